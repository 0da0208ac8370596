"""Substring dedup by sliding spans of sentences.

A sentence ends at a word that ends in '.', '!' or '?', behind a full stop of another
script (these end a sentence inside a word too), either with closing quotes and
brackets behind it, or at a line break. Every run of at least two consecutive
sentences and MIN_WORDS words, and every sentence of LONG words, is looked up over
the whole table, over words with A-Z in lower case and without regard to white
space. Of each repeated run the occurrence with the smallest doc_id (in it, the
earliest) is the first, and every sentence that a non-first occurrence covers is
removed. Scripts without spaces count two characters as a word.

Only the shortest run from each sentence on and up to each sentence is hashed; the
outcome is that of hashing all: where a run repeats, so do the shortest ones inside
it. Let [i, ..] be the last of these that fits into a run: those from its first
sentence to i cover it up to where that one ends, and the shortest run up to its last
sentence begins at i. A run is told by two independent hashes of 64 bits. A
document sends each of its runs once, counts are combined before the shuffle, and
the join back can split a frequent run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import save
from precedent.llm.tokens import Hasher, Texts, _powers, id_array, mix, texts, words

MIN_WORDS = 12
LONG = 25
SLICE = 1 << 20
_U = np.uint64
_OTHER = _U(0xC2B2AE3D27D4EB4F)

#: Characters that end a sentence, those of them that also do so inside
#: a word, and what may follow them: closing quotes and brackets.
ENDS = ".!?\u037e\u0589\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u1367\u17d4\u17d5\u203c\u203d\u2047\u2048\u2049\u3002\uff01\uff0e\uff1f\uff61"
INNER = "\u0964\u0965\u104a\u104b\u17d4\u17d5\u3002\uff01\uff0e\uff1f\uff61"
CLOSERS = "\"')]}\u00bb\u2019\u201d\u203a\u3009\u300b\u300d\u300f\u3011\uff09\uff3d\uff5d\uff63"
#: Ranges of letters written without spaces.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF),
            (0x20000, 0x3FFFF)]


def _among(chars: str) -> np.ndarray:
    """Table over the code points below 0x10000."""
    out = np.zeros(0x10000, bool)
    out[[ord(c) for c in chars]] = True
    return out


_ENDS, _INNER, _CLOSERS = _among(ENDS), _among(INNER), _among(CLOSERS)


def _closed(points: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each end of a sentence and each closer behind one in the same text.
    ``heads``: where texts begin."""
    low = np.where(points < 0x10000, points, 0)
    out = np.zeros(len(points), bool)
    at = np.flatnonzero(ends[low] | _CLOSERS[low])
    if not len(at):
        return out
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | np.isin(at[1:], heads)
    stop = ends[low[at]]
    seen = np.cumsum(stop)
    first = np.flatnonzero(fresh)
    before = np.repeat(seen[first] - stop[first], np.diff(np.append(first, len(at))))
    out[at] = seen > before
    return out


class Runs:
    """Sentences and runs of one slice of texts."""

    def __init__(self, t: Texts, hasher: Hasher, min_words: int, long: int) -> None:
        low = t.lower()
        w = words(low)
        start, end, bound = w.start, w.end, w.bound
        if len(t.buf) and t.buf.max() >= 128:
            points = np.frombuffer(t.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((t.buf & 0xC0) != 0x80)  # first byte of each character
            heads = np.searchsorted(at, t.off[:-1])
            closed = np.repeat(_closed(points, heads, _ENDS), np.diff(np.append(at, len(t.buf))))
            inner = _closed(points, heads, _INNER)
            turn = np.flatnonzero(inner[:-1] & ~inner[1:])
            cut = at[turn + 1]  # a word ends before these bytes
            k = np.searchsorted(start, cut, "right") - 1
            inside = k >= 0
            inside[inside] = (start[k[inside]] < cut[inside]) & (cut[inside] < end[k[inside]])
            cut = cut[inside]
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
            bound = np.searchsorted(start, t.off)
            unspaced = np.zeros(len(points), bool)
            for a, z in UNSPACED:
                unspaced |= (points >= a) & (points <= z)
            count = np.concatenate([[0], np.cumsum(unspaced)])
            size = np.maximum(1, (count[np.searchsorted(at, end)] - count[np.searchsorted(at, start)]) // 2)
        else:
            closed = _closed(t.buf, t.off[:-1], _ENDS)
            size = np.ones(len(start), np.int64)
        n = len(start)
        lines = np.concatenate([[0], np.cumsum(t.buf == 10)])
        opens = np.zeros(n, bool)
        if n:
            opens[1:] = closed[end[:-1] - 1] | (lines[start[1:]] > lines[end[:-1]])
            opens[bound[:-1][np.diff(bound) > 0]] = True
        a = np.flatnonzero(opens)  # first word of each sentence
        z = np.append(a[1:], n) if len(a) else a  # end of each sentence, in words
        self.bound = np.searchsorted(a, bound)  # sentences of each text
        self.start = start[a] if n else a
        doc = np.repeat(np.arange(t.n), np.diff(self.bound))
        upto = np.concatenate([[0], np.cumsum(size)])
        lo, hi, i = upto[a], upto[z], np.arange(len(a))
        alone = hi - lo >= long
        fwd = np.searchsorted(hi, lo + min_words, "left")
        fwd = np.where(alone, i, np.maximum(fwd, i + 1))
        back = np.searchsorted(lo, hi - min_words, "right") - 1
        back = np.where(alone, i, np.minimum(back, i - 1))
        ok_f = fwd < self.bound[1:][doc]
        ok_b = back >= self.bound[:-1][doc]
        pairs = np.unique(np.concatenate([np.stack([i[ok_f], fwd[ok_f]], 1), np.stack([back[ok_b], i[ok_b]], 1)]), axis=0) \
            if len(a) else np.zeros((0, 2), np.int64)
        self.s, self.e = pairs[:, 0], pairs[:, 1]  # first and last sentence of each run
        self.doc = doc[self.s] if len(a) else self.s
        hashes = hasher.spans(low.buf, start, end)
        up, down = _powers(n + 1)
        x, y = (a[self.s], z[self.e]) if len(a) else (self.s, self.s)

        def over(values):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * up[:n])])
            return mix((sums[y] - sums[x]) * down[x] + (y - x).astype(_U)).view(np.int64)

        self.hash, self.proof = over(hashes), over(mix(hashes ^ _OTHER))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
         long: int = LONG) -> DataFrame:
    """(hash, proof, doc_id): each distinct run of each text; rows without id have none."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            ids, _ = id_array(b.column(0))
            for t in texts(b.column(1), SLICE):
                r = Runs(t, hasher, min_words, long)
                own = np.unique(np.stack([r.doc, r.hash], 1), axis=0, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(r.hash[own]), pa.array(r.proof[own]), pa.array(ids[t.first + r.doc[own]])],
                                                 ["hash", "proof", "doc_id"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.where("doc_id is not null").mapInArrow(run, "hash long, proof long, doc_id long")


def _cleaned(min_words, long):
    def run(batches):
        hasher = Hasher()
        for b in batches:
            marks = b.column(2)
            for t in texts(b.column(1), SLICE):
                r = Runs(t, hasher, min_words, long)
                gone = np.zeros(len(r.start) + 1, np.int64)
                marked = [marks[t.first + d].as_py() for d in range(t.n)]
                later = np.ones(len(r.s), bool)  # of runs that occur twice in a text, all but the first
                later[np.unique(np.stack([r.doc, r.hash], 1), axis=0, return_index=True)[1]] = False
                edge = np.searchsorted(r.doc, np.arange(t.n + 1))
                for d, m in enumerate(marked):
                    if m:
                        at = slice(edge[d], edge[d + 1])
                        later[at] |= np.isin(r.hash[at], np.array(m, np.int64))
                np.add.at(gone, r.s[later], 1)
                np.add.at(gone, r.e[later] + 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                n, out, removed = np.diff(r.bound), [], []
                whole = t.buf.tobytes()
                for d in range(t.n):
                    i, j = int(r.bound[d]), int(r.bound[d + 1])
                    lo, hi = int(t.off[d]), int(t.off[d + 1])
                    cut = np.flatnonzero(gone[i:j])
                    removed.append(cut.tolist())
                    if not len(cut):
                        out.append(whole[lo:hi])
                        continue
                    edges = [lo, *r.start[i + 1 : j].tolist(), hi]
                    out.append(b"".join(whole[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone[i:j]).tolist()))
                rows = b.column(0).slice(t.first, t.n)
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(n.astype(np.int64)), pa.array([len(x) for x in removed], pa.int64()),
                     pa.array(removed, pa.list_(pa.int32())), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_sentences", "n_removed", "removed", "clean_text"])

    return run


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
               long: int = LONG) -> DataFrame:
    """One row per input row: doc_id, n_sentences, n_removed, removed (numbers
    of the removed sentences, from 0), clean_text (what is left, byte for byte).

    A null text counts as empty. Texts below ``min_words`` words or of one
    sentence below ``long`` words have no runs and stay. A text whose repeat begins or
    ends inside a sentence loses the whole sentences of the repeat. Rows with a null id
    lose only repeats inside themselves and are first for nobody; rows repeated
    with one id are one document. Other columns are not read; an empty table
    gives an empty result."""
    found = save(runs(docs, id_col, text_col, min_words, long), "runs")
    repeated = found.groupBy("hash", "proof").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    marks = (found.join(repeated.select("hash", "proof", "first"), ["hash", "proof"]).where("doc_id <> first").groupBy("doc_id")
             .agg(F.collect_set("hash").alias("marks")))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_sentences long, n_removed long, removed array<int>, clean_text string"
    return src.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(_cleaned(min_words, long), schema)
