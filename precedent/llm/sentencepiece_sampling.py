"""Sampled SentencePiece segmentations, and lossless decoding.

A text is a sequence of chunks (a run of spaces with the run of other bytes after
it; a line break alone) that no piece of the model crosses, so its piece lattice
is a chain of chunk lattices. Forward filtering sums, for each place of a chunk,
the weight of all segmentations up to it; backward sampling draws pieces from the
end, each with its exact posterior probability. Forward tables are made once per
distinct chunk of a slice, for all of them at once; draws are made once per
occurrence. Random numbers are a hash of the row key, the place of the chunk in
its text and the step, so a row gets the same segmentation wherever it is
processed.

Weights: a piece of a unigram model weighs exp(alpha * score). Scores of a BPE
model are only merge ranks, which Zipf's law turns into weights: (rank + 1) to
the power -alpha. A larger alpha favours frequent (mostly longer) pieces.

Ids are those of the model. White space is kept as it is; a character that has
no piece, and a literal U+2581, go out as their bytes; so decode(encode(x)) = x
for every text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precedent.llm.tokens import _BYTES, Hasher, Texts, id_array, mix, texts

MODEL = "piece_bpe_32k.model"
SLICE = 1 << 20  # bytes of text encoded at a time
WIDE = 48  # chunks of more bytes go one by one
STEP = 1 << 14  # distinct chunks of one forward table
_U = np.uint64
_MARK = "▁"


def model_path() -> str:
    """Where the public model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Lattice:
    """Pieces and weights of a model. A piece is held as bytes with spaces."""

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(sp)
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.dummy = bool(sp.encode("a", out_type=str)[0].startswith(_MARK))
        self.surface: list[bytes] = [b""] * n
        self.byte = np.zeros(256, np.int64)
        ids, merges = {}, bool((scores[scores < 0] % 1 == 0).all())
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.surface[i] = bytes([int(piece[3:5], 16)])
                self.byte[self.surface[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.surface[i] = piece.replace(_MARK, " ").encode()
                ids[self.surface[i]] = i
        if not all(sp.is_byte(int(i)) for i in self.byte):
            raise ValueError("the model has no byte pieces")
        crossing = [p for p in ids if re.search(rb"[^ ] |\n.|.\n", p)]
        if crossing:
            raise ValueError(f"pieces cross chunks: {crossing[:3]}")
        floor = scores[scores > -1e8].min() - 1
        scores = np.where(scores > -1e8, scores, floor)
        log = -np.log1p(-scores) if merges else scores
        self.weight = np.exp(alpha * log)
        self.weight[self.byte] = np.exp(alpha * (log.min() - 1))
        self.single = {p for p in ids if len(p.decode()) == 1}
        self.longest = max(map(len, ids))
        order = sorted(ids.items())
        flat = b"".join(p for p, _ in order)
        size = np.array([len(p) for p, _ in order])
        ends = np.cumsum(size)
        keys = Hasher().spans(np.frombuffer(flat, np.uint8), ends - size, ends)
        self.of = {p: i for p, i in order}
        at = np.argsort(keys)
        self.keys, self.ids = keys[at], np.array([i for _, i in order])[at]
        self.bits = 18
        self.table = np.zeros(1 << self.bits, np.int32)  # place + 1 of the first key with these top bits
        top = (self.keys >> _U(64 - self.bits)).astype(np.int64)
        self.table[top[::-1]] = np.arange(len(top), 0, -1)
        self.run = int(np.bincount(top).max())
        size = np.array([len(p) for p in self.surface])
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        at = self.table[(keys >> _U(64 - self.bits)).astype(np.int64)]
        out = np.full(len(keys), -1, np.int64)
        live = np.flatnonzero(at)
        place = at[live].astype(np.int64) - 1
        for _ in range(self.run):
            hit = self.keys[place] == keys[live]
            out[live[hit]] = self.ids[place[hit]]
            live, place = live[~hit], place[~hit] + 1
            ok = place < len(self.keys)
            live, place = live[ok], place[ok]
            if not len(live):
                break
        return out

    def decode(self, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of ids[bound[i]:bound[i + 1]]."""
        size = self.off[ids + 1] - self.off[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.off[ids] - ends[:-1], size) + np.arange(ends[-1])
        buf, off = self.flat[at], ends[bound]
        if self.dummy:  # each text that isn't empty began with one space more
            first = off[:-1][off[1:] > off[:-1]]
            buf = np.delete(buf, first)
            off = off - np.searchsorted(first, off, "left")
        return buf, off


def chunks(t: Texts, dummy: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (with the space that goes before each text), chunk starts, ends,
    and the chunks of each text."""
    buf, off = t.buf, t.off
    if dummy:
        full = off[1:] > off[:-1]
        buf = np.insert(buf, off[:-1][full], 32)
        off = off + np.concatenate([[0], np.cumsum(full)])
    if not len(buf):
        z = np.zeros(0, np.int64)
        return buf, z, z, np.zeros(t.n + 1, np.int64)
    space, line = buf == 32, buf == 10
    opens = np.zeros(len(buf), bool)
    opens[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    opens[off[:-1][off[1:] > off[:-1]]] = True
    start = np.flatnonzero(opens)
    return buf, start, np.append(start[1:], len(buf)), np.searchsorted(start, off)


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    x = seed + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(x) >> _U(11)).astype(np.float64) * 2.0**-53


def _bare(lat: Lattice, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks bytes of characters that have no piece of their own."""
    high = np.flatnonzero(buf >= 0x80)
    out = np.zeros(len(buf), bool)
    for b in range(128):
        if bytes([b]) not in lat.single:
            out |= buf == b
    if len(high):
        lead = high[buf[high] >= 0xC0]
        size = np.where(buf[lead] >= 0xF0, 4, np.where(buf[lead] >= 0xE0, 3, 2))
        code = np.zeros(len(lead), np.int64)
        for j in range(4):
            code = code * 256 + np.where(size > j, buf[np.minimum(lead + j, len(buf) - 1)], 0)
        kinds, one, at = np.unique(code, return_index=True, return_inverse=True)
        miss = np.array([buf[lead[i] : lead[i] + size[i]].tobytes() not in lat.single for i in one], bool)[at]
        for j in range(4):
            out[lead[miss & (size > j)] + j] = True
    return out


class Table:
    """Forward sums and, for each place of each chunk, the pieces that end there
    with their cumulative posterior shares. Place p of chunk c is state
    c * (WIDE + 1) + p."""

    def __init__(self, lat: Lattice, hasher: Hasher, buf, start, size, bare) -> None:
        """Chunks in order of falling size, none above WIDE bytes."""
        n, longest = len(start), int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(longest + 1), "right")  # chunks of at least p bytes
        up, down = hasher.up, hasher.down
        # prefix sums of the hash, place by place
        sums = np.zeros((longest + 1, n), _U)
        lone = np.zeros((longest, n), bool)
        for p in range(longest):
            m = live[p + 1]
            at = buf[start[:m] + p]
            sums[p + 1, :m] = sums[p, :m] + _BYTES[at] * up[p]
            lone[p, :m] = bare[start[:m] + p]
        alpha = np.zeros((longest + 1, n))
        alpha[0] = 1
        state, piece, share, back = [], [], [], []
        for p in range(1, longest + 1):
            m = live[p]
            for w in range(min(p, lat.longest), 0, -1):  # long pieces first: the likelier
                q = p - w
                some = np.flatnonzero(alpha[q, :m] > 0)
                if not len(some):
                    continue
                key = mix((sums[p, some] - sums[q, some]) * down[q] + _U(w))
                ids = lat.find(key)
                if w == 1:
                    alone = lone[q, some]
                    ids[alone] = lat.byte[buf[start[some[alone]] + q]]
                hit = ids >= 0
                c, ids = some[hit], ids[hit]
                x = alpha[q, c] * lat.weight[ids]
                alpha[p, c] += x
                state.append(c * (WIDE + 1) + p)
                piece.append(ids)
                share.append(x)
                back.append(np.full(len(c), w))
            if p % 8 == 0 and m:  # hold off underflow: scale the last places of a chunk alike
                low = max(0, p - lat.longest)
                scale = alpha[low : p + 1, :m].max(axis=0)
                scale[scale <= 0] = 1
                alpha[low : p + 1, :m] /= scale
        none = np.zeros(0, np.int64)
        state, piece, back = (np.concatenate([none, *x]) for x in (state, piece, back))
        share = np.concatenate([np.zeros(0), *share])
        order = np.argsort(state, kind="stable")
        state, share = state[order], share[order]
        self.piece, self.back = piece[order].astype(np.int32), back[order]
        first = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]])) if len(state) else none
        sizes = np.diff(np.append(first, len(state)))
        # cumulative shares within each state, up to one; first divided by their
        # sum, as the sums of different states differ by many orders
        if len(first):
            share = share / np.repeat(np.add.reduceat(share, first), sizes)
        self.cum = np.cumsum(share)
        self.cum -= np.repeat(self.cum[first] - share[first], sizes)
        self.cum[np.append(first[1:], len(state))[: len(first)] - 1] = 1.0
        self.first = np.zeros(n * (WIDE + 1) + 1, np.int32)
        self.first[state[first]] = first

    def draw(self, chunk, size, seed):
        """Pieces of each occurrence (chunk number, its bytes, its seed): ids in
        text order and their number for each occurrence."""
        n = len(chunk)
        at, live = size.copy(), np.arange(n)
        who, what = [], []
        step = 0
        while len(live):
            state = chunk[live] * (WIDE + 1) + at[live]
            u = _uniform(seed[live], step)
            edge = self.first[state]
            more = np.flatnonzero(u >= self.cum[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.cum[edge[more]]]
            who.append(live)
            what.append(self.piece[edge])
            at[live] -= self.back[edge]
            live = live[at[live] > 0]
            step += 1
        count = np.zeros(n, np.int64)
        for x in who:
            count[x] += 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if n else 0, np.int32)
        for s, (x, ids) in enumerate(zip(who, what)):
            out[ends[x] - 1 - s] = ids  # drawn from the end
        return out, count


def _long(lat: Lattice, raw: bytes, bare: np.ndarray, seed: int) -> list[int]:
    """The same draw for one chunk of any size, with logarithms."""
    n = len(raw)
    log = np.full(n + 1, -np.inf)
    log[0] = 0
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    weight = np.log(lat.weight)
    for p in range(n):
        if log[p] == -np.inf:
            continue
        edges = [(p + 1, int(lat.byte[raw[p]]))] if bare[p] else []
        edges += [(q, lat.of[raw[p:q]]) for q in range(p + 1, min(n, p + lat.longest) + 1) if raw[p:q] in lat.of]
        for q, i in edges:
            x = log[p] + weight[i]
            into[q].append((p, i, x))
            log[q] = np.logaddexp(log[q], x)
    out, p, step = [], n, 0
    while p:
        u = float(_uniform(np.array([seed], _U), step)[0])
        x = np.cumsum(np.exp(np.array([e[2] for e in into[p]]) - log[p]))
        p, i, _ = into[p][min(int(np.searchsorted(x / x[-1], u, "left")), len(x) - 1)]
        out.append(i)
        step += 1
    return out[::-1]


def encode_slice(lat: Lattice, hasher: Hasher, t: Texts, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of the texts of a slice, one after the other, and the bounds
    of each text. keys: 64-bit row keys."""
    buf, start, end, bound = chunks(t, lat.dummy)
    size, n = end - start, len(start)
    bare = _bare(lat, buf, start, end)
    doc = np.repeat(np.arange(t.n), np.diff(bound))
    place = np.arange(n) - bound[:-1][doc]
    seeds = mix(mix(keys + _U(seed))[doc] + place.astype(_U) * _U(0xD6E8FEB86659FD93))
    short = np.flatnonzero(size <= WIDE)
    hashes = hasher.spans(buf, start, end)[short]
    _, one, at = np.unique(hashes, return_index=True, return_inverse=True)
    one = short[one]
    order = np.argsort(-size[one], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at, one = rank[at], one[order]
    count = np.zeros(n, np.int64)
    got = []
    step = STEP
    group = at // step
    by = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[by], np.arange(-(-len(one) // step) + 1))
    for g in range(len(edge) - 1):
        own = one[g * step : (g + 1) * step]
        table = Table(lat, hasher, buf, start[own], size[own], bare)
        occ = by[edge[g] : edge[g + 1]]
        who = short[occ]
        ids, c = table.draw(at[occ] - g * step, size[who], seeds[who])
        count[who] = c
        got.append((who, ids, c))
    for c in np.flatnonzero(size > WIDE).tolist():
        ids = np.array(_long(lat, buf[start[c] : end[c]].tobytes(), bare[start[c] : end[c]], int(seeds[c])), np.int64)
        count[c] = len(ids)
        got.append((np.array([c]), ids, np.array([len(ids)])))
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(ends[-1]), np.int32)
    for who, ids, c in got:
        first = np.cumsum(c) - c
        out[np.repeat(ends[who] - first, c) + np.arange(len(ids))] = ids
    return out, ends[bound]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           alpha: float = 1.0, seed: int = 1, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (array<int>; null where the text is
    null), n_pieces, lossless (the ids decode to the text), and the columns that
    ``keep`` names and defines.

    An empty text has no ids. Rows of equal id and text get equal ids; a null id
    is a key like any other. ``path`` must name the model on every machine.
    Other columns are not read; an empty table gives an empty result."""
    path = path or model_path()

    def run(batches):
        lat, hasher = Lattice(path, alpha), Hasher()
        for b in batches:
            ids, nulls = id_array(b.column(0))
            keys = mix(ids.view(_U) + nulls.astype(_U) * _U(0xA5A5A5A5A5A5A5A5))
            gone = np.asarray(b.column(1).is_null())
            for t in texts(b.column(1), SLICE):
                rows = slice(t.first, t.first + t.n)
                out, bound = encode_slice(lat, hasher, t, keys[rows], seed)
                buf, off = lat.decode(out.astype(np.int64), bound)
                same = (np.diff(off) == np.diff(t.off))
                if len(buf) == len(t.buf) and same.all():
                    wrong = np.flatnonzero(buf != t.buf)
                    same[np.searchsorted(off, wrong, "right") - 1] = False
                else:
                    same &= False
                lists = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(out), mask=pa.array(gone[rows]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.first, t.n), lists, pa.array(np.diff(bound)), pa.array(same),
                     *(c.slice(t.first, t.n) for c in b.columns[2:])],
                    ["doc_id", "ids", "n_pieces", "lossless", *names])

    names = list(keep or {})
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *(c.alias(name) for name, c in (keep or {}).items()))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    return src.mapInArrow(run, f"doc_id long, ids array<int>, n_pieces long, lossless boolean{extra}")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, null members
    of a list nothing."""
    path = path or model_path()

    def run(batches):
        lat = Lattice(path)
        for b in batches:
            lists = b.column(1).to_pylist()
            flat = np.array([i for x in lists if x for i in x if i is not None], np.int64)
            bound = np.concatenate([[0], np.cumsum([sum(i is not None for i in x or ()) for x in lists])]).astype(np.int64)
            buf, off = lat.decode(flat, bound)
            raw = buf.tobytes()
            out = [None if x is None else raw[i:j].decode() for x, i, j in zip(lists, off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "doc_id long, text string")
