"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from
the nearest ancestor directory.

A file is cut into units: its sentences (a line break also ends one), two and
three neighbouring lines of one sentence, and the whole file. Each unit is a
sparse TF-IDF vector over words (runs of letters and digits, A-Z in lower case)
and is compared with every template. The best unit decides, if its cosine reaches
the threshold: these catch headers and notices anywhere in a file, wrapped or not.

Licence texts and long headers (the files of ``licenses``) have a vocabulary of
their own. The whole file is compared with them, and so is its licence block:
from the first to the last paragraph that has some cosine to one of them. A text
that is met decides before any notice in it.

Document frequencies are counted over the sentences of all files, for the words
of the templates (a bounded vocabulary); a word of no template counts as one that
occurs nowhere else, so it only lengthens the unit's vector, by the idf of an
unseen word for each time it occurs.

A line with an SPDX tag is compared with the tags of the known identifiers, and met
when it equals one word for word (cosine 1); one that names another licence, or
several, is not taken for the tag it resembles.

A file without a licence of its own takes that of the nearest directory at or
above its own that holds a licence file with a licence. Directories, not files,
are joined to their ancestors, with a salt, so that a root that covers
everything is no hot key.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import save
from precedent.llm.tokens import NOT_ALNUM, Hasher, Texts, texts, words

THRESHOLD = 0.6
TEXT_THRESHOLD = 0.8
BLOCK_FLOOR = 0.3
SALTS = 16
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
_U = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True

#: Usual licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2",
                "Licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "Licensed under the GNU General Public License, version 3"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0"],
}

#: What SPDX tags may name, by the identifier reported for it.
SPDX = {
    **{n: [n] for n in ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense",
                        "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")},
    **{n: [n, f"{n}-only", f"{n}-or-later"] for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
}
#: A tag is its words and nothing else: its cosine to another licence's tag is high too.
TAG_THRESHOLD = 0.999


def tags() -> dict[str, list[str]]:
    """One-line notices with an SPDX tag, by identifier."""
    return {n: [f"SPDX-License-Identifier: {name}" for name in names] for n, names in SPDX.items()}


def license_texts() -> dict[str, list[str]]:
    """The texts of the folder ``licenses``, by SPDX identifier."""
    out: dict[str, list[str]] = {}
    for file in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
        out.setdefault(file.name.removesuffix(".txt").removesuffix(".header"), []).append(file.read_text())
    return out


def _word_list(text: str) -> list[bytes]:
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return re.findall(rb"[a-z0-9\x80-\xff]+", raw)


class Templates:
    """Template words, by hash, and their counts in each template."""

    def __init__(self, table: dict[str, list[str]]) -> None:
        self.names, bags = [], []
        for name, notices in table.items():
            for notice in notices:
                self.names.append(name)
                bags.append(Counter(_word_list(notice)))
        vocabulary = sorted(set().union(*bags)) if bags else []
        flat = b"".join(vocabulary)
        ends = np.cumsum([len(v) for v in vocabulary]).astype(np.int64)
        starts = ends - np.array([len(v) for v in vocabulary], np.int64)
        keys = Hasher().spans(np.frombuffer(flat, np.uint8), starts, ends)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = np.array([[bag[vocabulary[i]] for i in order] for bag in bags], float).reshape(len(bags), len(vocabulary))

    def vectors(self, idf: np.ndarray) -> np.ndarray:
        v = self.counts * idf
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


class Slice:
    """The words of a slice of texts, their hashes, and where pieces (sentences
    and lines) and paragraphs begin."""

    def __init__(self, t: Texts, hasher: Hasher) -> None:
        low = t.lower()
        w = words(low, NOT_ALNUM)
        self.n_docs, n = t.n, len(w.start)
        self.hashes, self.doc, self.bound = hasher.spans(low.buf, w.start, w.end), w.doc(), w.bound
        stop, space = _ENDS[t.buf], (t.buf == 32) | ((t.buf >= 9) & (t.buf <= 13))
        ended = np.zeros(len(t.buf), bool)  # white space at i after an end of sentence
        ended[1:] = space[1:] & stop[:-1]
        line = t.buf == 10

        def between(marks):
            total, out = np.concatenate([[0], np.cumsum(marks)]), np.zeros(n, np.int64)
            if n:
                out[1:] = total[w.start[1:]] - total[w.end[:-1]]
            return out

        head = np.zeros(n, bool)
        head[w.bound[:-1][np.diff(w.bound) > 0]] = True
        lines, ends = between(line), between(ended)
        opens = head | (between(line | ended) > 0)
        self.first = np.flatnonzero(opens)
        self.piece, self.paragraph = np.cumsum(opens) - 1, np.cumsum(head | (lines > 1)) - 1
        #: pieces that go on with the sentence of the line before
        self.wrapped = (~head & (lines == 1) & (ends == 0))[self.first]


class Units:
    """Counts of template words in units, which are lists of (unit, word) pairs.
    doc and size: the text and the number of words of each unit."""

    def __init__(self, unit, hashes, keys, doc, size) -> None:
        self.doc, self.size = doc, size.astype(float)
        cell = unit * len(keys) + hashes
        cells, counts = np.unique(cell, return_counts=True)
        self.unit, self.word, self.count = cells // max(len(keys), 1), cells % max(len(keys), 1), counts.astype(float)

    def best(self, idf: np.ndarray, unseen: float, vectors: np.ndarray):
        """Best cosine and template of each unit that has a template word."""
        who, at = np.unique(self.unit, return_inverse=True)
        x = self.count * idf[self.word]
        own = np.bincount(at, x * x, len(who))
        alien = self.size[who] - np.bincount(at, self.count, len(who))
        norm = np.sqrt(own + alien * unseen * unseen)
        dots = np.stack([np.bincount(at, x * v[self.word], len(who)) for v in vectors]) if len(vectors) else np.zeros((1, len(who)))
        k = dots.argmax(axis=0)
        return who, dots[k, np.arange(len(who))] / np.maximum(norm, 1e-300), k


def _hits(w: Slice, keys: np.ndarray):
    """Words that are template words, and which."""
    at = np.minimum(np.searchsorted(keys, w.hashes), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[at] == w.hashes) if len(keys) else np.zeros(0, np.int64)
    return hit, at[hit]


def notice_units(w: Slice, keys: np.ndarray) -> Units:
    """Pieces, whole texts, two and three lines from each piece on."""
    hit, at = _hits(w, keys)
    p, n = w.piece[hit], len(w.first)
    size, doc = np.bincount(w.piece, minlength=n), w.doc[w.first]
    unit, word, sizes, docs = [p, n + w.doc[hit]], [at, at], [size, np.diff(w.bound)], [doc, np.arange(w.n_docs)]
    goes_on, run = np.ones(n, bool), size
    for k in (1, 2):
        goes_on = goes_on & np.concatenate([w.wrapped[k:], np.zeros(min(k, n), bool)])[:n]
        run = run + np.concatenate([size[k:], np.zeros(min(k, n), np.int64)])[:n]
        base = n + w.n_docs + (k - 1) * n
        for back in range(k + 1):
            start = p - back
            ok = start >= 0
            ok[ok] = goes_on[start[ok]]
            unit.append(base + start[ok])
            word.append(at[ok])
        sizes.append(run)
        docs.append(doc)
    return Units(np.concatenate(unit), np.concatenate(word), keys, np.concatenate(docs), np.concatenate(sizes))


def text_scores(w: Slice, table: Templates, idf: np.ndarray, unseen: float, vectors: np.ndarray):
    """Of each text: cosine and template of its licence block or the whole of it,
    and the block's first piece in it (-1 the whole)."""
    hit, at = _hits(w, table.keys)
    n = int(w.paragraph[-1]) + 1 if len(w.paragraph) else 0
    first = np.searchsorted(w.paragraph, np.arange(n))
    units = Units(np.concatenate([w.paragraph[hit], n + w.doc[hit]]), np.tile(at, 2), table.keys,
                  np.concatenate([w.doc[first], np.arange(w.n_docs)]),
                  np.concatenate([np.bincount(w.paragraph, minlength=n), np.diff(w.bound)]))
    score, name, piece = np.zeros(w.n_docs), np.zeros(w.n_docs, np.int64), np.full(w.n_docs, -1)
    who, cosine, k = units.best(idf, unseen, vectors)
    whole = who >= n
    score[who[whole] - n], name[who[whole] - n] = cosine[whole], k[whole]
    near = who[(cosine >= BLOCK_FLOOR) & ~whole]
    lo, hi = np.full(w.n_docs, n), np.full(w.n_docs, -1)
    np.minimum.at(lo, units.doc[near], near)
    np.maximum.at(hi, units.doc[near], near)
    inside = (w.paragraph >= lo[w.doc]) & (w.paragraph <= hi[w.doc])
    mine = inside[hit]
    block = Units(w.doc[hit][mine], at[mine], table.keys, np.arange(w.n_docs), np.bincount(w.doc[inside], minlength=w.n_docs))
    who, cosine, k = block.best(idf, unseen, vectors)
    better = cosine > score[who] + 1e-12
    who = who[better]
    score[who], name[who] = cosine[better], k[better]
    piece[who] = w.piece[first[lo[who]]] - w.piece[w.bound[who]]
    return score, name, piece


def _frequencies(keys):
    def run(batches):
        hasher, units, df = Hasher(), 0, np.zeros(len(keys), np.int64)
        for b in batches:
            for t in texts(b.column(0)):
                w = Slice(t, hasher)
                hit, at = _hits(w, keys)
                units += len(w.first)
                df += np.bincount(np.unique(w.piece[hit] * max(len(keys), 1) + at) % max(len(keys), 1), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[units], df]))], ["i", "n"])

    return run


def _scan(table, idf, long, long_idf, tag, tag_idf, unseen, threshold, text_threshold):
    vectors, long_vectors, tag_vectors = table.vectors(idf), long.vectors(long_idf), tag.vectors(tag_idf)

    def run(batches):
        hasher = Hasher()
        for b in batches:
            for t in texts(b.column(2)):
                w = Slice(t, hasher)
                u, n = notice_units(w, table.keys), len(w.first)
                who, cosine, k = u.best(idf, unseen, vectors)
                # per text the best unit; ties to the earliest, sentences before the whole
                order = np.lexsort((who, -np.round(cosine, 12), u.doc[who]))
                doc = u.doc[who[order]]
                top = order[np.concatenate([[True], doc[1:] != doc[:-1]])] if len(doc) else order
                name, score, unit = [None] * t.n, np.zeros(t.n), [None] * t.n
                for i in top.tolist():
                    d = int(u.doc[who[i]])
                    score[d] = min(1.0, cosine[i])
                    if cosine[i] >= threshold:
                        name[d] = table.names[k[i]]
                        whole = n <= who[i] < n + t.n
                        piece = who[i] if who[i] < n else (who[i] - n - t.n) % max(n, 1)
                        unit[d] = -1 if whole else int(piece - w.piece[w.bound[d]])
                if b"spdx" in t.buf.tobytes().lower():
                    tagged = notice_units(w, tag.keys)
                    who, cosine, k = tagged.best(tag_idf, unseen, tag_vectors)
                    for i in np.flatnonzero((cosine >= TAG_THRESHOLD) & (who < n))[::-1].tolist():  # the first of a text stays
                        d = int(tagged.doc[who[i]])
                        name[d], score[d], unit[d] = tag.names[k[i]], min(1.0, cosine[i]), int(who[i] - w.piece[w.bound[d]])
                text_score, text_name, text_piece = text_scores(w, long, long_idf, unseen, long_vectors)
                for d in np.flatnonzero(text_score >= text_threshold).tolist():
                    name[d], score[d], unit[d] = long.names[text_name[d]], min(1.0, text_score[d]), int(text_piece[d])
                rows = [c.slice(t.first, t.n) for c in b.columns[:2]]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(name, pa.string()), pa.array(score), pa.array(unit, pa.int64())],
                    ["file_id", "path", "own", "score", "unit"])

    return run


def scan_licenses(files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text",
                  templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD,
                  license_file: str = LICENSE_FILE, full_texts: dict[str, list[str]] | None = None,
                  text_threshold: float = TEXT_THRESHOLD, tag_lines: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per input row: file_id, path, license (null if none), how ('own',
    'inherited' or null), score (best cosine of the file's own units), unit
    (number of the first deciding sentence, -1 the whole file, null if none), from_dir
    (the directory a licence is inherited from).

    A path is a slash-separated list of names; leading and doubled slashes don't
    matter, and a null path lies in the root. Of several licence files in one
    directory the one with the highest score decides, then the smallest name of
    a licence. A licence file also covers files below its directory, but never
    overrules a licence of their own. A null text counts as empty and has none
    of its own. Rows repeated are scanned alike. Other columns are not read; an
    empty table gives an empty result. Paths are joined over as many
    ancestors as they have."""
    table = Templates(TEMPLATES if templates is None else templates)
    long = Templates(license_texts() if full_texts is None else full_texts)
    tag = Templates(tags() if tag_lines is None else tag_lines)
    keys = np.union1d(np.union1d(table.keys, long.keys), tag.keys)
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(path_col).cast("string"), F.lit("")), "/+", "/"), "^/", "")
    src = files.select(F.col(id_col).cast("long").alias("file_id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    got = src.select("text").mapInArrow(_frequencies(keys), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = {r["i"]: r["n"] for r in got}
    units = n.get(-1, 0)
    every = np.array([math.log((1 + units) / (1 + n.get(i, 0))) + 1 for i in range(len(keys))])
    idf, long_idf, tag_idf = (every[np.searchsorted(keys, x.keys)] for x in (table, long, tag))
    unseen = math.log(1 + units) + 1
    scan = _scan(table, idf, long, long_idf, tag, tag_idf, unseen, threshold, text_threshold)
    own = save(src.mapInArrow(scan, "file_id long, path string, own string, score double, unit long")
               .withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "license-scan")
    given = own.where(F.col("own").isNotNull() & F.col("path").rlike(license_file)).groupBy("dir").agg(
        F.max("score").alias("best"))
    given = own.where(F.col("own").isNotNull() & F.col("path").rlike(license_file)).join(given, "dir").where(
        "score = best").groupBy("dir").agg(F.min("own").alias("dir_license"))
    names = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(names))
    above = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("dir")))
    salt = F.pmod(F.xxhash64("from"), F.lit(SALTS))
    dirs = own.select("dir").distinct()
    climbed = dirs.select(F.col("dir").alias("from"), F.explode(above).alias("up")).select(
        "from", F.col("up.dir").alias("dir"), F.col("up.depth").alias("depth"), salt.cast("int").alias("salt"))
    spread = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nearest = climbed.join(spread, ["dir", "salt"]).groupBy("from").agg(
        F.max_by(F.struct("dir", "dir_license"), "depth").alias("near"))
    inherited = nearest.select(F.col("from").alias("dir"), F.col("near.dir").alias("near_dir"), F.col("near.dir_license").alias("near_license"))
    # files meet their directory; a directory that holds very many is split by the skew join
    out = own.join(inherited, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select("file_id", "path", F.coalesce("own", "near_license").alias("license"),
                      F.when(has, "own").when(F.col("near_license").isNotNull(), "inherited").alias("how"),
                      "score", "unit", F.when(~has, F.col("near_dir")).alias("from_dir"))
