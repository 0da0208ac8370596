"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, which makes a word a reduced word. All
reduced words one edit away (the full neighbourhood: every deletion, every
replacement and every insertion of a symbol, and the reduced word itself) are
generated for each word of the vocabulary and joined to the reduced vocabulary;
what meets is verified on the original words. An edit of a word is an edit of its
reduced word or leaves that unchanged, so no near word is missed, and with s
symbols a word of length L has about 2 s L neighbours instead of 2 * 190 L.

Reduced words are never built: a 64-bit polynomial over their symbols gives the
hash of each neighbour from prefix sums, in blocks of a bounded size whatever the
length of the word. A bit filter of the reduced vocabulary (of at most
``FILTER_BITS`` bits, whatever the vocabulary) spares the shuffle most neighbours
that no word has; it changes no result. Words longer than ``INLINE`` travel as
ids and are fetched for the verification, so a row stays small.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import save
from precedent.llm.tokens import mix

#: Symbols that letters are hashed to.
SYMBOLS = 16
#: Shortest word, in code points, and fewest occurrences of one.
MIN_LENGTH = 7
MIN_COUNT = 2
#: Every RULE-th run, by crc32 of its document and itself, loses a letter.
RULE = 31
#: A form has at least so many times a word's occurrences.
RATIO = 10
#: Code points up to which a word travels with its neighbours.
INLINE = 64
#: Most bits of the filter (16 MB), and how many each word sets.
FILTER_BITS = 1 << 27
_HASHES = 3
#: Words counted in a task before they are handed on, neighbours hashed at a time.
_HELD = 200_000
_BLOCK = 1 << 18

_U = np.uint64
_ALL = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _counted(shortest: int, rule: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held = Counter()
        for b in batches:
            ids, docs = b.column(0), b.column(1).cast(pa.binary())
            for i in range(b.num_rows):
                raw = docs[i].as_py()
                if not raw:
                    continue
                seed = zlib.crc32(f"{ids[i].as_py() or ''}:".encode())
                for w in runs.findall(raw.lower().decode()):  # lower() of bytes changes A-Z alone
                    h = zlib.crc32(w.encode(), seed)
                    if h % rule == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < shortest:
                            continue
                    held[w] += 1
                if len(held) > _HELD:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, rule: int = RULE) -> DataFrame:
    """(id, word, n) of the words of all whole texts, as a saved table. Counted in each
    task before the shuffle, so a frequent word is one row a task."""
    src = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    n = src.mapInArrow(_counted(min_length, rule), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return save(n.where(F.col("n") >= min_count).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


class Reduced:
    """Hashes of reduced words and of their neighbours, for words of one length."""

    def __init__(self, symbols: int):
        self.symbol_of = np.array([zlib.crc32(chr(c).encode()) % symbols for c in range(256)])
        self.value = mix(np.arange(1, symbols + 1, dtype=_U) * _U(_BASE))
        self.symbols = symbols

    @staticmethod
    def _key(h, length):
        return mix(h + _U(length * 0xD6E8FEB86659FD93 & _ALL)).view(np.int64)

    def _sums(self, words: list[str]):
        size = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)
        s = self.symbol_of[np.minimum(points, 255)]
        power = np.full(size + 1, _BASE, _U)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.zeros((len(words), size + 1), _U)
        np.cumsum(self.value[s] * power[:size], axis=1, out=sums[:, 1:])
        return s, power, sums

    def keys(self, words: list[str]) -> np.ndarray:
        return self._key(self._sums(words)[2][:, -1], len(words[0]))

    def neighbours(self, words: list[str]):
        """Blocks (word number, key); over all blocks each neighbour of a word once."""
        s, power, sums = self._sums(words)
        n, size = s.shape
        number, whole = np.arange(n), sums[:, -1]
        yield number, self._key(whole, size)
        step = max(1, _BLOCK // (n * self.symbols))
        for i in range(0, size, step):
            j = min(size, i + step)
            # of a run of equal symbols only the first is deleted
            other = s[:, i:j] != (s[:, i - 1 : j - 1] if i else np.column_stack([np.full(n, -1), s[:, : j - 1]]))
            less = sums[:, i:j] + (whole[:, None] - sums[:, i + 1 : j + 1]) * _U(_BACK)
            yield np.broadcast_to(number[:, None], other.shape)[other], self._key(less[other], size - 1)
            # [word, place, symbol]: another symbol instead, and a symbol before one that differs
            new = self.value[None, None, :] * power[None, i:j, None]
            differs = s[:, i:j, None] != np.arange(self.symbols)[None, None, :]
            at = np.broadcast_to(number[:, None, None], differs.shape)[differs]
            same = whole[:, None] - self.value[s[:, i:j]] * power[i:j]
            yield at, self._key((same[:, :, None] + new)[differs], size)
            more = sums[:, i:j] + (whole[:, None] - sums[:, i:j]) * _U(_BASE)
            yield at, self._key((more[:, :, None] + new)[differs], size + 1)
        last = whole[:, None] + self.value[None, :] * power[size]
        yield np.repeat(number, self.symbols), self._key(last.ravel(), size + 1)


def _by_length(words: list[str]):
    """Places of words of one length, as many together as fill a block."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        step = max(1, _BLOCK // (SYMBOLS * (size + 1)))
        for i in range(0, len(at), step):
            yield at[i : i + step]


def _keyed(symbols: int):
    def run(batches):
        reduced = Reduced(symbols)
        for b in batches:
            words, out = b.column(1).to_pylist(), np.zeros(b.num_rows, np.int64)
            for at in _by_length(words):
                out[at] = reduced.keys([words[i] for i in at])
            yield b.append_column("key", pa.array(out))

    return run


def _place(key: np.ndarray, j: int, bits: int) -> np.ndarray:
    """The bit that the filter's hash j gives each key."""
    return ((mix(key.view(_U) + _U((2 * j + 1) * _BASE & _ALL)) >> _U(3)) & _U(bits - 1)).astype(np.int64)


def _set_bits(bits: int):
    def run(batches):
        for b in batches:
            key = np.asarray(b.column(0)).astype(np.int64)
            for j in range(_HASHES):
                yield pa.RecordBatch.from_arrays([pa.array(_place(key, j, bits))], ["p"])

    return run


def _filter(keys: DataFrame, n: int, limit: int) -> np.ndarray:
    """A bit filter of ``keys``, 32 bits a key but at most ``limit`` in all."""
    bits = 1 << min(limit.bit_length() - 1, max(15, (32 * n - 1).bit_length()))
    p = keys.select("key").mapInArrow(_set_bits(bits), "p long")
    parts = p.groupBy(F.floor(F.col("p") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("b"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["b"], np.uint8)
    return out.ravel()


def _met(key: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for j in range(_HASHES):
        p = _place(key, j, len(bits) * 8)
        hit = (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        key, at = key[hit], at[hit]
    return key, at


def _neighboured(symbols: int, shared):
    def run(batches):
        reduced, bits = Reduced(symbols), shared.value
        for b in batches:
            words = b.column(1).to_pylist()
            for at in _by_length(words):
                for number, key in reduced.neighbours([words[i] for i in at]):
                    key, number = _met(key, at[number], bits)
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(key), *[c.take(pa.array(number)) for c in b.columns]], ["key", *b.schema.names])

    return run


def _one_edit(a: str, b: str) -> bool:
    """Exactly one edit, in time linear in the words."""
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)  # a[:low] == b[:low], and a[:high + 1] differs
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    if len(a) == len(b):
        return low < len(a) and a[low + 1 :] == b[low + 1 :]
    return len(b) == len(a) + 1 and a[low:] == b[low + 1 :]


def _verified(batches):
    for b in batches:
        pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
        yield b.filter(pa.array([_one_edit(x, y) for x, y in pairs], pa.bool_())).drop_columns(["word_a"])


def near_words(vocab: DataFrame, symbols: int = SYMBOLS, inline: int = INLINE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(a, b, word, n): each ordered pair of ids of words one edit apart, with the word
    and the count of b. ``vocab`` is a saved table (id, word, n) of distinct words."""
    if symbols < 2:
        raise ValueError("at least 2 symbols")
    if inline < 1 or filter_bits < 1 << 15:
        raise ValueError("inline must be at least 1, filter_bits at least 32768")
    keys = save(vocab.mapInArrow(_keyed(symbols), "id long, word string, n long, key long"), "reduced-words")
    shared = vocab.sparkSession.sparkContext.broadcast(_filter(keys, keys.count(), filter_bits))
    make = _neighboured(symbols, shared)
    size = F.length("word")
    one = F.levenshtein("word_a", "word", 1) == 1
    # a word of up to inline letters has no near word of more than inline + 1
    short = keys.where(size <= inline).select("id", "word").mapInArrow(make, "key long, id long, word string")
    short = short.withColumnsRenamed({"id": "a", "word": "word_a"}).join(
        keys.where(size <= inline + 1).withColumnRenamed("id", "b"), "key").where(one).select("a", "b", "word", "n")
    # longer ones: numbers only, and both words for what meets
    long = keys.where(size > inline).select("id", "word").mapInArrow(
        lambda batches: (x.drop_columns(["word"]) for x in make(batches)), "key long, id long")
    long = long.withColumnRenamed("id", "a").join(keys.where(size >= inline).select("key", F.col("id").alias("b")), "key")
    long = long.where("a <> b").join(vocab.select(F.col("id").alias("a"), F.col("word").alias("word_a")), "a")
    long = long.join(vocab.withColumnRenamed("id", "b"), "b").select("a", "b", "word_a", "word", "n")
    return short.unionByName(long.mapInArrow(_verified, "a long, b long, word string, n long"))


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(id, root_id) of the words with a form, following forms to the last. Counts grow
    by ``ratio`` each step, so their logarithm bounds the steps; each round doubles."""
    depth, n = 1, most
    while n >= ratio:
        depth, n = depth + 1, n // ratio
    at = forms.select("id", F.col("form_id").alias("root_id"))
    reach = 1
    while reach < depth:
        on = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        at = save(at.join(on, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id")), "roots")
        reach *= 2
    return at


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, symbols: int = SYMBOLS, inline: int = INLINE,
                   filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per word: word, n, n_near (words one edit apart), form (the near word of
    largest n, the first in code-point order of several, if its n is at least ``ratio``
    times the word's), form_n, root (the last of the chain of forms, or the word).

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; every
    RULE-th run, drawn by crc32, has lost a letter. Null and empty texts have none; a
    null id counts as an empty one; rows that repeat count each; other columns are not
    read; an empty table gives an empty result."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    vocab = vocabulary(docs, id_col, text_col, min_length, min_count)
    near = near_words(vocab, symbols, inline, filter_bits).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word", "b")).alias("top"))
    own = vocab.join(near.withColumnRenamed("a", "id"), "id", "left")
    is_form = -F.col("top.less") >= F.col("n") * ratio
    words = save(own.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top.word")).alias("form"),
        F.when(is_form, -F.col("top.less")).alias("form_n"), F.when(is_form, F.col("top.b")).alias("form_id")), "variants")
    most = vocab.agg(F.max("n")).first()[0] or 0
    roots = _roots(words.where("form_id is not null"), most, ratio)
    roots = roots.join(vocab.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return words.join(roots, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
