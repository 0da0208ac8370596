"""Katz backoff language model over whole tables.

Tokens of a text: its words after lower-casing A-Z, then one end. The model has
``order`` levels: n-grams of one token up to ``order``. Counts up to CUT are
discounted by Good-Turing (Katz' form, from the counts of that level); the mass
set free in a history is given to the tokens not seen after it, in proportion to
their probability one level below (which backs off in turn), by a weight that
makes the distribution of every history sum to one exactly. The unigram mass set
free goes to the one unknown token. Where nothing would be set free (no count of
a history is discounted), its denominator is one larger. The history of a first
token is the start of a text, at every level.

How it runs: texts become blocks of tokens (word hashes, a dictionary and ids per
block). Level by level a block sends, for each part of the n-grams, its distinct
ones with their training counts, as packed arrays; the task that holds a part adds
them up, tells how many n-grams occur how often, and answers each block in the order
it asked. An answer holds the counts, the numbers that the next level's histories
are made of, one byte per history (which counts occur in it, so its denominator),
and only for histories with a token not seen in training the sums that its weight
needs. What a seen n-gram takes from the level below is a count that the block has
already, sent once per word where it is that of a word. So a token is never shuffled
by itself, a frequent n-gram crosses the network once per block, and the tables may
grow with the corpus without ever being broadcast. A history that holds more than
1/parts of all training tokens (fewer than ``parts`` of them can) is dealt by its
next word, and only its sums are gathered. Tasks are as many as parts or blocks, so
none grows with the input. The shuffles behind a level's answers are removed when
these are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import fold, save
from precedent.llm.tokens import Hasher, id_array, texts, words

CUT = 5
ORDER = 3
BLOCK_BYTES = 8 << 20
PART_TOKENS = 1 << 20
_U = np.uint64
END = _U(0x5EED0E0D5EED0E0D)
# N-grams are numbered (place in the part << bits of a part | part) + FIRST; these two are none of them.
UNKNOWN, START, FIRST = _U(0), _U(1), _U(2)


def pack(x: np.ndarray) -> bytes:
    """An array as bytes: byte planes (all first bytes, all second ...), zstd.
    Integers that are not negative take the bytes of the largest."""
    x = np.ascontiguousarray(x).reshape(-1)
    if x.dtype.kind in "iu" and len(x) and x.min() >= 0:
        x = x.astype(np.min_scalar_type(x.max()))
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return bytes([x.itemsize]) + len(raw).to_bytes(7, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(x: bytes, dtype) -> np.ndarray:
    n, dtype = int.from_bytes(x[1:8], "little"), np.dtype(dtype)
    raw = np.frombuffer(pa.decompress(x[8:], n, codec="zstd", asbytes=True), np.uint8)
    raw = np.ascontiguousarray(raw.reshape(x[0], -1).T).reshape(-1)
    return raw.view(dtype) if x[0] == dtype.itemsize else raw.view(f"u{x[0]}").astype(dtype)


def pack_ascending(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_ascending(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x, _U), dtype=_U)


def discounts(count_of: dict[int, int], cut: int = CUT) -> np.ndarray:
    """d[r] for r = 0..cut by Good-Turing, from the numbers of types that occur
    1..cut + 1 times. 1 (no discount) wherever the formula gives nothing
    between 0 and 1."""
    d = np.ones(cut + 1)
    n1, rest = count_of.get(1, 0), (cut + 1) * count_of.get(cut + 1, 0)
    for r in range(1, cut + 1):
        nr, up = count_of.get(r, 0), count_of.get(r + 1, 0)
        if nr and n1 and n1 != rest:
            x = ((r + 1) * up / nr / r - rest / n1) / (1 - rest / n1)
            if 0 < x <= 1:
                d[r] = x
    return d


class Unigrams:
    """Discounted unigram probabilities: n training tokens, and the number of
    types by count up to cut + 1."""

    def __init__(self, n: int, count_of: dict[int, int]) -> None:
        self.d = discounts(count_of)
        freed = sum((1 - self.d[r]) * r * count_of.get(r, 0) for r in range(1, CUT + 1))
        self.z = n if freed > 1e-9 * n else n + 1
        self.unknown = (freed if self.z == n and n else 1) / max(self.z, 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        p = c * np.where(c <= CUT, self.d[np.minimum(c, CUT)], 1.0) / max(self.z, 1)
        return np.where(c > 0, p, self.unknown)


def _block_of(ids, nulls, held, hashes, sizes, number):
    """One row: the tokens of some documents, ends included."""
    tokens = np.concatenate(hashes)
    terms, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # frequent terms first: small ids, which pack well
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    return [number, len(tokens), pack(np.concatenate(ids)), pack(np.concatenate(nulls)), pack(np.concatenate(held)),
            pack(np.concatenate(sizes)), pack(order), pack(rank[at]), pack_ascending(terms)]


# The tokens are places in ``ranked``, which has places in ``terms`` (ascending hashes, needed for the first level only).
BLOCK = "block long, n long, ids binary, nulls binary, held binary, sizes binary, ranked binary, tokens binary, terms binary"
AFTER = BLOCK.rpartition(", ")[0]


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, held, text -> token blocks of about ``block_bytes`` of text
    (at least one whole text)."""

    def run(batches):
        hasher, made, size, got = Hasher(), 0, 0, [[], [], [], [], []]

        def flush():
            row = _block_of(*got, (TaskContext.get().partitionId() << 32) | made)
            types = [pa.int64()] * 2 + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                              [c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            ids, nulls = id_array(b.column(0))
            held = np.asarray(b.column(1)).astype(bool)
            for t in texts(b.column(2)):
                low = t.lower()
                w = words(low)
                n = np.diff(w.bound) + 1
                out = np.empty(int(n.sum()), _U)
                ends = np.cumsum(n) - 1
                mask = np.ones(len(out), bool)
                mask[ends] = False
                out[ends], out[mask] = END, hasher.spans(low.buf, w.start, w.end)
                rows = slice(t.first, t.first + t.n)
                for have, x in zip(got, (ids[rows], nulls[rows], held[rows], out, n)):
                    have.append(x)
                size += len(t.buf)
                if size >= block_bytes:
                    yield flush()
                    made, size, got = made + 1, 0, [[], [], [], [], []]
        if got[0]:
            yield flush()

    return docs.mapInArrow(run, BLOCK)


def _rows(batches):
    """Rows of Arrow batches as tuples, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def _emit(schema, rows, limit=16 << 20):
    """Arrow batches of about ``limit`` bytes from row lists."""
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    have, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in have], kinds[t]) for i, t in enumerate(types)], list(names))

    for r in rows:
        have.append(r)
        size += 64 + sum(len(v) for v in r if isinstance(v, bytes))
        if size >= limit:
            yield batch()
            have, size = [], 0
    if have:
        yield batch()


def _grouped(rows, k):
    """Rows that come sorted by field k, in lists."""
    last, have = None, []
    for r in rows:
        if have and r[k] != last:
            yield have
            have = []
        last = r[k]
        have.append(r)
    if have:
        yield have


def _train_mask(held, sizes):
    return np.repeat(~held, sizes)


def _cuts(part: np.ndarray):
    """Slices of an ascending array of part numbers: (part, from, to)."""
    edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return [(int(part[i]), i, j) for i, j in zip(edge, edge[1:]) if j > i]


ASK = "part long, block long, h binary, w binary, n binary, c binary, hot binary"
REPLY = "kind int, level int, block long, part long, x binary, y binary, z binary, u binary"


def _ask_words(bits):
    def run(batches):
        def rows():
            for block, _, _, _, held, sizes, ranked, tokens, terms in _rows(batches):
                terms, ranked = unpack_ascending(terms), unpack(ranked, np.int64)
                train = _train_mask(unpack(held, bool), unpack(sizes, np.int64))
                n = np.empty(len(terms), np.int64)
                n[ranked] = np.bincount(unpack(tokens, np.uint32)[train], minlength=len(terms))
                for part, i, j in _cuts((terms >> _U(64 - bits)).astype(np.int64)):
                    yield part, block, None, pack_ascending(terms[i:j]), pack(n[i:j].astype(np.uint32)), None, None

        yield from _emit(ASK, rows())

    return run


def _histogram(n: np.ndarray) -> bytes:
    """Of counts: their sum, how many are not 0, how many are r for r up to CUT + 1."""
    return pack(np.array([n.sum(), (n > 0).sum(), *((n == r).sum() for r in range(1, CUT + 2))], np.int64))


def _count_words(batches):
    """kind 0: the histogram y of the counts of a part; kind 1: answers (x:
    counts, y: places in the part, by falling count)."""

    def rows():
        for asked in _grouped(_rows(batches), 0):
            keys, counts = [unpack_ascending(r[3]) for r in asked], [unpack(r[4], np.uint32) for r in asked]
            terms, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(terms)).astype(np.int64)
            place = np.empty(len(n), np.uint32)
            place[np.argsort(-n, kind="stable")] = np.arange(len(n))
            yield 0, 1, -1, asked[0][0], None, _histogram(n), None, None
            first = 0
            for r, k in zip(asked, keys):
                mine = at[first : first + len(k)]
                first += len(k)
                yield 1, 1, r[1], r[0], pack(n[mine]), pack(np.where(n[mine] > 0, place[mine], 0)), None, None

    yield from _emit(REPLY, rows())


def _histograms(batches):
    for r in _rows(batches):
        n = unpack(r[0], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([0, -1, *range(1, CUT + 2)]), pa.array(n)], ["r", "n"])


def _sums(answers: DataFrame) -> dict[int, int]:
    """Over all parts: r -> types that occur r times (r up to CUT + 1), 0 -> all
    tokens, -1 -> all types."""
    got = answers.where("kind = 0").select("y").mapInArrow(_histograms, "r long, n long").groupBy("r").agg(F.sum("n").alias("n"))
    return {r["r"]: r["n"] for r in got.collect()}


def _bits(parts: int) -> int:
    """Words are dealt to 1 << bits parts by the first bits of their hashes."""
    return max(4, (parts - 1).bit_length())


class Plan:
    """What every task knows: sizes, the discounts of the levels counted so far,
    and the sums of hot histories by level (fewer than ``parts`` each)."""

    def __init__(self, parts: int, sums: dict[int, int], train_docs: int) -> None:
        self.parts, self.bits, self.train_docs = parts, _bits(parts), train_docs
        self.n, self.v = sums.get(0, 0), sums.get(-1, 0)
        self.p1 = Unigrams(self.n, sums)
        self.d, self.hot = {1: self.p1.d}, {}

    def kept(self, c: np.ndarray, level: int) -> np.ndarray:
        """Discounted counts."""
        return c * np.where(c <= CUT, self.d[level][np.minimum(c, CUT)], 1.0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _ascending(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (uint64) in ascending order, and the rows they come from."""
    n = len(key)
    bits = _U(n.bit_length())
    if n and int(key.max()).bit_length() + int(bits) <= 64:  # both in one number, which sorts faster
        both = key << bits
        both |= np.arange(n, dtype=_U)
        both.sort()
        ascending = both >> bits
        both &= (_U(1) << bits) - _U(1)
        return ascending, both.view(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], order


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the number of each row's."""
    ascending, order = _ascending(key)
    starts = _starts(ascending)
    number = np.empty(len(key), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(key)))
    return ascending[starts], number


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Where each value of an ascending array begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ascending)), bool), ascending[1:] != ascending[:-1]]))


def backoff(stats: np.ndarray, below: np.ndarray, ch: np.ndarray, d: np.ndarray):
    """Denominator and backoff weight of histories with training count ch: row
    r - 1 of ``stats`` holds how many next words occur r times, up to CUT;
    ``below`` is the probability of all next words one level below."""
    r = np.arange(1, CUT + 1)
    freed = (stats * (r * (1 - d[r]))[:, None]).sum(axis=0)
    z = _denominator((stats > 0).T @ (1 << (r - 1)), ch, d)
    return z, (freed + z - ch) / z / (1 - below)


def _denominator(occurs: np.ndarray, ch: np.ndarray, d: np.ndarray) -> np.ndarray:
    """ch, or one more where no count that occurs (bit r - 1: r) is discounted."""
    cut = sum(1 << (r - 1) for r in range(1, CUT + 1) if d[r] < 1)
    return ch + ((occurs & cut) == 0)


def _number(place: np.ndarray, part: int, bits: int) -> np.ndarray:
    return (place.astype(_U) << _U(bits) | _U(part)) + FIRST


def _climb(block, replies, plan, level=None):
    """Goes up the levels with the answers to a block. Up to ``level``: the rows
    to ask for there. Without one: log10 probabilities and training counts of its
    tokens."""
    held, sizes, ranked, tokens = (unpack(x, t) for x, t in zip(block[4:8], (bool, np.int64, np.int64, np.uint32)))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mine = [r for r in replies if r[1] == 1]
    c = np.concatenate([unpack(r[4], np.int64) for r in mine])
    numbers = np.concatenate([_number(unpack(r[5], np.uint32), r[3], plan.bits) for r in mine])
    words, word = _numbered(np.where(c > 0, numbers, UNKNOWN))  # unknown words are one
    tokens = word[ranked][tokens]
    of_word = np.zeros(len(words), np.int64)
    of_word[word] = c
    bits = _U(len(words).bit_length())
    p = None if level else plan.p1(of_word)[tokens]
    # the n-gram that ends at each token, and of the block's n-grams: number, count, denominator
    at, number, count, z = tokens, words, of_word, np.full(len(words), plan.p1.z, np.int64)
    for k in range(2, (level or max(plan.d)) + 1):
        before = np.empty_like(at)
        before[1:], before[first] = at[:-1], len(number)
        from_number, of_rank = _ascending(np.append(number, START))
        from_count = np.append(count, plan.train_docs)[of_rank]
        rank = np.empty(len(from_number), _U)
        rank[of_rank] = np.arange(len(from_number), dtype=_U)
        before = rank[before]
        live = np.flatnonzero(before >= np.searchsorted(from_number, START))  # an unknown history has no n-grams
        ascending, order = _ascending(before[live] << bits | tokens[live].astype(_U))
        starts = _starts(ascending)
        order, some = live[order], ascending[starts]
        del before, live, ascending, rank, of_rank  # a block should leave room for the others of its machine
        own_rank, own_word = (some >> bits).view(np.int64), (some & ((_U(1) << bits) - _U(1))).view(np.int64)
        h, ch, w = from_number[own_rank], from_count[own_rank], words[own_word]
        del own_rank, from_number, from_count
        below = at[order[starts]]  # the n-gram without its first token
        hot = ch * plan.parts > plan.n
        part = (_mixed(np.where(hot, w, h)) % _U(plan.parts)).astype(np.uint16 if plan.parts < 1 << 16 else np.int64)
        by_part = np.argsort(part, kind="stable")
        cuts = list(_cuts(part[by_part]))
        del part
        if k == level:
            train = _train_mask(held, sizes)[order]
            n = np.add.reduceat(train, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
            counts = of_word if k == 2 else count[below]
            return [_question(q, block[0], by_part[i:j], h, w, n, own_word if k == 2 else None, counts, hot) for q, i, j in cuts]
        del w, own_word, hot, number, count
        n, own_number = np.zeros(len(some), np.int64), np.full(len(some), UNKNOWN)
        zs, weight, z = np.ones(len(some), np.int64), np.ones(len(some)), z[below]
        for (q, i, j), r in zip(cuts, (r for r in replies if r[1] == k), strict=True):
            own = by_part[i:j]
            n[own], own_number[own] = _answer(r, plan)
            if not level:
                zs[own], weight[own] = _weights(r, h[own], ch[own], n[own], z[own], plan, k)
        del h, ch, below, by_part
        of_token = np.repeat(np.arange(len(some)), np.diff(starts, append=len(order)))
        if not level:
            seen = n > 0
            factor, seen = np.where(seen, plan.kept(n, k) / zs, weight)[of_token], seen[of_token]
            p[order] = np.where(seen, factor, factor * p[order])
        at = np.full(len(tokens), len(some), np.int64)
        at[order] = of_token
        number, count, z = np.append(own_number, UNKNOWN), np.append(n, 0), np.append(zs, 1)
    return None if level else (np.log10(p), of_word[tokens], first, held, sizes)


def _question(part, block, own, h, w, n, word, counts, hot):
    """A row of ASK: n-grams by history and word, ascending, with their training
    counts; c: counts of what is left of those in training one level below, once
    per word where that is the word alone; hot: one per history."""
    h, n = h[own], n[own]
    left = own[n > 0]
    c = counts[left] if word is None else counts[np.unique(word[left])]
    return int(part), block, pack_ascending(h), pack(w[own]), pack(n), pack(c), pack(hot[own][_starts(h)])


def _answer(reply, plan):
    """Counts and numbers of the n-grams of a question."""
    n = unpack(reply[4], np.int64)
    number = np.full(len(n), UNKNOWN)
    if reply[7] is not None:
        number[n > 0] = _number(unpack_ascending(reply[7]), reply[3], plan.bits)
    return n, number


def _weights(reply, h, ch, n, z_below, plan, level):
    """Denominators and weights of the n-grams of a question."""
    some = _starts(h)
    hs, ch, z_below, of = h[some], ch[some], z_below[some], np.repeat(np.arange(len(some)), np.diff(some, append=len(h)))
    occurs = unpack(reply[5], np.uint8).astype(np.int64)
    needy = np.bincount(of[n == 0], minlength=len(hs)) > 0
    sums = unpack(reply[6], np.float64).reshape(CUT + 1, -1)
    weight, d = np.ones(len(hs)), plan.d[level]
    weight[needy] = backoff(sums[:CUT], sums[CUT] / z_below[needy], ch[needy], d)[1]
    z = _denominator(occurs, ch, d)
    if level in plan.hot:  # the sums over all parts
        of_hot, hot_sums = plan.hot[level]
        there = np.isin(hs, of_hot)
        at = np.searchsorted(of_hot, hs[there])
        z[there], weight[there] = backoff(hot_sums[:CUT, at], hot_sums[CUT, at] / z_below[there], ch[there], d)
    return z[of], weight[of]


def _blocks_with_answers(batches):
    """Rows sorted by (block, kind, level, part): the block row, then its answers."""
    for rows in _grouped(_rows(batches), 2):
        yield rows[0][8:], rows[1:]


def _ask_grams(plan, level):
    def run(batches):
        yield from _emit(ASK, (q for block, replies in _blocks_with_answers(batches) for q in _climb(block, replies, plan, level)))

    return run


def _count_grams(plan, level, last):
    """kind 0: the histogram y of the counts of a part; kind 1: answers (x:
    counts, y: a byte per history, z: sums of histories with a token not seen, u:
    places of those seen unless this level is the last); kind 2: sums z of the hot
    histories x in this part. Sums: how many next words occur r times, and what
    the training counts of all next words keep one level below."""

    def run(batches):
        def rows():
            for asked in _grouped(_rows(batches), 0):
                part, own = asked[0][0], [unpack_ascending(r[2]) for r in asked]
                words, ns = ([unpack(r[i], t) for r in asked] for i, t in ((3, _U), (4, np.int64)))
                history, h = _numbered(np.concatenate(own))
                word, w = _numbered(np.concatenate(words))
                bits = _U(len(word).bit_length())
                some, at = _numbered(h.astype(_U) << bits | w.astype(_U))
                n = np.bincount(at, np.concatenate(ns), len(some)).astype(np.int64)
                of = (some >> bits).view(np.int64)  # ascending
                c, hot, places, first = np.zeros(len(some), np.int64), np.zeros(len(history), bool), [], 0
                for r, x, y, m in zip(asked, own, words, ns):
                    places.append(h[first + _starts(x)])
                    hot[places[-1]] = unpack(r[6], bool)
                    sent, left = unpack(r[5], np.int64), m > 0
                    c[at[first : first + len(x)][left]] = sent[_numbered(y[left])[1]] if level == 2 else sent
                    first += len(x)
                seen = n > 0
                sums = np.zeros((CUT + 1, len(history)))
                for r in range(1, CUT + 1):
                    sums[r - 1] = np.bincount(of[n == r], minlength=len(history))
                sums[CUT] = np.bincount(of[seen], plan.kept(c, level - 1)[seen], len(history))
                occurs = ((sums[:CUT] > 0).T @ (1 << np.arange(CUT))).astype(np.uint8)
                place = np.cumsum(seen) - seen
                yield 0, level, -1, part, None, _histogram(n), None, None
                if hot.any():
                    yield 2, level, -1, part, pack_ascending(history[hot]), None, pack(sums[:, hot]), None
                first = 0
                for r, x, there in zip(asked, own, places):
                    mine = at[first : first + len(x)]
                    first += len(x)
                    m = n[mine]
                    needy = np.zeros(len(history), bool)
                    needy[of[mine[m == 0]]] = True
                    yield (1, level, r[1], part, pack(m), pack(occurs[there]), pack(sums[:, there[needy[there]]]),
                           None if last else pack_ascending(place[mine[m > 0]].astype(_U)))

        yield from _emit(REPLY, rows())

    return run


def _hot_sums(batches):
    for x, z in _rows(batches):
        h, s = unpack_ascending(x).astype(np.int64), unpack(z, np.float64).reshape(CUT + 1, -1)
        yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(row) for row in s)], ["h", *(f"m{r}" for r in range(CUT + 1))])


def _hot(table: DataFrame):
    """Sums of the hot histories over all parts: fewer rows than parts."""
    names = [f"m{r}" for r in range(CUT + 1)]
    got = (table.where("kind = 2").select("x", "z").mapInArrow(_hot_sums, "h long, " + ", ".join(f"{m} double" for m in names))
           .groupBy("h").agg(*[F.sum(m).alias(m) for m in names]).orderBy("h").collect())
    if got:
        return np.array([r["h"] for r in got], np.int64).astype(_U), np.array([[r[m] for r in got] for m in names])
    return None


def _score(plan):
    def of_block(block, replies):
        p, c, first, held, sizes = _climb(block, replies, plan)
        add = lambda x: np.add.reduceat(x, first)
        ids = pa.array(unpack(block[2], np.int64), mask=unpack(block[3], bool))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(held), pa.array(sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(sizes), plan.n)),
             pa.array(add(np.log10((c + 1) / (plan.n + plan.v + 1)))), pa.array(add(p))],
            [x.split()[0] for x in RESULT.split(", ")])

    def run(batches):
        for block, replies in _blocks_with_answers(batches):
            yield of_block(block, replies)

    return run


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _together(blocks_of, replies, tasks):
    """Block rows (without hashes) and the answers to each, sorted by (block, kind,
    level, part)."""
    extra = [c.split() for c in AFTER.split(", ")]
    names = [c.split()[0] for c in REPLY.split(", ")]
    own = blocks_of.select(F.lit(0).alias("kind"), F.lit(0).alias("level"), "block", F.lit(0).cast("long").alias("part"),
                           *[F.lit(None).cast("binary").alias(c) for c in names[4:]], *[F.col(c).alias(f"b_{c}") for c, _ in extra])
    rest = replies.select(*names, *[F.lit(None).cast(t).alias(f"b_{c}") for c, t in extra])
    return own.unionByName(rest).repartition(tasks, "block").sortWithinPartitions("block", "kind", "level", "part")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _save(df: DataFrame, name: str) -> DataFrame:
    """``save``; Spark removes the shuffle files behind the table once it is written,
    not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return save(df, name)
    finally:
        conf.set(CLEANUP, was)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
                part_tokens: int = PART_TOKENS, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams), score (log10 probability by the model).

    Rows whose crc32(id as text) mod ``folds`` is ``held`` are scored but not
    learnt from; a null id is learnt from. A null or empty text is its end
    token alone. Repeated rows count as often as they occur. With no training
    tokens every token is unknown and has probability one. Other columns are
    not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(id_col, folds, held).alias("held"),
                      F.col(text_col).cast("string").alias("text"))
    table = save(blocks(src, block_bytes), "token-blocks")
    tokens, made = table.agg(F.sum("n"), F.count("*")).first()
    if not tokens:
        return spark.createDataFrame([], RESULT)
    parts = max(16, -(-tokens // part_tokens))
    by_part = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")
    answers = _save(by_part(table.mapInArrow(_ask_words(_bits(parts)), ASK)).mapInArrow(_count_words, REPLY), "gram-1-counts")
    plan = Plan(parts, _sums(answers), docs.where(~fold(id_col, folds, held)).count())
    replies = answers.where("kind = 1")
    for level in range(2, order + 1):
        # a question needs counts and numbers of what is below, no sums
        below = replies.withColumns({"y": F.when(F.col("level") == 1, F.col("y")), "z": F.lit(None).cast("binary")})
        asked = _together(table, below, made).mapInArrow(_ask_grams(plan, level), ASK)
        answers = _save(by_part(asked).mapInArrow(_count_grams(plan, level, level == order), REPLY), f"gram-{level}-counts")
        plan.d[level], hot = discounts(_sums(answers)), _hot(answers)
        if hot:
            plan.hot[level] = hot
        replies = replies.unionByName(answers.where("kind = 1"))
    return _together(table, replies, made).mapInArrow(_score(plan), RESULT)
