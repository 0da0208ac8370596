"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Texts are lower-cased (A-Z), cut into words, and turned into sets of 64-bit
   shingle hashes. Documents with equal sets form a class, of which only the
   smallest id goes on; copies are never paired.
2. Each class gets BANDS x ROWS minima. The bands are hashed to bucket keys; of
   every minimum only the low BITS bits are kept, packed in bit planes.
3. Candidates come from buckets in two rounds. First every class is held
   against the hub of each of its buckets (a star, not all pairs), which folds
   the large groups. Then the classes of one bucket that are still in different
   components are compared inside a task, by bit counts of their packed
   signatures, in blocks of at most BLOCK classes; no pair leaves the task.
4. A pair whose collision-corrected estimate is more than five standard errors
   below the threshold is put aside; all others are confirmed or refused on the
   full sets: 100 * intersection >= 75 * union.
5. Connected components over confirmed links, joined back to all rows.

With 48 bands of 6 rows a pair at similarity 0.75 shares no band once in 12,000
pairs; from 0.8 up, once in a million.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import join_groups, save
from precedent.llm.components import components
from precedent.llm.tokens import Hasher, id_array, mix, texts, words

SHINGLE = 5
BANDS, ROWS, BITS = 48, 6, 2
PERCENT = 75
BLOCK = 1000
MEMBERS = 256  # pairs confirmed beside one copy of a text
_U = np.uint64


def _constants(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)) | _U(1)


def shingles(hashes: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their bounds. A text of
    fewer words has one shingle, the whole sequence; one of none has none."""
    n = np.diff(bound)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bound[:-1] - out[:-1], count) + np.arange(out[-1])
    by, size = _constants(k, 7), np.repeat(np.minimum(n, k), count)
    total = size.astype(_U) * _U(0xD6E8FEB86659FD93)
    padded = np.concatenate([hashes, np.zeros(k, _U)])
    for j in range(k):
        total += np.where(size > j, padded[first + j] * by[j], _U(0))
    return mix(total), out


def sets(hashes: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text, ascending."""
    out = []
    for i, j in zip(bound[:-1].tolist(), bound[1:].tolist()):
        x = np.sort(hashes[i:j])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if j > i else x)
    return out


def _sign(t, hasher, k):
    low = t.lower()
    w = words(low)
    sh, bound = shingles(hasher.spans(low.buf, w.start, w.end), w.bound, k)
    return sh, bound


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """doc_id, cls (digest of the shingle set; null without words), n_shingles,
    sig (packed low bits of the minima), bands (bucket keys)."""
    perms = BANDS * ROWS

    def run(batches):
        hasher, by, salt = Hasher(), _constants(perms, 11), _constants(perms, 13)
        within = _constants(ROWS, 17)
        for b in batches:
            for t in texts(b.column(1)):
                sh, bound = _sign(t, hasher, k)
                distinct = sets(sh, bound)
                full = np.flatnonzero(np.diff(bound) > 0)
                cls, sig, keys = [None] * t.n, [None] * t.n, [None] * t.n
                if len(full):
                    at = bound[:-1][full]
                    mins, work = np.empty((perms, len(full)), _U), np.empty_like(sh)
                    for p in range(perms):
                        np.multiply(sh, by[p], out=work)
                        np.minimum.reduceat(work, at, out=mins[p])
                    low = mix(mins ^ salt[:, None])
                    planes = [np.packbits(((low >> _U(i)) & _U(1)).astype(bool).T, axis=1) for i in range(BITS)]
                    packed = np.ascontiguousarray(np.concatenate(planes, axis=1))
                    band = np.arange(BANDS, dtype=_U)[:, None] * _U(0xC2B2AE3D27D4EB4F)
                    band = band + (mins.reshape(BANDS, ROWS, -1) * within[None, :, None]).sum(axis=1, dtype=_U)
                    band = np.ascontiguousarray(mix(band).T)
                    for r, d in enumerate(full.tolist()):
                        cls[d] = hashlib.blake2b(distinct[d].tobytes(), digest_size=16).digest()
                        sig[d], keys[d] = packed[r].tobytes(), band[r].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.first, t.n), pa.array(cls, pa.binary()),
                     pa.array([len(x) for x in distinct], pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(keys, pa.binary())], ["doc_id", "cls", "n_shingles", "sig", "bands"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, cls binary, n_shingles long, sig binary, bands binary")


def _bands(batches):
    for b in batches:
        node = np.asarray(b.column(0))
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node, BANDS))], ["key", "node"])


def similarity(agree: np.ndarray, perms: int, bits: int) -> np.ndarray:
    """Jaccard estimate from the share of minima whose low bits agree, corrected
    for the 2^-bits of unequal minima that agree by chance."""
    chance = 0.5**bits
    return (agree / perms - chance) / (1 - chance)


def lowest_estimate(percent: int, perms: int, bits: int, errors: float = 5.0) -> float:
    """The threshold less five standard errors of the estimate at it."""
    chance, j = 0.5**bits, percent / 100
    p = j + (1 - j) * chance
    return j - errors * (p * (1 - p) / perms) ** 0.5 / (1 - chance)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minima whose low bits agree; x, y: (..., BITS, bytes of a plane)."""
    unequal = np.bitwise_or.reduce(x ^ y, axis=-2)
    return BANDS * ROWS - np.bitwise_count(unequal).sum(axis=-1, dtype=np.int64)


def _planes(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), BITS, -1)


def _likely(n, m, agree, percent):
    near = similarity(agree, BANDS * ROWS, BITS) >= lowest_estimate(percent, BANDS * ROWS, BITS)
    return near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _estimated(percent):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = _planes(b.column(2).to_pylist()), _planes(b.column(4).to_pylist())
                ok = _likely(np.asarray(b.column(3)), np.asarray(b.column(5)), _agreeing(x, y), percent)
                b = b.filter(pa.array(ok))
            yield b.select([0, 1])

    return run


def _blocks(percent, k):
    """Rows come sorted by block (key, i, j): the links between classes of a block
    that are in different components. Block (i, j) with i < j holds rows of part
    i against rows of part j only. A pair is looked at only in the first band
    whose bucket it shares, if its estimate is likely, and as long as the links
    found here don't connect it; then on the full sets."""

    def likely(rows, key):
        node, comp, n, part, sig, bands = (np.concatenate([r[c] for r in rows]) for c in range(6))
        two = part.min() != part.max()
        left = np.flatnonzero(part == part.min()) if two else np.arange(len(node))
        right = np.flatnonzero(part != part.min()) if two else left
        for s in range(0, len(left), 128):
            i = left[s : s + 128]
            ok = _likely(n[i][:, None], n[right][None, :], _agreeing(sig[i][:, None], sig[right][None, :]), percent)
            ok &= comp[i][:, None] != comp[right][None, :]
            if not two:
                ok &= i[:, None] < right[None, :]
            p, q = np.nonzero(ok)
            p, q = i[p], right[q]
            same = bands[p] == bands[q]
            first = bands[p, same.argmax(axis=1)] == key
            yield from zip(p[first].tolist(), q[first].tolist())

    def links(rows, key, hasher):
        node, comp = (np.concatenate([r[c] for r in rows]).tolist() for c in (0, 1))
        whole = pa.concat_arrays([r[6] for r in rows])
        root, own, out = {}, {}, []

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def shingled(p):
            if p not in own:
                (t,) = texts(whole.slice(p, 1))
                own[p] = sets(*_sign(t, hasher, k))[0]
            return own[p]

        for p, q in likely(rows, key):
            x, y = find(comp[p]), find(comp[q])
            if x != y:
                both = len(np.intersect1d(shingled(p), shingled(q), assume_unique=True))
                if 100 * both >= percent * (len(own[p]) + len(own[q]) - both):
                    root[x] = y
                    out.append((node[p], node[q]))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    def run(batches):
        hasher, last, rows = Hasher(), None, []
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(3)])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            cols = [np.asarray(b.column(c)) for c in (3, 4, 5, 6)] + [_planes(b.column(7).to_pylist())]
            cols.append(np.frombuffer(b"".join(b.column(8).to_pylist()), np.int64).reshape(-1, BANDS))
            cols.append(b.column(9))
            for i, j in zip(cuts, cuts[1:]):
                block = tuple(ids[:, i].tolist())
                if block != last and rows:
                    yield links(rows, last[0], hasher)
                    rows = []
                last = block
                rows.append([c[i:j] for c in cols])
        if rows:
            yield links(rows, last[0], hasher)

    return run


def _confirmed(percent, k):
    """Rows come sorted by (hub, part, member): the hub's own text first, then
    texts to hold against it."""

    def run(batches):
        hasher, at, hub = Hasher(), None, None
        for b in batches:
            heads, parts, nodes = (b.column(i).to_pylist() for i in (0, 1, 3))
            a, z = [], []
            for t in texts(b.column(4)):
                sh, bound = _sign(t, hasher, k)
                for r, own in enumerate(sets(sh, bound), t.first):
                    if nodes[r] == heads[r]:
                        at, hub = (heads[r], parts[r]), own
                    elif at == (heads[r], parts[r]):
                        both = len(np.intersect1d(hub, own, assume_unique=True))
                        if 100 * both >= percent * (len(hub) + len(own) - both):
                            a.append(heads[r])
                            z.append(nodes[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, wanted: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``wanted``: node,
    text. Pairs are dealt by a and, for an a with many, by a part of the b."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("long")
    dealt = pairs.join(many, "a").select("a", part.alias("part"), "b")
    rows = dealt.select("a", "part", F.lit(1).alias("member"), F.col("b").alias("node")).unionByName(
        many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                    F.lit(0).alias("member"), F.col("a").alias("node")))
    return (rows.join(wanted, "node").select("a", "part", "member", "node", "text").repartition("a", "part")
            .sortWithinPartitions("a", "part", "member").mapInArrow(_confirmed(percent, k), "a long, b long"))


def _still_mixed(shared, linked):
    """(key, node, component) of the buckets that hold several components, and
    the number of their classes."""
    at = shared.select("key", "node").join(linked.select("node", "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    return at.join(mixed.where("lo <> hi").select("key", "n"), "key")


def _stars(mixed):
    """(a, b), a < b: each class with the hub of each of its buckets, if that is
    another. The hub is the class with most company over all its buckets: in a
    group of edits of one text that is the one closest to all others."""
    company = mixed.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = mixed.join(company, "node").groupBy("key").agg(F.max_by("node", "company").alias("hub"))
    pairs = mixed.join(hubs, "key").where("hub <> node")
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _within(mixed, reps, wanted, percent, k):
    """Links between classes of one bucket that are in different components."""
    parts = F.ceil(F.col("n") / BLOCK)
    rows = mixed.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("long")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("node", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                       "component", "part").join(reps, "node").join(wanted, "node")
    return (rows.select("key", "i", "j", "node", "component", "n_shingles", "part", "sig", "bands", "text")
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(percent, k), "a long, b long"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
               k: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id
    reachable over links, itself included), kept (doc_id = component_id).

    A null or empty text, or one without words, has n_shingles 0 and is linked
    with nothing. Rows repeated with one id are one document and share its
    mark. A row whose id is null takes the component of an equal set that has
    an id; else it is alone, with a null component_id, and stays. Other columns
    are not read. An empty table gives an empty result."""
    rows = save(signatures(docs, id_col, text_col, k), "signatures")
    classes = save(rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    reps = save(rows.join(classes.where("rep is not null").select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"])
                .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "sig", "bands"), "reps")
    sig = reps.select("node", "n_shingles", "sig")

    bands = reps.select("node", "bands").mapInArrow(_bands, "key long, node long")
    several = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = save(bands.join(several, "key"), "buckets")
    src = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    wanted = save(src.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "texts")
    ends = [sig.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
            for c in "ab"]
    likely = save(_stars(shared).join(ends[0], "a").join(ends[1], "b").select("a", "b", "sig_a", "n_a", "sig_b", "n_b")
                  .mapInArrow(_estimated(percent), "a long, b long"), "star-pairs")
    first = save(confirm(likely, wanted, percent, k), "star-links")
    mixed = save(_still_mixed(shared, components(first)), "mixed-buckets")
    found = components(first.unionByName(_within(mixed, reps, wanted, percent, k)))
    whole = save(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "cls", F.coalesce("component", "rep").alias("component_id"), "size"), "class-components")
    slim = rows.select("doc_id", "cls", "n_shingles")
    out = join_groups(slim.where("cls is not null"), whole, "cls", "size").select("doc_id", "n_shingles", "component_id")
    alone = slim.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
