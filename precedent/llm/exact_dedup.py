"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z only; a null
text counts as empty. Each row gets the SHA-256 of its normalised text. Every
task keeps a cuckoo filter over the digests it has met (insertion and deletion
of single digests, 16-bit fingerprints, buckets of four) and the full digests
in buckets beside it: a miss in the filter proves a digest new without a look
at the content; a hit is verified against the digests of its bucket. When an
insertion overflows, the filter is built anew at twice the size from the stored
keys.

Copies are folded twice: inside each input partition, before anything is
shuffled, and then by digest. So a text that makes up a third of all rows sends
one row per input partition. Groups are joined back with ``join_groups``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import join_groups, save
from precedent.llm.tokens import texts

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter plus the stored keys it stands for (bytes of 16 or more).

    ``get``, ``add`` and ``delete`` are exact: the filter only answers which
    keys need no look at the stored ones."""

    def __init__(self, buckets: int = 64) -> None:
        self._make(buckets)
        self.n = 0
        self.resizes = 0

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = [0] * (buckets * SLOTS)
        self.store: list[dict] = [{} for _ in range(buckets)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") & self.mask
        return fp, one, one ^ ((fp * 0x5BD1E995) & self.mask)

    def may_hold(self, key: bytes) -> bool:
        fp, one, two = self._places(key)
        s = self.slots
        return fp in s[one * SLOTS : one * SLOTS + SLOTS] or fp in s[two * SLOTS : two * SLOTS + SLOTS]

    def get(self, key: bytes):
        """The value of a live key, or None."""
        if not self.may_hold(key):
            return None
        return self.store[int.from_bytes(key[:8], "little") & self.mask].get(key)

    def add(self, key: bytes, value) -> None:
        """Insert a key that is not live."""
        self.store[int.from_bytes(key[:8], "little") & self.mask][key] = value
        self.n += 1
        if not self._place(key):
            self._resize()

    def _place(self, key: bytes) -> bool:
        fp, one, two = self._places(key)
        s = self.slots
        for b in (one, two):
            for k in range(b * SLOTS, b * SLOTS + SLOTS):
                if not s[k]:
                    s[k] = fp
                    return True
        b = two
        for kick in range(MAX_KICKS):
            k = b * SLOTS + (fp + kick) % SLOTS
            fp, s[k] = s[k], fp
            b ^= (fp * 0x5BD1E995) & self.mask
            for k in range(b * SLOTS, b * SLOTS + SLOTS):
                if not s[k]:
                    s[k] = fp
                    return True
        return False

    def _resize(self) -> None:
        """Twice the buckets (more if need be), from the stored keys."""
        live = list(self.items())
        size = (self.mask + 1) * 2
        while True:
            self.resizes += 1
            self._make(size)
            for key, value in live:
                self.store[int.from_bytes(key[:8], "little") & self.mask][key] = value
            if all(self._place(key) for key, _ in live):
                return
            size *= 2

    def delete(self, key: bytes) -> bool:
        """Remove a live key; False when there is none."""
        if self.get(key) is None:
            return False
        del self.store[int.from_bytes(key[:8], "little") & self.mask][key]
        fp, one, two = self._places(key)
        for b in (one, two):
            for k in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.slots[k] == fp:
                    self.slots[k] = 0
                    self.n -= 1
                    return True
        raise AssertionError("a live key has its fingerprint in one of its buckets")

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.store:
            yield from bucket.items()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text after lower-casing A-Z; null as '')."""

    def run(batches):
        for b in batches:
            out = []
            for t in texts(b.column(1)):
                raw, off = t.buf.tobytes(), t.off.tolist()
                out += [hashlib.sha256(raw[i:j].lower()).digest() for i, j in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, digest binary")


def _folded(batches):
    """Copies of a partition through a cuckoo index: digest, the largest id,
    the number of rows. Value of a key: [largest id or None, rows]."""
    index = CuckooIndex()
    for b in batches:
        for key, i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            met = index.get(key)
            if met is None:
                index.add(key, [i, n])
                continue
            met[1] += n
            if i is not None and (met[0] is None or i > met[0]):
                met[0] = i
    keys, values = [], []
    for key, value in index.items():
        keys.append(key)
        values.append(value)
        if len(keys) == 20_000:
            yield _groups(keys, values)
            keys, values = [], []
    yield _groups(keys, values)


def _groups(keys, values):
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array([v[0] for v in values], pa.int64()),
         pa.array([v[1] for v in values], pa.int64())], ["digest", "keep_id", "group_size"])


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest of ``rows`` (doc_id, digest): digest, keep_id (largest
    id; null only if all are null), group_size."""
    schema = "digest binary, keep_id long, group_size long"
    own = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return own.mapInArrow(_folded, schema).repartition("digest").mapInArrow(_folded, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; ids order null lowest, so
    a null id stays only in a group of null ids. Null and empty texts are one
    group. Rows repeated with one id are one document: all of them carry its
    mark, and each counts in group_size. An empty table gives an empty result.
    Other columns are not read."""
    rows = save(digests(docs, id_col, text_col), "digests")
    found = save(groups(rows), "digest-groups")
    return join_groups(rows, found, "digest", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def apply_changes(live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """New live rows (doc_id, digest) of an index after changes.

    All three tables have doc_id and digest. First the deletions, then the
    insertions; deleting a row that is not live and inserting one that is have
    no effect. Rows are dealt by digest and id together, so that one text with
    many copies is spread evenly."""

    def run(batches):
        index = CuckooIndex()
        for b in batches:
            for key, i, digest, op in zip(*(b.column(k).to_pylist() for k in ("key", "doc_id", "digest", "op"))):
                if op == 1:
                    index.delete(key)
                elif index.get(key) is None:
                    index.add(key, (i, digest))
        rows = [v for _, v in index.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            ["doc_id", "digest"])

    def tagged(df, op):
        key = F.unhex(F.sha2(F.concat_ws("|", F.hex("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256))
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", F.lit(op).alias("op"), key.alias("key"))

    every = tagged(live, 0).unionByName(tagged(deleted, 1)).unionByName(tagged(inserted, 2))
    return every.repartition("key").sortWithinPartitions("op").mapInArrow(run, "doc_id long, digest binary")
