"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in an order drawn by hash, are laid end to end and
cut into blocks of ``block_bytes``. Block i of a source of weight w may go out
from slot floor(i / w) and must by slot ceil((i + 1) / w); among the blocks that
may go out, the one with the earliest deadline takes the slot. While no source
has run out, every source is then less than one block from its target share
after any number of slots.

Weights are exact fractions of their sum, never rounded to a period, so this
holds for the given weights however long the mixture gets. One task works out the
schedule, block after block; it holds one block of each source at a time and
writes the rest to a table, which is joined to the rows by source and block. A
block takes it microseconds, and 30 GB have half a million of them. Places inside
a source come from sums over hash buckets and a window inside each bucket, so a
source of any size is spread over many tasks. Every row gets a slot; where a
source has run out, its slots stay empty or take a block that may go out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precedent.llm.common import row_keys, save

BLOCK_BYTES = 64 << 10
BUCKET_ROWS = 20_000
PLAN_ROWS = 1 << 16


def whole(weights: Sequence[object]) -> list[int]:
    """Integers in exactly the proportions of ``weights``."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact))
    out = [int(w * unit) for w in exact]
    divisor = math.gcd(*out)
    return [w // divisor for w in out]


def shares(weights: Mapping[object, float], period: int) -> dict[object, int]:
    """Whole shares of the period by largest remainder; at least 1 each."""
    names = sorted(weights, key=lambda s: (s is not None, str(s)))
    _check(weights)
    if period < len(names):
        raise ValueError("the period needs a slot for each source")
    exact = whole([weights[s] for s in names])
    ideal = {s: Fraction(period * w, sum(exact)) for s, w in zip(names, exact)}
    out = {s: max(1, int(ideal[s])) for s in names}
    while (left := period - sum(out.values())) > 0:
        for s in sorted(names, key=lambda s: out[s] - ideal[s])[:left]:
            out[s] += 1
    while sum(out.values()) > period:
        out[max((s for s in names if out[s] > 1), key=lambda s: out[s] - ideal[s])] -= 1
    return out


def _check(weights: Mapping[object, float]) -> None:
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be above zero")


def windows(weight: Sequence[int], blocks: Sequence[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of ``blocks[k]`` blocks of each
    source k, by slot: the earliest deadline first."""
    total = sum(weight)
    waiting = [(0, k, 0) for k in range(len(weight)) if blocks[k]]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weight[k]), k, i))
        due, k, i = heapq.heappop(ready)
        assert due > slot
        yield k, i, slot, i * total // weight[k], due
        if i + 1 < blocks[k]:
            heapq.heappush(waiting, ((i + 1) * total // weight[k], k, i + 1))
        slot += 1


def schedule(share: Mapping[object, int]) -> list[tuple[object, int, int]]:
    """(source, block, slot) of one period of whole shares."""
    names = list(share)
    return [(names[k], i, slot) for k, i, slot, _, _ in windows(list(share.values()), list(share.values()))]


def _plan(block_bytes: int, power: float):
    """Rows (source, bytes, weight) -> the slot and window of every block."""

    def run(batches):
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        given = rows.to_pylist()
        order = sorted(range(len(given)), key=lambda j: (given[j]["source"] is not None, str(given[j]["source"])))
        given = [given[j] for j in order]
        weight = whole([r["bytes"] ** power if r["weight"] is None else r["weight"] for r in given])
        blocks = [-(-r["bytes"] // block_bytes) for r in given]
        total = sum(weight)
        if any(b * total // w >= 1 << 62 for b, w in zip(blocks, weight)):
            raise ValueError("a weight is so small that its slots are no longs")
        horizon = min(b * total // w for b, w in zip(blocks, weight))
        names = rows.column("source").take(pa.array(order)).combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names

        def batch(have):
            k, i, slot, release, due = zip(*have)
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(k)), *(pa.array(x, pa.int64()) for x in (i, slot, release, due)),
                 pa.array([t < horizon for t in slot])],
                ["source_", "block_", "slot", "release", "deadline", "on_target"])

        have = []
        for row in windows(weight, blocks):
            have.append(row)
            if len(have) == PLAN_ROWS:
                yield batch(have)
                have = []
        if have:
            yield batch(have)

    return run


def _unused(docs: DataFrame, name: str) -> str:
    return next(c for i in range(len(docs.columns) + 1) if (c := f"__{name}{i or ''}") not in docs.columns)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Mapping[object, float] | None = None, power: float = 0.5, period: int | None = None,
                block_bytes: int = BLOCK_BYTES, seed: int = 17, bucket_rows: int = BUCKET_ROWS,
                size_col: str | None = None, keep: Sequence[str] = (), row_col: str | None = None, drawn: bool = True) -> DataFrame:
    """One row per input row: doc_id, source, block (number in its source), slot,
    release, deadline, at (first byte of the text in its source), on_target
    (false from the slot on at which the first source has run out), and the
    columns that ``keep`` names.

    Order by (slot, at) for the mixture. ``weights`` must name every source;
    without it a source weighs its bytes to the power ``power``. They hold exactly
    unless ``period`` asks for whole shares of so many slots. A null source is
    a source of its own; a null or empty text takes one byte. Rows are drawn by
    id and row number, so null or repeated ids are spread like all others: ``row_col``
    names the number, else rows are numbered as they are written first. Without
    ``drawn`` the texts of a source go in the order of their numbers: rows that were
    mixed before, numbered as they lie in their files, get the same slots again. A text longer than a block belongs to the block in
    which it begins; ``size_col`` holds the bytes of a text where the text itself
    isn't there. Other columns are not read; an empty table gives an empty
    result."""
    spark = docs.sparkSession
    length = F.octet_length(F.col(text_col).cast("string")) if size_col is None else F.col(size_col)
    size = F.greatest(F.coalesce(length, F.lit(0)), F.lit(1)).cast("long")
    place = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    numbered = docs.withColumn(number := _unused(docs, "place"), place)
    rows = save(numbered.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                                (F.xxhash64(F.col(id_col), F.col(number), F.lit(seed)) if drawn else F.col(number).cast("long")).alias("draw"),
                                *keep), "sizes")
    per = save(rows.groupBy("source").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "sources")
    kind = rows.schema["source"].dataType.simpleString()
    n_rows = per.agg(F.sum("n")).first()[0]
    if not n_rows:
        return spark.createDataFrame([], f"doc_id long, source {kind}, block long, slot long, release long, "
                                         "deadline long, at long, on_target boolean"
                                         + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep))
    if period is not None:
        if weights is None:
            weights = {r["source"]: r["bytes"] ** power for r in per.collect()}
        weights = shares(weights, period)
    same = F.col("source").eqNullSafe(F.col("source_"))
    if weights is None:
        weighed = per.withColumn("weight", F.lit(None).cast("string"))
    else:
        _check(weights)
        table = spark.createDataFrame([(s, str(Fraction(w))) for s, w in weights.items()], f"source_ {kind}, weight string")
        weighed = per.join(table, same, "left")
        if (unnamed := weighed.where("weight is null").first()) is not None:
            raise KeyError(unnamed["source"])
    schema = f"source_ {kind}, block_ long, slot long, release long, deadline long, on_target boolean"
    plan = save(weighed.select("source", "bytes", "weight").coalesce(1).mapInArrow(_plan(block_bytes, power), schema), "mix-plan")

    buckets = max(1, math.ceil(n_rows / bucket_rows))
    bucket = F.least(F.floor((F.shiftright("draw", 1) / F.lit(2.0**63) + 0.5) * buckets).cast("long"), F.lit(buckets - 1).cast("long"))
    dealt = rows.withColumn("bucket", bucket if drawn else F.floor(F.col("draw") / bucket_rows).cast("long"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"),
                          F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (dealt.withColumn("upto", F.sum("size").over(inside))
              .join(offsets, same & (F.col("bucket") == F.col("bucket_")))
              .withColumn("at", F.col("offset") + F.col("upto") - F.col("size"))
              .withColumn("block", F.expr(f"at div {block_bytes}")).drop("source_"))
    timed = placed.join(plan, same & (F.col("block") == F.col("block_")))
    return timed.select("doc_id", "source", "block", "slot", "release", "deadline", "at", "on_target", *keep)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all rows and columns, in the order of the mixture (written files
    follow it from part to part). Each row has a place of its own, whatever its id;
    columns may have any names."""
    keyed, row = row_keys(docs)
    at = mix_sources(keyed, keep=[row], row_col=row, **options).select(row, F.col("slot").alias(f"{row}_slot"), F.col("at").alias(f"{row}_at"))
    order = [f"{row}_slot", f"{row}_at"]
    return keyed.join(at, row).repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])
