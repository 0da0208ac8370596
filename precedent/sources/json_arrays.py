"""JSON arrays of records, read by several tasks a file and written as such.

A file ``[{...}, {...}]`` is cut at its closing braces by Spark's text reader,
which splits a file at any byte, so a file of any size is read in parallel
from whatever store Spark reads. Whether a brace ends a record depends on all
text before it (strings, depth), so each piece is weighed for both cases, its
split starting inside or outside a string; running sums inside the splits and
then over the splits (one row each) settle which case holds. The pieces lie
below the shared checkpoint folder, so that all steps see the same splits.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.session import scratch_dir

CORRUPT = "_corrupt"


def _depth(text: F.Column) -> F.Column:
    """Brackets opened less brackets closed outside strings; no escapes in ``text``."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts between closing braces, with running sums inside their split:
    quotes before and after the piece, and the depth after it (its brace
    included) if the split starts outside (d0) or inside (d1) a string."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
        # a backslash and what it escapes lie in one piece: "\}" is no JSON
        F.regexp_replace("value", r"(?s)\\.", "").alias("plain"))
    quotes = F.length("plain") - F.length(F.replace(F.col("plain"), F.lit('"'), F.lit("")))
    odd = quotes % 2 == 1
    raw = raw.select(
        "value", "file", "block", "ord", quotes.alias("q"),
        (_depth(F.col("plain")) - F.when(odd, 0).otherwise(1)).alias("n0"),
        (_depth(F.concat(F.lit('"'), F.col("plain"))) - F.when(odd, 1).otherwise(0)).alias("n1"))
    here = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("before") % 2 == 0
    summed = raw.withColumn("after", F.sum("q").over(here)).withColumn("before", F.col("after") - F.col("q"))
    summed = summed.withColumn("d0", F.sum(F.when(same, F.col("n0")).otherwise(F.col("n1"))).over(here)).withColumn(
        "d1", F.sum(F.when(same, F.col("n1")).otherwise(F.col("n0"))).over(here))
    out = scratch_dir(spark, "json-pieces")
    summed.select("value", "file", "block", "ord", "after", "d0", "d1").write.parquet(out)
    return spark.read.parquet(out)


def _splits(pieces: DataFrame) -> DataFrame:
    """Per split: whether it starts inside a string, its depth at the start,
    whether its file closes all it opens, and the file's last piece."""
    last = pieces.groupBy("file", "block").agg(
        F.max("after").alias("q"), F.max_by("d0", "ord").alias("a"), F.max_by("d1", "ord").alias("b"), F.max("ord").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    change = F.when(F.col("inside") == 0, F.col("a")).otherwise(F.col("b"))
    return (
        last.withColumn("inside", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
        .withColumn("change", change)
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        # the end of a file counts as one more closing brace
        .withColumn("closed", (F.sum("change").over(whole) == -1) & (F.sum("q").over(whole) % 2 == 0))
        # the piece that ends a file, which no brace is known to follow
        .withColumn("last", F.when(F.col("block") == F.max("block").over(whole), F.col("last")))
        .select("file", "block", "inside", "depth", "closed", "last")
    )


def read_arrays(spark: SparkSession, path: str, schema: T.StructType | str, *, strict: bool = True,
                with_position: bool = False) -> DataFrame:
    """Records of the JSON arrays at ``path`` (a file, folder or pattern).

    Fields missing from a record are null, others are ignored. With ``strict``
    text that is no array of objects, or a record that does not fit, fails the
    job; else bad records come with their text in ``_corrupt`` and null fields,
    and of a file that is cut off the last record comes so, without its brace. ``with_position``
    adds ``pos``: order in the file, files by name. An empty array has no rows;
    a file without any text is no array."""
    sch = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    pieces = _pieces(spark, path)
    splits = _splits(pieces)

    def placed(df):
        first = F.col("inside") == 0
        depth = F.col("depth") + F.when(first, F.col("d0")).otherwise(F.col("d1"))
        outside = (F.col("inside") + F.col("after")) % 2 == 0
        return df.join(splits, ["file", "block"]).withColumn(
            "ends", (depth == 1) & outside & ~F.col("ord").eqNullSafe(F.col("last"))).drop("last")

    # records that end before a split: from the sums alone, without the texts
    ended = placed(pieces.drop("value")).groupBy("file", "block").agg(F.count_if("ends").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    number = ended.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    here = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    marked = placed(pieces).join(number, ["file", "block"]).withColumn(
        "k", F.col("first") + F.coalesce(F.sum(F.col("ends").cast("long")).over(here), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("block", "ord", "value")))
    records = marked.groupBy("file", "k").agg(
        F.array_join(F.transform(parts, lambda s: s["value"]), "}").alias("text"),
        F.bool_or("ends").alias("ends"), F.first("closed").alias("closed"))
    lead = F.when(F.col("k") == 0, F.col("text").rlike(r"^\s*\[\s*\{")).otherwise(F.col("text").rlike(r"^\s*,\s*\{"))
    tail = F.when(F.col("k") == 0, F.col("text").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("text").rlike(r"^\s*\]\s*$"))
    good = F.when(F.col("ends"), lead).otherwise(tail)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("no JSON array of records: "), F.col("file"))).cast("boolean")
        records = records.where(F.when(good & F.col("closed"), F.col("ends")).otherwise(wrong))
        options = {"mode": "FAILFAST"}
    else:
        records = records.where(F.col("ends") | ~good)
        sch = T.StructType([*sch.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    body = F.concat(F.regexp_replace("text", r"^\s*[\[,]\s*", ""), F.when(F.col("ends"), F.lit("}")).otherwise(F.lit("")))
    out = records.select("file", "k", F.from_json(body, sch, options).alias("r"))
    if not with_position:
        return out.select("r.*")
    sizes = number.join(ended, ["file", "block"]).groupBy("file").agg(F.sum("n").alias("n"))
    # one row a file
    base = sizes.withColumn("base", F.coalesce(
        F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return out.join(base, "file").select("r.*", (F.col("base") + F.col("k")).cast("long").alias("pos"))


def _bracketed(batches):
    """Texts of a partition as the lines of one array."""
    lead = "["
    for b in batches:
        if b.num_rows:
            leads = pa.array([lead] + [","] * (b.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(leads, b.column(0).cast(pa.string()), "")], ["value"])
            lead = ","
    yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])


def write_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Writes each partition as one JSON array in a file of its own (UTF-8,
    nulls written out), in the order of the rows; sort ``df`` before for an
    order over all files. Files appear when the job commits."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(_bracketed, "value string").write.mode(mode).text(path)
    return path
