"""Scratch tables, reading, and joins that stay level under a hot key."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.session import ensure_checkpoint_dir

#: A key is hot when it holds more than one row in this many; so there are at
#: most this many hot keys whatever the size of the table.
HOT_KEYS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it
    back. Cuts the lineage; any executor can read it again."""
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers its rows, and that column's name. A row of
    a file has the number of its file and its place there, the same in every
    evaluation whatever the partitions; rows of anything else are written and
    numbered once. The driver holds the names of the files."""
    name, path, place = (next(c for i in range(len(docs.columns) + 1) if (c := f"__{k}{i or ''}") not in docs.columns)
                         for k in ("row", "path", "place"))
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
        files = sorted(r[0] for r in at.select(path).distinct().collect())
    except AnalysisException:  # no table of files
        return save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    number = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], f"{path} string, {name} long")
    keyed = at.join(F.broadcast(number), path)  # one row per file
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(name) + F.col(place)).alias(name)), name


def fold(id_col: str, parts: int, held: int = 2) -> Column:
    """True for the held-out rows: crc32 of the id as text, modulo ``parts``,
    equals ``held``. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == held, F.lit(False))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per ``key``; ``size`` is its
    number of rows in ``rows``). Groups above 1/HOT_KEYS of all rows number
    less than HOT_KEYS, so that bounded list is broadcast and their rows are
    never shuffled; all other groups go through a shuffle join. Both inputs are
    read twice: pass saved tables."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_KEYS > F.lit(total)
    few = F.broadcast(groups.where(hot))
    on_hot = rows.join(few, key)
    rest = rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti").join(groups.where(~hot), key)
    return on_hot.unionByName(rest)
