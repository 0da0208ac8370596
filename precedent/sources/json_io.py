"""JSON record files and name -> value lookup files.

Record files are read with a declared schema (no inference). A JSON array per
file (``multiline=True``) is parsed by one task per file, in file order; JSON
lines (what ``write_records`` produces) split across tasks. A lookup file is
one JSON object, small by nature.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precedent.operators.documents import assign_positions


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    multiline: bool = True,
    required: bool = True,
    strict: bool = True,
    with_position: bool = False,
) -> DataFrame:
    """Read flat JSON records.

    required=False: a missing path gives an empty DataFrame with ``schema``
    (warn-and-continue policy); True raises. strict=True fails on malformed
    JSON (FAILFAST); False keeps going and puts bad text in ``_corrupt``.
    with_position adds ``pos``: file order within each file, files by name.
    """
    if not _exists(spark, path):
        if required:
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}")
        sch = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        empty = spark.createDataFrame([], sch)
        return empty.withColumn("pos", F.lit(None).cast("long")) if with_position else empty
    sch = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    reader = spark.read.option("multiLine", multiline).option("encoding", "UTF-8")
    if strict:
        reader = reader.option("mode", "FAILFAST")
    else:
        sch = T.StructType(list(sch.fields) + [T.StructField("_corrupt", T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    df = reader.schema(sch).json(path)
    if with_position:
        # one task per file keeps file order; the id's low bits count rows in the task
        df = df.withColumn("_file", F.input_file_name()).withColumn("_mid", F.monotonically_increasing_id())
        df = assign_positions(df, ["_file", "_mid"], "pos").drop("_file", "_mid")
    return df


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines, UTF-8, non-ASCII kept as is."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)
    return path


def read_lookup(spark: SparkSession, path: str, *, required: bool = True) -> DataFrame:
    """One JSON object {name: value} -> (pos, key, value), pos = key order in
    the file. A later duplicate of a key is kept as its own row; build_lookup
    with pos picks the last one."""
    if not _exists(spark, path):
        if required:
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}")
        return spark.createDataFrame([], "pos long, key string, value string")
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.posexplode("m").alias("pos", "key", "value")).withColumn("pos", F.col("pos").cast("long"))
