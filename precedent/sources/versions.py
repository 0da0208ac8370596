"""A collection in versions: rows in folders by hash of their id, and one small
manifest a version that names the folder of each hash.

``<base>/versions/<n>.json`` holds schema, vector column, vector length, metric, row
count and the paths of the data. A version comes into being when its manifest is renamed
to its number, which fails if another writer was first; so readers see a whole version
or the one before, and the newest number is the current one. A patch reads and
rewrites the folders that hold one of its ids; all others are shared with the version
before. ``expire`` removes folders that no kept version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER, FOLDERS, SPLITS = "id_folder", 64, 8


@dataclass(frozen=True)
class Manifest:
    """What a version is: everything a reader needs, bounded by ``folders``."""

    version: int
    key: str
    folders: int
    schema: str
    count: int
    paths: dict[str, str]
    vector_col: str | None = None
    dimension: int | None = None
    metric: str = "sql2"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(conf), conf


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions that exist, in order."""
    _, folder, fs, _ = _files(spark, f"{base}/versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> Manifest:
    """The manifest of a version (the current one by default); an error if there is none."""
    have = versions(spark, base)
    if not have or version is not None and version not in have:
        raise AnalysisException(f"[PATH_NOT_FOUND] no version {'' if version is None else version} of a collection at {base}")
    text = spark.read.text(f"{base}/versions/{have[-1] if version is None else version}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def _commit(spark: SparkSession, base: str, m: Manifest) -> Manifest:
    jvm, temp, fs, conf = _files(spark, f"{base}/versions/.{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(bytearray(json.dumps(asdict(m)).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:  # refuses to replace a file
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), conf)
        context.rename(fs.makeQualified(temp), fs.makeQualified(_files(spark, f"{base}/versions/{m.version}.json")[1]), none)
    except Exception as e:
        fs.delete(temp, False)
        raise RuntimeError(f"version {m.version} of {base} was written by another writer") from e
    return m


def _folder(key: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(folders)).cast("int")


def _write(df: DataFrame, base: str, key: str, folders: int) -> tuple[dict[str, str], int, int]:
    """Write ``df`` below a fresh folder: its paths by folder, rows, and distinct keys."""
    path = f"{base}/data/{uuid.uuid4().hex[:12]}"
    split = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(SPLITS))  # files of a folder
    df.withColumn(FOLDER, _folder(key, folders)).repartition(FOLDER, split).write.partitionBy(FOLDER).parquet(path)
    back = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField(FOLDER, T.IntegerType())])).parquet(path)
    per = back.groupBy(FOLDER, key).agg(F.count(F.lit(1)).alias("n")).groupBy(FOLDER).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).collect()  # a row a folder
    return {str(r[0]): f"{path}/{FOLDER}={r[0]}" for r in per}, sum(r["n"] for r in per), sum(r["keys"] for r in per)


def _checked(df: DataFrame, key: str, vector_col: str | None, dimension: int | None) -> int | None:
    """Refuses null ids and vectors of unlike length; the vector length."""
    bad = [F.count_if(F.col(key).isNull()).alias("no_id")]
    if vector_col:
        bad += [F.min(F.size(vector_col)).alias("lo"), F.max(F.size(vector_col)).alias("hi")]
    r = df.agg(*bad).first()
    if r["no_id"]:
        raise ValueError(f"{r['no_id']} rows have no {key}")
    if not vector_col or r["hi"] is None:
        return dimension
    if r["lo"] != r["hi"] or dimension not in (None, r["hi"]):
        raise ValueError(f"vectors of {r['lo']} to {r['hi']} components, not {dimension or 'one length'}")
    return r["hi"]


def create(df: DataFrame, base: str, key: str = "id", vector_col: str | None = None, metric: str = "sql2",
           folders: int = FOLDERS) -> Manifest:
    """Write the whole of ``df`` as the next version. Ids are unique and not null, vectors
    (null ones aside) of one length; anything else is refused before a version exists."""
    spark = df.sparkSession
    dimension = _checked(df, key, vector_col, None)
    paths, count, keys = _write(df, base, key, folders)
    if keys != count:
        raise ValueError(f"{count - keys} rows repeat a {key}")
    number = max(versions(spark, base), default=0) + 1
    return _commit(spark, base, Manifest(number, key, folders, df.schema.json(), count, paths, vector_col, dimension, metric))


def open_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the current one by default), with its columns and types."""
    m = manifest(spark, base, version)
    schema = T.StructType.fromJson(json.loads(m.schema))
    return spark.read.schema(schema).parquet(*m.paths.values()) if m.paths else spark.createDataFrame([], schema)


def patch(spark: SparkSession, base: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> Manifest:
    """The next version: ``rows`` (all columns of the collection, unique ids) replace the
    rows of their ids or are added, ids of ``gone`` are removed. Only folders with such
    an id are read and written. Of two patches of one version, the later fails."""
    m = manifest(spark, base)
    schema = T.StructType.fromJson(json.loads(m.schema))
    key = m.key
    dimension = m.dimension
    ids = []
    if rows is not None:
        if missing := [c for c in schema.names if c not in rows.columns]:
            raise ValueError(f"a patch needs the columns {missing}")
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        dimension = _checked(rows, key, m.vector_col, m.dimension)
        ids.append(rows.select(key))
    if gone is not None:
        gone = gone.select(F.col(key).cast(schema[key].dataType).alias(key)).where(F.col(key).isNotNull())
        ids.append(gone)
    if not ids:
        raise ValueError("a patch needs rows or ids")
    changed = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
    touched = [str(r[0]) for r in changed.select(_folder(key, m.folders)).distinct().collect()]  # at most ``folders``
    old = [m.paths[t] for t in touched if t in m.paths]
    parts = [spark.read.schema(schema).parquet(*old).join(changed, key, "left_anti").select(*schema.names)] if old else []
    if rows is not None:
        parts.append(rows if gone is None else rows.join(gone, key, "left_anti").select(*schema.names))
    fresh = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        fresh = fresh.unionByName(p)
    before = spark.read.schema(schema).parquet(*old).count() if old else 0
    paths, count, keys = _write(fresh, base, key, m.folders)
    if keys != count:
        raise ValueError(f"{count - keys} rows of the patch repeat a {key}")
    kept = {t: p for t, p in m.paths.items() if t not in touched}
    return _commit(spark, base, replace(m, version=m.version + 1, paths={**kept, **paths}, count=m.count - before + count,
                                        dimension=dimension))


def expire(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` versions and the folders that only they name;
    the numbers removed. Folders of writes under way or given up are left alone."""
    have = versions(spark, base)
    old, stay = have[: max(len(have) - max(keep, 1), 0)], have[max(len(have) - max(keep, 1), 0):]
    named = {p for v in stay for p in manifest(spark, base, v).paths.values()}
    lost = {p for v in old for p in manifest(spark, base, v).paths.values()} - named
    for v in old:  # no reader finds a version whose folders are going
        _, p, fs, _ = _files(spark, f"{base}/versions/{v}.json")
        fs.delete(p, False)
    for path in sorted(lost):
        _, p, fs, _ = _files(spark, path)
        fs.delete(p, True)
    return old
