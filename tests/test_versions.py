"""Collections in versions: patches of touched folders, reopening, refusals, expiry."""

import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from precedent.sources import versions as V

SCHEMA = "id long, name string, industry string, embedding array<float>"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_patch_rewrites_touched_folders_and_expiry_removes_the_rest(spark):
    base = tempfile.mkdtemp(prefix="versions-")
    with pytest.raises(AnalysisException):
        V.open_version(spark, base)
    df = _rows(spark, [(i, f"n{i}", f"i{i % 3}", [float(i), 1.0]) for i in range(40)])
    one = V.create(df, base, vector_col="embedding", metric="cosine", folders=8)
    assert (one.version, one.count, one.dimension, one.metric, len(one.paths)) == (1, 40, 2, "cosine", 8)
    two = V.patch(spark, base, rows=_rows(spark, [(5, "new", "", None)]))
    changed = [k for k in one.paths if one.paths[k] != two.paths[k]]
    assert len(changed) == 1 and two.count == 40
    three = V.patch(spark, base, rows=_rows(spark, [(100, "added", None, [1.0, 2.0])]),
                    gone=spark.createDataFrame([(6,), (999,), (None,)], "id long"))
    assert three.count == 40 and V.versions(spark, base) == [1, 2, 3]
    now = {r["id"]: r for r in V.open_version(spark, base).collect()}
    assert now[5]["name"] == "new" and now[5]["industry"] == "" and 6 not in now and now[100]["industry"] is None
    assert sorted(map(tuple, V.open_version(spark, base, 1).select("id", "name").collect())) == [(i, f"n{i}") for i in range(40)]
    assert V.open_version(spark, base).schema == df.schema
    assert V.expire(spark, base, keep=1) == [1, 2] and V.open_version(spark, base).count() == 40
    assert not os.path.exists(one.paths[changed[0]]) and V.versions(spark, base) == [3]


def test_refusals_leave_the_current_version(spark):
    base = tempfile.mkdtemp(prefix="versions-")
    good = _rows(spark, [(1, "a", "x", [1.0, 0.0]), (2, "b", "x", None)])
    for bad in ([(1, "a", "x", None), (1, "b", "x", None)], [(None, "a", "x", None)], [(1, "a", "x", [1.0]), (2, "a", "x", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            V.create(_rows(spark, bad), base, vector_col="embedding")
    assert V.versions(spark, base) == []
    first = V.create(good, base, vector_col="embedding", folders=4)
    for rows in ([(3, "c", "x", [1.0])], [(3, "c", "x", None), (3, "d", "x", None)]):
        with pytest.raises(ValueError):
            V.patch(spark, base, rows=_rows(spark, rows))
    with pytest.raises(ValueError):
        V.patch(spark, base, rows=good.drop("industry"))
    with pytest.raises(RuntimeError):  # another writer took the number
        V._commit(spark, base, first)
    assert V.manifest(spark, base) == first and not [f for f in os.listdir(f"{base}/versions") if len(f) > 8 and not f.endswith(".crc")]
    empty = tempfile.mkdtemp(prefix="versions-")
    assert V.create(good.where("false"), empty).count == 0 and V.open_version(spark, empty).count() == 0
    assert V.patch(spark, empty, rows=good).count == 2
    assert V.patch(spark, empty, gone=good.select("id")).count == 0
    assert V.open_version(spark, empty).select(F.count("*")).first()[0] == 0
