import json
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from precedent.operators import enrich as J
from precedent.sources import collection as S
from precedent.sources import json_io

SCHEMA = "company_name string, funding_amount string"


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_lookup_file_order_duplicates_and_last_wins(spark):
    d = tempfile.mkdtemp(prefix="lk-")
    p = os.path.join(d, "lookup.json")
    _write(p, '{"Acme": "$1M", "Bolt": "", "": "$3M", "Acme": "$9M", "Café": "未公开"}')
    lk = json_io.read_lookup(spark, p)
    rows = [tuple(r) for r in lk.orderBy("pos").collect()]
    assert [r[1] for r in rows] == ["Acme", "Bolt", "", "Acme", "Café"]
    built = {r.key: r.value for r in J.build_lookup(lk, "key", "value", "pos").collect()}
    assert built == {"Acme": "$9M", "Café": "未公开"}  # empty key/value skipped, last duplicate wins


def test_missing_inputs_required_and_optional(spark):
    missing = os.path.join(tempfile.mkdtemp(prefix="none-"), "absent.json")
    with pytest.raises(AnalysisException):
        json_io.read_records(spark, missing, SCHEMA)
    assert json_io.read_records(spark, missing, SCHEMA, required=False).count() == 0
    assert json_io.read_lookup(spark, missing, required=False).count() == 0


def test_records_array_file_order_and_bad_json(spark):
    d = tempfile.mkdtemp(prefix="rec-")
    good = os.path.join(d, "good.json")
    recs = [{"company_name": f"c{i}", "funding_amount": "未公开" if i == 2 else f"${i}M"} for i in range(5)]
    _write(good, json.dumps(recs, ensure_ascii=False, indent=2))
    df = json_io.read_records(spark, good, SCHEMA, with_position=True)
    assert [(r.pos, r.company_name) for r in df.orderBy("pos").collect()] == [(i, f"c{i}") for i in range(5)]
    bad = os.path.join(d, "bad.json")
    _write(bad, '[{"company_name": "x", ')
    with pytest.raises(Exception):
        json_io.read_records(spark, bad, SCHEMA).collect()
    lenient = json_io.read_records(spark, bad, SCHEMA, strict=False).collect()
    assert len(lenient) == 1 and lenient[0]["_corrupt"] is not None


def test_write_read_roundtrip_keeps_non_ascii(spark):
    df = spark.createDataFrame([("Café", "未公开")], SCHEMA)
    out = json_io.write_records(df, tempfile.mkdtemp(prefix="out-") + "/recs")
    back = json_io.read_records(spark, out, SCHEMA, multiline=False).first()
    assert (back.company_name, back.funding_amount) == ("Café", "未公开")
    raw = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".json"))
    assert "未公开" in raw


def test_collection_rebuild_open_and_versioned_patch(spark):
    with pytest.raises(AnalysisException):
        S.open_collection(spark, os.path.join(tempfile.mkdtemp(prefix="col-"), "nothing"))
    df = spark.createDataFrame([(i, f"ind{i % 3}") for i in range(10)], "id long, industry string")
    chk = S.rebuild_and_check(df).first()
    assert (chk.source_count, chk.written_count, chk.ok) == (10, 10, True)
    path = S.rebuild(df)
    col = S.open_collection(spark, path)
    assert col.where(F.col("industry") == "ind1").count() == 3
    patched = S.patched_version(col.withColumn("industry", F.upper("industry")), path)
    assert patched != path
    assert S.open_collection(spark, path).where(F.col("industry") == "ind1").count() == 3  # old version intact
    assert spark.read.parquet(patched).where(F.col("industry") == "IND1").count() == 3


def test_collection_labels_come_back_as_they_were(spark):
    rows = [(1, "01"), (2, ""), (3, None), (4, "a=b/c"), (5, "1")]
    path = S.rebuild(spark.createDataFrame(rows, "id long, industry string"))
    assert sorted(map(tuple, S.open_collection(spark, path).collect())) == rows
