import json
import os
import tempfile

import pytest

from precedent.sources.json_arrays import read_arrays, write_arrays

SCHEMA = "id long, text string, inner struct<a: array<struct<b: string>>>"


def _file(text, folder=None, name="a.json"):
    folder = folder or tempfile.mkdtemp(prefix="arr-")
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)
    return folder


def _records(n):
    texts = ["plain", "}", "a}b{c", '"}"', "\\", '\\"}', "[{]}", "未公开}", "", None, '{"id": 1}', "x" * 300 + "}\n{" * 40]
    return [{"id": i, "text": texts[i % len(texts)], "extra": {"}": [1, {}]},
             "inner": {"a": [{"b": "}"}, {"b": f"v{i}"}, {}]} if i % 3 else None} for i in range(n)]


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_splits_inside_strings_and_records(spark, tiny_splits, indent):
    recs = _records(40)
    folder = _file(json.dumps(recs, ensure_ascii=False, indent=indent))
    assert spark.read.option("lineSep", "}").text(folder).rdd.getNumPartitions() > 20
    got = read_arrays(spark, folder, SCHEMA, with_position=True).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(40)) and [r.id for r in got] == list(range(40))
    assert [r.text for r in got] == [r["text"] for r in recs]
    assert all((g.inner is None) == (r["inner"] is None) for g, r in zip(got, recs)) and got[1].inner.a[0].b == "}"


def test_several_files_in_order_and_empty_ones(spark):
    folder = _file("[]", name="a.json")
    _file('[{"id": 1}, {"id": 2}]', folder, "b.json")
    _file(" [ \n ] ", folder, "c.json")
    _file('\n[{"id": 3}]\n', folder, "d.json")
    got = read_arrays(spark, folder, "id long", with_position=True).collect()
    assert sorted((r.pos, r.id) for r in got) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("bad", ['[{"id": 1}, {"id": 2}', '[{"id": 1}, {"id": ', '{"id": 1}', '{"id": {"b": 1}}', '[{"id": 1} {"id": 2}]',
                                 '[1, {"id": 2}]', '[{"id": 1}] x', '[{"id": "one"}]', '[{"id": 1}, "x]', '[[{"id": 1}]]'])
def test_what_is_no_array_of_records_fails_if_strict(spark, bad):
    with pytest.raises(Exception):
        read_arrays(spark, _file(bad), "id long").collect()


def test_bad_records_are_kept_as_text_if_not_strict(spark):
    got = read_arrays(spark, _file('[{"id": 1}, {"id": "one"}, {"id": 3}]'), "id long", strict=False).collect()
    assert sorted((r.id, r._corrupt) for r in got if r.id) == [(1, None), (3, None)]
    assert [r._corrupt for r in got if r.id is None] == ['{"id": "one"}']
    for end in ('{"id": ', '{"id": 2'):
        cut = read_arrays(spark, _file('[{"id": 1}, ' + end), "id long", strict=False).collect()
        assert [r.id for r in cut if not r._corrupt] == [1] and [r._corrupt for r in cut if r._corrupt] == [end]


def test_written_arrays_are_json_and_come_back(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f'é"{i}}}') for i in range(20)], "id long, text string")
    out = write_arrays(df.repartition(3).sortWithinPartitions("id"), tempfile.mkdtemp(prefix="out-"))
    files = [f for f in os.listdir(out) if f.endswith(".txt")]
    every = [r for f in files for r in json.load(open(os.path.join(out, f), encoding="utf-8"))]
    assert len(files) == 3 and len(every) == 20 and all("text" in r for r in every)
    back = read_arrays(spark, out, "id long, text string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    none = write_arrays(df.where("id < 0").coalesce(1), tempfile.mkdtemp(prefix="out-"))
    assert read_arrays(spark, none, "id long").count() == 0
