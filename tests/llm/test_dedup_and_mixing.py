"""Exact and near dedup, vectors, mixing, components and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from precedent.llm import minhash_dedup, queries
from precedent.llm.components import components
from precedent.llm.embedding_dedup import near_vectors
from precedent.llm.exact_dedup import CuckooIndex, apply_changes, exact_dedup
from precedent.llm.quality_cotraining import score_quality
from precedent.llm.pfair_mix import mix_sources, mixed, schedule, shares
from tests.conftest import SMOKE
from tests.llm.test_text_operations import none, odd_docs


def smallest(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_cuckoo_index_is_exact_under_insertion_deletion_and_growth():
    rng, live, index = random.Random(1), {}, CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(20_000):
        key = rng.choice(keys)
        if rng.random() < 0.6:
            if index.get(key) is None:
                index.add(key, 1)
            live[key] = 1
        else:
            assert index.delete(key) == (live.pop(key, None) is not None)
    assert index.resizes and index.n == len(live) and dict(index.items()) == live


def test_exact_groups_and_changes(spark):
    rows = odd_docs(spark)
    got = Counter(tuple(r) for r in exact_dedup(rows).drop("text_sha256").collect())
    assert got == Counter({(1, 1, 2, True): 2, (2, 3, 3, False): 1, (3, 3, 3, True): 1, (None, 3, 3, False): 1, (4, 4, 1, True): 1,
                           (5, 6, 2, False): 1, (6, 6, 2, True): 1, (None, None, 1, True): 1, (7, 7, 1, True): 1, (8, 8, 1, True): 1})
    sha = exact_dedup(spark.createDataFrame([(1, "Ä B")], "doc_id long, text string")).first()["text_sha256"]
    assert sha == hashlib.sha256("Ä b".encode()).hexdigest()
    assert exact_dedup(none(spark)).count() == 0
    table = lambda ids: spark.createDataFrame([(i, bytes([i % 3]) * 32) for i in ids], "doc_id long, digest binary")
    after = apply_changes(table(range(20)), table([3, 25, 30]), table([0, 3, 4, 40]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({*range(20), 25, 30} - {0, 4})


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(400, 700) if i != 500]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links] * 2
    nodes = {x for p in links for x in p if p[0] != p[1]}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == smallest(nodes, [p for p in links if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _near(rows):
    own = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    by = {}
    for i, s in own.items():
        for x in s:
            by.setdefault(x, []).append(i)
    links = [(i, j) for i, s in own.items() for j, n in Counter(j for x in s for j in by[x] if j < i).items()
             if 100 * n >= 75 * (len(s) + len(own[j]) - n)]
    comp = smallest(own, links)
    return {i: (len(own[i]), comp[i]) for i in own}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng, rows = random.Random(5), []
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for i in range(160):  # a chain of edits around one text, and texts that share half of it
        t = base[:] if i % 2 else base[:60] + [f"u{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        rows.append((1000 - i, " ".join(t)))
    rows += [(2000, ""), (2001, None), (2002, "a B"), (2003, "a b"), (2004, " A\tb "), (2005, "a b c d e f"), (2006, "a b c d e g")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, node long")
    want = _near(rows)
    for block in (1000, 7):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_dedup(docs).collect()}
        assert got == want
    out = minhash_dedup.near_dedup(odd_docs(spark)).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in out)[(6, 5, False)] == 1 and len(out) == 11
    assert minhash_dedup.near_dedup(none(spark)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 16))
    x = [*(centre[i % 6] + rng.normal(size=16) * 0.1 for i in range(150)), *rng.normal(size=(150, 16))]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(900, [float(c) for c in x[0]]), (901, [float(c) for c in x[0]])]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    ids = [r[0] for r in rows]
    comp = smallest(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a > b])
    want = {i: (int(near[k].sum()) - 1, comp[i]) for k, i in enumerate(ids)}
    odd = [(-1, None), (-2, []), (-3, [0.0] * 16), (-4, [float("nan")] * 16), (-5, [None] * 16), (-6, rows[0][1][:5]), (None, rows[0][1])]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows + odd], "vec_id long, embedding array<double>, size int, cls string")
    for interval in (4096, 40):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(table, interval=interval).collect()}
        assert got == want | {i: (0, i) for i, _ in odd}
    assert near_vectors(table.where("false")).count() == 0


def test_pfair_windows_and_deviation():
    for weights in ({"a": 5, "b": 3, "c": 1}, {i: 1 + i % 7 for i in range(40)}, {None: 1}):
        share = shares(weights, 200)
        assert sum(share.values()) == 200
        sent = Counter()
        for source, i, slot in schedule(share):
            w = share[source] / 200
            assert i == sent[source] and int(i / w) <= slot < -(-(i + 1) * 200 // share[source])
            sent[source] += 1
            assert all(abs(sent[s] - share[s] / 200 * (slot + 1)) < 1 for s in share)


def test_mixture_follows_the_given_weights_to_the_end(spark):
    text = "x" * 10
    half = spark.range(4000).selectExpr("id as doc_id", f"'{text}' as text", "if(id < 2000, 0, 1 + id % 19) as source")
    few = spark.range(1200).selectExpr("id as doc_id", f"'{text}' as text", "if(id < 1199, 0, 1) as source")
    for docs, weights in ((half, {s: 19 if s == 0 else 1 for s in range(20)}), (few, {0: 1.0, 1: 1e-5})):
        out = sorted((r["slot"], r["source"], r["on_target"]) for r in mix_sources(docs, weights=weights, block_bytes=10).collect())
        assert len({slot for slot, _, _ in out}) == len(out) == docs.count()
        sent, total = Counter(), sum(weights.values())
        on = [s for _, s, on in out if on]
        assert len(on) >= 1000
        for n, s in enumerate(on, 1):
            sent[s] += 1
            assert all(abs(sent[k] - w / total * n) < 1 for k, w in weights.items())


def test_mixture_keeps_all_rows_near_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mix_sources(docs, block_bytes=2048, bucket_rows=100).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(1000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    first = {r["source"]: [] for r in out}
    for r in out:
        first[r["source"]].append((r["at"], r["slot"], r["block"]))
    for rows in first.values():
        rows.sort()
        assert [r[1] for r in rows] == sorted(r[1] for r in rows) and rows[0][0] == 0
    odd = odd_docs(spark)
    again = mixed(odd)
    assert again.columns == odd.columns and Counter(map(tuple, again.collect())) == Counter(map(tuple, odd.collect()))
    assert mix_sources(none(spark)).count() == 0 and mixed(none(spark)).count() == 0


def test_pipeline_stages_and_odd_rows(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = corpus_pipeline.run(spark, SMOKE)
    got = out.select("doc_id", "lossless").collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = [r["doc_id"] for r in got]
    assert len(left) == len(set(left)) and all(r["lossless"] for r in got)
    folded = ["".join(c.lower() if c.isascii() else c for c in text[i]) for i in left]
    assert len(folded) == len(set(folded))
    near = _near([(i, text[i]) for i in left])
    assert all(c == i for i, (_, c) in near.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMOKE}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in left) <= 0.3 * max(1, sum(q == 0 for q in labels.values()))
    rows = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SMOKE)
        assert rows.columns == odd_docs(spark).columns
    left = [(r["doc_id"], r["text"]) for r in rows.collect()]  # null ids are decided like all others
    assert len(left) == len({t for _, t in left}) and (None, None) not in left and sum(i == 1 for i, _ in left) <= 1


def _stages(spark, rows, names=("exact_dedup", "near_dedup", "mixing")):
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            rows = stage(spark, rows, SMOKE)
    return rows


def test_stages_decide_by_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    once = {(r["doc_id"], r["text"]) for r in _stages(spark, docs).collect()}
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs.repartition(2).write.mode("append").parquet(str(tmp_path / "docs"))
    twice = _stages(spark, spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert len(twice) == len(once) and {(r["doc_id"], r["text"]) for r in twice} == once
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert len({r["text"].lower() for r in _stages(spark, nameless, ("exact_dedup",)).collect()}) == nameless.select(F.lower("text")).distinct().count()
    assert _stages(spark, nameless).count() == len(once)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (1, "another text that shares the id and nothing else"), (2, " ".join(words)), (3, " ".join(words[:-1])),
            (3, "a third one, with an id of its own copy")]
    for add in ({}, {"_id": 1, "_slot": 2, "_at": 3, "__row": 4, "row": 5, "group": 6, "id": 7, "_metadata": 8}):
        table = spark.createDataFrame([(*r, "s", *add.values()) for r in rows], ["doc_id", "text", "source", *add])
        out = _stages(spark, table)
        assert out.columns == table.columns
        assert sorted(r["text"] for r in out.collect()) == sorted([rows[1][1], rows[4][1], rows[2][1]])


def test_quality_takes_sizes_that_are_not_finite(spark):
    docs = [(i, "good words of prose, again and again. " * (3 + i % 5) if i % 2 else "@@## 1 2 3 %% " * 9, "s", "en",
             [float("nan"), float("inf"), -5.0, 100.0, None][i % 5]) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = score_quality(table, labels).collect()
    assert len(got) == 60 and all(r["kept"] == bool(r["doc_id"] % 2) for r in got)


def test_pipeline_result_carries_the_mixture(spark, tmp_path):
    text = "some words of a text that is always the same, over and over. " * 64
    docs = spark.range(900).selectExpr("id as doc_id", f"'{text}' as text", "if(id < 600, 'a', if(id < 800, 'b', 'c')) as source")
    docs.repartitionByRange(7, "doc_id").write.parquet(str(tmp_path / "docs"))
    out = corpus_pipeline.pieces(spark, spark.read.parquet(str(tmp_path / "docs")), SMOKE).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(900)) and all(r["lossless"] for r in out)
    out.sort(key=lambda r: (r["slot"], r["at"]))
    size = Counter(r["source"] for r in out)
    weight = {s: n**0.5 / sum(m**0.5 for m in size.values()) for s, n in size.items()}
    sent, per_block = Counter(), (64 << 10) / len(text)
    for n, r in enumerate([r for r in out if r["on_target"]], 1):
        sent[r["source"]] += 1
        assert all(abs(sent[s] - w * n) < 3 * per_block for s, w in weight.items())
    assert n > 300
    rows = odd_docs(spark)
    got = corpus_pipeline.pieces(spark, rows, SMOKE).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows.collect())
    assert len({(r["source"], r["slot"], r["at"]) for r in got}) == 11
    assert corpus_pipeline.pieces(spark, none(spark), SMOKE).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE) <= set(entry.oracle_sql())
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")] == list(range(1, 14))


def test_mix_spreads_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else 7, "x" * (1 + i % 5), "s") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs, bucket_rows=200, block_bytes=64).collect()
    assert len(out) == 4000 and len({r["at"] for r in out}) == 4000  # each row has bytes of its own
    first = [r["doc_id"] for r in sorted(out, key=lambda r: r["at"])[:400]]
    assert 120 < first.count(7) < 280  # ids are no longer drawn together


def test_last_stage_follows_the_order_of_the_mixing(spark, tmp_path):
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('some words of a text, ', 200 + cast(id % 40 as int)) as text",
                                       "if(id < 400, 'a', if(id < 550, 'b', null)) as source")
    docs.repartitionByRange(5, "doc_id").write.parquet(str(tmp_path / "docs"))
    path = str(tmp_path / "mixed")
    corpus_pipeline.mixture(spark, spark.read.parquet(str(tmp_path / "docs")), SMOKE).write.parquet(path)
    stored = spark.read.parquet(path).select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    order = [r["doc_id"] for r in sorted(stored, key=lambda r: (r["file_name"], r["row_index"]))]
    out = corpus_pipeline.pieces(spark, spark.read.parquet(path), SMOKE).select("doc_id", "slot", "at").collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: (r["slot"], r["at"]))] == order
    # another order of the files gives another result
    spark.read.parquet(path).repartition(1).orderBy(F.desc("doc_id")).write.parquet(str(tmp_path / "turned"))
    turned = corpus_pipeline.pieces(spark, spark.read.parquet(str(tmp_path / "turned")), SMOKE).select("doc_id", "slot", "at").collect()
    assert [r["doc_id"] for r in sorted(turned, key=lambda r: (r["slot"], r["at"]))] != order
