"""Encoding, quality, language, licences, spans, language model: against brute
force, exact round trips, or held-out accuracy; and odd inputs."""

import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from precedent.llm import language_crf as crf
from precedent.llm import quality_cotraining
from precedent.llm import sentencepiece_sampling as sps
from precedent.llm import span_dedup as sd
from precedent.llm.katz_lm import Unigrams, discounts, katz_scores
from precedent.llm.license_scan import license_texts, scan_licenses
from precedent.llm.quality_cotraining import score_quality
from precedent.llm.span_dedup import span_dedup
from precedent.llm.tokens import Hasher, texts, words
from precedent.session import ensure_checkpoint_dir
from tests.conftest import SMOKE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, key long"


def odd_docs(spark):
    """Null columns, empty and very long texts, repeats, clashing columns."""
    long = "one two three four five six seven. " * 4000
    rows = [(1, "Plain text here. And more of it."), (1, "Plain text here. And more of it."), (2, None), (3, ""), (4, " \n\t "),
            (5, long), (6, long), (None, "no id. But a text."), (None, None), (7, "日本 ▁ \x00 x" + "y" * 300), (8, "... 123")]
    return spark.createDataFrame([(i, t, None, None if i == 3 else "s", None, "d", 1, 2) for i, t in rows], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes_follow_python_whatever_the_slices():
    col = pa.array(["Ab  c\x0bd", None, "", "É é\x85x", "z" * 2000, "end\n"])
    want = [(x or "").encode().lower().split() for x in col.to_pylist()]
    hasher, seen = Hasher(), {}
    for limit in (1, 7, 1 << 20):
        got = []
        for t in texts(col, limit):
            low = t.lower()
            w = words(low)
            for h, a, b in zip(hasher.spans(low.buf, w.start, w.end).tolist(), w.start, w.end):
                assert seen.setdefault(bytes(low.buf[a:b]), h) == h
            got += [[bytes(low.buf[a:b]) for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.bound, w.bound[1:])]
        assert got == want
    assert len(set(seen.values())) == len(seen)


def test_pieces_round_trip_are_repeatable_and_follow_the_posterior(spark):
    docs = odd_docs(spark)
    out = sps.encode(docs).collect()
    assert len(out) == 11 and all(r["lossless"] for r in out)
    again = sps.encode(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"] or ()), r["ids"] is None) for r in out) == Counter(
        (r["doc_id"], tuple(r["ids"] or ()), r["ids"] is None) for r in again)
    back = sps.decode(sps.encode(docs)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert sps.encode(none(spark)).count() == 0

    lat, raw, n = sps.Lattice(sps.model_path()), b" token", 20_000
    weights = {}

    def walk(p, path, w):
        if p == len(raw):
            weights[path] = w
        for q in range(p + 1, len(raw) + 1):
            if (i := lat.of.get(raw[p:q])) is not None:
                walk(q, (*path, i), w * lat.weight[i])

    walk(0, (), 1.0)
    total = sum(weights.values())
    (t,) = texts(pa.array(["token"] * n))
    ids, b = sps.encode_slice(lat, Hasher(), t, np.arange(n).astype(np.uint64), 3)
    drawn = Counter(tuple(ids[i:j].tolist()) for i, j in zip(b, b[1:]))
    lone = Counter(tuple(sps._long(lat, raw, np.zeros(6, bool), int(s))) for s in np.random.default_rng(1).integers(0, 1 << 62, 4000))
    for path, w in weights.items():
        assert abs(drawn[path] / n - w / total) < 0.015
        assert abs(lone[path] / 4000 - w / total) < 0.03


def test_forward_backward_is_exact_across_segments(monkeypatch):
    monkeypatch.setattr(crf, "SEGMENT", 4)
    rng = np.random.default_rng(0)
    scores, bound, moves = rng.normal(size=(3, 23)) * 3, np.array([0, 1, 1, 10, 23]), rng.normal(size=(3, 3))
    got, state = crf.forward_backward(scores, bound, moves)
    chain = np.repeat(np.arange(4), np.diff(bound))
    expected = np.zeros((3, 3))
    for i, j in zip(bound, bound[1:]):
        if i == j:
            continue
        a, b = np.zeros((3, j - i)), np.zeros((3, j - i))
        a[:, 0] = scores[:, i]
        for t in range(1, j - i):
            a[:, t] = np.log(np.exp(a[:, t - 1][:, None] + moves).sum(0)) + scores[:, i + t]
        for t in range(j - i - 2, -1, -1):
            b[:, t] = np.log(np.exp(moves + scores[:, i + t + 1] + b[:, t + 1]).sum(1))
            joint = np.exp(a[:, t][:, None] + moves + scores[:, i + t + 1] + b[:, t + 1] - np.logaddexp.reduce(a[:, j - i - 1]))
            expected += joint
        p = np.exp(a + b - np.logaddexp.reduce(a[:, j - i - 1]))
        assert np.allclose(p, got[:, i:j], atol=1e-10)
    assert np.allclose(crf.expected_moves(state, np.diff(chain) == 0), expected, atol=1e-9)


def test_language_is_right_on_held_out_texts_and_inside_mixed_ones(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = crf.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count() > 20
    rows = crf.sample(docs, "doc_id", "text", "lang", F.lit(True), 40, 8000)
    model = crf.train(rows)
    pick = {y: " ".join(x.split()[:15]) for x, y in rows if len(x.split()) > 30 and "!" not in x}
    mixed = crf.label_words(model, f"{pick['en']} {pick['de']}")
    n = len([w for w in words(next(texts(pa.array([pick["en"]]))), crf.NOT_LETTER).start])
    hits = [y == ("en" if i < n else "de") for i, (_, y, _) in enumerate(mixed)]
    assert sum(hits) >= 0.85 * len(hits)


def test_language_learns_labels_that_have_only_long_texts(spark):
    de = "Der Hund läuft über die Straße und die Katze schläft im Garten. Wir gehen heute nicht zur Schule! "
    en = "The dog runs over the street and the cat sleeps in the garden. We do not go to school today! "
    rows = [(i, en if i % 2 else de * 200, "en" if i % 2 else "de") for i in range(40)] + [(100, de, "de"), (101, "x" * 9000, "en")]
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in crf.predict_language(docs).collect()}
    assert got == {i: y for i, _, y in rows[:40]}
    drawn = crf.sample(spark.createDataFrame(rows, docs.schema), "doc_id", "text", "lang", F.lit(True), 3, 800)
    assert {y for _, y in drawn} == {"de", "en"} and all(0 < len(x) <= 800 for x, _ in drawn)
    assert (de, "de") in drawn  # short texts first
    assert 0 < len(crf.excerpt("日本" * 9000, 800)) <= 800 and crf.excerpt("... " * 3000 + "word", 800) == "word"


def test_language_odd_inputs(spark):
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in crf.predict_language(odd_docs(spark)).collect()}
    assert {y for _, y, _ in rows} == {"und"}  # no labels: nothing learnt
    docs = odd_docs(spark).withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r for r in crf.predict_language(docs, folds=1, held=2).collect()}
    assert got[1]["lang_pred"] == "en" and 0 < got[1]["score"] <= 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 8))
    assert crf.predict_language(none(spark)).count() == 0


def test_quality_features_are_computed_in_small_slices():
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcXYZ 019\n.!|#", np.uint8)
    rows = [bytes(rng.choice(letters, 3000)).decode() for _ in range(400)] + ["", None, "é😀 a A", "x y " * (quality_cotraining.SLICE // 2)]
    col = lambda v, t: pa.array([v] * len(rows), t)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows), col("s", pa.string()), col("l", pa.string()), col(1.0, pa.float64()),
                                        pa.array(range(len(rows)))], ["doc_id", "text", "source", "lang", "declared", "row"])
    tracemalloc.start()
    small = pa.Table.from_batches(quality_cotraining._features(iter([batch.slice(0, 400)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and small.num_rows == 400  # 1.2 MB of text
    got = pa.Table.from_batches(quality_cotraining._features(iter([batch])))
    assert got["doc_id"].to_pylist() == list(range(len(rows)))
    for text, x, empty in zip(rows, got["x_text"].to_pylist(), got["empty"].to_pylist()):
        raw = (text or "").encode()
        assert empty == (not raw)
        shares = [sum(bool(mask[c]) for c in raw) / max(len(raw), 1) for mask in quality_cotraining._CLASSES.values()]
        assert x[:20:2] == shares


def test_quality_on_held_out_labels_and_odd_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("crc32(cast(doc_id as string)) % 3 <> 0")
    out = score_quality(docs, train).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 0").collect()
    clean = [r for r in out if r["quality"] == 1]
    junk = [r for r in out if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean) and sum(not r["kept"] for r in junk) >= 0.7 * len(junk)
    odd = score_quality(odd_docs(spark), labels.where("false"))
    got = Counter((r["doc_id"], r["score"], r["kept"]) for r in odd.collect())
    assert got[(1, None, True)] == 2 and got[(2, None, False)] == 1 and sum(got.values()) == 11
    tagged = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (99, 1), (None, 1), (8, None)], "doc_id long, quality int")
    odd = score_quality(odd_docs(spark), tagged).collect()
    assert len(odd) == 11 and all(0 <= r["score"] <= 1 for r in odd)
    assert score_quality(none(spark), labels).count() == 0


def test_licenses_by_header_file_and_nearest_ancestor(spark):
    files = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x.py", "code"),
             (3, "a/b/COPYING", "Released under the MIT License.\nmore words follow"), (4, "a/b/c/y.py", "words. Licensed under CC BY-NC 4.0. words"),
             (5, "a/z", None), (6, "other/x", "the license of this is not known to the public"), (7, None, ""),
             (8, "//a//b/c/x.py", "code"), (8, "//a//b/c/x.py", "code")]
    out = scan_licenses(spark.createDataFrame([(*f, "clash") for f in files], "file_id long, path string, text string, own string"))
    got = {r["file_id"]: (r["license"], r["how"], r["from_dir"]) for r in out.collect()}
    assert out.count() == 9
    assert got == {1: ("Apache-2.0", "own", None), 2: ("MIT", "inherited", "a/b"), 3: ("MIT", "own", None),
                   4: ("CC-BY-NC-4.0", "own", None), 5: ("Apache-2.0", "inherited", "a"), 6: (None, None, None),
                   7: (None, None, None), 8: ("MIT", "inherited", "a/b")}
    assert scan_licenses(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_licence_texts_and_wrapped_headers(spark):
    full = license_texts()
    files, want = [], {}
    for name, kinds in full.items():
        for j, text in enumerate(kinds):
            body = text.replace("Copyright (c)", "Copyright (c) 2021 Some Person") + "\n"
            code = "\n\n".join(f"int value{i} = other{i} + {i};" for i in range(40))
            at = len(files)
            files += [(at, f"{name}{j}/COPYING", body), (at + 1, f"{name}{j}/a/x.c", "code"),
                      (at + 2, f"src/{name}{j}.c", "\n".join(f" * {x}" for x in body.split("\n")) + f"\n\n{code}")]
            want |= {at: (name, "own"), at + 1: (name, "inherited"), at + 2: (name, "own")}
    wrapped = {"GPL-2.0": "# Licensed under the GNU General Public License,\n# version 2\nx = 1",
               "GPL-3.0": "# Licensed under the GNU General\n# Public License,\n# version 3\nx = 1"}
    for name, text in wrapped.items():
        want[len(files)] = (name, "own")
        files.append((len(files), f"w/{name}.py", text))
    prose = "The terms of the work and of the use of this are not for any person or the parties to say. " * 40
    want[len(files)] = (None, None)
    files.append((len(files), "w/prose.txt", prose))
    out = scan_licenses(spark.createDataFrame(files, "file_id long, path string, text string")).collect()
    got = {r["file_id"]: (r["license"], r["how"]) for r in out}
    assert {files[i][1]: got[i] for i in want} == {files[i][1]: want[i] for i in want}


def test_spans_remove_later_passages_only(spark):
    passage = " ".join(f"w{i}" for i in range(30)) + ". " + " ".join(f"v{i}" for i in range(30)) + "."
    rows = [(1, f"Clean start.\n{passage}\nOwn end here."), (2, f"Other start.\n{passage.upper()}\nAnother end."),
            (3, f"{passage} Middle words. {passage}"), (4, "Short. Short. Short."), (5, None), (None, passage), (6, "Short. Short. Short.")]
    docs = spark.createDataFrame([(i, t, 0, "m") for i, t in rows], "doc_id long, text string, hash long, marks string")
    got = {r["doc_id"]: r for r in span_dedup(docs).collect()}
    assert got[1]["clean_text"] == rows[0][1] and got[2]["removed"] == [1, 2]
    assert got[2]["clean_text"] == "Other start.\nAnother end."
    assert got[3]["removed"] == [0, 1, 3, 4] and got[3]["clean_text"] == "Middle words. "
    assert got[4]["n_removed"] == got[6]["n_removed"] == 0 and got[5]["clean_text"] == "" and got[None]["n_removed"] == 0
    out = span_dedup(odd_docs(spark)).collect()
    assert len(out) == 11
    assert [r["clean_text"] for r in out if r["doc_id"] == 6] == [""]  # a copy of 5
    assert span_dedup(none(spark)).count() == 0


def _sentences(text):
    """(text of the sentence, its words) one character at a time."""
    tokens, word, line, shut = [], "", False, False
    for at, c in enumerate(text):
        if c in " \t\n\v\f\r":
            if word:
                tokens.append((at - len(word), word, line))
                word, line = "", False
            line |= c == "\n"
            continue
        inner = re.search(f"[{sd.INNER}][{re.escape(sd.CLOSERS + sd.INNER)}]*$", word)
        if inner and c not in sd.CLOSERS + sd.INNER:
            tokens.append((at - len(word), word, line))
            word, line = "", False
        word += c
    if word:
        tokens.append((len(text) - len(word), word, line))
    out = []
    for at, word, line in tokens:
        if not out or line or shut:
            out.append([at, []])
        out[-1][1].append("".join(c.lower() if c.isascii() else c for c in word))
        shut = re.search(f"[{re.escape(sd.ENDS)}][{re.escape(sd.CLOSERS + sd.ENDS)}]*$", word)
    return out


def _weigh(word):
    return max(1, sum(any(a <= ord(c) <= z for a, z in sd.UNSPACED) for c in word) // 2)


def _all_runs(rows):
    """Removed sentences of each row when every run of whatever length is looked up."""
    cut, seen, where = {i: set() for i, _ in rows}, {}, {}
    for i, text in sorted(rows):
        own = where[i] = [x[1] for x in _sentences(text)]
        for a in range(len(own)):
            for z in range(a + 1, len(own) + 1):
                flat = [w for x in own[a:z] for w in x]
                heavy = sum(map(_weigh, flat))
                if heavy >= sd.MIN_WORDS and z - a > 1 or z - a == 1 and heavy >= sd.LONG:
                    if seen.setdefault(tuple(flat), (i, a)) != (i, a):
                        cut[i].update(range(a, z))
    return {i: sorted(x) for i, x in cut.items()}


def test_spans_equal_looking_up_every_run(spark):
    rng = np.random.default_rng(5)
    stops = [".", "!", "?", '."', "?)", "\n", ".\n", " ", "\u3002", "\u3002\u300d", "\u0964 ", "\uff01"]
    pool = ["".join(f"{'x' * int(rng.integers(1, 4))}{rng.integers(9)} " for _ in range(rng.integers(1, 6))).rstrip() for _ in range(3)]
    pool += ["\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", "\u3053\u308c\u306f\u957f\u3044\u6587\u3067\u3059\u3088\u306d\u3047\u672c\u5f53\u306b\u305d\u3046\u3067\u3059", "\u300c\u306f\u3044", "a" + " b" * 26]
    rows = [(i, "".join(pool[rng.integers(len(pool))] + stops[rng.integers(len(stops))] + " " * int(rng.integers(2))
                        for _ in range(rng.integers(1, 25)))) for i in range(150)]
    got = {r["doc_id"]: r["removed"] for r in span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _all_runs(rows)
    assert got == want and sum(map(len, want.values())) > 100


def test_spans_of_short_sentences_other_scripts_and_quotes(spark):
    four = "One two three. Four five six. Seven eight nine. Ten eleven twelve."
    two = "The quick brown fox jumps over it. \u201cWhy would it do that at all?\u201d"
    zh = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u3002\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u3002\u665a\u4e0a\u56de\u5bb6\u5403\u996d\u3002\u7136\u540e\u770b\u4e66\u5b66\u4e60\u5230\u5f88\u665a\u3002"
    rows = [(1, f"Begin. {four} Own one."), (2, f"Other begin. {four} Own two."), (3, f"A. {two} B."), (4, f"C. {two} D."),
            (5, f"\u7532\u3002{zh}\u4e59"), (6, f"\u4e19\u3002{zh}\u4e01"), (7, "Tail?) Yes. No."), (8, "Tail?) Yes. No.")]
    got = {r["doc_id"]: r["clean_text"] for r in span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "Other begin. Own two." and got[4] == "C. D." and got[6] == "\u4e19\u3002\u4e01"
    assert all(got[i] == dict(rows)[i] for i in (1, 3, 5, 7, 8))


def _katz(rows, order):
    toks = [((t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c = Counter(w for ts, held in toks if not held for w in ts)
    n, v = sum(c.values()), len(c)
    uni = Unigrams(n, Counter(c.values()))
    after, d = [None, None], [None, None]  # by level: history -> next word -> count
    for k in range(2, order + 1):
        seen = defaultdict(Counter)
        for ts, held in toks:
            pad = ["<s>"] * (k - 1) + ts
            for i, w in enumerate(ts):
                if not held:
                    seen[tuple(pad[i : i + k - 1])][w] += 1
        after.append(seen)
        d.append(discounts(Counter(x for f in seen.values() for x in f.values())))
    kept = lambda x, k: (d[k][x] if x <= 5 else 1) * x
    z, back = {}, {}

    def p(h, w):
        k = len(h) + 1
        if k == 1:
            return float(uni(np.array([c[w]]))[0])
        f = after[k].get(h)
        if f is None:
            return p(h[1:], w)
        if h not in z:
            ch, mine = sum(f.values()), sum(kept(x, k) for x in f.values())
            z[h] = ch if ch - mine > 1e-9 * ch else ch + 1
            back[h] = (z[h] - mine) / z[h] / (1 - sum(p(h[1:], x) for x in f))
        return kept(f[w], k) / z[h] if w in f else back[h] * p(h[1:], w)

    for h in [h for k in range(2, order + 1) for h in list(after[k])[:20]]:  # every history sums to one
        assert abs(sum(p(h, w) for w in c) + p(h, "never seen") - 1) < 1e-9
    out = []
    for (i, _), (ts, held) in zip(rows, toks):
        pad = ["<s>"] * (order - 1) + ts
        out.append((i, held, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts),
                    sum(math.log10(p(tuple(pad[j : j + order - 1]), w)) for j, w in enumerate(ts))))
    return out


def test_katz_equals_brute_force_over_many_blocks_and_parts(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs(spark).select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for order, part, block in ((3, 1 << 20, 1 << 23), (3, 4000, 40_000), (2, 8000, 60_000), (4, 8000, 60_000)):
        want = sorted(_katz(rows, order), key=key)
        got = sorted(map(tuple, katz_scores(docs, part_tokens=part, block_bytes=block, order=order).collect()), key=key)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert katz_scores(none(spark)).count() == 0
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert {(r.train_tokens, r.score) for r in katz_scores(held).collect()} == {(0, 0.0)}


def test_katz_writes_little_and_keeps_no_shuffles(spark):
    base = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    dirs = [Path(str(d)) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in draw.zipf(1.3, 400) % 30_000)) for i in range(300)]
    before, tables = shuffles(), set(base.glob("gram-*"))
    scored = katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), part_tokens=1 << 12, block_bytes=1 << 16)
    for _ in range(100):  # files go in the background
        if (left := sum(f.stat().st_size for f in shuffles() - before if f.exists())) < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000, left  # those of the sums over all parts
    wrote = sum(f.stat().st_size for d in set(base.glob("gram-*")) - tables for f in d.glob("*.parquet"))
    assert wrote < 6 * 300 * 401, wrote / 300 / 401
    assert scored.count() == 300


def test_spdx_tags_are_met_word_for_word(spark):
    rows = [(1, "SPDX-License-Identifier: MIT"), (2, "// SPDX-License-Identifier: GPL-2.0-only\nint main;"),
            (3, "/* spdx-license-identifier: Apache-2.0 */\ncode"), (4, "# SPDX-License-Identifier: LGPL-2.1-or-later\n# rest"),
            (5, "SPDX-License-Identifier: FooBar-1.0"), (6, "SPDX-License-Identifier: Apache-2.0 OR MIT"),
            (7, "The SPDX list has a license for each identifier."), (8, "x\nSPDX-License-Identifier: ISC\nSPDX-License-Identifier: MIT"),
            (9, "SPDX-License-Identifier: GPL-2.0+"), (10, None)]
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in rows], "file_id long, path string, text string")
    got = {r["file_id"]: (r["license"], r["unit"]) for r in scan_licenses(files).collect()}
    assert got == {1: ("MIT", 0), 2: ("GPL-2.0", 0), 3: ("Apache-2.0", 0), 4: ("LGPL-2.1", 0), 5: (None, None), 6: (None, None),
                   7: (None, None), 8: ("ISC", 1), 9: ("GPL-2.0", 0), 10: (None, None)}


def test_language_is_learnt_from_rows_with_null_and_repeated_ids(spark):
    words_of = {"en": "the quick house and water is here with other people", "de": "das schnelle haus und wasser ist hier mit anderen leuten"}
    rng = np.random.default_rng(3)
    texts_of = [(k, " ".join(rng.permutation(v.split()).tolist())) for _ in range(60) for k, v in words_of.items()]
    for id_ in (None, 4):  # 4 is learnt from
        docs = spark.createDataFrame([(id_, t, k) for k, t in texts_of], "doc_id long, text string, lang string")
        out = crf.predict_language(docs, per_label=20)
        assert {r["lang_pred"] for r in out.collect()} == {"en", "de"}
        rows = crf.sample(docs, "doc_id", "text", "lang", F.lit(True), 20, 8000)
        assert max(Counter(k for _, k in rows).values()) <= 20 and len(rows) > 20
