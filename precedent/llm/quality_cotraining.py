"""Quality classifier by co-training two views of a document.

The text view sees what the text is made of (character classes, word and line
shapes, repetition); the metadata view sees what is known about it (source,
language, declared size). Each view is a logistic regression. In every round
both are fitted to the labelled rows and to the pseudo-labels they were given;
then each view labels the unlabelled documents it is confident about, for the
*other* view to learn from. Last, each view is calibrated on labelled rows that
it has not been fitted to, and the calibrated log-odds are added, less the prior
log-odds that both contain, as is right for views that are independent given
the class. A view that knows nothing then adds nothing.

Features are computed once for all documents and written as a table; fitting
runs distributed over that table (pyspark.ml), pseudo-labels over all unlabelled
documents. Only labelled rows are bounded: ``max_labels`` drawn by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import save
from precedent.llm.tokens import Hasher, Texts, per_doc, texts, words

MAX_LABELS = 200_000
ROUNDS = 2
CONFIDENT = 0.97
THRESHOLD = 0.5
HASHED = 64  # places for source and language each
#: Bytes of text whose features are computed at a time (one longer text alone): their
#: arrays take some sixty times as much.
SLICE = 256 << 10
_U = np.uint64

_CLASSES = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "lower": np.array([97 <= b <= 122 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "high": np.array([b >= 128 for b in range(256)]),
    "space": np.array([b in (9, 11, 12, 13, 32) for b in range(256)]),
    "line": np.array([b == 10 for b in range(256)]),
    "stop": np.array([chr(b) in ".,;:?'\"()" for b in range(256)]),
    "bar": np.array([chr(b) in "|<>{}[]\\" for b in range(256)]),
    "bang": np.array([chr(b) == "!" for b in range(256)]),
    "odd": np.array([chr(b) in "#$%&*+=@^~_`" for b in range(256)]),
}
_ODD_END = _CLASSES["odd"] | _CLASSES["bar"] | _CLASSES["bang"]


def _histograms(t: Texts) -> np.ndarray:
    """How often each byte occurs in each text, counted piece by piece."""
    out = np.zeros((t.n, 256), np.int64)
    for i, (a, b) in enumerate(zip(t.off[:-1].tolist(), t.off[1:].tolist())):
        for lo in range(a, b, SLICE):
            out[i] += np.bincount(t.buf[lo : min(lo + SLICE, b)], minlength=256)
    return out


def text_features(t: Texts, hasher: Hasher) -> np.ndarray:
    """One row of numbers per text; all zero for an empty one."""
    n_bytes = np.diff(t.off).astype(float)
    per_byte = np.maximum(n_bytes, 1)
    out, counts = [], _histograms(t)
    for mask in _CLASSES.values():
        share = counts[:, mask].sum(axis=1) / per_byte
        out += [share, np.sqrt(share)]
    low = t.lower()
    w = words(low)
    n = np.diff(w.bound).astype(float)
    some = np.maximum(n, 1)
    hashes, doc = hasher.spans(low.buf, w.start, w.end), w.doc()
    order = np.lexsort((hashes, doc))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], first, t.n)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    size = w.end - w.start
    out += [
        np.log1p(n) / 10, (n < 5) * 1.0, per_doc(size, w.bound) / some / 10,
        distinct / some, np.log1p(some / np.maximum(distinct, 1)), per_doc(same, w.bound) / some,
        per_doc(_ODD_END[t.buf[w.end - 1]].astype(np.int64), w.bound) / some,
        per_doc((size == 1).astype(np.int64), w.bound) / some, per_doc((size > 20).astype(np.int64), w.bound) / some,
        per_doc(_CLASSES["upper"][t.buf[w.start]].astype(np.int64), w.bound) / some,
        per_doc((_CLASSES["upper"][t.buf[w.start]] & _CLASSES["upper"][t.buf[w.end - 1]] & (size > 1)).astype(np.int64), w.bound) / some,
    ]
    x = np.stack(out, axis=1)
    x[n_bytes == 0] = 0
    return x


def _features(batches):
    hasher = Hasher()
    for b in batches:
        for t in texts(b.column(1), SLICE):
            x = text_features(t, hasher)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            empty = pa.array(np.diff(t.off) == 0)
            rows = [c.slice(t.first, t.n) for c in b.columns]
            yield pa.RecordBatch.from_arrays([rows[0], lists, empty, *rows[2:]], ["doc_id", "x_text", "empty", "source", "lang", "declared", "row"])


def _metadata(source, lang, declared):
    """One-hot places for source and language, and the declared size."""
    def place(c, salt):
        return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(HASHED - 1)) + 1)

    def hot(at):
        return F.transform(F.sequence(F.lit(0), F.lit(HASHED - 1)), lambda i: (i == at).cast("double"))

    odd = declared.isNull() | F.isnan(declared) | (F.abs(declared) == float("inf"))
    size = F.log1p(F.greatest(F.when(odd, 0.0).otherwise(declared), F.lit(0.0))) / 10
    rest = F.array(size, size * size, odd.cast("double"))
    return F.concat(hot(place(source, 1)), hot(place(lang, 2)), rest)


def _fit(rows: DataFrame, x: str):
    """Logistic regression on (x, y, w); None if there is one class only."""
    both = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if both["lo"] is None or both["lo"] == both["hi"]:
        return None
    fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", maxIter=40, regParam=1e-4, tol=1e-5)
    return fit.fit(rows.select(array_to_vector(x).alias("v"), "y", "w"))


def _log_odds(model, x: str):
    """The view's log-odds as a column expression: no model on the workers."""
    if model is None:
        return F.lit(0.0)
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    dot = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return dot + F.lit(float(model.intercept))


def _platt(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Slope and intercept that make log-odds calibrated, by Newton steps with a
    weak pull towards slope 1 (and never below 0)."""
    z, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((y - p) * z).sum() - (a - 1), (y - p).sum() - 0.01 * b])
        h = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", lang_col: str = "lang", declared_col: str = "n_chars",
                  label_col: str = "quality", rounds: int = ROUNDS, confident: float = CONFIDENT,
                  threshold: float = THRESHOLD, max_labels: int = MAX_LABELS, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, text_score, meta_score (calibrated views),
    score (probability of good quality), kept (score >= threshold).

    ``labels``: id, label (1 good, 0 bad; ids met more than once count with
    their largest label, null labels not at all). A null or empty text has
    score 0 and is not kept. Null metadata are a value of their own, and so is a
    declared size that is not finite. Each row is scored by its own text;
    ``row_col`` names a column of row numbers that the result carries as ``row``. Where labels of one class are missing
    nothing can be learnt: scores are null and every row with a text is kept. An
    empty table gives an empty result."""
    meta = _metadata(F.col("source"), F.col("lang"), F.col("declared"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(declared_col).cast("double").alias("declared"),
                      (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))
    rows = save(src.mapInArrow(_features, "doc_id long, x_text array<double>, empty boolean, source string, lang string, "
                                          "declared double, row long"), "quality-features")
    carried = ["row"] if row_col else []
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    known = known.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.join(rows.where("not empty").select("doc_id").distinct(), "doc_id", "left_semi")
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    known = known.withColumn("draw", draw).where(F.col("draw") <= max_labels / max(n, 1))  # bounded sample of labels
    table = save(rows.join(known, "doc_id", "left").where("not empty").withColumn("x_meta", meta)
                 .select("doc_id", "x_text", "x_meta", "y", F.coalesce("draw", F.lit(2.0)).alias("draw")), "quality-views")
    share = max_labels / max(n, 1)
    fitted = (F.col("draw") <= 1) & (F.col("draw") / min(share, 1.0) < 0.7)
    gold = table.where(fitted).select("x_text", "x_meta", "y", F.lit(1.0).alias("w"))
    models = {v: _fit(gold, v) for v in ("x_text", "x_meta")}
    if models["x_text"] is None:  # few labels: one class is in the held-out part alone
        gold = table.where("draw <= 1").select("x_text", "x_meta", "y", F.lit(1.0).alias("w"))
        models = {v: _fit(gold, v) for v in ("x_text", "x_meta")}
    if models["x_text"] is None and models["x_meta"] is None:
        null = F.lit(None).cast("double")
        return rows.select("doc_id", null.alias("text_score"), null.alias("meta_score"), null.alias("score"), (~F.col("empty")).alias("kept"), *carried)
    n_gold = gold.count()
    edge = math.log(confident / (1 - confident))
    pool = table.where("y is null")
    for _ in range(rounds):
        new = {}
        for view, other in (("x_text", "x_meta"), ("x_meta", "x_text")):
            odds = _log_odds(models[other], other)
            given = pool.withColumn("odds", odds).where(F.abs("odds") >= edge).select(
                "x_text", "x_meta", (F.col("odds") > 0).cast("double").alias("y"))
            many = given.count()
            # all confident pseudo-labels together weigh as much as the labels at most
            weight = min(1.0, n_gold / many) if many else 0.0
            new[view] = _fit(gold.unionByName(given.withColumn("w", F.lit(weight))), view) if many else models[view]
        models = new
    odds = {v: _log_odds(models[v], v) for v in models}
    held = table.where((F.col("draw") <= 1) & ~fitted).select(odds["x_text"].alias("t"), odds["x_meta"].alias("m"), "y").collect()
    if len({r["y"] for r in held}) < 2:
        held = table.where("draw <= 1").select(odds["x_text"].alias("t"), odds["x_meta"].alias("m"), "y").collect()
    (at, bt), (am, bm) = _platt([(r["t"], r["y"]) for r in held]), _platt([(r["m"], r["y"]) for r in held])
    mean = sum(r["y"] for r in held) / len(held)
    prior = math.log(mean / (1 - mean))
    t = odds["x_text"] * F.lit(at) + F.lit(bt)
    m = odds["x_meta"] * F.lit(am) + F.lit(bm)
    sig = lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    all_rows = rows.withColumn("x_meta", meta).select("doc_id", "empty", t.alias("t"), m.alias("m"), *carried)
    score = F.when(F.col("empty"), F.lit(0.0)).otherwise(sig(F.col("t") + F.col("m") - F.lit(prior)))
    return all_rows.select("doc_id", sig(F.col("t")).alias("text_score"), sig(F.col("m")).alias("meta_score"),
                           score.alias("score"), (~F.col("empty") & (score >= threshold)).alias("kept"), *carried)
