"""Language of every word and text by a linear-chain conditional random field.

Labels are the languages met in training. A word (a run of letters) scores each
label by its affixes (first and last 1-3 bytes), its byte bigrams and trigrams,
and its entry in a lexicon learnt from the training words; neighbouring labels
score by learned transitions. All weights are fitted together by gradient on the
conditional likelihood; forward-backward gives each word its marginals, so a
text may switch language from word to word. A text's language is the label with
the largest mean marginal over its words, and that mean is its score.

Training takes a bounded sample of labelled texts: ``per_label`` for each label,
drawn by hash, those above ``max_chars`` characters last. Of a drawn text above
that it learns from at most so many characters, in pieces drawn by hash over the
whole text. Prediction reads every whole text, slice by
slice: each distinct word of a slice is scored once, and forward-backward runs
over all texts of a slice at the same time.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precedent.llm.common import fold, row_keys
from precedent.llm.tokens import NOT_LETTER, Hasher, Texts, per_doc, texts, words

PER_LABEL = 80
MAX_CHARS = 8000
STEPS = 30
SEGMENT = 256
SLICE = 8 << 20
BITS = 15
UND = "und"
SENTENCE = re.compile(r"[^\n.!?。！？।]*[\n.!?。！？।]+\s*|[^\n.!?。！？।]+")
_U = np.uint64


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # labels x features
    lexicon: np.ndarray  # hashes of known words, ascending
    entries: np.ndarray  # labels x lexicon
    moves: np.ndarray  # label x next label


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of all words: affixes, bigrams, trigrams, hashed to
    BITS bits."""
    size = end - start
    pad = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(_U)
    whose, what = [], []

    def add(word, code, kind):
        h = (code * _U(64) + _U(kind)) * _U(0x9E3779B97F4A7C15)
        whose.append(word)
        what.append((h >> _U(64 - BITS)).astype(np.int64))

    every = np.arange(len(start))
    for n in (1, 2, 3):
        w = every[size >= n]
        head, tail = np.zeros(len(w), _U), np.zeros(len(w), _U)
        for j in range(n):
            head = head * _U(256) + pad[start[w] + j]
            tail = tail * _U(256) + pad[end[w] - n + j]
        add(w, head, 2 * n)
        add(w, tail, 2 * n + 1)
    for n in (2, 3):
        count = np.maximum(size - n + 1, 0)
        w = np.repeat(every, count)
        first = np.cumsum(count) - count
        at = np.arange(len(w)) - first[w] + start[w]
        code = pad[at]
        for j in range(1, n):
            code = code * _U(256) + pad[at + j]
        add(w, code, 8 + n)
    return np.concatenate(whose), np.concatenate(what)


def _sum(word, values, n):
    return np.stack([np.bincount(word, v, n) for v in values])


def emissions(model: Model, buf, start, end, hashes) -> np.ndarray:
    """Scores, labels x words."""
    word, feat = features(buf, start, end)
    out = _sum(word, model.weights[:, feat], len(start))
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        hit = model.lexicon[at] == hashes
        out[:, hit] += model.entries[:, at[hit]]
    return out


def forward_backward(scores: np.ndarray, bound: np.ndarray, moves: np.ndarray):
    """Marginals (labels x words) of chains of words bound[i]:bound[i + 1], and
    what ``expected_moves`` needs. scores: labels x words; underflow is held off
    by scaling every eighth step.

    Chains are cut into segments of SEGMENT words. The product of the move
    matrices over each segment carries messages across segments; inside, all
    segments of all chains go on together. So the number of steps does not grow
    with the longest chain but by one in SEGMENT, and the result is exact."""
    k, size = len(moves), np.diff(bound)
    n_words = int(size.sum())
    step = np.exp(moves - moves.max())
    up = np.exp(scores - scores.max(axis=0)) + 1e-30 if n_words else scores
    parts = -(-size // SEGMENT)
    chain = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = bound[:-1][chain] + nth * SEGMENT
    length = np.minimum(bound[1:][chain] - start, SEGMENT)
    # words by place in their segment, longest segments first: one slice a step
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(SEGMENT + 1), "left")  # segments longer than t
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    edge = np.concatenate([[0], np.cumsum(live)])
    place = edge[np.arange(n_words) - np.repeat(start, length)] + np.repeat(rank, length)
    by_step = np.empty_like(up)
    by_step[:, place] = up
    opens = (nth == 0)[order]
    enter, leave = np.ones((k, len(chain))), np.ones((k, len(chain)))
    if len(nth) and nth.max():
        _across(by_step, step, edge, live, nth, rank, opens, enter, leave)
    alpha, beta = np.empty_like(up), np.empty_like(up)
    a, b = enter[:, order], leave[:, order]
    for t in range(SEGMENT):
        n = live[t]
        if not n:
            break
        a = a[:, :n]
        a = (np.where(opens[:n], a, step.T @ a) if t == 0 else step.T @ a) * by_step[:, edge[t] : edge[t + 1]]
        if t % 8 == 0:
            a /= a.sum(axis=0)
        alpha[:, edge[t] : edge[t + 1]] = a
    for t in range(SEGMENT - 1, -1, -1):
        m = live[t + 1]
        if m:
            b[:, :m] = step @ (b[:, :m] * by_step[:, edge[t + 1] : edge[t + 1] + m])
            if t % 8 == 0:
                b[:, :m] /= b[:, :m].sum(axis=0)
        beta[:, edge[t] : edge[t + 1]] = b[:, : live[t]]
    marginal = alpha * beta
    marginal /= marginal.sum(axis=0)
    return marginal[:, place], (alpha, beta, place, up, step)


def _across(by_step, step, edge, live, nth, rank, opens, enter, leave):
    """Messages into and out of the segments, where a chain has several."""
    k = len(step)
    product = np.empty((k, k, len(nth)))  # to label, from label, segment
    product[:] = np.eye(k)[:, :, None]
    for t in range(SEGMENT):
        n = live[t]
        if not n:
            break
        p = product[:, :, :n]
        q = (step.T @ p.reshape(k, -1)).reshape(p.shape)
        p[:] = (np.where(opens[:n], p, q) if t == 0 else q) * by_step[:, None, edge[t] : edge[t] + n]
        if t % 8 == 7:
            p /= p.max(axis=(0, 1))
    product = product[:, :, rank]
    for j in range(1, int(nth.max()) + 1):
        s = np.flatnonzero(nth == j)
        v = np.einsum("in,jin->jn", enter[:, s - 1], product[:, :, s - 1])
        enter[:, s] = v / v.sum(axis=0)
    for j in range(int(nth.max()), 0, -1):
        s = np.flatnonzero(nth == j)
        v = np.einsum("jin,jn->in", product[:, :, s], leave[:, s])
        leave[:, s - 1] = v / v.sum(axis=0)


def expected_moves(state, inner: np.ndarray) -> np.ndarray:
    """Expected number of moves from label to label over the neighbours that
    ``inner`` marks (word i and i + 1 in one chain)."""
    alpha, beta, place, up, step = state
    x, y = alpha[:, place][:, :-1][:, inner], (beta[:, place] * up)[:, 1:][:, inner]
    z = ((step.T @ x) * y).sum(axis=0)
    return step * (x @ (y / z).T)


def train(rows: list[tuple[str, str]], steps: int = STEPS, rate: float = 0.25, decay: float = 1e-6) -> Model | None:
    """Fit on (text, label); None without any word."""
    labels = sorted({y for _, y in rows})
    hasher, parts = Hasher(), []
    col = pa.array([x for x, _ in rows], pa.large_string())
    y = np.array([labels.index(v) for _, v in rows])
    for t in texts(col, 1 << 40):
        low = t.lower()
        w = words(low, NOT_LETTER)
        parts.append((low, w, hasher.spans(low.buf, w.start, w.end)))
    if not parts or not len(parts[0][2]):
        return None
    low, w, hashes = parts[0]
    lexicon, one, at, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    word, feat = features(low.buf, w.start[one], w.end[one])
    k, u = len(labels), len(lexicon)
    known = times > 1
    gold = y[w.doc()]
    same = np.diff(w.doc()) == 0
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][same], gold[1:][same]), 1)
    truth = np.eye(k)[:, gold]
    params = [np.zeros((k, 1 << BITS)), np.zeros((k, u)), np.zeros((k, k))]
    past = [np.full_like(p, 1e-8) for p in params]
    for _ in range(steps):
        scores = (_sum(word, params[0][:, feat], u) + params[1])[:, at]
        marginal, state = forward_backward(scores, w.bound, params[2])
        moved = expected_moves(state, same)
        g = _sum(at, truth - marginal, u)
        grads = [_sum(feat, g[:, word], 1 << BITS), g * known, seen - moved]
        for p, h, d in zip(params, past, grads):
            d = d / len(gold) - decay * p
            h += d * d
            p += rate * d / np.sqrt(h)
    return Model(labels, params[0], lexicon[known], params[1][:, known], params[2])


def excerpt(text: str, max_chars: int) -> str:
    """Whole sentences or lines of ``text``, drawn by hash, up to ``max_chars``
    characters in all, in their order; pieces above a quarter of that are cut
    at white space, or anywhere where there is none."""
    if len(text) <= max_chars:
        return text
    most = max(1, max_chars // 4)
    pieces = [p for x in SENTENCE.findall(text) for p in _split(x, most)]
    pieces = [(i, p) for i, p in enumerate(pieces) if any(c.isalpha() for c in p)]
    drawn, left = [], max_chars
    for i, p in sorted(pieces, key=lambda x: zlib.crc32(f"{x[0]} {x[1]}".encode())):
        if len(p) <= left:
            drawn.append((i, p))
            left -= len(p)
    return "".join(p for _, p in sorted(drawn))


def _split(x: str, most: int) -> list[str]:
    out, at = [], 0
    while len(x) - at > most:
        end = next((i for i in range(at + most, at, -1) if x[i - 1].isspace()), at + most)
        out.append(x[at:end])
        at = end
    return [*out, x[at:]]


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, learn, per_label: int, max_chars: int) -> list:
    """Up to ``per_label`` (text, label) rows of each label among rows that
    ``learn`` allows, drawn by hash of id and text, texts above ``max_chars`` after the
    others and cut to an excerpt. Rows are drawn by themselves: null and repeated ids
    are rows like all others, and never more than ``per_label`` reach the driver."""
    text = F.col(text_col).cast("string")
    ok = learn & F.col(label_col).isNotNull() & text.rlike(r"\p{L}")
    keyed, row = row_keys(docs)
    mine = keyed.where(ok).select(F.col(row).alias("row"), F.col(label_col).cast("string").alias("label"), text.alias("text"),
                                  F.xxhash64(F.col(id_col).cast("long"), text).alias("draw"))
    order = Window.partitionBy("label").orderBy(F.col("size") > max_chars, "draw", "row")
    drawn = (mine.select("row", "label", "draw", F.length("text").alias("size")).withColumn("r", F.row_number().over(order))
             .where(F.col("r") <= per_label).select("row"))
    cut = F.udf(lambda x: excerpt(x, max_chars), "string")
    got = mine.join(F.broadcast(drawn), "row", "left_semi").select(cut("text").alias("text"), "label").collect()
    return sorted({(r["text"], r["label"]) for r in got})


def _marginals(model: Model, hasher: Hasher, t: Texts):
    """Words of a slice and their marginals; each distinct word scored once."""
    low = t.lower()
    w = words(low, NOT_LETTER)
    hashes = hasher.spans(low.buf, w.start, w.end)
    _, one, at = np.unique(hashes, return_index=True, return_inverse=True)
    scores = emissions(model, low.buf, w.start[one], w.end[one], hashes[one])
    marginal, _ = forward_backward(scores[:, at], w.bound, model.moves)
    return w, marginal


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, label, probability) for the words of one text."""
    (t,) = texts(pa.array([text]))
    w, m = _marginals(model, Hasher(), t)
    raw = t.buf.tobytes()
    best = m.argmax(axis=0)
    return [(raw[a:b].decode(), model.labels[k], float(m[k, i])) for i, (a, b, k) in enumerate(zip(w.start, w.end, best))]


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def _predict(model: Model | None):
    def run(batches):
        hasher = Hasher()
        for b in batches:
            for t in texts(b.column(2), SLICE):
                rows = slice(t.first, t.first + t.n)
                lang, score = [UND] * t.n, np.zeros(t.n)
                n, switches = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
                if model is not None:
                    w, m = _marginals(model, hasher, t)
                    n = np.diff(w.bound)
                    mean = np.stack([per_doc(v, w.bound) for v in m]) / np.maximum(n, 1)
                    best, word = mean.argmax(axis=0), m.argmax(axis=0)
                    score = np.clip(mean[best, np.arange(t.n)], 0, 1)
                    turn = np.concatenate([[False], word[1:] != word[:-1]])[: len(word)]
                    turn[w.bound[:-1][n > 0]] = False
                    switches = np.concatenate([[0], np.cumsum(turn)])
                    switches = switches[w.bound[1:]] - switches[w.bound[:-1]]
                    raw, ascii_words = t.buf.tobytes(), np.concatenate([[0], np.cumsum(~NOT_LETTER[t.buf] & (t.buf < 128))])
                    plain = ascii_words[t.off[1:]] > ascii_words[t.off[:-1]]
                    for d in range(t.n):
                        own = raw[t.off[d] : t.off[d + 1]]
                        if n[d] and (plain[d] or any(c.isalpha() for c in own.decode())):
                            lang[d] = model.labels[best[d]]
                        else:
                            score[d], n[d], switches[d] = 0, 0, 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[rows], b.column(1)[rows], pa.array(lang), pa.array(score), pa.array(n), pa.array(switches)],
                    [c.split()[0] for c in RESULT.split(", ")])

    return run


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                     folds: int = 4, held: int = 2, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, n_words,
    n_switches (neighbouring words of different language).

    Only rows whose crc32(id as text) mod ``folds`` is not ``held``, with a text
    and a label, are learnt from; the label, the id and other columns are no
    input of a prediction. A null text, or one without letters, is ``und`` with
    score 0; so is every text when nothing can be learnt. Repeated rows get the
    same answer. An empty table gives an empty result."""
    out = fold(id_col, folds, held)
    rows = sample(docs, id_col, text_col, label_col, ~out, per_label, max_chars)
    model = train(rows) if rows else None
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_predict(model), RESULT)
