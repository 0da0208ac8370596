"""Spelling variants against plain Python; long words, full filters, odd rows."""

import random
import zlib
from collections import Counter

import pytest

from precedent.llm.spelling_variants import Reduced, group_variants
from tests.llm.test_text_operations import none, odd_docs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    letters = {*map(chr, range(0xC0, 0x100)), *map(chr, range(97, 123))}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for i, text in rows:
        for w in "".join(c if c in letters else " " for c in (text or "").translate(low)).split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: (v if n[v] >= 10 * n[w] else None) for w in n if near[w] for v in [min(near[w], key=lambda v: (-n[v], v))]}
    out = set()
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, n[w], len(near[w]), f, n[f] if f else None, root))
    return out


def corpus(rng):
    stems = ["".join(rng.choice("abcdeßéàñ×") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    stems += ["z" * 64, "z" * 65, "z" * 66, "y" * 63 + "b", "xyz" * 500, "xyz" * 499 + "xy", "xyz" * 500 + "é"]

    def word():
        w = rng.choice(stems[: rng.choice([3, 8, len(stems)])])
        if rng.random() < 0.3:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abÀ") + w[k + 1 :]])
        return w.upper() if w.isascii() and rng.random() < 0.1 else w

    return [(i if i % 9 else None, " ".join(word() + rng.choice(["", "1", ".", "日"]) for _ in range(120))) for i in range(60)] + [(5, None), (6, "")] + [
        (100 + i, "chainaxy " * (i < 2) + "chainabxy " + "chainabcxy " * 15) for i in range(30)]


@pytest.mark.parametrize("opts", [{}, {"symbols": 2, "filter_bits": 1 << 15}, {"inline": 8}])
def test_groups_equal_brute_force(spark, opts):
    rows = corpus(random.Random(3))
    got = group_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **opts).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert max(len(w[0]) for w in want) > 1400 and sum(w[3] is not None for w in want) > 20
    assert any(w[5] != w[3] for w in want if w[3])  # a chain of two


def test_neighbourhoods_are_full_and_hold_each_word_once():
    reduced = Reduced(3)
    letters = {int(s): chr(c) for c, s in reversed(list(enumerate(reduced.symbol_of))) if 97 <= c < 123}
    for word in ("a", "aab", "abcabca", "zzzzz"):
        form = [int(reduced.symbol_of[ord(c)]) for c in word]
        want = {tuple(form)}
        for i in range(len(form) + 1):
            want |= {(*form[:i], s, *form[i:]) for s in range(3)}
            if i < len(form):
                want |= {(*form[:i], s, *form[i + 1 :]) for s in range(3)} | ({(*form[:i], *form[i + 1 :])} if len(form) > 1 else set())
        got = [k for _, keys in reduced.neighbours([word]) for k in keys.tolist()]
        keys = {int(reduced.keys(["".join(letters[s] for s in f)])[0]) for f in want}
        assert len(got) == len(set(got)) and keys <= set(got) and len(set(got) - keys) == (len(word) == 1)


def test_odd_rows(spark):
    assert group_variants(none(spark)).count() == 0
    got = {r["word"]: r["n"] for r in group_variants(odd_docs(spark)).collect()}
    assert got == {}
    docs = spark.createDataFrame([(1, "q" * 300_000 + " " + "q" * 300_000), (1, "q" * 299_999 + " " + "q" * 299_999)], "doc_id long, text string")
    out = group_variants(docs).collect()
    assert sorted(r["n"] for r in out) == [2, 2] and all(r["n_near"] == 1 and r["form"] is None for r in out)
