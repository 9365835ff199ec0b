"""Periodic runs, fill-in-the-middle and exact top-k search against plain versions."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkframe.llm import middle, periodic, topk
from inkframe.llm.common import Scratch


def plain_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), max_size=6), st.integers(0, 10**6)), min_size=1, max_size=4))
def test_find_runs(docs):
    made = []
    for letters, parts, seed in docs:
        rng = random.Random(seed)
        made.append([b"w%d" % rng.randrange(letters) for p, times in parts for _ in [0]])
        made[-1] = [w for p, times in parts for w in [b"w%d" % rng.randrange(letters) for _ in range(p)] * times]
    assert periodic.find_runs(made, 6, 4) == [plain_runs(w) for w in made]


def test_find_runs_long_periods():
    rng = random.Random(3)
    for q in (16, 17, 31, 32, 33, 63, 64, 65, 100, 129, 500):
        period = [b"%d" % rng.randrange(3) for _ in range(q)]
        for length in (4 * q - 1, 4 * q, 4 * q + 1, 9 * q + q // 2):
            words = [b"x%d" % i for i in range(rng.randrange(40))] + (period * 10)[:length] + [b"y%d" % i for i in range(rng.randrange(40))]
            assert periodic.find_runs([[b"a"], words, []], 6, 4) == [[], plain_runs(words), []]
    fibonacci = [b"a"], [b"b"]
    for _ in range(12):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for words in (fibonacci[1], fibonacci[1] * 5, [b"z"] * 3000, [b"z", b"y"] * 900):
        assert periodic.find_runs([words], 6, 4)[0] == plain_runs(words)


def test_periodic_rows(spark):
    texts = [None, "", " \t\n", "a " * 9, "b a a a\x0ba b a a a b a a a b a a a", "x " * 200_000 + "end", "a " * 9]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(None, "q q q q q q", "mine")], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert len(got) == 8 and got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[0].runs == [] and got[0].collapsed == ""
    for i, t in [*enumerate(texts[:5]), (6, texts[6])]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert [tuple(r) for r in got[i].runs] == runs and got[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert [tuple(r) for r in got[5].runs] == [(0, 200_000, 1)] and got[5].collapsed == "x end"
    assert [tuple(r) for r in got[None].runs] == [(0, 6, 1)]
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    assert periodic.looped([b"a", b"b", b"c", b"d", b"e"], 6) == [b"a", b"b", b"b", b"b", b"b"] and periodic.looped([], 3) == []


def plain_middle(text, form, a, b, unit):
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    a, b = sorted(x % (len(units) + 1) for x in (a, b))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return len(units), out, None if form == "plain" else len(p), None if form == "plain" else len(m)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("ab\n\0\x7f\x80é中\U0001f600 <"), max_size=40), st.sampled_from(["plain", "psm", "spm"]), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=6), st.sampled_from(["line", "char"]))
def test_turned(rows, unit):
    got = middle.turned([t.encode() for t, *_ in rows], [f for _, f, _, _ in rows], [a for *_, a, _ in rows], [b for *_, b in rows], unit)
    assert list(zip(*got, strict=True)) == [plain_middle(*r, unit) for r in rows]


def test_middle_rows(spark):
    texts = [None, "", "\n", "a<P>b\nc", "one\ntwo\n\nthree <S", "é中\n" * 300_000 + "x", "no end", "é<\nM>\n<\n", "a\nb"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(None, "a\nb", "mine"), (8, "a\nb", "mine")], "doc_id long, text string, output string")
    for unit in ("line", "char"):
        for seed in range(3):
            given_ = df.withColumns({f"d{i}": x for i, x in enumerate(middle.draws(F.col("doc_id"), seed))})
            done = middle.fill_in_middle(given_, [F.col(f"d{i}") for i in range(4)], unit, rate=90)
            for r in done.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect():
                text = r.text or ""
                plain = not text or any(s in text for s in middle.SENTINELS) or r.d2 % 100 >= 90
                assert r.form == ("plain" if plain else "spm" if r.d3 % 100 < 50 else "psm") and r.back == text
                assert (r.n_units, r.output, r.prefix_chars, r.middle_chars) == plain_middle(text, r.form, r.d0, r.d1, unit)
    none = F.lit(None).cast("long")
    assert {r.form for r in middle.fill_in_middle(df, [F.lit(1), none, F.lit(2), F.lit(3)]).collect()} == {"plain"}
    assert middle.fill_in_middle(df.limit(0), [F.lit(1)] * 4).collect() == []


def plain_top(rows, asks, k):
    valid = [(i, a, np.floor(256.0 * np.array(v, np.float32).astype(float))) for i, (a, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    exact = [[int(x) for x in v] for _, _, v in valid]
    out = []
    for q, (i, a, _) in enumerate(valid):
        if not asks(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(exact[q], exact[c])), b is None, b) for c, (j, b, _) in enumerate(valid) if j != i)
        out += [(a, r, b, -s) for r, (s, _, b) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        for name, n in (("LEAST", 7), ("MOST", 7), ("LEAF", 3), ("CELLS", 5), ("GROUPS", 4), ("BLOCK", 2)):
            monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 6))
    rows = [(i, (base[i % 8] + 0.05 * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5, -0.25, 0.125, 1.0, 2.0, -3.0]) for i in range(60)]  # copies of one vector
    rows += [(7, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (10, [0.5] * 6), (10, [0.5] * 6), (None, [3.0] * 6), (None, [3.0] * 6)]
    rows += [(300, None), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] * 6), (330, [float("inf")] * 6), (340, [2.0, 2.0]), (350, [])]
    rng.shuffle(order := np.arange(len(rows)))
    rows = [rows[i] for i in order]
    df = spark.createDataFrame([(a, v, "x") for a, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, Scratch(spark), 5).collect()]
    assert sorted(got, key=str) == plain_top(rows, lambda a: a is not None and a % 10 == 0, 5)


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e30, 1.0]), (50, [3e20, -1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, Scratch(spark), 5).collect()]
    big, most = int(np.floor(256.0 * 3e20)), 2**63 - 1
    assert sorted(got) == [(0, 1, 1, most), (0, 2, 50, most), (50, 1, 0, most), (50, 2, 1, most)] and big > most
    assert topk.top_k(df.limit(0), F.lit(True), Scratch(spark)).collect() == []
    assert topk.top_k(df.limit(1), F.lit(True), Scratch(spark)).collect() == []
