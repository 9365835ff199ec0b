"""Repeated byte strings against a set of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from inkframe.llm import queries, repeats
from inkframe.llm.common import Scratch


def plain(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op9_repeats"](spark, sf_dir).collect()}
    want = dict(zip([d.doc_id for d in docs], plain([d.text for d in docs]), strict=True))
    assert sum(w[1] for w in want.values()) and got == want


@pytest.mark.parametrize("paired", [1, 64])
def test_overlaps(spark, monkeypatch, paired):
    """Runs, matches just under and over the length, matches with both sides cut, and grams with many phrases."""
    monkeypatch.setattr(repeats, "MAX_PAIRED", paired)
    r = random.Random(3)
    rand = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    base = [rand(n) for n in (199, 200, 201, 230, 335, 337, 400, 900)]
    texts = [rand(30) + b + rand(r.randrange(50)) for b in base for _ in range(3)] + [base[7][i : i + 260] + rand(20) for i in range(0, 600, 37)]
    texts += [base[6][:250] + base[7][100:330] + rand(5), "a" * 700, "ab" * 200, "", None, "é" * 150, rand(5000), base[3], base[3]]
    texts += [rand(40) + base[5][40:250] + rand(40) for _ in range(80)]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in repeats.remove_repeats(df, Scratch(spark)).collect())
    assert got == sorted((row[0], *w) for row, w in zip(rows, plain([row[1] for row in rows]), strict=True))
    assert repeats.remove_repeats(df.limit(0), Scratch(spark)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    r = random.Random(4)
    raw = bytes(r.choice(b"abcdef ghi") for _ in range(20_000))
    whole = repeats.Parser(200).of([raw])
    monkeypatch.setattr(repeats, "PIECE", 1500)
    pieces = repeats.Parser(200).of([b"", raw])
    assert [x.tolist() for x in whole[1:]] == [x.tolist() for x in pieces[1:]] and set(pieces[0]) == {1}


def test_every_string_holds_a_trigger(monkeypatch):
    """Also where the least of a string's hashes has no upper bits."""
    mix = repeats._mix
    monkeypatch.setattr(repeats, "_mix", lambda h: np.where(mix(h) % np.uint64(40) == 0, mix(h) & np.uint64(0xFFFFFFFF), mix(h)))
    r = random.Random(6)
    raw = bytes(r.choice(b"abcdef ghi") for _ in range(3000))
    at = repeats.Parser(200).of([raw])[1]
    assert all(((at >= s) & (at <= s + 100)).any() for s in range(len(raw) - 199))


def test_runs_have_few_ranges(spark):
    """A text with a trigger at each byte, and one that repeats a block: a range a cell, not one a byte."""
    texts = ["a" * 50_000, "x" + "a" * 300 + "y", ("0123456789" * 9 + "-") * 400, "b" * 199]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = repeats.covers(df.select(repeats.row_key("doc_id", "text").alias("key"), "text"), 200, Scratch(spark)).selectExpr("max(size(marks)) AS n").first().n
    assert 0 < marks <= 500
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in repeats.remove_repeats(df, Scratch(spark)).collect())
    assert got == [(i, *w) for i, w in enumerate(plain(texts))]
