"""Toxicity scores from a weighted lexicon found by Aho-Corasick in folded text.

Folding lower-cases, maps look-alike letters and digit substitutions to plain letters, drops zero-width marks and turns
other signs into spaces. The lexicon holds word beginnings and whole words whose share of toxic training texts clearly exceeds that of
the others, weighted by log odds; phrases that training shows to be harmless are exceptions, and hits inside them don't
count. The summed weight and the weight per word go through a logistic curve.

Texts without hits (null and empty ones too) get the curve's low end; without labels of both classes the score is the
share of toxic labels, 0 where there are none. Texts of any length are read whole; repeated rows score alike, also under
different or null ids; an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

# Look-alike letters by the plain letter they stand for.
LOOK_ALIKES = {
    "a": "аα@４4ａ",
    "b": "вβ8ｂ",
    "c": "сϲｃ",
    "d": "ԁｄ",
    "e": "еε3єｅ",
    "g": "ɡ9ｇ",
    "h": "һｈ",
    "i": "іι1!ıｉ",
    "j": "јｊ",
    "k": "кκｋ",
    "l": "ӏ|ｌ",
    "m": "мｍ",
    "n": "ոｎ",
    "o": "оο0оｏ",
    "p": "рρｐ",
    "q": "ԛｑ",
    "s": "ѕ5$ｓ",
    "t": "тτ7+ｔ",
    "u": "υսｕ",
    "v": "ѵνｖ",
    "w": "ԝωｗ",
    "x": "хχｘ",
    "y": "уγｙ",
    "z": "2ᴢｚ",
}
ZERO_WIDTH = "­​‌‍⁠﻿"
FOLD = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(x): k for k, v in LOOK_ALIKES.items() for x in v} | {ord(x): None for x in ZERO_WIDTH} | {ord(x): " " for x in " …‘’“”«»–—¿¡"}
OUTPUTS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_weight", T.DoubleType()), T.StructField("toxic_hits", T.LongType())]
#: Terms are word beginnings of so many letters, and whole words that are longer.
SHORTEST, LONGEST = 3, 9


def fold(text: str) -> str:
    """Folded words with single spaces between and around them."""
    return f" {' '.join(text.lower().translate(FOLD).split())} "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    base: float = 0.0

    def scanner(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(f" {term}", (len(term) + 1, w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found if len(found) else None


def hits(scanner, folded: str) -> dict[int, float]:
    """Start of each hit word to its greatest weight, without those inside exception phrases."""
    out: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in scanner.iter(folded) if scanner else ():
        start = end + 1 - n
        if w is None:
            spared.append((start, end))
        elif w > out.get(start, 0.0):
            out[start] = w
    for lo, hi in spared:
        for start in [x for x in out if lo <= x < hi]:
            del out[start]
    return out


def features(weight: float, n_words: int) -> list[float]:
    return [1.0, math.log1p(weight), math.log1p(100 * weight / (n_words + 10))]


def _terms(batches):
    """(term, toxic texts, other texts) of a task's share, each term once a text."""
    counts = (Counter(), Counter())
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(fold(text or "").split())
            begun = {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            counts[y].update(begun | {w for w in words if len(w) > LONGEST})
    yield from _counted(counts)


def _counted(counts):
    keys = list(counts[0].keys() | counts[1].keys())
    for lo in range(0, len(keys), 50_000):
        some = keys[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[1][k] for k in some], pa.int64()), pa.array([counts[0][k] for k in some], pa.int64())], names=["term", "toxic", "other"])


def train_rows(docs: DataFrame, labels: DataFrame, max_rows: int, text_col: str = "text") -> DataFrame:
    """(text, y) of at most max_rows labelled texts of each class, chosen by a hash of doc_id.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out, and those without a doc_id. Of several texts of a doc_id the
    least is taken.
    """
    known = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    return docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, min_texts: int = 4, min_sure: float = 1.2, min_own: int = 2, very_sure: float = 4.0, text_col: str = "text") -> Model:
    """Lexicon, exceptions and curve from a bounded sample of labelled rows (max_rows of each class).

    Terms count by the sure part of their log odds (two standard errors off). A term stays only if it is the surest one
    of at least min_own toxic texts, or very sure and the surest of one: words that merely come along in copies of toxic texts explain none.
    What comes to the driver are the terms of these rows that pass, and two numbers a row: bounded by max_rows.
    """
    rows = train_rows(docs, labels, max_rows, text_col)
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    model = Model(base=n1 / (n0 + n1) if n0 + n1 else 0.0)
    if not n0 or not n1:
        return model
    schema = "term string, toxic long, other long"
    t, c = F.col("toxic") + 0.5, F.col("other") + 0.5
    weight = F.log(t / (n1 + 1)) - F.log(c / (n0 + 1))
    stats = rows.mapInArrow(_terms, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    sure = weight - 2 * F.sqrt(1 / t + 1 / c)
    strong = stats.where(F.col("toxic") >= min_texts).select("term", "toxic", weight.alias("w"), sure.alias("sure")).where(F.col("sure") >= min_sure)
    best_rows = strong.orderBy(F.desc("sure"), "term").collect()
    found, support = {r["term"]: r["w"] for r in best_rows}, {r["term"]: r["sure"] for r in best_rows}
    for term in sorted(found, key=len):
        best = max((model.weights.get(term[:n], 0.0) for n in range(SHORTEST, len(term))), default=0.0)
        if found[term] > best + 0.7:
            model.weights[term] = found[term]
    scanner_of = model
    if not model.weights:
        return model

    def explained(batches):
        scanner, counts = scanner_of.scanner(), (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded = fold(text or "") if y else ""
                terms = {folded[end + 2 - n : end + 1] for end, (n, _) in (scanner.iter(folded) if y else ())}
                if terms:
                    counts[1][max(terms, key=lambda t: (support.get(t, 0), t))] += 1
        yield from _counted(counts)

    own = rows.mapInArrow(explained, schema).groupBy("term").agg(F.sum("toxic").alias("toxic")).collect()
    kept = [r["term"] for r in own if r["toxic"] >= min_own or support[r["term"]] >= very_sure]
    texts = {r["term"]: r["toxic"] for r in best_rows}
    model.weights = {whole: found[whole] for whole in (_whole(t, texts) for t in kept)}

    def phrases(batches):
        scanner, counts = scanner_of.scanner(), (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded, seen = fold(text or ""), set()
                for start in hits(scanner, folded):
                    end = folded.index(" ", start + 1)
                    after, before = folded.find(" ", end + 1), folded.rfind(" ", 0, start)
                    if after > 0:
                        seen.add(folded[start + 1 : after])
                    if before >= 0:
                        seen.add(folded[before + 1 : end])
                counts[y].update(seen)
        yield from _counted(counts)

    spared = rows.mapInArrow(phrases, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where((F.col("other") >= 5) & (F.col("toxic") * n0 * 5 < F.col("other") * n1))
    model.exceptions = sorted(r["term"] for r in spared.select("term").collect())

    def measured(batches):
        scanner = scanner_of.scanner()
        for b in batches:
            folded = [fold(x or "") for x in b.column(0).to_pylist()]
            f = [features(sum(hits(scanner, x).values()), x.count(" ") - 1) for x in folded]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in f], pa.float64()) for i in (1, 2)] + [b.column(1).cast(pa.float64())], names=["a", "b", "y"])

    sample = np.array([tuple(r) for r in rows.mapInArrow(measured, "a double, b double, y double").collect()])
    model.curve = logistic(np.c_[np.ones(len(sample)), sample[:, :2]], sample[:, 2]).tolist()
    return model


def _whole(term: str, texts: dict[str, int]) -> str:
    """The longest continuation of a word beginning that nearly as many toxic texts have."""
    while longer := [t for t in texts if len(t) == len(term) + 1 and t.startswith(term) and texts[t] >= 0.98 * texts[term]]:
        term = longer[0]
    return term


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1), predicted (1 from 0.5), toxic_weight and toxic_hits. The model's size is bounded by fit()."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        scanner = m.scanner()

        def work(texts: list[str]) -> list[list]:
            out = []
            for t in texts:
                folded = fold(t)
                found = hits(scanner, folded)
                weight = sum(found.values())
                z = sum(a * b for a, b in zip(m.curve, features(weight, folded.count(" ") - 1), strict=True))
                s = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if any(m.curve) else m.base
                out.append((s, int(s >= 0.5), weight, len(found)))
            return [list(x) for x in zip(*out, strict=True)]

        return work

    return map_text(df, text_col, OUTPUTS, make)
