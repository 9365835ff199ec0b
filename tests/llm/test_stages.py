"""The pipeline's stages, one by one, against plain versions; cosine hashes against a plain transform."""

import math
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_corpus import jaccard, plain_dedup
from test_text_ops import plain_hits

import corpus_pipeline
from inkframe.llm import media, toxicity

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """Documents with null, empty and very long texts, null and repeated ids, and ties."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    long = "\n".join(f"line {i} of a long text with words {i * 7} {i * 11} in it" for i in range(40_000))
    more = [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, long, "en", "s", len(long)), (None, docs[3][1], "xx", None, 1), (docs[5][0], "another text\nwith two lines", None, "s", 5), docs[7], (9004, "before it " + item + " behind it " + docs[9][1], "en", "s", 3)]
    return docs + more


def frame(spark, rows):
    """With columns that are named like those that the stages make."""
    clash = ["kept", "score", "predicted", "spans", "items", "row", "node", "bits", "prefix", "text_hash", "n_removed", "token_ids", "least"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return df.withColumns({c: F.lit("mine") for c in clash})


def out(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_toxicity_stage(spark, sf_dir, rows):
    df = frame(spark, rows)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {(r.doc_id, r.text): r.score for r in toxicity.score(df, toxicity.fit(df, labels)).select("doc_id", "text", "score").collect()}
    assert out(corpus_pipeline.drop_toxic(spark, df, sf_dir)) == sorted((r for r in rows if scores[r[0], r[1]] < 0.5), key=str)
    assert {9001, 9002, 9003} <= {r[0] for r in out(corpus_pipeline.drop_toxic(spark, df, sf_dir))}


def test_line_stage(spark, sf_dir, rows):
    short = [r for r in rows if r[0] != 9003]
    want = plain_dedup([r[:2] for r in short], 30)
    expected = []
    for i, text, lang, source, n in short:
        _, removed, kept = want[i, text] if text is not None else (0, 0, None)
        if not removed or re.search(r"\S", kept):
            expected.append((i, kept, lang, source, len(kept) if removed else n))
    got = out(corpus_pipeline.drop_repeated_lines(spark, frame(spark, rows), sf_dir))
    assert [r for r in got if r[0] != 9003] == sorted(expected, key=str) and any(x[1] for x in want.values())
    assert [r for r in got if r[0] == 9003] == [r for r in rows if r[0] == 9003]


def test_near_stage(spark, sf_dir, rows):
    texts = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] and r[1].split()}, key=str)
    above = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = len(texts[i][2]), len(texts[j][2])
            if above[i] != above[j] and min(a, b) > 0.6 * max(a, b) and jaccard(texts[i][2], texts[j][2]) >= 0.8:
                lo, hi = sorted((above[i], above[j]))
                above = [lo if x == hi else x for x in above]
    groups = {}
    for k, t in zip(above, texts, strict=True):
        groups.setdefault(k, []).append(t)
    got = out(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf_dir))
    assert set(got) <= set(rows) and sum(1 for r in got if r[0] in (9001, 9002, 9003)) == 3
    kept = [(r[0] is None, r[0] or 0, r[1]) for r in got if r[1] and r[1].split()]
    for members in groups.values():
        here = [k for k in kept if k in members]
        assert len(here) == 1 and here[0][:2] == min(m[:2] for m in members)
    assert len(groups) < len(texts)


def test_benchmark_stage(spark, sf_dir, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    some = [r for r in rows if r[0] != 9003]
    got = {(r[0], r[2], r[3]): r for r in out(corpus_pipeline.drop_benchmark(spark, frame(spark, some), sf_dir))}
    cut = 0
    for i, text, lang, source, n in some:
        hit = plain_hits(text or "", items, 10)[0]
        share = sum(hit) / max(1, len(hit))
        r = got.get((i, lang, source))
        if not any(hit):
            assert r is not None and (r[1], r[4]) == (text, n)
        elif share > 0.8:
            assert r is None
        else:
            cut += 1
            words = re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", r[1].encode().lower())
            assert len(r[1]) == r[4] < len(text) and len(words) >= len(hit) - sum(hit) - sum(a and not b for a, b in zip(hit, hit[1:], strict=False))
    assert cut and got[9004, "en", "s"][1].startswith("before it")


def test_encode_stage(spark, sf_dir, rows):
    import public_tokenizers
    from tiktoken.load import load_tiktoken_bpe

    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = corpus_pipeline.encode(spark, frame(spark, rows), sf_dir).collect()
    ids = sorted((str((r.doc_id, r.lang, r.source)), np.frombuffer(bytes(r.token_ids), "<u4").tolist()) for r in got)
    assert ids == sorted((str((r[0], r[2], r[3])), coder.encode_ordinary(r[1] or "")) for r in rows) and all(r.round_trip and r.n_tokens == len(r.token_ids) // 4 for r in got)


def plain_hash(samples):
    """Means of 32 x 32 cells, the sums of the cosine transform's definition, and bits above the median."""
    h, w = samples.shape
    cells = [[0.0] * 32 for _ in range(32)]
    for y in range(32):
        lo, hi = y * h // 32, (y + 1) * h // 32
        lines = samples[lo:hi] if h >= 32 else samples[lo : lo + 1]
        for x in range(32):
            cells[y][x] = float(np.mean(lines[:, x * (w // 32) : (x + 1) * (w // 32)]))
    low = [sum(cells[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return low, middle, [v > middle for v in low]


def test_cosine_hash():
    rng = np.random.default_rng(6)
    for h in (1, 5, 31, 32, 33, 64, 200):
        samples = rng.integers(0, 256, (h, 64), np.uint8)
        low, middle, bits = plain_hash(samples)
        got = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(samples)), np.uint8)).astype(bool).tolist()
        assert all(a == b or abs(v - middle) < 1e-6 for a, b, v in zip(got, bits, low, strict=True))


def test_media_long_text(spark):
    """A text of 8 MB is stored and read whole."""
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789abcdefé "), 400_000).alias("text"), F.lit(1).alias("media"))
    got = media.media_columns(df).select("n_bytes", (F.substring("payload", 1, 7_600_000) == F.col("text").cast("binary")).alias("same")).first()
    assert got.same and got.n_bytes == 7_600_000
