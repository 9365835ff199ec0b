"""From documents to token ids, in stages that each read what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import bpe, decontaminate, lines, simhash, toxicity
from inkframe.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go. The model learns from the labelled ones that aren't held out.

    Null and empty texts have no hits and stay; long texts are read whole; repeated rows are judged alike, whatever their
    ids; an empty table gives no rows; further columns of docs, whatever their names, are left out.
    """
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents that have nothing else.

    Null texts stay null, empty ones stay; rows with null ids come first; repeated rows (same id and text) are cut alike and
    are no repeats of each other; long texts are cut like others; an empty table gives no rows; further columns are left out.
    """
    done = lines.dedup_lines(docs, Scratch(spark))
    changed = F.col("n_removed") > 0
    kept = done.where(~changed | F.col("kept").rlike(r"\S"))
    return kept.withColumns({"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar five-word shingles (0.8 or more), the one with the least doc_id stays; of several with
    that doc_id, or of rows without one where no row has one, the one with the least hash of its text.

    Links are those of SimHash fingerprints, as in op5, compared shingle by shingle; similar texts whose fingerprints are
    further apart are found by their shingles, so none is lost.
    Of rows with one doc_id (or none) and one text, one stays; rows that share only the doc_id are documents of their own.
    Null and empty texts and those without words are like no other and stay; long texts are compared whole; an empty
    table gives no rows; further columns are left out.
    """
    parts = ["doc_id", "text_hash", "chars"]
    keyed = docs.withColumns({"text_hash": F.xxhash64("text"), "chars": F.length("text")})
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), *parts)
    groups = simhash.similar_groups(keyed.select(row.alias("row"), "text"), Scratch(spark), id_col="row")
    later = groups.where(F.col("row") != F.col("least")).select("row.doc_id", "row.text_hash", "row.chars")
    same = keyed["doc_id"].eqNullSafe(later["doc_id"]) & (keyed["text_hash"] == later["text_hash"]) & (keyed["chars"] == later["chars"])
    return keyed.join(later, same, "left_anti").dropDuplicates(parts).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items go, and documents that are little else.

    Null and empty texts have no words and stay; long texts are streamed whole; repeated rows are cut alike; an empty table
    gives no rows, empty items change nothing; further columns are left out.
    """
    clean = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text's bytes.

    Null and empty texts have no tokens; long texts are encoded whole; repeated rows give equal rows; an empty table gives
    no rows.
    """
    import public_tokenizers

    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", whole.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark), ("bpe", encode)]
#: SQL has no form of toxicity scores, similarity groups and token ids; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents").select(*COLUMNS), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs)
            scratch.drop(before)
    return docs
