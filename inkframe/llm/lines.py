"""Removal of repeated line runs, with DataFrame functions alone.

Lines that occur once can be in no repeated run and leave at once. For the others, prefix doubling ranks the runs of 1,
2, 4, ... lines that start at each place: pairs of ranks that occur twice are sorted over all partitions and numbered in
that order, so equal numbers are an interval of the suffix array whose suffixes share that many lines. Two such
intervals, one from its start and one to its end, name a run of any length.

A line goes if it is in a run of at least min_words words that also begins earlier (by id, then line). It is enough to
test, for each line, the shortest such run that starts with it and the shortest that ends with it: together these cover
every longer run. They are at most min_words lines long, which bounds the doubling.

A line's words are its runs of anything but white space (tabs, no-break spaces and the like included); in scripts written
without blanks, two ideographs or kana and four letters of Thai, Lao, Khmer or Burmese make a word. Any line counts as one
at least, blank ones too. Null texts stay null; repeated rows (same id and text) are cut alike and don't
count as repeats of each other; null ids come first; an empty table gives no rows; columns named like an output are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, spread_join, without

OUTPUTS = ["n_lines", "n_removed", "kept"]
IDEOGRAPHS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
JOINED = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[^\s\p{{Z}}\x{{85}}{IDEOGRAPHS}{JOINED}]+|[{IDEOGRAPHS}]{{1,2}}|[{JOINED}]{{1,4}}"


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(F.col(text_col)))


def words_in(line: Column) -> Column:
    """How many words a line has; plain lines, with single blanks between words, are counted without the pattern."""
    blanks = F.length(line) - F.length(F.translate(line, " ", ""))
    plain = (F.length(line) == F.octet_length(line)) & ~F.contains(line, F.lit("  ")) & (F.translate(line, "\t\r\x0b\x0c", "") == line) & (F.trim(line) == line)
    return F.when(plain, blanks + 1).otherwise(F.greatest(F.lit(1), F.regexp_count(line, F.lit(WORD))))


def hashed_lines(df: DataFrame) -> DataFrame:
    """(key, id, pos, line, words) of all lines; no shuffle. df has key, id, text."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x, F.length(x)).alias("line"), words_in(x).alias("words")))
    return df.where(F.col("text").isNotNull()).select("key", "id", F.posexplode(lines).alias("pos", "x")).select("key", "id", "pos", "x.line", "x.words")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(key, id, pos, length) of the shortest runs of at least min_words words from each line, and up to each line, that
    hold no other lines than the given ones. lines has key, id, pos, words; running sums of words in the order of lines,
    met by the sums that are to be reached, say where a run ends or begins."""
    of_doc = Window.partitionBy("key").orderBy("pos")
    parted = lines.withColumn("part", F.col("pos") - F.row_number().over(of_doc))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = parted.withColumn("before", before).withColumn("after", F.col("before") + F.col("words"))

    def met(own: Column, wanted: Column, name: str, order: list[Column]) -> DataFrame:
        sides = F.array(F.struct(own.alias("value"), F.lit(True).alias("there")), F.struct(wanted.alias("value"), F.lit(False).alias("there")))
        both = summed.select("key", "id", "part", "pos", F.explode(sides).alias("x")).select("key", "id", "part", "pos", "x.value", "x.there")
        other = F.last(F.when(F.col("there"), F.col("pos")), ignorenulls=True).over(Window.partitionBy("key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn(name, other).where(~F.col("there") & F.col(name).isNotNull())

    # the least sum up to a line's end that is large enough, and the largest sum before a line that is small enough; lines
    # have words, so equal sums don't occur twice on a side
    ends = met(F.col("after"), F.col("before") + min_words, "end", [F.desc("value"), F.desc("there")])
    starts = met(F.col("before"), F.col("after") - min_words, "start", [F.asc("value"), F.desc("there")])
    from_here = ends.select("key", "id", "pos", (F.col("end") - F.col("pos") + 1).alias("length"))
    to_here = starts.select("key", "id", F.col("start").alias("pos"), (F.col("pos") - F.col("start") + 1).alias("length"))
    return from_here.unionByName(to_here).distinct()


def repeated_lines(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, pos, line, words) of lines that occur more than once. df has key, id, text."""
    placed = scratch.cut(hashed_lines(df))
    again = scratch.cut(placed.groupBy("line").agg(F.count("*").alias("times")).where(F.col("times") > 1))
    met = spread_join(placed, again, ["line"])
    # repeated rows have equal keys: one of each stays
    return scratch.cut(met.dropDuplicates(["key", "pos"]).select("key", "id", "pos", "line", "words"))


def doubled_ranks(lines: DataFrame, scratch: Scratch, longest: int) -> list[DataFrame]:
    """(key, pos, rank) for runs of 1, 2, 4, ... up to longest lines that occur more than once, in suffix-array order."""
    now = lines.select("key", "pos", F.col("line").alias("rank"))
    out, step = [now], 1
    while 2 * step <= longest:
        after = now.select("key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = now.join(after, ["key", "pos"])
        twice = pairs.groupBy("rank", "next").agg(F.count("*").alias("times")).where(F.col("times") > 1)
        # ids grow along the sorted partitions, so they keep the order of the runs
        named = scratch.cut(twice.orderBy("rank", "next").select("rank", "next", "times", F.monotonically_increasing_id().alias("name")))
        now = scratch.cut(spread_join(pairs, named, ["rank", "next"]).select("key", "pos", F.col("name").alias("rank")))
        out.append(now)
        step *= 2
    return out


def repeated_runs(df: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(key, pos, length) of shortest long enough runs that also begin earlier. df has key, id, text."""
    mark = len(scratch.made)
    lines = repeated_lines(df, scratch)
    ranks = doubled_ranks(lines, scratch, min_words)
    runs = scratch.cut(shortest_runs(lines, min_words))
    named = None
    for k, rank in enumerate(ranks):
        level = runs.where((F.col("length") >= 1 << k) & (F.col("length") < 2 << k))
        if k == 0:
            both = level.join(rank, ["key", "pos"]).select("key", "id", "pos", "length", "rank", F.col("rank").alias("end_rank"))
        else:
            ends = rank.select("key", F.col("pos").alias("end_pos"), F.col("rank").alias("end_rank"))
            both = level.join(rank, ["key", "pos"]).withColumn("end_pos", F.col("pos") + F.col("length") - (1 << k)).join(ends, ["key", "end_pos"]).select("key", "id", "pos", "length", "rank", "end_rank")
        named = both if named is None else named.unionByName(both)
    named = scratch.cut(named)
    place = F.struct("id", "key", "pos")
    first = scratch.cut(named.groupBy("length", "rank", "end_rank").agg(F.min(place).alias("first"), F.count("*").alias("times")).where(F.col("times") > 1))
    scratch.drop_since(mark, named, first)
    return spread_join(named, first, ["length", "rank", "end_rank"]).where(place != F.col("first")).select("key", "pos", "length")


def dedup_lines(df: DataFrame, scratch: Scratch, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_lines, n_removed and kept, the text without lines of later copies."""
    base = without(df, [*OUTPUTS, "_key", "_gone"])
    docs = base.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = repeated_runs(docs, scratch, min_words).select("key", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("pos"))
    by_row = gone.groupBy(F.col("key").alias("_key")).agg(F.collect_set("pos").alias("_gone"))
    joined = base.withColumn("_key", row_key(id_col, text_col)).join(by_row, "_key", "left")
    lines = F.split(text_col, "\n")
    all_ = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(F.transform(F.array_except(all_, F.col("_gone")), lambda i: F.element_at("_lines", i + 1)), "\n")
    out = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines))
    return out.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept).alias("kept"),
    )
