"""URL rules behind a blocked Bloom filter.

Listed entries (host, path, verdict), or listed urls in canonical form, set eight bits in one block of a filter. Every
url's candidates (its host and each parent domain, with the path prefixes of the lengths that the list has) probe only
their own block; what passes goes to an exact hash join on (host, path), which removes false positives; the longest entry
wins. All is DataFrame work. A filter of a list within a bound is one broadcast row of arrays, probed in the url's own
row: then only urls with a possible hit are shuffled. A larger filter is a table of blocks that probes are joined with.

Of a host only as many labels and characters are looked at as the list's longest host has, so a url of any length costs
its own length. Null urls and those without :// have an empty host and path, and only entries with an empty host or path could fit
them. Equal entries with two verdicts: allow wins. Repeated rows are judged alike; an empty list leaves the default
verdict everywhere; an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

LANES = 8
#: Rows of a filter or list that may be broadcast: at most some 10 MB.
BROADCAST_ROWS = 100_000
OUTPUTS = ["host", "path", "rule", "verdict"]


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(host: Column, path: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(n_blocks))


def _bit(host: Column, path: Column, lane: int) -> Column:
    """The one bit of a lane's 32 that an entry sets."""
    spread = F.xxhash64(path, F.lit("bits"), host)
    return F.expr("1L") * F.pow(F.lit(2), F.shiftrightunsigned(spread, 5 * lane).bitwiseAND(31)).cast("long")


def build_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """One row for each block that holds an entry: block and its lanes' bits."""
    h, p = F.col("host"), F.col("path")
    marked = listed.select(_block(h, p, n_blocks).alias("block"), *[_bit(h, p, i).alias(f"b{i}") for i in range(LANES)])
    return marked.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(LANES)])


def listed_urls(urls: DataFrame, url_col: str = "url", verdict: str = "block") -> DataFrame:
    """Entries (host, path, verdict) of a list of urls in canonical form: host in lower case without a user, a trailing dot
    or the scheme's own port, an empty path as /, no query and no fragment. What isn't a url is left out."""
    u = F.col(url_col)
    scheme = F.lower(F.regexp_extract(u, r"(?s)^(.*?)://", 1))
    host = F.regexp_replace(host_of(u), r"^.*@", "")
    own = F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?$", "")).otherwise(host)
    path = path_of(u)
    entries = urls.select(F.regexp_replace(own, r"\.$", "").alias("host"), F.when(path == "", "/").otherwise(path).alias("path"), F.lit(verdict).alias("verdict"))
    return entries.where(F.contains(u, F.lit("://")) & (F.col("host") != "")).distinct()


def packed_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as one row: an array of all blocks for each lane."""
    blocks = listed.sparkSession.range(n_blocks).select(F.col("id").alias("block")).join(build_filter(listed, n_blocks), "block", "left")
    lanes = [F.coalesce(f"w{i}", F.lit(0)).alias(f"w{i}") for i in range(LANES)]
    rows = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct("block", *lanes))).alias("blocks"))
    return rows.select(*[F.col(f"blocks.w{i}").alias(f"_w{i}") for i in range(LANES)])


def candidates(host: Column, path: Column, lengths: list[int], most_labels: int, most_chars: int) -> Column:
    """What could be listed for a url: (rule_host, rule_path) of its host and parents with the prefixes of those lengths.

    Listed hosts have at most so many labels and characters, so only that much of a host's end is cut into labels; longer
    parents can't be listed.
    """
    labels = F.split(F.substring(host, -(most_chars + 1), most_chars + 1), r"\.")
    # where the host's end isn't all of it, its first label isn't whole
    whole = F.length(host) <= most_chars + 1
    n = F.size(labels)
    first = F.greatest(F.when(whole, 1).otherwise(2), n - F.lit(most_labels - 1))
    parents = F.when(first <= n, F.transform(F.sequence(first, F.greatest(first, n)), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda k: k <= F.length(path))
    return F.flatten(F.transform(parents, lambda h: F.transform(fits, lambda k: F.struct(h.alias("rule_host"), F.substring(path, F.lit(1), k).alias("rule_path")))))


def judge(df: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow", entries_per_block: int = 16) -> DataFrame:
    """Adds host, path, rule (the longest listed entry that fits, host before path; else null) and verdict."""
    listed = listed.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.min("verdict").alias("listed_verdict"))
    n = listed.count()
    parted = without(df, [x for x in OUTPUTS if x != url_col] + ["_could"]).withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    kept = [F.col(f"`{c}`") for c in parted.columns if c not in ("host", "path")]
    if not n:
        return parted.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_blocks = max(1, -(-n // entries_per_block))
    # at most as many as a path has characters
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())
    labels, chars = listed.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("host"))).first()
    could = candidates(F.col("host"), F.col("path"), lengths, labels, chars)
    exact = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "listed_verdict")
    rh, rp = F.col("rule_host"), F.col("rule_path")

    def longest(passed: DataFrame) -> DataFrame:
        ranked = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_host", "rule_path", "listed_verdict")).alias("best")
        return passed.groupBy("host", "path").agg(ranked)

    if n <= BROADCAST_ROWS:
        held = parted.join(F.broadcast(packed_filter(listed, n_blocks)))
        lane = lambda x, i: F.element_at(f"_w{i}", (_block(x["rule_host"], x["rule_path"], n_blocks) + 1).cast("int")).bitwiseAND(_bit(x["rule_host"], x["rule_path"], i)) != 0
        passes = lambda x: reduce(lambda a, i: a & lane(x, i), range(1, LANES), lane(x, 0))
        marked = held.withColumn("_could", F.filter(could, passes)).drop(*[f"_w{i}" for i in range(LANES)])
        some = marked.where(F.size("_could") > 0)
        probes = some.select("host", "path", "_could").dropDuplicates(["host", "path"]).select("host", "path", F.explode("_could").alias("c")).select("host", "path", "c.*")
        best = longest(probes.join(F.broadcast(exact), ["rule_host", "rule_path"]))
        judged = some.drop("_could").join(best, ["host", "path"], "left")
        others = marked.where(F.size("_could") == 0).drop("_could")
        out = judged.unionByName(others, allowMissingColumns=True)
    else:
        urls = parted.select("host", "path").distinct()
        probes = urls.select("host", "path", F.explode(could).alias("c")).select("host", "path", "c.*").withColumn("block", _block(rh, rp, n_blocks))
        passed = probes.join(build_filter(listed, n_blocks), "block")
        for i in range(LANES):
            passed = passed.where(F.col(f"w{i}").bitwiseAND(_bit(rh, rp, i)) != 0)
        best = longest(passed.join(exact, ["rule_host", "rule_path"]))
        # urls without a host and path have nothing to be joined by
        empty = (F.col("host") == "") & (F.col("path") == "")
        fits_empty = not listed.where("host = '' and path = ''").isEmpty()
        some = parted if fits_empty else parted.where(~empty)
        out = some.join(best, ["host", "path"], "left")
        out = out if fits_empty else out.unionByName(parted.where(empty), allowMissingColumns=True)
    return out.select(*kept, "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.listed_verdict", F.lit(default)).alias("verdict"))
