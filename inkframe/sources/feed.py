"""Search feeds as rows, and their links against those that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "title string, link string, size string, pubDate string, seeders int, leechers int, downloads int, infoHash string"


def items(feeds: DataFrame, xml_col: str) -> DataFrame:
    """A row an item of each feed, numbered from 1; counts that are missing are 0, a missing hash gives an empty magnet.
    Feeds that are no XML, empty or null give no rows."""
    body = F.from_xml(F.col(xml_col), f"channel struct<item: array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in ITEM.split(', ')))}>>>", {"mode": "PERMISSIVE"})
    kept = [c for c in feeds.columns if c != xml_col]
    each = feeds.withColumn("_feed", body).select(*kept, F.posexplode("_feed.channel.item").alias("item", "i"))
    counts = [F.coalesce(f"i.{c}", F.lit(0)).alias(c) for c in ("seeders", "leechers", "downloads")]
    magnet = F.when(F.col("i.infoHash").isNull(), "").otherwise(F.concat(F.lit("magnet:?xt=urn:btih:"), F.col("i.infoHash")))
    return each.select(*kept, (F.col("item") + 1).alias("item"), "i.title", "i.link", "i.size", F.col("i.pubDate").alias("date"), *counts, magnet.alias("magnet"))


def unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """The links whose hash isn't among the known ones, whatever the case."""
    return found.withColumn("_hash", F.lower("hash")).join(known.select(F.lower("hash").alias("_hash")).distinct(), "_hash", "left_anti").drop("_hash")


def looked_up(found: DataFrame, active: DataFrame) -> DataFrame:
    """Each link with its active download's state, if it has one."""
    return found.join(active.select(F.lower("hash").alias("hash"), "state"), "hash", "left")
