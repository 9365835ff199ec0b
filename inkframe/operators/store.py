"""A result store with a lifetime, as a table that is read, filtered and rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIFETIME = "INTERVAL '4:30' HOUR TO MINUTE"
LIFETIME_MS = 270 * 60_000


def stored(events: DataFrame) -> DataFrame:
    """Events as stored results."""
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), F.col("value"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr(LIFETIME)).alias("expires_at"), F.col("props").alias("data"))


def live(store: DataFrame, now) -> DataFrame:
    return store.where(F.col("expires_at") > now)


def references(store: DataFrame) -> DataFrame:
    """Without the heavy columns, which then aren't read."""
    return store.drop("data")


def without_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids, "id", "left_anti")


def by_id(store: DataFrame, key) -> DataFrame:
    return store.where(F.col("id") == key)


def by_session(store: DataFrame, session) -> DataFrame:
    """A session's results, oldest first."""
    return store.where(F.col("session_id") == session).orderBy("created_at", "id")


def newest_first(store: DataFrame) -> DataFrame:
    return store.orderBy(F.desc("created_at"), "id")


def append(results: DataFrame, path: str) -> None:
    """Adds results to the stored table, a folder a day, so that expiry reads and drops whole days."""
    results.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
