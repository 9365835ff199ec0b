"""Continuous strips cut into slices, and lifetimes of stored results, as streams and as batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def slices(strips: DataFrame, slice_height: int, overlap: int, book: str = "book") -> DataFrame:
    """(book, slice_no, top) of full slices of each book's images laid end to end, and its leftover height.

    strips has page_no and h. Without solid slices the step is constant, so slices follow from the total height.
    """
    step = slice_height - slice_height * overlap // 100
    total = strips.groupBy(book).agg(F.sum("h").cast("long").alias("height"))
    n = F.when(F.col("height") >= slice_height, F.floor((F.col("height") - slice_height) / step) + 1).otherwise(0)
    made = total.withColumns({"n": n, "left": F.col("height") - n * step})
    return made.select(book, "left", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).alias("slice_no")).withColumn("top", F.col("slice_no") * step)


def stream_slices(strips: DataFrame, slice_height: int, overlap: int, book: str = "book") -> DataFrame:
    """The same for a stream: a book's state is its height so far and how far slices have come."""
    step = slice_height - slice_height * overlap // 100

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        height, top = state.get if state.exists else (0, 0)
        height += sum(int(f["h"].sum()) for f in frames)
        tops = list(range(top, height - slice_height + 1, step))
        if tops:
            top = tops[-1] + step
        state.update((height, top))
        yield pd.DataFrame({book: [key[0]] * len(tops), "top": tops})

    kind = strips.schema[book].dataType.simpleString()
    return strips.groupBy(book).applyInPandasWithState(run, f"{book} {kind}, top long", "height long, top long", "append", GroupStateTimeout.NoTimeout)


def settled_queries(events: DataFrame, gap: str = "800 milliseconds") -> DataFrame:
    """The last event of each burst of a user's events."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n")).select("user_id", "event_id", "n")


def last_page(pages: DataFrame, book: str) -> DataFrame:
    """Each book's page of the greatest page_no."""
    rest = F.struct(*[F.col(c) for c in pages.columns if c != book])
    return pages.groupBy(book).agg(F.max_by(rest, "page_no").alias("_x")).select(book, "_x.*")
