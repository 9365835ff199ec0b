"""Streams that keep state for each key: strips of books, results with a lifetime.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as transformWithState does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.raster import Strip
from ..operators.store import LIFETIME_MS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stitcher(StatefulProcessor):
    """The strip of a book between batches, and pages that came before their turn."""

    def __init__(self, kept_ms: int | None, **options):
        self.kept_ms, self.options = kept_ms, options

    def init(self, handle):
        self.strip = handle.getValueState("strip", "rows binary, slices int, next int")
        self.waiting = handle.getMapState("waiting", "page_no int", "width int, height int, data binary, last boolean")
        self.ended = handle.getValueState("ended", "at int", self.kept_ms) if self.kept_ms else handle.getValueState("ended", "at int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        past = self.ended.exists()
        now = self.strip.get() if self.strip.exists() else (b"", 0, 1)
        strip, turn = Strip(**self.options), now[2]
        strip.start(bytes(now[0]), now[1])
        for r in rows:
            if not past and r.page_no is not None and r.page_no >= turn:
                self.waiting.updateValue((r.page_no,), (r.width, r.height, r.data, bool(r.last)))
        while not past and self.waiting.containsKey((turn,)):
            width, height, data, last = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            for x in strip.finish() if last else strip.append(data, width, height):
                yield Row(book=key[0], slice_no=x[0], solid=x[1], page_blob=x[2])
            turn, past = turn + 1, last
        if past:
            self.strip.clear()
            self.waiting.clear()
            self.ended.update((turn,))
        else:
            self.strip.update((strip.rows.tobytes(), strip.slices, turn))

    def close(self):
        pass


def stream_stitch(
    pages: DataFrame, size: tuple[int, int], overlap: int = 50, contrast: float = 0, gamma: float = 1.0, invert: bool = False, dithering: str = "none", two_bit: bool = False, pad_black: bool = False,
    kept_ms: int | None = None,
) -> DataFrame:
    """(book, slice_no, solid, page_blob) of a stream of pages (book, page_no from 1, width, height, data, last): the slices
    that stitch gives, as soon as they are full, however pages fall into batches.

    Pages that come before their turn wait in state; repeated ones are passed over, and so are those that are no
    rasters. A row with last and a page_no after the book's last page ends the book: the rest of its strip goes out, and
    its state goes but for a mark that keeps later rows out: for kept_ms, or else for ever. With kept_ms the stream
    looks for old marks by the clock, so it has a next batch at any time, and a trigger that ends with the input never ends.
    """
    options = {"size": size, "overlap": overlap, "contrast": contrast, "gamma": gamma, "invert": invert, "dithering": dithering, "two_bit": two_bit, "pad_black": pad_black}
    kind = pages.schema["book"].dataType.simpleString()
    given = pages.select("book", F.col("page_no").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"), "data", F.coalesce("last", F.lit(False)).alias("last"))
    return given.groupBy("book").transformWithState(Stitcher(kept_ms, **options), f"book {kind}, slice_no int, solid boolean, page_blob binary", "append", "processingTime" if kept_ms else "none")


class Lifetimes(StatefulProcessor):
    """The living results of a session as one value, pairs of id and end, and a timer at the first end: the calls to the state store
    are some a batch and session, not some a result."""

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle):
        self.handle = handle
        self.living = handle.getValueState("living", "pairs binary")

    def pairs(self) -> np.ndarray:
        held = self.living.get()
        return np.frombuffer(held[0] if held else b"", np.int64).reshape(-1, 2)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.pairs()
        new = np.concatenate([r[["id", "created_ms"]].to_numpy(np.int64) for r in rows])
        # a result lives once
        new = new[np.sort(np.unique(new[:, 0], return_index=True)[1])]
        new = new[~np.isin(new[:, 0], held[:, 0])] + [0, self.lifetime_ms]
        if len(new):
            first = held[:, 1].min() if len(held) else None
            if first is None or new[:, 1].min() < first:
                if first is not None:
                    self.handle.deleteTimer(int(first))
                self.handle.registerTimer(int(new[:, 1].min()))
            self.living.update((np.concatenate([held, new]).tobytes(),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, now = self.pairs(), timerValues.getCurrentWatermarkInMs()
        over = held[:, 1] <= now
        left, due = held[~over], held[over]
        if len(left):
            self.living.update((left.tobytes(),))
            self.handle.registerTimer(int(left[:, 1].min()))
        else:
            self.living.clear()
        due = due[np.lexsort((due[:, 0], due[:, 1]))]
        ends, starts, counts = np.unique(due[:, 1], return_index=True, return_counts=True)
        if len(ends):
            yield pd.DataFrame({"session_id": [key[0]] * len(ends), "expired_ms": ends, "n": counts.astype(np.int32), "ids": np.split(due[:, 0], starts[1:])})

    def close(self):
        pass


def expired_results(results: DataFrame, lifetime_ms: int = LIFETIME_MS, late: str = "0 seconds") -> DataFrame:
    """(session_id, expired_ms, n, ids) of a stream of stored results (id, session_id, created_at): which results of a session
    end their lifetime at a time, once the stream's clock (its greatest created_at, less what may be late) has passed it.

    A result that is stored again while it lives counts once; state holds living results only. Results whose lifetime
    was over when they came are put out like others; rows later than the clock allows are left out, as are those without
    an id or time.
    """
    timed = results.where(F.col("id").isNotNull() & F.col("created_at").isNotNull()).withWatermark("created_at", late)
    kind = results.schema["session_id"].dataType.simpleString()
    given = timed.select("session_id", F.col("id").cast("long").alias("id"), F.unix_millis("created_at").alias("created_ms"), "created_at")
    return given.groupBy("session_id").transformWithStateInPandas(Lifetimes(lifetime_ms), f"session_id {kind}, expired_ms long, n int, ids array<long>", "append", "eventTime")
