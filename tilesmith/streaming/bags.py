"""Bags that complete: tiles arrive in any order, and a bag goes on once all its tiles are there.

State is kept by slide, in one value: which tiles were seen, as a bit for each, and whether the bag went on. It is read and
written once a batch and slide, whatever the number of tiles. A slide of a million tiles has a state of 125 kB.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "n_tiles long, seen binary, n_seen long, whole boolean"
OUT = "slide string, n_tiles long, n_seen long, status string"


class BagProcessor(StatefulProcessor):
    """A row (slide, n_tiles, n_seen, status) when a bag is whole, and one each time it has stalled for so many seconds."""

    def __init__(self, stall_seconds: float | None) -> None:
        self.stall = None if stall_seconds is None else int(1000 * stall_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bag = handle, handle.getValueState("bag", STATE)

    def _row(self, key: tuple, n_tiles: int, n_seen: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"slide": [key[0]], "n_tiles": [n_tiles], "n_seen": [n_seen], "status": [status]})

    def _timers(self, at: int | None) -> None:
        for old in [x for page in self.handle.listTimers() for x in (page if isinstance(page, list) else [page])]:
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n_tiles, seen, n_seen, whole = self.bag.get() if self.bag.exists() else (0, b"", 0, False)
        if whole:  # what comes again
            return
        told, tiles = n_tiles, [np.empty(0, np.int64)]
        for part in rows:
            told = max(told, int(part["n_tiles"].max()))
            tiles.append(part["tile"].to_numpy(np.int64))
        tiles = np.concatenate(tiles)
        if len(tiles) and not (0 <= tiles.min() and tiles.max() < told):
            raise ValueError(f"slide {key[0]!r} has {told} tiles, and not number {tiles.max() if tiles.max() >= told else tiles.min()}")
        bits = np.zeros(-(-told // 8), np.uint8)
        bits[: len(seen)] = np.frombuffer(seen, np.uint8)
        np.bitwise_or.at(bits, tiles >> 3, (1 << (tiles & 7)).astype(np.uint8))
        n_seen = int(np.unpackbits(bits).sum())
        whole = n_seen == told
        self.bag.update((told, b"" if whole else bits.tobytes(), n_seen, whole))
        if self.stall is not None:
            self._timers(None if whole else timerValues.getCurrentProcessingTimeInMs() + self.stall)
        if whole:
            yield self._row(key, told, n_seen, "whole")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.bag.exists():
            n_tiles, _, n_seen, whole = self.bag.get()
            if not whole:
                yield self._row(key, n_tiles, n_seen, "stalled")

    def close(self) -> None:
        pass


def completed(tiles: DataFrame, stall_seconds: float | None = None) -> DataFrame:
    """A stream of (slide, n_tiles, n_seen, status) from one of (slide, n_tiles, tile).

    tile: its number, from 0 to n_tiles - 1. status whole comes once a slide, when all were seen, in whatever order and
    however often a tile comes; later tiles of it are passed over. With stall_seconds, a slide without a new tile for
    that time (of the clock, not of events, so that no tile is too late to count) gives a row stalled, and goes on when tiles
    come again. n_tiles may grow until a bag is whole; the largest counts. A tile beyond it stops the stream. Rows without slide, n_tiles or
    tile are passed over, as is a slide of no tiles.
    """
    rows = tiles.select(F.col("slide").cast("string").alias("slide"), F.col("n_tiles").cast("long").alias("n_tiles"), F.col("tile").cast("long").alias("tile")).dropna().where("n_tiles > 0")
    return rows.groupBy("slide").transformWithStateInPandas(BagProcessor(stall_seconds), OUT, "Append", "None" if stall_seconds is None else "ProcessingTime")


@contextmanager
def state_store(spark: SparkSession):
    """The session's store of streaming state is the one that timers need, while a stream is started."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ingest_bags(tiles: DataFrame, table: str, checkpoint: str, stall_seconds: float | None = None) -> DataFrame:
    """Run the stream ``completed`` over what is there, append its rows to a Parquet table, and give that table.

    Run again over the same checkpoint, it goes on where it ended: a bag that was half there is whole when the rest comes, and
    none comes twice. With stall_seconds what is there is one batch, as timers of the clock would keep a run over several going for
    ever; a stream that stays up takes ``completed`` with a trigger of its own.
    """
    spark = tiles.sparkSession
    trigger = {"availableNow": True} if stall_seconds is None else {"once": True}
    with state_store(spark):
        q = completed(tiles, stall_seconds).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        q.awaitTermination()
    return spark.read.schema(OUT).parquet(table)
