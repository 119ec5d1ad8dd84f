"""File-change streams: filters, debounce with keyed state, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import paths

GAP_MS, IDLE_MS = 500, 60_000
# Folders whose changes do not count.
IGNORED = [".git", ".svn", ".vs", "binaries", "build", "deriveddatacache", "intermediate", "node_modules", "saved"]


def watched(events: DataFrame) -> DataFrame:
    return events.where(~paths.in_directories(F.col("path"), IGNORED))


class Debounce(StatefulProcessor):
    """Keeps, per path, the time of the last accepted event; idle state expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long", ttlDurationMs=IDLE_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t in sorted(t for b in rows for t in b["ts"].tolist()):
            if last is None or t - last >= GAP_MS:
                kept.append(t)
                last = t
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"path": [key[0]] * len(kept), "ts": kept})

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame) -> DataFrame:
    """(path, ts) of accepted events of a stream (path, ts in ms). Needs the RocksDB state store provider."""
    return events.groupBy("path").transformWithStateInPandas(statefulProcessor=Debounce(), outputStructType="path string, ts long", outputMode="append", timeMode="ProcessingTime")


def router(on_config: Callable[[DataFrame], None], on_asset: Callable[[DataFrame], None], on_source: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands changed paths on by extension."""

    def route(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_ext", paths.extension(F.col("path"))).persist()
        try:
            for names, handler in ((("ini",), on_config), (("uasset", "umap"), on_asset), (("h", "hpp", "cpp", "cs", "inl"), on_source)):
                handler(rows.where(F.col("_ext").isin(*names)).drop("_ext"))
        finally:
            rows.unpersist()

    return route
