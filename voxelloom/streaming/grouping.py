"""Arrival-driven grouping of a stream: emit a group when its n-th member arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxelloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fixed_size_groups(key: str, order: str, size: int) -> StatefulProcessor:
    """Processor that holds fewer than `size` waiting members per key, and the count of
    groups so far.  The class is local so that it travels by value to Python processes
    that do not have this package."""

    class FixedSizeGroups(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.waiting = handle.getListState("waiting", "member bigint")
            self.emitted = handle.getValueState("emitted", "n bigint")

        def handleInputRows(self, group, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
            done = self.emitted.get()[0] if self.emitted.exists() else 0
            members = held + sorted(int(v) for pdf in rows for v in pdf[order])
            full = len(members) // size
            rest = members[full * size:]
            self.waiting.clear()
            if rest:
                self.waiting.put([(m,) for m in rest])
            if full:
                self.emitted.update((done + full,))
                groups = [members[i * size:(i + 1) * size] for i in range(full)]
                yield pd.DataFrame({key: group[0], "grp": range(done, done + full), "n": size, "members": groups})

        def close(self) -> None:
            pass

    return FixedSizeGroups()


def fixed_groups(stream: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Streaming frame of complete groups: key, grp, n, members.

    A micro-batch is ordered by `order`; its size is bounded by the source's options
    (maxFilesPerTrigger, maxBytesPerTrigger).
    """
    key_type = stream.schema[key].dataType.simpleString()
    return stream.select(key, order).groupBy(key).transformWithStateInPandas(
        fixed_size_groups(key, order, size), f"{key} {key_type}, grp bigint, n bigint, members array<bigint>", "Append", "None")


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Process what the source holds now, exactly once, and return the written result."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/progress")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
