"""Rotation cursors as carried state (W4, K4): one a policy, provider, kind and store, kept between runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["policy", "provider", "kind", "store_key"]
CURSORS = "policy string, provider string, kind string, store_key string, run int, first int, cursor int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Fixed value: how many buckets a policy, provider and kind has; a store's bucket must not change while its state lives.
BUCKETS = 1024
STORES = "stores array<struct<store_key: string, run: int, cursor: int>>"


class Rotation(StatefulProcessor):
    """A store's cursor moves on by its limit in every run in which it publishes; a gated store keeps its cursor.

    Rows: store_key, run, size (offers fit to publish), limit, gated. The state of a
    bucket holds its stores' last runs and cursors, so that a run that is told again
    moves nothing, and a state is read and written once for many stores.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cursors", STORES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {store: (run, cursor) for store, run, cursor in self.state.get()[0]} if self.state.exists() else {}
        out = []
        for store, run, size, limit, gated in sorted(r for part in rows for r in zip(part["store_key"], part["run"].tolist(), part["size"].tolist(), part["limit"].tolist(), part["gated"])):
            last, cursor = known.get(store, (-1, 0))
            if run <= last:
                continue
            first = cursor % size if size > limit else 0
            cursor = cursor if gated else (first + limit) % size
            known[store] = run, cursor
            out.append((*key[:3], store, run, first, cursor))
        if out:
            self.state.update(([(store, run, cursor) for store, (run, cursor) in known.items()],))
        yield pd.DataFrame(out, columns=[*KEYS, "run", "first", "cursor"])

    def close(self) -> None:
        pass


def rotated(sizes: DataFrame) -> DataFrame:
    """CURSORS of every run, from a stream of KEYS, run, size (above 0), limit, gated: a row a store and run.

    The state store must be RocksDB (ROCKSDB). A task holds one row a run and store of
    a bucket, never a store's offers; the published ring follows from `first` by a join.
    """
    bucket = (F.crc32(F.col("store_key").cast("binary")) % BUCKETS).cast("int")
    return sizes.withColumn("bucket", bucket).groupBy(*KEYS[:3], "bucket").transformWithStateInPandas(statefulProcessor=Rotation(), outputStructType=CURSORS, outputMode="Append", timeMode="None")
