"""Write-back with keyed state: which ids are stored and how many records a day has live in the stream's state store.

A batch asks the state only for its own ids and days, so its cost doesn't grow with the store; state and output are
committed together by the checkpoint, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfId(StatefulProcessor):
    """Of rows of one bucket of ids: the first of each id that no batch has brought before."""

    def __init__(self, order: list[str], columns: list[str]):
        # frames name columns by place where a name begins with _
        self.order, self.columns, self.names = order, columns, [*columns, "_key", "_bucket"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getMapState("stored", "id string", "batch int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame.set_axis(self.names, axis=1)
            first = frame if first is None else pd.concat([first, frame], ignore_index=True)
            first = first.sort_values(self.order, kind="stable").drop_duplicates("_key")
        if first is None:
            return
        new = first[[not self.stored.containsKey((k,)) for k in first["_key"]]]
        for k in new["_key"]:
            self.stored.updateValue((k,), (1,))
        if len(new):
            yield new[self.columns].reset_index(drop=True)

    def close(self) -> None:
        pass


class DayCap(StatefulProcessor):
    """Of rows of one day: the first in order, until the day has `cap` of them; `_free` ones don't count. From frame to frame only rows
    that may still be taken are held, `cap` at most."""

    def __init__(self, order: list[str], columns: list[str], cap: int):
        self.order, self.columns, self.names, self.cap = order, columns, [*columns, "_free", "_day"], cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.taken.get()
        had = had[0] if had is not None else 0
        best = None
        for frame in rows:
            frame = frame.set_axis(self.names, axis=1)
            free = frame[frame["_free"]]
            if len(free):
                yield free[self.columns].reset_index(drop=True)
            rest = frame[~frame["_free"]]
            best = rest if best is None else pd.concat([best, rest], ignore_index=True)
            best = best.sort_values(self.order, kind="stable").head(max(self.cap - had, 0))
        if best is not None and len(best):
            self.taken.update((had + len(best),))
            yield best[self.columns].reset_index(drop=True)

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """State of several keys and maps needs the RocksDB store; another that is set stays."""
    if spark.conf.get(PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


def first_arrivals(rows: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """A stream's rows, of each id the first (by `order` within a batch) that no earlier batch brought. Ids are dealt over `buckets` state
    keys, so rows of a batch are handled some thousands at once. Null ids are one id."""
    out = T.StructType(rows.schema.fields)
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    return keyed.groupBy("_bucket").transformWithStateInPandas(FirstOfId(order, rows.columns), out, "append", "none")


def capped(rows: DataFrame, order: list[str], cap: int, at: str = "added_at", exempt: str = "seed") -> DataFrame:
    """A stream's rows, the first `cap` of each UTC day over all batches; rows of the exempt origin don't count."""
    out = T.StructType(rows.schema.fields)
    keyed = rows.withColumn("_free", F.coalesce(F.col("origin") == exempt, F.lit(False))).withColumn("_day", F.to_date(at))
    return keyed.groupBy("_day").transformWithStateInPandas(DayCap(order, rows.columns, cap), out, "append", "none")


def write_back(source: DataFrame, store: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], order: list[str], cap: int | None = None, exempt: str = "seed", buckets: int = 64):
    """STR1, STR2: a stream of candidates -> validated, of each id the first over all batches, at most `cap` a day, appended.

    `prepare` maps rows to rows; those it gives a reject_reason are left out. Each batch goes to its own partition
    (batch_id), written with overwrite of that partition, so a batch that is run again after a failure leaves the same
    rows. Returns the running query.
    """
    keyed_state(source.sparkSession)
    rows = prepare(source)
    if "reject_reason" in rows.columns:
        rows = rows.where("reject_reason is null")
    rows = first_arrivals(rows, order, buckets)
    if cap is not None:
        rows = capped(rows, order, cap, exempt=exempt)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(store)

    return rows.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
