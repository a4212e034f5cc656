"""The record store as an append-only stream, its daily cap, counters, and limiter replays.

`write_back` keeps what it knows of the store in keyed state (`keyed`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.streaming.keyed import write_back as write_back


def cap_per_day(added: DataFrame, stored: DataFrame | None, cap: int, order: list[Column | str], at: str = "added_at", exempt: str = "seed") -> DataFrame:
    """added rows with `over_cap`: those beyond `cap` a UTC day, counting what the store holds of that day;
    rows of the exempt origin don't count (STR2). A day's rows are numbered in two steps, per hour and over
    hours, so a day is not one task's sort."""
    counted = F.col("origin") != exempt
    a = added.withColumn("_day", F.to_date(at)).withColumn("_hour", F.date_trunc("hour", at)).withColumn("_c", counted)
    before = F.sum("n").over(Window.partitionBy("_day").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = a.where("_c").groupBy("_day", "_hour").agg(F.count("*").alias("n")).withColumn("_b", F.coalesce(before, F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("_hour", "_c").orderBy(*order))
    out = a.withColumn("_i", rank).join(F.broadcast(hours.drop("_day")), "_hour", "left")
    if stored is not None:
        s = stored.where(counted).groupBy(F.to_date(at).alias("_day")).agg(F.count("*").alias("_s"))
        out = out.join(F.broadcast(s), "_day", "left")
    else:
        out = out.withColumn("_s", F.lit(0))
    place = F.col("_i") + F.coalesce("_b", F.lit(0)) + F.coalesce("_s", F.lit(0))
    return out.withColumn("over_cap", F.col("_c") & (place > cap)).drop("_day", "_hour", "_c", "_i", "_b", "_s")


def arrivals(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """STR3: records per day and origin, and the latest instant. Late rows count within the watermark."""
    w = stream.withWatermark("added_at", watermark).groupBy(F.window("added_at", "1 day").alias("w"), "origin")
    return w.agg(F.count("*").alias("n"), F.max("added_at").alias("latest")).select(F.col("w.start").alias("day"), "origin", "n", "latest")


def sliding_limit(log: DataFrame, most: int, seconds: int = 600) -> DataFrame:
    """(client, ts, seq, allowed): replay of a sliding-window limit; a request is turned away if `most`
    allowed ones lie in the window before it, strictly newer than its start (STR4). Whether one counts
    depends on those before it, so it is sequential per client: rows come sorted, and from batch to batch only the
    client at hand and at most `most` instants are kept, so a client of any size takes bounded memory. Null
    clients are one."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span, now, ring = pd.Timedelta(seconds=seconds), None, None
        for rows in batches:
            ok = []
            for client, t in zip(rows["client"].astype(object), rows["ts"], strict=True):
                client = None if pd.isna(client) else client
                if ring is None or client != now:
                    now, ring = client, deque()
                while ring and ring[0] <= t - span:
                    ring.popleft()
                ok.append(len(ring) < most)
                if ok[-1]:
                    ring.append(t)
            yield rows.assign(allowed=pd.Series(ok, dtype=bool, index=rows.index))

    kind = log.schema["client"].dataType.simpleString()
    rows = log.select("client", "ts", "seq").repartition("client").sortWithinPartitions("client", "ts", "seq")
    return rows.mapInPandas(replay, f"client {kind}, ts timestamp, seq long, allowed boolean")


def daily_cap(log: DataFrame, most: int) -> DataFrame:
    """log with `allowed`: the first `most` of a UTC day (STR5), numbered per hour and over hours."""
    out = cap_per_day(log.withColumn("origin", F.lit("x")), None, most, [F.col("added_at"), F.col("seq")])
    return out.withColumn("allowed", ~F.col("over_cap")).drop("over_cap", "origin")
