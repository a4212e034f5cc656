"""Snapshot, public projection, CSV export, audit counts; appends and versions are in `commits`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(records: DataFrame, path: str) -> None:
    """A folder of gzip JSON lines in place of what is there. Not at once: `commits.write_version` is for tables that are read meanwhile."""
    records.write.mode("overwrite").option("compression", "gzip").json(path)


def public(records: DataFrame) -> DataFrame:
    """SNK3: eight public columns, abstracts up to 400 characters."""
    return records.select("publication_number", "title", F.substring("abstract", 1, 400).alias("abstract"), "jurisdiction", "company_name", "assignees", "ipc", "publication_date")


def export_csv(results: DataFrame, path: str) -> None:
    """SNK4: seven columns, all quoted, quotes doubled, CRLF; the header's first name carries the byte-order
    mark, since Spark writes none. Meant for a page of results: one file."""
    cols = ["publication_number", "title", "jurisdiction", "company_name", "publication_date", "ipc", "url"]
    r = results.select("publication_number", "title", "jurisdiction", "company_name", F.col("publication_date").cast("string").alias("publication_date"), F.array_join("ipc", "; ").alias("ipc"), "url")
    r = r.toDF("﻿" + cols[0], *cols[1:])
    r.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n")


def funnel(records: DataFrame, *by: str) -> DataFrame:
    """SNK5: counts per status and the given columns, from a status column, not from counters."""
    return records.groupBy("status", *by).agg(F.count("*").alias("n"))


def store_stats(records: DataFrame) -> DataFrame:
    """AGG34: totals by type, origin, source and year in one pass of grouping sets; null means not grouped."""
    g = records.groupingSets([[], ["type"], ["origin"], ["source"], ["year"]], "type", "origin", "source", "year").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("levels"))
    return g


def recent(records: DataFrame, k: int = 10) -> DataFrame:
    """AGG35."""
    return records.orderBy(F.desc("added_at"), F.desc("pos")).limit(k)
