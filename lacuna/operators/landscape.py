"""What a topic looks like: years, regions, classes, applicants, papers against patents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.metrics import growth_pct, half_up
from lacuna.operators.classes import JURISDICTIONS, concentration


def years(hits: DataFrame, last: int, span: int = 10, year: Column | None = None) -> DataFrame:
    """(year, n) for the `span` years up to `last`, zeros kept."""
    y = F.year("publication_date") if year is None else year
    dim = hits.sparkSession.range(last - span + 1, last + 1).select(F.col("id").cast("int").alias("year"))
    n = hits.groupBy(y.cast("int").alias("year")).agg(F.count("*").alias("n"))
    return dim.join(F.broadcast(n), "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def regions(hits: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(jurisdiction, n) for fixed jurisdictions, zeros kept."""
    dim = hits.sparkSession.createDataFrame([(j,) for j in names or JURISDICTIONS], "jurisdiction string")
    n = hits.groupBy("jurisdiction").agg(F.count("*").alias("n"))
    return dim.join(F.broadcast(n), "jurisdiction", "left").select("jurisdiction", F.coalesce("n", F.lit(0)).alias("n"))


def top(hits: DataFrame, key: Column, k: int = 5) -> DataFrame:
    """(name, n): most frequent values, ties by first appearance."""
    g = hits.where(key.isNotNull()).groupBy(key.alias("name")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(k).select("name", "n")


def applicants(hits: DataFrame, name: Column, k: int = 5) -> DataFrame:
    """(name, n, share_pct, hhi): top applicants with their share, and the rounded index of all (AGG5b)."""
    rows = hits.withColumn("_name", name)
    hhi = concentration(rows, [], "_name").select(half_up(F.col("hhi")).alias("hhi"), F.col("total").alias("_t"))
    return top(rows, F.col("_name"), k).join(F.broadcast(hhi), F.lit(True)).select("name", "n", half_up(F.col("n") / F.col("_t") * 100, 1).alias("share_pct"), "hhi")


def summary(patents: DataFrame, population: DataFrame, papers: DataFrame, last: int) -> DataFrame:
    """One row: matched, share of the population, growth of the last five years on the five before, papers
    matched, and papers per patent in the last five years (AGG27, AGG28, AGG30)."""

    def window(y: Column, name: str) -> list[Column]:
        n = lambda a, b, c: F.coalesce(F.sum(F.when(y.between(a, b), 1).otherwise(0)), F.lit(0)).alias(c)
        return [F.count("*").alias(f"{name}_matched"), n(last - 4, last, f"{name}_recent"), n(last - 9, last - 5, f"{name}_prior")]

    row = patents.agg(*window(F.year("publication_date"), "patents")).join(papers.agg(*window(F.col("year"), "papers")), F.lit(True))
    row = row.join(population.agg(F.count("*").alias("population")), F.lit(True))
    return row.select(
        "patents_matched", half_up(F.col("patents_matched") / F.nullif("population", F.lit(0)) * 100, 1).alias("share_pct"),
        growth_pct(F.col("patents_prior"), F.col("patents_recent")).alias("patents_growth_pct"), "papers_matched",
        growth_pct(F.col("papers_prior"), F.col("papers_recent")).alias("papers_growth_pct"),
        F.when(F.col("patents_recent") > 0, half_up(F.col("papers_recent") / F.col("patents_recent"), 2)).alias("papers_per_patent"),
    )


def most_cited(papers: DataFrame, k: int = 5) -> DataFrame:
    """AGG28."""
    return papers.orderBy(F.desc(F.coalesce("cited_by", F.lit(0))), F.col("year").desc_nulls_last(), "pos").limit(k)


def newest(rows: DataFrame, k: int = 5) -> DataFrame:
    """AGG29."""
    return rows.orderBy(F.col("year").desc_nulls_last(), "pos").limit(k)


def trend(records: DataFrame) -> DataFrame:
    """(year, jurisdiction, n, total, cumulative): yearly counts by jurisdiction, all, and running (AGG37)."""
    g = records.where("publication_date is not null").groupBy(F.year("publication_date").alias("year"), "jurisdiction").agg(F.count("*").alias("n"))
    t = g.groupBy("year").agg(F.sum("n").alias("total"))
    t = t.withColumn("cumulative", F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))  # one row per year
    return g.join(F.broadcast(t), "year").select("year", "jurisdiction", "n", "total", "cumulative")


def top_or_other(records: DataFrame, k: int = 7) -> DataFrame:
    """(jurisdiction, applicant, n): the k largest applicants by name, all others as 'other' (AGG38)."""
    best = top(records, F.col("company_name"), k).select(F.col("name").alias("_b"))
    rows = records.join(F.broadcast(best), F.col("company_name") == F.col("_b"), "left")
    return rows.groupBy("jurisdiction", F.coalesce("_b", F.lit("other")).alias("applicant")).agg(F.count("*").alias("n"))


def ranking(records: DataFrame, jurisdictions: list[str], k: int = 10) -> DataFrame:
    """Applicants with their total and a column per jurisdiction (AGG39)."""
    by = [F.sum(F.when(F.col("jurisdiction") == j, 1).otherwise(0)).alias(j) for j in jurisdictions]
    g = records.groupBy(F.col("company_name").alias("applicant")).agg(F.count("*").alias("total"), *by, F.min("pos").alias("_f"))
    return g.orderBy(F.desc("total"), "_f").limit(k).drop("_f")


def cross(records: DataFrame, *keys: str) -> DataFrame:
    """Counts over all combinations of the keys and their totals (AGG41): a cube; null is 'all', and levels
    tells totals from missing values."""
    return records.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("levels"))
