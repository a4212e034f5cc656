"""One population of records under two classification schemes: the corpus by IPC, external patents by CPC.

Both schemes name main groups alike ("H04L 41"). Where they don't agree on a group, records that are classified under both
show it: the crosswalk counts, for each IPC group, the CPC groups of the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import classes
from lacuna.operators.clean import base_number, exclude_known


def cpc_groups(codes: Column) -> Column:
    """Distinct main groups of CPC codes, malformed ones left out; no codes give no groups."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(codes, F.expr("cast(array() as array<string>)")), classes.cpc_group), lambda g: g.isNotNull()))


def external_patents(store: DataFrame, corpus: DataFrame, pad: str = "none") -> DataFrame:
    """Stored patents that the corpus doesn't hold, by base number, with `classified` (some CPC code) and `groups`."""
    out = exclude_known(store.where("type = 'patent'"), corpus, pad)
    return out.withColumn("classified", F.coalesce(F.size("cpc") > 0, F.lit(False))).withColumn("groups", cpc_groups(F.col("cpc")))


def population(corpus: DataFrame, external: DataFrame) -> DataFrame:
    """Corpus records by IPC and classified external ones by CPC as one population, with `origin`, `groups` and
    `primary_group` (of the corpus only, so external records don't choose the top groups) (SET5)."""
    own = classes.grouped(corpus).withColumn("origin", F.lit("corpus"))
    other = external.where("classified").withColumn("origin", F.lit("knowledge_base"))
    return own.unionByName(other, allowMissingColumns=True)


def sizes(corpus: DataFrame, external: DataFrame) -> DataFrame:
    """One row: population, corpus, kb_patents, kb_classified."""
    e = external.agg(F.count("*").alias("kb_patents"), F.count_if("classified").alias("kb_classified"))
    c = corpus.agg(F.count("*").alias("corpus"))
    return c.join(e, F.lit(True)).select((F.col("corpus") + F.col("kb_classified")).alias("population"), "corpus", "kb_patents", "kb_classified")


def crosswalk(corpus: DataFrame, store: DataFrame, pad: str = "none") -> DataFrame:
    """(ipc, cpc, n, records, share): of the records that both hold, by base number, how many of an IPC group have which CPC group.

    `records` are those of the IPC group with some CPC code, each counted once. A record adds its own groups' pairs only."""
    a = classes.grouped(corpus).select(base_number(F.col("publication_number"), pad).alias("base"), F.col("groups").alias("ipc"))
    b = store.where("type = 'patent'").select(base_number(F.col("publication_number"), pad).alias("base"), cpc_groups(F.col("cpc")).alias("cpc")).where(F.size("cpc") > 0)
    both = a.join(b, "base").groupBy("base").agg(F.array_distinct(F.flatten(F.collect_list("ipc"))).alias("ipc"), F.array_distinct(F.flatten(F.collect_list("cpc"))).alias("cpc"))
    each = both.select(F.explode("ipc").alias("ipc"), "cpc")
    records = each.groupBy("ipc").agg(F.count("*").alias("records"))
    pairs = each.select("ipc", F.explode("cpc").alias("cpc")).groupBy("ipc", "cpc").agg(F.count("*").alias("n"))
    return pairs.join(records, "ipc").select("ipc", "cpc", "n", "records", (F.col("n") / F.col("records")).alias("share"))


def reclassified(walk: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """(g, moved_to, records, kept_share, caveat): IPC groups of `least` records or more of which less than `share` have the CPC
    group of the same name; moved_to is the CPC group that most of them have (the first by name on ties), if that is another."""
    same = F.coalesce(F.max(F.when(F.col("ipc") == F.col("cpc"), F.col("share"))), F.lit(0.0)).alias("kept_share")
    # a record may have several groups: what stands beside every group tells nothing of this one
    w = Window.partitionBy("ipc").orderBy(F.desc(F.col("n") / F.col("everywhere")), F.desc("n"), "cpc")
    walk = walk.withColumn("everywhere", F.sum("n").over(Window.partitionBy("cpc")))
    first = walk.where("ipc <> cpc").withColumn("r", F.row_number().over(w)).where("r = 1").select("ipc", F.col("cpc").alias("moved_to"))
    out = walk.groupBy("ipc").agg(same, F.max("records").alias("records")).where((F.col("records") >= least) & (F.col("kept_share") < share))
    note = F.concat(F.lit("reclassified: "), F.col("ipc"), F.lit(" is now "), F.col("moved_to"))
    return out.join(first, "ipc").select(F.col("ipc").alias("g"), "moved_to", "records", "kept_share", note.alias("caveat"))


def with_caveats(pairs: DataFrame, moved: DataFrame) -> DataFrame:
    """Pairs of groups (a, b) with `caveat`: what is known of a, else of b, else null."""
    of = lambda side: moved.select(F.col("g").alias(side), F.col("caveat").alias(f"_{side}"))
    out = pairs.drop("caveat").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.withColumn("caveat", F.coalesce("_a", "_b")).drop("_a", "_b")


def scan(corpus: DataFrame, store: DataFrame, n: int = 12, least: int = 5, share: float = 0.5) -> DataFrame:
    """White space over corpus and external patents: pairs of the corpus's n top groups with counts of both
    origins, sides and expectation over the whole population, and caveats from the crosswalk (AGG24)."""
    people = population(corpus, external_patents(store, corpus))
    top = classes.top_groups(people.where("origin = 'corpus'"), n)
    return with_caveats(classes.white_space(people, top), reclassified(crosswalk(corpus, store), least, share))


def matrix_counts(external: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(row, col, n): external patents with both groups, for every row (g) and column (g), zeros kept; a patent counts once a
    cell, and only with two known groups or more (AGG32)."""
    one = lambda d, name: d.agg(F.collect_set("g").alias(name))
    known = one(rows, "_rows").join(one(cols, "_cols"), F.lit(True))
    own = external.where("classified").join(F.broadcast(known), F.lit(True))
    a, b = F.array_intersect("groups", "_rows"), F.array_intersect("groups", "_cols")
    own = own.select(a.alias("a"), b.alias("b")).where(F.size(F.array_union("a", "b")) >= 2)
    n = own.select(F.explode("a").alias("row"), "b").select("row", F.explode("b").alias("col")).groupBy("row", "col").agg(F.count("*").alias("n"))
    grid = rows.select(F.col("g").alias("row")).join(cols.select(F.col("g").alias("col")), F.lit(True))
    return grid.join(n, ["row", "col"], "left").fillna(0, ["n"])
