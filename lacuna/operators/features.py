"""Document features by a small taxonomy, co-occurrence, lift, and what a case document says.

A taxonomy is a list of (id, label, phrases, acronyms), an argument of the plan; all its terms are looked up in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.operators import lookup
from lacuna.sources.tables import written

#: Different tokens up to which their table of frequencies is broadcast; beyond it, the join shuffles.
FEW_TOKENS = 500_000

Taxonomy = list[tuple[str, str, list[str], list[str]]]


def terms_of(taxonomy: Taxonomy) -> list[lookup.Term]:
    """All terms; phrases whatever their case, acronyms as they are. The key is the feature's place in the taxonomy."""
    return [lookup.Term(n, t, case) for n, (_, _, phrases, acronyms) in enumerate(taxonomy) for ts, case in ((phrases, False), (acronyms, True)) for t in ts]


def features_in(rows: DataFrame, taxonomy: Taxonomy, text: str, *ids: str) -> DataFrame:
    """(ids..., feature_id, tf, n) of every row with matches; all terms are matched in one pass, and overlapping terms count
    each (JN1, SCL4). n is the feature's place in the taxonomy; `ids` name one row each."""
    names = F.array(*[F.lit(i) for i, *_ in taxonomy])
    hits = lookup.found(rows.select(*ids, text), list(ids), text, terms_of(taxonomy))
    return hits.select(*ids, F.get(names, F.col("key")).alias("feature_id"), F.col("n").cast("int").alias("tf"), F.col("key").alias("n"))


def document_features(records: DataFrame, taxonomy: Taxonomy, *keep: str) -> DataFrame:
    """(pos, keep..., feature_id, tf, n), one row per document and feature (JN1b)."""
    return features_in(records.withColumn("_body", F.concat_ws(" ", "title", "abstract")), taxonomy, "_body", "pos", *keep)


def taxonomy_frame(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    return spark.createDataFrame([(n, i, label, p, a) for n, (i, label, p, a) in enumerate(taxonomy)], "n int, feature_id string, label string, phrases array<string>, acronyms array<string>")


def pair_grid(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    ids = [i for i, *_ in taxonomy]
    return spark.createDataFrame([(a, b, i, j) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j], "f1 string, f2 string, n1 int, n2 int")


def pair_counts(records: DataFrame, taxonomy: Taxonomy, *by: str) -> DataFrame:
    """Documents with both features for every unordered pair, zeros kept (JN2). Pairs come from each
    document's own short array; the grid has a row per pair of the taxonomy. With `by`, for each value, the pairs
    that occur."""
    return pairs_among(document_features(records, taxonomy, *by), taxonomy, *by)


def pairs_among(doc_features: DataFrame, taxonomy: Taxonomy, *by: str) -> DataFrame:
    """As pair_counts, from the rows of document_features (pos, by..., n): at most one row per feature and document."""
    own = doc_features.groupBy("pos", *by).agg(F.sort_array(F.collect_set("n")).alias("ns"))
    return counted(own, pair_grid(doc_features.sparkSession, taxonomy), *by)


def counted(own: DataFrame, grid: DataFrame, *by: str) -> DataFrame:
    """Pair counts of (by..., ns: ascending places)."""
    pairs = F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: b > a), lambda b: F.struct(a.alias("n1"), b.alias("n2")))))
    counts = own.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.n1", "p.n2").agg(F.count("*").alias("c"))
    out = counts.join(grid, ["n1", "n2"]) if by else grid.join(counts, ["n1", "n2"], "left")
    return out.select(*by, "f1", "f2", F.coalesce("c", F.lit(0)).alias("documents"), "n1", "n2")


def frequency(features: DataFrame) -> DataFrame:
    """(feature_id, df) (AGG7)."""
    return features.groupBy("feature_id").agg(F.count_distinct("pos").alias("df"))


def group_lift(features: DataFrame, rates: DataFrame, support: int = 3) -> DataFrame:
    """(feature_id, group, support, lift): the group with the highest lift among those with enough support;
    if none has, the group with most documents and no lift (AGG8). features has pos, feature_id, subtech;
    rates has subtech, rate. Ties by the first document."""
    c = features.where("subtech <> 'OTHER'").groupBy("feature_id", "subtech").agg(F.count_distinct("pos").alias("c"), F.min("pos").alias("first"))
    c = c.withColumn("total", F.sum("c").over(Window.partitionBy("feature_id"))).join(F.broadcast(rates), "subtech")
    lift = F.when(F.col("c") >= support, F.col("c") / F.col("total") / F.col("rate"))
    w = Window.partitionBy("feature_id").orderBy(F.col("lift").desc_nulls_last(), F.desc("c"), "first")
    best = c.withColumn("lift", lift).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("feature_id", F.col("subtech").alias("group"), F.col("c").alias("support"), "lift")


def base_rates(records: DataFrame) -> DataFrame:
    """(subtech, n, rate) over all records, OTHER included (AGG6)."""
    g = records.groupBy("subtech").agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def extract(cases: DataFrame, taxonomy: Taxonomy, df: DataFrame, total: DataFrame, lift: DataFrame | None = None, most: int = 8) -> DataFrame:
    """Features of case texts by tf * (ln(N / (1 + df)) + 1), the first `most` as F1, F2, ... (AGG11); ties in
    the taxonomy's order. cases has case_id and text; total one row with n; lift is optional."""
    f = features_in(cases, taxonomy, "text", "case_id")
    f = f.join(df, "feature_id", "left").join(F.broadcast(total.toDF("_all")), F.lit(True))
    f = f.withColumn("score", F.col("tf") * (F.log(F.col("_all") / (1 + F.coalesce("df", F.lit(0)))) + 1))
    w = Window.partitionBy("case_id").orderBy(F.desc(F.round("score", 9)), "n")
    f = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    if lift is not None:
        f = f.join(F.broadcast(lift.select("feature_id", F.col("group").alias("ipc"), "support")), "feature_id", "left")
    else:
        f = f.withColumn("ipc", F.lit(None).cast("string")).withColumn("support", F.lit(0))
    return f.select("case_id", F.concat(F.lit("F"), F.col("rank").cast("string")).alias("id"), "feature_id", "ipc", F.coalesce("support", F.lit(0)).alias("support"), "tf", "score", "rank")


def document_terms(cases: DataFrame, df: DataFrame, total: DataFrame, k: int = 20) -> DataFrame:
    """(case_id, token, weight, rank): a text's k most telling tokens by (1 + ln tf) * ln(N / df), tokens that
    no record holds left out, ties by token (AGG12). Texts are dealt by case once; counting, the join with up to FEW_TOKENS
    tokens and the ranking stay where a case is."""
    df = written(df, "frequencies")
    few = F.broadcast if df.count() <= FEW_TOKENS else (lambda x: x)
    t = cases.select("case_id", "text").repartition("case_id").select("case_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("case_id", "token").agg(F.count("*").alias("tf"))
    t = t.join(few(df), "token").join(F.broadcast(total.toDF("_all")), F.lit(True)).withColumn("weight", (1 + F.log("tf")) * F.log(F.col("_all") / F.col("df")))
    w = Window.partitionBy("case_id").orderBy(F.desc(F.round("weight", 9)), "token")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("case_id", "token", "weight", "rank")


def dominant_group(case_features: DataFrame) -> DataFrame:
    """(case_id, subtech): the most frequent class among a case's features, the first on ties, else OTHER
    (AGG9)."""
    g = case_features.groupBy("case_id", "ipc").agg(F.count("*").alias("c"), F.min("rank").alias("first"))
    best = F.max(F.when(F.col("ipc").isNotNull(), F.struct("c", (-F.col("first")).alias("o"), "ipc")))["ipc"]
    return g.groupBy("case_id").agg(F.coalesce(best, F.lit("OTHER")).alias("subtech"))
