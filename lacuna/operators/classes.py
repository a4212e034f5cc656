"""Classification groups, white space between them, applicants, concentration.

A record frame has pos (input order, the tie-break), ipc (codes in order), jurisdiction, company_name,
assignees, publication_date. Group tables hold `n` rows (12 by default) and are broadcast as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.metrics import half_up

JURISDICTIONS = ["US", "EP", "JP", "TW", "SG", "MY"]
LABELS = {
    # fixed values: curated group labels
    "H04L 12": "Packet Switching & Network Services", "H04L 41": "Network Management", "H04L 29": "Network Protocol Control",
    "H04L 47": "Traffic Control & QoS", "H04W 48": "Network Access Selection", "G06F 15": "Computing Systems",
    "G06F 9": "Virtualization & Scheduling", "H04L 9": "Network Security", "H04W 28": "Wireless Resource Management",
    "H04W 24": "Wireless Monitoring & Testing", "H04W 4": "Wireless Network Services", "H04W 16": "Network Planning & Deployment",
}


def main_group(code: Column) -> Column:
    """Cut at the first bracket, then at the slash (CLN10)."""
    return F.trim(F.split(F.split(code, r"\(")[0], "/")[0])


def fine_group(code: Column) -> Column:
    """Cut at the first bracket only."""
    return F.trim(F.split(code, r"\(")[0])


def cpc_group(code: Column) -> Column:
    """Class and number of a CPC code, null if it isn't one (CLN11)."""
    pattern = r"^([A-H]\d{2}[A-Z])\s*(\d+)"
    return F.when(code.rlike(pattern), F.concat_ws(" ", F.regexp_extract(code, pattern, 1), F.regexp_extract(code, pattern, 2)))


def grouped(records: DataFrame, group=main_group) -> DataFrame:
    """records with `groups` (distinct, in order) and `primary_group` (null without codes)."""
    all_ = F.filter(F.transform("ipc", group), lambda g: g.isNotNull() & (g != ""))
    return records.withColumn("primary_group", F.get(F.transform("ipc", group), F.lit(0))).withColumn("groups", F.array_distinct(all_))


def top_groups(records: DataFrame, n: int = 12) -> DataFrame:
    """(g, n, rank): the n most frequent primary groups, ties by first appearance (AGG1)."""
    counts = records.where("primary_group is not null and primary_group <> ''").groupBy(F.col("primary_group").alias("g")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    top = counts.orderBy(F.desc("n"), "first_pos").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first_pos"))).select("g", "n", "rank")


def subtech(records: DataFrame, top: DataFrame) -> DataFrame:
    """records with `subtech`: the primary group if it is a top one, else OTHER (AGG2)."""
    t = F.broadcast(top.select(F.col("g").alias("_g")))
    return records.join(t, records["primary_group"] == t["_g"], "left").withColumn("subtech", F.coalesce("_g", F.lit("OTHER"))).drop("_g")


def touches(records: DataFrame, top: DataFrame) -> DataFrame:
    """records with `ranks`: the sorted ranks of the top groups that each touches. The top groups travel as
    one broadcast row, so nothing is shuffled."""
    one = top.agg(F.map_from_entries(F.collect_list(F.struct("g", "rank"))).alias("_top"))  # n entries
    rows = records.join(F.broadcast(one), F.lit(True))
    return rows.withColumn("ranks", F.array_sort(F.filter(F.transform("groups", lambda g: F.try_element_at("_top", g)), lambda r: r.isNotNull()))).drop("_top")


def pairs_of(ranks: Column) -> Column:
    """All (i, j), i < j, of a sorted array of at most n ranks."""
    return F.flatten(F.transform(ranks, lambda a: F.transform(F.filter(ranks, lambda b: b > a), lambda b: F.struct(a.alias("ra"), b.alias("rb")))))


def white_space(records: DataFrame, top: DataFrame, reclassified: dict[str, str] | None = None) -> DataFrame:
    """All pairs of top groups, zeros kept: patents in both, from the corpus and from elsewhere (`origin`),
    sizes of both sides, expected = A * B / N, lift = patents / expected, caveat (JN3, AGG24).

    records needs groups and origin ('corpus' or other). N counts all records. Pairs come from each record's
    own short array, so there is no self join; one grouped count on pair keys is the only shuffle."""
    rows = touches(records, top)
    counts = rows.select("origin", F.explode(pairs_of(F.col("ranks"))).alias("p")).groupBy("p.ra", "p.rb").agg(
        F.count("*").alias("patents"), F.sum((F.col("origin") == "corpus").cast("long")).alias("corpus")
    )
    sides = rows.select(F.explode("ranks").alias("rank")).groupBy("rank").agg(F.count("*").alias("side"))
    side = top.join(sides, "rank", "left").select("g", "rank", F.coalesce("side", F.lit(0)).alias("side"))
    total = records.agg(F.count("*").alias("population"))
    a = side.select(F.col("g").alias("a"), F.col("rank").alias("ra"), F.col("side").alias("side_a_patents"))
    b = side.select(F.col("g").alias("b"), F.col("rank").alias("rb"), F.col("side").alias("side_b_patents"))
    grid = a.join(F.broadcast(b), F.col("ra") < F.col("rb")).join(F.broadcast(total), F.lit(True))
    out = grid.join(F.broadcast(counts), ["ra", "rb"], "left").fillna(0, ["patents", "corpus"])
    expected = F.col("side_a_patents") * F.col("side_b_patents") / F.col("population")
    notes = F.create_map(*[F.lit(x) for kv in (reclassified or {"": ""}).items() for x in kv])
    return out.select(
        "a", "b", "patents", "corpus", (F.col("patents") - F.col("corpus")).alias("knowledge_base"), "side_a_patents", "side_b_patents",
        half_up(expected, 1).alias("expected"), F.when(expected > 0, half_up(F.col("patents") / expected, 2)).alias("lift"),
        F.coalesce(F.try_element_at(notes, F.col("a")), F.try_element_at(notes, F.col("b"))).alias("caveat"), "ra", "rb",
    )


def candidates(pairs: DataFrame, limit: int = 8, min_side: int = 150) -> DataFrame:
    """Pairs whose sides are both large, caveats last, least lift first (AGG24b); ties by the groups' ranks."""
    big = pairs.where((F.col("side_a_patents") >= min_side) & (F.col("side_b_patents") >= min_side))
    return big.orderBy(F.col("caveat").isNotNull(), F.coalesce("lift", F.lit(0.0)), "patents", "ra", "rb").limit(limit)


def most_crowded(pairs: DataFrame, limit: int = 3) -> DataFrame:
    return pairs.orderBy(F.desc("patents"), "ra", "rb").limit(limit)


def markdown(pairs: DataFrame) -> DataFrame:
    """Each pair as a row of a markdown table."""
    return pairs.select(F.format_string("| %s × %s | %d | %s | %s | %d / %d |", "a", "b", "patents", F.col("expected").cast("string"), F.coalesce(F.col("lift").cast("string"), F.lit("–")), "side_a_patents", "side_b_patents").alias("line"))


def applicant(prefer: str = "assignee") -> Column:
    """First of assignees[0] and company_name that isn't empty, or the other way round (CLN13)."""
    a, c = F.nullif(F.get("assignees", F.lit(0)), F.lit("")), F.nullif(F.col("company_name"), F.lit(""))
    return F.coalesce(a, c, F.lit("unknown")) if prefer == "assignee" else F.coalesce(c, a, F.lit("unknown"))


#: Legal forms that an applicant's key leaves out.
LEGAL_FORMS = "co|company|corp|corporation|inc|incorporated|ltd|limited|llc|lp|plc|gmbh|ag|sa|ab|publ|oy|kk|bv|nv"


def applicant_key(name: Column) -> Column:
    """Lower case, no brackets, no legal forms (CLN12)."""
    c = F.regexp_replace(F.lower(name), r"\(.*?\)", " ")
    c = F.regexp_replace(c, r"(?<![a-z0-9_])(l\.l\.c|l\.p|s\.a)\.", " ")
    c = F.regexp_replace(c, "[.,]", " ")
    c = F.regexp_replace(c, rf"(?<![a-z0-9_])({LEGAL_FORMS})(?![a-z0-9_])", " ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9&぀-鿿]+", " "))


def top_applicants(docs: DataFrame, n: int = 5, by: list[str] | None = None) -> DataFrame:
    """(by..., key, name, patents, rank): applicants by key, shown by their shortest spelling, first on ties
    (AGG26). docs has applicant and pos."""
    by = by or []
    docs = docs.where("applicant is not null and applicant <> ''").withColumn("key", F.coalesce(F.nullif(applicant_key(F.col("applicant")), F.lit("")), F.col("applicant")))
    g = docs.groupBy(*by, "key").agg(F.count("*").alias("patents"), F.min(F.struct(F.length("applicant").alias("l"), F.col("pos").alias("p"), F.col("applicant").alias("name")))["name"].alias("name"), F.min("pos").alias("_first"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("patents"), "_first")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*by, "key", "name", "patents", "rank")


def both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Applicants in the top 40 of a and the top 8 of b, the first 5 by a (JN8)."""
    left = top_applicants(a, 40).select("key", "name", F.col("patents").alias("side_a"), "rank")
    right = top_applicants(b, 8).select("key", F.col("patents").alias("side_b"))
    return left.join(F.broadcast(right), "key").orderBy("rank").limit(5).select("name", "side_a", "side_b")


def pair_detail(records: DataFrame, a: str, b: str, as_of: int) -> DataFrame:
    """One row: the newest combined records, the newest of each side if none is combined, and the trend of
    the last five complete years against the five before (AGG25)."""
    rows = records.where(F.array_contains("groups", a) | F.array_contains("groups", b)).withColumn("year", F.year("publication_date"))
    rows = rows.withColumn("_s", F.when(F.array_contains("groups", a) & F.array_contains("groups", b), "both").when(F.array_contains("groups", a), "a").otherwise("b"))
    w = Window.partitionBy("_s").orderBy(F.desc(F.coalesce("year", F.lit(0))), "pos")
    newest = rows.select("_s", "pos", "year", "publication_number").withColumn("_r", F.row_number().over(w)).where("_r <= 6")
    last = as_of - 1
    lists = newest.agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("_s") == s, F.struct("_r", "publication_number")))), lambda x: x["publication_number"]).alias(n) for s, n in (("both", "combined"), ("a", "only_a"), ("b", "only_b"))])
    both = F.col("_s") == "both"
    trend = rows.agg(
        F.sum(F.when(both & (F.col("year") > last - 5) & (F.col("year") <= last), 1).otherwise(0)).alias("last5"),
        F.sum(F.when(both & (F.col("year") > last - 10) & (F.col("year") <= last - 5), 1).otherwise(0)).alias("previous5"),
    )
    few = lambda c: F.when(F.size("combined") > 0, F.expr("cast(array() as array<string>)")).otherwise(F.slice(c, 1, 3))
    return lists.join(trend, F.lit(True)).select("combined", few("only_a").alias("newest_side_a"), few("only_b").alias("newest_side_b"), "last5", "previous5")


def concentration(rows: DataFrame, by: list[str], name: str, order: str = "pos", weight: str | None = None) -> DataFrame:
    """(by..., total, hhi, top_applicant, top_share, value): Herfindahl index over applicants, combined in
    two steps (AGG5); value = 1 - hhi / 10000; the top applicant is the first seen on ties. A row counts once, or `weight` times."""
    c = rows.groupBy(*by, F.col(name).alias("name")).agg((F.sum(weight) if weight else F.count("*")).alias("c"), F.min(order).alias("first"))
    g = c.groupBy(*by).agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max(F.struct("c", (-F.col("first")).alias("o"), "name")).alias("m"))
    hhi = F.col("squares") / (F.col("total") * F.col("total")) * 10000.0
    return g.select(*by, "total", hhi.alias("hhi"), F.col("m.name").alias("top_applicant"), (F.col("m.c") / F.col("total")).alias("top_share"), F.greatest(F.lit(0.0), 1 - hhi / 10000.0).alias("value"))


def density(counts: DataFrame) -> DataFrame:
    """(subtech, n, label_pos) -> with value = 1 - place / (labels - 1) in ascending order of counts (AGG3)."""
    w = Window.partitionBy(F.lit(0))
    place = F.row_number().over(w.orderBy("n", "label_pos")) - 1
    return counts.withColumn("value", F.when(F.count("*").over(w) > 1, 1 - place / (F.count("*").over(w) - 1)).otherwise(1.0))


def combinations_of(records: DataFrame, top: DataFrame, own: str, limit: int = 12) -> DataFrame:
    """One group against the other top groups: (ipc_a, ipc_b, count, status) ascending (AGG22); the group
    counts also if it is no top group; OTHER gives no rows."""
    mine = records.where(F.array_contains("groups", own)).select(F.explode("groups").alias("g"))
    n = mine.groupBy("g").agg(F.count("*").alias("count"))
    out = top.where((F.col("g") != own) & F.lit(own != "OTHER")).join(n, "g", "left").select(F.lit(own).alias("ipc_a"), F.col("g").alias("ipc_b"), F.coalesce("count", F.lit(0)).alias("count"), "rank")
    status = F.when(F.col("count") == 0, "gap").when(F.col("count") < 5, "developing").otherwise("crowded")
    return out.withColumn("status", status).orderBy("count", "rank").limit(limit).drop("rank")


def zero_cells(records: DataFrame, top: DataFrame, jurisdictions: list[str] | None = None) -> DataFrame:
    """(subtech, jurisdiction) without a record, over all labels and jurisdictions (JN9, AGG23)."""
    spark = records.sparkSession
    jur = spark.createDataFrame([(j,) for j in jurisdictions or JURISDICTIONS], "jurisdiction string")
    labels = top.select(F.col("g").alias("subtech")).unionByName(spark.createDataFrame([("OTHER",)], "subtech string"))
    grid = labels.join(F.broadcast(jur), F.lit(True))
    seen = records.groupBy("subtech", "jurisdiction").agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(seen), ["subtech", "jurisdiction"], "left_anti")


def matrix(records: DataFrame, top: DataFrame) -> DataFrame:
    """Rows = groups 1 to 4, columns = groups 5 to 8: count, and status against the lower median of the cells
    that aren't zero (AGG33; counts of AGG32)."""
    rows = touches(records, top)
    n = rows.select(F.explode(pairs_of(F.col("ranks"))).alias("p")).where("p.ra <= 4 and p.rb between 5 and 8").groupBy("p.ra", "p.rb").agg(F.count("*").alias("n"))
    a, b = top.where("rank <= 4").select(F.col("g").alias("row"), F.col("rank").alias("ra")), top.where("rank between 5 and 8").select(F.col("g").alias("col"), F.col("rank").alias("rb"))
    cells = a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(n), ["ra", "rb"], "left").fillna(0, ["n"])
    some = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.col("n"))).over(Window.partitionBy(F.lit(0))))
    median = F.get(some, F.floor((F.size(some) - 1) / 2).cast("int"))
    return cells.select("row", "col", "n", F.when(F.col("n") == 0, "gap").when(F.col("n") <= median, "developing").otherwise("crowded").alias("status"))


def distinctive_words(records: DataFrame, least: int = 4, share: float = 0.3) -> DataFrame:
    """(subtech, label): up to two title words of which at least `share` of all titles that hold them are in
    the group, by their count in it (AGG10); ties by the first title."""
    from lacuna.functions.text import STOP_LABEL, tokens

    w = records.select("subtech", "pos", F.explode(F.array_distinct(tokens(F.col("title"), stop=STOP_LABEL))).alias("word"))
    c = w.groupBy("subtech", "word").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    c = c.withColumn("all", F.sum("c").over(Window.partitionBy("word"))).where((F.col("c") >= least) & (F.col("c") / F.col("all") >= share) & (F.col("subtech") != "OTHER"))
    r = F.row_number().over(Window.partitionBy("subtech").orderBy(F.desc("c"), "first", "word"))
    top = c.withColumn("r", r).where("r <= 2")
    word = lambda x: F.concat(F.upper(x["word"].substr(1, 1)), x["word"].substr(F.lit(2), F.length(x["word"])))
    return top.groupBy("subtech").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), word), " ").alias("label"))
