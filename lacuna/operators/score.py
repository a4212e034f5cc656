"""The opportunity score of many cases at once: four factors, grade, sensitivity, back test.

Frames: cases (case_id, cutoff, cutoff_year, target?), case_features (case_id, id, feature_id),
doc_features (pos, feature_id), records (pos, publication_date, jurisdiction, company_name, assignees).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.metrics import clamp01, growth_of, half_up, smoothed
from lacuna.sources.tables import written

WEIGHTS = {"novelty": 0.40, "crowding": 0.25, "temporal": 0.20, "regional": 0.15}
TARGETS = ["US", "EP", "JP", "TW"]
LEAST_EVIDENCE = 20


def clean_features(cases: DataFrame, most: int = 12) -> DataFrame:
    """Well-formed caller-supplied features: first 12, id up to 16 characters, text up to 120 (CLN14)."""
    ok = F.filter("features", lambda f: f.isNotNull() & f["id"].isNotNull() & (f["id"] != "") & f["text"].isNotNull() & (f["text"] != ""))
    cut = F.transform(F.slice(ok, 1, most), lambda f: F.struct(F.substring(f["id"], 1, 16).alias("id"), F.substring(f["text"], 1, 120).alias("text"), f["feature_id"].alias("feature_id")))
    return cases.withColumn("features", cut)


def status(features: Column, year: Column, subtech: Column) -> Column:
    """Why a case is not scored, else 'scored' (FLT9, FLT12). features: array of struct with feature_id."""
    known = F.size(F.filter(features, lambda f: f["feature_id"].isNotNull()))
    return (
        F.when(year.isNull(), "needs_confirmation: cutoff_year")
        .when(F.coalesce(F.size(features), F.lit(0)) <= 0, "needs_confirmation: features")
        .when(known < 2, "insufficient")
        .when(subtech == "OTHER", "other")
        .otherwise("scored")
    )


def reference_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Cases that name a record instead of a text: its text and filing date, its codes as features without a
    known id; an unknown record is an error (JN11)."""
    r = records.select(F.col("publication_number").alias("patent_id"), F.concat_ws(" ", "title", "abstract").alias("ref_text"), F.coalesce("filing_date", "publication_date").alias("ref_date"), F.col("ipc").alias("ref_ipc"))
    out = cases.join(r, "patent_id", "left")
    codes = F.transform("ref_ipc", lambda c, i: F.struct(F.concat(F.lit("F"), (i + 1).cast("string")).alias("id"), c.alias("text"), F.lit(None).cast("string").alias("feature_id")))
    return out.withColumn("code_features", codes).withColumn("error", F.when(F.col("patent_id").isNull(), "missing reference").when(F.col("ref_text").isNull(), "unknown reference"))


#: Features in a word of bits.
WORD = 62


class Shared:
    """Cases and records as classes, by what they have of the cases' features: cases of a class share all their matches but for their
    cutoffs, so classes are compared, never rows.

    A class is a set of features as words of bits, one word up to 62 features of the cases; records' classes are by date as well where dates
    count. Their number is bounded by the taxonomy and the dates, not by the records. Whether two classes meet is a count of common bits."""

    def __init__(self, case_features: DataFrame, doc_features: DataFrame):
        ids = case_features.where("feature_id is not null").select("case_id", "feature_id")
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("feature_id")) - 1
        places = written(ids.select("feature_id").distinct().withColumn("_n", place), "places")  # a row per feature
        self.words = [f"s{w}" for w in range(max(1, -(-places.count() // WORD)))]
        bits = [F.expr(f"bit_or(if(_n div {WORD} = {w}, shiftleft(1L, cast(_n % {WORD} as int)), 0L))").alias(f"s{w}") for w in range(len(self.words))]
        sets = lambda rows, key: rows.join(F.broadcast(places), "feature_id").groupBy(key).agg(*bits)
        self.cases = written(sets(ids, "case_id"), "case_sets")
        self.docs = written(sets(doc_features.select("pos", "feature_id"), "pos"), "doc_sets")

    def meet(self, cases: DataFrame, docs: DataFrame, least: int, on: Column | None = None) -> DataFrame:
        """Classes of cases (kid, words...) beside classes of records (words...) that have at least `least` features in common."""
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        c = cases.withColumnsRenamed({w: f"c_{w}" for w in self.words})
        common = sum((F.bit_count(F.col(w).bitwiseAND(F.col(f"c_{w}"))) for w in self.words), F.lit(0))
        met = common >= least
        # dealt out anew: the classes are few rows, the comparisons many
        return docs.repartition(parts).join(c, met if on is None else met & on).drop(*[f"c_{w}" for w in self.words])

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(case_id, kid) and (kid, words...): the cases' classes, one per set of features; dates stay with the members."""
        k = written(self.cases.select(*self.words).distinct().withColumn("kid", F.monotonically_increasing_id()), "classes")
        return self.cases.join(k, self.words).select("case_id", "kid"), k

    def matched(self, cases: DataFrame, records: DataFrame) -> DataFrame:
        """(case_id, pos): records up to the cutoff with at least two of the case's features (AGG16).

        The pairs are quadratic in their nature: of all records as cases about one pair in fourteen. A class of cases is a row with its members,
        a record meets the classes and lists their members where it is, so that the pairs themselves are neither shuffled nor sorted."""
        own = self.cases.join(cases.select("case_id", "cutoff").where("cutoff is not null"), "case_id")
        k = own.groupBy(*self.words).agg(F.collect_list(F.struct("case_id", "cutoff")).alias("_members"), F.max("cutoff").alias("_last"))
        docs = self.docs.join(records.select("pos", F.col("publication_date").alias("day")), "pos").where("day is not null")
        met = self.meet(written(k, "classes"), written(docs, "dated_sets"), 2, F.col("day") <= F.col("_last"))
        return met.select("pos", "day", F.inline("_members")).where("day <= cutoff").select("case_id", "pos")

    def matched_counts(self, cases: DataFrame, records: DataFrame, by: Sequence[str] = ("year", "jurisdiction", "applicant")) -> DataFrame:
        """(case_id, by..., n, pos): the matched records counted, not listed; pos is the smallest. A class's records are counted per day
        once, then added up for each of its cutoffs."""
        from lacuna.operators.classes import applicant

        members, k = self.classes()
        members = members.join(cases.select("case_id", "cutoff").where("cutoff is not null"), "case_id")
        docs = self.docs.join(records.select("pos", F.col("publication_date").alias("day"), "jurisdiction", applicant("assignee").alias("applicant")), "pos").withColumn("year", F.year("day"))
        docs = docs.join(cases.agg(F.max("cutoff").alias("_last")), F.col("day") <= F.col("_last"))
        d = written(docs.groupBy(*self.words, "day", *by).agg(F.count("*").alias("n"), F.min("pos").alias("pos")), "classes")
        cells = written(self.meet(k, d, 2).groupBy("kid", "day", *by).agg(F.sum("n").alias("n"), F.min("pos").alias("pos")), "cells")
        upto = members.select("kid", "cutoff").distinct().join(cells, "kid").where("day <= cutoff").groupBy("kid", "cutoff", *by).agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
        return members.join(upto, ["kid", "cutoff"]).drop("kid", "cutoff")

    def year_counts(self, records: DataFrame, year: str = "year") -> DataFrame:
        """(case_id, year, n): records that share a feature with the case, by year (SRC11 over a landed table)."""
        members, k = self.classes()
        d = written(self.docs.join(records.select("pos", F.col(year).alias("year")), "pos").groupBy(*self.words, "year").agg(F.count("*").alias("n")), "classes")
        cells = self.meet(k, d, 1).groupBy("kid", "year").agg(F.sum("n").alias("n"))
        return members.join(cells, "kid").select("case_id", "year", "n")


def matched_set(case_features: DataFrame, cases: DataFrame, doc_features: DataFrame, records: DataFrame) -> DataFrame:
    """(case_id, pos): records up to the cutoff with at least two of the case's features (AGG16)."""
    return Shared(case_features, doc_features).matched(cases, records)


def rows_of(matched: DataFrame) -> Column:
    """How many records the rows of a matched set stand for: one each, or n where it is counted."""
    return F.sum("n") if "n" in matched.columns else F.count("*")


def novelty(case_features: DataFrame, art: DataFrame, doc_features: DataFrame) -> DataFrame:
    """(case_id, value, is_fallback, evidence_count, closest, overlap_pct, unmatched, total) (AGG14, AGG15).
    art: (case_id, pos, place) in evidence order, ten at most; the closest is the last of equally close ones."""
    total = case_features.groupBy("case_id").agg(F.count("*").alias("total"), F.count_distinct("id").alias("ids"))
    has = art.join(doc_features.select("pos", "feature_id"), "pos", "left").join(case_features.select("case_id", "feature_id", "id").where("feature_id is not null"), ["case_id", "feature_id"], "left")
    each = has.groupBy("case_id", "pos", "place").agg(F.count_distinct("id").alias("both"))
    each = each.join(total, "case_id").withColumn("j", F.col("both") / F.col("ids"))  # a record's matches are among the case's
    best = each.groupBy("case_id").agg(F.max(F.struct("j", "place", "pos")).alias("m"), F.count("*").alias("evidence_count"))
    seen = has.where("id is not null").groupBy("case_id").agg(F.count_distinct("id").alias("seen"))
    out = total.join(best, "case_id", "left").join(seen, "case_id", "left").withColumn("unmatched", F.col("total") - F.coalesce("seen", F.lit(0)))
    value = 0.5 * clamp01(1 - F.col("m.j")) + 0.5 * clamp01(F.col("unmatched") / F.col("total"))
    return out.select(
        "case_id", F.coalesce(value, F.lit(0.5)).alias("value"), F.col("m").isNull().alias("is_fallback"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.col("m.pos").alias("closest"), half_up(F.col("m.j") * 100).alias("overlap_pct"), "unmatched", "total",
    )


def crowding(matched: DataFrame, cases: DataFrame, background: DataFrame) -> DataFrame:
    """(case_id, value, hits, percentile): 1 - mid-rank of the matched set's size among the counts of all
    feature pairs at the same cutoff (AGG17). background: (cutoff, documents), a row per pair and cutoff. matched: rows or counts."""
    hits = cases.select("case_id", "cutoff").join(matched.groupBy("case_id").agg(rows_of(matched).alias("hits")), "case_id", "left").fillna(0, ["hits"])
    b = background.select("cutoff", "documents")
    # cases with the same cutoff and number of hits have the same rank
    r = hits.select("cutoff", "hits").distinct().join(b, "cutoff").groupBy("cutoff", "hits").agg(F.sum((F.col("documents") < F.col("hits")).cast("int")).alias("below"), F.sum((F.col("documents") == F.col("hits")).cast("int")).alias("equal"), F.count("*").alias("n"))
    r = hits.join(r, ["cutoff", "hits"])
    p = (F.col("below") + 0.5 * F.col("equal")) / F.col("n")
    return r.select("case_id", clamp01(1 - p).alias("value"), "hits", p.alias("percentile"))


def regional(matched: DataFrame, cases: DataFrame, records: DataFrame | None, default: str = "TW", targets: list[str] | None = None) -> DataFrame:
    """(case_id, value, target, target_hits, hhi, total): half for no hit in the target, half for dispersed
    applicants (AGG18). Without records, matched has counts by jurisdiction and applicant."""
    from lacuna.operators.classes import applicant, concentration

    rows = matched if records is None else matched.join(records.select("pos", "jurisdiction", applicant("assignee").alias("applicant")), "pos").withColumn("n", F.lit(1).cast("long"))
    t = cases.select("case_id", F.when(F.col("target").isin(targets or TARGETS), F.col("target")).otherwise(default).alias("target"))
    hits = rows.join(t, "case_id").groupBy("case_id").agg(F.sum(F.when(F.col("jurisdiction") == F.col("target"), F.col("n"))).alias("target_hits"))
    c = concentration(rows, ["case_id"], "applicant", weight="n").select("case_id", "total", "hhi", F.col("value").alias("spread"))
    out = t.join(hits, "case_id", "left").join(c, "case_id", "left").fillna(0, ["target_hits", "total"])
    value = 0.5 * F.when(F.col("target_hits") == 0, 1.0).otherwise(0.0) + 0.5 * F.coalesce("spread", F.lit(0.5))
    return out.select("case_id", value.alias("value"), "target", "target_hits", F.coalesce("hhi", F.lit(0.0)).alias("hhi"), "total")


def year_counts(doc_features: DataFrame, case_features: DataFrame, records: DataFrame, year: str = "year") -> DataFrame:
    """(case_id, year, n): records that share a feature with the case, by year (SRC11 over a landed table)."""
    return Shared(case_features, doc_features).year_counts(records, year)


def temporal(cases: DataFrame, counts: DataFrame, field: DataFrame, matched: DataFrame, records: DataFrame | None) -> DataFrame:
    """(case_id, value, is_fallback, evidence_count): growth over the five years to the cutoff against the
    field's, on a log scale; too thin or no data is neutral; halved if patents outnumber papers (AGG19). Without records,
    matched has counts by year."""
    c = cases.select("case_id", "cutoff_year")
    at = lambda d, name: F.coalesce(F.sum(F.when(F.col("year") == F.col("cutoff_year") - d, F.col("n"))), F.lit(0)).alias(name)
    window = F.col("year").between(F.col("cutoff_year") - 4, F.col("cutoff_year"))
    own = c.join(counts, "case_id", "left").groupBy("case_id", "cutoff_year").agg(at(4, "first"), at(0, "last"), F.coalesce(F.sum(F.when(window, F.col("n"))), F.lit(0)).alias("papers"))
    base_of = c.select("cutoff_year").distinct().join(F.broadcast(field), F.lit(True)).groupBy("cutoff_year").agg(at(4, "ff"), at(0, "fl")) if field is not None else None
    f = c.join(base_of, "cutoff_year").drop("cutoff_year") if field is not None else c.select("case_id", F.lit(0).alias("ff"), F.lit(0).alias("fl"))
    dated = matched if records is None else matched.join(records.select("pos", F.year("publication_date").alias("year")), "pos")
    p = dated.join(c, "case_id").where(window).groupBy("case_id").agg(rows_of(dated).alias("patents"))
    r = own.join(f, "case_id", "left").join(p, "case_id", "left").fillna(0, ["ff", "fl", "patents"])
    base = (F.col("ff") > 0) & (F.col("fl") > 0)
    relative = clamp01(0.5 + 0.25 * F.log2(smoothed(F.col("first"), F.col("last")) / smoothed(F.col("ff"), F.col("fl"))))
    value = F.when(base, relative).otherwise(clamp01(0.5 + growth_of(F.col("first"), F.col("last")) / 2))
    value = value * F.when(F.col("patents") > F.col("papers"), 0.5).otherwise(1.0)
    thin = F.col("papers") < LEAST_EVIDENCE
    return r.select("case_id", F.when(thin, 0.5).otherwise(value).alias("value"), thin.alias("is_fallback"), F.col("papers").alias("evidence_count"))


def grade(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 45, "Medium").otherwise("Low")


def combine(factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """factors (case_id, factor, value, is_fallback) -> (breakdown, scores): weighted with one decimal each,
    then summed and rounded; `insufficient_evidence` with two fallbacks or more (AGG20)."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("factor"))
    b = factors.withColumn("weight", weight).withColumn("weighted", half_up(F.col("value") * F.col("weight") * 100, 1))
    s = b.groupBy("case_id").agg(half_up(F.round(F.sum("weighted"), 6)).cast("int").alias("score"), (F.sum(F.col("is_fallback").cast("int")) >= 2).alias("insufficient_evidence"))
    b = b.select("case_id", "factor", half_up(F.col("value"), 2).alias("value"), "weight", "weighted", "is_fallback")
    return b, s.select("case_id", "score", grade(F.col("score")).alias("grade"), "insufficient_evidence")


def sensitivity(breakdown: DataFrame) -> DataFrame:
    """(case_id, factor, delta, score, grade, grade_changed, robust): each weight moved by 5 and 10 points,
    the others scaled to keep the sum, over two-decimal values and unrounded terms (AGG21)."""
    base = breakdown.groupBy("case_id").agg(grade(half_up(F.round(F.sum("weighted"), 6))).alias("base"))
    deltas = F.explode(F.array(*map(F.lit, (-0.10, -0.05, 0.05, 0.10))))
    moved = breakdown.select("case_id", F.col("factor").alias("target"), F.col("weight").alias("w0")).withColumn("delta", deltas)
    moved = moved.withColumn("w1", clamp01(F.col("w0") + F.col("delta"))).withColumn("scale", (1 - F.col("w1")) / (1 - F.col("w0")))
    each = moved.join(breakdown.select("case_id", "factor", "value", "weight"), "case_id")
    term = F.col("value") * F.when(F.col("factor") == F.col("target"), F.col("w1")).otherwise(F.col("weight") * F.col("scale")) * 100
    out = each.groupBy("case_id", F.col("target").alias("factor"), "delta").agg(half_up(F.round(F.sum(term), 6)).cast("int").alias("score"))
    out = out.join(base, "case_id").withColumn("grade", grade(F.col("score"))).withColumn("grade_changed", F.col("grade") != F.col("base"))
    return out.withColumn("robust", ~F.max("grade_changed").over(Window.partitionBy("case_id"))).drop("base")


def matched_features(case_features: DataFrame, art: DataFrame, doc_features: DataFrame) -> DataFrame:
    """(case_id, pos, place, matched): which of the case's features (F1, ...) each record of the evidence has, in order
    (AGG14); features without a known id never match."""
    known = case_features.where("feature_id is not null").select("case_id", "feature_id", "id", F.regexp_extract("id", "([0-9]+)", 1).cast("int").alias("_n"))
    has = art.select("case_id", "pos", "place").join(doc_features.select("pos", "feature_id").distinct(), "pos").join(known, ["case_id", "feature_id"])
    listed = has.groupBy("case_id", "pos").agg(F.transform(F.array_sort(F.collect_set(F.struct("_n", "id"))), lambda x: x["id"]).alias("matched"))
    return art.select("case_id", "pos", "place").join(listed, ["case_id", "pos"], "left").withColumn("matched", F.coalesce("matched", F.expr("cast(array() as array<string>)")))


def back_test(breakdown: DataFrame, scores: DataFrame, runs: DataFrame, now: int, then: int) -> DataFrame:
    """(case_id, factor, value_now, value_then, change, score_now, score_then, grade_now, grade_then): the same cases at two cutoffs of one
    run (JN10). runs: (case_id, of, run); a case that has no value at one date keeps nulls there."""
    rows = breakdown.join(scores, "case_id").join(runs, "case_id")
    at = lambda run, name: rows.where(F.col("run") == run).select(F.col("of").alias("case_id"), "factor", *[F.col(c).alias(f"{c}_{name}") for c in ("value", "score", "grade")])
    out = at(now, "now").join(at(then, "then"), ["case_id", "factor"], "full")
    out = out.withColumn("change", half_up(F.col("value_now") - F.col("value_then"), 2))
    return out.select("case_id", "factor", "value_now", "value_then", "change", "score_now", "score_then", "grade_now", "grade_then")


def ordinal(n: Column) -> Column:
    n = n.cast("int")
    ending = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)
