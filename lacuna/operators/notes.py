"""What a factor's value says in words: message templates are a table, joined by factor, case and language, and filled by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.metrics import half_up
from lacuna.operators.score import LEAST_EVIDENCE, ordinal

#: (factor, case, language, template); {name} stands for a fact.
TEMPLATES = [
    ("novelty", "found", "en", "{closest} is the closest prior art: it shares {overlap}% of the features. {unmatched} of {total} features are in none of the {evidence} records compared."),
    ("novelty", "none", "en", "Nothing comparable was found before the cutoff, so novelty stays neutral at 0.5."),
    ("crowding", "found", "en", "{hits} records before the cutoff have two or more of the features, the {place} percentile among {pairs} pairs of features."),
    ("regional", "gap", "en", "No matching record in {target}: a regional gap. Concentration of applicants over {total} records is {hhi}."),
    ("regional", "found", "en", "{hits} matching records in {target}. Concentration of applicants over {total} records is {hhi}."),
    ("regional", "none", "en", "No record matches before the cutoff, so concentration stays neutral at 0.5."),
    ("temporal", "thin", "en", "Only {papers} publications match from {first_year} to {last_year}, fewer than {least}, so the trend stays neutral at 0.5."),
    ("temporal", "found", "en", "{papers} publications match from {first_year} to {last_year}; the trend against the field gives {value}."),
    ("novelty", "found", "zh", "最接近的前案為 {closest}，特徵重疊 {overlap}%；{total} 項特徵中 {unmatched} 項不見於所比對的 {evidence} 件資料。"),
    ("novelty", "none", "zh", "基準日前查無可比對的前案，新穎性取中性值 0.5。"),
    ("crowding", "found", "zh", "基準日前有 {hits} 件資料具備兩項以上特徵，於 {pairs} 組特徵配對中位居第 {place_number} 百分位。"),
    ("regional", "gap", "zh", "{target} 沒有相符資料，為區域缺口；{total} 件資料的申請人集中度為 {hhi}。"),
    ("regional", "found", "zh", "{target} 有 {hits} 件相符資料；{total} 件資料的申請人集中度為 {hhi}。"),
    ("regional", "none", "zh", "基準日前沒有相符資料，集中度取中性值 0.5。"),
    ("temporal", "thin", "zh", "{first_year} 至 {last_year} 年僅 {papers} 篇文獻相符，少於 {least} 篇，趨勢取中性值 0.5。"),
    ("temporal", "found", "zh", "{first_year} 至 {last_year} 年有 {papers} 篇文獻相符；相對於整個領域的趨勢值為 {value}。"),
]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "factor string, case string, lang string, template string")


def filled(template: Column, facts: Column) -> Column:
    """A template with each {name} replaced by the fact of that name; names without a fact stay as they are."""
    step = lambda said, kv: F.replace(said, F.concat(F.lit("{"), kv["key"], F.lit("}")), F.coalesce(kv["value"], F.lit("")))
    return F.aggregate(F.map_entries(facts), template, step)


def whole(c) -> Column:
    return F.coalesce(c.cast("long").cast("string"), F.lit("0"))


def facts_of(factor: str, case: Column, **named: Column) -> list[Column]:
    pairs = [x for name, c in named.items() for x in (F.lit(name), c)]
    return [F.lit(factor).alias("factor"), case.alias("case"), F.create_map(*pairs).alias("facts")]


def facts(novelty: DataFrame, crowding: DataFrame, regional: DataFrame, temporal: DataFrame, cases: DataFrame, pairs: int) -> DataFrame:
    """(case_id, factor, case, facts) of the four factors' frames (score.novelty, ...); cases has case_id and cutoff_year, `pairs` is the number of
    pairs of features."""
    c, text = F.col, lambda name: F.coalesce(F.col(name).cast("string"), F.lit("-"))
    last = temporal.join(cases.select("case_id", "cutoff_year"), "case_id")
    place = half_up(c("percentile") * 100)
    parts = [
        novelty.select("case_id", *facts_of("novelty", F.when(c("is_fallback"), "none").otherwise("found"), closest=text("closest"), overlap=whole(c("overlap_pct")), unmatched=whole(c("unmatched")), total=whole(c("total")), evidence=whole(c("evidence_count")))),
        crowding.select("case_id", *facts_of("crowding", F.lit("found"), hits=whole(c("hits")), place=ordinal(place), place_number=whole(place), pairs=F.lit(str(pairs)))),
        regional.select("case_id", *facts_of("regional", F.when(c("total") == 0, "none").when(c("target_hits") == 0, "gap").otherwise("found"), target=text("target"), hits=whole(c("target_hits")), total=whole(c("total")), hhi=whole(half_up(c("hhi"))))),
        last.select("case_id", *facts_of("temporal", F.when(c("is_fallback"), "thin").otherwise("found"), papers=whole(c("evidence_count")), first_year=whole(c("cutoff_year") - 4), last_year=whole(c("cutoff_year")), least=F.lit(str(LEAST_EVIDENCE)), value=F.format_string("%.2f", c("value")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def told(facts: DataFrame, languages: list[str]) -> DataFrame:
    """(case_id, factor, lang, note) in each language asked for (SCL16)."""
    wanted = table(facts.sparkSession).where(F.col("lang").isin(languages))
    return facts.join(F.broadcast(wanted), ["factor", "case"]).select("case_id", "factor", "lang", filled(F.col("template"), F.col("facts")).alias("note"))
