"""Keys, validation, de-duplication and merging of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.sources.tables import written

#: Features of which one is enough for the domain gate.
CORE = ["sdn", "nfv", "sfc", "network_slicing", "oran", "openflow", "5g_core"]


#: Titles of figures and tables, not of works.
FIGURE = r"(?i)^(?:fig(?:ure)?|table|supplementary)[\s.]*\w*\s*[:.]"


def base_number(c: Column, pad: str = "all") -> Column:
    """A publication number without kind code (pad='none'), also without zeros after the country ('all'), or
    only without the zero of US0 and seven digits ('us') (CLN3)."""
    out = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), r"[A-Z]\d?$", "")
    if pad == "all":
        return F.regexp_replace(out, r"^([A-Z]{2})0+", "$1")
    return F.regexp_replace(out, r"^US0(\d{7})$", "US$1") if pad == "us" else out


def record_id(type_: Column, number: Column, doi: Column, url: Column, title: Column) -> Column:
    """patent:number, else doi:, else arxiv:, else title: (CLN4)."""
    clean = F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://(dx\.)?doi\.org/|doi:)", "")
    arxiv = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)arxiv\.org/abs/([0-9.]+)", 1)
    return F.coalesce(
        F.when((type_ == "patent") & number.isNotNull(), F.concat(F.lit("patent:"), base_number(number, "none"))),
        F.when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit("doi:"), clean)),
        F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)),
        F.concat(F.lit("title:"), F.substring(text.title_key(title), 1, 160)),
    )


def reject_reason(as_of_year: int, core: list[str] = CORE, markup: bool = True) -> Column:
    """Why a record isn't taken, else null (CLN5, CLN6). Needs title, year, url, date and features. Without `markup` titles are
    plain text and stand as they are."""
    title = F.coalesce("title", F.lit(""))
    title = text.strip_tags(title) if markup else title
    scope = F.arrays_overlap("features", F.array(*map(F.lit, core))) | (F.size("features") >= 2)
    return (
        F.when(F.length(title) < 8, "title too short")
        .when(title.rlike(FIGURE), "figure or table")
        .when(F.col("year").isNull() | ~F.col("year").between(1950, as_of_year), "year")
        .when(~F.coalesce(scope, F.lit(False)), "out of domain")
    )


def normalise(records: DataFrame, as_of_year: int, core: list[str] = CORE, markup: bool = True) -> DataFrame:
    """Records with cleaned and capped fields, `id` and `reject_reason` (CLN5). Without `markup` titles are plain text."""
    date = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd"))
    return records.withColumn("reject_reason", reject_reason(as_of_year, core, markup)).withColumns({
        "title": F.substring(text.strip_tags(F.col("title")) if markup else F.col("title"), 1, 400),
        "abstract": F.substring(text.strip_tags(F.coalesce("abstract", F.lit(""))), 1, 2000),
        "date": date,
        "url": F.when(F.col("url").rlike("^https?://"), F.col("url")),
        "authors": F.slice("authors", 1, 8),
        "id": record_id(F.col("type"), F.col("publication_number"), F.col("doi"), F.col("url"), F.col("title")),
    })


def first_arrivals(attempts: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """attempts with status: added for the first of each id unless known, else duplicate; rejected ones keep
    their reason (CLN7). One window per id; the known side is a semi-join flag."""
    valid = F.col("reject_reason").isNull() if "reject_reason" in attempts.columns else F.lit(True)
    a = attempts.withColumn("_ok", valid)
    if known is not None:
        a = a.join(known.select("id").distinct().withColumn("_k", F.lit(True)), "id", "left")
    else:
        a = a.withColumn("_k", F.lit(None).cast("boolean"))
    first = F.row_number().over(Window.partitionBy("id", "_ok").orderBy(*order)) == 1
    status = F.when(~F.col("_ok"), "rejected").when(F.col("_k").isNotNull() | ~first, "duplicate").otherwise("added")
    return a.withColumn("status", status).drop("_ok", "_k")


def merge_corpora(a: DataFrame, b: DataFrame, pad: str = "all") -> DataFrame:
    """Corpus a, one record per base number: the earliest publication date (none last) at the place of the
    first; then those of b whose base is new; with `batch` (CLN8, SET2)."""
    a, b = (d.withColumn("base", base_number(F.col("publication_number"), pad)) for d in (a, b))
    w = Window.partitionBy("base").orderBy(F.col("publication_date").asc_nulls_last(), "pos")
    kept = a.withColumn("_p", F.min("pos").over(Window.partitionBy("base"))).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    kept = kept.withColumn("pos", F.col("_p")).drop("_p", "_r").withColumn("batch", F.lit("a"))
    new = b.join(kept.select("base"), "base", "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy("base").orderBy("pos"))).where("_r = 1").drop("_r")
    return kept.unionByName(new.withColumn("batch", F.lit("b")))


def exclude_known(records: DataFrame, corpus: DataFrame, pad: str = "all") -> DataFrame:
    """Records not in the corpus, by base number (CLN9, JN6, SET3)."""
    k = corpus.select(base_number(F.col("publication_number"), pad).alias("_k")).distinct()
    return records.join(k, base_number(F.col("publication_number"), pad) == F.col("_k"), "left_anti")


def tolerant_union(sources: list[tuple[str, Callable[[], DataFrame]]], columns: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(rows, notes) of several landed sources (SET6): a source that can't be read, or whose rows can't be made, gives a note (source, note) in
    place of an error, the others all their rows, with `source`; rows is None if none can be read. Nothing is de-duplicated here.

    A source counts as read once all its rows are: they are written to a table of their own, so that a file which is broken
    in the middle leaves none of its rows behind."""
    from pyspark.sql import SparkSession

    rows, notes = None, []
    for name, read in sources:
        try:
            got = written(read().select(*columns).withColumn("source", F.lit(name)), "source")
        except Exception as e:  # whatever a source fails with is said in its note
            notes.append((name, f"{name} failed: {type(e).__name__}"))
            continue
        rows = got if rows is None else rows.unionByName(got)
    spark = SparkSession.active()
    return rows, spark.createDataFrame(notes, "source string, note string")


def shape_literature(live: DataFrame, stored: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Live rows first, then stored: no figure titles, year bounds (no year fails the start, passes the end),
    one row per title key (FLT11, SET6)."""
    rows = live.withColumn("section", F.lit(0)).unionByName(stored.withColumn("section", F.lit(1)), allowMissingColumns=True)
    rows = rows.where(~F.coalesce(F.col("title").rlike(FIGURE), F.lit(False)))
    if first is not None:
        rows = rows.where(F.col("year") >= first)
    if last is not None:
        rows = rows.where(F.coalesce(F.col("year") <= last, F.lit(True)))
    w = Window.partitionBy(text.title_key(F.col("title"))).orderBy("section", "pos")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def longest_prefix(codes: DataFrame, titles: DataFrame) -> DataFrame:
    """(code, title): the title whose prefix is the longest start of the code (CLN16). The label table is a
    small dimension; each code looks up its own prefixes, so it is an equi join."""
    p = codes.select("code", F.explode(F.sequence(F.lit(1), F.length("code"))).alias("n")).withColumn("prefix", F.expr("substring(code, 1, n)"))
    best = p.join(titles, "prefix").groupBy("code").agg(F.max_by("title", "n").alias("title"))
    return codes.join(best, "code", "left")


def class_titles(codes: DataFrame, titles: DataFrame, suffix: bool = False) -> DataFrame:
    """(code, title, level): what a class code is called (CLN16): the title of the longest prefix, else of its class (a code of three characters), its
    subclass or its section; level says which, null without any.

    titles: (level, prefix, title), level one of prefix, class, subclass, section. A code's blanks and case don't count. With `suffix`, for a
    code with a sub-group: no section, and the sub-group stands behind a title that covers more than it (its prefix is shorter and ends in another
    sub-group, or none). Every code looks its own beginnings up, so it is an equi join with the titles."""
    form = F.upper(F.regexp_replace("code", r"\s+", ""))
    c = codes.select("code").distinct().withColumn("_form", form)
    begins = F.transform(F.sequence(F.lit(1), F.length("_form")), lambda n: F.struct(F.lit("prefix").alias("level"), F.substring("_form", F.lit(1), n).alias("prefix"), (n + 10).alias("weight")))
    step = lambda level, pattern, weight: F.when(F.col("_form").rlike(pattern), F.array(F.struct(F.lit(level).alias("level"), F.regexp_extract("_form", pattern, 1).alias("prefix"), F.lit(weight).alias("weight")))).otherwise(F.expr("cast(array() as array<struct<level:string,prefix:string,weight:int>>)"))
    falls = [] if suffix else [step("class", "^([A-HY][0-9]{2})$", 3), step("section", "^([A-Z])", 1)]
    ways = F.concat(begins, step("subclass", "^([A-H][0-9]{2}[A-Z])", 2), *falls)
    tried = c.where("_form <> ''").select("code", "_form", F.explode(ways).alias("_w")).select("code", "_form", "_w.*").join(titles, ["level", "prefix"])
    best = tried.groupBy("code", "_form").agg(F.max(F.struct("weight", "level", "prefix", "title")).alias("b")).select("code", "_form", "b.level", "b.prefix", "b.title")
    if suffix:
        group = F.regexp_extract("code", "([0-9]+/[0-9]+)", 1)
        own = F.when(F.col("level") == "prefix", F.regexp_extract("prefix", "([0-9]+/[0-9]+)", 1)).otherwise("")
        covered = F.when(F.col("level") == "prefix", F.length("prefix")).otherwise(0)
        more = (group != "") & (F.length("_form") > covered) & (group != own)
        best = best.withColumn("title", F.when(more, F.concat("title", F.lit(" ("), group, F.lit(")"))).otherwise(F.col("title")))
    return codes.select("code").distinct().join(best.select("code", "title", "level"), "code", "left")


def class_label(groups: DataFrame, curated: dict[str, str], words: DataFrame) -> DataFrame:
    """(g, label): curated, else distinctive words, else 'IPC g' (CLN15)."""
    m = F.create_map(*[F.lit(x) for kv in (curated or {"": ""}).items() for x in kv])
    out = groups.join(F.broadcast(words.select(F.col("subtech").alias("g"), F.col("label").alias("_w"))), "g", "left")
    return out.select("g", F.coalesce(F.try_element_at(m, F.col("g")), "_w", F.concat(F.lit("IPC "), "g")).alias("label"))


def lookup(records: DataFrame, asked: DataFrame, number: str = "publication_number") -> DataFrame:
    """Records with one of the numbers asked for, each number once whatever its repeats (FLT10)."""
    return records.join(asked.select(number).where(F.col(number).isNotNull()).distinct(), number)
