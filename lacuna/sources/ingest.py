"""Landed files and API responses as record frames. Network calls are not made here: the inputs are files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import text

CORPUS = "publication_number string, title string, abstract string, jurisdiction string, company_name string, assignees array<string>, ipc array<string>, cpc array<string>, publication_date string, filing_date string, category string"
KNOWLEDGE = """id string, type string, title string, abstract string, year int, date string, venue string, url string, doi string, source string,
authors array<string>, cited_by int, publication_number string, jurisdiction string, assignee string, cpc array<string>, features array<string>,
origin string, query string, added_at string"""


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: JSON arrays of records, with defaults; assignees fall back to the company. pos follows the files' paths and the
    rows within them, however the read is split: a file's number and the row's place in it."""
    raw = spark.read.schema(CORPUS).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_i"))
    # a file of one array is read by one task, in order
    files = raw.groupBy("_file").agg(F.min("_i").alias("_first")).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_file")) - 1)
    raw = raw.join(files, "_file").withColumn("pos", F.shiftleft(F.col("_n").cast("long"), 40) + F.col("_i") - F.col("_first"))
    blank = F.expr("cast(array() as array<string>)")
    has = F.size(F.coalesce("assignees", blank)) > 0
    company = F.coalesce("company_name", F.lit(""))
    return raw.select(
        "pos", "publication_number", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "abstract")], "jurisdiction", company.alias("company_name"),
        F.when(has, F.col("assignees")).when(company != "", F.array(company)).otherwise(blank).alias("assignees"), F.coalesce("ipc", blank).alias("ipc"), F.coalesce("cpc", blank).alias("cpc"),
        *[F.try_to_date(c, "yyyy-MM-dd").alias(c) for c in ("publication_date", "filing_date")], "category",
    )


def knowledge(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC2: JSON lines (gzip is read as it is), earlier paths first; corrupt lines skipped; first id wins.

    First means: by path in the order given, then by file name, by the block of the file, by the row in the block. Rows of a block are
    read in order by one task, so the winner is the same however files are split and dealt."""
    frames = []
    for n, p in enumerate(paths):
        d = spark.read.schema(KNOWLEDGE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(p)
        frames.append(d.select("*", F.lit(n).alias("_n"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i")))
    rows = frames[0]
    for d in frames[1:]:
        rows = rows.unionByName(d)
    rows = rows.where("_corrupt is null and id is not null")
    first = F.row_number().over(Window.partitionBy("id").orderBy("_n", "_file", "_block", "_i"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r", "_n", "_file", "_block", "_i", "_corrupt")


def full_date(c: Column) -> Column:
    """A whole yyyy-MM-dd date, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)


def digits_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


#: The response schemas of the sources.
SCHOLAR = "data array<struct<paperId:string,title:string,year:int,venue:string,url:string,abstract:string,publicationDate:string,externalIds:struct<DOI:string>,authors:array<struct<name:string>>>>"
CROSSREF = "message struct<items:array<struct<title:array<string>,`container-title`:array<string>,URL:string,DOI:string,abstract:string,`is-referenced-by-count`:int,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>>>>"
OPENALEX = "results array<struct<id:string,doi:string,title:string,publication_year:int,publication_date:string,cited_by_count:int,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>>>"
PATENT_API = """hits array<struct<`@database`:string,`publication-reference`:struct<`doc-number`:string,date:string>,`application-reference`:struct<`doc-number`:string,date:string>,
`patent-title`:struct<title:string,`english-title`:string>,abstract:struct<p:array<string>>,parties:struct<applicants:struct<applicant:array<struct<name:string,`english-name`:string>>>>,
`classifications-ipc`:struct<ipc:array<struct<keyValue:string>>>,`classifications-cpc`:struct<cpc:array<struct<keyValue:string>>>>>"""


def names(c: Column, *fields: str) -> Column:
    """The named fields of each struct, joined; empty ones left out."""
    return F.filter(F.transform(c, lambda a: F.concat_ws(" ", *[a[f] for f in fields])), lambda x: x != "")


def scholar(raw: DataFrame) -> DataFrame:
    """SRC3 over responses of schema SCHOLAR."""
    p = raw.select(F.explode("data").alias("p"))
    return p.select(
        F.col("p.title"), F.col("p.year"), F.nullif("p.venue", F.lit("")).alias("venue"),
        F.coalesce("p.url", F.concat(F.lit("https://www.semanticscholar.org/paper/"), "p.paperId")).alias("url"), F.lit("Semantic Scholar").alias("source"),
        F.coalesce("p.abstract", F.lit("")).alias("abstract"), F.col("p.externalIds.DOI").alias("doi"), full_date(F.col("p.publicationDate")).alias("date"), names(F.col("p.authors"), "name").alias("authors"),
    )


def crossref(raw: DataFrame) -> DataFrame:
    """SRC4 over responses of schema CROSSREF; rows without a title go; a date needs year, month and day."""
    p = raw.select(F.explode("message.items").alias("p")).withColumn("d", F.get("p.issued.date-parts", F.lit(0)))
    part = lambda i, n: F.lpad(F.get("d", F.lit(i)).cast("string"), n, "0")
    return p.select(
        F.get("p.title", F.lit(0)).alias("title"), F.get("d", F.lit(0)).alias("year"), F.get("p.container-title", F.lit(0)).alias("venue"),
        F.coalesce("p.URL", F.concat(F.lit("https://doi.org/"), "p.DOI")).alias("url"), F.lit("Crossref").alias("source"), F.coalesce("p.abstract", F.lit("")).alias("abstract"), F.col("p.DOI").alias("doi"),
        F.when(F.size("d") == 3, F.concat_ws("-", part(0, 4), part(1, 2), part(2, 2))).alias("date"), names(F.col("p.author"), "given", "family").alias("authors"),
    ).where("coalesce(title, '') <> ''")


def arxiv(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: Atom feeds by the XML reader."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string, published string").load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), text.SPACES, " "))
    return raw.select(
        squeeze("title").alias("title"), F.substring("published", 1, 4).try_cast("int").alias("year"), F.lit("arXiv preprint").alias("venue"), F.regexp_replace(F.trim("id"), "^http:", "https:").alias("url"),
        F.lit("arXiv").alias("source"), squeeze("summary").alias("abstract"), full_date(F.substring("published", 1, 10)).alias("date"),
    ).where("title <> ''")


def rebuild_abstract(index: Column) -> Column:
    """A text from its inverted index, word -> positions (SRC6)."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " "), F.lit(""))


def openalex(raw: DataFrame) -> DataFrame:
    """SRC6 over responses of schema OPENALEX."""
    p = raw.select(F.explode("results").alias("p"))
    return p.select(
        F.col("p.title"), F.col("p.publication_year").alias("year"), F.col("p.primary_location.source.display_name").alias("venue"), F.coalesce("p.doi", "p.id").alias("url"), F.lit("OpenAlex").alias("source"),
        rebuild_abstract(F.col("p.abstract_inverted_index")).alias("abstract"), F.col("p.doi"), F.col("p.publication_date").alias("date"),
        F.filter(F.transform("p.authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull()).alias("authors"), F.col("p.cited_by_count").alias("cited_by"),
    )


def patent_api(raw: DataFrame) -> DataFrame:
    """SRC7 over responses of schema PATENT_API: zero padding of US numbers off, English title first, first
    applicant; rows without number or date go. CLN5 comes after."""
    p = raw.select(F.explode("hits").alias("p"))
    number = F.regexp_replace("p.publication-reference.doc-number", r"^US0(\d{7}[A-Z]\d?)$", "US$1")
    title = F.coalesce("p.patent-title.english-title", "p.patent-title.title")
    keys = lambda c: F.array_distinct(F.transform(F.filter(F.transform(c, lambda x: x["keyValue"]), lambda k: k.isNotNull() & (k != "")), lambda k: F.trim(k)))
    owner = F.get(F.filter(F.transform("p.parties.applicants.applicant", lambda a: F.coalesce(a["english-name"], a["name"])), lambda x: x.isNotNull()), F.lit(0))
    date = digits_date(F.col("p.publication-reference.date"))
    return p.select(
        F.lit("patent").alias("type"), number.alias("publication_number"), title.alias("title"), F.when(F.col("p.patent-title.title") != title, F.col("p.patent-title.title")).alias("title_original"),
        F.concat_ws(" ", "p.abstract.p").alias("abstract"), date.alias("date"), F.substring(date, 1, 4).cast("int").alias("year"), F.regexp_extract(number, "^([A-Z]{2})", 1).alias("jurisdiction"),
        text.page_url(number).alias("url"), F.col("p.application-reference.doc-number").alias("application_number"), digits_date(F.col("p.application-reference.date")).alias("filing_date"),
        text.strip_tags(owner).alias("assignee"), keys(F.col("p.classifications-ipc.ipc")).alias("ipc"), keys(F.col("p.classifications-cpc.cpc")).alias("cpc"), F.col("p.@database").alias("gpss_database"),
    ).where("coalesce(publication_number, '') <> '' and date is not null")


def first_of(html: Column, *patterns: str) -> Column:
    """The first pattern's group that isn't empty."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def patent_pages(pages: DataFrame) -> DataFrame:
    """SRC8: pages (publication_number, html) with title, abstract and publication date, all three present."""
    h = F.col("html")
    some = lambda c: F.nullif(text.strip_tags(c), F.lit(""))
    out = pages.select(
        "publication_number", some(first_of(h, '<meta name="DC\\.title" content="([^"]*)"')).alias("title"),
        F.coalesce(some(first_of(h, r"(?s)<abstract[^>]*>(.*?)</abstract>")), some(first_of(h, '<meta name="(?:DC\\.)?description" content="([^"]*)"'))).alias("abstract"),
        first_of(h, r'itemprop="publicationDate"[^>]*datetime="(\d{4}-\d{2}-\d{2})"', r'datetime="(\d{4}-\d{2}-\d{2})"[^>]*itemprop="publicationDate"', r'<meta name="DC\.date" content="(\d{4}-\d{2}-\d{2})" scheme="issue"').alias("publication_date"),
        F.substring("publication_number", 1, 2).alias("jurisdiction"),
    )
    return out.where("title is not null and abstract is not null and publication_date is not null")


#: The relations that page markup names; the patterns in these functions are the markup's, too.
RELATIONS = ["backwardReferences", "backwardReferencesOrig", "backwardReferencesFamily", "forwardReferences", "forwardReferencesOrig", "forwardReferencesFamily", "similarDocuments"]


def citation_edges(pages: DataFrame) -> DataFrame:
    """SRC9: (src, dst, relation, title) of pages (publication_number, html)."""
    row = rf'(?s)<tr itemprop="(?:{"|".join(RELATIONS)})"[^>]*>.*?</tr>'
    r = pages.select(F.col("publication_number").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(row), F.lit(0))).alias("r"))
    dst = F.regexp_extract("r", 'itemprop="publicationNumber">([A-Z]{2}[0-9A-Z]+)<', 1)
    out = r.select("src", dst.alias("dst"), F.regexp_extract("r", '^<tr itemprop="([A-Za-z]+)"', 1).alias("relation"), text.strip_tags(F.regexp_extract("r", r'(?s)itemprop="title">(.*?)</td>', 1)).alias("title"))
    return out.where("dst <> ''")


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): what any page (id in `src`, html) links to, in the page's order, repeats kept (SRC9)."""
    return pages.select("src", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))


def page_text(html: Column) -> tuple[Column, Column]:
    """(title, text) of any page: what its title element says, and all text outside tags."""
    return F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)), text.strip_tags(html)


def page_extras(pages: DataFrame) -> DataFrame:
    """SRC9: assignee, up to 12 CPC codes, priority date."""
    h = F.col("html")
    codes = F.slice(F.array_distinct(F.regexp_extract_all(h, F.lit(r'<span itemprop="Code">([A-H]\d{2}[A-Z]\d{1,4}/\d{2,6})</span>'), F.lit(1))), 1, 12)
    return pages.select("publication_number", text.strip_tags(first_of(h, '<meta name="DC\\.contributor" content="([^"]*)" scheme="assignee">')).alias("assignee"), codes.alias("cpc"), first_of(h, r'itemprop="priorityDate"[^>]*datetime="(\d{4}-\d{2}-\d{2})"').alias("priority_date"))


def candidate_numbers(c: Column, most: int = 12) -> Column:
    """SRC10: patent numbers in URLs and prose, distinct, the first `most`."""
    plain = lambda a: F.transform(a, lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))
    url = F.regexp_extract_all(c, F.lit(r"(?i)patents\.google\.com/patent/([A-Z]{2}[0-9A-Z]{4,}[A-Z0-9]*)"), F.lit(1))
    other = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)patents\.justia\.com/patent/(\d{7,8})(?![A-Za-z0-9_])"), F.lit(1)), lambda x: F.concat(F.lit("US"), x))
    prose = F.regexp_extract_all(c, F.lit(rf"{text.B0}((?:US|EP|JP|TW|WO|CN|KR)[- ]?\d[\d,]{{4,}}[A-Z]?\d?){text.B1}"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(plain(url), other, plain(prose))), 1, most)
