"""Page markup, point lookup, accepted years and feature-pair queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.operators import clean, score
from lacuna.plans import views
from lacuna.plans.registry import query
from lacuna.sources import ingest
from lacuna.sources.tables import shared_dir


def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as landed patent pages: owner, codes and date in the markup, and each line a cited publication."""
    lines = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("lines"))  # lines of one order
    p = views.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    cited = F.transform("lines", lambda x: F.concat(
        F.lit('<tr itemprop="'), F.when(x["l_linenumber"] % 2 == 0, "backwardReferences").otherwise("forwardReferencesOrig"), F.lit('" repeat><td><span itemprop="publicationNumber">US'),
        (x["l_partkey"] + 8000000).cast("string"), F.lit('B2</span></td><td itemprop="title"> <b>by</b> '), x["l_returnflag"], F.lit("</td></tr>")))
    codes = F.transform("lines", lambda x: F.concat(F.lit('<span itemprop="Code">H04L'), (x["l_partkey"] % 90 + 1).cast("string"), F.lit("/"), (x["l_linenumber"] + 10).cast("string"), F.lit("</span>")))
    html = F.concat(
        F.lit('<html><meta name="DC.contributor" content="'), F.concat(F.lit("Owner "), F.col("o_custkey").cast("string")), F.lit('" scheme="assignee"><time itemprop="priorityDate" datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('">x</time>'), F.array_join(codes, " "), F.array_join(cited, "\n"), F.lit("</html>"))
    return p.select(F.concat(F.lit("EP"), F.col("o_orderkey").cast("string")).alias("publication_number"), html.alias("html"))


@query("""SELECT 'EP' || l_orderkey AS src, 'US' || (l_partkey + 8000000) || 'B2' AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'backwardReferences' ELSE 'forwardReferencesOrig' END AS relation, 'by ' || l_returnflag AS title
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def citation_edges(spark, d):
    return ingest.citation_edges(marked_pages(spark, d))


@query("""WITH c AS (SELECT l_orderkey, 'H04L' || (l_partkey % 90 + 1) || '/' || (l_linenumber + 10) AS code, min(l_linenumber::BIGINT * 1000000000 + l_partkey) AS k FROM lineitem GROUP BY 1, 2)
  SELECT 'EP' || o_orderkey AS publication_number, 'Owner ' || o_custkey AS assignee, array_to_string(list(code ORDER BY k)[1:12], ';') AS cpc, strftime(o_orderdate, '%Y-%m-%d') AS priority_date
  FROM orders JOIN c ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate""")
def page_extras(spark, d):
    return ingest.page_extras(marked_pages(spark, d)).withColumn("cpc", F.array_join("cpc", ";"))


@query(f"WITH {views.REC} SELECT pos, publication_number FROM rec WHERE publication_number IN (SELECT 'D' || page_id FROM pages)")
def point_lookup(spark, d):
    asked = views.table(spark, d, "pages").select(F.concat(F.lit("D"), F.col("page_id").cast("string")).alias("publication_number"))
    return clean.lookup(views.rec(spark, d), asked).select("pos", "publication_number")


@query(f"""WITH {views.REC}, y AS (SELECT pos, CASE WHEN pos % 3 > 0 AND 1970 + pos % 90 BETWEEN 1990 AND 2030 THEN 1970 + pos % 90 ELSE year END AS y FROM rec)
  SELECT pos, CAST(y AS INTEGER) AS cutoff_year, make_date(CAST(y AS BIGINT), CAST(12 AS BIGINT), CAST(31 AS BIGINT)) AS cutoff FROM y""")
def accepted_cutoff(spark, d):
    asked = F.when(F.col("pos") % 3 > 0, 1970 + F.col("pos") % 90)
    out = views.rec(spark, d).select("pos", text.accepted_year(asked, F.col("year")).cast("int").alias("cutoff_year"))
    return out.withColumn("cutoff", text.cutoff_date(F.col("cutoff_year")))


@query("""WITH l AS (SELECT l_orderkey AS k, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag, l_linestatus) AS a FROM lineitem GROUP BY 1),
  q AS (SELECT k, CASE len(a) WHEN 1 THEN [a[1]] WHEN 2 THEN [a[1] || ' ' || a[2]] WHEN 3 THEN [a[1] || ' ' || a[2], a[3], a[1] || ' ' || a[3]] WHEN 4 THEN [a[1] || ' ' || a[2], a[3] || ' ' || a[4], a[1] || ' ' || a[3]]
    WHEN 5 THEN [a[1] || ' ' || a[2], a[3] || ' ' || a[4], a[5]] ELSE [a[1] || ' ' || a[2], a[3] || ' ' || a[4], a[5] || ' ' || a[6]] END AS qs FROM l),
  u AS (SELECT k, i, q FROM (SELECT k, unnest(qs) AS q, unnest(range(len(qs))) AS i FROM q)), f AS (SELECT k, q, min(i) AS i FROM u GROUP BY 1, 2)
  SELECT k, array_to_string(list(q ORDER BY i), '|') AS queries FROM f GROUP BY 1""")
def feature_pair_queries(spark, d):
    """Flags of an order's lines as the labels of a case."""
    lines = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("a"))  # lines of one order
    return lines.select("k", F.array_join(text.pair_queries(F.transform("a", lambda x: F.concat(x["l_returnflag"], x["l_linestatus"]))), "|").alias("queries"))


# --- responses of literature and patent sources, landed as JSON text ----------------------------------------


def landed(spark: SparkSession, rows: DataFrame, body: Column, schema: str, wrap: str, end: str = "") -> DataFrame:
    """Rows (pos, jurisdiction, ...) as responses of at most 500 each, written as JSON text and read by a source's schema."""
    at = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    j = rows.groupBy("jurisdiction", F.expr("pos div 500")).agg(F.to_json(F.struct(F.collect_list(body).alias("x"))).alias("j"))  # a page of results
    j.select(F.concat(F.regexp_replace("j", r'^\{"x":', wrap), F.lit(end)).alias("value")).write.text(at)
    return spark.read.schema(schema).json(at)


def responses(spark: SparkSession, d: str, body: Column, where: str, schema: str, wrap: str, end: str = "") -> DataFrame:
    """Pages of a kind as landed responses."""
    return landed(spark, views.kb(spark, d).where(where), body, schema, wrap, end)


def scholar_rows(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("publication_number").alias("paperId"), "title", "year", F.when(F.col("pos") % 3 > 0, "Journal").otherwise("").alias("venue"), F.when(F.col("pos") % 8 > 0, F.col("url")).alias("url"), F.substring("abstract", 1, 50).alias("abstract"),
                    F.when(F.col("pos") % 4 == 0, F.concat(F.col("year").cast("string"), F.lit("-05-06"))).otherwise("unknown").alias("publicationDate"), F.array(F.struct(F.lit("A. Writer").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"))
    return ingest.scholar(responses(spark, d, body, "type = 'paper'", ingest.SCHOLAR, '{"data":'))


@query(f"WITH {views.KB} SELECT title, year, CASE WHEN pos % 3 > 0 THEN 'Journal' END AS venue, CASE WHEN pos % 8 > 0 THEN url ELSE 'https://www.semanticscholar.org/paper/' || publication_number END AS url, CASE WHEN pos % 4 = 0 THEN year || '-05-06' END AS date, 1 AS n_authors FROM kb WHERE type = 'paper'")
def scholar_records(spark, d):
    """Semantic Scholar responses (SRC3)."""
    return scholar_rows(spark, d).select("title", "year", "venue", "url", "date", F.size("authors").alias("n_authors"))

@query(f"""WITH {views.KB} SELECT title, year, CASE WHEN pos % 4 > 0 THEN 'Proceedings' END AS venue, CASE WHEN pos % 8 > 0 THEN url ELSE 'https://doi.org/10.1/' || pos END AS url, '10.1/' || pos AS doi,
    CASE WHEN pos % 3 = 0 THEN year || '-05-0' || (pos % 9 + 1) END AS date, CASE WHEN pos % 5 = 0 THEN 'A. Writer;Group' ELSE 'A. Writer' END AS authors
  FROM kb WHERE type = 'paper' AND title <> '' AND pos % 14 > 0""")
def crossref_records(spark, d):
    """Crossref responses (SRC4): a date needs all three parts, rows without a title go, names are joined."""
    part = lambda n: F.array(F.col("year"), F.lit(5), (F.col("pos") % 9 + 1).cast("int")) if n == 3 else F.slice(F.array(F.col("year"), F.lit(5)), 1, n)
    issued = F.when(F.col("pos") % 3 == 0, part(3)).when(F.col("pos") % 3 == 1, part(2)).otherwise(part(1))
    writer = F.struct(F.lit("A.").alias("given"), F.lit("Writer").alias("family"))
    group = F.struct(F.lit(None).cast("string").alias("given"), F.lit("Group").alias("family"))
    blank = F.expr("cast(array() as array<string>)")
    body = F.struct(
        F.when(F.col("pos") % 14 == 0, blank).otherwise(F.array("title")).alias("title"), F.when(F.col("pos") % 4 > 0, F.array(F.lit("Proceedings"))).otherwise(blank).alias("container-title"),
        F.when(F.col("pos") % 8 > 0, F.col("url")).alias("URL"), F.concat(F.lit("10.1/"), F.col("pos").cast("string")).alias("DOI"), "abstract",
        F.struct(F.array(issued).alias("date-parts")).alias("issued"), F.when(F.col("pos") % 5 == 0, F.array(writer, group)).otherwise(F.array(writer)).alias("author"),
    )
    out = ingest.crossref(responses(spark, d, body, "type = 'paper'", ingest.CROSSREF, '{"message":{"items":', "}"))
    return out.select("title", "year", "venue", "url", "doi", "date", F.array_join("authors", ";").alias("authors"))


@query(f"""WITH {views.KB} SELECT title, year, 'https://arxiv.org/abs/' || pos AS url, abstract, CASE WHEN pos % 3 > 0 THEN year || '-05-06' END AS date FROM kb WHERE type = 'paper' AND title <> ''""")
def arxiv_records(spark, d):
    """Atom feeds (SRC5): white space squeezed, ids under https, dates from the time of publication."""
    at = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    published = F.concat(F.col("year").cast("string"), F.when(F.col("pos") % 3 > 0, "-05-06T00:00:00Z").otherwise(""))
    entry = F.concat(
        F.lit("<entry><id> http://arxiv.org/abs/"), F.col("pos").cast("string"), F.lit("</id><title>  "), F.replace(safe(F.col("title")), F.lit(" "), F.lit("  ")), F.lit(" </title><summary> "),
        F.replace(safe(F.col("abstract")), F.lit(" "), F.lit("\t ")), F.lit("</summary><published>"), published, F.lit("</published></entry>"),
    )
    feeds = views.kb(spark, d).where("type = 'paper'").groupBy(F.expr("pos div 500")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    feeds.select("value").write.option("maxRecordsPerFile", 1).text(at)  # a file is one feed
    return ingest.arxiv(spark, at).select("title", "year", "url", "abstract", "date")


@query(f"""WITH {views.KB} SELECT title, year, CASE WHEN pos % 3 > 0 THEN 'Journal' END AS venue, CASE WHEN pos % 8 > 0 THEN 'https://doi.org/10.1/' || pos ELSE 'https://openalex.org/W' || pos END AS url, abstract,
    CASE WHEN pos % 8 > 0 THEN 'https://doi.org/10.1/' || pos END AS doi, year || '-07-01' AS date, 'A. Writer' AS authors, cited_by FROM kb WHERE type = 'paper'""")
def openalex_records(spark, d):
    """OpenAlex responses (SRC6): abstracts come as words with their places and are put together again."""
    k = views.kb(spark, d).where("type = 'paper'")
    w = k.select("pos", F.posexplode(F.split("abstract", " ")).alias("p", "w")).groupBy("pos", "w").agg(F.collect_list("p").alias("ps"))
    index = w.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("inverted"))  # words of one page
    person = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    body = F.struct(
        F.concat(F.lit("https://openalex.org/W"), F.col("pos").cast("string")).alias("id"), F.when(F.col("pos") % 8 > 0, F.concat(F.lit("https://doi.org/10.1/"), F.col("pos").cast("string"))).alias("doi"), "title",
        F.col("year").alias("publication_year"), F.concat(F.col("year").cast("string"), F.lit("-07-01")).alias("publication_date"), F.col("cited_by").alias("cited_by_count"), F.col("inverted").alias("abstract_inverted_index"),
        F.array(person(F.lit("A. Writer")), person(F.lit(None).cast("string"))).alias("authorships"), F.when(F.col("pos") % 3 > 0, F.struct(F.struct(F.lit("Journal").alias("display_name")).alias("source"))).alias("primary_location"),
    )
    out = ingest.openalex(landed(spark, k.join(index, "pos"), body, ingest.OPENALEX, '{"results":'))
    return out.select("title", "year", "venue", "url", "abstract", "doi", "date", F.array_join("authors", ";").alias("authors"), "cited_by")


@query(f"""WITH {views.KB} SELECT publication_number, title, date, CAST(substr(date, 1, 4) AS INTEGER) AS year, jurisdiction, cpc FROM (
    SELECT CASE WHEN pos % 3 = 0 THEN 'US' || (1000000 + pos) || 'B2' ELSE 'EP' || (2000000 + pos) || 'A1' END AS publication_number, title, year || '-03-04' AS date, CASE WHEN pos % 3 = 0 THEN 'US' ELSE 'EP' END AS jurisdiction,
           CASE WHEN pos % 2 = 1 THEN 'H04L41/08' ELSE '' END || CASE WHEN pos % 2 = 1 THEN ';' ELSE '' END || 'H04W' || (pos % 9 + 1) || '/10' AS cpc FROM kb WHERE type = 'patent' AND pos % 7 > 0)""")
def api_records(spark, d):
    """Responses of a patent service (SRC7): zero padding of US numbers goes, rows without a number are left out."""
    number = F.when(F.col("pos") % 7 == 0, F.lit("")).when(F.col("pos") % 3 == 0, F.concat(F.lit("US0"), (F.col("pos") + 1000000).cast("string"), F.lit("B2"))).otherwise(F.concat(F.lit("EP"), (F.col("pos") + 2000000).cast("string"), F.lit("A1")))
    code = lambda c: F.struct(c.alias("keyValue"))
    cpc = F.array(code(F.when(F.col("pos") % 2 == 1, F.lit(" H04L41/08 ")).otherwise("")), code(F.concat(F.lit("H04W"), (F.col("pos") % 9 + 1).cast("string"), F.lit("/10"))))
    body = F.struct(F.struct(number.alias("doc-number"), F.concat(F.col("year").cast("string"), F.lit("0304")).alias("date")).alias("publication-reference"), F.struct(F.col("title").alias("title")).alias("patent-title"), F.struct(cpc.alias("cpc")).alias("classifications-cpc"))
    out = ingest.patent_api(responses(spark, d, body, "type = 'patent'", ingest.PATENT_API, '{"hits":'))
    return out.select("publication_number", "title", "date", "year", "jurisdiction", F.concat_ws(";", "cpc").alias("cpc"))


@query("""SELECT 'EP' || o_orderkey || 'A1' AS publication_number, 'Title & ' || o_custkey AS title, 'Text of ' || o_orderpriority AS abstract, strftime(o_orderdate, '%Y-%m-%d') AS publication_date, 'EP' AS jurisdiction
  FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P'""")
def patent_page_records(spark, d):
    """Orders as landed pages of patents (SRC8); pages without an abstract or a date are left out."""
    o = views.table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "F", F.concat(F.lit('<time itemprop="publicationDate" datetime="'), day, F.lit('">x</time>'))).otherwise(F.concat(F.lit('<meta name="DC.date" content="'), day, F.lit('" scheme="issue">')))
    text_ = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.concat(F.lit("<abstract lang='en'><p>Text of\n "), "o_orderpriority", F.lit("</p></abstract>")))
    html = F.concat(F.lit('<html><meta name="DC.title" content="Title &amp; '), F.col("o_custkey").cast("string"), F.lit('">'), date, text_, F.lit("</html>"))
    return ingest.patent_pages(o.select(F.concat(F.lit("EP"), F.col("o_orderkey").cast("string"), F.lit("A1")).alias("publication_number"), html.alias("html")))


# --- cases as they come in ----------------------------------------------------------------------------------


@query(f"""WITH {views.CODED}, c AS (SELECT p_partkey AS case_id, CASE WHEN p_size % 10 > 0 THEN 'US' || p_partkey || 'B1' END AS patent_id FROM part), n AS (SELECT pos, count(*) AS codes FROM cl GROUP BY 1)
  SELECT case_id, patent_id, CASE WHEN patent_id IS NULL THEN 'missing reference' WHEN corp.pos IS NULL THEN 'unknown reference' END AS error, CASE WHEN patent_id IS NOT NULL AND corp.pos IS NOT NULL THEN CAST(o_orderdate AS DATE) END AS cutoff,
         CASE WHEN patent_id IS NOT NULL AND corp.pos IS NOT NULL THEN coalesce(codes, 0) END AS n_features
  FROM c LEFT JOIN corp ON corp.pos = case_id LEFT JOIN orders ON o_orderkey = corp.pos LEFT JOIN n ON n.pos = corp.pos""")
def reference_cases(spark, d):
    """Cases that name a record: its date as the cutoff and its codes as features, or what is wrong (JN11, FLT12)."""
    c = views.table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") % 10 > 0, F.concat(F.lit("US"), F.col("p_partkey").cast("string"), F.lit("B1"))).alias("patent_id"))
    r = views.coded_corpus(spark, d).withColumns({"title": F.lit("t"), "abstract": F.lit("a"), "filing_date": F.lit(None).cast("date")})
    out = score.reference_cases(c, r)
    return out.select("case_id", "patent_id", "error", F.col("ref_date").alias("cutoff"), F.when(F.col("error").isNull(), F.size("code_features")).cast("long").alias("n_features"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_returnflag || l_linestatus AS f FROM lineitem),
  ok AS (SELECT k, n, p, row_number() OVER (PARTITION BY k ORDER BY n, p, f) AS r, least(16, n * 4) AS idlen, least(120, 50 * n) AS textlen, f FROM l WHERE n % 5 > 0 AND f <> 'RF')
  SELECT o_orderkey AS case_id, CAST(count(ok.k) AS BIGINT) AS n_features, CAST(coalesce(sum(idlen), 0) AS BIGINT) AS id_chars, CAST(coalesce(sum(textlen), 0) AS BIGINT) AS text_chars
  FROM orders LEFT JOIN ok ON ok.k = o_orderkey AND r <= 3 WHERE o_orderkey IN (SELECT k FROM l) GROUP BY 1""")
def case_input_clean(spark, d):
    """Features that callers send, of an order's lines: malformed ones go, then the first three stay, ids and texts cut (CLN14)."""
    f = F.concat("l_returnflag", "l_linestatus")
    sent = F.struct(F.when(F.col("l_linenumber") % 5 > 0, F.expr("repeat('F', cast(l_linenumber * 4 as int))")).alias("id"), F.when(f == "RF", "").otherwise(F.rpad(F.lit("x"), (50 * F.col("l_linenumber")).cast("int"), F.lit("y"))).alias("text"), F.lit(None).cast("string").alias("feature_id"))
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", f.alias("f"), sent.alias("s")))), lambda x: x["s"]).alias("features"))  # lines of one order
    out = score.clean_features(rows, 3)
    chars = lambda name: F.aggregate("features", F.lit(0).cast("long"), lambda n, x: n + F.length(x[name]))
    return out.select("case_id", F.size("features").cast("long").alias("n_features"), chars("id").alias("id_chars"), chars("text").alias("text_chars"))
