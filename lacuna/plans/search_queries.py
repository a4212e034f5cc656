"""Concept search, features and retrieval over the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.operators import features, landscape, match
from lacuna.plans import views
from lacuna.plans.registry import query
from lacuna.sources.tables import written

#: Synonym groups whose terms occur in the tables.
GROUPS = [["erin", "erin", "erines"], ["thble", "thble", "th ble"], ["under", "under"], ["thor", "thor", "thorre"], ["nden", "nden"]]
QUERY = "erin thor"
TERMS = ["erin", "thble", "rehe", "ster", "nden", "esing", "thndly", "ntly", "under"]
LAST = 2024


def searchable(spark: SparkSession, d: str) -> DataFrame:
    return match.searchable(views.rec(spark, d))


SEARCH_FORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[-_/]+', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"
NORM = f"{views.REC}, s AS (SELECT *, {SEARCH_FORM.format('title')} AS nt, {SEARCH_FORM.format('abstract')} AS na FROM rec)"


def q(p: str) -> str:
    return p.replace("'", "''")


def sql_match(concepts: list[match.Concept]) -> str:
    has = [f"(regexp_matches(nt, '{q(match.concept_pattern(c))}') OR regexp_matches(na, '{q(match.concept_pattern(c))}'))" for c in concepts]
    return " AND ".join(has) or "false"


def sql_score(concepts: list[match.Concept], text_: str) -> str:
    each = [f"CASE WHEN regexp_matches(nt, '{q(match.concept_pattern(c))}') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(na, '{q(match.concept_pattern(c))}') THEN 1.0::DOUBLE ELSE 0 END" for c in concepts]
    lit = match.literal(text_)
    return " + ".join([*each, f"CASE WHEN contains(nt, '{lit}') OR contains(na, '{lit}') THEN 0.5::DOUBLE ELSE 0 END"])


C = match.parse(QUERY, GROUPS)
HITS = f"{NORM}, hit AS (SELECT *, {sql_score(C, QUERY)} AS score FROM s WHERE {sql_match(C)})"


@query(f"WITH {HITS} SELECT pos, publication_number, score FROM hit")
def concept_search(spark, d):
    return match.search(searchable(spark, d), QUERY, GROUPS).select("pos", "publication_number", "score")


@query(f"WITH {HITS} SELECT pos, score FROM hit WHERE jurisdiction = 'EN' AND year BETWEEN 2008 AND 2020 ORDER BY score DESC, publication_date DESC NULLS LAST, pos LIMIT 5 OFFSET 5")
def faceted_search_page(spark, d):
    hits = match.search(match.facets(searchable(spark, d), "EN", 2008, 2020), QUERY, GROUPS)
    return match.page(match.relevance(hits), 2).select("pos", "score")


@query(f"WITH {HITS} SELECT page, pos, score FROM (SELECT pos, score, CAST((row_number() OVER (ORDER BY score DESC, publication_date DESC NULLS LAST, pos) - 1) // 20 + 1 AS INTEGER) AS page FROM hit) WHERE page <= 4")
def keyset_pages(spark, d):
    """The first four pages of 20, each asked for by the last row of the one before (SRT3)."""
    hits = written(match.search(searchable(spark, d), QUERY, GROUPS).select("pos", "score", "publication_date"), "hits")
    out, last = None, None
    for number in range(1, 5):
        page = match.page_after(hits, last, 20)
        rows = page.select(F.lit(number).alias("page"), "pos", "score")
        out = rows if out is None else out.unionByName(rows)
        last = match.cursor(page)
        if last is None:
            break
    return out


@query(f"WITH {HITS} SELECT pos, publication_date FROM hit ORDER BY publication_date ASC NULLS FIRST, pos LIMIT 20")
def search_resort(spark, d):
    return match.by_date(match.search(searchable(spark, d), QUERY, GROUPS), newest=False).limit(20).select("pos", "publication_date")


@query(f"WITH {views.REC} SELECT pos FROM rec WHERE contains(lower(coalesce(title, '')), 'erin') OR contains(lower(coalesce(abstract, '')), 'erin') OR contains(lower(company_name), 'erin')")
def substring_search(spark, d):
    r = views.rec(spark, d).withColumn("assignees", F.array("company_name"))
    return match.substring_facets(r, "erin").select("pos")


@query(f"WITH {views.REC} SELECT DISTINCT jurisdiction FROM rec")
def facet_values(spark, d):
    return views.rec(spark, d).select("jurisdiction").distinct()


@query(f"WITH {HITS} SELECT count(*) AS hits, count(*) FILTER (WHERE NOT (contains(nt, 'erin thor') OR contains(na, 'erin thor'))) AS by_synonym FROM hit")
def synonym_gain(spark, d):
    return match.synonym_gain(searchable(spark, d), QUERY, GROUPS)


@query(f"WITH {NORM} " + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) AS n, {i} AS i FROM s WHERE {sql_match(match.parse(t, GROUPS))}" for i, t in enumerate(TERMS)))
def term_match_counts(spark, d):
    return match.term_counts(searchable(spark, d), TERMS, GROUPS)


PROPOSED = ["thor", "under", "nden", "under", "zzzz", "thble"]


@query(f"WITH {NORM}, t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) AS n, {i} AS i FROM s WHERE {sql_match(match.parse(t, GROUPS))}" for i, t in enumerate(["under", "nden", "zzzz", "thble"])) + ") SELECT term, n, i FROM t WHERE n > 0 ORDER BY n DESC, i LIMIT 8")
def verified_terms(spark, d):
    return match.verified(searchable(spark, d), QUERY, PROPOSED, 8, GROUPS)


@query(f"WITH {NORM} " + " UNION ALL ".join(f"SELECT '{c.label}' AS concept, count(*) AS n FROM s WHERE jurisdiction = 'EN' AND {sql_match([c])}" for c in match.parse("erin zzzz under", GROUPS)))
def zero_hit_breakdown(spark, d):
    return match.breakdown(match.facets(searchable(spark, d), "EN"), "erin zzzz under", GROUPS)


@query(f"WITH {NORM} " + " UNION ALL ".join(f"SELECT '{t}' AS query, pos, {sql_score(match.parse(t, GROUPS), t)} AS score FROM s WHERE {sql_match(match.parse(t, GROUPS))}" for t in ("erin", "under thor")))
def several_queries(spark, d):
    return match.concept_frame(searchable(spark, d), ["erin", "under thor"], GROUPS)


@query()
def normalise_unicode(spark, d):
    """NFKC is in no SQL dialect; tests compare with Python's own."""
    return match.searchable(views.rec(spark, d), nfkc=True).select("pos", "norm_title")


# --- landscape of a topic ---------------------------------------------------------------------------------


@query(f"WITH {HITS} SELECT CAST(y.y AS INTEGER) AS year, count(hit.pos) AS n FROM (SELECT unnest(range({LAST - 9}, {LAST + 1})) AS y) y LEFT JOIN hit ON hit.year = y.y GROUP BY 1")
def topic_landscape_years(spark, d):
    return landscape.years(match.search(searchable(spark, d), QUERY, GROUPS), LAST)


@query(f"WITH {HITS} SELECT j.j AS jurisdiction, count(hit.pos) AS n FROM (SELECT unnest(['EN', 'FR', 'DE', 'ES', 'IT']) AS j) j LEFT JOIN hit ON hit.jurisdiction = j.j GROUP BY 1")
def topic_landscape_regions(spark, d):
    return landscape.regions(match.search(searchable(spark, d), QUERY, GROUPS), ["EN", "FR", "DE", "ES", "IT"])


@query(f"WITH {HITS} SELECT company_name AS name, count(*) AS n FROM hit GROUP BY 1 ORDER BY 2 DESC, min(pos) LIMIT 5")
def topic_landscape_classes(spark, d):
    return landscape.top(match.search(searchable(spark, d), QUERY, GROUPS), F.col("company_name"))


KQUERY = "erin"
KC = match.parse(KQUERY, GROUPS)
KNORM = f"{views.KB}, ks AS (SELECT *, {SEARCH_FORM.format('title')} AS nt, {SEARCH_FORM.format('abstract')} AS na FROM kb), khit AS (SELECT *, {sql_score(KC, KQUERY)} AS score FROM ks WHERE {sql_match(KC)})"
WINDOWED = "count(*) FILTER (WHERE year BETWEEN {0} AND {1})"


@query(f"""WITH {HITS}, {KNORM},
  p AS (SELECT count(*) AS m, {WINDOWED.format(LAST - 4, LAST)} AS r, {WINDOWED.format(LAST - 9, LAST - 5)} AS b FROM hit),
  k AS (SELECT count(*) AS m, {WINDOWED.format(LAST - 4, LAST)} AS r, {WINDOWED.format(LAST - 9, LAST - 5)} AS b FROM khit WHERE type = 'paper')
  SELECT p.m AS patents_matched, floor(p.m / (SELECT count(*) FROM rec)::DOUBLE * 1000 + 0.5) / 10 AS share_pct, CASE WHEN p.b > 0 THEN floor((p.r - p.b) / p.b::DOUBLE * 1000 + 0.5) / 10 END AS patents_growth_pct,
         k.m AS papers_matched, CASE WHEN k.b > 0 THEN floor((k.r - k.b) / k.b::DOUBLE * 1000 + 0.5) / 10 END AS papers_growth_pct, CASE WHEN p.r > 0 THEN floor(k.r / p.r::DOUBLE * 100 + 0.5) / 100 END AS papers_per_patent FROM p, k""")
def topic_landscape_summary(spark, d):
    r, k = searchable(spark, d), match.searchable(views.kb(spark, d))
    return landscape.summary(match.search(r, QUERY, GROUPS), r, match.search(k.where("type = 'paper'"), KQUERY, GROUPS), LAST)


@query(f"WITH {KNORM} SELECT pos, title, cited_by FROM khit WHERE type = 'paper' ORDER BY cited_by DESC, year DESC, pos LIMIT 5")
def topic_papers_cited(spark, d):
    k = match.searchable(views.kb(spark, d).where("type = 'paper'"))
    return landscape.most_cited(match.search(k, KQUERY, GROUPS)).select("pos", "title", "cited_by")


@query(f"""WITH {KNORM}, p AS (SELECT * FROM khit WHERE type = 'patent' AND assignee IS NOT NULL), c AS (SELECT assignee AS name, count(*) AS n, min(pos) AS f FROM p GROUP BY 1)
  SELECT name, n, floor(n / (SELECT count(*) FROM p)::DOUBLE * 100 * 10 + 0.5) / 10 AS share_pct, (SELECT floor(sum(n * n) / (sum(n) * sum(n))::DOUBLE * 10000 + 0.5) FROM c) AS hhi FROM c ORDER BY n DESC, f LIMIT 5""")
def topic_external(spark, d):
    k = match.searchable(views.kb(spark, d).where("type = 'patent'"))
    return landscape.applicants(match.search(k, KQUERY, GROUPS).where("assignee is not null"), F.col("assignee"))


@query(f"WITH {KNORM} SELECT pos, country, score FROM (SELECT *, jurisdiction AS country FROM khit WHERE type = 'patent' AND year BETWEEN 2006 AND 2022) ORDER BY score DESC, year DESC, pos LIMIT 20")
def external_search(spark, d):
    k = match.knowledge_facets(match.searchable(views.kb(spark, d).where("type = 'patent'")), 2006, 2022)
    return match.search(k, KQUERY, GROUPS).orderBy(F.desc("score"), F.desc("year"), "pos").limit(20).select("pos", "country", "score")


@query(f"""WITH {KNORM}, h AS (SELECT jurisdiction FROM khit WHERE type = 'patent' AND year BETWEEN 2006 AND 2022)
  SELECT country, count(*) AS n, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM kb WHERE type = 'patent') AS population FROM (SELECT jurisdiction AS country FROM h) GROUP BY 1""")
def external_search_facets(spark, d):
    """What stands beside a page of the store's search: hits by country, all hits, all patents (AGG31)."""
    k = match.searchable(views.kb(spark, d).where("type = 'patent'"))
    hits = match.search(match.knowledge_facets(k, 2006, 2022), KQUERY, GROUPS)
    return match.facet_counts(hits, k, "country")


# --- features ---------------------------------------------------------------------------------------------

TAX = views.TAXONOMY


def sql_term(t: str, case: bool) -> str:
    """Matches of a term: RE2's \\b is ASCII, as needed."""
    return rf"len(regexp_extract_all(body, '{'' if case else '(?i)'}\b{t}\b'))"


TF = f"{views.REC}, b AS (SELECT *, title || ' ' || abstract AS body FROM rec), f AS (" + " UNION ALL ".join(
    f"SELECT pos, '{i}' AS feature_id, CAST({' + '.join([sql_term(x, False) for x in p] + [sql_term(x, True) for x in a])} AS INTEGER) AS tf, {n} AS n, publication_date, jurisdiction, year FROM b" for n, (i, _, p, a) in enumerate(TAX)
) + "), df AS (SELECT * FROM f WHERE tf > 0)"


@query(f"WITH {TF} SELECT pos, feature_id, tf, n FROM df")
def doc_features(spark, d):
    return features.document_features(views.rec(spark, d), TAX)


@query(f"WITH {TF} SELECT feature_id, count(*) AS df FROM df GROUP BY 1")
def feature_df(spark, d):
    return features.frequency(features.document_features(views.rec(spark, d), TAX))


GRID = "grid AS (SELECT DISTINCT x.feature_id AS f1, y.feature_id AS f2, x.n AS n1, y.n AS n2 FROM (SELECT DISTINCT feature_id, n FROM f) x JOIN (SELECT DISTINCT feature_id, n FROM f) y ON x.n < y.n)"


@query(f"""WITH {TF}, {GRID}, c AS (SELECT x.n AS n1, y.n AS n2, count(*) AS c FROM df x JOIN df y ON x.pos = y.pos AND x.n < y.n GROUP BY 1, 2)
  SELECT f1, f2, coalesce(c, 0) AS documents, grid.n1, grid.n2 FROM grid LEFT JOIN c ON c.n1 = grid.n1 AND c.n2 = grid.n2""")
def feature_pair_counts(spark, d):
    return features.pair_counts(views.rec(spark, d), TAX)


@query(f"""WITH {TF}, r AS (SELECT jurisdiction AS subtech, count(*) / (SELECT count(*) FROM rec)::DOUBLE AS rate FROM rec GROUP BY 1),
  c AS (SELECT feature_id, jurisdiction AS subtech, count(*) AS c, min(pos) AS first FROM df WHERE jurisdiction IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY feature_id) AS total FROM c),
  l AS (SELECT t.*, CASE WHEN c >= 3 THEN c / total::DOUBLE / rate END AS lift FROM t JOIN r ON r.subtech = t.subtech)
  SELECT feature_id, subtech AS "group", c AS support, round(lift, 6) AS lift FROM l QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY lift DESC NULLS LAST, c DESC, first) = 1""")
def feature_group_lift(spark, d):
    r = views.rec(spark, d).withColumn("subtech", F.col("jurisdiction"))
    return features.group_lift(features.document_features(r, TAX, "subtech"), features.base_rates(r)).withColumn("lift", F.round("lift", 6))


TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9-]{{2,}}'), lambda t: NOT list_contains([{1}], t))"
STOP = ", ".join(f"'{w}'" for w in text.STOP_A)


LABEL_TOKENS = TOKENS.format("title", ", ".join(f"'{w}'" for w in text.STOP_LABEL))


@query(f"""WITH {views.REC}, w AS (SELECT DISTINCT jurisdiction AS subtech, pos, unnest({LABEL_TOKENS}) AS word FROM rec),
  c AS (SELECT subtech, word, count(*) AS c, min(pos) AS first FROM w GROUP BY 1, 2), a AS (SELECT *, sum(c) OVER (PARTITION BY word) AS total FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY subtech ORDER BY c DESC, first, word) AS r FROM a WHERE c >= 4 AND c / total::DOUBLE >= 0.3)
  SELECT subtech, string_agg(upper(word[1]) || word[2:], ' ' ORDER BY r) AS label FROM r WHERE r <= 2 GROUP BY 1""")
def distinctive_labels(spark, d):
    from lacuna.operators.classes import distinctive_words

    return distinctive_words(views.rec(spark, d).withColumn("subtech", F.col("jurisdiction")))
