"""White space, concentration and cross-tabs over the classified records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import classes, features, landscape, schemes
from lacuna.plans import views
from lacuna.plans.registry import query

CUTOFF = "1996-12-31"
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def base(spark: SparkSession, d: str, fine: bool = False) -> tuple[DataFrame, DataFrame]:
    r = classes.grouped(views.cls(spark, d), classes.fine_group if fine else classes.main_group).withColumn("origin", F.when(F.col("pos") % 10 == 0, "kb").otherwise("corpus"))
    return r, classes.top_groups(r)


PAIRS = """,
  pair AS (SELECT x.rank AS ra, y.rank AS rb, count(*) AS patents, count(*) FILTER (WHERE x.pos % 10 <> 0) AS corpus FROM touch x JOIN touch y ON x.pos = y.pos AND x.rank < y.rank GROUP BY 1, 2),
  side AS (SELECT rank, count(*) AS side FROM touch GROUP BY 1),
  scan AS (
    SELECT a.g AS a, b.g AS b, coalesce(patents, 0) AS patents, coalesce(corpus, 0) AS corpus, coalesce(patents, 0) - coalesce(corpus, 0) AS knowledge_base,
           coalesce(sa.side, 0) AS side_a_patents, coalesce(sb.side, 0) AS side_b_patents,
           floor(coalesce(sa.side, 0) * coalesce(sb.side, 0) / (SELECT count(*) FROM cls)::DOUBLE * 10 + 0.5) / 10 AS expected,
           CASE WHEN coalesce(sa.side, 0) * coalesce(sb.side, 0) > 0 THEN floor(coalesce(patents, 0) / (sa.side * sb.side / (SELECT count(*) FROM cls)::DOUBLE) * 100 + 0.5) / 100 END AS lift,
           CASE WHEN a.g = 'Brand#13' OR b.g = 'Brand#13' THEN 'moved' END AS caveat, a.rank AS ra, b.rank AS rb
    FROM top a JOIN top b ON a.rank < b.rank LEFT JOIN pair ON pair.ra = a.rank AND pair.rb = b.rank
    LEFT JOIN side sa ON sa.rank = a.rank LEFT JOIN side sb ON sb.rank = b.rank)"""
MOVED = {"Brand#13": "moved"}


def scan(spark: SparkSession, d: str, fine: bool = False) -> DataFrame:
    return classes.white_space(*base(spark, d, fine), MOVED)


@query(f"WITH {views.CLS}{PAIRS} SELECT * FROM scan")
def whitespace_scan(spark, d):
    return scan(spark, d)


@query(f"WITH {views.CLS_FINE}{PAIRS} SELECT * FROM scan")
def whitespace_scan_fine(spark, d):
    return scan(spark, d, True)


@query(f"WITH {views.CLS}{PAIRS} SELECT * FROM scan WHERE side_a_patents >= 50 AND side_b_patents >= 50 ORDER BY caveat IS NOT NULL, coalesce(lift, 0), patents, ra, rb LIMIT 8")
def whitespace_candidates(spark, d):
    return classes.candidates(scan(spark, d), 8, 50)


@query(f"WITH {views.CLS}{PAIRS} SELECT * FROM scan ORDER BY patents DESC, ra, rb LIMIT 3")
def whitespace_most_crowded(spark, d):
    return classes.most_crowded(scan(spark, d))


def _side(g: str) -> str:
    return f"(SELECT DISTINCT cls.* FROM cls JOIN grp ON grp.pos = cls.pos WHERE grp.g = '{g}')"


@query(f"""WITH {views.CLS},
  s AS (SELECT pos, publication_number, CAST(year(publication_date) AS INTEGER) AS y, pos IN (SELECT pos FROM grp WHERE g = 'Brand#13') AS a, pos IN (SELECT pos FROM grp WHERE g = 'Brand#22') AS b FROM cls),
  r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY y DESC, pos) AS r FROM s WHERE a OR b)
  SELECT list(publication_number ORDER BY r) FILTER (WHERE a AND b AND r <= 6) AS combined, CAST([] AS VARCHAR[]) AS newest_side_a, CAST([] AS VARCHAR[]) AS newest_side_b,
         count(*) FILTER (WHERE a AND b AND y > 1994 AND y <= 1999) AS last5, count(*) FILTER (WHERE a AND b AND y > 1989 AND y <= 1994) AS previous5 FROM r""")
def whitespace_pair_detail(spark, d):
    return classes.pair_detail(base(spark, d)[0], "Brand#13", "Brand#22", 2000)


TOP_APPLICANTS = "SELECT company_name AS name, count(*) AS patents, min(pos) AS f FROM {0} GROUP BY 1"


@query(f"WITH {views.CLS}, t AS ({TOP_APPLICANTS.format(_side('Brand#13'))}) SELECT name, patents, CAST(row_number() OVER (ORDER BY patents DESC, f) AS INTEGER) AS rank FROM t QUALIFY rank <= 5")
def top_applicants_grouped(spark, d):
    r = base(spark, d)[0].where(F.array_contains("groups", "Brand#13")).withColumn("applicant", classes.applicant("company"))
    return classes.top_applicants(r).drop("key")


@query(f"""WITH {views.CLS}, ta AS (SELECT *, row_number() OVER (ORDER BY patents DESC, f) AS r FROM ({TOP_APPLICANTS.format(_side('Brand#13'))})),
  tb AS (SELECT *, row_number() OVER (ORDER BY patents DESC, f) AS r FROM ({TOP_APPLICANTS.format(_side('Brand#22'))}))
  SELECT ta.name, ta.patents AS side_a, tb.patents AS side_b FROM ta JOIN tb ON ta.name = tb.name WHERE ta.r <= 40 AND tb.r <= 8 ORDER BY ta.r LIMIT 5""")
def pair_applicants_both_sides(spark, d):
    r = base(spark, d)[0].withColumn("applicant", classes.applicant("company"))
    return classes.both_sides(r.where(F.array_contains("groups", "Brand#13")), r.where(F.array_contains("groups", "Brand#22")))


@query(f"""WITH {views.CLS}, n AS (SELECT x.g, count(DISTINCT x.pos) AS n FROM touch x JOIN grp y ON x.pos = y.pos AND y.g = 'Brand#13' JOIN cls ON cls.pos = x.pos WHERE publication_date <= DATE '{CUTOFF}' GROUP BY 1)
  SELECT 'Brand#13' AS ipc_a, top.g AS ipc_b, coalesce(n.n, 0) AS count, CASE WHEN coalesce(n.n, 0) = 0 THEN 'gap' WHEN n.n < 5 THEN 'developing' ELSE 'crowded' END AS status
  FROM top LEFT JOIN n ON n.g = top.g WHERE top.g <> 'Brand#13' ORDER BY coalesce(n.n, 0), rank LIMIT 12""")
def case_group_combinations(spark, d):
    r, top = base(spark, d)
    return classes.combinations_of(r.where(F.col("publication_date") <= F.lit(CUTOFF).cast("date")), top, "Brand#13")


def labelled(spark: SparkSession, d: str, fine: bool = False) -> tuple[DataFrame, DataFrame]:
    r, top = base(spark, d, fine)
    return classes.subtech(r, top), top


@query(f"""WITH {views.CLS_FINE}, j AS (SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'POLAR']) AS jurisdiction),
  l AS (SELECT g AS subtech FROM top UNION ALL SELECT 'OTHER')
  SELECT l.subtech, j.jurisdiction FROM l, j WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.subtech = l.subtech AND sub.jurisdiction = j.jurisdiction)""")
def zero_filing_cells(spark, d):
    return classes.zero_cells(*labelled(spark, d, True), [*REGIONS, "POLAR"])


MATRIX = """,
  n AS (SELECT x.rank AS ra, y.rank AS rb, count(*) AS n FROM touch x JOIN touch y ON x.pos = y.pos WHERE x.rank <= 4 AND y.rank BETWEEN 5 AND 8 GROUP BY 1, 2),
  cell AS (SELECT a.g AS row, b.g AS col, coalesce(n.n, 0) AS n FROM top a JOIN top b ON a.rank <= 4 AND b.rank BETWEEN 5 AND 8 LEFT JOIN n ON n.ra = a.rank AND n.rb = b.rank),
  m AS (SELECT l[CAST(floor((len(l) - 1) / 2) AS BIGINT) + 1] AS m FROM (SELECT list(n ORDER BY n) AS l FROM cell WHERE n > 0))
  SELECT row, col, n, CASE WHEN n = 0 THEN 'gap' WHEN n <= (SELECT m FROM m) THEN 'developing' ELSE 'crowded' END AS status FROM cell"""


@query(f"WITH {views.CLS_FINE}{MATRIX}")
def default_matrix_status(spark, d):
    return classes.matrix(*base(spark, d, True))


@query(f"""WITH {views.CODED}, pair AS (SELECT x.rank AS ra, y.rank AS rb, count(*) AS patents, count(*) FILTER (WHERE x.origin = 'corpus') AS corpus FROM touch x JOIN touch y ON x.pos = y.pos AND x.origin = y.origin AND x.rank < y.rank GROUP BY 1, 2),
  side AS (SELECT g, rank, (SELECT count(*) FROM touch WHERE touch.rank = top.rank) AS side FROM top), note AS (SELECT g, 'reclassified: ' || g || ' is now ' || moved_to AS caveat FROM moved)
  SELECT a.g AS a, b.g AS b, coalesce(patents, 0) AS patents, coalesce(corpus, 0) AS corpus, coalesce(patents, 0) - coalesce(corpus, 0) AS knowledge_base, a.side AS side_a_patents, b.side AS side_b_patents,
         floor(a.side * b.side / people.n::DOUBLE * 10 + 0.5) / 10 AS expected, CASE WHEN a.side * b.side > 0 THEN floor(coalesce(patents, 0) / (a.side * b.side / people.n::DOUBLE) * 100 + 0.5) / 100 END AS lift,
         coalesce(na.caveat, nb.caveat) AS caveat, a.rank AS ra, b.rank AS rb
  FROM side a JOIN side b ON a.rank < b.rank LEFT JOIN pair ON pair.ra = a.rank AND pair.rb = b.rank LEFT JOIN note na ON na.g = a.g LEFT JOIN note nb ON nb.g = b.g, people""")
def whitespace_with_external(spark, d):
    return schemes.scan(views.coded_corpus(spark, d), views.coded_store(spark, d))


@query(f"WITH {views.CODED} SELECT people.n AS population, (SELECT count(*) FROM corp) AS corpus, (SELECT count(*) FROM ext) AS kb_patents, (SELECT count(*) FROM ext WHERE classified) AS kb_classified FROM people")
def whitespace_population(spark, d):
    corpus = views.coded_corpus(spark, d)
    return schemes.sizes(corpus, schemes.external_patents(views.coded_store(spark, d), corpus))


@query(f"WITH {views.CODED} SELECT ipc, cpc, n, records, round(n / records::DOUBLE, 6) AS share FROM walk")
def class_crosswalk(spark, d):
    return schemes.crosswalk(views.coded_corpus(spark, d), views.coded_store(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {views.CODED} SELECT g, moved_to, records, round(kept_share, 6) AS kept_share, 'reclassified: ' || g || ' is now ' || moved_to AS caveat FROM moved")
def reclassified_groups(spark, d):
    walk = schemes.crosswalk(views.coded_corpus(spark, d), views.coded_store(spark, d))
    return schemes.reclassified(walk).withColumn("kept_share", F.round("kept_share", 6))


@query(f"""WITH {views.CODED}, e AS (SELECT DISTINCT pos, g, rank FROM touch WHERE origin = 'knowledge_base')
  SELECT a.g AS row, b.g AS col, (SELECT count(*) FROM e x JOIN e y ON x.pos = y.pos WHERE x.rank = a.rank AND y.rank = b.rank) AS n FROM top a, top b WHERE a.rank <= 4 AND b.rank BETWEEN 5 AND 8""")
def external_matrix_counts(spark, d):
    corpus = views.coded_corpus(spark, d)
    top = classes.top_groups(classes.grouped(corpus))
    return schemes.matrix_counts(schemes.external_patents(views.coded_store(spark, d), corpus), top.where("rank <= 4"), top.where("rank between 5 and 8"))


@query(f"WITH {views.CLS} SELECT subtech, count(*) FILTER (WHERE publication_date <= DATE '{CUTOFF}') AS n, count(*) FILTER (WHERE publication_date <= DATE '{CUTOFF}' AND jurisdiction = 'ASIA') AS n_asia FROM sub GROUP BY 1")
def subtech_counts(spark, d):
    r = labelled(spark, d)[0]
    before = F.col("publication_date") <= F.lit(CUTOFF).cast("date")
    return r.groupBy("subtech").agg(F.count(F.when(before, 1)).alias("n"), F.count(F.when(before & (F.col("jurisdiction") == "ASIA"), 1)).alias("n_asia"))


@query(f"""WITH {views.CLS}, l AS (SELECT g AS subtech, rank AS label_pos FROM top UNION ALL SELECT 'OTHER', 13), c AS (SELECT l.*, (SELECT count(*) FROM sub WHERE sub.subtech = l.subtech) AS n FROM l)
  SELECT subtech, n, label_pos, round(1 - (row_number() OVER (ORDER BY n, label_pos) - 1) / (count(*) OVER () - 1), 6) AS value FROM c""")
def density_factor(spark, d):
    r, top = labelled(spark, d)
    n = r.groupBy("subtech").agg(F.count("*").alias("n"))
    rows = top.select(F.col("g").alias("subtech"), F.col("rank").alias("label_pos")).unionByName(spark.createDataFrame([("OTHER", 13)], "subtech string, label_pos int"))
    out = classes.density(rows.join(F.broadcast(n), "subtech", "left").fillna(0, ["n"]).select("subtech", "n", "label_pos"))
    return out.withColumn("value", F.round("value", 6))


@query(f"""WITH {views.CLS}, c AS (SELECT subtech, segment AS name, count(*) AS c, min(pos) AS f FROM sub WHERE publication_date <= DATE '{CUTOFF}' GROUP BY 1, 2)
  SELECT subtech, CAST(sum(c) AS BIGINT) AS total, round(sum(c * c) / (sum(c) * sum(c))::DOUBLE * 10000, 6) AS hhi, arg_min(name, (-c, f)) AS top_applicant, round(max(c) / sum(c)::DOUBLE, 6) AS top_share,
         round(greatest(0, 1 - sum(c * c) / (sum(c) * sum(c))::DOUBLE), 6) AS value FROM c GROUP BY 1""")
def applicant_hhi(spark, d):
    r = labelled(spark, d)[0].where(F.col("publication_date") <= F.lit(CUTOFF).cast("date"))
    out = classes.concentration(r, ["subtech"], "segment")
    return out.select("subtech", "total", F.round("hhi", 6).alias("hhi"), "top_applicant", F.round("top_share", 6).alias("top_share"), F.round("value", 6).alias("value"))


@query(f"WITH {views.CLS} SELECT subtech, count(*) AS n, round(count(*) / (SELECT count(*) FROM sub)::DOUBLE, 6) AS rate FROM sub GROUP BY 1")
def group_base_rates(spark, d):
    return features.base_rates(labelled(spark, d)[0]).withColumn("rate", F.round("rate", 6))


@query(f"WITH {views.CLS} SELECT count(*) AS n, count(*) FILTER (WHERE publication_date <= DATE '{CUTOFF}') AS n_before_cutoff FROM cls")
def corpus_meta(spark, d):
    return views.cls(spark, d).agg(F.count("*").alias("n"), F.count(F.when(F.col("publication_date") <= F.lit(CUTOFF).cast("date"), 1)).alias("n_before_cutoff"))


@query(f"""WITH {views.CLS}, g AS (SELECT CAST(year(publication_date) AS INTEGER) AS year, jurisdiction, count(*) AS n FROM cls WHERE publication_date IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT year, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY 1), c AS (SELECT year, total, CAST(sum(total) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM t)
  SELECT g.year, jurisdiction, n, total, cumulative FROM g JOIN c ON c.year = g.year""")
def yearly_trend(spark, d):
    return landscape.trend(views.cls(spark, d))


@query(f"""WITH {views.CLS}, b AS (SELECT company_name, count(*) AS n, min(pos) AS f FROM cls GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 7)
  SELECT jurisdiction, coalesce(b.company_name, 'other') AS applicant, count(*) AS n FROM cls LEFT JOIN b ON b.company_name = cls.company_name GROUP BY 1, 2""")
def region_applicant_top_other(spark, d):
    return landscape.top_or_other(views.cls(spark, d))


@query(f"""WITH {views.CLS} SELECT company_name AS applicant, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE jurisdiction = '{r}') AS {chr(34)}{r}{chr(34)}" for r in REGIONS)}
  FROM cls GROUP BY 1 ORDER BY 2 DESC, min(pos) LIMIT 10""")
def applicant_ranking(spark, d):
    return landscape.ranking(views.cls(spark, d), REGIONS)


@query(f"WITH {views.CLS} SELECT category, jurisdiction, count(*) AS n FROM cls GROUP BY 1, 2")
def category_region_matrix(spark, d):
    return views.cls(spark, d).groupBy("category", "jurisdiction").agg(F.count("*").alias("n"))


@query(f"""WITH {views.CLS}, y AS (SELECT jurisdiction, segment, CAST(year(publication_date) AS INTEGER) AS year FROM cls)
  SELECT jurisdiction, segment, year, count(*) AS n, CAST(grouping(jurisdiction, segment, year) AS INTEGER) AS levels FROM y GROUP BY CUBE (jurisdiction, segment, year)""")
def kpi_cross_tabs(spark, d):
    return landscape.cross(views.cls(spark, d).withColumn("year", F.year("publication_date")), "jurisdiction", "segment", "year")


@query(f"""WITH {views.CLS}, h AS (SELECT * FROM sub WHERE primary_group = 'Brand#13'), c AS (SELECT segment AS name, count(*) AS n, min(pos) AS f FROM h GROUP BY 1)
  SELECT name, n, floor(n / (SELECT count(*) FROM h)::DOUBLE * 100 * 10 + 0.5) / 10 AS share_pct, (SELECT floor(sum(n * n) / (sum(n) * sum(n))::DOUBLE * 10000 + 0.5) FROM c) AS hhi FROM c ORDER BY n DESC, f LIMIT 5""")
def applicant_shares(spark, d):
    return landscape.applicants(labelled(spark, d)[0].where("primary_group = 'Brand#13'"), F.col("segment"))


@query(f"""WITH {views.CLS} SELECT CAST(y.year AS INTEGER) AS year, count(h.pos) AS n FROM (SELECT unnest(range(1990, 2000)) AS year) y LEFT JOIN (SELECT * FROM sub WHERE primary_group = 'Brand#13') h ON year(h.publication_date) = y.year GROUP BY 1""")
def group_years(spark, d):
    return landscape.years(labelled(spark, d)[0].where("primary_group = 'Brand#13'"), 1999)


