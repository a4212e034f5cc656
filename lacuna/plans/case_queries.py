"""Cases: retrieval, factors, score, sensitivity, back test."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.operators import clean, features, notes, retrieve, score
from lacuna.plans import views
from lacuna.plans.registry import query
from lacuna.plans.search_queries import GRID, STOP, TF, TOKENS, sql_term
from lacuna.sources.tables import written

TAX = views.TAXONOMY


def cases(spark: SparkSession, d: str, asked: bool = True) -> DataFrame:
    """Records as cases at their own date: with `asked` those whose id is divisible by 100, the queries put to all
    records, else every record."""
    r = views.rec(spark, d).where("pos % 100 = 0") if asked else views.rec(spark, d)
    return r.select(F.col("pos").alias("case_id"), F.concat_ws(" ", "title", "abstract").alias("text"), F.col("publication_date").alias("cutoff"), F.year("publication_date").alias("cutoff_year"), F.lit("FR").alias("target"))


def store(spark: SparkSession, d: str) -> DataFrame:
    """Pages as the store's records, every third with a date; their places come after the records'."""
    k = views.kb(spark, d).withColumn("date", F.when(F.col("pos") % 3 == 0, F.make_date("year", F.lit(6), F.lit(30))))
    return k.withColumn("pos", F.col("pos") + 10_000_000_000)


def known(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that the corpus holds already (here: stored ones with pos % 4 = 3)."""
    return views.kb(spark, d).where("pos % 4 = 3").select("publication_number")


def own_features(rows: DataFrame, docs: DataFrame, records: DataFrame) -> DataFrame:
    return features.extract(rows, TAX, features.frequency(docs), records.agg(F.count("*").alias("N")))


class Asked:
    """What a search run needs, each worked out once: features of all records, the cases' own, the index, the queries. With `every` each
    record is a case."""

    def __init__(self, spark: SparkSession, d: str, shifts: list[int] | None = None, search: bool = True, every: bool = False):
        self.spark, self.d = spark, d
        own = cases(spark, d, not every).withColumns({"of": F.col("case_id"), "run": F.lit(0)})
        self.cases = retrieve.at_dates(own.drop("of", "run"), shifts) if shifts else own
        self.cutoffs = self.cases.select("case_id", "cutoff")
        self.records = views.rec(spark, d).withColumn("assignees", F.array("company_name"))
        self.docs = written(features.document_features(self.records, TAX, "publication_date"), "features")
        self.own = written(own_features(self.cases, self.docs, self.records), "own")
        if search:
            self.index = retrieve.Index(self.records)
            self.terms = written(features.document_terms(self.cases, self.index.frequencies(), self.index.size()), "terms")
            self.asked = written(retrieve.case_tokens(self.own, features.taxonomy_frame(spark, TAX), self.terms), "asked")

    @cached_property
    def store(self) -> DataFrame:
        """The store's pages, taken apart once."""
        return written(store(self.spark, self.d), "store")

    def external(self) -> DataFrame:
        """The cases' patents of the store, ranked beside the corpus."""
        said = retrieve.store_tokens(self.own, features.taxonomy_frame(self.spark, TAX), self.terms)
        extra = written(retrieve.stored_patents(self.store, said, self.cutoffs, known(self.spark, self.d)), "extra")
        return self.index.beside(extra, self.asked, self.cutoffs)


CASES_ = f"""{TF}, cdf AS (SELECT feature_id, count(*) AS df FROM df GROUP BY 1),
  cs AS (SELECT pos AS case_id, body AS text, publication_date AS cutoff, year AS cutoff_year FROM b WHERE @which),
  ex AS (
    SELECT df.pos AS case_id, df.feature_id, tf, n, tf * (ln((SELECT count(*) FROM rec)::DOUBLE / (1 + coalesce(cdf.df, 0))) + 1) AS score
    FROM df LEFT JOIN cdf ON cdf.feature_id = df.feature_id WHERE @which),
  cf AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, n) AS INTEGER) AS rank FROM ex QUALIFY rank <= 8),
  tk AS (SELECT pos, publication_date, unnest({TOKENS.format('body', STOP)}) AS token FROM b),
  po AS (SELECT pos, token, count(*) AS tf, any_value(publication_date) AS publication_date FROM tk GROUP BY 1, 2),
  ln AS (SELECT pos, publication_date, len({TOKENS.format('body', STOP)}) AS len FROM b),
  pdf AS (SELECT token, count(*) AS df FROM po GROUP BY 1),
  dt AS (
    SELECT po.pos AS case_id, po.token, (1 + ln(tf)) * ln((SELECT count(*) FROM rec) / pdf.df::DOUBLE) AS weight FROM po JOIN pdf ON pdf.token = po.token WHERE @which),
  terms AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(weight, 9) DESC, token) AS INTEGER) AS rank FROM dt QUALIFY rank <= 20),
  tw AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{t.lower()}')" for i, label, p, a in TAX for t in dict.fromkeys(x.lower() for x in [label, *p, *a]) if len(t) >= 3 and t not in text.STOP_A)}) AS v(feature_id, token)),
  qt AS (SELECT case_id, token FROM terms UNION SELECT case_id, token FROM cf JOIN tw ON tw.feature_id = cf.feature_id)"""

CASES, ALL_CASES = CASES_.replace("@which", "pos % 100 = 0"), CASES_.replace("@which", "true")


def sql_bm25(docs: str, lens: str, extra: str = "") -> str:
    """Statistics per case over what its cutoff lets in, said directly."""
    return f"""
  st AS (SELECT case_id, cutoff, count(*) AS N, sum(len) / count(*)::DOUBLE AS avgdl FROM cs JOIN {lens} l ON l.publication_date <= cs.cutoff GROUP BY 1, 2),
  hp AS (SELECT qt.case_id, p.pos, p.token, p.tf{extra}, st.N, st.avgdl FROM qt JOIN st ON st.case_id = qt.case_id JOIN {docs} p ON p.token = qt.token AND p.publication_date <= st.cutoff),
  hd AS (SELECT case_id, token, count(*) AS df FROM hp GROUP BY 1, 2),
  hs AS (
    SELECT hp.case_id, hp.pos{extra}, sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score
    FROM hp JOIN hd ON hd.case_id = hp.case_id AND hd.token = hp.token JOIN {lens} l ON l.pos = hp.pos GROUP BY ALL),
  hr AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, pos) AS INTEGER) AS rank, max(score) OVER (PARTITION BY case_id) AS best FROM hs)"""


BM25, ALL_BM25 = (f"{c},{sql_bm25('po', 'ln')}" for c in (CASES, ALL_CASES))


@query(f"WITH {ALL_CASES} SELECT case_id, 'F' || rank AS id, feature_id, tf, round(score, 6) AS score, rank FROM cf")
def extract_features(spark, d):
    r = views.rec(spark, d)
    docs = written(features.document_features(r, TAX), "features")
    return own_features(cases(spark, d, False), docs, r).select("case_id", "id", "feature_id", "tf", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ALL_CASES} SELECT case_id, token, round(weight, 6) AS weight, rank FROM terms")
def document_terms(spark, d):
    index = retrieve.Index(views.rec(spark, d))
    return features.document_terms(cases(spark, d, False), index.frequencies(), index.size()).withColumn("weight", F.round("weight", 6))


@query(f"WITH {ALL_BM25} SELECT case_id, pos, rank, floor(score / best * 1000 + 0.5) / 1000 AS similarity FROM hr WHERE rank <= 5")
def bm25_top5(spark, d):
    a = Asked(spark, d, every=True)
    return a.index.as_of(a.asked, a.cutoffs).select("case_id", "pos", "rank", "similarity")


def with_external(spark: SparkSession, d: str) -> DataFrame:
    """Records and dated pages as one pool; pages' places come after the records'."""
    k = views.kb(spark, d).select((F.col("pos") + 10_000_000_000).alias("pos"), "title", "abstract", F.make_date("year", F.lit(6), F.lit(30)).alias("publication_date"))
    return views.rec(spark, d).select("pos", "title", "abstract", "publication_date").unionByName(k)


EXT = f"""{ALL_CASES}, {views.KB}, kt AS (SELECT pos + 10000000000 AS pos, make_date(year, 6, 30) AS publication_date, {TOKENS.format("(title || ' ' || abstract)", STOP)} AS ts FROM kb),
  po2 AS (SELECT pos, token, tf, publication_date FROM po UNION ALL SELECT pos, token, count(*), any_value(publication_date) FROM (SELECT pos, publication_date, unnest(ts) AS token FROM kt) GROUP BY 1, 2),
  ln2 AS (SELECT * FROM ln UNION ALL SELECT pos, publication_date, len(ts) FROM kt),{sql_bm25('po2', 'ln2')},
  er AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY rank) AS INTEGER) AS place FROM hr WHERE pos >= 10000000000)"""


@query(f"WITH {EXT} SELECT case_id, pos, place FROM er WHERE place <= 5")
def bm25_with_external(spark, d):
    """Records and all dated pages as one pool; of the pages, the first five of each case. The pool gives the statistics, pages
    alone are searched."""
    a = Asked(spark, d, every=True)
    hits = retrieve.Index(with_external(spark, d)).as_of(a.asked, a.cutoffs, 5, F.col("pos") >= 10_000_000_000)
    return hits.select("case_id", "pos", F.col("rank").alias("place"))


STOP_B = ", ".join(f"'{w}'" for w in retrieve.STOP_B)
KTOK = "list_filter(regexp_extract_all(lower(title || ' ' || title || ' ' || abstract), '[a-z0-9][a-z0-9-]{1,}'), lambda t: NOT list_contains([" + STOP_B + "], t) AND NOT regexp_matches(t, '^[0-9]+$'))"
KQ = "kq AS (SELECT * FROM (VALUES (1, 'erin'), (1, 'thor'), (1, 'under'), (2, 'nden'), (2, 'ster')) AS v(case_id, token)), kc AS (SELECT 1 AS case_id, DATE '2020-12-31' AS cutoff UNION ALL SELECT 2, DATE '2015-12-31')"


def knowledge_hits(spark: SparkSession, d: str, k: int, kind: str | None) -> DataFrame:
    docs = views.kb(spark, d).withColumn("date", F.when(F.col("pos") % 3 == 0, F.make_date("year", F.lit(6), F.lit(30))))
    qs = spark.createDataFrame([(1, "erin"), (1, "thor"), (1, "under"), (2, "nden"), (2, "ster")], "case_id int, token string")
    cuts = spark.createDataFrame([(1, "2020-12-31"), (2, "2015-12-31")], "case_id int, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    return retrieve.in_store(docs, qs, cuts, k, kind)


def sql_knowledge(kind: str) -> str:
    return f"""{views.KB}, kd AS (SELECT pos, type, year, CASE WHEN pos % 3 = 0 THEN make_date(year, 6, 30) END AS date, {KTOK} AS ts FROM kb), {KQ},
  kp AS (SELECT pos, token, count(*) AS tf FROM (SELECT pos, unnest(ts) AS token FROM kd) GROUP BY 1, 2), kf AS (SELECT token, count(*) AS df FROM kp GROUP BY 1),
  ks AS (SELECT count(*) AS N, avg(len(ts)) AS avgdl FROM kd),
  kh AS (
    SELECT kq.case_id, kd.pos, sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))) * (1 + count(*) / (SELECT count(*) FROM kq z WHERE z.case_id = kq.case_id)::DOUBLE) AS score
    FROM kq JOIN kc ON kc.case_id = kq.case_id JOIN kp ON kp.token = kq.token JOIN kf ON kf.token = kq.token JOIN kd ON kd.pos = kp.pos, ks
    WHERE {kind} AND CASE WHEN date IS NOT NULL THEN date <= cutoff ELSE kd.year <= year(cutoff) END GROUP BY 1, 2),
  kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, pos) AS INTEGER) AS rank, max(score) OVER (PARTITION BY case_id) AS best FROM kh)"""


@query(f"WITH {sql_knowledge('true')} SELECT case_id, pos, rank, floor(score / best * 1000 + 0.5) / 1000 AS similarity FROM kr WHERE rank <= 10")
def bm25_knowledge(spark, d):
    return knowledge_hits(spark, d, 10, None).select("case_id", "pos", "rank", "similarity")


def sql_bundle(kind: str, most: int) -> str:
    where = f"type = '{kind}'"
    return f"(WITH {sql_knowledge(where)} SELECT * FROM kr WHERE rank <= {most})"


@query(f"""SELECT 'paper' AS section, case_id, pos, rank FROM {sql_bundle('paper', 8)}
  UNION ALL SELECT 'patent', case_id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS p FROM {sql_bundle('patent', 12)} WHERE pos % 4 <> 3) WHERE p <= 6""")
def prior_art_bundle(spark, d):
    """Stored papers and patents of a query: the first 8 papers; of the first 12 patents, the first six that the corpus
    doesn't hold."""
    k = views.kb(spark, d).select("pos", "publication_number")
    papers = knowledge_hits(spark, d, 8, "paper").select("case_id", "pos", "rank")
    patents = clean.exclude_known(knowledge_hits(spark, d, 12, "patent").join(k, "pos"), known(spark, d), "none")
    patents = patents.withColumn("p", F.row_number().over(Window.partitionBy("case_id").orderBy("rank"))).where("p <= 6").select("case_id", "pos", "rank")
    return papers.select(F.lit("paper").alias("section"), "*").unionByName(patents.select(F.lit("patent").alias("section"), "*"))


def year_before(sql: str) -> str:
    return sql.replace("publication_date AS cutoff, year AS cutoff_year", "make_date(year - 1, 12, 31) AS cutoff, CAST(year - 1 AS INTEGER) AS cutoff_year")


@query(f"""SELECT * FROM (WITH {BM25} SELECT count(*) AS cases, CAST(sum(hit) AS BIGINT) AS found, round(sum(hit) / count(*)::DOUBLE, 6) AS recall FROM (SELECT case_id, CASE WHEN EXISTS (SELECT 1 FROM hr WHERE hr.case_id = cs.case_id AND hr.pos = cs.case_id AND rank <= 5) THEN 1 ELSE 0 END AS hit FROM cs)) a,
  (SELECT count(*) AS hits_before, count(n.pos) AS still_hits, count(*) FILTER (WHERE b.late) AS leaked
   FROM (WITH {year_before(BM25)} SELECT hr.case_id, hr.pos, rec.publication_date > cs.cutoff AS late FROM hr JOIN rec ON rec.pos = hr.pos JOIN cs ON cs.case_id = hr.case_id WHERE rank <= 5) b
   LEFT JOIN (WITH {BM25} SELECT case_id, pos FROM hr WHERE rank <= 5) n ON n.case_id = b.case_id AND n.pos = b.pos) c""")
def known_item_recall(spark, d):
    """Each case's own record among its hits; and the same index asked at the end of the year before."""
    a = Asked(spark, d)
    before = a.cutoffs.withColumn("cutoff", F.make_date(F.year("cutoff") - 1, F.lit(12), F.lit(31)))
    # one search at both dates
    both = a.cutoffs.withColumn("_run", F.lit(0)).unionByName(before.withColumn("_run", F.lit(1))).withColumn("of", F.col("case_id")).withColumn("case_id", F.concat_ws("@", "case_id", "_run"))
    asked = a.asked.withColumnRenamed("case_id", "of").join(both.select("of", "case_id"), "of").select("case_id", "token")
    hits = a.index.as_of(asked, both.select("case_id", "cutoff")).join(both.select("case_id", "of", "_run"), "case_id").select(F.col("of").alias("case_id"), "pos", "_run")
    hits = written(hits, "hits")
    now, then = hits.where("_run = 0").drop("_run"), hits.where("_run = 1").drop("_run")
    out = retrieve.recall(now, a.cases.select("case_id", F.col("case_id").alias("pos")))
    leaks = retrieve.leaks(now, then, before, a.records.select("pos", "publication_date"))
    return out.withColumn("recall", F.round("recall", 6)).join(leaks, F.lit(True))


# --- factors ----------------------------------------------------------------------------------------------


class Scored(Asked):
    """A scoring run: besides, the matched records, listed or counted, and with `search` the evidence: the corpus's first five and the first
    five of the store's patents ranked beside it. Each is made when it is first asked for. `by` is what matched records are counted by."""

    def __init__(self, *args, by: tuple[str, ...] = ("year", "jurisdiction", "applicant"), **kwargs):
        super().__init__(*args, **kwargs)
        self.by = by

    @cached_property
    def shared(self) -> score.Shared:
        return score.Shared(self.own, self.docs)

    @cached_property
    def matched(self) -> DataFrame:
        return written(self.shared.matched_counts(self.cases, self.records, self.by), "matched")

    @cached_property
    def art(self) -> DataFrame:
        return written(retrieve.prior_art(self.index.as_of(self.asked, self.cutoffs), self.external()), "art")

    @cached_property
    def seen(self) -> DataFrame:
        told = self.store.where("type = 'patent'").join(self.art.select("pos").distinct(), "pos", "left_semi")
        return self.docs.select("pos", "feature_id").unionByName(features.document_features(told, TAX).select("pos", "feature_id"))

    def novelty(self) -> DataFrame:
        return score.novelty(self.own, self.art, self.seen)

    def background(self) -> DataFrame:
        """Pair counts at each distinct cutoff: pairs counted per day once, then joined with the cutoffs."""
        per_day = features.pairs_among(self.docs.where("publication_date is not null"), TAX, "publication_date").select("n1", "n2", F.col("publication_date").alias("day"), "documents")
        cut = self.cases.select("cutoff").distinct()
        grid = cut.join(F.broadcast(features.pair_grid(self.spark, TAX)), F.lit(True))
        n = retrieve.running_at(per_day, grid.select("n1", "n2", "cutoff"), ["n1", "n2"], ["documents"])
        return grid.join(n, ["cutoff", "n1", "n2"], "left").select("cutoff", F.coalesce("documents", F.lit(0)).alias("documents"))

    def crowding(self) -> DataFrame:
        return score.crowding(self.matched, self.cases, self.background())

    def regional(self) -> DataFrame:
        return score.regional(self.matched, self.cases, None, targets=["EN", "FR", "DE", "ES"])

    def temporal(self) -> DataFrame:
        field = self.records.groupBy("year").agg(F.count("*").alias("n"))
        return score.temporal(self.cases, self.shared.year_counts(self.records), field, self.matched, None)

    def factors(self) -> DataFrame:
        one = lambda df, name, fallback: df.select("case_id", F.lit(name).alias("factor"), "value", fallback.alias("is_fallback"))
        return (
            one(self.novelty(), "novelty", F.col("is_fallback"))
            .unionByName(one(self.crowding(), "crowding", F.lit(False)))
            .unionByName(one(self.temporal(), "temporal", F.col("is_fallback")))
            .unionByName(one(self.regional(), "regional", F.col("total") == 0))
        )


#: The store's search of each case, its patents that may be evidence, and their places beside the corpus.
ART = f"""{views.KB}, kd AS (SELECT pos + 10000000000 AS pos, type, year, publication_number, title || ' ' || abstract AS body, CASE WHEN pos % 3 = 0 THEN make_date(year, 6, 30) END AS date, pos % 4 = 3 AS known, {KTOK} AS ts FROM kb),
  sw AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{t}')" for i, label, p, a in TAX for t in dict.fromkeys(re.findall('[a-z0-9][a-z0-9-]+', label.lower())) if t not in retrieve.STOP_B)}) AS v(feature_id, token)),
  sq AS (SELECT case_id, token FROM terms WHERE NOT list_contains([{STOP_B}], token) UNION SELECT case_id, token FROM cf JOIN sw ON sw.feature_id = cf.feature_id),
  kp AS (SELECT pos, token, count(*) AS tf FROM (SELECT pos, unnest(ts) AS token FROM kd) GROUP BY 1, 2), kf AS (SELECT token, count(*) AS df FROM kp GROUP BY 1),
  kh AS (
    SELECT sq.case_id, kd.pos, sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))) * (1 + count(*) / (SELECT count(*) FROM sq z WHERE z.case_id = sq.case_id)::DOUBLE) AS score
    FROM sq JOIN cs ON cs.case_id = sq.case_id JOIN kp ON kp.token = sq.token JOIN kf ON kf.token = sq.token JOIN kd ON kd.pos = kp.pos, (SELECT count(*) AS N, avg(len(ts)) AS avgdl FROM kd) ks
    WHERE type = 'patent' AND CASE WHEN date IS NOT NULL THEN date <= cutoff ELSE kd.year <= year(cutoff) END GROUP BY 1, 2),
  kr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, pos) AS rank FROM kh),
  xd AS (SELECT kr.case_id, kr.pos, kr.rank, {TOKENS.format('body', STOP)} AS ts FROM kr JOIN kd ON kd.pos = kr.pos JOIN cs ON cs.case_id = kr.case_id WHERE rank <= 15 AND date IS NOT NULL AND date <= cutoff AND NOT known),
  xn AS (SELECT case_id, count(*) AS n, sum(len(ts)) AS l FROM xd GROUP BY 1),
  xp AS (SELECT case_id, pos, rank, len, token, count(*) AS tf FROM (SELECT case_id, pos, rank, len(ts) AS len, unnest(ts) AS token FROM xd) GROUP BY ALL),
  xq AS (SELECT xp.* FROM xp JOIN qt ON qt.case_id = xp.case_id AND qt.token = xp.token), xf AS (SELECT case_id, token, count(*) AS df FROM xq GROUP BY 1, 2),
  xs AS (
    SELECT xq.case_id, xq.pos, xq.rank, sum(ln(1 + (coalesce(st.N, 0) + xn.n - (coalesce(hd.df, 0) + xf.df) + 0.5) / (coalesce(hd.df, 0) + xf.df + 0.5)) * (tf * 2.5)
             / (tf + 1.5 * (0.25 + 0.75 * xq.len / ((coalesce(st.avgdl * st.N, 0) + xn.l) / (coalesce(st.N, 0) + xn.n)::DOUBLE)))) AS score
    FROM xq JOIN xn ON xn.case_id = xq.case_id JOIN xf ON xf.case_id = xq.case_id AND xf.token = xq.token LEFT JOIN st ON st.case_id = xq.case_id LEFT JOIN hd ON hd.case_id = xq.case_id AND hd.token = xq.token GROUP BY 1, 2, 3),
  art AS (
    SELECT case_id, pos, rank AS place FROM hr WHERE rank <= 5
    UNION ALL SELECT case_id, pos, CAST(5 + p AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, rank) AS p FROM xs WHERE score > 0) WHERE p <= 5),
  adf AS (SELECT pos, feature_id FROM df UNION ALL SELECT pos, feature_id FROM ({' UNION ALL '.join(f"SELECT pos, '{i}' AS feature_id, {' + '.join([sql_term(x, False) for x in p] + [sql_term(x, True) for x in a])} AS tf FROM kd" for i, _, p, a in TAX)}) WHERE tf > 0)"""
NOV = """ct AS (SELECT case_id, count(*) AS total FROM cf GROUP BY 1),
  mt AS (SELECT art.case_id, art.pos, art.place, count(cf.feature_id) AS c FROM art JOIN adf ON adf.pos = art.pos JOIN cf ON cf.case_id = art.case_id AND cf.feature_id = adf.feature_id GROUP BY 1, 2, 3),
  ja AS (SELECT art.case_id, art.pos, art.place, coalesce(mt.c, 0) / ct.total::DOUBLE AS j FROM art JOIN ct ON ct.case_id = art.case_id LEFT JOIN mt ON mt.case_id = art.case_id AND mt.pos = art.pos),
  bj AS (SELECT case_id, max(j) AS j, arg_max(pos, (j, place)) AS closest, count(*) AS n FROM ja GROUP BY 1),
  se AS (SELECT cf.case_id, count(DISTINCT cf.feature_id) AS seen FROM art JOIN adf ON adf.pos = art.pos JOIN cf ON cf.case_id = art.case_id AND cf.feature_id = adf.feature_id GROUP BY 1),
  nov AS (
    SELECT ct.case_id, CASE WHEN bj.j IS NULL THEN 0.5 ELSE 0.5::DOUBLE * greatest(0, least(1, 1 - bj.j)) + 0.5::DOUBLE * ((total - coalesce(seen, 0)) / total::DOUBLE) END AS value, bj.j IS NULL AS is_fallback,
           coalesce(bj.n, 0) AS evidence_count, closest, floor(bj.j * 100 + 0.5) AS overlap_pct, total - coalesce(seen, 0) AS unmatched, total
    FROM ct LEFT JOIN bj ON bj.case_id = ct.case_id LEFT JOIN se ON se.case_id = ct.case_id)"""
MATCHED = "ms AS (SELECT cf.case_id, df.pos, any_value(df.publication_date) AS publication_date, any_value(df.jurisdiction) AS jurisdiction FROM cf JOIN df ON df.feature_id = cf.feature_id JOIN cs ON cs.case_id = cf.case_id AND df.publication_date <= cs.cutoff GROUP BY 1, 2 HAVING count(*) >= 2)"
CROWD = f"""{GRID}, bg AS (
    SELECT cut.cutoff, grid.n1, grid.n2, (SELECT count(*) FROM df x JOIN df y ON x.pos = y.pos WHERE x.n = grid.n1 AND y.n = grid.n2 AND x.publication_date <= cut.cutoff) AS documents FROM (SELECT DISTINCT cutoff FROM cs) cut, grid),
  hc AS (SELECT cs.case_id, cs.cutoff, (SELECT count(*) FROM ms WHERE ms.case_id = cs.case_id) AS hits FROM cs),
  cr AS (SELECT case_id, hits, (count(*) FILTER (WHERE documents < hits) + 0.5::DOUBLE * count(*) FILTER (WHERE documents = hits)) / count(*) AS percentile FROM hc JOIN bg ON bg.cutoff = hc.cutoff GROUP BY 1, 2),
  cro AS (SELECT case_id, greatest(0, least(1, 1 - percentile)) AS value, hits, percentile FROM cr)"""
REGIO = """ra AS (SELECT ms.case_id, company_name AS name, count(*) AS c FROM ms JOIN rec ON rec.pos = ms.pos GROUP BY 1, 2), rh AS (SELECT case_id, CAST(sum(c) AS BIGINT) AS total, sum(c * c) / (sum(c) * sum(c))::DOUBLE * 10000 AS hhi FROM ra GROUP BY 1),
  reg AS (
    SELECT cs.case_id, 0.5::DOUBLE * CASE WHEN coalesce(t.n, 0) = 0 THEN 1 ELSE 0 END + 0.5::DOUBLE * CASE WHEN hhi IS NULL THEN 0.5 ELSE greatest(0, 1 - hhi / 10000) END AS value, 'FR' AS target, coalesce(t.n, 0) AS target_hits, coalesce(hhi, 0) AS hhi, coalesce(total, 0) AS total
    FROM cs LEFT JOIN rh ON rh.case_id = cs.case_id LEFT JOIN (SELECT case_id, count(*) AS n FROM ms WHERE jurisdiction = 'FR' GROUP BY 1) t ON t.case_id = cs.case_id)"""
TEMPO = """yc AS (SELECT case_id, year, count(*) AS n FROM (SELECT DISTINCT cf.case_id, df.pos, df.year FROM cf JOIN df ON df.feature_id = cf.feature_id) GROUP BY 1, 2), fy AS (SELECT year, count(*) AS n FROM rec GROUP BY 1),
  tv AS (
    SELECT cs.case_id, coalesce((SELECT n FROM yc WHERE yc.case_id = cs.case_id AND yc.year = cutoff_year - 4), 0) AS f, coalesce((SELECT n FROM yc WHERE yc.case_id = cs.case_id AND yc.year = cutoff_year), 0) AS l,
           coalesce((SELECT CAST(sum(n) AS BIGINT) FROM yc WHERE yc.case_id = cs.case_id AND yc.year BETWEEN cutoff_year - 4 AND cutoff_year), 0) AS papers, coalesce((SELECT n FROM fy WHERE fy.year = cutoff_year - 4), 0) AS ff,
           coalesce((SELECT n FROM fy WHERE fy.year = cutoff_year), 0) AS fl, (SELECT count(*) FROM ms WHERE ms.case_id = cs.case_id AND year(publication_date) BETWEEN cutoff_year - 4 AND cutoff_year) AS patents FROM cs),
  tem AS (
    SELECT case_id, CASE WHEN papers < 20 THEN 0.5 ELSE
             (CASE WHEN ff > 0 AND fl > 0 THEN greatest(0, least(1, 0.5 + 0.25 * log2(((l + 1) / (f + 1)::DOUBLE) / ((fl + 1) / (ff + 1)::DOUBLE))))
                   ELSE greatest(0, least(1, 0.5 + CASE WHEN f > 0 THEN (l - f) / f::DOUBLE WHEN l > 0 THEN 1 ELSE 0 END / 2)) END) * CASE WHEN patents > papers THEN 0.5 ELSE 1 END END::DOUBLE AS value,
           papers < 20 AS is_fallback, papers AS evidence_count FROM tv)"""


@query(f"WITH {BM25}, {ART}, {NOV} SELECT case_id, round(value, 6) AS value, is_fallback, evidence_count, closest, overlap_pct, unmatched, total FROM nov")
def novelty(spark, d):
    return Scored(spark, d).novelty().withColumn("value", F.round("value", 6))


def note_facts(s: Scored) -> DataFrame:
    pairs = len(TAX) * (len(TAX) - 1) // 2
    return notes.facts(s.novelty(), s.crowding(), s.regional(), s.temporal(), s.cases, pairs)


@query(f"WITH {BM25}, {ART} SELECT case_id, pos, place FROM art")
def evidence(spark, d):
    return Scored(spark, d).art


@query(f"""WITH {BM25}, {ART}, m AS (SELECT art.case_id, art.pos, string_agg('F' || cf.rank, ',' ORDER BY cf.rank) AS matched FROM art JOIN adf ON adf.pos = art.pos JOIN cf ON cf.case_id = art.case_id AND cf.feature_id = adf.feature_id GROUP BY 1, 2)
  SELECT art.case_id, art.pos, place, coalesce(matched, '') AS matched FROM art LEFT JOIN m ON m.case_id = art.case_id AND m.pos = art.pos""")
def evidence_features(spark, d):
    s = Scored(spark, d)
    return score.matched_features(s.own, s.art, s.seen).withColumn("matched", F.concat_ws(",", "matched"))


@query(f"WITH {ALL_CASES}, {MATCHED} SELECT case_id, pos FROM ms")
def matched_set(spark, d):
    s = Scored(spark, d, search=False, every=True)
    return s.shared.matched(s.cases, s.records)


@query(f"WITH {ALL_CASES}, {MATCHED}, {CROWD} SELECT case_id, round(value, 6) AS value, hits, round(percentile, 6) AS percentile FROM cro")
def crowding(spark, d):
    return Scored(spark, d, search=False, every=True, by=()).crowding().withColumns({"value": F.round("value", 6), "percentile": F.round("percentile", 6)})


@query(f"WITH {ALL_CASES}, {MATCHED}, {REGIO} SELECT case_id, round(value, 6) AS value, target, target_hits, round(hhi, 6) AS hhi, total FROM reg")
def regional(spark, d):
    return Scored(spark, d, search=False, every=True, by=("jurisdiction", "applicant")).regional().withColumns({"value": F.round("value", 6), "hhi": F.round("hhi", 6)})


@query(f"WITH {ALL_CASES}, {MATCHED}, {TEMPO} SELECT case_id, round(value, 6) AS value, is_fallback, evidence_count FROM tem")
def temporal(spark, d):
    return Scored(spark, d, search=False, every=True, by=("year",)).temporal().withColumn("value", F.round("value", 6))


@query(f"WITH {ALL_CASES}, yc AS (SELECT case_id, year, count(*) AS n FROM (SELECT DISTINCT cf.case_id, df.pos, df.year FROM cf JOIN df ON df.feature_id = cf.feature_id) GROUP BY 1, 2) SELECT case_id, year, n FROM yc")
def year_counts(spark, d):
    s = Scored(spark, d, search=False, every=True)
    return s.shared.year_counts(s.records)


FACTORS = f"""{BM25}, {ART}, {NOV}, {MATCHED}, {CROWD}, {REGIO}, {TEMPO},
  fa AS (
    SELECT case_id, 'novelty' AS factor, value, is_fallback, 0.40::DOUBLE AS weight FROM nov UNION ALL SELECT case_id, 'crowding', value, false, 0.25::DOUBLE FROM cro
    UNION ALL SELECT case_id, 'temporal', value, is_fallback, 0.20::DOUBLE FROM tem UNION ALL SELECT case_id, 'regional', value, total = 0, 0.15::DOUBLE FROM reg),
  bd AS (SELECT case_id, factor, floor(value * 100 + 0.5) / 100 AS value, weight, floor(value * weight * 100 * 10 + 0.5) / 10 AS weighted, is_fallback FROM fa)"""
GRADE = "CASE WHEN {0} >= 70 THEN 'High' WHEN {0} >= 45 THEN 'Medium' ELSE 'Low' END"


@query(f"WITH {FACTORS}, sc AS (SELECT case_id, CAST(floor(round(sum(weighted), 6) + 0.5) AS INTEGER) AS score, count(*) FILTER (WHERE is_fallback) >= 2 AS insufficient_evidence FROM bd GROUP BY 1) SELECT case_id, score, {GRADE.format('score')} AS grade, insufficient_evidence FROM sc")
def opportunity_score(spark, d):
    return score.combine(written(Scored(spark, d).factors(), "factors"))[1]


@query(f"""WITH {FACTORS}, ba AS (SELECT case_id, {GRADE.format('floor(round(sum(weighted), 6) + 0.5)')} AS base FROM bd GROUP BY 1), de AS (SELECT unnest([-0.1::DOUBLE, -0.05::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS delta),
  mo AS (SELECT case_id, factor AS target, weight AS w0, delta, greatest(0, least(1, weight + delta)) AS w1 FROM bd, de),
  te AS (SELECT mo.case_id, target AS factor, delta, CAST(floor(round(sum(value * CASE WHEN bd.factor = target THEN w1 ELSE weight * ((1 - w1) / (1 - w0)) END * 100), 6) + 0.5) AS INTEGER) AS score FROM mo JOIN bd ON bd.case_id = mo.case_id GROUP BY 1, 2, 3),
  gr AS (SELECT te.*, {GRADE.format('score')} AS grade, base FROM te JOIN ba ON ba.case_id = te.case_id)
  SELECT case_id, factor, delta, score, grade, grade <> base AS grade_changed, NOT bool_or(grade <> base) OVER (PARTITION BY case_id) AS robust FROM gr""")
def sensitivity(spark, d):
    return score.sensitivity(score.combine(written(Scored(spark, d).factors(), "factors"))[0])


def back_cases(sql: str) -> str:
    return sql.replace("publication_date AS cutoff, year AS cutoff_year", "CAST(publication_date - INTERVAL 24 MONTH AS DATE) AS cutoff, CAST(year - 2 AS INTEGER) AS cutoff_year")


SCORES = f"sc AS (SELECT case_id, CAST(floor(round(sum(weighted), 6) + 0.5) AS INTEGER) AS score FROM bd GROUP BY 1)"
GRADED = f"SELECT bd.*, score, {GRADE.format('score')} AS grade FROM bd JOIN sc ON sc.case_id = bd.case_id"


@query(f"""SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.factor, b.factor) AS factor, a.value AS value_now, b.value AS value_then, floor((a.value - b.value) * 100 + 0.5) / 100 AS change,
         a.score AS score_now, b.score AS score_then, a.grade AS grade_now, b.grade AS grade_then
  FROM (WITH {FACTORS}, {SCORES} {GRADED}) a FULL JOIN (WITH {back_cases(FACTORS)}, {SCORES} {GRADED}) b ON a.case_id = b.case_id AND a.factor = b.factor""")
def backtest(spark, d):
    s = Scored(spark, d, [0, 24])
    breakdown, scores = score.combine(written(s.factors(), "factors"))
    return score.back_test(breakdown, scores.select("case_id", "score", "grade"), s.cases.select("case_id", "of", "run"), 0, 24)


GROUPS_ = "g AS (SELECT case_id, jurisdiction AS ipc, count(*) AS c, min(rank) AS first FROM cf JOIN rec r ON r.pos = (cf.case_id + cf.rank) GROUP BY 1, 2), sub AS (SELECT case_id, CASE WHEN arg_max(ipc, (c, -first)) = 'DE' THEN 'OTHER' ELSE arg_max(ipc, (c, -first)) END AS subtech FROM g GROUP BY 1)"


@query(f"""WITH {ALL_CASES}, k AS (SELECT case_id, count(*) AS n FROM cf GROUP BY 1), {GROUPS_}
  SELECT cs.case_id, CASE WHEN coalesce(n, 0) = 0 THEN 'needs_confirmation: features' WHEN n < 2 THEN 'insufficient' WHEN coalesce(subtech, 'OTHER') = 'OTHER' THEN 'other' ELSE 'scored' END AS status
  FROM cs LEFT JOIN k ON k.case_id = cs.case_id LEFT JOIN sub ON sub.case_id = cs.case_id""")
def case_status(spark, d):
    """Here a class is the language of the record `rank` places behind the case; German ones count as no known class."""
    f = grouped_features(spark, d)
    of = features.dominant_group(f).withColumn("subtech", F.when(F.col("subtech") == "DE", "OTHER").otherwise(F.col("subtech")))
    own = f.groupBy("case_id").agg(F.collect_list(F.struct("id", "feature_id")).alias("features"))
    c = cases(spark, d, False).join(own, "case_id", "left").join(of, "case_id", "left")
    return c.select("case_id", score.status(F.col("features"), F.col("cutoff_year"), F.col("subtech")).alias("status"))


def grouped_features(spark: SparkSession, d: str) -> DataFrame:
    r = views.rec(spark, d)
    docs = written(features.document_features(r, TAX), "features")
    f = own_features(cases(spark, d, False), docs, r).drop("ipc")
    classed = r.select(F.col("pos").alias("_pos"), F.col("jurisdiction").alias("ipc"))
    return written(f.join(classed, F.col("case_id") + F.col("rank") == F.col("_pos"), "left").drop("_pos"), "own")


@query(f"WITH {ALL_CASES}, g AS (SELECT case_id, r.jurisdiction AS ipc, count(*) AS c, min(rank) AS first FROM cf JOIN rec r ON r.pos = (cf.case_id + cf.rank) GROUP BY 1, 2) SELECT case_id, arg_max(ipc, (c, -first)) AS subtech FROM g GROUP BY 1")
def case_group(spark, d):
    return features.dominant_group(grouped_features(spark, d).where("ipc is not null"))


NOTES = f"""{BM25}, {ART}, {NOV}, {MATCHED}, {CROWD}, {REGIO}, {TEMPO},
  nt AS (
    SELECT case_id, 'novelty' AS factor, 'en' AS lang, CASE WHEN is_fallback THEN 'Nothing comparable was found before the cutoff, so novelty stays neutral at 0.5.'
      ELSE closest || ' is the closest prior art: it shares ' || CAST(overlap_pct AS BIGINT) || '% of the features. ' || unmatched || ' of ' || total || ' features are in none of the ' || evidence_count || ' records compared.' END AS note FROM nov
    UNION ALL SELECT case_id, 'novelty', 'zh', CASE WHEN is_fallback THEN '基準日前查無可比對的前案，新穎性取中性值 0.5。' ELSE '最接近的前案為 ' || closest || '，特徵重疊 ' || CAST(overlap_pct AS BIGINT) || '%；' || total || ' 項特徵中 ' || unmatched || ' 項不見於所比對的 ' || evidence_count || ' 件資料。' END FROM nov
    UNION ALL SELECT case_id, 'crowding', 'en', hits || ' records before the cutoff have two or more of the features, the ' || p || CASE WHEN p % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p % 10 = 1 THEN 'st' WHEN p % 10 = 2 THEN 'nd' WHEN p % 10 = 3 THEN 'rd' ELSE 'th' END || ' percentile among 120 pairs of features.'
      FROM (SELECT *, CAST(floor(percentile * 100 + 0.5) AS BIGINT) AS p FROM cro)
    UNION ALL SELECT case_id, 'crowding', 'zh', '基準日前有 ' || hits || ' 件資料具備兩項以上特徵，於 120 組特徵配對中位居第 ' || CAST(floor(percentile * 100 + 0.5) AS BIGINT) || ' 百分位。' FROM cro
    UNION ALL SELECT case_id, 'regional', 'en', CASE WHEN total = 0 THEN 'No record matches before the cutoff, so concentration stays neutral at 0.5.' WHEN target_hits = 0 THEN 'No matching record in ' || target || ': a regional gap. Concentration of applicants over ' || total || ' records is ' || CAST(floor(hhi + 0.5) AS BIGINT) || '.'
      ELSE target_hits || ' matching records in ' || target || '. Concentration of applicants over ' || total || ' records is ' || CAST(floor(hhi + 0.5) AS BIGINT) || '.' END FROM reg
    UNION ALL SELECT case_id, 'regional', 'zh', CASE WHEN total = 0 THEN '基準日前沒有相符資料，集中度取中性值 0.5。' WHEN target_hits = 0 THEN target || ' 沒有相符資料，為區域缺口；' || total || ' 件資料的申請人集中度為 ' || CAST(floor(hhi + 0.5) AS BIGINT) || '。'
      ELSE target || ' 有 ' || target_hits || ' 件相符資料；' || total || ' 件資料的申請人集中度為 ' || CAST(floor(hhi + 0.5) AS BIGINT) || '。' END FROM reg
    UNION ALL SELECT tem.case_id, 'temporal', 'en', CASE WHEN is_fallback THEN 'Only ' || evidence_count || ' publications match from ' || (cutoff_year - 4) || ' to ' || cutoff_year || ', fewer than 20, so the trend stays neutral at 0.5.'
      ELSE evidence_count || ' publications match from ' || (cutoff_year - 4) || ' to ' || cutoff_year || '; the trend against the field gives ' || printf('%.2f', value) || '.' END FROM tem JOIN cs ON cs.case_id = tem.case_id
    UNION ALL SELECT tem.case_id, 'temporal', 'zh', CASE WHEN is_fallback THEN (cutoff_year - 4) || ' 至 ' || cutoff_year || ' 年僅 ' || evidence_count || ' 篇文獻相符，少於 20 篇，趨勢取中性值 0.5。'
      ELSE (cutoff_year - 4) || ' 至 ' || cutoff_year || ' 年有 ' || evidence_count || ' 篇文獻相符；相對於整個領域的趨勢值為 ' || printf('%.2f', value) || '。' END FROM tem JOIN cs ON cs.case_id = tem.case_id)"""


@query(f"WITH {NOTES} SELECT case_id, factor, lang, note FROM nt")
def factor_notes(spark, d):
    """What each factor of each case says, in two languages (SCL16)."""
    return notes.told(note_facts(Scored(spark, d)), ["en", "zh"])
