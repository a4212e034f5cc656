"""Record, classification, knowledge-base, attempt and edge views over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources import ingest

#: A small taxonomy whose terms occur in the tables: (id, label, phrases, acronyms).
TAXONOMY = [(w, w.title(), [w], []) for w in ("erin", "thble", "rehe", "ster", "nden", "esing", "thndly", "ntly", "under", "thor", "thea", "thin")] + [
    (f"acr_{w.lower()}", w, [], [w]) for w in ("The", "And", "Thor", "Er")
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated records."""
    d = table(spark, sf_dir, "documents")
    year = (F.lit(2005) + (F.col("doc_id") * 7) % 20).cast("int")
    return d.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("publication_number"),
        F.substring("text", 1, 120).alias("title"),
        F.expr("substring(text, 121)").alias("abstract"),
        F.upper("lang").alias("jurisdiction"),
        F.col("source").alias("company_name"),
        year.alias("year"),
        F.make_date(year, (1 + F.col("doc_id") % 12).cast("int"), F.lit(15)).alias("publication_date"),
    )


REC = """rec AS (
    SELECT doc_id AS pos, 'D' || doc_id AS publication_number, substr(text, 1, 120) AS title, substr(text, 121) AS abstract,
           upper(lang) AS jurisdiction, source AS company_name, CAST(2005 + (doc_id * 7) % 20 AS INTEGER) AS year,
           make_date(CAST(2005 + (doc_id * 7) % 20 AS BIGINT), CAST(1 + doc_id % 12 AS BIGINT), CAST(15 AS BIGINT)) AS publication_date
    FROM documents)"""


def cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as classified records; codes in order, the first is the primary one."""
    t = lambda n: table(spark, sf_dir, n)
    code = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("(2022.01)"))
    codes = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_partkey", code.alias("code")).alias("c"))
    codes = codes.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["code"]).alias("ipc"))  # lines of one order
    owner = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = t("orders").join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(owner, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("publication_number"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.coalesce("ipc", F.expr("cast(array() as array<string>)")).alias("ipc"),
        F.col("r_name").alias("jurisdiction"),
        F.col("c_name").alias("company_name"),
        F.array("c_name").alias("assignees"),
        F.col("c_mktsegment").alias("segment"),
        F.to_date("o_orderdate").alias("publication_date"),
        F.col("o_orderpriority").alias("category"),
    )


CLS = """code AS (
    SELECT l_orderkey AS pos, l_linenumber AS ln, l_partkey AS pk, p_brand || '/' || p_size || '(2022.01)' AS c
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  cls AS (
    SELECT o_orderkey AS pos, 'O' || o_orderkey AS publication_number, 'Order ' || o_orderkey AS title, r_name AS jurisdiction,
           c_name AS company_name, c_mktsegment AS segment, CAST(o_orderdate AS DATE) AS publication_date, o_orderpriority AS category
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
  grp AS (SELECT pos, ln, pk, trim(split_part(split_part(c, '(', 1), '/', 1)) AS g FROM code),
  prim AS (SELECT pos, arg_min(g, (ln, pk)) AS g FROM grp GROUP BY pos),
  top AS (
    SELECT g, n, CAST(row_number() OVER (ORDER BY n DESC, first_pos) AS INTEGER) AS rank
    FROM (SELECT g, count(*) AS n, min(pos) AS first_pos FROM prim GROUP BY g)
    QUALIFY row_number() OVER (ORDER BY n DESC, first_pos) <= 12),
  touch AS (SELECT DISTINCT grp.pos, grp.g, top.rank FROM grp JOIN top ON grp.g = top.g),
  sub AS (SELECT cls.*, prim.g AS primary_group, coalesce(top.g, 'OTHER') AS subtech FROM cls LEFT JOIN prim ON prim.pos = cls.pos LEFT JOIN top ON top.g = prim.g)"""

#: The same with brand and size as the group.
CLS_FINE = CLS.replace("trim(split_part(split_part(c, '(', 1), '/', 1)) AS g", "trim(split_part(c, '(', 1)) AS g")


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as knowledge records: even ids are papers, odd ones patents."""
    p = table(spark, sf_dir, "pages")
    html = F.coalesce("html", F.lit(""))
    title, body = ingest.page_text(html)
    year = (F.lit(2005) + (F.col("page_id") * 3) % 20).cast("int")
    return p.select(
        F.col("page_id").alias("pos"),
        F.when(F.col("page_id") % 2 == 0, "paper").otherwise("patent").alias("type"),
        title.alias("title"),
        body.alias("abstract"),
        year.alias("year"),
        F.col("url"),
        F.concat(F.lit("K"), (F.col("page_id") + 100000).cast("string")).alias("publication_number"),
        F.when(F.col("page_id") % 3 == 0, "US").when(F.col("page_id") % 3 == 1, "EP").otherwise("JP").alias("jurisdiction"),
        F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("owner "), (F.col("page_id") % 7).cast("string"))).alias("assignee"),
        ((F.col("page_id") * 37) % 101).cast("int").alias("cited_by"),
    )


KB = r"""kb AS (
    SELECT page_id AS pos, CASE WHEN page_id % 2 = 0 THEN 'paper' ELSE 'patent' END AS type,
           trim(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)) AS title,
           trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t\n\r\f\v]+', ' ', 'g')) AS abstract,
           CAST(2005 + (page_id * 3) % 20 AS INTEGER) AS year, url, 'K' || (page_id + 100000) AS publication_number,
           CASE page_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'EP' ELSE 'JP' END AS jurisdiction,
           CASE WHEN page_id % 5 > 0 THEN 'owner ' || (page_id % 7) END AS assignee, CAST((page_id * 37) % 101 AS INTEGER) AS cited_by
    FROM pages)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records that arrive."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("added_at"), F.col("event_id").alias("seq"), F.col("user_id").alias("client"), F.col("event_type").alias("origin"))


ATTEMPTS = "attempts AS (SELECT event_type || ':' || user_id AS id, CAST(ts AS TIMESTAMP) AS added_at, event_id AS seq, user_id AS client, event_type AS origin FROM events)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2000).alias("src"), F.col("l_partkey").alias("dst")).distinct()


EDGES = "edges AS (SELECT DISTINCT l_orderkey % 2000 AS src, l_partkey AS dst FROM lineitem)"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patents with codes under both schemes: `ipc` ("H01L 30/25(2022.01)") and `cpc` ("H01L30/25"), of brand and size.
    CPC has moved the group of Brand#13 to H01L 99; parts of size 50 have a malformed CPC code; orders still open have none."""
    t = lambda n: table(spark, sf_dir, n)
    d1, d2, size = F.substring("p_brand", 7, 1), F.substring("p_brand", 8, 1), F.col("p_size").cast("string")
    ipc = F.concat(F.lit("H0"), d1, F.lit("L "), d2, F.lit("0/"), size, F.lit("(2022.01)"))
    moved = F.when(F.col("p_brand") == "Brand#13", "99").otherwise(F.concat(d2, F.lit("0")))
    cpc = F.when(F.col("p_size") == 50, F.concat(F.lit("X"), size)).otherwise(F.concat(F.lit("H0"), d1, F.lit("L"), moved, F.lit("/"), size))
    codes = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_partkey", ipc.alias("ipc"), cpc.alias("cpc")).alias("c"))
    codes = codes.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("c")).alias("c"))  # lines of one order
    none = F.expr("cast(array() as array<string>)")
    of = lambda name: F.coalesce(F.transform("c", lambda x: x[name]), none)
    rows = t("orders").join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("pos"),
        F.lit("patent").alias("type"),
        F.concat(F.lit("US"), F.col("o_orderkey").cast("string"), F.lit("B1")).alias("publication_number"),
        F.to_date("o_orderdate").alias("publication_date"),
        of("ipc").alias("ipc"),
        F.when(F.col("o_orderstatus") == "O", none).otherwise(of("cpc")).alias("cpc"),
        F.col("o_orderpriority").alias("category"),
    )


def coded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: all but urgent orders, by IPC."""
    return coded(spark, sf_dir).where("category <> '1-URGENT'").drop("cpc", "type", "category")


def coded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store: urgent and high orders, by CPC; the high ones are in the corpus as well."""
    return coded(spark, sf_dir).where("category in ('1-URGENT', '2-HIGH')").drop("ipc", "category").withColumn("publication_number", F.regexp_replace("publication_number", "B1$", "A1"))


CODED = """cl AS (
    SELECT l_orderkey AS pos, l_linenumber AS ln, l_partkey AS pk, 'H0' || substr(p_brand, 7, 1) || 'L ' || substr(p_brand, 8, 1) || '0' AS ipc,
           CASE WHEN p_size <> 50 THEN 'H0' || substr(p_brand, 7, 1) || 'L ' || CASE WHEN p_brand = 'Brand#13' THEN '99' ELSE substr(p_brand, 8, 1) || '0' END END AS cpc
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  corp AS (SELECT o_orderkey AS pos FROM orders WHERE o_orderpriority <> '1-URGENT'),
  stor AS (SELECT o_orderkey AS pos, o_orderstatus <> 'O' AND o_orderkey IN (SELECT pos FROM cl) AS classified FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
  ext AS (SELECT * FROM stor WHERE pos NOT IN (SELECT pos FROM corp)),
  top AS (
    SELECT g, n, CAST(row_number() OVER (ORDER BY n DESC, first_pos) AS INTEGER) AS rank
    FROM (SELECT g, count(*) AS n, min(pos) AS first_pos FROM (SELECT pos, arg_min(ipc, (ln, pk)) AS g FROM cl WHERE pos IN (SELECT pos FROM corp) GROUP BY pos) GROUP BY g)
    QUALIFY row_number() OVER (ORDER BY n DESC, first_pos) <= 12),
  own AS (
    SELECT DISTINCT pos, ipc AS g, 'corpus' AS origin FROM cl WHERE pos IN (SELECT pos FROM corp)
    UNION ALL SELECT DISTINCT pos, cpc, 'knowledge_base' FROM cl WHERE cpc IS NOT NULL AND pos IN (SELECT pos FROM ext WHERE classified)),
  people AS (SELECT (SELECT count(*) FROM corp) + (SELECT count(*) FROM ext WHERE classified) AS n),
  touch AS (SELECT own.*, top.rank FROM own JOIN top ON top.g = own.g),
  both_ AS (SELECT DISTINCT cl.pos, cl.ipc, c2.cpc FROM cl JOIN cl c2 ON c2.pos = cl.pos AND c2.cpc IS NOT NULL WHERE cl.pos IN (SELECT pos FROM corp) AND cl.pos IN (SELECT pos FROM stor WHERE classified)),
  walk AS (SELECT ipc, cpc, count(*) AS n, (SELECT count(DISTINCT pos) FROM both_ z WHERE z.ipc = both_.ipc) AS records FROM both_ GROUP BY 1, 2),
  moved AS (
    SELECT w.ipc AS g, first.cpc AS moved_to, max(records) AS records, coalesce(max(n / records::DOUBLE) FILTER (WHERE w.ipc = w.cpc), 0) AS kept_share
    FROM walk w JOIN (SELECT ipc, cpc FROM (SELECT *, sum(n) OVER (PARTITION BY cpc) AS everywhere FROM walk) WHERE ipc <> cpc QUALIFY row_number() OVER (PARTITION BY ipc ORDER BY n / everywhere::DOUBLE DESC, n DESC, cpc) = 1) first ON first.ipc = w.ipc
    GROUP BY 1, 2 HAVING max(records) >= 5 AND coalesce(max(n / records::DOUBLE) FILTER (WHERE w.ipc = w.cpc), 0) < 0.5)"""
