"""BM25 over postings, with statistics as of each case's own cutoff or of the whole store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.functions.metrics import half_up
from lacuna.operators import tiles
from lacuna.operators.clean import exclude_known
from lacuna.sources.tables import written

K1, B = 1.5, 0.75


def postings(docs: DataFrame, pattern: str = text.TOKEN_A, stop: list[str] = text.STOP_A, digits: bool = True, title_twice: bool = False, *keep: str) -> DataFrame:
    """(pos, keep..., token, tf, len): one row per document and token (D9). A materialised table of it,
    clustered by token, is the index."""
    body = F.concat_ws(" ", "title", "title", "abstract") if title_twice else F.concat_ws(" ", "title", "abstract")
    t = docs.select("pos", *keep, text.tokens(body, pattern, stop, digits).alias("t"))
    t = t.select("pos", *keep, F.size("t").alias("len"), F.explode("t").alias("token"))
    return t.groupBy("pos", *keep, "token", "len").agg(F.count("*").alias("tf"))


def ranked(hits: DataFrame, k: int | None, order: str = "pos") -> DataFrame:
    """Top k per case with similarity = score / best, three decimals (AGG13); ties in input order."""
    w = Window.partitionBy("case_id").orderBy(F.desc(F.round("score", 9)), order)
    hits = hits.withColumn("rank", F.row_number().over(w))
    if k is not None:
        hits = hits.where(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy("case_id"))
    return hits.withColumn("similarity", half_up(F.col("score") / best, 3))


def running_at(rows: DataFrame, asked: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """rows (keys..., day, sums...), asked (keys..., cutoff) -> (keys..., cutoff, sums...): each key's sums over the days
    up to each cutoff asked of it, where there are any. Days and cutoffs stand in one list by key and day, so every
    row is met once; a key has at most a row a day."""
    days = rows.select(*keys, "day", *sums, F.lit(0).alias("_ask"))
    cuts = asked.select(*keys, F.col("cutoff").alias("day"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in sums], F.lit(1).alias("_ask"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("day", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    out = days.unionByName(cuts).select(*keys, "day", "_ask", *[F.sum(c).over(upto).alias(c) for c in sums])
    return out.where(f"_ask = 1 and {sums[0]} is not null").select(*keys, F.col("day").alias("cutoff"), *sums)


class Index:
    """The tokens of a corpus, taken out of its texts once and written: searches as of any cutoff, frequencies and sizes all
    read the same table. docs: pos, title, abstract, publication_date."""

    def __init__(self, docs: DataFrame):
        body = F.concat_ws(" ", "title", "abstract")
        self.listed = written(docs.select("pos", F.col("publication_date").alias("day"), text.tokens(body).alias("t")), "tokens")
        self.dated = self.listed.where("day is not null")

    def frequencies(self) -> DataFrame:
        """(token, df) over all records, dated or not."""
        return self.listed.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))

    def size(self) -> DataFrame:
        return self.listed.agg(F.count("*").alias("N"))

    def postings(self, queries: DataFrame, cutoffs: DataFrame) -> DataFrame:
        """(pos, day, len, token, tf) of the tokens that some query asks for, of the records published by the latest cutoff of all: no
        statistics and no search as of a cutoff has a later one. Written, as both read it."""
        latest = F.broadcast(cutoffs.agg(F.max("cutoff").alias("_last")))
        post = self.dated.join(latest, F.col("day") <= F.col("_last")).select("pos", "day", F.size("t").alias("len"), F.explode("t").alias("token"))
        post = post.join(queries.select("token").distinct(), "token", "left_semi")
        return written(post.groupBy("pos", "day", "token", "len").agg(F.count("*").alias("tf")), "postings")

    def statistics(self, queries: DataFrame, cutoffs: DataFrame, post: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(case_id, token, cutoff, df) of what is asked, df null where no record has the token yet, and (cutoff, N, L): records
        and tokens up to each cutoff. Sums per day and running sums over days give them for every cutoff at once (`running_at`)."""
        asked = queries.join(cutoffs, "case_id")
        per_day = self.dated.groupBy("day").agg(F.count("*").alias("N"), F.sum(F.size("t")).alias("L"))
        at = running_at(per_day, cutoffs.select("cutoff").distinct(), [], ["N", "L"])
        df = running_at(post.groupBy("token", "day").agg(F.count("*").alias("df")), asked.select("token", "cutoff").distinct(), ["token"], ["df"])
        return asked.join(df, ["token", "cutoff"], "left"), at

    def as_of(self, queries: DataFrame, cutoffs: DataFrame, k: int | None = 5, only: Column | None = None) -> DataFrame:
        """(case_id, pos, score, rank, similarity): BM25 in which N, df and mean length count only records
        published by the case's cutoff (AGG13, JN4, JN5). With `only`, a condition on pos, statistics are the same, and ranks are
        among these records.

        queries: distinct (case_id, token); cutoffs: (case_id, cutoff). Only tokens of some query are kept, by a semi
        join, before anything is counted. With k, blocks of cases meet blocks of records (`tiles`), so that no hits are rows; without,
        a case joins the postings of its own tokens, and every hit is a row.
        """
        post = self.postings(queries, cutoffs)
        asked, at = self.statistics(queries, cutoffs, post)
        q = asked.where("df is not null").join(at, "cutoff")
        post = post if only is None else post.where(only)
        if k is None:
            hits = post.join(q, "token").where(F.col("day") <= F.col("cutoff"))
            part = weight(F.col("N"), F.col("df"), F.col("tf"), F.col("len"), F.col("L") / F.col("N"))
            return ranked(hits.groupBy("case_id", "pos").agg(F.sum(part).alias("score")).where("score > 0"), k)
        tid = F.xxhash64(F.lit(telling_seed(queries)), "token")
        # dealt by record into as many parts as tasks are to search, however small
        docs = post.repartition(int(post.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pos").groupBy("pos", "day", "len").agg(F.collect_list(F.struct(tid.alias("t"), F.col("tf").cast("int").alias("tf"))).alias("p"))
        docs = docs.select(F.col("pos").cast("long").alias("pos"), "day", "len", F.col("p.t").alias("tokens"), F.col("p.tf").alias("tfs"))
        own = q.groupBy("case_id", "cutoff", (F.col("L") / F.col("N")).alias("mean")).agg(F.sort_array(F.collect_list(F.struct((-idf(F.col("N"), F.col("df"))).alias("m"), tid.alias("t")))).alias("p"))
        own = own.select("case_id", "cutoff", "mean", F.col("p.t").alias("tokens"), F.transform("p.m", lambda m: -m).alias("idfs"))
        return ranked(tiles.best(written(docs, "records"), own, k, K1, B), k)

    def beside(self, extra: DataFrame, queries: DataFrame, cutoffs: DataFrame, k: int = 5) -> DataFrame:
        """(case_id, pos, score, place): a case's own extra records as they rank in one pool with the corpus, the first k (AGG13,
        second stage). extra: case_id, pos, seq, title, abstract, publication_date; ties in the order of seq.

        The pool's N, df and lengths are the corpus's up to the cutoff plus those of the case's own extra records up to
        it; only extra records are scored, since only their order is asked for."""
        body = F.concat_ws(" ", "title", "abstract")
        x = extra.join(cutoffs, "case_id").where(F.col("publication_date") <= F.col("cutoff")).select("case_id", "cutoff", "pos", "seq", text.tokens(body).alias("t"))
        own = x.groupBy("case_id", "cutoff").agg(F.count("*").alias("xN"), F.sum(F.size("t")).alias("xL"))
        x = x.select("case_id", "pos", "seq", F.size("t").alias("len"), F.explode("t").alias("token")).join(queries, ["case_id", "token"], "left_semi")
        x = x.groupBy("case_id", "pos", "seq", "len", "token").agg(F.count("*").alias("tf"))
        near = queries.join(x.select("case_id", "token").distinct(), ["case_id", "token"], "left_semi")
        asked, at = self.statistics(near, cutoffs, self.postings(near, cutoffs))
        pool = own.join(at, "cutoff", "left").select("case_id", (F.col("xN") + F.coalesce("N", F.lit(0))).alias("N"), (F.col("xL") + F.coalesce("L", F.lit(0))).alias("L"))
        q = asked.join(x.groupBy("case_id", "token").agg(F.count("*").alias("xdf")), ["case_id", "token"]).select("case_id", "token", (F.col("xdf") + F.coalesce("df", F.lit(0))).alias("df"))
        part = weight(F.col("N"), F.col("df"), F.col("tf"), F.col("len"), F.col("L") / F.col("N"))
        hits = x.join(q, ["case_id", "token"]).join(pool, "case_id").groupBy("case_id", "pos", "seq").agg(F.sum(part).alias("score")).where("score > 0")
        w = Window.partitionBy("case_id").orderBy(F.desc(F.round("score", 9)), "seq")
        return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("case_id", "pos", "score", "place")


def telling_seed(queries: DataFrame) -> int:
    """A seed with which no two tokens of the queries have the same hash."""
    tokens, seed = queries.select("token").distinct(), 1
    while True:
        n = tokens.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(F.lit(seed), "token")).alias("hashes")).first()
        if n["n"] == n["hashes"]:
            return seed
        seed += 1


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(n, df, tf, length, mean):
    """A token's part of a BM25 score."""
    return idf(n, df) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean))


def as_of(docs: DataFrame, queries: DataFrame, cutoffs: DataFrame, k: int | None = 5) -> DataFrame:
    """Index.as_of over records that are searched once."""
    return Index(docs).as_of(queries, cutoffs, k)


def stored_patents(store: DataFrame, queries: DataFrame, cutoffs: DataFrame, known: DataFrame, k: int = 15, pad: str = "none") -> DataFrame:
    """(case_id, pos, seq, title, abstract, publication_date): a case's patents of the store as extra prior art (JN12): the first k by the
    store's own search, of these the dated ones up to the cutoff whose number isn't known. `known` has publication_number.

    store: pos, type, title, abstract, date, year, publication_number; queries in the store's tokens (`store_tokens`)."""
    hits = in_store(store, queries, cutoffs, k, "patent").select("case_id", "pos", F.col("rank").alias("seq"))
    hits = hits.join(store.select("pos", "title", "abstract", F.col("date").alias("publication_date"), "publication_number"), "pos").join(cutoffs, "case_id")
    return exclude_known(hits.where(F.col("publication_date") <= F.col("cutoff")), known, pad).select("case_id", "pos", "seq", "title", "abstract", "publication_date")


def store_tokens(case_features: DataFrame, taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, token), distinct, as the store reads them: the labels of a case's features and its document terms."""
    words = taxonomy.select("feature_id", F.explode(text.tokens(F.col("label"), text.TOKEN_B, STOP_B, False)).alias("token"))
    own = case_features.join(F.broadcast(words), "feature_id").select("case_id", "token")
    said = terms.select("case_id", F.explode(text.tokens(F.col("token"), text.TOKEN_B, STOP_B, False)).alias("token"))
    return own.unionByName(said).distinct()


def prior_art(corpus: DataFrame, external: DataFrame, most: int = 5) -> DataFrame:
    """(case_id, pos, place): evidence in order, the corpus's own first `most`, then the first external ones (AGG15); more external
    records can only add evidence."""
    own = corpus.where(F.col("rank") <= most).select("case_id", "pos", F.col("rank").alias("place"))
    return own.unionByName(external.where(F.col("place") <= most).select("case_id", "pos", (F.col("place") + most).alias("place")))


def at_dates(cases: DataFrame, shifts: list[int]) -> DataFrame:
    """Cases at several cutoffs, each `shift` months before their own, as cases of one run: `run` is the shift, `of` the case's
    id, and case_id one for both, so that one index and one set of features serve all dates."""
    runs = F.explode(F.array(*map(F.lit, shifts))).alias("run")
    out = cases.select("*", runs).withColumn("of", F.col("case_id")).withColumn("case_id", F.concat_ws("@", F.col("of").cast("string"), F.col("run").cast("string")))
    return out.withColumn("cutoff", F.add_months("cutoff", -F.col("run"))).withColumn("cutoff_year", F.year("cutoff"))


def in_store(docs: DataFrame, queries: DataFrame, cutoffs: DataFrame, k: int, kind: str | None = None) -> DataFrame:
    """BM25 over the knowledge store (AGG13b): the title counts twice, statistics are those of the whole
    store, the cutoff only filters results, and the score grows by the share of query terms matched.

    docs: pos, type, title, abstract, date, year; a record is allowed by its date, else by its year (FLT2)."""
    b = lambda d, *keep: postings(d, text.TOKEN_B, STOP_B, False, True, *keep)
    body = F.concat_ws(" ", "title", "title", "abstract")
    stats = docs.agg(F.count("*").alias("N"), F.avg(F.size(text.tokens(body, text.TOKEN_B, STOP_B, False))).alias("avgdl"))
    post = b(docs, "type", "date", "year").join(queries.select("token").distinct(), "token", "left_semi")
    post = written(post, "postings")
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    size = queries.groupBy("case_id").agg(F.count("*").alias("terms"))
    q = queries.join(cutoffs, "case_id").join(size, "case_id").join(df, "token")
    allowed = lambda cutoff: F.when(F.col("date").isNotNull(), F.col("date") <= F.col(cutoff)).otherwise(F.col("year") <= F.year(cutoff))
    # what no case may have goes before the join
    own = post.join(F.broadcast(cutoffs.agg(F.max("cutoff").alias("_last"))), allowed("_last")).where(F.col("type") == kind if kind else F.lit(True))
    hits = own.select("pos", "date", "year", "token", "tf", "len").join(q, "token").where(allowed("cutoff")).join(F.broadcast(stats), F.lit(True))
    part = idf(F.col("N"), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    score = F.sum(part) * (1 + F.count("*") / F.max("terms"))
    return ranked(hits.groupBy("case_id", "pos").agg(score.alias("score")), k)


#: Stop words of the knowledge store's tokenizer.
STOP_B = """a an the and or of for in to with based method methods system systems device devices apparatus using via from on
by its into at is are be such this that which not can may also each between over than then as it their these we our paper
propose proposed approach results show new network networks networking""".split()


def case_tokens(case_features: DataFrame, taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, token), distinct: tokens of each feature's label, phrases and acronyms, and the document
    terms (AGG13c)."""
    said = F.array_distinct(F.flatten(F.transform(F.concat(F.array("label"), "phrases", "acronyms"), lambda x: text.tokens(x))))
    words = taxonomy.select("feature_id", F.explode(said).alias("token"))
    return case_features.join(F.broadcast(words), "feature_id").select("case_id", "token").unionByName(terms.select("case_id", "token")).distinct()


def recall(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: cases, found among their own hits, recall (AGG42). truth: (case_id, pos)."""
    got = truth.join(hits.select("case_id", "pos").distinct().withColumn("hit", F.lit(1)), ["case_id", "pos"], "left")
    return got.agg(F.count("*").alias("cases"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.when(F.col("cases") > 0, F.col("found") / F.col("cases")))


def leaks(now: DataFrame, before: DataFrame, cutoffs: DataFrame, dates: DataFrame) -> DataFrame:
    """One row: hits before an earlier cutoff, how many of them the later one still has, and how many are published behind
    the earlier cutoff, which must be none (AGG42). now, before: (case_id, pos); cutoffs: (case_id, cutoff); dates: (pos, publication_date)."""
    kept = now.select("case_id", "pos").withColumn("_now", F.lit(1))
    rows = before.join(kept, ["case_id", "pos"], "left").join(cutoffs, "case_id").join(dates, "pos")
    late = F.col("publication_date").isNull() | (F.col("publication_date") > F.col("cutoff"))
    return rows.agg(F.count("*").alias("hits_before"), F.count("_now").alias("still_hits"), F.count_if(late).alias("leaked"))
