"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import cut

#: Bits of a segment: an index key is a segment's number and value.
SEGMENT = 16


def binary_codes(vectors: DataFrame, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, code): bit i is set if component i is positive; `dims` bits in longs of 64. Vectors that are
    null, of another length, or hold null or non-finite components have no code and are left out."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    words = []
    for w in range((dims + 63) // 64):
        bits = [F.when(v[i] > 0, F.shiftleft(F.lit(1).cast("long"), i - 64 * w)).otherwise(F.lit(0).cast("long")) for i in range(64 * w, min(dims, 64 * w + 64))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return vectors.where(good).select(F.col(id_col).alias("vec_id"), F.array(*words).alias("code"))


def distance(a: Column, b: Column, words: int) -> Column:
    d = F.bit_count(a[0].bitwiseXOR(b[0]))
    for w in range(1, words):
        d = d + F.bit_count(a[w].bitwiseXOR(b[w]))
    return d


def segment(word_at: Callable[[int], Column], s: int) -> Column:
    """The value of segment s, from the words of a code."""
    return F.shiftrightunsigned(word_at(s * SEGMENT // 64), s * SEGMENT % 64).bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("long"))


def masks(r: int) -> Column:
    """All masks of exactly r of a segment's bits, as one literal."""
    values = [sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), r)]
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64, radius: bool = False) -> DataFrame:
    """codes, queries (vec_id, code) -> (query_id, rank, vec_id, distance): for each query the k nearest other
    rows by Hamming distance, ties by id; fewer only where there are fewer rows.

    Rows of one code are one entry of the index with its k + 1 smallest ids (a copy group of any size is one
    entry). Round r looks up, in each of the m segments, only the values at exactly r bits from the query's. A
    code is taken in the one round and segment where its nearest segment comes first, so none is met twice, and
    only if it isn't further than the query's kth so far. What a round finds is cut to the best k entries of a
    query within each task before it is shuffled (more can't matter: each entry holds at least one row), then
    joins the best k so far, the state that rounds hand on: k rows a query. After round r every code within
    m * (r + 1) - 1 bits has been met, since one of its segments is within r bits; a query whose kth lies there
    is done and leaves, the others go on. The index is joined by sort and merge, so that a value shared by very many
    codes can be split at run time; nothing is broadcast. Every round is written to the shared folder.

    With `radius` there is one more column, the round in which the query was done. Null ids take no part. Rows
    repeated with id and code are one; an id with several codes is as many rows, and as a query its smallest code
    counts. A query's own rows (its id) are no hits. Equal distances are ordered by id. Empty tables give no rows.
    """
    m, words = (dims + SEGMENT - 1) // SEGMENT, (dims + 63) // 64
    codes, queries = codes.where("vec_id is not null"), queries.where("vec_id is not null")
    ranked = codes.select("vec_id", "code").withColumn("_r", F.dense_rank().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    index = cut(ranked.groupBy("code").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    at_most = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    keyed = index.select("code", "ids", F.posexplode(F.array(*[segment(lambda w: F.col("code")[w], s) for s in range(m)])).alias("seg", "val"))
    keyed = cut(keyed.repartition("seg", "val"))
    left = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("code").alias("qcode"))
    left = cut(left.withColumn("worst", F.lit(dims)))
    none = codes.sparkSession.createDataFrame([], f"query_id {codes.schema['vec_id'].dataType.simpleString()}, vec_id {codes.schema['vec_id'].dataType.simpleString()}, distance int")
    best, done = none, [none.withColumn("radius", F.lit(0))]
    per_query = lambda *order: Window.partitionBy("query_id").orderBy(*order)
    for r in range(SEGMENT + 1):
        if not left.take(1):
            break
        values = F.posexplode(F.array(*[segment(lambda w: F.col("qcode")[w], s) for s in range(m)])).alias("seg", "_v")
        probes = left.select("query_id", "qcode", "worst", values).withColumn("_m", F.explode(masks(r)))
        probes = probes.select("query_id", "qcode", "worst", "seg", F.col("_v").bitwiseXOR(F.col("_m")).alias("val"))
        hits = probes.join(keyed.hint("merge"), ["seg", "val"])
        apart = [F.bit_count(segment(lambda w: F.col("code")[w], s).bitwiseXOR(segment(lambda w: F.col("qcode")[w], s))) for s in range(m)]
        first = F.lit(True)
        for s in range(m):
            first &= F.when(F.col("seg") > s, apart[s] > r).otherwise(apart[s] >= r)
        hits = hits.where(first).withColumn("distance", distance(F.col("qcode"), F.col("code"), words)).where("distance <= worst")
        hits = hits.withColumn("ids", F.array_remove("ids", F.col("query_id"))).where(F.size("ids") > 0)
        hits = hits.withColumn("_r", F.row_number().over(per_query("distance", F.col("ids")[0]))).where(F.col("_r") <= k)
        hits = hits.select("query_id", F.explode("ids").alias("vec_id"), F.col("distance").cast("int").alias("distance"))
        both = best.unionByName(hits)
        best = both.withColumn("_r", F.row_number().over(per_query("distance", "vec_id"))).where(F.col("_r") <= k).drop("_r")
        best = cut(best)
        reach = m * (r + 1) - 1 if r < SEGMENT else dims
        state = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        state = left.select("query_id", "qcode").join(state, "query_id", "left")
        # fewer rows than k in the whole table: all of them are to be found
        full = (F.coalesce("n", F.lit(0)) >= min(k, at_most - 1)) & (F.coalesce("kth", F.lit(0)) <= reach)
        state = cut(state.select("query_id", "qcode", F.when(F.col("n") >= k, F.col("kth")).otherwise(dims).cast("int").alias("worst"), (full | F.lit(r == SEGMENT)).alias("full")))
        done.append(best.join(state.where("full"), "query_id", "left_semi").select(*none.columns, F.lit(r).alias("radius")))
        left, best = state.where("not full").drop("full"), best.join(state.where("not full"), "query_id", "left_semi").select(*none.columns)
    rows = reduce(DataFrame.unionByName, done)
    return rows.withColumn("rank", F.row_number().over(per_query("distance", "vec_id"))).select("query_id", "rank", "vec_id", "distance", *["radius"] * radius)
