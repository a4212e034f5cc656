"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import cut, free_name, join_keys

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Primes above any number of blocks of a shard, far from its fractions.
STRIDES = [2147483647, 1101904333, 1523545981, 1536484109, 1964747209, 1799369821, 2106134243, 1751902367, 1973166469, 1462263463, 1744723873, 1420623697, 1791399277, 1977071851, 1460547229, 1693992043]


def apportion(df: DataFrame, group: list[str], weight: str, seats: str, out: str, most: str | None = None) -> DataFrame:
    """Sainte-Laguë: give each group's `seats` (a column, equal within the group) to its rows by highest
    quotients weight / (2 * given + 1); `out` holds the seats of a row, never above `most` where it is named.

    The quotients of all seats are never listed. Rounding weight / divisor, with divisor = total weight /
    seats, gives all but a few seats the same way; the surplus or lack D is at most half the number of rows,
    and a row's part in it at most 2 + its share of (D + rows), so only so many quotients are ranked. Ties
    go to the row first by its other columns. Sums are combined before the shuffle; the window holds a
    group's candidate quotients, so callers nest groups to keep them small.
    """
    keys = [c for c in df.columns if c not in (weight, seats)]
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    df = df.withColumn("_t", F.sum(weight).over(w)).withColumn("_n", F.count("*").over(w))
    df = df.withColumn("_s", F.when(F.col("_t") > 0, F.floor(F.col(weight) / F.col("_t") * F.col(seats) + 0.5)).otherwise(0).cast("long"))
    df = df.withColumn("_d", F.when(F.col("_t") > 0, F.col(seats) - F.sum("_s").over(w)).otherwise(0))
    span = F.when(F.col("_d") == 0, 0).otherwise(2 + F.ceil(F.col(weight) / F.col("_t") * (F.abs("_d") + F.col("_n")))).cast("long")
    # lacking seats: the next quotients, highest first; surplus: the last ones given, lowest first
    steps = F.when(F.col("_d") > 0, span).otherwise(F.least(span, F.col("_s")))
    cand = df.where("_d <> 0").withColumn("_k", steps).where("_k > 0").withColumn("_j", F.explode(F.expr("sequence(0L, _k - 1)")))
    cand = cand.withColumn(
        "_q", F.when(F.col("_d") > 0, F.col(weight) / (2 * (F.col("_s") + F.col("_j")) + 1)).otherwise(-F.col(weight) / (2 * (F.col("_s") - F.col("_j")) - 1))
    )
    order = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    cand = cand.withColumn("_r", F.row_number().over(order.orderBy(F.desc("_q"), *[F.asc_nulls_last(k) for k in keys], "_j")))
    moved = cand.where(F.col("_r") <= F.abs("_d")).groupBy(*keys).agg(F.sum(F.signum("_d")).cast("long").alias("_m"))
    got = F.col("_s") + F.coalesce(F.col("_m"), F.lit(0))
    df = join_keys(df, moved, keys, "left").withColumn(out, got)
    if most:
        # what a row may not take goes to the group's others, in the order of their keys, as far as they have room
        room = F.greatest(F.col(most) - F.col(out), F.lit(0)).cast("long")
        over = F.sum(F.greatest(F.col(out) - F.col(most), F.lit(0))).over(w)
        before = F.coalesce(F.sum(room).over(w.orderBy(*[F.asc_nulls_last(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        df = df.withColumn("_more", F.greatest(F.least(room, over - before), F.lit(0))).withColumn(out, (F.least(F.col(out), F.col(most)) + F.col("_more")).cast("long")).drop("_more")
    return df.drop("_t", "_n", "_s", "_d", "_m", seats)


def targets(sources: DataFrame, share: float, cap: float, weights: list[int]) -> DataFrame:
    """(source, source_size) -> with target: sources by code point, null last, take the weights in turn and
    share `share` times all sizes; a target stops at `cap` times its source's size and the excess is shared
    again by weight until none is above.

    Closed form instead of rounds: with the level u = target per weight, sources stop in the order of cap *
    size / weight; the level is the one at which the stopped and the rising sources add up to the sum. The
    table has one row per source and is ordered in one window.
    """
    one = Window.partitionBy(F.lit(0))
    s = sources.withColumn("_i", F.row_number().over(one.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_u", F.col("_cap") / F.col("_w"))
    by_u = one.orderBy("_u", "_i")
    # with the sources before this one stopped, the level that spends the whole sum
    s = s.withColumn("_spent", F.coalesce(F.sum("_cap").over(by_u.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_w").over(by_u.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.sum("source_size").over(one) * F.lit(float(share)) - F.col("_spent")) / F.col("_rest"))
    s = s.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_u"), F.struct("_u", "_i", "_level"))).over(one)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    seed: int = 42,
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[int, ...] = (3, 1, 2),
    block: int = 32,
    shard: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    digest: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken[, digest]) of every row of docs; digest is that of the text.

    Sources fall into shards of about `shard` words by a seeded hash of id and text, and shards into groups, so
    that one source may hold any part of the corpus. All targets together make a number of blocks of `block`
    words; Sainte-Laguë gives them to sources, then to groups, then to shards (integer quotas). A shard's
    documents, in seeded order, form one line of words, cut into equal blocks; each block is taken quota div
    blocks times, and once more if a seeded permutation puts it among the first quota mod blocks. `taken` is
    the number of a document's words in the blocks taken, repeats counted; no block is taken more than twice
    (for cap 2), so no document is. The same input and seed give the same rows, whatever the partitioning.

    Null texts have size 0 and empty texts too: they are returned with taken 0. A null source is a source of
    its own, ordered last. Repeated rows (also of one id) count each by itself. An empty table gives no rows.
    """
    hashed = lambda *c: F.xxhash64(F.lit(seed), *c)
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("_x")
    )
    base = cut(base.withColumn("size", F.greatest("size", F.lit(0))))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, share, cap, list(weights)).withColumn("_all", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5).cast("long"))
    plan = apportion(plan, [], "target", "_all", "quota")
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))
    plan = cut(plan.withColumn("groups", F.ceil(F.sqrt("shards")).cast("long")).select("source", "source_size", "target", "quota", "shards", "groups"))

    placed = join_keys(base, plan, ["source"])
    placed = placed.withColumn("_g", F.pmod(hashed("doc_id", "_x"), F.col("shards"))).withColumn("_o", hashed("doc_id", "_x", F.lit(1)))
    sizes = cut(placed.groupBy("source", "_g").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"), F.first("groups").alias("groups")))
    sizes = sizes.withColumn("grp", F.pmod("_g", F.col("groups")))
    groups = sizes.groupBy("source", "grp").agg(F.sum("shard_size").alias("group_size"), F.first("quota").alias("quota"))
    groups = apportion(groups, ["source"], "group_size", "quota", "group_quota").select("source", "grp", "group_quota")
    shards = join_keys(sizes.drop("quota", "groups"), groups, ["source", "grp"])
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / block).cast("long")).withColumn("most", F.floor(F.lit(float(cap)) * F.col("blocks")).cast("long"))
    shards = apportion(shards.withColumnRenamed("_g", "shard"), ["source", "grp"], "shard_size", "group_quota", "shard_quota", "most")
    shards = cut(shards.select("source", "shard", "shard_size", "blocks", "shard_quota"))

    line = Window.partitionBy("source", "_g").orderBy("_o", F.asc_nulls_last("doc_id"), "_x", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.sum("size").over(line))
    rows = join_keys(placed, shards.withColumnRenamed("shard", "_g"), ["source", "_g"])
    # block i covers words [i * size div blocks, (i + 1) * size div blocks); i -> (a * i + b) mod blocks is a
    # permutation, since a is a prime of which no number of blocks is a multiple; which prime and b are drawn by the seed
    turn = F.pmod(hashed("source", "_g"), F.col("blocks"))
    stride = F.array(*[F.lit(p).cast("long") for p in STRIDES])[F.pmod(hashed("source", "_g", F.lit(2)), F.lit(len(STRIDES))).cast("int")]
    rows = rows.withColumn("_b", turn).withColumn("_a", F.pmod(stride, F.col("blocks")))
    taken = F.expr(
        """aggregate(
             sequence(((_end - size) * blocks) div shard_size, ((_end - 1) * blocks) div shard_size + 1), 0L,
             (sum, i) -> sum + greatest(0L, least(_end, -((-(i + 1) * shard_size) div blocks) + if((i + 1) * shard_size % blocks > 0, 1L, 0L))
                                            - greatest(_end - size, -((-i * shard_size) div blocks) + if(i * shard_size % blocks > 0, 1L, 0L)))
                       * if(i >= blocks, 0L, shard_quota div blocks + if((_a * i + _b) % blocks < shard_quota % blocks, 1L, 0L)))"""
    )
    more = [F.col("_x").alias("digest")] if digest else []
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"), *more)


def take(docs: DataFrame, seed: int = 42, **settings) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the mix takes it. A document taken for part of its
    words comes once more with that part as probability, decided by a seeded hash of its id and text; one without
    words (null or empty text) takes no part in the mix and comes once. A document is an id, a source and a text, so rows
    of one id, or of none, that differ are decided each by itself; rows alike in all three share what the mix takes of
    them. Columns are those of docs, whatever their names; an empty table gives no rows."""
    own, of, text, times, copy = (free_name(n, docs.columns) for n in ("id", "of", "digest_of_text", "times", "copy"))
    m = mix(docs, seed, digest=True, **settings).groupBy(F.col("doc_id").alias(own), F.col("source").alias(of), F.col("digest").alias(text)).agg(F.max("size").alias("size"), F.avg("taken").alias("taken"))
    part = F.pmod(F.xxhash64(F.lit(seed), F.lit(2), own, text), F.lit(1 << 20)) / float(1 << 20)
    often = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + part)).otherwise(1).cast("int")
    m = m.select(own, of, text, often.alias(times))
    same = docs["doc_id"].eqNullSafe(m[own]) & docs["source"].eqNullSafe(m[of]) & (F.xxhash64(docs["text"]) == m[text])
    rows = docs.join(m, same)
    return rows.withColumn(copy, F.explode(F.expr(f"if(`{times}` > 0, sequence(1, `{times}`), array())"))).select(*[docs[c] for c in docs.columns])
