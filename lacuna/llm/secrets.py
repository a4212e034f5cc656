"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut, join_keys

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of the base patterns are as long as they can be, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# weak parts: telling nothing alone
WEAK_ID = r"""(?<![A-Za-z0-9_])(?i:access_?key_?id|access_?key|client_?id|user_?name|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,88}={0,2}(?![A-Za-z0-9+/=_-])"
#: The groups are possessive: Java follows repeated groups by recursion else, and a long name ends the executor.
ENDPOINT = r"""https?://[A-Za-z0-9.-]++(?::[0-9]++)?+(?:/[^\s"'<>]*+)?+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"""
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Matches that are placed together; appending to an array copies it, so runs of this length are placed each by itself.
RUN = 256


def spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches as (start, kind, end), in code points. Positions follow from the
    lengths of the matches and of the pieces between them. `keep`: an array of booleans, one per match."""
    pat, none = F.lit(pattern), F.expr(f"cast(array() as {SPAN})")
    hits = F.transform(F.regexp_extract_all(text, pat, F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern), F.length)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))

    def place(run: Column) -> Column:
        """(at: length of the run's text, out: spans from the run's beginning)."""
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        span = lambda at, p: F.struct((at + p["g"]).alias("start"), F.lit(kind).alias("kind"), (at + p["g"] + p["h"]).alias("end"))
        return F.aggregate(run, begin, lambda acc, p: F.struct((acc["at"] + p["g"] + p["h"]).alias("at"), F.array_append(acc["out"], span(acc["at"], p)).alias("out")))

    def chained(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), (F.size(pairs) - 1).cast("int"), F.lit(RUN)), lambda i: place(F.slice(pairs, i + 1, RUN)))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = lambda rs: F.aggregate(rs, begin, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        moved = lambda rs: F.flatten(F.zip_with(rs, starts(rs), lambda r, o: F.transform(r["out"], lambda s: F.struct((s["start"] + o).alias("start"), s["kind"].alias("kind"), (s["end"] + o).alias("end")))))
        # one element arrays stand for variables, so that nothing is worked out twice
        return F.flatten(F.transform(F.array(runs), moved))

    run = F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, chained(p)).otherwise(none)))
    if keep is not None:
        run = F.transform(F.filter(F.arrays_zip(run.alias("s"), keep.alias("k")), lambda x: x["k"]), lambda x: x["s"])
    return F.when(text.rlike(pattern), run).otherwise(none)


def scan(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, linked) of every row: arrays of (start, kind, end), offsets in code points, kind the
    place in KINDS.

    `base` has assignments with a value of 6 or more characters, access identifiers and hex runs. Weak parts
    (other identifiers, random-looking strings, endpoints) are `linked` only if complementary ones lie within
    `scope` characters: an identifier and a secret report each other, and an endpoint is reported near either of such a
    pair. Parts meet in an interval join on the text and buckets of `scope` characters, all that a part
    touches, only for texts that hold both sides; a bucket holds at most scope / 4 parts, so a text adds
    pairs in proportion to its length. The join's key is the id with a digest of the text, so repeated rows don't multiply.

    Null and empty texts have no spans. Null ids pass through. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    long_enough = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda x: F.length(x) >= 6)
    rows = rows.select(
        "doc_id",
        F.when(t.contains("=") | t.contains(":"), spans(t, ASSIGN, 0, long_enough)).alias("a"),
        F.when(t.contains("AKIA"), spans(t, ACCESS, 1)).alias("k"),
        spans(t, HEX, 2).alias("h"),
        F.when(t.contains("=") | t.contains(":"), spans(t, WEAK_ID, 3)).alias("i"),
        spans(t, WEAK_SECRET, 4).alias("s"),
        F.when(t.contains("://") | t.contains("=") | t.contains(":"), spans(t, ENDPOINT, 5)).alias("e"),
        F.md5("t").alias("m"),
    )
    none = F.expr(f"cast(array() as {SPAN})")
    full = lambda *names: F.array_sort(F.concat(*[F.coalesce(F.col(n), none) for n in names]))
    rows = rows.select("doc_id", full("a", "k", "h").alias("base"), full("k", "i").alias("ids"), full("a", "s").alias("keys"), full("e").alias("ends"), "m")
    both = (F.size("ids") > 0) & (F.size("keys") > 0)
    rows = cut(rows.select("doc_id", "base", *[F.when(both, F.col(c)).alias(c) for c in ("ids", "keys", "ends", "m")]))

    hot = rows.where("m is not null").dropDuplicates(["doc_id", "m"])
    part = lambda c: hot.select("doc_id", "m", F.explode(c).alias("p")).select("doc_id", "m", F.struct("p.start", "p.kind", "p.end").alias("p"))
    # a part is in every bucket that it touches, on one side with `scope` around it; a pair counts in the first that both are in
    first = lambda c, around=0: F.floor((F.col(f"{c}.start") - around) / scope)
    over = lambda c, around=0: F.explode(F.sequence(first(c, around), F.floor((F.col(f"{c}.end") + around) / scope))).alias("b")
    near = lambda x, y: (F.col(f"{x}.start") <= F.col(f"{y}.end") + scope) & (F.col(f"{y}.start") <= F.col(f"{x}.end") + scope) & ((F.col(f"{x}.start") >= F.col(f"{y}.end")) | (F.col(f"{y}.start") >= F.col(f"{x}.end")))

    def meet(left: DataFrame, x: str, right: DataFrame, y: str) -> DataFrame:
        left, right = left.select("doc_id", "m", x, over(x, scope)), right.select("doc_id", "m", y, over(y))
        return join_keys(left, right, ["doc_id", "m", "b"]).where((F.col("b") == F.greatest(first(x, scope), first(y))) & near(x, y)).select("doc_id", "m", x, y)

    pairs = meet(part("ids").withColumnRenamed("p", "id"), "id", part("keys").withColumnRenamed("p", "key"), "key")
    members = pairs.select("doc_id", "m", F.explode(F.array("id", "key")).alias("one")).distinct()
    with_end = meet(members, "one", part("ends").withColumnRenamed("p", "end_"), "end_").select("doc_id", "m", F.col("end_").alias("p"))
    linked = pairs.select("doc_id", "m", F.explode(F.array("id", "key")).alias("p")).unionByName(with_end).where("p.kind > 2")
    linked = linked.groupBy("doc_id", "m").agg(F.array_sort(F.collect_set("p")).alias("linked"))
    return join_keys(rows, linked, ["doc_id", "m"], "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans) of scan()'s rows."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    both = F.array_sort(F.concat("base", "linked"))
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(both).alias("spans"), F.size(both).cast("long").alias("n_spans"))
