"""License scans: ordered signature rules behind a keyword gate, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import cut, join_keys
from lacuna.llm.license_rules import BASE, CONFIDENCE, RULES, Rule

#: What stands between words; A-Z count as letters here and are read in either case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOUND = "array<struct<rule:int,i:int,gap:long,hit:long>>"


def whole_words(pattern: str) -> str:
    """A rule's pattern over words joined, begun and ended by single spaces. (?i) is A-Z only."""
    return f"(?i)(?<= )(?:{pattern})(?= )"


def base_rules() -> list[Rule]:
    """The base phrases as rules. They come first, below level 1: nothing contains them but what is longer."""
    return [Rule(4, label, tuple(phrase.split()[-2:-1]), phrase) for label, phrase in BASE.items()]


def rule_table(rules: list[Rule]) -> Column:
    """The rules as one constant array of (no, keywords, pattern)."""
    return F.array(*[F.struct(F.lit(no).alias("no"), F.array(*map(F.lit, r.keywords)).alias("words"), F.lit(whole_words(r.pattern)).alias("pattern")) for no, r in enumerate(rules)])


def spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def matches(words: Column, no: Column, pattern: Column) -> Column:
    """All leftmost, non-overlapping matches of one pattern as (rule, i, gap, hit): the i-th match is `hit` spaces long and
    comes `gap` spaces behind the one before."""
    hits = F.regexp_extract_all(words, pattern, F.lit(0))
    gaps = F.slice(F.split(words, pattern), F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(spaces(g).alias("gap"), spaces(h).alias("hit")))
    return F.transform(pairs, lambda p, i: F.struct(no.alias("rule"), i.alias("i"), p["gap"].alias("gap"), p["hit"].alias("hit")))


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, found) of every row: `base` and `found` are arrays of (start, end, label, level, rule) in
    order of place, in words from 0, end exclusive; rule is the place in `rules`, -1 and below for base phrases.

    Words are runs of 0-9, A-Z in either case, and all characters from U+0080. A rule is tried only on texts that have one of
    its keywords as a word. Of the matches, `found` keeps those that lie in no other match of a lower level, nor in a
    longer one (or an equal one of an earlier rule) of their own level. `base` is every place of the base phrases,
    whatever contains it.

    Each text is read once, in one narrow step; only texts with matches are dealt again, by id and digest, one row a
    match. Running maxima of ends, one for each level, find what is contained: a sort and a pass, however many matches
    a text has.

    Null and empty texts have no words. Null ids pass through, repeated rows give repeated results, other columns are
    ignored, an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    base = base_rules()
    every = base + rules
    keywords = F.array(*map(F.lit, sorted({w for r in every for w in r.keywords})))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace("t", BETWEEN, " ")), F.lit(" ")).alias("w"), F.md5("t").alias("m"))
    # a text of no words is two spaces
    n_words = F.when(F.length("w") > 2, spaces(F.col("w")) - 1).otherwise(F.lit(0)).cast("long")
    rows = rows.select("doc_id", "m", "w", n_words.alias("n_words"), F.array_intersect(F.split(F.lower("w"), " "), keywords).alias("have"))
    tried = F.filter(rule_table(every), lambda r: F.arrays_overlap(r["words"], F.col("have")) & F.regexp_like(F.col("w"), r["pattern"]))
    found = F.when(F.size("have") > 0, F.flatten(F.transform(tried, lambda r: matches(F.col("w"), r["no"], r["pattern"]))))
    found = F.coalesce(found, F.expr(f"cast(array() as {FOUND})"))
    rows = rows.select("doc_id", "n_words", found.alias("f"), "m")
    rows = cut(rows.select("doc_id", "n_words", F.when(F.size("f") > 0, F.col("f")).alias("f"), F.when(F.size("f") > 0, F.col("m")).alias("m")))

    one = rows.where("f is not null").dropDuplicates(["doc_id", "m"]).select("doc_id", "m", F.inline("f"))
    text = ["doc_id", "m"]
    upto = Window.partitionBy(*text, "rule").orderBy("i")
    one = one.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(upto))
    # the first space stands before word 0
    one = one.select(*text, "rule", (F.col("end") - F.col("hit") - 1).alias("start"), F.col("end").alias("end"))
    levels = F.array(*[F.lit(r.level) for r in every])
    labels = F.array(*[F.lit(r.label) for r in every])
    one = one.select(*text, "rule", "start", "end", F.get(levels, F.col("rule")).alias("level"), F.get(labels, F.col("rule")).alias("label"))
    before = Window.partitionBy(*text).orderBy("start", F.desc("end"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.array(*[F.max(F.when(F.col("level") <= level, F.col("end"))).over(before) for level in range(1, max(CONFIDENCE) + 1)])
    one = one.select(*text, "rule", "start", "end", "level", "label", F.coalesce(F.get(reach, F.col("level") - 1) >= F.col("end"), F.lit(False)).alias("inside"))
    is_base = F.col("rule") < len(base)
    span = F.struct("start", "end", "label", "level", (F.col("rule") - len(base)).alias("rule"))
    told = one.groupBy(*text).agg(F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("inside"), span))).alias("found"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,label:string,level:int,rule:int>>)")
    bare = rows.where("f is null").select("doc_id", "n_words", none.alias("base"), none.alias("found"))
    hot = join_keys(rows.where("f is not null").select("doc_id", "n_words", "m"), told, text).select("doc_id", "n_words", "base", "found")
    return bare.unionByName(hot)


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of scan()'s rows; the score is
    the confidence of the best match, 0 without one."""
    of = lambda c: F.transform(c, lambda s: s["label"])
    listed = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    starts = F.transform("base", lambda s: s["start"])
    worth = F.array(*[F.lit(CONFIDENCE[level]) for level in range(1, max(CONFIDENCE) + 1)])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(of("base")).alias("base_labels"),
        listed(F.concat(of("base"), of("found"))).alias("labels"),
        F.coalesce(F.get(worth, F.array_min(F.transform("found", lambda s: s["level"])) - 1), F.lit(0.0)).alias("score"),
    )
