"""Many terms at once: the runs of words of a text are looked up in a table of terms.

A pattern per term reads every text as often as there are terms. Here a text is taken apart once; its runs of as many words
as some term has are rows, and one hash join with the terms finds them all, so the cost doesn't depend on the number
of terms. The terms are an argument of the plan and travel to every task.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import quoted

#: What a word is made of: for features ASCII letters, digits and _, for searches the search form's letters and digits.
WORD, SEARCH_WORD = "A-Za-z0-9_", "a-z0-9"


class Term(NamedTuple):
    """`key` is what a match counts for, `text` what is looked for, `case` whether upper and lower case differ."""

    key: int
    text: str
    case: bool = True


def words_in(term: str, chars: str) -> list[str]:
    return re.findall(f"[{chars}]+", term)


def regular(term: str, chars: str) -> bool:
    """Begins and ends with a word, so that words' bounds are its own."""
    return bool(re.fullmatch(f"[{chars}](?:.*[{chars}])?", term, re.S))


def overlaps(term: str, chars: str) -> bool:
    """Whether a place of the term can overlap the next one: it begins with the words with which it ends."""
    w = words_in(term.lower(), chars)
    return any(w[:n] == w[-n:] for n in range(1, len(w)))


def runs(text: Column, chars: str, sizes: list[int], firsts: list[str] | None = None) -> Column:
    """array of (i, run): every run of `sizes` words with what stands between them; i is the place of its first word. With
    `firsts` only runs whose first word is one of these are put together."""
    if sizes == [1] and firsts is None:
        return F.transform(F.regexp_extract_all(text, F.lit(f"[{chars}]+"), F.lit(0)), lambda w, i: F.struct(i.alias("i"), w.alias("run")))

    def of(parts: Column) -> Column:
        begin = F.when(F.get(parts, F.lit(0)).rlike(f"^[{chars}]"), 0).otherwise(1)

        def sized(n: int) -> Column:
            # every other part is a word
            last = F.floor((F.size(parts) - begin - (2 * n - 1)) / 2).cast("int")
            run = lambda k: F.array_join(F.slice(parts, begin + 2 * k + 1, F.lit(2 * n - 1)), "")
            at = F.sequence(F.lit(0), last)
            at = at if firsts is None else F.filter(at, lambda k: F.get(parts, begin + 2 * k).isin(firsts))
            return F.when(last >= 0, F.transform(at, lambda k: F.struct(k.alias("i"), run(k).alias("run")))).otherwise(F.expr("cast(array() as array<struct<i:int,run:string>>)"))

        return F.concat(*map(sized, sizes))

    # a one-element array stands for a variable
    return F.flatten(F.transform(F.array(F.regexp_extract_all(text, F.lit(f"[{chars}]+|[^{chars}]+"), F.lit(0))), of))


def found(rows: DataFrame, ids: list[str], text: str, terms: list[Term], chars: str = WORD) -> DataFrame:
    """(ids..., key, n): how often terms of each key occur in `text`, between bounds of words; keys without a match give no row.

    Each term counts by itself, so places of different terms may overlap; places of one term don't. `ids` name one row
    each. Terms that begin or end with no word are matched by pattern, one by one.
    """
    spark = rows.sparkSession
    plain = [t for t in terms if regular(t.text, chars)]
    odd = [t for t in terms if t not in plain and t.text]
    counts = []
    if plain:
        table = [(t.text.lower(), None if not t.case else t.text, t.key, no, len(words_in(t.text, chars)), overlaps(t.text, chars)) for no, t in enumerate(plain)]
        table = F.broadcast(spark.createDataFrame(table, "_low string, _exact string, key int, _no int, _size int, _again boolean"))
        each = rows.select(*ids, F.explode(runs(F.col(text), chars, sorted({len(words_in(t.text, chars)) for t in plain}))).alias("_r")).select(*ids, "_r.i", "_r.run")
        hits = each.join(table, F.lower("run") == F.col("_low")).where("_exact is null or _exact = run")
        if any(overlaps(t.text, chars) for t in plain):
            # of places that overlap, the first counts, then the next behind its end
            places = F.array_sort(F.collect_list(F.when(F.col("_again"), F.col("i"))))
            per = hits.groupBy(*ids, "key", "_no", "_size").agg(F.count_if(~F.col("_again")).alias("n"), places.alias("_at"))
            begin = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, i: F.when(i > acc["end"], F.struct((i + F.col("_size") - 1).alias("end"), (acc["n"] + 1).alias("n"))).otherwise(acc)
            counts.append(per.select(*ids, "key", (F.col("n") + F.aggregate("_at", begin, step, lambda acc: acc["n"])).alias("n")))
        else:
            counts.append(hits.groupBy(*ids, "key").agg(F.count("*").alias("n")))
    for t in odd:
        pattern = ("" if t.case else "(?i)") + bounded(t.text, chars)
        counts.append(rows.select(*ids, F.lit(t.key).alias("key"), F.regexp_count(F.col(text), F.lit(pattern)).cast("long").alias("n")).where("n > 0"))
    if not counts:
        return rows.select(*ids, F.lit(0).alias("key"), F.lit(0).cast("long").alias("n")).limit(0)
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*ids, "key").agg(F.sum("n").alias("n")) if len(counts) > 1 or any(overlaps(t.text, chars) for t in plain) else out


def bounded(term: str, chars: str) -> str:
    """A term between bounds of words as a pattern: of two neighbours, exactly one is part of a word."""
    edge = lambda c, before: f"(?<![{chars}])" if before and re.match(f"[{chars}]", c) else f"(?![{chars}])" if re.match(f"[{chars}]", c) else f"(?<=[{chars}])" if before else f"(?=[{chars}])"
    return edge(term[0], True) + quoted(term) + edge(term[-1], False)
