"""Scalar text functions as Columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities in the order they are decoded, and the stop words of the two tokenizers.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
STOP_A = """a an the and or of for in to with based method methods system systems device devices apparatus apparatuses
using via from on by its into at is are be same such thereof network networks networking non first second one more this
that which not can may also each between over than then as it their these""".split()
STOP_LABEL = """a an the and or of for in to with based method methods system systems device devices apparatus apparatuses
using via from on by its into at is are be same such thereof network networks networking non first second one more""".split()
TOKEN_A = "[a-z][a-z0-9-]{2,}"
TOKEN_B = "[a-z0-9][a-z0-9-]{1,}"
SPACES = r"[ \t\n\r\f\u000B]+"


def quoted(s: str) -> str:
    """s as a literal inside a regular expression of Java, RE2 and Python alike."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)


def strip_tags(c: Column) -> Column:
    """Tags to spaces, entities decoded in order, white space squeezed (CLN1)."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, SPACES, " "))


def title_key(c: Column) -> Column:
    """Lower case, no tags, anything but letters and digits a space (CLN2)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "<[^>]+>", " "), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def search_form(c: Column, nfkc: bool = False) -> Column:
    """The form in which texts are searched: lower case, - _ / as spaces, squeezed (SCL1). Spark has no NFKC;
    with `nfkc` one Arrow UDF makes it, best once at ingest."""
    c = F.coalesce(c, F.lit(""))
    c = F.lower(_nfkc(c) if nfkc else c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[-_/]+", " "), SPACES, " "))


def tokens(c: Column, pattern: str = TOKEN_A, stop: list[str] = STOP_A, digits: bool = True) -> Column:
    """Tokens in order, repeats kept, without stop words (SCL2; SCL3 with TOKEN_B and digits=False)."""
    out = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0)), lambda t: ~t.isin(stop))
    return out if digits else F.filter(out, lambda t: ~t.rlike("^[0-9]+$"))


def _runs(ordered: Column, same, entry) -> Column:
    """entry(first place, number) of every run of equal elements of an array in order. A one-element array stands for a variable."""
    starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | ~same(F.get(ordered, i), F.get(ordered, i - 1)))
    return F.get(F.transform(F.array(starts), lambda st: F.transform(st, lambda a, k: entry(a, F.coalesce(F.get(st, k + 1), F.size(ordered)) - a))), F.lit(0))


def inverted(words: Column) -> Column:
    """word -> its places in an array of words, from 0, ascending; within the row."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    entry = lambda s: lambda a, n: F.struct(F.get(s, a)["w"].alias("w"), F.transform(F.slice(s, a + 1, n), lambda x: x["p"]).alias("ps"))
    return F.map_from_entries(F.get(F.transform(F.array(placed), lambda s: F.when(F.size(s) > 0, _runs(s, lambda x, y: x["w"] == y["w"], entry(s)))), F.lit(0)))


def term_pattern(term: str, case: bool) -> str:
    """A term between ASCII word boundaries; Java's own \\b also counts letters with accents (SCL4)."""
    return ("" if case else "(?i)") + rf"(?<![A-Za-z0-9_]){quoted(term)}(?![A-Za-z0-9_])"


def year_candidates(c: Column) -> Column:
    """Years from 1980 on that a text names, distinct, latest first (SCL8)."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"{B0}(19[89]\d|20[0-2]\d|2030){B1}"), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, lambda y: y.cast("int"))), asc=False)


#: ASCII word boundaries before and after a digit or letter.
B0, B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def without_references(c: Column) -> Column:
    """Text up to the first references heading (SCL9)."""
    return F.regexp_replace(c, r"(?is)\n\s*(?:references|bibliography|works cited)\s*\n.*\z", "")


def without_citation_years(c: Column) -> Column:
    """In-text citation years blanked (SCL10)."""
    c = F.regexp_replace(c, rf"\([^()]{{0,120}}?{B0}(?:19|20)\d{{2}}[a-z]?{B1}[^()]{{0,40}}?\)", " ")
    c = F.regexp_replace(c, rf"\[[^\[\]]{{0,120}}?{B0}(?:19|20)\d{{2}}[a-z]?{B1}[^\[\]]{{0,40}}?\]", " ")
    return F.regexp_replace(c, r"(?i)et\s+al\.?,?\s*(?:19|20)\d{2}[a-z]?", " ")


YEAR = rf"{B0}(?:19|20)\d{{2}}{B1}"
EVENT = "(?:conference|proceedings|symposium|workshop)"
#: What a text says of itself on its first page, in order of trust.
SELF = [
    ("copyright_line", rf"(?i)(?:©|\(c\)|copyright)\s*(?:19|20)\d{{2}}{B1}"),
    ("published_accepted_received", rf"(?i){B0}(?:published|accepted|received){B1}[^.\n]{{0,30}}?{YEAR}"),
    ("conference_year", rf"(?i){YEAR}[^.\n]{{0,40}}{B0}{EVENT}{B1}|{B0}{EVENT}{B1}[^.\n]{{0,40}}{YEAR}"),
    ("arxiv_id", rf"(?i){B0}arxiv:\s*\d{{4}}\.\d{{4,5}}"),
]


def cutoff_year(c: Column) -> Column:
    """struct(year, confidence, source): the first pattern of SELF that the first 4,000 characters hold, its
    last year; else the most frequent year, ties to the later; else null (SCL11)."""
    clean = without_citation_years(without_references(F.coalesce(c, F.lit(""))))
    first = F.substring(clean, 1, 4000)
    out = F.lit(None).cast("struct<year:int,confidence:string,source:string>")
    years = F.transform(F.regexp_extract_all(clean, F.lit(rf"{B0}(19[89]\d|20[0-2]\d|2030){B1}"), F.lit(1)), lambda y: y.cast("int"))
    ranked = F.array_max(F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), y.alias("y"))))
    out = F.when(F.size(years) > 0, F.struct(ranked["y"].alias("year"), F.lit("low").alias("confidence"), F.lit("frequency_fallback").alias("source")))
    for source, pattern in reversed(SELF):
        hit = F.regexp_extract(first, pattern, 0)
        if source == "arxiv_id":
            year = F.lit(2000) + F.regexp_extract(hit, r"(\d{2})\d{2}\.", 1).cast("int")
        else:
            year = F.try_element_at(F.regexp_extract_all(hit, F.lit(YEAR), F.lit(0)), F.lit(-1)).cast("int")
        out = F.when((hit != "") & year.isNotNull(), F.struct(year.alias("year"), F.lit("high").alias("confidence"), F.lit(source).alias("source"))).otherwise(out)
    return out


def evidence(c: Column, term: str, case: bool = False) -> Column:
    """The sentence around a term's first match, else a window of 140 characters after it (SCL5)."""
    at = F.regexp_instr(c, F.lit(term_pattern(term, case)))
    before = F.substring(c, F.lit(1), at)
    last = F.greatest(_last(before, "."), _last(before, "\n"))
    start = F.greatest(last, at - 1 - 140, F.lit(0))
    after = at - 1 + len(term)
    stop = F.locate(".", F.substring(c, after + 1, F.length(c)))
    end = F.when((stop == 0) | (after + stop - 1 - start > 280), F.least(F.length(c), after + 140)).otherwise(after + stop)
    piece = F.trim(F.regexp_replace(F.substring(c, start + 1, end - start), SPACES, " "))
    return F.when(at > 0, piece)


def _last(c: Column, mark: str) -> Column:
    """Characters of c up to and with the last `mark`; 0 if there is none."""
    return F.when(F.instr(c, mark) > 0, F.length(c) - F.locate(mark, F.reverse(c)) + 1).otherwise(0)


def abstract_snippet(c: Column, pattern: str, size: int = 220) -> Column:
    """About `size` characters from the start of the sentence, else of the word, of the first match, with an
    ellipsis where text was left out (SCL6)."""
    at = F.greatest(F.regexp_instr(c, F.lit(pattern)), F.lit(1))
    before = F.substring(c, F.lit(1), at - 1)
    sentence, word = _last(before, "."), _last(F.substring(c, F.lit(1), F.greatest(at - 60, F.lit(0))), " ")
    start = F.when(at - sentence <= 120, sentence).otherwise(word)
    piece = F.trim(F.substring(c, start + 1, F.lit(size)))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), piece, F.when(start + size < F.length(c), F.lit("…")).otherwise(""))


def highlight(c: Column, terms: list[str]) -> Column:
    """Matches of any of the terms, longest first, between <mark> tags (SCL7)."""
    pattern = "(?i)(" + "|".join(quoted(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"
    return F.regexp_replace(c, pattern, "<mark>$1</mark>")


def page_url(number: Column) -> Column:
    return F.concat(F.lit("https://patents.google.com/patent/"), number, F.lit("/en"))


def clean_query(c: Column) -> Column:
    """Control characters to spaces, squeezed; null unless 1 to 100 characters (CLN17)."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1f\\x7f]", " "), SPACES, " "))
    return F.when(F.length(c).between(1, 100), c)


def accepted_year(asked: Column, detected: Column) -> Column:
    """The year that a user names if it is plausible (1990 to 2030), else the detected one (SCL12)."""
    return F.coalesce(F.when(asked.between(1990, 2030), asked), detected)


def cutoff_date(year: Column) -> Column:
    """The last day of a year (SCL12)."""
    return F.make_date(year, F.lit(12), F.lit(31))


def pair_queries(labels: Column) -> Column:
    """At most three distinct search texts from a case's labels: two by two, and where that gives fewer than three, the
    first with the third (SCL18). Null and empty labels don't count."""
    said = F.filter(labels, lambda x: x.isNotNull() & (x != ""))
    none = F.expr("cast(array() as array<string>)")
    two = F.when(F.size(said) > 0, F.transform(F.sequence(F.lit(0), F.least(F.size(said) - 1, F.lit(5)), F.lit(2)), lambda i: F.array_join(F.slice(said, i + 1, 2), " "))).otherwise(none)
    third = F.when(F.size(said).between(3, 4), F.array(F.concat_ws(" ", F.get(said, F.lit(0)), F.get(said, F.lit(2))))).otherwise(none)
    return F.slice(F.array_distinct(F.concat(two, third)), 1, 3)
