"""Phrase mining against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import phrases
from lacuna.llm.phrases import Transducer

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    c = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, p), a in c.items():
        d = len(p)
        if any(x == lang and len(q) > d and any(q[i : i + d] == p for i in range(len(q) - d + 1)) and 100 * b >= share * a for (x, q), b in c.items()):
            continue
        s, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, d))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, g in out.items() for i, (s, a, p, left, right) in enumerate(sorted(g)[:top], 1))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["a", "B", "ça", "d", "e\x1cf", "the", "\x00", "zz", "日本", "É", " x"]
    some = [(r.choice(["en", "fr", None, "und", ""]), "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "\x0b"]) for _ in range(r.randrange(60)))) for _ in range(150)]
    return [*some, ("en", None), ("en", ""), (None, "..."), ("xx", "one word"), ("en", "the zz " * 2000)]


@pytest.mark.parametrize(("longest", "block", "size"), [(3, 1 << 21, 1 << 23), (3, 200, 1500), (2, 300, 1500), (4, 300, 3000)])
def test_equals_plain_counts(spark, rows, longest, block, size):
    df = spark.createDataFrame([(i, lang, t, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=4, longest=longest, top=25, block_words=block, range_bytes=size).collect())
    assert got == plain(rows, 4, longest, 50, 25)


def test_hot_prefixes_change_nothing(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    plain_rows = df.selectExpr("coalesce(lang, 'und') as lang", "cast(coalesce(text, '') as binary) as text")
    assert len(phrases.hot_prefixes(plain_rows, 30000, 9)) > 0
    got = [sorted(tuple(r) for r in phrases.collocations(df, least=4, top=25, block_words=300, range_bytes=size).collect()) for size in (1 << 23, 3000)]
    assert got[0] == got[1]


def test_slices_lose_nothing(spark, rows, monkeypatch):
    text = ". ".join(t or "" for _, t in rows).encode()
    whole = [x for s in phrases.tokens(text) for x in s]
    monkeypatch.setattr(phrases, "SLICE", 50)
    assert [x for s in phrases.tokens(text) for x in s] == whole


def some_paths(seed, n=200):
    r = random.Random(seed)
    c = Counter()
    for _ in range(n):
        c[tuple(r.choice([b"a", b"bb", b"c", "é".encode(), b"zz"]) for _ in range(r.randrange(1, 4)))] += r.randrange(1, 5)
    return c


def told(t):
    return {p: int(w) for d in range(len(t.parent)) for p, w in zip(t.paths(d + 1), t.weight[d], strict=True) if w}


def test_transducers():
    a, b = some_paths(1), some_paths(2, 50)
    ta, tb = (Transducer.from_sorted(sorted(c), [c[p] for p in sorted(c)]) for c in (a, b))
    assert told(ta) == a
    assert told(Transducer.from_bytes(ta.to_bytes())) == a
    assert told(Transducer.union([ta, tb])) == a + b
    assert told(Transducer.union([])) == {}
    left = ta.part([w > 3 for w in ta.weight])
    assert told(left) == {p: n for p, n in a.items() if n > 3}
    found = [x for n in ta.compose(tb) for x in n]
    asked = [p for d in range(len(tb.parent)) for p in tb.paths(d + 1)]
    assert found == [a.get(p, 0) for p in asked]
    big = Transducer.from_sorted([(b"w",)], [1 << 40])
    assert told(Transducer.from_bytes(big.to_bytes())) == {(b"w",): 1 << 40}


@pytest.mark.parametrize("hot", [False, True])
def test_ranges_divide_the_paths(hot):
    a = some_paths(4)
    t = Transducer.from_sorted(sorted(a), [a[p] for p in sorted(a)])
    hot = t.spread(phrases.NONE)[1][:5] if hot else phrases.NONE
    parts = dict(t.divided(7, hot))
    assert sum((Counter(told(p)) for p in parts.values()), Counter()) == a
    # a path's range depends on the path alone
    for i, p in parts.items():
        own = told(p)
        again = Transducer.from_sorted(sorted(own), [1] * len(own))
        assert all(int(r) == i for d, rs in enumerate(again.ranges(7, hot)) for r, w in zip(rs, again.weight[d], strict=True) if w)


def test_scores_are_exact(spark):
    big = [(10**15, 10**15 + 7, 10**15 + 9), (3, 7, 11), (10, 10, 10), (123456789012, 987654321098, 123456789013)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = [x[0] for x in df.select(phrases.cut_score(df["a"], df["l"], df["r"])).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in big]


def test_ties_and_no_rows(spark):
    df = spark.createDataFrame([("en", "x y. b a. ")] * 12, "lang string, text string")
    got = [(r["rank"], r["phrase"], r["score"]) for r in phrases.collocations(df).orderBy("rank").collect()]
    assert got == [(1, "b a", 1_000_000), (2, "x y", 1_000_000)]
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_text_blocks():
    words = [b"a", b"b"]
    t = Transducer.from_text(words, np.array([-1, 0, 1, 0, -1, 1, -1]), 3)
    assert told(t) == {(b"a",): 2, (b"b",): 2, (b"a", b"b"): 1, (b"b", b"a"): 1, (b"a", b"b", b"a"): 1}
    assert told(Transducer.from_text([], np.array([-1, -1]), 3)) == {}
