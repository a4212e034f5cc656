"""Line dedup: recall against brute force, nothing that depends on unrelated rows, ids of any type, long documents."""

import random
import re

import pytest

from lacuna.llm import linededup
from test_small_ops import edits, words


def near_pairs(r, n, changed, count):
    out = []
    while len(out) < count:
        a = words(r, n).split()
        b = list(a)
        for i in r.sample(range(n), changed):
            b[i] = words(r, 1)
        a, b = " ".join(a), " ".join(b)
        if a != b and edits(a, b) <= 0.2 * len(a):
            out.append((a, b))
    return out


def test_recall_is_over_nine_tenths(spark):
    r = random.Random(41)
    cases = {(n, e): near_pairs(r, n, e, 120) for n, e in ((30, 1), (30, 3), (12, 1), (6, 1), (60, 8))}
    rows = [(k, t) for k, t in enumerate(t for pairs in cases.values() for p in pairs for t in p)]
    found = []
    for others in (0, 20_000):
        more = [(1_000_000 + k, words(r, 20)) for k in range(others)]
        out = linededup.dedup_lines(spark.createDataFrame(rows + more, "doc_id long, text string")).where("doc_id < 1000000").collect()
        kept = {x["doc_id"] for x in out if x["n_kept"]}
        found.append([k for k, _ in rows if k not in kept])
    assert found[0] == found[1]  # the same with or without unrelated lines
    gone, at = set(found[0]), 0
    for case, pairs in cases.items():
        share = sum(at + 2 * k + 1 in gone for k in range(len(pairs))) / len(pairs)
        assert share >= 0.9, (case, share)
        at += 2 * len(pairs)
    assert all(k % 2 for k in gone)


def test_links_equal_brute_force_where_found(spark):
    """What goes has a like line that stays before it, by components of the true links."""
    r = random.Random(42)
    base = [words(r, r.choice([4, 9, 15])) for _ in range(30)]
    texts = []
    for i in range(150):
        w = base[i % 30].split()
        if i >= 30:
            w[r.randrange(len(w))] = words(r, 1)
        texts.append(" ".join(w))
    root = list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(texts):
            for j in range(i):
                if abs(len(a) - len(texts[j])) < 20 and edits(a, texts[j]) <= 0.2 * max(len(a), len(texts[j])):
                    root[i] = root[j] = min(root[i], root[j])
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kept = {x["doc_id"] for x in out if x["n_kept"]}
    assert {i for i in range(len(texts)) if root[i] == i} <= kept
    assert len(kept - {i for i in range(len(texts)) if root[i] == i}) <= 0.1 * len(texts)


def test_text_ids_and_clashing_names(spark):
    rows = [("b", "one line of words here", 1, 2), ("a", "One line of words here!", 3, 4), (None, "one line of words here\nown line of its own", 5, 6), ("c", None, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id string, text string, o int, more int")
    got = {x["doc_id"]: (x["n_lines"], x["n_kept"], x["text_out"]) for x in linededup.dedup_lines(df).collect()}
    assert got == {"a": (1, 1, "One line of words here!"), "b": (1, 0, ""), None: (2, 1, "own line of its own"), "c": (0, 0, None)}
    assert linededup.keep_first_lines(df).columns == df.columns


def test_a_document_of_many_lines(spark):
    text = "\n".join(["x" * 50_000, "字" * 20_000, *(f"line number {i} {words(random.Random(i), 3)}" if i % 3 else "" for i in range(30_000))])
    out = linededup.dedup_lines(spark.createDataFrame([(1, text), (2, "字" * 20_000)], "doc_id long, text string")).collect()
    got = {x["doc_id"]: x for x in out}
    assert got[1]["n_lines"] == 20_002 and got[2]["n_kept"] == 0


def long_words(r, n, size):
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(n)]


def share_found(spark, pairs):
    """Of pairs of lines, how many lose their second; no first one goes."""
    rows = [(k, t) for k, t in enumerate(t for p in pairs for t in p)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {x["doc_id"] for x in out if not x["n_kept"]}
    assert not any(k % 2 == 0 for k in gone)
    return len(gone) / len(pairs)


@pytest.mark.parametrize(("common", "own", "groups"), [(9, 14, 60), (9, 20, 200), (6, 14, 60), (15, 14, 100)])
def test_lines_of_a_template(spark, common, own, groups):
    r = random.Random(common * own)
    form = long_words(r, common, 11)
    pairs = []
    for _ in range(groups):
        w = long_words(r, own, 5)
        v = list(w)
        v[r.randrange(own)] = long_words(r, 1, 5)[0]
        pairs.append((" ".join(form + w), " ".join(form + v)))
    assert share_found(spark, pairs) >= 0.9


@pytest.mark.parametrize(("letters", "n"), [("abcdefghijklmnopqrstuvwxyz0123456789", 300), ("abcdefghijklmnopqrstuvwxyz0123456789", 600), ("".join(map(chr, range(0x4E00, 0x5200))), 600), ("".join(map(chr, range(0x4E00, 0x5200))), 5000), ("abcdefghijklmnopqrstuvwxyz0123456789", 30000)])
def test_long_lines_without_spaces(spark, letters, n):
    r = random.Random(n)
    pairs = []
    for _ in range(12):
        a = [r.choice(letters) for _ in range(n)]
        b = list(a)
        for _ in range(1 + n // 300):
            b[r.randrange(n)] = r.choice(letters)
        del b[r.randrange(n)]
        pairs.append(("".join(a), "".join(b)))
    assert share_found(spark, pairs) >= 0.9


def test_log_lines(spark):
    r = random.Random(9)
    pairs = []
    for i in range(80):
        head = f"2024-03-{i % 28 + 1:02d} service=gateway level=info handler=process_incoming_request"
        tail = f"session {r.getrandbits(48):x} user {r.getrandbits(40):x} path {' '.join(long_words(r, 9, 6))}"
        pairs.append((f"{head} {tail} took 17ms", f"{head} {tail} took 18ms"))
    assert share_found(spark, pairs) >= 0.9


def test_no_link_within_a_bucket_is_left_out(spark):
    """Lines of templates, each pair with a letter changed in all its own words: what shares a key and is alike is connected,
    whichever line is its bucket's smallest, in buckets of one tile and of many."""
    r = random.Random(24)
    form = [long_words(r, 5, 11) for _ in range(2)]
    texts = []
    for g in range(120):
        own = long_words(r, 8, 5)
        texts += [" ".join(form[g % 2] + [w[:3] + r.choice("0123456789") + w[4:] for w in own]) for _ in range(2)]
    texts += texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = linededup.lines_of(df.selectExpr("doc_id as o", "0 as x", "text"))
    buckets = {}
    for x in linededup.keys(lines.select("h", "norm")).join(lines.select("h", "o"), "h").collect():
        buckets.setdefault(x["key"], set()).add(x["o"])
    pairs = {(a, b) for among in buckets.values() for a in among for b in among if a < b}
    links = [(a, b) for a, b in pairs if edits(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b]))]
    assert len(links) > 50
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    for tile in (512, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(linededup, "TILE", tile, raising=False)
            m.setattr(linededup, "OFTEN", 2 if tile == 7 else 1000, raising=False)
            out = linededup.dedup_lines(df).collect()
        assert {x["doc_id"] for x in out if x["n_kept"]} == want


def test_a_pair_in_many_buckets_is_compared_once(spark, monkeypatch):
    """Like lines that share several keys, none of them like the smallest line of their buckets, are one row each pair, and the same pairs
    as by brute force over the buckets."""
    r = random.Random(33)
    texts = {h: " ".join(["common", "prefix", *long_words(r, 9, 6)]) for h in range(100, 104)}
    for h in range(200, 224):
        w = texts[100 + h % 4].split()
        w[r.randrange(2, 11)] = long_words(r, 1, 6)[0]
        texts[h] = " ".join(w)
    texts |= {1: "x", 2: "an unlike smallest line", 3: "y"}
    members = [(key, h) for key in (7, 8, 9) for h in texts if h > 3] + [(7, 1), (8, 2), (9, 3)]
    head = {7: 1, 8: 2, 9: 3}
    buckets = spark.createDataFrame([(k, h, len(texts[h]), head[k], len(texts[head[k]])) for k, h in members], "key long, h long, n int, head long, head_n int")
    norms = spark.createDataFrame(list(texts.items()), "h long, norm string")
    root = spark.createDataFrame([(200, 100), (204, 100)], "node long, root long")
    same = lambda a, b: {a, b} <= {100, 200, 204}
    want = {(a, b) for a in texts for b in texts if 3 < a < b and not same(a, b) and edits(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b]))}
    assert len(want) > 50
    monkeypatch.setattr(type(norms), "distinct", lambda self: self)  # the rows that the join itself makes
    for tile in (512, 5):
        monkeypatch.setattr(linededup, "TILE", tile)
        got = [tuple(sorted(x)) for x in linededup.apart(buckets, root, norms.select("h", *linededup.forms(norms["norm"])), 0.8).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_lines_carry_only_what_is_compared(spark):
    """A line has characters and a core or, if only its words are compared, neither; keys are worked out once, not again in a filter."""
    texts = ["short line", ("word " * 200).strip(), "x" * 900, "x" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "h long, norm string")
    got = {r["h"]: (r["core"] is not None, r["chars"] is not None, r["words"] is not None, r["pieces"] is not None) for r in df.select("h", *linededup.forms(df["norm"])).collect()}
    assert got == {0: (True, True, False, False), 1: (False, False, True, False), 2: (True, True, True, False), 3: (False, False, True, True)}
    of = linededup.keys(df)
    plan = of._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 3, plan  # the long words, and all words by their two kinds
    assert of.where("key is null").count() == 0


def test_normal_form_of_runs_between_words(spark):
    """Every run of other characters is one space, single spaces too, at line feeds and at both ends."""
    texts = ["a b", "a  b", "a - b", " a", "a ", "-", " ", "", "a\n b", "a \nb", "a-\n-b", "-a b- c\t d", "a\u00a0b", "É É  é", "1 2,3", "a , b", "\n \n", "a. b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("text", linededup.normal(df["text"]).alias("n")).collect():
        want = re.sub(r"[^\w\n]+", " ", r["text"].lower())
        assert r["n"] == want, r


def test_buckets_are_members_with_their_smallest(spark):
    """Each bucket of two or more gives its lines but the smallest, which each row names."""
    df = spark.createDataFrame([(5, 50, 1), (3, 30, 1), (9, 90, 1), (4, 40, 2), (3, 30, 3), (4, 40, 3)], "h long, n int, key long")
    assert sorted(map(tuple, linededup.bucketed(df).collect())) == [(1, 5, 50, 3, 30), (1, 9, 90, 3, 30), (3, 4, 40, 3, 30)]
