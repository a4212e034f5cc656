"""Tokenizer alignment against all pairs of overlapping byte ranges."""

import hashlib
from collections import Counter

import pytest

from lacuna.llm import align
from lacuna.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
TEXTS = [
    (1, "Hello world, don't stop."), (2, None), (3, ""), (4, "  two  spaces \n\t x  "), (5, " "), (None, "héllo ☃ 中文 <|endoftext|> <s> x"), (7, "a\0b"),
    (8, "x" * 5000), (1, "Hello world, don't stop."), (9, "▁ underline ▁▁ x"), (10, "<|endoftext|>"), (11, "tab\tand\rreturn {\r\n x"), (12, "a▁ b"), (13, "a▁ b"),
    (14, "word " * 3000), (15, "نص عربي और हिन्दी"), (16, "　wide　 space   x"), (17, "\x1c sep \x1d x"), (18, "🙂🙃 👩‍👩‍👧"),
]


def plain(texts):
    pair = align.Pair(A, B)
    rows = []
    for t in texts:
        row = None
        if t:
            ids_a = pair.a.encode(" " + t, add_special_tokens=False).ids
            ids_b = pair.b.encode(t)
            if b"".join(map(pair.bytes_a.__getitem__, ids_a)) == (" " + t).encode() == b"".join(map(pair.bytes_b.__getitem__, ids_b)):
                spans = []
                for ids, sizes in ((ids_a, pair.sizes_a), (ids_b, pair.sizes_b)):
                    at, own = 0, []
                    for i in ids:
                        own.append((at, at + sizes[i], i))
                        at += sizes[i]
                    spans.append(own)
                if len(ids_a) * len(ids_b) < 5_000_000:
                    links = [(i, j) for u, v, i in spans[0] for y, z, j in spans[1] if u < z and y < v]
                else:
                    links = [(i, j) for k, (u, v, i) in enumerate(spans[0]) for y, z, j in spans[1][max(0, k - 50) : k + 50] if u < z and y < v]
                ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
                groups, lo = [], 0
                for e in ends:
                    groups.append("|".join(",".join(str(i) for u, v, i in s if lo <= u and v <= e) for s in spans) if len(ends) < 3500 else "")
                    lo = e
                row = (len(ids_a), len(ids_b), len(ends), links, ";".join(groups))
        rows.append(row)
    count = Counter(x for r in rows if r for x in set(r[3]))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for r in rows:
        out.append((0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[x] == top[x[0]] for x in r[3]), sum(count[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest()))
    return out


@pytest.mark.parametrize("links", [align.CHUNK_LINKS, 40])
def test_equals_all_pairs(spark, links):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, chunk string").repartition(3)
    got = sorted(tuple(map(str, r)) for r in align.align_tokens(df, A, B, chunk_links=links).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    want = sorted(tuple(map(str, (i, *r))) for (i, _), r in zip(TEXTS, plain([t for _, t in TEXTS]), strict=True))
    assert got == want


def test_units_read_as_whole_texts(spark, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    pair = align.Pair(A, B)
    assert pair.splits
    for t, rows in zip(texts, pair.units(texts), strict=True):
        a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
        whole = [(e, p, q) for e, p, q, _ in align.align(a, b, pair.sizes_a, pair.sizes_b)]
        assert (sum(r[0] for r in rows), sum(r[1] for r in rows), sum(r[2] for r in rows)) == (len(a), len(b), len(whole))


def test_texts_whose_bytes_differ_have_no_tokens(monkeypatch):
    pair = align.Pair(A, B)
    pair.bytes_b = [b"?" if x == b" Hello" else x for x in pair.bytes_b]
    [first, second, again] = pair.units(["Hello there", "other words", "Hello there"])
    assert first == again == []
    assert len(second) == 2


def test_expand_slices():
    # 0-2-5-9 against 0-3-4-9
    assert align.expand([1, 2, 3], [7, 8, 9], [2, 5, 9], [3, 4, 9]) == [a << 32 | b for a, b in [(1, 7), (2, 7), (2, 8), (2, 9), (3, 9)]]


def test_groups_are_told(spark):
    df = spark.createDataFrame([(1, "don't"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in align.align_tokens(df, A, B, groups=True).collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"]
    assert rows[2]["groups"] == rows[2]["groups_sha256"] == ""
    assert align.align_tokens(df.limit(0), A, B).count() == 0


def test_a_small_memory_changes_nothing(spark, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    one, few = align.Pair(A, B), align.Pair(A, B, kept=3)
    for t in [*texts, *texts]:
        assert one.units([t]) == few.units([t])


def test_many_units_at_once_are_as_one_by_one(monkeypatch):
    """Units learned together are what align says of each by itself, and groups of one id each aren't walked."""
    units = ["Hello", "don't", "épare,", "नमस्ते", "🙂🙃", "tionthst", "x" * 50, "a", "ÈMENT!!"]
    pair = align.Pair(A, B)
    want = []
    for u in units:
        a, b = pair.a.encode(" " + u, add_special_tokens=False).ids, pair.b.encode(u)
        groups = list(align.align(a, b, pair.sizes_a, pair.sizes_b))
        cut = [(0, 0), *[(p, q) for _, p, q, _ in groups]]
        said = ";".join(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}" for (i, j), (p, q) in zip(cut, cut[1:]))
        want.append((len(a), len(b), len(groups), said, [x for g in groups for x in g[-1]]))
    assert any(len(w[4]) > w[2] for w in want)
    walked = []
    monkeypatch.setattr(align, "align", lambda *x, f=align.align: walked.append(x) or f(*x))
    got = pair.units([" ".join(units)])[0]
    assert [(*r[:4], list(memoryview(r[4]).cast("q"))) for r in got] == want
    assert not walked
