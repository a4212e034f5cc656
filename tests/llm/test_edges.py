"""Cases that once failed: long names, repeated and null ids, vectors of several lengths, clashing names."""

import random
import time

import numpy as np
import pytest

from lacuna.llm import covertree, jaccard, language, mixing, pii, secrets


def test_every_pattern_on_a_long_text(spark):
    n = 1 << 20
    texts = ["host=" + "a." * (n // 2) + "com", "https://" + "a." * (n // 2), "https://x/" + "p" * n, "password=" + "a" * n, "AKIA" + "A" * n, "0a" * (n // 2), "client_id=" + "a" * n, "aA1+" * (n // 4), "token=abcdefgh " * (n // 15)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    assert len(got) == len(texts)
    assert (got[3]["n_assign"], got[4]["n_access"], got[5]["n_hex"]) == (1, 1, 1)
    assert got[8]["n_assign"] == n // 15
    assert got[8]["spans"].endswith(f"assign:{15 * (n // 15 - 1)}:{15 * (n // 15) - 1}")


def test_rows_come_back_whatever_ids_and_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.01]), (None, [0.0, 1.0, 0.0]), (7, None), (7, [0.0, 0.0]), (5, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(str, covertree.near_links(df).collect()))
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 1, 5, False), (7, 0, 7, True), (7, 0, 7, True), (5, 1, 5, True)]
    assert got == sorted(f"Row(vec_id={a}, n_links={b}, component_id={c}, kept={d})" for a, b, c, d in want)
    text = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [1.0, 2.0])], "vec_id string, embedding array<float>")
    assert {r["component_id"] for r in covertree.near_links(text).collect()} == {"a"}


def test_links_over_blocks_of_several_lengths(spark):
    r = np.random.default_rng(3)
    vecs = []
    for d in (4, 6):
        base = r.standard_normal((12, d))
        vecs += [base[i % 12] + 0.1 * r.standard_normal(d) for i in range(90)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x["n_links"] for x in covertree.near_links(df, block=16, pivots=5).collect()}
    for lo, hi in ((0, 90), (90, 180)):
        x = np.array(vecs[lo:hi])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert [got[i] for i in range(lo, hi)] == ((x @ x.T >= 0.95).sum(1) - 1).tolist()


def test_letters_of_all_planes(spark):
    rows = [(i, chr(0x30010 + i) * 6, "zz") for i in range(8)] + [(i, "some plain words", "en") for i in range(8, 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(df).collect()}
    assert "und" not in {got[i] for i in range(8)}


def test_surplus_seats_go_on(spark):
    rows = [(i, "g", float(w), 20, most) for i, (w, most) in enumerate([(10, 2), (5, 30), (5, 6), (1, 1)])]
    df = spark.createDataFrame(rows, "i int, g string, w double, k long, most long")
    got = {x["i"]: x["n"] for x in mixing.apportion(df, ["g"], "w", "k", "n", "most").collect()}
    assert sum(got.values()) == 20
    assert all(got[i] <= most for i, *_, most in rows)


def test_take_with_clashing_names(spark):
    rows = [(i, "w " * (i % 50), "s", 1, 2, 3) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _times int, _copy int, id int")
    out = mixing.take(df)
    assert out.columns == df.columns
    assert out.count() > 0


def test_blocks_are_drawn_by_the_seed(spark):
    """Block selection by brute force: the permutation takes each residue once, and seeds give other blocks."""
    assert all(p % n for p in mixing.STRIDES for n in range(2, 2049))
    rows = [(i, "w " * 7, "s") for i in range(400)] + [(1000 + i, "w " * 9, "t") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = ({x["doc_id"]: x["taken"] for x in mixing.mix(df, seed).collect()} for seed in (1, 2))
    assert one != two
    assert abs(sum(one.values()) - sum(two.values())) <= 64


def test_spans_are_found_in_linear_time():
    text = "a@b.cd " * 20_000 + "ab (at) cd (dot) ef " * 3_000
    began = time.time()
    found = pii.candidates(text)
    assert len(found) == 23_000
    assert time.time() - began < 10


@pytest.mark.parametrize("seed", [1, 2])
def test_reliabilities_by_brute_force(seed):
    """Counted patterns give what the rows themselves give, and better labelers are trusted more."""
    r = random.Random(seed)
    truth = [r.random() < 0.4 for _ in range(3000)]
    vote = lambda t, good: (2 if t else 0) if r.random() < good else r.choice([0, 1, 2])
    rows = np.array([[vote(t, g) for g in (0.95, 0.8, 0.6, 0.2)] for t in truth])
    each = pii.reliabilities(rows, np.ones(len(rows)))
    patterns, at, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    assert np.allclose(pii.reliabilities(patterns, n.astype(float))[at.ravel()], each, atol=1e-6)
    assert ((each > 0.5) == np.array(truth)).mean() > 0.95


def test_stages_with_names_of_their_own(spark):
    rows = [(i, f"some words of text number {i // 2} that stand here for all to read again", i % 3, "x", True, "keep") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _at string, _all boolean, _md5 string")
    out = jaccard.dedup(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"], r["_id"], r["_md5"], r["_all"]) for r in out.collect())
    assert got == [(0, 0, "keep", True), (2, 2, "keep", True), (4, 1, "keep", True)]


def test_take_tells_rows_of_one_id_apart(spark):
    long = "word " * 5000
    rows = [(7, long, "a", "x"), (7, "one", "a", "x"), (None, long + "more", "a", "x"), (None, "two", "b", "x"), (None, None, "b", "x"), (8, "same text", "a", "1"), (8, "same text", "a", "2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, digest string")
    m = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(df).where("size > 2").collect()}
    out = mixing.take(df).collect()
    assert mixing.take(df).columns == df.columns
    for i, n, text in ((7, 5000, long), (None, 5001, long + "more")):
        times = sum(r["doc_id"] == i and r["text"] == text for r in out)
        assert m[i, n] // n <= times <= -(-m[i, n] // n)
    assert all(sum(r["doc_id"] == i and r["text"] == t for r in out) <= 2 for i, t in ((7, "one"), (None, "two")))
    assert sum(r["text"] is None for r in out) == 1
    assert mixing.take(df.limit(0)).count() == 0


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Links over many blocks and rounds are all links, and vectors aren't shuffled once a pair of blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + rng.normal(size=(150, 64)) * 0.1
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    got = {r["vec_id"]: r["n_links"] for r in covertree.near_links(df, block=16, pivots=5).collect()}
    time.sleep(1)
    assert shuffled() - before < 1_000_000  # 3.6 MB, when each pair of the 21 blocks was a row
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate((((u @ u.T) >= 0.95).sum(1) - 1).tolist())) and sum(got.values()) > 100
