"""Factors on hand-written frames, streams, limiter."""

from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import score
from lacuna.operators.snowball import snowball
from lacuna.streaming import writeback


@pytest.mark.parametrize(
    ("topic", "field", "value", "fallback"),
    [
        ([10, 10, 10, 10, 21], [100, 0, 0, 0, 201], 0.5, False),
        ([9, 9, 9, 9, 39], [99, 0, 0, 0, 99], 1.0, False),
        ([39, 9, 9, 9, 9], [99, 0, 0, 0, 99], 0.0, False),
        ([1, 1, 1, 1, 1], [99, 0, 0, 0, 99], 0.5, True),
        ([10, 10, 10, 10, 15], [0, 0, 0, 0, 0], 0.75, False),
    ],
)
def test_temporal(spark, topic, field, value, fallback):
    years = range(2016, 2021)
    cases = spark.createDataFrame([(1, 2020)], "case_id int, cutoff_year int")
    counts = spark.createDataFrame([(1, y, n) for y, n in zip(years, topic, strict=True)], "case_id int, year int, n long")
    base = spark.createDataFrame(list(zip(years, field, strict=True)), "year int, n long")
    none = spark.createDataFrame([], "case_id int, pos int")
    rec = spark.createDataFrame([], "pos int, publication_date date")
    r = score.temporal(cases, counts, base, none, rec).first()
    assert (round(r["value"], 2), r["is_fallback"]) == (pytest.approx(value, abs=0.01), fallback)


def test_novelty_only_falls_with_more_art(spark):
    own = spark.createDataFrame([(1, "F1", "a"), (1, "F2", "b"), (1, "F3", "c")], "case_id int, id string, feature_id string")
    docs = spark.createDataFrame([(10, "a"), (11, "a"), (11, "b")], "pos int, feature_id string")
    art = lambda *p: spark.createDataFrame([(1, x, i) for i, x in enumerate(p)], "case_id int, pos int, place int")
    few, more, none = (score.novelty(own, a, docs).first() for a in (art(10), art(10, 11), art()))
    assert more["value"] <= few["value"]
    assert few["value"] == pytest.approx(0.5 * (2 / 3) + 0.5 * (2 / 3))
    assert (none["value"], none["is_fallback"]) == (0.5, True)


def test_crowding_mid_rank(spark):
    cases = spark.createDataFrame([(1, "2020-01-01")], "case_id int, cutoff string")
    matched = spark.createDataFrame([(1, 5), (1, 6)], "case_id int, pos int")
    background = spark.createDataFrame([("2020-01-01", n) for n in (0, 2, 2, 9)], "cutoff string, documents long")
    assert score.crowding(matched, cases, background).first()["value"] == 0.5


def test_sensitivity_has_sixteen_rows(spark):
    f = spark.createDataFrame([(1, k, v, False) for k, v in (("novelty", 0.8), ("crowding", 0.6), ("temporal", 0.5), ("regional", 0.4))], "case_id int, factor string, value double, is_fallback boolean")
    b, s = score.combine(f)
    assert s.first()["score"] == 63
    assert score.sensitivity(b).count() == 16


def test_limiter(spark):
    t0 = pd.Timestamp("2024-01-01").to_pydatetime()
    log = [(1, t0 + timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 600, 601, 602))] + [(2, t0, 9)]
    df = spark.createDataFrame(log, "client int, ts timestamp, seq long")
    got = {r["seq"]: r["allowed"] for r in writeback.sliding_limit(df, 2, 600).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 9: True}


def test_snowball_budget(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 4), (3, 5)], "src int, dst int")
    got = snowball(e, spark.createDataFrame([(0,)], "node int"), F.col("dst") != 2, 2, budget=1).collect()
    assert sorted((r["node"], r["hop"], r["status"]) for r in got) == [(0, 0, "seed"), (1, 1, "passed"), (2, 1, "gated")]


def test_write_back_is_idempotent(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    kind = "id string, added_at timestamp, seq long, origin string"

    def put(rows):
        spark.createDataFrame([(i, pd.Timestamp(t).to_pydatetime(), s, "x") for i, t, s in rows], kind).write.mode("append").json(src)

    def run():
        s = spark.readStream.schema(kind).json(src)
        writeback.write_back(s, store, ck, lambda x: x, ["added_at", "seq"], cap=3).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(store).collect())

    put([("a", "2024-01-01", 1), ("b", "2024-01-01", 2), ("a", "2024-01-01", 3)])
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    put([("b", "2024-01-01 05:00", 4), ("c", "2024-01-01 06:00", 5), ("d", "2024-01-01 07:00", 6), ("e", "2024-01-02", 7)])
    assert run() == ["a", "b", "c", "e"]


def test_cases_and_records_meet_as_classes(spark):
    """Matches by classes are those of comparing all rows, for more features than a word of bits holds."""
    import random

    draw = random.Random(5)
    own = {c: draw.sample(range(90), 8) for c in range(30)} | {30: [], 31: [3]}
    docs = {p: draw.sample(range(90), draw.randrange(30)) for p in range(300)}
    docs |= {p: docs[p % 7] for p in range(300, 340)}
    day = lambda n: f"20{n % 20 + 10}-0{n % 9 + 1}-15"
    f = spark.createDataFrame([(c, f"f{x}") for c in own for x in own[c]] + [(2, None)], "case_id long, feature_id string")
    d = spark.createDataFrame([(p, f"f{x}") for p in docs for x in docs[p]], "pos long, feature_id string")
    cases = spark.createDataFrame([(c, day(c)) for c in own], "case_id long, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    records = spark.createDataFrame([(p, None if p % 50 == 0 else day(p), f"J{p % 3}", f"A{p % 4}", p % 6) for p in docs], "pos long, publication_date string, jurisdiction string, company_name string, year int")
    records = records.withColumns({"publication_date": F.to_date("publication_date"), "assignees": F.array("company_name")})
    want = {(c, p) for c in own for p in docs if len(set(own[c]) & set(docs[p])) >= 2 and p % 50 and day(p) <= day(c)}
    s = score.Shared(f, d)
    assert len(s.words) == 2
    got = [tuple(r) for r in s.matched(cases, records).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    cells = {}
    for c, p in want:
        cells.setdefault((c, int(day(p)[:4]), f"J{p % 3}", f"A{p % 4}"), []).append(p)
    assert {tuple(r) for r in s.matched_counts(cases, records).select("case_id", "year", "jurisdiction", "applicant", "n", "pos").collect()} == {(*k, len(v), min(v)) for k, v in cells.items()}
    years = {}
    for c in own:
        for p in docs:
            if set(own[c]) & set(docs[p]):
                years[c, p % 6] = years.get((c, p % 6), 0) + 1
    assert {tuple(r) for r in s.year_counts(records).collect()} == {(*k, n) for k, n in years.items()}


@pytest.mark.parametrize("name", ["matched_set", "crowding", "regional", "temporal", "year_counts", "bm25_top5", "bm25_with_external"])
def test_every_record_is_a_case(spark, sf_dir, name):
    """Records whose id isn't divisible by 100 are cases as well; factors have a row for each."""
    from lacuna.plans import catalog

    got = {r["case_id"] for r in catalog.QUERIES[name](spark, sf_dir).select("case_id").distinct().collect()}
    every = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert got <= every and any(c % 100 for c in got)
    if name in ("crowding", "regional", "temporal"):
        assert got == every
