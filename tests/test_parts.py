"""Lookups, schemes, two-stage search, commits, keyed state, file order, paging, titles and notes on hand-written rows."""

import json
import math
import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.operators import clean, features, lookup, match, notes, retrieve, schemes, score
from lacuna.operators.lookup import Term
from lacuna.sources import commits, ingest
from lacuna.streaming import keyed

# --- many terms at once -----------------------------------------------------------------------------------


def plain_counts(text, terms):
    out = {}
    for t in terms:
        edge = lambda c, b: (r"(?<![A-Za-z0-9_])" if b else r"(?![A-Za-z0-9_])") if re.match("[A-Za-z0-9_]", c) else (r"(?<=[A-Za-z0-9_])" if b else r"(?=[A-Za-z0-9_])")
        n = len(re.findall(edge(t.text[0], True) + re.escape(t.text) + edge(t.text[-1], False), text, 0 if t.case else re.I | re.A))
        if n:
            out[t.key] = out.get(t.key, 0) + n
    return out


def test_many_terms_in_one_pass(spark):
    r = random.Random(2)
    terms = [Term(0, "5g", False), Term(0, "beyond 5g", False), Term(1, "RAN", True), Term(2, "a b a", False), Term(3, "self-service", False), Term(4, "c++", True), Term(5, "zz", False), Term(6, "a.b", True), Term(7, "x  y", False), Term(8, "a a", True)]
    bits = ["5G", "beyond", "beyond 5g", "ran", "RAN", "a", "b", "A", "self-service", "c++", "c++x", "zzé", "ézz", "a.b", "x  y", "-", "_", "é", "zz_", "\n"]
    texts = ["", " ", "a b a b a b a", "a a a a", *["".join(r.choice(bits) + r.choice([" ", " ", "", "-"]) for _ in range(r.randrange(25))) for _ in range(200)]]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(4)
    got: dict = {}
    for row in lookup.found(df, ["pos"], "text", terms).collect():
        got.setdefault(row["pos"], {})[row["key"]] = row["n"]
    for i, t in enumerate(texts):
        assert got.get(i, {}) == plain_counts(t, terms), t
    assert lookup.found(df, ["pos"], "text", []).count() == 0


def test_features_count_overlapping_terms(spark):
    tax = [("fiveg", "5G", ["5g", "beyond 5g"], []), ("ran", "RAN", [], ["RAN"])]
    df = spark.createDataFrame([(1, "Beyond 5G RAN", "ran 5g"), (2, "ran", None), (3, None, None)], "pos long, title string, abstract string")
    got = sorted((r["pos"], r["feature_id"], r["tf"]) for r in features.document_features(df, tax).collect())
    assert got == [(1, "fiveg", 3), (1, "ran", 1)]
    pairs = {(r["f1"], r["f2"]): r["documents"] for r in features.pair_counts(df, tax).collect()}
    assert pairs == {("fiveg", "ran"): 1}


def test_term_counts_equal_patterns(spark):
    groups = [["slicing", "network slicing", "slice", "切片"], ["nfv", "nfv", "network function virtualization", "vnf"]]
    texts = ["Network-Slicing for VNFs", "slices and sliced", "網路切片 nfv", "slicer", "network function virtualizations", "quantum keys", "quanta", "a slice"]
    df = match.searchable(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "pos long, title string, abstract string"))
    terms = ["slice", "nfv slice", "quant", "quantum", "qua", "切片", "", "c++"]
    got = {r["term"]: r["n"] for r in match.term_counts(df, terms, groups).collect()}
    assert got == {t: df.where(match.matching(match.parse(t, groups))).count() for t in terms}


def test_only_words_of_terms_leave_their_row(spark):
    texts = ["network slicing of a network of slices, not under test", "nothing to see here " * 50, "", "underneath under_neath"]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, t string")
    kept = match.candidates(F.col("t"), [["network slicing", "slices"], []], [[], ["under"]])
    got = {r["pos"]: sorted(r["k"]) for r in df.select("pos", kept.alias("k")).collect()}
    assert got == {0: ["network of", "network slicing", "slices", "under"], 1: [], 2: [], 3: ["under", "underneath"]}


def test_document_terms_deal_texts_once(spark, monkeypatch):
    texts = ["alpha alpha beta", "beta gamma delta delta delta", "", None, "omega alpha gamma"]
    cases = spark.createDataFrame(list(enumerate(texts)), "case_id long, text string")
    count = {"alpha": 2, "beta": 2, "gamma": 2, "delta": 1}
    df = spark.createDataFrame(list(count.items()), "token string, df long")
    total = spark.createDataFrame([(5,)], "N long")
    got = {}
    for few in (500_000, 0):
        monkeypatch.setattr(features, "FEW_TOKENS", few, raising=False)
        out = features.document_terms(cases, df, total, 2)
        got[few] = sorted((r["case_id"], r["rank"], r["token"], round(r["weight"], 9)) for r in out.collect())
        if few:
            dealt = re.findall(r"hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
            assert dealt and not any("token" in d for d in dealt)  # by case alone
    want = []
    for case, t in enumerate(texts):
        w = {x: (1 + math.log((t or "").split().count(x))) * math.log(5 / count[x]) for x in set((t or "").split()) & set(count)}
        want += [(case, n, x, round(w[x], 9)) for n, x in enumerate(sorted(w, key=lambda x: (-round(w[x], 9), x))[:2], 1)]
    assert got[0] == got[500_000] == sorted(want)


def test_longest_phrase_first():
    groups = [["VNF", "virtualised network function", "vnf"], ["NFV", "network function virtualization", "nfv"], ["slicing", "slicing"]]
    labels = lambda q: [c.label for c in match.parse(q, groups)]
    assert labels("virtualised network function virtualization") == ["NFV", "virtualised"]
    assert labels("virtualised network function now") == ["VNF", "now"]
    assert labels("slicing of network function virtualization") == ["NFV", "slicing"]
    assert labels('"exact words" nfv nfv slicing keys') == ["exact words", "slicing", "NFV", "keys"]
    assert labels("") == labels(None) == []


# --- two schemes ------------------------------------------------------------------------------------------


def test_schemes(spark):
    corpus = spark.createDataFrame([(1, "US1B1", ["H04L 41/08", "H04L 29/06"]), (2, "US2B1", ["H04L 29/06"]), (3, "US3B2", []), (4, "US4B1", ["H04L 41/1(2022.01)"])], "pos long, publication_number string, ipc array<string>")
    store = [(11, "patent", "US1A1", ["H04L41/0893", "H04L65/1"]), (12, "patent", "US2A1", ["H04L65/40"]), (13, "patent", "US9A1", ["H04L41/2", "garbage", "H04L65/2"]), (14, "patent", "US8A1", []), (15, "paper", "US7A1", ["H04L41/2"]), (16, "patent", "US6A1", None), (17, "patent", "US5A1", ["h04l41/1"])]
    store = spark.createDataFrame(store, "pos long, type string, publication_number string, cpc array<string>")
    external = schemes.external_patents(store, corpus)
    assert sorted((r["pos"], r["classified"], r["groups"]) for r in external.collect()) == [(13, True, ["H04L 41", "H04L 65"]), (14, False, []), (16, False, []), (17, True, [])]
    assert tuple(schemes.sizes(corpus, external).first()) == (6, 4, 4, 2)
    walk = {(r["ipc"], r["cpc"]): (r["n"], r["records"]) for r in schemes.crosswalk(corpus, store).collect()}
    assert walk == {("H04L 41", "H04L 41"): (1, 1), ("H04L 41", "H04L 65"): (1, 1), ("H04L 29", "H04L 41"): (1, 2), ("H04L 29", "H04L 65"): (2, 2)}
    moved = [tuple(r)[:3] for r in schemes.reclassified(schemes.crosswalk(corpus, store), least=2).collect()]
    assert moved == [("H04L 29", "H04L 65", 2)]
    pairs = schemes.scan(corpus, store, least=2).collect()
    assert [(r["a"], r["b"], r["patents"], r["corpus"], r["side_a_patents"], r["side_b_patents"], r["expected"], r["caveat"]) for r in pairs] == [("H04L 41", "H04L 29", 1, 1, 3, 2, 1.0, "reclassified: H04L 29 is now H04L 65")]
    rows, cols = (spark.createDataFrame([(g,) for g in gs], "g string") for gs in (["H04L 41"], ["H04L 65", "H04L 41"]))
    assert {(r["row"], r["col"]): r["n"] for r in schemes.matrix_counts(external, rows, cols).collect()} == {("H04L 41", "H04L 65"): 1, ("H04L 41", "H04L 41"): 1}
    assert schemes.scan(corpus.limit(0), store.limit(0)).count() == 0


# --- search in two stages ---------------------------------------------------------------------------------


def bm25(pool, asked):
    """{id: score} over (id, tokens)."""
    n, mean = len(pool), sum(len(t) for _, t in pool) / len(pool)
    out = {}
    for i, t in pool:
        for q in asked:
            df = sum(q in x for _, x in pool)
            if q in t:
                tf = t.count(q)
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    return out


def test_extra_records_rank_beside_the_corpus(spark):
    r = random.Random(4)
    words = ["alpha", "bravo", "carol", "delta", "eagle", "fancy"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))
    docs = [(i, text(), date(2000 + i % 9, 1, 1) if i % 7 else None) for i in range(40)]
    extra = [(c, 100 + i, i, text(), date(2000 + i % 9, 6, 1) if i % 5 else None) for c in (1, 2, 3) for i in range(8)]
    cases = [(1, date(2004, 1, 1)), (2, date(2008, 12, 31)), (3, date(1999, 1, 1))]
    asked = [(c, w) for c in (1, 2, 3) for w in words[c : c + 3]]
    d = spark.createDataFrame([(i, t, None, day) for i, t, day in docs], "pos long, title string, abstract string, publication_date date")
    x = spark.createDataFrame([(c, i, s, t, None, day) for c, i, s, t, day in extra], "case_id long, pos long, seq int, title string, abstract string, publication_date date")
    cuts, qs = spark.createDataFrame(cases, "case_id long, cutoff date"), spark.createDataFrame(asked, "case_id long, token string")
    got = {(y["case_id"], y["place"]): (y["pos"], round(y["score"], 9)) for y in retrieve.Index(d).beside(x, qs, cuts, 5).collect()}
    want = {}
    for c, cut in cases:
        pool = [(i, t.split()) for i, t, day in docs if day and day <= cut] + [(i, t.split()) for k, i, _, t, day in extra if k == c and day and day <= cut]
        if pool:
            scores = bm25(pool, [w for k, w in asked if k == c])
            best = sorted(((-round(s, 9), i) for i, s in scores.items() if i >= 100))[:5]
            want |= {(c, p): (i, -s) for p, (s, i) in enumerate(best, 1)}
    assert got == want
    assert retrieve.Index(d).beside(x.limit(0), qs, cuts).count() == 0


def test_stored_patents_are_dated_and_unknown(spark):
    rows = [(1, "patent", "alpha bravo", date(2001, 1, 1), 2001, "US1A1"), (2, "patent", "alpha", None, 2000, "US2A1"), (3, "patent", "alpha alpha", date(2002, 1, 1), 2002, "US3A1"), (4, "paper", "alpha", date(2001, 1, 1), 2001, None), (5, "patent", "alpha", date(2009, 1, 1), 2009, "US5A1")]
    store = spark.createDataFrame([(p, t, x, None, d, y, n) for p, t, x, d, y, n in rows], "pos long, type string, title string, abstract string, date date, year int, publication_number string")
    q, cuts = spark.createDataFrame([(7, "alpha")], "case_id long, token string"), spark.createDataFrame([(7, date(2005, 1, 1))], "case_id long, cutoff date")
    known = spark.createDataFrame([("US3B2",)], "publication_number string")
    assert [r["pos"] for r in retrieve.stored_patents(store, q, cuts, known).collect()] == [1]
    # what is known is left out behind the first k, not before
    assert retrieve.stored_patents(store, q, cuts, known, k=1).count() == 0


def test_cases_at_several_dates(spark):
    c = spark.createDataFrame([(5, date(2010, 3, 31), 2010)], "case_id long, cutoff date, cutoff_year int")
    got = sorted((r["case_id"], r["of"], r["run"], r["cutoff"], r["cutoff_year"]) for r in retrieve.at_dates(c, [0, 13]).collect())
    assert got == [("5@0", 5, 0, date(2010, 3, 31), 2010), ("5@13", 5, 13, date(2009, 2, 28), 2009)]


def test_matched_features(spark):
    own = spark.createDataFrame([(1, "F1", "a"), (1, "F2", None), (1, "F10", "b")], "case_id long, id string, feature_id string")
    art = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "case_id long, pos long, place int")
    docs = spark.createDataFrame([(7, "b"), (7, "a"), (7, "c"), (9, "a")], "pos long, feature_id string")
    assert {r["pos"]: r["matched"] for r in score.matched_features(own, art, docs).collect()} == {7: ["F1", "F10"], 8: []}


# --- commits, file order, streams -------------------------------------------------------------------------


def test_versions_are_whole(spark, tmp_path):
    at = str(tmp_path / "snap")
    one = spark.createDataFrame([(1, "a", ["x"]), (2, None, None)], "id long, t string, xs array<string>")
    with pytest.raises(FileNotFoundError):
        commits.read_version(spark, at)
    assert commits.write_version(one, at) == 1
    broken = one.select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        commits.write_version(broken, at)
    assert sorted(map(tuple, commits.read_version(spark, at).collect())) == [(1, "a", ["x"]), (2, None, None)]
    assert commits.write_version(one.where("id = 2"), at) == 2
    assert commits.read_version(spark, at).count() == 1
    assert commits.read_version(spark, at, 1).count() == 2
    with pytest.raises(FileExistsError):
        commits.Commits(spark, at).commit("0000000002", {})


def test_appends_happen_once(spark, tmp_path):
    at = str(tmp_path / "log")
    one = spark.createDataFrame([(1, "paper"), (2, "patent")], "id long, type string")
    assert commits.append(one, at, "b1")
    assert not commits.append(one, at, "b1")
    with pytest.raises(Exception, match="stop"):
        commits.append(one.withColumn("id", F.raise_error(F.lit("stop"))), at, "b2")
    assert commits.append(one.withColumn("more", F.lit(3)).where("id = 2"), at, "b2")
    got = sorted((r["id"], r["type"], r["batch"], r["more"]) for r in commits.read_appended(spark, at).collect())
    assert got == [(1, "paper", "b1", None), (2, "patent", "b1", None), (2, "patent", "b2", 3)]
    with pytest.raises(ValueError, match="name"):
        commits.append(one, at, "../x")


def test_first_id_wins_however_files_are_split(spark, tmp_path):
    for part in range(3):
        lines = [json.dumps({"id": f"i{k % 40}", "title": f"file {part} row {k}"}) if k % 9 else "{broken" for k in range(120)]
        (tmp_path / f"part-{part}.jsonl").write_text("\n".join(lines) + "\n")
    last = tmp_path / "last.jsonl"
    last.write_text(json.dumps({"id": "i1", "title": "late"}) + "\n" + json.dumps({"id": "new", "title": "only here"}) + "\n")
    got = []
    try:
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got.append({r["id"]: r["title"] for r in ingest.knowledge(spark, [str(tmp_path / "part-*.jsonl"), str(last)]).collect()})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {}
    for k in range(120):
        if k % 9:
            want.setdefault(f"i{k % 40}", f"file 0 row {k}")
    assert got[0] == got[1] == want | {"new": "only here"}


def test_places_follow_files(spark, tmp_path):
    for name, ids in (("b.json", "34"), ("a.json", "12")):
        (tmp_path / name).write_text(json.dumps([{"publication_number": i} for i in ids]))
    rows = ingest.corpus(spark, str(tmp_path / "*.json")).orderBy("pos").collect()
    assert [r["publication_number"] for r in rows] == ["1", "2", "3", "4"]
    assert [r["pos"] for r in rows] == [0, 1, 1 << 40, (1 << 40) + 1]


def test_keyed_state_outlives_restarts(spark, tmp_path):
    schema = "id string, added_at timestamp, seq long, origin string, _extra string"
    day = lambda d, h: datetime(2024, 1, d, h)
    batches = [
        [("a", day(1, 1), 1, "x", None), ("a", day(1, 0), 0, "x", None), ("b", day(1, 2), 2, "x", None), ("c", day(1, 3), 3, "x", None), ("s", day(1, 3), 4, "seed", None)],
        [("a", day(2, 1), 5, "x", None), ("d", day(1, 4), 6, "x", None), ("e", day(2, 1), 7, "x", None), (None, day(2, 2), 8, "x", None), ("s", day(3, 1), 9, "x", None)],
        [(None, day(4, 2), 10, "x", None), ("f", day(2, 3), 11, "x", None), ("g", day(4, 3), 12, "x", None)],
    ]
    at = str(tmp_path)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        keyed.write_back(stream, f"{at}/store", f"{at}/checkpoint", lambda x: x, ["added_at", "seq"], cap=2, buckets=2).awaitTermination()
    got = sorted((r["seq"], r["batch_id"]) for r in spark.read.parquet(f"{at}/store").collect())
    # day 1 is full with a and b, so d stays out in the next batch; day 2 takes e and the null id, then nothing
    assert got == [(0, 0), (2, 0), (4, 0), (7, 1), (8, 1), (12, 2)]


# --- pages, sources, titles, notes ------------------------------------------------------------------------


def test_pages_by_cursor(spark):
    r = random.Random(1)
    rows = [(i, float(r.randrange(3)), r.choice([None, date(2020, 1, 1), date(2021, 1, 1)])) for i in range(57)]
    hits = spark.createDataFrame(rows, "pos long, score double, publication_date date")
    whole, pages, last = [x["pos"] for x in match.relevance(hits).collect()], [], None
    while True:
        page = match.page_after(hits, last, 10)
        if (last := match.cursor(page)) is None:
            break
        pages += [x["pos"] for x in page.collect()]
    assert pages == whole
    plan = match.page_after(hits, (1.0, None, 5), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_broken_source_gives_a_note(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"title": "one"}) + "\n" + json.dumps({"title": "two"}) + "\n")
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"PAR1 not a table PAR1")
    read = lambda: spark.read.schema("title string").json(str(good))
    rows, told = clean.tolerant_union([("a", read), ("b", lambda: spark.read.schema("title string").parquet(str(bad))), ("c", read)], ["title"])
    assert sorted((r["source"], r["title"]) for r in rows.collect()) == [("a", "one"), ("a", "two"), ("c", "one"), ("c", "two")]
    assert [r["source"] for r in told.collect()] == ["b"]
    rows, told = clean.tolerant_union([("b", lambda: spark.read.parquet(str(tmp_path / "none")))], ["title"])
    assert rows is None
    assert told.count() == 1


def test_class_titles(spark):
    titles = spark.createDataFrame([("prefix", "H04L41/08", "configuration"), ("prefix", "H04L41", "management"), ("prefix", "G06", "computing"), ("class", "H04", "communication"), ("subclass", "H04W", "wireless"), ("section", "H", "electricity")], "level string, prefix string, title string")
    codes = spark.createDataFrame([(c,) for c in ["H04L 41/0893", "h04l 41/08", "H04L41/12", "H04", "H04W 4/00", "H05K 1/02", "A01B", "", None, "G06N 3/04"]], "code string")
    got = {r["code"]: (r["title"], r["level"]) for r in clean.class_titles(codes, titles).collect()}
    assert got == {"H04L 41/0893": ("configuration", "prefix"), "h04l 41/08": ("configuration", "prefix"), "H04L41/12": ("management", "prefix"), "H04": ("communication", "class"), "H04W 4/00": ("wireless", "subclass"), "H05K 1/02": ("electricity", "section"), "A01B": (None, None), "": (None, None), None: (None, None), "G06N 3/04": ("computing", "prefix")}
    got = {r["code"]: r["title"] for r in clean.class_titles(codes, titles, suffix=True).collect()}
    assert got == {"H04L 41/0893": "configuration (41/0893)", "h04l 41/08": "configuration", "H04L41/12": "management (41/12)", "H04": None, "H04W 4/00": "wireless (4/00)", "H05K 1/02": None, "A01B": None, "": None, None: None, "G06N 3/04": "computing (3/04)"}


def test_notes(spark):
    c = spark.createDataFrame([(1, 2010), (2, 2012)], "case_id long, cutoff_year int")
    novelty = spark.createDataFrame([(1, 0.4, False, 5, 77, 60.0, 2, 4), (2, 0.5, True, 0, None, None, 3, 3)], "case_id long, value double, is_fallback boolean, evidence_count long, closest long, overlap_pct double, unmatched long, total long")
    crowding = spark.createDataFrame([(1, 0.1, 12, 0.9149), (2, 0.9, 0, 0.12)], "case_id long, value double, hits long, percentile double")
    regional = spark.createDataFrame([(1, 0.2, "TW", 3, 1234.5, 12), (2, 0.9, "US", 0, 0.0, 0)], "case_id long, value double, target string, target_hits long, hhi double, total long")
    temporal = spark.createDataFrame([(1, 0.625, False, 40), (2, 0.5, True, 3)], "case_id long, value double, is_fallback boolean, evidence_count long")
    said = {(r["case_id"], r["factor"], r["lang"]): r["note"] for r in notes.told(notes.facts(novelty, crowding, regional, temporal, c, 120), ["en", "zh"]).collect()}
    assert len(said) == 16
    assert said[1, "novelty", "en"] == "77 is the closest prior art: it shares 60% of the features. 2 of 4 features are in none of the 5 records compared."
    assert said[1, "crowding", "en"].endswith("the 91st percentile among 120 pairs of features.")
    assert "12th" in said[2, "crowding", "en"]
    assert said[2, "regional", "zh"] == "基準日前沒有相符資料，集中度取中性值 0.5。"
    assert said[1, "temporal", "en"] == "40 publications match from 2006 to 2010; the trend against the field gives 0.63."
    assert not any("{" in x for x in said.values())
    assert notes.told(notes.facts(novelty, crowding, regional, temporal, c, 120), []).count() == 0


def test_blocks_of_cases_and_records_rank_like_all_hits(spark, monkeypatch):
    """The best k by blocks are the first k of all hits, ties by place; blocks of a few cases and postings, many equal records."""
    from lacuna.operators import tiles

    draw = random.Random(11)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    texts = [" ".join(draw.choices(words, weights=range(1, 21), k=draw.randrange(1, 12))) for _ in range(60)]
    rows = [(p, "", texts[p % 60 if p < 120 else 7], f"20{10 + p % 8}-01-15") for p in range(150)]
    d = spark.createDataFrame(rows, "pos long, title string, abstract string, publication_date string").withColumn("publication_date", F.to_date("publication_date"))
    qs = spark.createDataFrame([(f"c{c}", t) for c in range(40) for t in draw.sample(words, 6)], "case_id string, token string")
    cuts = spark.createDataFrame([(f"c{c}", f"20{9 + c % 9:02d}-06-30") for c in range(40)], "case_id string, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    monkeypatch.setattr(tiles, "CASES", 9)
    monkeypatch.setattr(tiles, "POSTINGS", 50)
    index = retrieve.Index(d)
    want = {(r["case_id"], r["rank"]): (r["pos"], round(r["score"], 9)) for r in index.as_of(qs, cuts, None).where("rank <= 4").collect()}
    got = [((r["case_id"], r["rank"]), (r["pos"], round(r["score"], 9))) for r in index.as_of(qs, cuts, 4).collect()]
    assert len(got) == len(want) > 100 and dict(got) == want
    late = {r["case_id"]: r["pos"] for r in index.as_of(qs, cuts, None).where("pos >= 90").withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("rank"))).where("n = 1").collect()}
    assert {r["case_id"]: r["pos"] for r in index.as_of(qs, cuts, 1, F.col("pos") >= 90).collect()} == late
