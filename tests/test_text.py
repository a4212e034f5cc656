"""Text functions, matcher, cleaning and ingestion on hand-written rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lacuna.functions import metrics, taxonomy, text
from lacuna.operators import classes, clean, features, match, score
from lacuna.sources import ingest, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "year", "source"),
    [
        ("Copyright 2019 A. Body. Many others, 2022.", 2019, "copyright_line"),
        ("A title\nPublished 12 May 2018 in a journal", 2018, "published_accepted_received"),
        ("Proceedings of the 2017 Symposium on Nets", 2017, "conference_year"),
        ("arXiv:2104.01234v2 [cs.NI]", 2021, "arxiv_id"),
        ("In 2015 and 2015, later 2016 (Smith, 2022) and et al., 2022.\nReferences\n2022 2022 2022", 2015, "frequency_fallback"),
        ("2014 or 2016", 2016, "frequency_fallback"),
    ],
)
def test_cutoff_year(spark, said, year, source):
    c = one(spark, text.cutoff_year(F.col("t")), t=said)
    assert (c["year"], c["source"]) == (year, source)


def test_no_year(spark):
    assert one(spark, text.cutoff_year(F.col("t")), t="nothing here") is None


def test_rounding_of_halves(spark):
    assert one(spark, metrics.half_up(F.lit(-12.5))) == -12
    assert one(spark, metrics.half_up(F.lit(2.345), 2)) == pytest.approx(2.35)


def test_nfkc(spark):
    s = "Ｓoftware－Ｄefined ﬁeld"
    want = " ".join(unicodedata.normalize("NFKC", s).lower().replace("-", " ").split())
    assert one(spark, text.search_form(F.col("t"), nfkc=True), t=s) == want


def test_boundary_is_ascii(spark):
    df = spark.createDataFrame([("éerin",), ("erin",), ("xerin",)], ["t"])
    assert [r[0] for r in df.select(F.regexp_count("t", F.lit(text.term_pattern("erin", False)))).collect()] == [1, 1, 0]


def records(spark, rows):
    return match.searchable(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, title string, abstract string"))


def test_search_rules(spark):
    r = records(spark, [("SDN control", "x"), ("Software-Defined Networking", "y"), ("maintain", "z"), ("orchestrating VNFs", "q"), ("軟體定義網路", "w")])
    hit = lambda q: sorted(x["pos"] for x in match.search(r, q).collect())
    assert hit("SDN") == [0, 1, 4]
    assert hit("ai") == []
    assert hit("orchestr") == [3]
    assert hit('"software defined"') == [1]
    assert hit("sdn vnf") == []
    assert hit("") == []


def test_concepts():
    assert [c.label for c in match.parse("network slicing and the 5G zzz")] == ["network slicing", "5G", "zzz"]
    assert match.english_query(match.parse("軟體定義網路")) == "SDN"
    assert len(taxonomy.FEATURES) == 17
    assert len(taxonomy.SYNONYMS) == 30


def test_overlapping_terms_count_twice(spark):
    r = spark.createDataFrame([(1, "beyond 5G", "")], "pos int, title string, abstract string")
    f = {x["feature_id"]: x["tf"] for x in features.document_features(r, taxonomy.FEATURES).collect()}
    assert f == {"cellular_gen": 2}


def test_lower_case_acronym(spark):
    r = spark.createDataFrame([(1, "ran fast", "RAN")], "pos int, title string, abstract string")
    assert [x["tf"] for x in features.document_features(r, taxonomy.FEATURES).collect()] == [1]


def test_groups(spark):
    df = spark.createDataFrame([("H04L 41/0895(2022.01)", "H04L41/0893"), ("G06F 9", "garbage")], ["i", "c"])
    got = df.select(classes.main_group(F.col("i")), classes.cpc_group(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("H04L 41", "H04L 41"), ("G06F 9", None)]


def test_applicant_spellings(spark):
    names = ["Huawei Technologies Co.", "HUAWEI TECHNOLOGIES CO LTD", "Telefonaktiebolaget LM Ericsson (publ)", "Telefonaktiebolaget LM Ericsson AB"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, applicant string")
    top = classes.top_applicants(df).orderBy("rank").collect()
    assert [(r["name"], r["patents"]) for r in top] == [("Huawei Technologies Co.", 2), ("Telefonaktiebolaget LM Ericsson AB", 2)]


def test_numbers(spark):
    keys = [one(spark, clean.base_number(F.col("n"), p), n="US08448238B1") for p in ("none", "all", "us")]
    assert keys == ["US08448238", "US8448238", "US8448238"]


def test_validation(spark):
    rows = [
        ("paper", "Network slicing in 5G", 2020, "10.1/A", None, ["network_slicing"]),
        ("paper", "Network slicing, other title", 2020, "https://doi.org/10.1/a", None, ["network_slicing"]),
        ("paper", "Cooking for many people", 2020, None, None, []),
        ("paper", "Latency only, nothing else", 2020, None, None, ["qos"]),
        ("paper", "Figure 3: a network slice", 2020, None, None, ["network_slicing"]),
        ("paper", "A slice of the future", 2031, None, None, ["network_slicing"]),
        ("paper", "No year at all here", None, None, "https://arxiv.org/abs/2101.00001", ["sdn"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, type string, title string, year int, doi string, url string, features array<string>")
    df = df.withColumns({"abstract": F.lit(""), "date": F.lit(None).cast("string"), "authors": F.array(F.lit("x")), "publication_number": F.lit(None).cast("string")})
    out = clean.first_arrivals(clean.normalise(df, 2026), ["pos"]).orderBy("pos").collect()
    assert [r["status"] for r in out] == ["added", "duplicate", "rejected", "rejected", "rejected", "rejected", "rejected"]
    assert [r["reject_reason"] for r in out][2:] == ["out of domain", "out of domain", "figure or table", "year", "year"]


def test_api_rows(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"message":{"items":[{"title":["T one"],"DOI":"10.1/x","issued":{"date-parts":[[2020,3,4]]},"author":[{"given":"A","family":"B"},{"family":"C"}]},{"title":[]},{"title":["T two"],"issued":{"date-parts":[[2019]]}}]}}')
    got = ingest.crossref(spark.read.schema(ingest.CROSSREF).json(str(tmp_path / "c.json"))).orderBy("title").collect()
    assert [(r["title"], r["year"], r["date"], r["url"], r["authors"]) for r in got] == [("T one", 2020, "2020-03-04", "https://doi.org/10.1/x", ["A B", "C"]), ("T two", 2019, None, None, None)]
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/1</id><title>A\n  b</title><summary>s</summary><published>2020-01-02T00:00:00Z</published></entry></feed>")
    r = ingest.arxiv(spark, str(tmp_path / "a.xml")).first()
    assert (r["title"], r["year"], r["url"], r["date"]) == ("A b", 2020, "https://arxiv.org/abs/1", "2020-01-02")
    (tmp_path / "s.json").write_text('{"data":[{"paperId":"p","title":"S","year":2021,"publicationDate":"2021-05","externalIds":{"DOI":"10.2/y"},"authors":[{"name":"N"}]}]}')
    r = ingest.scholar(spark.read.schema(ingest.SCHOLAR).json(str(tmp_path / "s.json"))).first()
    assert (r["url"], r["doi"], r["date"], r["authors"]) == ("https://www.semanticscholar.org/paper/p", "10.2/y", None, ["N"])
    (tmp_path / "o.json").write_text('{"results":[{"id":"w","title":"O","abstract_inverted_index":{"b":[1],"a":[0,2]},"authorships":[{"author":{"display_name":"D"}}]}]}')
    r = ingest.openalex(spark.read.schema(ingest.OPENALEX).json(str(tmp_path / "o.json"))).first()
    assert (r["abstract"], r["url"], r["authors"]) == ("a b a", "w", ["D"])
    (tmp_path / "p.json").write_text('{"hits":[{"@database":"US","publication-reference":{"doc-number":"US08448238B1","date":"20130521"},"patent-title":{"title":"T","english-title":"E"},"abstract":{"p":["x","y"]},"parties":{"applicants":{"applicant":[{"name":"AT&amp;T"}]}},"classifications-ipc":{"ipc":[{"keyValue":"H04L 1"},{"keyValue":"H04L 1"}]}},{"publication-reference":{"doc-number":"US1","date":"x"}}]}')
    got = ingest.patent_api(spark.read.schema(ingest.PATENT_API).json(str(tmp_path / "p.json"))).collect()
    assert [(r["publication_number"], r["title"], r["title_original"], r["abstract"], r["date"], r["assignee"], r["ipc"]) for r in got] == [("US8448238B1", "E", "T", "x y", "2013-05-21", "AT&T", ["H04L 1"])]


def test_patent_pages(spark):
    html = '<meta name="DC.title" content="A &amp; B"><abstract x>Some <b>text</b></abstract><meta name="DC.date" content="2010-01-02" scheme="issue"><tr itemprop="similarDocuments" z><td itemprop="publicationNumber">US1234567B2</td><td itemprop="title">Old\n one</td></tr><tr itemprop="similarDocuments"><td>scholar</td></tr>'
    df = spark.createDataFrame([("US9B1", html), ("US8B1", "<abstract>no date</abstract>")], "publication_number string, html string")
    assert [tuple(r) for r in ingest.patent_pages(df).collect()] == [("US9B1", "A & B", "Some text", "2010-01-02", "US")]
    assert [tuple(r) for r in ingest.citation_edges(df).collect()] == [("US9B1", "US1234567B2", "similarDocuments", "Old one")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "corpus.json").write_text('[{"publication_number":"US1B1","title":"T","company_name":"C","publication_date":"2020-01-02"},{"publication_number":"US2B1","assignees":["A"],"ipc":["H04L 1/1"]}]')
    got = ingest.corpus(spark, str(tmp_path / "corpus.json")).orderBy("publication_number").collect()
    assert [(r["abstract"], r["assignees"], r["ipc"]) for r in got] == [("", ["C"], []), ("", ["A"], ["H04L 1/1"])]
    (tmp_path / "k.jsonl").write_text('{"id":"a","title":"first"}\n{"id":"a","title":"second"}\nnot json\n{"id":"b","title":"b"}\n')
    assert sorted((r["id"], r["title"]) for r in ingest.knowledge(spark, [str(tmp_path / "k.jsonl")]).collect()) == [("a", "first"), ("b", "b")]
    df = spark.createDataFrame([("US1", 'say "x"', "US", "C", "2020-01-02", ["a", "b"], "u")], "publication_number string, title string, jurisdiction string, company_name string, publication_date string, ipc array<string>, url string")
    sinks.export_csv(df, str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith('"﻿publication_number"'.encode())
    assert b'"say ""x"""' in raw
    assert raw.count(b"\r\n") == 2
    sinks.snapshot(df, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 1


def test_notes(spark):
    assert [one(spark, score.ordinal(F.lit(n))) for n in (1, 2, 3, 11, 83, 112)] == ["1st", "2nd", "3rd", "11th", "83rd", "112th"]


def test_case_input(spark):
    df = spark.createDataFrame([([("F" * 20, "t" * 200, "sdn"), (None, "x", None), ("F2", "", None)] + [("F9", "y", "qos")] * 20,)], "features array<struct<id:string,text:string,feature_id:string>>")
    f = score.clean_features(df).first()["features"]
    assert len(f) == 12
    assert (len(f[0]["id"]), len(f[0]["text"])) == (16, 120)


def test_titles_that_are_plain_text_stand_as_they_are(spark):
    """`A &amp; b.` has ten characters as text and six as markup."""
    from lacuna.operators import clean

    kind = "pos int, type string, title string, abstract string, year int, url string, date string, doi string, publication_number string, authors array<string>, features array<string>"
    df = spark.createDataFrame([(1, "paper", "A &amp; b.", "", 2010, None, None, None, None, [], ["sdn"])], kind)
    assert [clean.normalise(df, 2022, markup=m).first()["reject_reason"] for m in (True, False)] == ["title too short", None]


def test_candidates_and_planted_years_follow_their_sql(spark, tmp_path):
    """Short titles with entities, and texts that name years of their own beside the planted one."""
    from lacuna.plans import catalog

    pages = [(n, f"http://x/{n}", f"<html><title>{t}</title><p>text</p></html>") for n, t in enumerate(["Xy. abcdefgh", "A &amp; b.", "A &lt; b", "De &quot;", "A &amp; b."] * 4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    said = "In 2021 and 2021, 2021. Published 1999. Conference of 2001. arXiv:0704.12345 (c) 2012"
    docs = [(n, said, "en", "s", len(said)) for n in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    for a, b in (("p", "pages"), ("d", "documents")):
        next((tmp_path / a).glob("*.parquet")).rename(tmp_path / f"{b}.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    from compare import same

    for name in ("cutoff_year", "normalise_records", "dedupe_first", "learn_report", "funnel_counts"):
        same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLE_SQL[name])


def test_words_are_inverted_within_their_row(spark):
    """As by grouping, without an exchange in the plan."""
    rows = [(1, ["b", "a", "b", "", "ü", "b"]), (2, []), (3, None), (4, ["z"])]
    df = spark.createDataFrame(rows, "k int, w array<string>").select("k", text.inverted(F.col("w")).alias("i"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["i"] for r in df.collect()}
    assert got[1] == {"": [3], "a": [1], "b": [0, 2, 5], "ü": [4]}
    assert got[2] is None and got[3] is None and got[4] == {"z": [0]}


def test_rebuilt_abstracts_need_no_exchange(spark, sf_dir):
    from lacuna.plans import catalog

    assert "Exchange" not in catalog.QUERIES["rebuild_abstract"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
