"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lacuna.llm import language, mixing
from lacuna.llm.common import cut
from lacuna.llm.queries import documents, tokenizer


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into and comes out of each stage."""
    docs, seen = documents(spark, sf_dir), []
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf_dir))
        seen.append((name, docs.toPandas(), out.toPandas()))
        docs = out
    return {name: (a, b) for name, a, b in seen}


def form(line):
    return re.sub(r"[^\w]+|_", " ", line.lower()).strip()


def shingles(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_language_keeps_what_has_a_profile(spark, sf_dir, stages):
    before, after = stages["language"]
    told = language.identify(documents(spark, sf_dir)).toPandas().set_index("doc_id")
    want = {i for i in before["doc_id"] if told.loc[i, "lang_pred"] != "und" and told.loc[i, "score"] >= 0.1}
    assert set(after["doc_id"]) == want
    assert list(after.columns) == list(before.columns)
    assert len(want) > 0.9 * len(before)


def test_lines_stay_once(stages):
    before, after = stages["lines"]
    count = lambda df: Counter(f for t in df["text"] if t for x in t.split("\n") if (f := form(x)))
    had, has = count(before), count(after)
    assert max(has.values()) == 1
    assert set(has) <= set(had)
    gone = before[~before["doc_id"].isin(set(after["doc_id"]))]
    assert all(form(x) == "" or had[form(x)] > 0 for t in gone["text"] for x in t.split("\n"))
    # a line that was there once and is like no other stays: most of them
    once = [f for f, n in had.items() if n == 1]
    assert sum(f in has for f in once) > 0.8 * len(once)


def test_one_of_each_near_group_stays(stages):
    before, after = stages["near duplicates"]
    sets = {i: shingles(t) for i, t in zip(before["doc_id"], before["text"], strict=True)}
    link = lambda a, b: bool(a) and bool(b) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if link(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(after["doc_id"]) == {i for i in ids if find(i) == i}


def test_the_mix_takes_documents_as_planned(spark, stages):
    before, after = stages["mix"]
    m = mixing.mix(spark.createDataFrame(before)).toPandas().set_index("doc_id")
    times = Counter(after["doc_id"])
    for i in before["doc_id"]:
        size, taken = m.loc[i, "size"], m.loc[i, "taken"]
        low = taken // size if size else 1
        assert times[i] in ((low, low + 1) if size and taken % size else (low,))
    words = lambda df: df["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))).sum()
    assert abs(words(after) - m["taken"].sum()) < 0.15 * m["taken"].sum()


def test_tokens_are_the_library_s(stages):
    from tokenizers import Tokenizer

    before, after = stages["tokens"]
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(before["doc_id"], before["text"], strict=True))
    assert Counter((i, tuple(x)) for i, x in zip(after["doc_id"], after["ids"], strict=True)) == want


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == len(stages["tokens"][1])
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
