"""License scans against a plain reading of the rules."""

import random
import re

import pytest

from lacuna.llm import licenses
from lacuna.llm.license_rules import BASE, CONFIDENCE, RULES, Rule, parsed

DOC = "doc_id long, text string, n_words string, found string, more string"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(text, rules):
    """(words, base, found) one rule after the other, each pair of matches compared."""
    words = words_of(text)
    line, have = f" {' '.join(words)} ", set(words)
    every = [(-3 + i, Rule(4, label, tuple(p.split()[-2:-1]), p)) for i, (label, p) in enumerate(BASE.items())] + list(enumerate(rules))
    hits = []
    for no, r in every:
        if have & set(r.keywords):
            hits += [(line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), r.label, r.level, no) for m in re.finditer(f"(?i)(?<= )(?:{r.pattern})(?= )", line, re.ASCII)]

    def beats(e, d):
        larger = e[:2] != d[:2]
        return e != d and e[0] <= d[0] and e[1] >= d[1] and (e[3] < d[3] or (e[3] == d[3] and (larger or e[4] < d[4])))

    return len(words), sorted(h for h in hits if h[4] < 0), sorted(d for d in hits if not any(beats(e, d) for e in hits))


def test_rules_are_hundreds_and_their_keywords_can_be_met():
    assert len(RULES) > 200
    assert {r.level for r in RULES} == set(CONFIDENCE)
    for r in RULES:
        assert re.compile(r.pattern)
        assert not r.pattern.endswith(" ")
        assert all(re.fullmatch("[a-z0-9]+", k) for k in r.keywords)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    bits = [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: GPL-2.0-or-later", "GNU General Public License v3 or later", "the MIT license", "MIT LICENSE", "Apache License", "mit",
        "general public license", "Lesser General Public License, version 2.1", "CC BY-SA 4.0", "creative commons attribution-sharealike 4.0 international license",
        "See the LICENSE file for details", "All rights reserved.", "3-Clause BSD License", "opensource.org/licenses/MIT", "license", "mİt license", "MIT license", "mit\nlicense",
    ]
    out = [None, "", " ", "!!! --", "mit license " * 3000, "x" * 200000, "ÉÀ 漢字 mit license"]
    for _ in range(150):
        out.append(" ".join(r.choice([*bits, "lorem", "ipsum,", "the", "of"]) for _ in range(r.randrange(12))))
    return out


def test_equals_a_plain_reading(spark, texts):
    df = spark.createDataFrame([(i, t, None, "x", None) for i, t in enumerate(texts)], DOC).repartition(5)
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t and len(t) > 30000 and "mit" in t:
            assert len(got[i]["base"]) == len(got[i]["found"]) == 3000
            continue
        n, base, found = plain(t, RULES)
        assert got[i]["n_words"] == n
        assert sorted(map(tuple, got[i]["base"])) == base, t
        assert sorted(map(tuple, got[i]["found"])) == found, t


def test_digest(spark, texts):
    df = spark.createDataFrame([(i, t, None, "x", None) for i, t in enumerate(texts)], DOC)
    for r in licenses.digest(licenses.scan(df)).collect():
        words = words_of(texts[r["doc_id"]])
        places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for label, p in BASE.items()}
        all_ = sorted(x for p in places.values() for x in p)
        assert (r["n_words"], r["n_base"]) == (len(words), len(all_))
        assert (r["first_word"], r["last_word"]) == ((all_[0], all_[-1]) if all_ else (None, None))
        assert r["base_labels"] == ",".join(sorted(k for k, v in places.items() if v))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")


def test_priority_and_containment(spark):
    rules = parsed("""
        2 | long | b | a b c d
        3 | inner | b | b c
        1 | strong | c | b c d
        3 | twice | d | c d
        4 | apart | e | d e
    """)
    got = licenses.scan(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), rules).first()["found"]
    # d e lies in no other match; c d and b c lie in stronger ones; a b c d in none that is as strong
    assert [tuple(x)[:3] for x in got] == [(0, 4, "long"), (1, 4, "strong"), (3, 5, "apart")]


def test_repeated_and_null_ids_and_no_rows(spark):
    rows = [(1, "MIT License"), (1, "MIT License"), (1, "other"), (None, "the GPL"), (None, "the GPL"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["labels"]) for r in licenses.digest(licenses.scan(df)).collect())))
    assert got == sorted(map(str, [(1, "mit"), (1, "mit"), (1, ""), (None, "gpl"), (None, "gpl"), (None, "")]))
    assert licenses.digest(licenses.scan(df.limit(0))).count() == 0


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licenses.digest(licenses.scan(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
