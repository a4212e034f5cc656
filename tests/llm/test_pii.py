"""Spans beyond the base patterns, on planted documents and against a plain version."""

import random
import re

import numpy as np
import pytest

from lacuna.llm import pii

PLANTED = {
    "email": ["jane dot doe at example dot org", "bob at mail dot example dot com", "sue_b [at] example [dot] net"],
    "ip": ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0db8:0000:0000:0000:ff00:0042:8329"],
    "phone": ["(212) 555-0147", "415-555-0132"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606", "ES91 2100 0418 4502 0005 1332"],
    "birth": ["1984-03-07", "23.11.1975", "4/30/1962"],
    "name": ["Maria Lopez", "Peter J. Miller", "Zoltan Kovacs"],
}
BEFORE = {"email": "write to ", "ip": "the server at ", "phone": "call us at ", "iban": "account ", "birth": "she was born on ", "name": "signed, Dr. "}
CLEAN = [
    "Version 2.0 came out on 2019-05-06 and std::vector is in chapter a::b of it",
    "The Old House stands at Green Park since 1.1.1950, see section 4.2 of the report",
    "Dear Customer Service, invoice 2020-01-31 lists AB12 CDEF 1234 5678 9012 34 as a part",
    "He looked at the dot in the middle at noon on 12/12/2012, order no 415 5550 132",
    "at 10:30:45 the meeting began; ratio 3::4; figure 2021.03.04 and case A::B",
]
FILLER = "the river runs past an old mill where people met and talked about the weather".split()


def planted(n, seed):
    """(text, spans put in) of n documents with one or two spans each, some of none."""
    r, out = random.Random(seed), []
    for i in range(n):
        if i % 3 == 2:
            out.append((r.choice(CLEAN) + " " + " ".join(r.choices(FILLER, k=9)), set()))
            continue
        text, spans = "", set()
        for kind in r.sample(sorted(PLANTED), r.choice([1, 2])):
            text += " ".join(r.choices(FILLER, k=r.randint(8, 14))) + " " + BEFORE[kind]
            s = r.choice(PLANTED[kind])
            spans.add(f"{kind}:{len(text)}:{len(text) + len(s)}")
            text += s + " , "
        out.append((text + " ".join(r.choices(FILLER, k=5)), spans))
    return out


def said(spark, texts):
    rows = pii.digest(pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    return {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in rows}


@pytest.mark.parametrize("n,seed", [(300, 1), (40, 2)])
def test_planted_spans(spark, n, seed):
    docs = planted(n, seed)
    got = said(spark, [t for t, _ in docs])
    for kind in PLANTED:
        want = {(i, s) for i, (_, spans) in enumerate(docs) for s in spans if s.startswith(kind)}
        have = {(i, s) for i, spans in got.items() for s in spans if s.startswith(kind)}
        assert len(want & have) >= 0.9 * len(want), (kind, sorted(want - have)[:3])
        assert len(want & have) >= 0.9 * len(have), (kind, [(s, docs[i][0]) for i, s in sorted(have - want)[:3]])


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_by_brute_force(spark, seed):
    """Candidate by candidate: EM over single rows, logistic regression by plain gradient steps, then the threshold."""
    docs = planted(60, seed)
    rows = [(i, k, a, e, base, pii.votes(t, k, a, e, well)) for i, (t, _) in enumerate(docs) for k, a, e, base, well in pii.candidates(t)]
    want: dict = {i: set() for i in range(len(docs))}
    close = set()
    for kind in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == kind]
        four, x = pii.unpack(np.array([r[5] for r in own]))
        lean = (four - 1).sum(1)
        p = [1 / (1 + np.exp(-1.5 * (v - 0.5))) for v in lean]
        first = sum(p) / len(p)
        for _ in range(50):
            share = min(max((sum(p) / len(p) + first) / 2, 0.01), 0.99)
            f = {(c, k, v): [0.5, 1.0, 2.0][v if c else 2 - v] + sum(q if c else 1 - q for q, row in zip(p, four, strict=True) if row[k] == v) for c in (0, 1) for k in range(4) for v in range(3)}
            total = {(c, k): sum(f[c, k, v] for v in range(3)) for c in (0, 1) for k in range(4)}
            like = [[[1 - share, share][c] * np.prod([f[c, k, row[k]] / total[c, k] for k in range(4) if len(set(four[:, k])) > 1]) for c in (0, 1)] for row in four]
            p = [b / (a + b) for a, b in like]
        w = np.zeros(x.shape[1])
        for _ in range(20000):
            q = 1 / (1 + np.exp(-x @ w))
            w -= 4 / (1 + len(x)) * (x.T @ (q - np.array(p)) + w) / 8
        for (i, k, a, e, base, cell), q in zip(own, 1 / (1 + np.exp(-x @ w)), strict=True):
            well, known, context = cell // 972, cell // 324 % 3, cell // 108 % 3
            key = f"{pii.KINDS[k]}:{a}:{e}"
            if abs(q - 0.5) < 0.01 and not base:
                close.add((i, key))
            if base or (q >= 0.5 and (well == 2 or (well == 1 and 2 in (known, context)))):
                want[i].add(key)
    got = said(spark, [t for t, _ in docs])
    assert sum(map(len, want.values())) > 30
    for i in want:
        assert all((i, s) in close for s in want[i] ^ got[i]), (docs[i][0], want[i] ^ got[i])


def test_edges_of_candidates(spark):
    one = lambda t: {(pii.KINDS[k], t[a:e], ok) for k, a, e, _, ok in pii.candidates(t)}
    assert ("iban", "ES91 2100 0418 4502 0005 1332", 2) in one("to ES91 2100 0418 4502 0005 1332 CODE")
    assert ("iban", "DE89 3704 0044 0532 0130 01", 0) in one("to DE89 3704 0044 0532 0130 01")
    assert ("birth", "31.02.1990", 0) in one("born 31.02.1990")
    assert ("birth", "2/29/1992", 1) in one("born 2/29/1992.")
    assert ("name", "Maria Customer", 0) in one("Maria Customer")
    assert not {k for k, *_ in one("The Old Mill of Some Town and Another Place")}
    assert ("email", "jane.doe@example.org", 2) in one("jane.doe@example.org at example dot org")
    for t in ("at dot " * 40000, "a dot " * 50000, "Ab " * 80000, "1.1." * 60000, "AB12 " * 50000, "::" * 100000, "Maria " * 40000, "dr. " * 50000):
        assert len(pii.candidates(t)) < len(t)


def test_labelers(spark):
    docs = planted(200, 5)
    df = spark.createDataFrame(list(enumerate(t for t, _ in docs)), "doc_id long, text string")
    rows = pii.labelers(df).collect()
    assert {r["kind"] for r in rows} >= set(PLANTED) and all(0 <= r["share"] <= 1 for r in rows)
    by = {(r["kind"], r["labeler"], r["truth"], r["vote"]): r["share"] for r in rows}
    for kind in PLANTED:
        assert abs(sum(by[kind, "context", True, v] for v in range(3)) - 1) < 1e-9
    for kind, labeler in (("birth", "context"), ("iban", "check"), ("ip", "gazetteer"), ("name", "context")):
        assert by[kind, labeler, True, 2] > by[kind, labeler, False, 2]
    assert pii.labelers(df.limit(0)).count() == 0


def test_base_spans_stay(spark):
    texts = [t for t, _ in planted(60, 7)] + ["Dr. jane.doe@example.org born 1.2.1990 at 10.0.0.1", "", "+49 (30) 1234 5678 and 4111 1111 1111 1111"]
    for i, spans in said(spark, texts).items():
        t = texts[i]
        assert {f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)} <= spans
