"""Incremental search: exact, stops at the proven radius, odd ids."""

import numpy as np

from lacuna.llm import hamming


def brute(bits, q, k):
    return sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:k]


def test_every_query_stops_at_its_proven_radius(spark):
    r = np.random.default_rng(21)
    centres = r.standard_normal((30, 64))
    vecs = {i: centres[i % 30] + (0.05 + 0.3 * (i % 3)) * r.standard_normal(64) for i in range(600)}
    vecs |= {1000 + i: r.standard_normal(64) for i in range(60)} | {2000 + i: vecs[7] for i in range(40)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vecs.items()], "vec_id long, embedding array<double>")
    codes = hamming.binary_codes(df)
    got = hamming.top_k(codes, codes.where("vec_id % 20 = 0"), 6, radius=True).collect()
    bits = {i: v > 0 for i, v in vecs.items()}
    seen = set()
    for q in [i for i in vecs if i % 20 == 0]:
        mine = sorted((x["rank"], x["distance"], x["vec_id"], x["radius"]) for x in got if x["query_id"] == q)
        want = brute(bits, q, 6)
        assert [(d, i) for _, d, i, _ in mine] == want
        kth = want[-1][0]  # the first round r with 4 (r + 1) - 1 >= kth
        assert {x[3] for x in mine} == {max(0, -(-(kth + 1) // 4) - 1)}
        seen.add(mine[0][3])
    assert len(seen) > 2


def test_repeated_and_null_ids(spark):
    zero, one, far = [0], [1], [-1]
    rows = [(0, zero), (0, zero), (0, far), (1, one), (1, one), (2, far), (None, zero), (3, zero)]
    codes = spark.createDataFrame(rows, "vec_id long, code array<long>")
    got = [tuple(x) for x in hamming.top_k(codes, codes.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0), (0, 2, 1, 63), (0, 3, 3, 64)]  # its smallest code is [-1]
    assert hamming.top_k(codes, codes.limit(0)).count() == 0
