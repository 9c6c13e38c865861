import math
from decimal import Decimal

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import topk as K


def brute(rows, queries, k, scale=256):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = lambda v: [hold(math.floor(Decimal(float(np.float32(x))) * scale)) for x in v]
    out = []
    for i, q in queries:
        if i is None or not fine(q):
            continue
        c = sorted((-hold(sum(a * b for a, b in zip(whole(q), whole(x)))), j) for j, x in rows if j is not None and fine(x) and len(x) == len(q) and j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(c)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 24).astype("f4").tolist()) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # ties
    rows += [(7, rows[7][1]), (7, rows[7][1]), (2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (None, rows[0][1]), (2004, [1.0, 2.0]), (2050, [0.5, -3.0]), (2005, []), (2100, []), (2006, [0.0] * 24)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    for k in (5, 1, 900):
        got = K.nearest(df, df.where("vec_id % 50 = 0"), k).collect()
        assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], k)
    many = K.nearest(df, df.where("vec_id % 50 = 0"), 5, pass_bytes=500).collect()
    assert sorted(map(tuple, many)) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    assert K.nearest(df.limit(0), df).collect() == [] and K.nearest(df, df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_blocks_match_brute_force(data):
    d, n, m, k = (data.draw(st.integers(1, x)) for x in (20, 60, 8, 6))
    seed = data.draw(st.integers(0, 1 << 30))
    size = data.draw(st.sampled_from([1e-3, 0.3, 1e4, 1e8, 1e17]))
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, 1, (n, d)) * size).astype("f4")
    q = np.concatenate([x[: m // 2], (rng.normal(0, 1, (m, d)) * size).astype("f4")])
    best = K.Best(np.arange(len(q)), K.quantised(q, 256), k)
    for a in range(0, n, 17):
        best.add(np.arange(a, min(n, a + 17)), K.quantised(x[a : a + 17], 256))
    want = brute(list(enumerate(x.tolist())), list(enumerate(q.tolist())), k)
    got = sorted((i, r + 1, int(best.names[i, r]), int(best.scores[i, r])) for i in range(len(q)) for r in range(best.held[i]))
    assert got == want
