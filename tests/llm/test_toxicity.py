import math
from collections import defaultdict

import numpy as np

from gridloom.llm import toxicity as X


def test_features_match_brute_force():
    import re

    texts = ["A bb ccc A bb", "", "éé, x-y ZZtop longerword longerthing", "one"]
    docs, coords = X.features([t.encode() for t in texts])
    per = X.distinct(docs, coords, len(texts))
    low = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    for i, w in enumerate(low):
        kinds = {("w", a) for a in w} | {("s", a.encode()[:5]) for a in w if len(a.encode()) > 5}
        kinds |= {(g, w[j], w[j + g]) for g in (1, 2, 3) for j in range(len(w) - g)}
        assert len(per[i]) == len(kinds)


def test_learns_and_defines_every_case(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = [str(w) for w in rng.choice(words, 40)]
        if bad:
            t[int(rng.integers(40))] = str(rng.choice(["nasty", "vile"]))
            t[int(rng.integers(40))] = "nasty"
        rows.append((i, " ".join(t), "x"))
        labels.append((i, int(bad)))
    rows += [(9001, None, "x"), (9002, "", None), (None, "nasty vile nasty", None), (9003, "NASTY vile " * 30000, "x"), (3, rows[3][1], "again")]
    labels += [(None, 1), (5, None), (6, 7), (10, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.train(docs, known, held_out=f"{X.remainder(3)} = 1")
    got = X.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {"x", None, "again"}
    s = {r.doc_id: r.toxicity.score for r in got}
    hits = [(s[i] >= 0.5) == (i % 5 == 0) for i in range(600)]
    assert np.mean(hits) > 0.97
    assert s[9001] == s[9002] and s[9003] > 0.5 and s[None] > 0.5
    assert all(0 <= x <= 1 for x in s.values())
    again = X.train(docs.repartition(3), known, held_out=f"{X.remainder(3)} = 1")
    assert np.array_equal(again[0], model[0]) and np.array_equal(again[1], model[1])
    more = X.train(docs.unionByName(docs.where("doc_id = 7").join(spark.range(500).select(), how="cross")), known, held_out=f"{X.remainder(3)} = 1")
    assert np.array_equal(more[0], model[0]) and np.array_equal(more[1], model[1])
    none = X.train(docs, known.limit(0))
    assert {r.toxicity.score for r in X.score_toxicity(docs, none).collect()} == {0.5}
    assert X.score_toxicity(docs.limit(0), none).collect() == []


def brute_ftrl(rows, l1, epochs):
    """FTRL-proximal of one coordinate at a time; the last coordinate is the intercept, without L1."""
    bias = 1 << X.BITS
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        own = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= own else -(z[i] - math.copysign(own, z[i])) / ((X.BETA + math.sqrt(n[i])) / X.ALPHA + X.L2)

    for _ in range(epochs):
        for at, label in rows:
            w = {i: weight(i) for i in [*at, bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / X.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i)}


def test_weights_and_scores_match_brute_force():
    rng = np.random.default_rng(2)
    texts = [" ".join(str(w) for w in rng.choice(["aa", "bb", "cc", "dd", "longerword", "ff"], 6)) for _ in range(60)]
    labels = [int("aa bb" in t) for t in texts]
    per = X.distinct(*X.features([t.encode() for t in texts]), len(texts))
    rows = [(x.astype("<u4"), y) for x, y in zip(per, labels, strict=True)]
    at, w = X.fit(rows)
    rarer = min(sum(labels), len(labels) - sum(labels)) ** 0.5
    first = brute_ftrl([(x.tolist(), y) for x, y in rows], X.PHASES[0][0] * rarer, X.PHASES[0][1])
    want = brute_ftrl([([i for i in x.tolist() if i in first], y) for x, y in rows], X.PHASES[1][0] * rarer, X.PHASES[1][1])
    assert len(want) > 3 and set(at.tolist()) == set(want) and np.allclose(w, [want[i] for i in at.tolist()])
    score = X._scorer(at, w)([t.encode() for t in texts])[0]
    assert np.allclose(score, [1 / (1 + math.exp(-want.get(1 << X.BITS, 0.0) - sum(want.get(i, 0.0) for i in x.tolist()))) for x in per])


def test_scores_keep_the_prior_of_all_labels(spark):
    texts = ["word"] * 1500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1500)], "doc_id long, toxic int")
    few, every = (np.array([r.toxicity.score for r in X.score_toxicity(docs, X.train(docs, known, sample=n)).collect()]) for n in (200, 8000))
    # The texts tell nothing of the label, so scores are its share, 0.1, whatever the sample.
    assert abs(np.median(few) - 0.1) < 0.05 and abs(np.median(every) - 0.1) < 0.05
