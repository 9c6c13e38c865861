import numpy as np

from gridloom.llm import quality as Q


def test_table_matches_brute_force(spark):
    texts = ["A b c, D!! b", None, "", "one", "x y " * 50, "é ü É"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = np.zeros((1 << Q.BITS, Q.DIM))
    for t in texts:
        _, h = Q.tokens([(t or "").encode()])
        places, signs = Q.index_vectors(h)
        rows = (h >> np.uint64(64 - Q.BITS)).astype(int)
        for i in range(len(h)):
            for j in range(max(0, i - Q.WINDOW), min(len(h), i + Q.WINDOW + 1)):
                if i != j:
                    for p, s in zip(places[:, j], signs[:, j]):
                        want[rows[i], p] += s
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(Q.word_vectors(df), want / np.maximum(size, 1e-9), atol=1e-6)
    assert not Q.word_vectors(df.limit(0)).any()


def test_learns_and_defines_every_case(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        t = [str(w) for w in rng.choice(words, 60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in t), "s"))
        labels.append((i, int(not bad)))
    rows += [(9001, None, "s"), (9002, "", "s"), (None, "w1 w2", None), (9003, "w5 W6!! " * 40000, "s"), (3, rows[3][1], "s")]
    labels += [(None, 1), (5, None), (6, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    table = Q.word_vectors(docs)
    net = Q.train(docs, known, table, held_out="crc32(cast(id as string)) % 5 = 0")
    got = Q.score_quality(docs, table, net).collect()
    assert len(got) == len(rows)
    s = {r.doc_id: r.quality_score.score for r in got}
    assert np.mean([(s[i] >= 0.5) == (i % 4 > 0) for i in range(900)]) > 0.98
    assert s[9001] == s[9002] and all(0 <= x <= 1 for x in s.values())
    more = Q.train(docs.unionByName(docs.where("doc_id = 7").join(spark.range(500).select(), how="cross")), known, table, held_out="crc32(cast(id as string)) % 5 = 0")
    assert all(np.allclose(a, b) for a, b in zip(more.p, net.p, strict=True))
    assert Q.train(docs, known.limit(0), table) is None
    assert {r.quality_score.score for r in Q.score_quality(docs, table, None).collect()} == {0.5}
    assert Q.score_quality(docs.limit(0), table, net).collect() == []


def test_network_matches_brute_force():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 2 * Q.DIM)), rng.integers(0, 2, 60).astype(float)
    net = Q.Network(x, y, shift=0.4)
    z = net.inputs(x)

    def odds(row):
        w, b, u, c = net.p
        hidden = [max(0.0, sum(row[i] * w[i, k] for i in range(len(row))) + b[k]) for k in range(Q.HIDDEN)]
        return sum(h * v for h, v in zip(hidden, u, strict=True)) + c[0]

    want = [1 / (1 + np.exp(-(odds(row) / net.temperature + 0.4))) for row in z[:5]]
    assert np.allclose(net.score(x[:5]), want)
    loss = lambda: np.mean([np.logaddexp(0, -odds(r) if t else odds(r)) for r, t in zip(z[:7], y[:7], strict=True)])
    for k, g in enumerate(net.gradients(z[:7], y[:7])):
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-5
            up = loss()
            net.p[k][at] = old - 1e-5
            slope = (up - loss()) / 2e-5
            net.p[k][at] = old
            assert abs(slope - g[at]) < 1e-6


def test_scores_keep_the_prior_of_all_labels(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(str(w) for w in rng.choice(words, 20)) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1500)], "doc_id long, quality int")
    table = Q.word_vectors(docs)
    few, every = (np.array([r.q.score for r in Q.score_quality(docs, table, Q.train(docs, known, table, sample=n), out_col="q").collect()]) for n in (250, 8000))
    # The texts tell nothing of the label, so scores are near its share, 0.9, whatever the sample.
    assert abs(np.median(few) - 0.9) < 0.06 and abs(np.median(every) - 0.9) < 0.06
