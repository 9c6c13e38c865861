import re

import numpy as np
import pytest

import corpus_pipeline as C
from gridloom.llm import toxicity as X
from gridloom.llm.packing import encoder

from .test_decontaminate import brute as brute_leak
from .test_pii import base


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups(rows):
    """The smallest id of the documents reachable by a similarity of 0.8."""
    sets, part = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both):
                part = [part[j] if x == part[i] else x for x in part]
    least = {p: min(str(r[0]).rjust(9) for r, q in zip(rows, part, strict=True) if q == p) for p in set(part)}
    return [least[p].strip() for p in part]


def corpus():
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(str(w) for w in rng.choice(words, n))
    items = [(1, text(20)), (2, text(30))]
    rows = []
    for i in range(500):
        t = text(int(rng.integers(20, 90)))
        if i % 5 == 0:
            t += " nasty vile nasty"
        if i % 17 == 1:
            t += " " + items[i % 2][1] + " " + text(5)
        if i % 13 == 2:
            t += " write to joe.x@mail.example or +1 (743) 555-3824 now"
        rows.append((i, t, "en", "s", len(t)))
    for i in range(40):
        k = 1 + 5 * i
        rows.append((500 + i, rows[k][1] + " " * (i % 2) + "done" * (i % 3 == 0), "en", "t", len(rows[k][1])))
    rows += [(700, None, None, None, None), (701, "", "en", "s", 0), (None, text(30), "en", "s", 1), (3, rows[3][1], "en", "s", 2)]
    return rows, items, [(i, int(i % 5 == 0)) for i in range(500)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items, labels = corpus()
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_match_brute_force(spark, folder):
    rows, items, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for _, stage in C.STAGES:
        docs = C.staged(stage(spark, docs, folder), "t")
        results.append(docs.collect())
    key = lambda xs: sorted((tuple(x) for x in xs), key=str)
    for r in results[:4]:
        assert not r or r[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = key(results[0])
    ids = {r[0] for r in kept}
    assert len(ids & set(range(0, 500, 5))) <= 5 and len([i for i in range(500) if i % 5 and i not in ids]) <= 5 and {700, 701, None} <= ids
    assert set(kept) <= set(rows)
    # One row of each component, that of the smallest id.
    want = sorted(({(r[0], r[1]) for r, c in zip(kept, groups(kept), strict=True) if str(r[0]) == c}), key=str)
    assert len(kept) - len(want) >= 30
    assert [(r[0], r[1]) for r in key(results[1])] == want
    clean = [r for r in key(results[1]) if not brute_leak(r[1], items)[1]]
    assert key(results[2]) == clean and len(clean) < len(want)
    hidden = {r.doc_id: r for r in results[3]}
    assert len(results[3]) == len(clean)
    for r in clean:
        out, at = "", 0
        spans = base(r[1])
        got = hidden[r[0]]
        if not spans:
            assert tuple(got) == r
            continue
        for a, _, b, k, _ in spans:
            out += r[1][at:a] + f"[{k.upper()}]"
            at = b
        out += r[1][at:]
        # Terms near an entity may go besides.
        assert "@" not in got.text and "555" not in got.text and got.n_chars == len(got.text) and (got.text == out or "[TERM]" in got.text)
    pieces = {}
    for r in results[4]:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for i, r in hidden.items():
        n = len(encoder("byte_bpe_50k")(r.text or "")) + 1
        assert sum(p[1] for p in pieces[i]) == n == pieces[i][0][2]
    whole = C.run(spark, folder).collect()
    assert key(whole) == key(results[4])


def test_reject_threshold_is_the_operators():
    assert X.REJECT == 0.7
