import re

import pytest

from gridloom.llm import decontaminate as D

lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute(text, items, size=8):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        k = min(size, len(v))
        for a in range(len(v) - k + 1) if k and i is not None else []:
            for b in range(len(w) - k + 1):
                if w[b : b + k] == v[a : a + k]:
                    hit.update(range(b, b + k))
                    found.add(str(i))
    return len(w), sorted(found), sorted(hit)


ITEMS = [(1, "A b c d e f g h i j"), (2, "short one"), (10, "c d e f g h i j k l m"), (3, None), (4, "..."), (5, "aa aa aa aa aa aa aa aa aa"), (None, "x y z"), (6, "Ünï çödé wörds äre hére fór yöu tóo"), (2, "short one")]
DOCS = ["a B c, d e f g h i j k", None, "", "!!", "a short one and short-one", "aa " * 30, "x y z", "so ünï ÇödÉ wörds äre hére fór yöu tóo x", "ünï çödé wörds äre hére fór yöu tóo", "a b c d e f g h", "pad " * 5000 + "a b c d e f g h i j k l m" + " pad" * 300, "a b c d e f g", "h i j"]


@pytest.mark.parametrize("room", [D.PASS_BYTES, 150])
def test_matches_brute_force(spark, room):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(DOCS)] + [(4, DOCS[4], None)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_contamination(docs, bench, pass_bytes=room).collect()
    assert len(got) == len(DOCS) + 1
    for r in got:
        c = r.contamination
        assert (c.n_words, list(c.items), list(c.hits)) == brute(r.text, ITEMS), r.text
        assert c.n_hit == len(c.hits)
    with pytest.raises(ValueError):
        D.find_contamination(docs, bench, out_col="n_words")


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(docs, none).first().contamination.n_hit == 0
    assert D.find_contamination(docs.limit(0), none).collect() == []
