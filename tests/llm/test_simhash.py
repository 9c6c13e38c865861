import re

import numpy as np
import xxhash
from pyspark.sql import types as T

from gridloom.llm import simhash as S

SCHEMA = "doc_id long, text string, component string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_xxh64_matches_the_library():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in [*range(100), 1000, 5003]]
    buf, bounds = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    assert S.xxh64(buf, bounds[:-1], np.diff(bounds)).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_fingerprints_match_brute_force():
    texts = ["", None, "   ", "One", "one  two", "A b c d e A b c", "\ttabs\nand  lines ", "é ß ñ É x", "w" * 5000 + " z", " ".join(f"w{i % 7}" for i in range(4000))]
    got = S.fingerprints([(t or "").encode() for t in texts])
    assert got.tolist() == [brute_print(t) for t in texts]
    assert S.fingerprints([]).tolist() == []


def test_cells_and_components_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    prints = {0, *base.tolist()}
    for _ in range(900):
        x = int(rng.choice(list(prints)[:300])) if rng.random() < 0.8 else int(base[0])
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints)
    signed = [S._signed(p) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for cell in (2048, 16):  # 16 deals cells again
        roots = dict(map(tuple, S.components(S.link_fingerprints(df, cell=cell)).collect()))
        got = [roots.get(p, p) for p in signed]
        assert got == brute_components(signed, prints)


def test_near_duplicates(spark):
    body = " ".join(f"word{i}" for i in range(300))
    rows = [(5, body, "x"), (3, body, "y"), (9, body + " more", "z"), (3, body, "y"), (None, body, None), (7, None, "n"), (8, "", "e"), (11, "alone here now today", "a"), (None, "other text without an id", None)]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = brute_components([r[0] for r in rows], [brute_print(r[1]) for r in rows])
    order = lambda xs: sorted(xs, key=str)
    assert order((r.doc_id, r.text, r.component, r.simhash.component) for r in got) == order((*r, c) for r, c in zip(rows, want, strict=True))
    assert want[7] == 11 and want[8] is None
    empty = S.near_duplicates(spark.createDataFrame([], T._parse_datatype_string(SCHEMA)))
    assert empty.collect() == []


def wide(texts):
    return S.wide_fingerprints([(t or "").encode() for t in texts])


def distances(prints):
    v = prints.view("<u8")
    return np.array([[int(np.bitwise_count(a ^ b).sum()) for b in v] for a in v])


def test_wide_fingerprints():
    texts = ["", None, "one", "a b c d e f", " ".join(f"w{i % 901}" for i in range(200_000))]
    got = wide(texts)
    assert got.shape == (5, S.BITS // 8) and not got[:2].any() and got[2:].any(axis=1).all()
    for t, row in zip(texts, got, strict=True):
        h, _ = S.shingle_hashes([(t or "").encode()], 5)
        bits = [2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h) for b in range(64)]
        assert np.unpackbits(row[:8], bitorder="little").astype(bool).tolist() == bits
    assert 70 < S.apart(0.8) * S.BITS < 80 < S.allowed(0.8) and S.allowed(1.0) == 0


def test_cells_of_wide_fingerprints_match_brute_force():
    rng = np.random.default_rng(4)
    for radius in (40, 85):
        base = rng.integers(0, 256, (30, 64), np.uint8)
        prints = [base]
        for _ in range(12):  # chains and crowds around the same centres
            bits = np.unpackbits(prints[-1][rng.integers(0, len(prints[-1]), 25)], axis=1)
            bits ^= rng.random(bits.shape) < rng.choice([0.02, 0.07, 0.1])
            prints.append(np.packbits(bits, axis=1))
        prints = np.unique(np.concatenate(prints), axis=0)
        cells = np.sort(rng.integers(0, 4, len(prints)))
        nodes = rng.permutation(len(prints)).astype(np.int64)
        a, b = S.link_wide(cells, nodes, np.ascontiguousarray(prints), radius)
        parent = dict(zip(a.tolist(), b.tolist(), strict=True))
        near = (distances(prints) <= radius) & (cells[:, None] == cells)
        want = np.arange(len(prints))
        while ((least := np.where(near, want, len(want)).min(axis=1)) != want).any():
            want = least
        got = [parent.get(n, n) for n in nodes.tolist()]
        pairs = lambda xs: {tuple(np.flatnonzero(np.array(xs) == x)) for x in set(xs)}
        assert pairs(got) == pairs(want.tolist())


def test_representatives_of_similar_documents(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(3000)]
    text = lambda n: " ".join(str(w) for w in rng.choice(words, n))
    rows = [(i, text(int(rng.integers(60, 300))), "c") for i in range(300)]
    for k in range(200):  # a crowd of copies, each with a word changed
        own = rows[7][1].split()
        own[k % len(own)] = f"x{k}"
        rows.append((1000 + k, " ".join(own), "d"))
    rows += [(2000 + k, rows[k + 20][1].upper() + " End.", "e") for k in range(20)]
    rows += [(21, rows[20][1], "same text, other id"), (3000, None, None), (3001, "", "x"), (3002, " ", "x"), (None, rows[5][1], "n"), (None, text(80), "n"), (9, rows[9][1], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(5)
    kept = sorted(S.representatives(df).collect(), key=str)
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    want = {i for i in range(300)} | {3000}
    # 21 stands in two groups with two texts; 20 has the text of one of them.
    assert sorted(ids) == sorted(want) and len(kept) == 302
    assert {r.doc_id for r in kept if r.doc_id is None} == {None}
    cut = S.link_similar(spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(np.unique(wide([r[1] for r in rows]), axis=0))], "node long, print binary"), cell=32)
    assert cut.count() > 200
    assert S.representatives(df.limit(0)).collect() == []
