import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from gridloom.llm import mixing as M


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def corpus():
    rng = np.random.default_rng(8)
    share = 1 / np.arange(1, 61)
    texts = []
    tongues = []
    for parts in (["ka", "ro", "mi", "té", "lun", "ñá"], ["sho", "ber", "ix", "und", "gr", "wal"]):
        tongues.append((parts, ["".join(str(x) for x in rng.choice(parts, rng.integers(1, 4))) for _ in range(60)]))
    for i in range(400):
        parts, common = tongues[i // 3 % 2]
        make = lambda parts=parts: "".join(str(x) for x in rng.choice(parts, rng.integers(2, 4))) + "."
        texts.append(" ".join(str(rng.choice(common, p=share / share.sum())) if rng.random() < 0.9 else make() for _ in range(rng.integers(1, 200))))
    return [*texts, None, "", "  ", "Ünknown QQQ " + "z" * 3000, texts[3], "ka " * 30000]


def test_counts_and_base_score_match_brute_force(spark):
    texts = corpus()
    rows = [(i if i != 7 else None, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, out string").repartition(5)
    trained = docs.where("doc_id is null or doc_id % 3 > 0")
    count = Counter()
    for d, t, _ in rows:
        if d is None or d % 3:
            count.update([*words(t), None])
    total, distinct = sum(count.values()), len(count)
    for bound in (1 << 20, 40):
        model, rest, (n, v) = M.train(trained, frequent=bound)
        assert (n, v) == (total, distinct)
        got = M.score_texts(docs, model, rest, (n, v), keep=["doc_id"]).collect()
        assert len(got) == len(rows)
        want = sorted((str(d), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in [*words(t), None]), 5)) for d, t, _ in rows)
        assert sorted((str(r.doc_id), r.out.n_tokens, r.out.n_known, round(r.out.base_score, 5)) for r in got) == want
        assert all(r.out.train_tokens == total and r.out.score < 0 and r.out.bits_per_byte > 0 for r in got)
        unseen = [r.out for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
        if bound > 40:
            assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    empty = M.train(docs.limit(0))
    assert {r.out.base_score for r in M.score_texts(docs, *empty, keep=["doc_id"]).collect()} == {0.0}
    assert M.score_texts(docs.limit(0), *empty, keep=["doc_id"]).collect() == []


def test_probabilities_of_a_token_add_up_to_one():
    hashes = M._hashed([b"aa", b"ab", b"b", b"q"])
    d = M.Dictionary(hashes, np.array([40, 20, 9, 8]), np.array([0, 0, 1, 0]), 30, np.zeros(256))
    lengths, codes = np.append(d.length, d.end[0]), np.append(d.code, d.end[1])
    assert sum(2.0**-x for x in lengths) <= 1
    full = sorted((format(int(c), f"0{int(n)}b") for c, n in zip(codes, lengths)))
    assert not any(b.startswith(a) for a, b in zip(full, full[1:]))
    length, code = M.huffman(np.arange(256) ** 3)
    full = sorted(format(int(c), f"0{int(n)}b") for c, n in zip(code, length))
    assert sum(2.0**-x for x in length) == 1 and not any(b.startswith(a) for a, b in zip(full, full[1:]))


def test_scores_do_not_depend_on_what_stands_beside(spark):
    texts = corpus()[:200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = M.train(docs)
    all_of = {r.doc_id: r.out.score for r in M.score_texts(docs.repartition(7), *trained).collect()}
    one = {r.doc_id: r.out.score for r in M.score_texts(docs.where("doc_id < 5").coalesce(1), *trained).collect()}
    assert all(math.isclose(all_of[i], one[i], rel_tol=1e-9) for i in one)


def test_word_order_counts(spark):
    rng = np.random.default_rng(3)
    follow = {i: rng.choice(40, 2) for i in range(40)}
    texts = []
    for _ in range(400):
        at, out = int(rng.integers(40)), []
        for _ in range(60):
            out.append(f"w{at}x")
            at = int(rng.choice(follow[at]))
        texts.append(out)
    frame = lambda rows: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    trained = M.train(frame(texts[:300]))
    kept, mixed = (sum(r.out.score for r in M.score_texts(frame(x), *trained).collect()) for x in (texts[300:], [list(rng.permutation(t)) for t in texts[300:]]))
    # A word has 2 followers of 40: about 0.3 of 1.6 decimal digits a word.
    assert kept > 0.7 * mixed and kept / 6000 > -0.8


def test_scores_match_brute_force(spark):
    texts = corpus()[:150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = M.train(docs)
    model, dictionary = trained[0], trained[0].dictionary
    count = Counter(w.encode() for t in texts for w in words(t))
    rare = {w: n for w, n in count.items() if n < M.LEAST}
    assert {bytes(r.word): r.n for r in trained[1].collect()} == rare and 1 in rare.values()
    new = list(rare.values()).count(1) / sum(rare.values())
    few = ["", "Ünknown ka.", "y" * 700, *texts[:4], " ".join(texts[5].split()[::-1])]
    got = {r.doc_id: r.out.score for r in M.score_texts(spark.createDataFrame(list(enumerate(few)), "doc_id long, text string"), *trained).collect()}

    def fold(*parts):
        h = 0
        for p in parts:
            h = (h ^ p) * 0x9FB21C651E98DF25 % (1 << 64)
            h ^= h >> 31
        return h

    def token(word, cls, one, two):
        """Log10 probability of one token, a bit at a time."""
        count, length, code = dictionary.find(M._hashed([word] if word else []))
        which = 1 if word else 0
        size, data = (np.array([len(word)]), np.frombuffer(word, np.uint8)) if word else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        before = np.array([[one], [two]], np.uint32).view(np.int32)
        told = {M.CODE: 0.0, M.SPELL: 0.0}
        for _, contexts, slots, bits in M.steps(dictionary.letters, M.Spelling(size, data), length, code, np.array([which]), np.array([cls]), before):
            for i, bit in enumerate(bits.tolist()):
                at = [int(s[i]) for s in slots]
                rich, other = (int(model.seen[at[k]]) for k in M.deciding(contexts))
                g = int(M.gate(contexts, rich, other))
                x = max(-12.0, min(12.0, sum(float(model.weights[g, k]) * int(model.odds[a]) / M.ODDS for k, a in enumerate(at))))
                level = min(M.LEVELS - 1, max(0, int((x + 8) * M.LEVELS / 16)))
                p = 0.5 / (1 + math.exp(-x)) + 0.5 * float(model.maps[g * M.LEVELS + level])
                p = min(1 - 1e-6, max(1e-6, p))
                told[contexts] += math.log10(p if bit else 1 - p)
        if length[which]:
            assert word not in rare
            return told[M.CODE]
        # What is left: with the share of words met once, the spelling; else one of the counted words.
        if word not in rare:
            return told[M.CODE] + told[M.SPELL] + math.log10(new)
        return told[M.CODE] + math.log10(new * 10 ** told[M.SPELL] + (1 - new) * rare[word] / sum(rare.values()))

    for d, text in enumerate(few):
        own = [w.encode() for w in words(text)]
        parts = M.Words([text.encode()])
        hashes = [int(h) for h in M._hashed(own)] if own else []
        want = 0.0
        for i in range(len(own) + 1):
            one = hashes[i - 1] if i >= 1 else 1
            two = hashes[i - 2] if i >= 2 else 2
            want += token(own[i] if i < len(own) else b"", int(parts.cls[i]), fold(one) >> 32, fold(one, two) >> 32)
        assert math.isclose(got[d], want, rel_tol=2e-4), (d, got[d], want)


def test_codes_of_a_context_share_one(spark):
    texts = corpus()[:150]
    trained = M.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model, d = trained[0], trained[0].dictionary
    n = len(d.hashes)
    assert n > 20
    for cls, one in ((0, 5), (M.KINDS + 2, 9)):
        word = np.arange(1, n + 1)
        told = model.told(np.ones(n, np.int64), np.zeros(n, np.uint8), np.append(d.end[0], d.length), np.append(d.end[1], d.code), np.append(0, word), np.full(n + 1, cls), np.full((2, n + 1), one, np.int32)).sum(axis=0)
        # All words of the dictionary and the end; what is left is for spelled words and unused codes.
        assert 0.2 < (10.0**told).sum() <= 1 + 1e-9


def test_groups_of_pairs_match_brute_force():
    rng = np.random.default_rng(5)
    keys, before = rng.integers(0, 9, 500).astype(np.int32), rng.integers(0, 4, (2, 500)).astype(np.int32)
    rows = list(zip(keys.tolist(), *before.tolist(), strict=True))
    found, near, back, n = M.grouped(keys, before)
    pairs = list(zip(found.tolist(), *near.tolist(), strict=True))
    assert dict(zip(pairs, n.tolist(), strict=True)) == Counter(rows) and len(set(pairs)) == len(pairs)
    assert found.tolist() == sorted(found.tolist()) and [pairs[i] for i in back] == rows
    assert [x.tolist() for x in M.grouped(keys, before, places=False) if x is not None] == [x.tolist() for x in (found, near, n)]


def test_learning_holds_one_group_of_tokens_at_a_time(monkeypatch):
    monkeypatch.setattr(M, "TOKENS", 200_000)
    monkeypatch.setattr(M, "PIECE", 1 << 17)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30_000, 1000)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    dictionary = M.Dictionary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 800, np.zeros(256))

    def learned():
        return sum(int(n.sum()) for n, _ in M._bits(iter([batch]), dictionary, M.STEP))

    assert learned() == 800 * 1001
    tracemalloc.start()
    learned()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Bytes a token of a group: its words, its pairs and what sorts them, but not those of the group before.
    assert peak < 130 * M.TOKENS, peak


def test_ordered_matches_argsort():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5000):
        x = rng.integers(0, 700, n).astype(np.uint64) << np.uint64(40)
        assert M.ordered(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_what_does_not_depend_on_previous_words_is_done_once_a_key(monkeypatch):
    """Learning and scoring look up the contexts without previous words once for a (word, surroundings) key, and what they count is what the bits of all pairs give."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{x}" for x in range(60)]
    texts = [" ".join([*rng.choice(vocabulary, 400), f"rare{i % 7}x", "rare!"]) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    dictionary = M.Dictionary(M._hashed([w.encode() for w in vocabulary]), np.full(60, 400), np.zeros(60, np.int64), 60, np.bincount(np.frombuffer(texts[0].encode(), np.uint8), minlength=256))
    asked, place = Counter(), M._place

    def counted(k, context, node):
        asked[k] += len(context)
        return place(k, context, node)

    monkeypatch.setattr(M, "_place", counted)
    shared = type("Shared", (), {"value": dictionary})
    made = [r for b in M._mixed(shared)(iter([batch])) for r in b.to_pylist()]
    # 24,000 tokens with few keys, each with many previous words.
    assert asked[0] == asked[3] and 0 < 5 * asked[0] < asked[4] == asked[5]
    got = np.zeros((M.SLOTS, 2))
    for r in made:
        if r["block"] != M.LEARNED:
            at = r["block"] * M.BLOCK
            got[at : at + M.BLOCK] = M._unpacked(r["sums"], "<u4").reshape(-1, 2)[: M.SLOTS - at]
    parts = M.Words([t.encode() for t in texts])
    hashes, size, data, numbers = M.merged([parts])
    _, length, code = dictionary.find(hashes)
    word, spelling = numbers[0][parts.word].astype(np.int64), M.Spelling(size, data)
    want = np.zeros((M.SLOTS, 2))
    asked.clear()
    for _, _, slots, bits in M.steps(dictionary.letters, spelling, length, code, word, parts.cls.astype(np.int64), parts.before):
        for slot in slots:
            np.add.at(want, (slot, bits), 1)
    assert np.array_equal(got, want) and got.sum() > 0
    model = M.Model(M.halved(got), M.start_weights(), np.zeros((M.GATES * M.LEVELS, 2)), dictionary)
    keys, before, _, _ = M.grouped(M.pair_keys([parts], numbers, len(size)), parts.before)
    asked.clear()
    model.told(size, data, length, code, keys // M.CLASSES, keys % M.CLASSES, before)
    assert asked[0] == asked[3] and 0 < 5 * asked[0] < asked[4] == asked[5]
