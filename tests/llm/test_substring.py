import re
from collections import defaultdict

import pytest

from gridloom.llm import substring as S


def sentences(text):
    """(first byte, words) of each sentence."""
    out, own, at = [], [], 0
    raw = (text or "").encode()
    found = list(re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw))
    for i, m in enumerate(found):
        if not own:
            at = m.start()
        own.append(m[0].translate(S.np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], "u1").tobytes()))
        gap = raw[m.end() : found[i + 1].start()] if i + 1 < len(found) else b"\n"
        if m[0][-1:] in (b".", b"!", b"?") or b"\n" in gap or b"\r" in gap:
            out.append((at, own))
            own = []
    return out


def brute(rows, least, alone):
    groups, texts = defaultdict(set), {}
    for d, t in rows:
        key = (d is not None, d or 0, t or "")
        texts[d, t] = s = sentences(t)
        n = len(s)
        size = lambda a, b, s=s: sum(len(w) for _, w in s[a : b + 1])
        spans = set()
        for k, words in ((3, 0), (2, least), (1, alone)):
            spans |= {(i, i + k - 1) for i in range(n - k + 1) if size(i, i + k - 1) >= words}
        for a, b in spans:
            groups[tuple(w for _, ws in s[a : b + 1] for w in ws)].add((key, a, b, (d, t)))
    gone = defaultdict(set)
    for hits in groups.values():
        for _, a, b, row in sorted(hits, key=lambda h: h[:3])[1:]:
            gone[row].update(range(a, b + 1))
    out = {}
    for (d, t), s in texts.items():
        if t is None:
            out[d, t] = (0, [], None)
            continue
        raw, cut = t.encode(), sorted(gone[d, t])
        ends = [a for a, _ in s[1:]] + [len(raw)]
        left = raw[: s[0][0]] + b"".join(raw[a:e] for k, ((a, _), e) in enumerate(zip(s, ends)) if k not in cut) if s else raw
        out[d, t] = (len(s), cut, left.decode())
    return out


PASSAGE = "One two three four. Five six seven! Eight nine é ten eleven twelve? Thirteen fourteen."
ROWS = [
    (1, "Start here. " + PASSAGE + " The end of it."),
    (2, "Another  start.\n" + PASSAGE.replace(" ", "  ") + "\nAnother end"),
    (0, "  lead " + PASSAGE.upper()),
    (3, PASSAGE + "\n" + PASSAGE),
    (4, "a b c. d e f. g h i. j k l. " * 400),
    (5, None),
    (6, ""),
    (7, " \n "),
    (8, "x " * 60 + ". short."),
    (9, "x " * 60 + ". other."),
    (None, PASSAGE),
    (10, "Clean words only here. Nothing is repeated at all. Three sentences."),
    (11, "LA!! DE!! UN!! LA!! DE!! UN!!"),
    (12, "LA!! DE!! UN!!"),
    (13, "Ab. Cd. Ef. and so"),
    (14, "Other words. Ab. Cd. Ef. and more"),
    (15, "Ab. Cd. Other ones. Ef."),
]


@pytest.mark.parametrize("least,alone", [(8, 20), (25, 50)])
def test_matches_brute_force(spark, least, alone):
    rows = [*ROWS, ROWS[0], ROWS[10]]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, h int").repartition(4)
    got = S.drop_repeats(df, min_words=least, alone=alone).collect()
    want = brute(rows, least, alone)
    assert len(got) == len(rows)
    for r in got:
        assert (r.repeats.n_sentences, list(r.repeats.spans), r.repeats.text) == want[r.doc_id, r.text], r.doc_id
        assert r.repeats.n_removed == len(r.repeats.spans)
    assert S.drop_repeats(df.limit(0)).collect() == []
    short = {r.doc_id: r.repeats.text for r in got}
    assert short[14] == "Other words. and more" and short[15] == "Ab. Cd. Other ones. Ef."
    with pytest.raises(ValueError):
        S.drop_repeats(df, out_col="h")
