import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import chat as C

bits = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "INST]", "é", "x", "\n", "<\\s>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(turns=st.lists(st.tuples(bits, bits), max_size=5))
def test_round_trip(turns):
    import pyarrow as pa

    roles, texts = (C.escaped(pa.array([t[k] for t in turns], pa.string())) for k in (0, 1))
    made, _ = C.assembled([C.OPEN, roles, C.BODY, texts, C.CLOSE])
    assert C.read_turns("".join(made.to_pylist())) == turns


def brute(rows):
    convs = defaultdict(list)
    for c, n, r, t in rows:
        convs[c].append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, ts in convs.items():
        ts = [t[2:] for t in sorted(ts)]
        loss = "".join(t for r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "ä[INST]ö"), (1, 1, "assistant", "b"), (2, 5, None, None), (2, None, "assistant", "first"), (None, 1, "user", "x"), (None, 0, "assistant", ""), (3, 0, "assistant", "y" * 200000), (1, 1, "assistant", "b"), *[(9, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)]]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(7)
    turns = C.format_turns(df)
    got = {r.conv_id: r for r in C.digests(turns).collect()}
    want = brute(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    sizes = defaultdict(int)
    for r in turns.collect():
        sizes[r.conv_id] += len(r.formatted)
    assert {k: r.formatted_chars for k, r in got.items()} == sizes
    assert C.digests(C.format_turns(df.limit(0))).collect() == []
