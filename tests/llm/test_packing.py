import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing as P


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_ids_equal_those_of_the_tokenizer(reference, text):
    assert P.encoder("byte_bpe_50k")(text) == reference.encode(text, add_special_tokens=False).ids


def test_ids_on_awkward_texts(reference):
    for t in ["", "  \n\n x", "<|endoftext|> a", "ab" * 5000, "  x\x00y", "it's we'LL 12,3", " \t \r\n"]:
        assert P.encoder("byte_bpe_50k")(t) == reference.encode(t, add_special_tokens=False).ids


def test_added_tokens_have_the_ids_of_the_tokenizers_default(spark):
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["plain", f"{end} a", f"a{end}{end} \n {end}", f"x  {end}  y", f"<|endof{end}text|>", "<|ENDOFTEXT|> <|endoftext", end, ""]
    for t in texts:
        assert P.encoder("byte_bpe_50k", added=True)(t) == default.encode(t, add_special_tokens=False).ids
    packed = P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packed} == {i: [*default.encode(t, add_special_tokens=False).ids, P.END_ID] for i, t in enumerate(texts)}


def test_pieces_rebuild_every_document(spark, reference):
    texts = ["", None, "a b c", "word " * 5000, "é" * 700, *[f"document number {i} " * (i % 40) for i in range(200)], "a b c"]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, n int").repartition(5)
    for length in (2048, 64):
        packed = P.pack(docs, length=length)
        got = sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset))
        parts = {}
        for r in got:
            parts.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
            assert len(r.ids) == 4 * r.length > 0
        for i, t in enumerate(texts):
            want = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
            mine = sorted(parts[i if i else None])
            assert sum((p[1] for p in mine), []) == want and [p[0] for p in mine] == np.cumsum([0, *[len(p[1]) for p in mine]])[:-1].tolist()
            assert {p[2] for p in mine} == {len(want)}
        total, at = sum(r.length for r in got), 0
        for r in got:
            assert (r.sequence_id, r.offset) == divmod(at, length)
            assert r.sequence_tokens == min(length, total - r.sequence_id * length)
            at += r.length
        whole = {r.sequence_id: r for r in P.sequences(packed, pad_id=258).collect()}
        assert len(whole) == -(-total // length)
        for k, r in whole.items():
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert ids[: r.n_tokens] == sum((np.frombuffer(x.ids, "<u4").tolist() for x in got if x.sequence_id == k), [])
            assert len(ids) == (r.n_tokens if r.n_tokens.bit_count() == 1 else length) and set(ids[r.n_tokens :]) <= {258}


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_padding():
    assert [P.padded(n) for n in (1, 2, 3, 1024, 1025, 2048)] == [1, 2, 2048, 1024, 2048, 2048]
