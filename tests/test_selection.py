import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import layout
from gridloom.plans import selection as S
from gridloom.plans.selection import slice_
from gridloom.sources.metadata import ArrayMeta

ends = st.one_of(st.none(), st.integers(-30, 30))


@settings(max_examples=500, deadline=None)
@given(n=st.integers(0, 25), c=st.integers(1, 9), a=ends, b=ends, step=st.one_of(st.none(), st.integers(1, 12)))
def test_slices_match_numpy(n, c, a, b, step):
    d = S.dimension(slice(a, b, step), n)
    want = np.arange(n)[a:b:step].tolist()
    assert d.start + d.step * np.arange(d.count) == pytest.approx(want) if want else d.count == 0
    chunks = sorted({i // c for i in want})
    assert d.chunk_count(c) == len(chunks)
    assert [x for k in range(-(-n // c)) for x in d.inside(k, c).tolist()] == want
    for k in range(-(-n // c)):
        assert d.covers(k, c, n) == set(range(k * c, min(n, k * c + c))).issubset(want)


def test_whole_numbers_and_errors():
    assert S.dimension(-1, 5) == S.Dim(4, 1, 1, False) and S.dimension(2.9, 5).start == 2
    for bad, n in [(5, 5), (-6, 5), (0, 0)]:
        with pytest.raises(IndexError, match="out of bounds"):
            S.dimension(bad, n)
    with pytest.raises(IndexError, match="step cannot be zero"):
        S.dimension(slice(None, None, 0), 4)
    with pytest.raises(IndexError, match="step >= 1"):
        S.dimension(slice(None, None, -2), 4)
    with pytest.raises(IndexError, match="too many"):
        S.normalized([1, 2], (3,))
    assert S.result_shape(S.normalized([0, slice_(None, None, 2)], (2, 3, 4))) == [2, 4]
    assert slice_(3) == slice(None, 3, None) and slice_(1, None) == slice(1, None, None) and slice_(None) == slice(None)


@settings(max_examples=15, deadline=None)
@given(st.data())
def test_plan_names_the_chunks_that_are_needed(spark, data):
    rank = data.draw(st.integers(0, 3))
    shape, chunks = ([data.draw(st.integers(1, 12)) for _ in range(rank)] for _ in range(2))
    sel = [slice(data.draw(ends), data.draw(ends), data.draw(st.integers(1, 7))) for _ in range(rank)]
    meta = ArrayMeta(shape, chunks, "uint8")
    rows = S.chunk_plan(spark, meta, S.normalized(sel, shape)).collect()
    index = np.indices(shape)[(slice(None), *sel)].reshape(rank, -1) if rank else np.zeros((0, 1), int)
    want = {tuple((p // chunks).tolist()) for p in index.T} if rank else {()}
    assert {tuple(r[f"c{i}"] for i in range(rank)) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        k = [r[f"c{i}"] for i in range(rank)]
        assert r.key == layout.chunk_key(k) and [r[f"e{i}"] for i in range(rank)] == layout.edge_shape(shape, chunks, k)


def test_layout():
    assert layout.strides((2, 3, 4)) == [12, 4, 1] and layout.strides((2, 3, 4), "F") == [1, 2, 6] and layout.strides((2, 3, 4), [1, 0, 2]) == [4, 8, 1]
    assert layout.chunk_key([]) == "c" and layout.chunk_key([], "v2") == "0" and layout.chunk_key([1, 2], "v2", "/") == "1/2" and layout.chunk_key([1, 2]) == "c/1/2"
    with pytest.raises(ValueError, match="unknown chunk key encoding"):
        layout.chunk_key([1], "other")
    with pytest.raises(ValueError):
        layout.strides((2, 3), [0, 0])
