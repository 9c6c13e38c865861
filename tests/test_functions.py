import json
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import codecs, dtypes
from gridloom.plans import inference as I
from gridloom.sources import metadata as M


@given(st.data())
def test_codecs_round_trip(data):
    names = data.draw(st.lists(st.sampled_from(["gzip", "zlib", "bz2", "lzma", "zstd", "lz4", "snappy"]), max_size=3))
    order = data.draw(st.sampled_from(["C", "F", [1, 2, 0], [2, 0, 1]]))
    endian = data.draw(st.sampled_from(["little", "big"]))
    dtype = data.draw(st.sampled_from(sorted(dtypes.DTYPES)))
    spec = [{"name": "transpose", "configuration": {"order": order}}, {"name": "bytes", "configuration": {"endian": endian}}, *[{"name": n} for n in names]]
    p = codecs.Pipeline(dtype, (2, 3, 4), spec)
    a = np.arange(24).reshape(2, 3, 4).astype(dtypes.numpy_type(dtype))
    assert np.array_equal(p.decode(p.encode(a), (2, 3, 4)), a)
    edge = tuple(data.draw(st.integers(1, n)) for n in (2, 3, 4))
    part = a[tuple(slice(0, e) for e in edge)]
    assert np.array_equal(p.decode(p.encode(a), edge), part) and np.array_equal(p.decode(p.encode(part), edge), part)


def test_codec_errors():
    with pytest.raises(ValueError, match="Unknown codec: nope"):
        codecs.Pipeline("int8", (2,), [{"name": "nope"}])
    with pytest.raises(ValueError, match="unsupported data type"):
        dtypes.numpy_type("string")


def test_wrap_around(spark):
    values = [0, 1, -1, 255, 256, 257, -129, 70000, 3.9, -3.9, float("nan"), float("inf"), 2.0**31, -(2.0**33) - 1]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    for name in dtypes.DTYPES:
        want = dtypes.coerced(values, name).tolist()
        got = [r.x for r in df.select("i", dtypes.wrapped(F.col("v"), name).alias("x")).orderBy("i").collect()]
        same = [a == b or a != a and b != b for a, b in zip(map(float, want), map(float, got))]
        assert all(same), (name, want, got)
    assert np.isnan(dtypes.coerced(["NaN"], "float32")[0]) and dtypes.coerced([3.9], "uint8")[0] == 3
    assert dtypes.coerced([2**64 - 1], "uint64")[0] == 2**64 - 1 and dtypes.coerced([-1], "uint64")[0] == 2**64 - 1


def test_metadata():
    meta = M.ArrayMeta((5, 4), (2, 3), "int16", ({"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}), float("nan"), "v2", "/")
    again = M.from_v3(meta.to_v3())
    assert again.fill == "NaN" and (again.shape, again.chunks, again.codecs, again.encoding, again.separator) == (meta.shape, meta.chunks, meta.codecs, "v2", "/")
    v2 = {"shape": [4, 4], "chunks": [2, 2], "dtype": ">i4", "order": "F", "compressor": {"id": "zlib", "level": 2}, "filters": [{"id": "bz2"}], "fill_value": 7, "dimension_separator": "/"}
    m = M.from_v2(json.dumps(v2))
    assert [c["name"] for c in m.codecs] == ["transpose", "bytes", "bz2", "zlib"] and m.codecs[1]["configuration"]["endian"] == "big"
    assert (m.dtype, m.encoding, m.separator, m.fill) == ("int32", "v2", "/", 7)
    assert M.from_v2(json.dumps({**v2, "dimension_separator": None})).separator == "."
    files = {".zarray": json.dumps(v2).encode()}
    assert M.read_metadata(files.get) == m
    assert M.read_metadata({}.get, m).codecs == M.PLAIN and M.read_metadata({}.get, m).fill is None
    with pytest.raises(FileNotFoundError):
        M.read_metadata({}.get)


def test_candidates_are_ranked():
    assert I.candidates(96**3, (96, 96, 96), (386, 256, 256)) == [[96, 96, 96]]
    c = I.candidates(200704, (96, 96, 96), (193, 128, 128))
    assert c[0] == [98, 32, 64] and c[3] == [49, 64, 64] and I.score([49, 64, 64], (96, 96, 96), (193, 128, 128)) == 126
    c = I.candidates(196608, (96, 96, 96), (96, 128, 128))
    assert c[0] == [96, 32, 64] and c[3] == [48, 64, 64] and len(c) == 18
    assert I.candidates(12, (3, 3), (12, 8)) == [[3, 4], [4, 3]] and I.score([4, 3], (3, 3), (12, 8)) == 36
    assert I.candidates(250000, (96, 96, 96), (100, 50, 50)) == []
    assert I.candidates(8192, (64, 64), (10, 512)) == [[64, 128]]  # a declared size beyond the array stays a candidate


def test_sizes_follow_the_declared_codec():
    raw = b"\x28\xb5\x2f\xfd\x20\xff" + bytes(10)
    assert I.decompressed_size(raw, M.PLAIN) == 16
    assert I.decompressed_size(raw, (*M.PLAIN, {"name": "zstd"})) == 255
    assert I.decompressed_size(b"broken", (*M.PLAIN, {"name": "gzip"}), lambda b: 1 / 0) is None
    assert I.validated([2, 2], [2, 2], lambda k: True) and not I.validated([2, 2], [4, 2], lambda k: k == "c/2/0")


def test_a_probe_that_fails_changes_nothing():
    m = M.ArrayMeta((12, 8), (3, 3), "int32")
    fail = lambda *_: 1 / 0
    assert I.validated([3, 4], [12, 8], fail)
    assert I.probed(m, fail, fail) == [3, 3] and I.probed(m, lambda: None, fail) == [3, 3]
    assert I.probed(m, lambda: bytes(48), fail) == [3, 4] and I.probed(m, lambda: bytes(48), lambda k: k == "c/0/2") == [4, 3]


def test_blosc_frames():
    rng = np.random.default_rng(3)
    data = np.repeat(rng.integers(0, 999, 700), 3).astype("<i4").tobytes()
    for name in ("lz4", "zlib", "zstd", "snappy"):
        for shuffle in (0, 1, 2, "bitshuffle"):
            for raw in (data, data[:-3], b"", rng.bytes(300)):
                encode, decode = codecs.REGISTRY["blosc"][1](cname=name, shuffle=shuffle, typesize=4, blocksize=1000)
                assert decode(encode(raw)) == raw
    assert len(codecs.REGISTRY["blosc"][1](cname="zlib", shuffle=1, typesize=4)[0](data)) < len(data) // 3
    # A block in parts, one for each byte of an element, as the format's own writer makes it.
    block = np.arange(4 * 512, dtype="<u4").tobytes()
    turned = np.frombuffer(block, np.uint8).reshape(-1, 4).T
    parts = [zlib.compress(x.tobytes()) for x in np.ascontiguousarray(turned)]
    body = b"".join(len(x).to_bytes(4, "little") + x for x in parts)
    head = bytes([2, 1, 1 | 3 << 5, 4]) + b"".join(x.to_bytes(4, "little") for x in (len(block), len(block), 20 + len(body), 20))
    assert codecs.REGISTRY["blosc"][1]()[1](head + body) == block and codecs.blosc_content_size(head + body) == len(block)
    with pytest.raises(ValueError, match="blosclz"):
        codecs.REGISTRY["blosc"][1]()[1](bytes([2, 1, 0, 4]) + head[4:] + body)


def test_fill_values_are_json():
    for fill, text in ((float("inf"), "Infinity"), (float("-inf"), "-Infinity"), (float("nan"), "NaN")):
        m = M.ArrayMeta((2,), (2,), "float64", fill=fill)
        assert json.loads(m.to_v3(), parse_constant=lambda x: 1 / 0)["fill_value"] == text
        assert str(M.from_v3(m.to_v3()).fill_scalar()) == str(np.float64(fill))
