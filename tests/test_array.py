import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.layout import strides
from gridloom.operators.array import ArrayFrame, StoredArray
from gridloom.plans.selection import slice_
from gridloom.sources.metadata import PLAIN, ArrayMeta
from gridloom.sources.store import synthetic


def cells(spark, a, prefix="i"):
    i = F.col("id")
    where = [F.pmod(F.floor(i / F.lit(s)), F.lit(n)).cast("long").alias(f"{prefix}{d}") for d, (s, n) in enumerate(zip(strides(a.shape), a.shape))]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(a.ravel().tolist())], f"id long, value {'double' if a.dtype.kind == 'f' else 'decimal(20,0)' if a.dtype == np.uint64 else 'long'}")
    return rows.select(*where, "value")


def made(spark, a, chunks, dtype=None, **more):
    return ArrayFrame.from_cells(cells(spark, a), ArrayMeta(a.shape, chunks, dtype or str(a.dtype), **more))


def test_sequence_of_writes(spark):
    a = ArrayFrame.empty(spark, ArrayMeta((5, 10), (2, 5), "int32"))
    assert not a.dense().any()
    a = a.write([0], 42)
    assert a.dense()[0].tolist() == [42] * 10 and a.dense().sum() == 420
    a = a.write([None, 0], 42)
    assert a.dense()[:, 0].tolist() == [42] * 5
    a = a.write(None, 42)
    assert (a.dense() == 42).all()
    a = a.write([0], cells(spark, np.arange(10), "o"))
    want = np.arange(50).reshape(5, 10)
    assert a.dense()[0].tolist() == list(range(10))
    a = a.write(None, cells(spark, want, "o"))
    for sel in [(), (slice(None), 0), (0,), (1,), (slice(None), slice(0, 7)), (slice(0, 3),), (slice(1, 4), slice(2, 7))]:
        assert np.array_equal(a.dense(list(sel)), want[sel])


def test_selections_of_three_dimensions(spark):
    want = np.arange(24, dtype=np.int32).reshape(2, 3, 4)
    a = made(spark, want, (1, 2, 2))
    n = None
    golden = [([1, slice_(1, 3)], range(16, 24)), ([n, slice_(1, 3), slice_(2)], [4, 5, 8, 9, 16, 17, 20, 21]), ([n, n, 0], range(0, 24, 4)), ([0, slice_(n, n, 2), slice_(n, n, 3)], [0, 3, 8, 11]), ([n, n, slice_(n, n, 4)], range(0, 24, 4)), ([1, n, slice_(n, 3, 2)], range(12, 24, 2)), ([n, 1], [4, 5, 6, 7, 16, 17, 18, 19]), ([1, 2], range(20, 24))]
    for sel, values in golden:
        assert a.dense(sel).ravel().tolist() == list(values)
    assert a.scalar([1, 1, 1]) == 17
    with pytest.raises(IndexError):
        a.read([0, slice_(n, n, -2)])
    with pytest.raises(ValueError):
        a.scalar([1])


def test_sparse_and_fill(spark):
    big = ArrayFrame.empty(spark, ArrayMeta((7_500_000,), (42,), "float64")).write([slice_(5)], 1)
    assert big.dense([slice_(10)]).tolist() == [1.0] * 5 + [0.0] * 5 and big.chunks.count() == 1
    d = ArrayFrame.empty(spark, ArrayMeta((6,), (2,), "int32", fill=-1)).write([slice_(2)], 42)
    assert d.dense().tolist() == [42, 42, -1, -1, -1, -1]
    nan = ArrayFrame.empty(spark, ArrayMeta((3,), (2,), "float32", fill="NaN")).write([0], 1)
    assert nan.dense()[0] == 1 and np.isnan(nan.dense()[1:]).all()
    for dtype, top in (("int64", 2**63 - 1), ("uint64", 2**64 - 1)):
        x = ArrayFrame.empty(spark, ArrayMeta((5,), (2,), dtype, fill=7)).write([slice_(1, 3)], top)
        assert x.dense().tolist() == [7, top, top, 7, 7]


def test_scalar_and_empty(spark):
    zero = ArrayFrame.empty(spark, ArrayMeta((), (), "int16", fill=3))
    assert zero.scalar(None) == 3 and zero.write(None, 9).scalar([]) == 9
    a = made(spark, np.arange(10), (4,), "int32")
    for sel in (slice_(4, 4), slice_(5, 2), slice_(5, 5), slice_(20, 30)):
        assert a.read([sel]).collect() == [] and a.shape_of([sel]) == [0]
        assert a.write([sel], 1).dense().tolist() == list(range(10))


@settings(max_examples=8, deadline=None)
@given(st.data())
def test_reads_and_writes_match_numpy(spark, data):
    rank = data.draw(st.integers(1, 3))
    shape, chunks = ([data.draw(st.integers(1, 8)) for _ in range(rank)] for _ in range(2))
    dtype = data.draw(st.sampled_from(["int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "float32", "float64"]))
    spec = data.draw(st.sampled_from([PLAIN, (*PLAIN, {"name": "zstd"}), ({"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}), ({"name": "transpose", "configuration": {"order": "F"}}, *PLAIN)]))
    sel = []
    for n in shape:
        kind = data.draw(st.integers(0, 3))
        sel.append(data.draw(st.integers(-n, n - 1)) if kind == 0 else slice(data.draw(st.integers(-9, 9)), data.draw(st.integers(-9, 9)), data.draw(st.integers(1, 4))) if kind == 1 else slice(None))
    want = np.arange(math.prod(shape)).reshape(shape).astype(dtype)
    a = made(spark, want, chunks, codecs=spec)
    assert np.array_equal(a.dense(sel), want[tuple(sel)])
    want[tuple(sel)] = 99
    a = a.write(sel, 99)
    assert np.array_equal(a.dense(), want)
    new = np.arange(want[tuple(sel)].size).reshape(want[tuple(sel)].shape).astype(dtype)
    if new.ndim and new.size:
        want[tuple(sel)] = new
        assert np.array_equal(a.write(sel, cells(spark, new, "o")).dense(), want)


def test_cells_outside_the_selection_are_refused(spark):
    a = made(spark, np.arange(6), (3,), "int32")
    with pytest.raises(Exception, match="outside the selection"):
        a.write([slice_(1, 4)], cells(spark, np.arange(4), "o")).dense()
    with pytest.raises(ValueError):
        a.write([slice_(1, 4)], cells(spark, np.arange(3), "i"))


def test_edges_may_be_padded_or_cut(spark):
    want = np.arange(10, 80, 10, dtype=np.int32)
    a = made(spark, want, (3,))
    cut = a.chunks.withColumn("payload", F.when(F.col("c0") == 2, F.substring("payload", 1, 4)).otherwise(F.col("payload")))
    assert np.array_equal(ArrayFrame(a.meta, cut).dense(), want)
    assert ArrayFrame(a.meta, cut).write([slice_(5, 7)], 1).dense().tolist() == [10, 20, 30, 40, 50, 1, 1]
    bad = a.chunks.withColumn("payload", F.substring("payload", 1, 8))
    with pytest.raises(Exception, match="elements"):
        ArrayFrame(a.meta, bad).dense()


def test_larger_volume_with_edges(spark):
    z, y, x = np.ogrid[:109, :64, :64]
    want = ((7 * z + 3 * y + x) % 65535 + 1).astype(np.uint16)
    i = F.col("id")
    table = spark.range(want.size).select(F.floor(i / 4096).alias("i0"), F.pmod(F.floor(i / 64), F.lit(64)).alias("i1"), F.pmod(i, F.lit(64)).alias("i2")).withColumn("value", F.pmod(7 * F.col("i0") + 3 * F.col("i1") + F.col("i2"), F.lit(65535)) + 1)
    a = ArrayFrame.from_cells(table, ArrayMeta(want.shape, (28, 24, 40), "uint16", (*PLAIN, {"name": "zstd"})))
    assert np.array_equal(a.dense(), want)


def test_plan_prunes_and_stays_in_few_stages(spark):
    a = ArrayFrame.from_cells(synthetic(spark, ArrayMeta((32, 32), (8, 8), "float32")), ArrayMeta((32, 32), (8, 8), "float32"))
    assert a.chunks.count() == 16
    from gridloom.plans.selection import chunk_plan, normalized

    assert chunk_plan(spark, a.meta, normalized([slice_(8, 16), 3], a.meta.shape)).count() == 1


def test_store_directory_and_versions(spark, tmp_path):
    want = np.arange(35, dtype=np.int32).reshape(7, 5)
    at = f"file://{tmp_path}/native"
    a = made(spark, want, (3, 2), codecs=(*PLAIN, {"name": "gzip", "configuration": {"level": 1}})).save(at)
    b = a.write([slice_(2, 4)], 7).save(at)
    assert np.array_equal(a.dense(), want) and (b.dense()[2:4] == 7).all()
    assert np.array_equal(ArrayFrame.open(spark, at).dense(), b.dense())
    for encoding, separator in (("default", "/"), ("default", "."), ("v2", "."), ("v2", "/")):
        out = f"file://{tmp_path}/z-{encoding}-{ord(separator)}"
        c = made(spark, want, (3, 2), encoding=encoding, separator=separator)
        StoredArray.create(c, out)
        opened = StoredArray.open(spark, out)
        assert opened.meta == c.meta and np.array_equal(opened.frame().dense(), want)
    assert np.array_equal(StoredArray.open(spark, f"file://{tmp_path}", "z-v2-46").frame([slice_(2, 5)]).dense([slice_(3, 5)]), want[3:5])


def values_of(df, shape):
    out = np.zeros(shape, np.int64)
    for r in df.collect():
        out[tuple(r[:-1])] = r.value
    return out


def test_a_directory_is_read_and_written_by_planned_keys(spark, tmp_path):
    want = np.arange(48, dtype=np.int32).reshape(8, 6)
    a = StoredArray.create(made(spark, want, (2, 3)), f"file://{tmp_path}/d", "some/array")
    at = tmp_path / "d" / "some" / "array"
    # Keys that the plan doesn't name may hold anything.
    for key in ("c/3/0", "c/3/1", "c/0/1"):
        (at / key).write_bytes(b"not a chunk")
    (at / "c/1/0").unlink()
    got = values_of(a.read([slice_(1, 6), slice_(0, 3)]), (5, 3))
    want[2:4, :3] = 0
    assert np.array_equal(got, want[1:6, :3])
    stamps = {f: f.stat().st_mtime_ns for f in at.glob("c/*/*")}
    # A part of one chunk, the whole of another (unreadable before), a missing one.
    assert a.write([slice_(4, 5), slice_(0, 2)], -5) == 1
    assert a.write([slice_(6, 8), slice_(0, 3)], 9) == 1
    assert a.write([2], cells(spark, np.array([7]), "o").withColumn("o0", F.col("o0") + 1)) == 1
    want[4, :2], want[6:, :3], want[2, 1] = -5, 9, 7
    assert np.array_equal(values_of(a.read([None, slice_(0, 3)]), (8, 3)), want[:, :3])
    changed = {str(f.relative_to(at)) for f in at.glob("c/*/*") if stamps.get(f) != f.stat().st_mtime_ns}
    assert changed == {"c/2/0", "c/3/0", "c/1/0"}


def test_one_cell_stores_one_chunk(spark):
    a = ArrayFrame.empty(spark, ArrayMeta((100, 100), (2, 10), "int32", fill=-1))
    b = a.write(None, spark.createDataFrame([(51, 7, 3)], "o0 long, o1 long, value long"))
    assert b.chunks.count() == 1 and b.scalar([51, 7]) == 3 and b.scalar([51, 8]) == -1
    with pytest.raises(Exception, match="outside the array"):
        ArrayFrame.from_cells(spark.createDataFrame([(100, 7, 3)], "i0 long, i1 long, value long"), a.meta).chunks.count()


def test_held_chunks_are_neither_fetched_nor_decoded_again(spark, tmp_path):
    want = np.arange(24, dtype=np.int32).reshape(6, 4)
    a = StoredArray.create(made(spark, want, (2, 2), codecs=(*PLAIN, {"name": "gzip"}), fill=8), f"file://{tmp_path}/d")
    (tmp_path / "d" / "c/1/0").unlink()
    want[2:4, :2] = 8
    held = a.cache([slice_(0, 4)])
    assert np.array_equal(values_of(held.read([slice_(0, 4)]), (4, 4)), want[:4])
    assert [r.cache_key.partition(":")[2] for r in held.held.chunks.orderBy("key").collect()] == ["/:c/0/0", "/:c/0/1", "/:c/1/0", "/:c/1/1"]
    for f in (tmp_path / "d").glob("c/[01]/*"):
        f.write_bytes(b"broken")
    assert np.array_equal(values_of(held.read([slice_(1, 4, 2)]), (2, 4)), want[1:4:2])
    assert np.array_equal(values_of(held.read([slice_(4, 6)]), (2, 4)), want[4:])  # goes past what is held
    with pytest.raises(Exception):
        held.unpersist().read([0]).collect()
    frame = made(spark, want, (2, 2)).cache()
    assert np.array_equal(frame.dense(), want) and frame.unpersist().held is None


def test_arrays_on_a_web_server(spark, tmp_path):
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    want = np.arange(12, dtype=np.int32).reshape(4, 3)
    StoredArray.create(made(spark, want, (2, 2)), f"file://{tmp_path}/w", "a")
    (tmp_path / "w" / "a" / "c/1/1").unlink()
    want[2:, 2:] = 0

    class Handler(SimpleHTTPRequestHandler):
        def do_GET(self):
            if self.headers.get("X-Key") != "right":
                return self.send_error(500)
            return super().do_GET()

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Handler, directory=str(tmp_path / "w")))
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}"
        a = StoredArray.open(spark, address, "a", headers={"X-Key": "right"})
        assert np.array_equal(values_of(a.read(), (4, 3)), want)
        with pytest.raises(Exception, match="500"):
            a.read(headers={"X-Key": "wrong"}).collect()
        with pytest.raises(Exception, match="can't be written"):
            a.write([0], 1)
    finally:
        server.shutdown()


def test_wrong_chunk_shape_is_found_at_open(spark, tmp_path):
    for spec in (PLAIN, (*PLAIN, {"name": "gzip"}), (*PLAIN, {"name": "zstd"}), (*PLAIN, {"name": "blosc", "configuration": {"typesize": 4}})):
        for shape, real, wrong in (((12, 8), (4, 3), (3, 3)), ((6, 6), (3, 6), (3, 3))):
            want = np.arange(1, 1 + math.prod(shape), dtype=np.int32).reshape(shape)
            a, out = made(spark, want, real, codecs=spec), f"file://{tmp_path}/{len(spec)}{spec[-1]['name']}{shape[0]}"
            stored = StoredArray.create(a, out)
            stored.place.put("zarr.json", a.meta.with_chunks(wrong).to_v3().encode())
            opened = StoredArray.open(spark, out, probe=True)
            assert opened.meta.chunks == real and np.array_equal(opened.frame().dense(), want)


def test_persist(spark):
    a = made(spark, np.arange(20), (4,), "int32").persist()
    assert a.dense().tolist() == a.dense().tolist() and a.chunks.is_cached
    assert not a.unpersist().chunks.is_cached


def test_stream_of_cells(spark, tmp_path):
    from gridloom.streaming import write_stream

    at, source = f"file://{tmp_path}/array", f"file://{tmp_path}/in"
    ArrayFrame.empty(spark, ArrayMeta((4, 6), (3, 4), "int32", fill=-1)).save(at)
    for k in range(2):
        spark.createDataFrame([(k, j, 10 * k + j) for j in range(3)], "i0 long, i1 long, value long").write.mode("append").parquet(source)
    stream = spark.readStream.schema("i0 long, i1 long, value long").option("maxFilesPerTrigger", 1).parquet(source)
    write_stream(stream, at, f"file://{tmp_path}/checkpoint").awaitTermination(120)
    got = ArrayFrame.open(spark, at).dense()
    assert got[0, :3].tolist() == [0, 1, 2] and got[1, :3].tolist() == [10, 11, 12] and (got[2:] == -1).all()


def test_stream_into_a_directory_puts_only_its_chunks(spark, tmp_path):
    from gridloom.streaming import write_stream

    at, source = f"file://{tmp_path}/array", f"file://{tmp_path}/in"
    StoredArray.create(ArrayFrame.empty(spark, ArrayMeta((400, 6), (3, 4), "int32", fill=-1)), at)
    spark.createDataFrame([(3, 1, 5), (300, 5, 6)], "i0 long, i1 long, value long").write.parquet(source)
    write_stream(spark.readStream.schema("i0 long, i1 long, value long").parquet(source), at, f"file://{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted(str(f.relative_to(tmp_path / "array")) for f in (tmp_path / "array" / "c").glob("*/*") if not f.name.startswith(".")) == ["c/1/0", "c/100/1"]
    a = StoredArray.open(spark, at)
    assert [r.value for r in a.read([slice_(3, 4)]).orderBy("o1").collect()] == [-1, 5, -1, -1, -1, -1]
