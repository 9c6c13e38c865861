"""Registered queries of the array engine, with the SQL that gives the same rows from the tables.

Every read and write goes through chunks and codecs: tables are viewed as
arrays, encoded into chunks, selected, and only then compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, dtypes, layout
from .operators.array import ArrayFrame, StoredArray
from .operators.execution import speedups, timing_stats
from .plans import inference, selection
from .plans.selection import slice_
from .sources.metadata import PLAIN, ArrayMeta
from .sources.store import shared_dir, synthetic

ZSTD = (*PLAIN, {"name": "zstd", "configuration": {"level": 1}})
GZIP = (*PLAIN, {"name": "gzip", "configuration": {"level": 1}})
BIG = ({"name": "bytes", "configuration": {"endian": "big"}},)
TURNED = ({"name": "transpose", "configuration": {"order": [1, 0]}}, *ZSTD)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _length(df: DataFrame, column: str) -> int:
    """Length of a dimension whose coordinates are a table's dense keys."""
    return df.agg(F.max(column)).first()[0] + 1


def emb(spark: SparkSession, d: str, chunks: Sequence[int] = (100, 16), spec: Sequence[dict] = ZSTD, dtype: str = "float32") -> ArrayFrame:
    t = _table(spark, d, "embeddings")
    cells = t.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value"))
    return ArrayFrame.from_cells(cells, ArrayMeta((_length(t, "vec_id"), 64), chunks, dtype, spec), complete=True)


def price1(spark: SparkSession, d: str, chunk: int = 1000, spec: Sequence[dict] = ZSTD) -> ArrayFrame:
    t = _table(spark, d, "orders")
    return ArrayFrame.from_cells(t.select(F.col("o_orderkey").alias("i0"), F.col("o_totalprice").alias("value")), ArrayMeta((_length(t, "o_orderkey"),), (chunk,), "float64", spec), complete=True)


def price3(spark: SparkSession, d: str, chunks: Sequence[int] = (7, 4, 3)) -> ArrayFrame:
    t, k = _table(spark, d, "orders"), F.col("o_orderkey")
    cells = t.select(F.floor(k / 100).alias("i0"), F.pmod(F.floor(k / 10), F.lit(10)).alias("i1"), F.pmod(k, F.lit(10)).alias("i2"), F.col("o_totalprice").alias("value"))
    return ArrayFrame.from_cells(cells, ArrayMeta((_length(t, "o_orderkey") // 100, 10, 10), chunks, "float64", ZSTD), complete=True)


def label(spark: SparkSession, d: str, chunk: int = 64) -> ArrayFrame:
    n = _length(_table(spark, d, "documents"), "doc_id")
    t = _table(spark, d, "labels")
    return ArrayFrame.from_cells(t.select(F.col("doc_id").alias("i0"), F.col("quality").alias("value")), ArrayMeta((n,), (chunk,), "int32", ZSTD, fill=-1))


ALL1 = "select o_orderkey as o0, o_totalprice as value from orders"
CELLS = "(select vec_id as i, unnest(range(64)) as j, unnest(embedding) as value from embeddings)"


@query(ALL1)
def read_full_1d(spark, d):
    return price1(spark, d).read()


@query("select o_orderkey - 10 as o0, o_totalprice as value from orders where o_orderkey >= 10 and o_orderkey < 777")
def read_slice_1d(spark, d):
    return price1(spark, d).read([slice_(10, 777)])


@query("select (o_orderkey - 3) // 7 as o0, o_totalprice as value from orders where o_orderkey >= 3 and (o_orderkey - 3) % 7 = 0")
def read_stride_1d(spark, d):
    return price1(spark, d).read([slice_(3, None, 7)])


@query("select (o_orderkey - 5) // 333 as o0, o_totalprice as value from orders where o_orderkey >= 5 and (o_orderkey - 5) % 333 = 0")
def read_stride_beyond_chunk(spark, d):
    return price1(spark, d, 100).read([slice_(5, None, 333)])


@query("select o_orderkey - ((select max(o_orderkey) + 1 from orders) - 50) as o0, o_totalprice as value from orders where o_orderkey >= (select max(o_orderkey) + 1 from orders) - 50")
def read_negative_slice(spark, d):
    return price1(spark, d).read([slice_(-50, None)])


@query(f"select i as o0, value from {CELLS} where j = 5")
def read_2d_int_col(spark, d):
    return emb(spark, d).read([None, 5])


@query(f"select j as o0, value from {CELLS} where i = 7")
def read_2d_int_row(spark, d):
    return emb(spark, d).read([7])


@query(f"select (i - 10) // 3 as o0, (j - 2) // 5 as o1, value from {CELLS} where i >= 10 and i < 200 and (i - 10) % 3 = 0 and j >= 2 and (j - 2) % 5 = 0")
def read_2d_block_stride(spark, d):
    return emb(spark, d).read([slice_(10, 200, 3), slice_(2, None, 5)])


PRICE3 = "(select o_orderkey // 100 as a, (o_orderkey // 10) % 10 as b, o_orderkey % 10 as c, o_totalprice as value, (select (max(o_orderkey) + 1) // 100 from orders) as n from orders)"


@query(f"select (a - 3) // 5 as o0, c // 2 as o1, value from {PRICE3} where a >= 3 and a < n - 2 and (a - 3) % 5 = 0 and b = 1 and c % 2 = 0")
def read_3d_mixed(spark, d):
    return price3(spark, d).read([slice_(3, -2, 5), 1, slice_(None, None, 2)])


@query(f"select a - (n - 9) as o0, b - 6 as o1, c - 5 as o2, value from {PRICE3} where a >= n - 9 and b >= 6 and c >= 5")
def read_3d_edge(spark, d):
    return price3(spark, d).read([slice_(-9, None), slice_(6, None), slice_(5, None)])


@query(f"select value from {CELLS} where i = 33 and j = 63")
def read_scalar(spark, d):
    return emb(spark, d).read([33, -1])


@query("select o_orderkey as o0, o_totalprice as value from orders where false")
def read_empty(spark, d):
    return price1(spark, d).read([slice_(4, 4)])


@query("select doc_id as o0, coalesce(quality, -1)::int as value from documents left join labels using (doc_id)")
def read_fill_sparse(spark, d):
    return label(spark, d).read()


@query("select doc_id as o0, -1::int as value from documents where doc_id < 40")
def read_missing_chunks(spark, d):
    array = label(spark, d)
    return ArrayFrame(array.meta, array.chunks.where("c0 > 5")).read([slice_(40)])


def _grid(spark, encoding=None):
    meta = ArrayMeta((23, 9, 10), (5, 4, 3), "uint8", encoding=encoding or "default")
    return meta, selection.chunk_plan(spark, meta, selection.normalized(None, meta.shape))


GRID = "(select a.range as c0, b.range as c1, c.range as c2 from range(5) a, range(3) b, range(4) c)"


@query(f"select * from {GRID}")
def chunk_grid(spark, d):
    return _grid(spark)[1].select("c0", "c1", "c2")


@query(f"select 'c/' || c0 || '/' || c1 || '/' || c2 as key from {GRID}")
def chunk_keys_default(spark, d):
    return _grid(spark)[1].select("key")


@query(f"select c0 || '.' || c1 || '.' || c2 as key from {GRID}")
def chunk_keys_v2(spark, d):
    return _grid(spark, "v2")[1].select("key")


@query(f"select c0, c1, c2, least(5, 23 - 5 * c0) as e0, least(4, 9 - 4 * c1) as e1, least(3, 10 - 3 * c2) as e2 from {GRID}")
def edge_shapes(spark, d):
    return _grid(spark)[1].drop("key")


@query("select distinct (10 + 7 * range) // 3 as c0 from range(80) union select distinct (10 + 7 * range) // 3 from range(80)")
def chunk_plan_pruned(spark, d):
    meta = ArrayMeta((2000,), (3,), "uint8")
    return selection.chunk_plan(spark, meta, selection.normalized([slice_(10, 570, 7)], meta.shape)).select("c0")


@query("select * from (values ('C', 12, 4, 1), ('F', 1, 2, 6), ('102', 4, 8, 1)) t(ordering, s0, s1, s2)")
def strides_c_f(spark, d):
    rows = [(n, *layout.strides((2, 3, 4), o)) for n, o in (("C", "C"), ("F", "F"), ("102", (1, 0, 2)))]
    return spark.createDataFrame(rows, "ordering string, s0 int, s1 int, s2 int")


@query(ALL1)
def codec_gzip_roundtrip(spark, d):
    return price1(spark, d, 777, GZIP).read()


@query(ALL1)
def codec_zstd_roundtrip(spark, d):
    return price1(spark, d, 4096, ZSTD).read()


@query(ALL1)
def codec_bytes_big_endian(spark, d):
    return price1(spark, d, 500, BIG).read()


def _also(name: str):
    def run(spark, d):
        return price1(spark, d, 900, (*PLAIN, {"name": name})).read()

    run.__name__ = f"codec_{name}_roundtrip"
    return query(ALL1)(run)


for _name in ("blosc", "zlib", "bz2", "lzma", "lz4", "snappy"):
    _also(_name)


@query(f"select i as o0, j as o1, value from {CELLS}")
def transpose_f_order(spark, d):
    return emb(spark, d, (90, 20), TURNED).read()


@query(f"select i as o0, j as o1, case when i = 3 then 42::float else value end as value from {CELLS}")
def write_scalar_row(spark, d):
    return emb(spark, d).write([3], 42).read()


@query(f"select i as o0, j as o1, case when i >= 1 and i < 300 and (i - 1) % 4 = 0 and j % 3 = 2 then -1.5::float else value end as value from {CELLS}")
def write_scalar_strided(spark, d):
    return emb(spark, d).write([slice_(1, 300, 4), slice_(2, None, 3)], -1.5).read()


@query("select o_orderkey as o0, case when o_orderkey between 100 and 499 then o_custkey * 2.0 else o_totalprice end as value from orders")
def write_block(spark, d):
    new = _table(spark, d, "orders").where("o_orderkey between 100 and 499").select((F.col("o_orderkey") - 100).alias("o0"), (F.col("o_custkey") * 2.0).alias("value"))
    return price1(spark, d, 64).write([slice_(100, 500)], new).read()


@query("select o_orderkey - 90 as o0, case when o_orderkey >= 95 and o_orderkey < 140 then 7.0 else o_totalprice end as value from orders where o_orderkey between 90 and 149")
def write_partial_then_read(spark, d):
    return price1(spark, d, 50).write([slice_(95, 140)], 7).read([slice_(90, 150)])


@query("select doc_id as o0, case when doc_id between 10 and 19 then 5 when doc_id < 64 then -1 else coalesce(quality, -1) end::int as value from documents left join labels using (doc_id)")
def write_into_missing_chunk(spark, d):
    array = label(spark, d)
    return ArrayFrame(array.meta, array.chunks.where("c0 > 0")).write([slice_(10, 20)], 5).read()


@query(f"select i as o0, j as o1, case when i >= 100 and i < 200 then 0.25::float else value end as value from {CELLS}")
def write_total_chunk(spark, d):
    return emb(spark, d).write([slice_(100, 200)], 0.25).read()


@query("select o_orderkey as o0, (((o_custkey * 3 - 500) % 256 + 256) % 256)::smallint as value from orders")
def wraparound_u8(spark, d):
    t = _table(spark, d, "orders")
    cells = t.select(F.col("o_orderkey").alias("i0"), (F.col("o_custkey") * 3 - 500).alias("value"))
    return ArrayFrame.from_cells(cells, ArrayMeta((_length(t, "o_orderkey"),), (512,), "uint8", ZSTD)).read()


@query("select event_id as o0, value from events where event_id % 11 = 0 and event_id < 0 union all select event_id // 11, value from events where event_id % 11 = 0")
def read_events_stride(spark, d):
    t = _table(spark, d, "events")
    cells = t.select(F.col("event_id").alias("i0"), "value")
    return ArrayFrame.from_cells(cells, ArrayMeta((_length(t, "event_id"),), (600,), "float64", ZSTD)).read([slice_(0, None, 11)])


@query("select range // 400 as o0, (range // 20) % 20 as o1, range % 20 as o2, (range * 0.5)::float as value from range(8000)")
def synthetic_array(spark, d):
    meta = ArrayMeta((20, 20, 20), (8, 8, 8), "float32", ZSTD)
    return ArrayFrame.from_cells(synthetic(spark, meta), meta).read()


@query("select range // 400 as o0, (range // 20) % 20 as o1, range % 20 as o2, (range % 65536)::int as value from range(12000)")
def generated_array(spark, d):
    meta = ArrayMeta((30, 20, 20), (8, 9, 7), "uint16", ZSTD)
    return ArrayFrame.generate(spark, meta, lambda at: at % 65536).read()


GOLDEN = [(397312, (96, 96, 96), (386, 256, 256)), (794624, (96, 96, 96), (773, 512, 512)), (1589248, (96, 96, 96), (1546, 1024, 1024)), (921600, (96, 96, 96), (400, 384, 384)), (8192, (64, 64), (256, 512)), (16384, (64, 64), (512, 512)), (12, (3, 3), (12, 8)), (8192, (64, 64), (10, 512)), (7, (96, 96, 96), (386, 256, 256))]


@query("select * from (values (397312, 14, '97,64,64', 80), (794624, 17, '97,64,128', 80), (1589248, 21, '97,128,128', 80), (921600, 21, '100,96,96', 34), (8192, 2, '64,128', 64), (16384, 2, '64,256', 192), (12, 2, '3,4', 11), (8192, 1, '64,128', 1069), (7, 0, '', 0)) t(elements, found, best, points)")
def infer_shape_candidates(spark, d):
    rows = []
    for n, declared, array in GOLDEN:
        c = inference.candidates(n, declared, array)
        rows.append((n, len(c), ",".join(map(str, c[0])) if c else "", inference.score(c[0], declared, array) if c else 0))
    return spark.createDataFrame(rows, "elements int, found int, best string, points int")


@query("select * from (values ('one', 200), ('two', 556), ('four', 100000), ('none', null), ('magic', null), ('short', null)) t(name, bytes)")
def zstd_header_size(spark, d):
    magic = b"\x28\xb5\x2f\xfd"
    frames = {"one": magic + bytes([0x20, 200]), "two": magic + bytes([0x60]) + (300).to_bytes(2, "little"), "four": magic + bytes([0xA0]) + (100000).to_bytes(4, "little"), "none": magic + bytes([0, 0, 0]), "magic": b"\0" * 12, "short": magic}
    return spark.createDataFrame([(k, codecs.zstd_content_size(v)) for k, v in frames.items()], "name string, bytes int")


@query("select * from (values ('fine', 4096), ('version', null), ('typesize', null), ('short', null), ('packed', null)) t(name, bytes)")
def blosc_header_size(spark, d):
    make = lambda version=2, width=4, whole=4096, packed=16: bytes([version, 1, 0, width]) + whole.to_bytes(4, "little") + bytes(4) + packed.to_bytes(4, "little")
    headers = {"fine": make(), "version": make(version=3), "typesize": make(width=9), "short": make()[:15], "packed": make(packed=33)}
    return spark.createDataFrame([(k, codecs.blosc_content_size(v)) for k, v in headers.items()], "name string, bytes int")


@query("select '4,3' as shape")
def validate_shape_probe(spark, d):
    array = ArrayFrame.from_cells(spark.range(96).select(F.floor(F.col("id") / 8).alias("i0"), F.pmod("id", F.lit(8)).alias("i1"), (F.col("id") + 1).alias("value")), ArrayMeta((12, 8), (4, 3), "int32"))
    held = {r.key: bytes(r.payload) for r in array.chunks.select("key", "payload").collect()}
    shape = inference.probed(array.meta.with_chunks((3, 3)), lambda: held["c/0/0"], held.__contains__)
    return spark.createDataFrame([(",".join(map(str, shape)),)], "shape string")


@query(f"select i as o0, value from {CELLS} where j = 9")
def cached_reread(spark, d):
    array = emb(spark, d).cache([None, slice_(0, 16)])
    array.read([0, 0]).count()
    return array.read([None, 9])


def _directory(array: ArrayFrame) -> StoredArray:
    """The array's chunks as files in the shared folder."""
    spark = array.chunks.sparkSession
    return StoredArray.create(array, f"{shared_dir(spark)}/directory-{uuid.uuid4().hex}", "array")


@query(f"select (i - 10) // 3 as o0, j - 20 as o1, value from {CELLS} where i >= 10 and i < 90 and (i - 10) % 3 = 0 and j >= 20 and j < 30")
def directory_read(spark, d):
    return _directory(emb(spark, d)).read([slice_(10, 90, 3), slice_(20, 30)])


@query("select doc_id - 100 as o0, coalesce(quality, -1)::int as value from documents left join labels using (doc_id) where doc_id >= 100 and doc_id < 192")
def directory_read_fill(spark, d):
    array = label(spark, d)
    return _directory(array).read([slice_(100, 192)])


@query(f"select i as o0, j as o1, case when i >= 5 and i < 150 and j = 7 then -2.5::float else value end as value from {CELLS}")
def directory_write_scalar(spark, d):
    array = _directory(emb(spark, d))
    array.write([slice_(5, 150), 7], -2.5)
    return array.read()


@query("select o_orderkey as o0, case when o_orderkey between 100 and 499 then o_custkey * 2.0 else o_totalprice end as value from orders")
def directory_write_block(spark, d):
    array = _directory(price1(spark, d, 64))
    array.write([slice_(100, 500)], _table(spark, d, "orders").where("o_orderkey between 100 and 499").select((F.col("o_orderkey") - 100).alias("o0"), (F.col("o_custkey") * 2.0).alias("value")))
    return array.read()


@query(f"select i as o0, value from {CELLS} where j = 9 and i < 50")
def directory_cached(spark, d):
    array = _directory(emb(spark, d)).cache([slice_(0, 100)])
    array.read([0, 0]).count()
    return array.read([slice_(0, 50), 9])


@query("select '4,3' as shape, 96::bigint as cells, 4656::bigint as total")
def directory_shape_probe(spark, d):
    meta = ArrayMeta((12, 8), (4, 3), "int32", (*PLAIN, {"name": "blosc", "configuration": {"typesize": 4}}))
    array = _directory(ArrayFrame.generate(spark, meta, lambda at: at + 1))
    array.place.put("zarr.json", meta.with_chunks((3, 3)).to_v3().encode())
    found = StoredArray.open(spark, array.place.store, array.place.path, probe=True)
    return found.read().agg(F.count("*").alias("cells"), F.sum("value").alias("total")).select(F.lit(",".join(map(str, found.meta.chunks))).alias("shape"), "cells", "total")


@query("select o_orderkey as o0, case when o_orderkey = 777 then 1.5 else 0 end as value from orders where o_orderkey between 700 and 800")
def write_sparse_cell(spark, d):
    array = ArrayFrame.empty(spark, ArrayMeta((_length(_table(spark, d, "orders"), "o_orderkey"),), (10,), "float64", ZSTD))
    one = array.write(None, spark.range(777, 778).select(F.col("id").alias("o0"), F.lit(1.5).alias("value")))
    return one.read([slice_(700, 801)]).withColumn("o0", F.col("o0") + 700)


TIMES = "(select user_id % 3 as operation, case when user_id % 2 = 0 then 'plain' else 'pooled' end as variant, value as ms from events)"


@query(f"select operation, variant, round(avg(ms), 6) as mean, round(quantile_cont(ms, 0.5), 6) as median, min(ms) as min, max(ms) as max, round(stddev_pop(ms), 6) as stddev from {TIMES} group by all")
def timing_statistics(spark, d):
    return timing_stats(_times(spark, d), "operation", "variant").select("operation", "variant", *[F.round(c, 6).alias(c) if c not in ("min", "max") else F.col(c) for c in ("mean", "median", "min", "max", "stddev")])


def _times(spark, d):
    return _table(spark, d, "events").select(F.pmod("user_id", F.lit(3)).alias("operation"), F.when(F.pmod("user_id", F.lit(2)) == 0, "plain").otherwise("pooled").alias("variant"), F.col("value").alias("ms"))


@query(f"with s as (select operation, variant, quantile_cont(ms, 0.5) as m from {TIMES} group by all) select s.operation, s.variant, round(b.m / s.m, 6) as speedup from s join s b on s.operation = b.operation and b.variant = 'plain'")
def speedup(spark, d):
    return speedups(timing_stats(_times(spark, d), "operation", "variant"), "plain").select("operation", "variant", F.round("speedup", 6).alias("speedup"))


@query("select o_orderkey as i, (((o_custkey - 300) % 256 + 384) % 256 - 128)::tinyint as b, ((o_totalprice::bigint % 65536 + 65536) % 65536)::int as w from (select o_orderkey, o_custkey, trunc(o_totalprice) as o_totalprice from orders)")
def coercion(spark, d):
    t = _table(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("i"), dtypes.wrapped(F.col("o_custkey") - 300, "int8").alias("b"), dtypes.wrapped(F.col("o_totalprice"), "uint16").alias("w"))
