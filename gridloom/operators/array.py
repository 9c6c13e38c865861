"""Arrays as chunk tables: building, reading, writing, caching."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import Pipeline
from ..functions.dtypes import arrow_values, coerced, numpy_type, numpy_values, spark_type, wrapped
from ..functions.layout import chunk_columns, chunk_key, chunk_key_column, edge_columns, offset_column, size, strides
from ..plans.inference import probed
from ..plans.selection import Dim, chunk_filter, chunk_plan, is_total, normalized, result_shape
from ..sources import store
from ..sources.keys import Location, cache_key, store_of
from ..sources.metadata import ArrayMeta, read_metadata

#: Cells of a chunk that become rows of one Arrow batch.
CELLS = 1 << 20


def _coords(rank: int) -> list[str]:
    return [f"c{i}" for i in range(rank)]


@dataclass(frozen=True)
class Held:
    """Decoded chunks, missing ones as fill values, of a range of chunks: cache_key, c0..., key, e0..., payload."""

    ranges: tuple[tuple[int, int], ...]
    chunks: DataFrame

    def covers(self, dims: Sequence[Dim], chunks: Sequence[int]) -> bool:
        return all(not d.count or low <= d.start // c and (d.stop - 1) // c <= high for d, c, (low, high) in zip(dims, chunks, self.ranges, strict=True))


def _hold(meta: ArrayMeta, dims: Sequence[Dim], rows: Callable[[Sequence[Dim]], DataFrame], name: str, get: Callable[[str], bytes | None] | None, level: StorageLevel) -> Held:
    """Decodes the chunks between a selection's first and last once, when they are first read, and keeps them."""
    whole = [Dim(d.start, 1, d.stop - d.start, True) for d in dims]
    schema = f"cache_key string, {''.join(f'c{i} long, ' for i in range(meta.rank))}key string, {''.join(f'e{i} long, ' for i in range(meta.rank))}payload binary"
    found = rows(whole).mapInArrow(_decoder(meta, name, get), schema).persist(level)
    return Held(tuple((d.start // c, (d.stop - 1) // c) if d.count else (0, -1) for d, c in zip(dims, meta.chunks, strict=True)), found)


def _out_schema(meta: ArrayMeta, kept: Sequence[int]) -> str:
    return "".join(f"o{j} long, " for j in range(len(kept))) + f"value {spark_type(meta.dtype)}"


@dataclass(frozen=True)
class ArrayFrame:
    """An array: its metadata and a table of encoded chunks (c0..., key, payload).

    A chunk that is missing holds the fill value. complete says that none is
    missing, which saves looking for them. held are decoded chunks of a range.
    """

    meta: ArrayMeta
    chunks: DataFrame
    complete: bool = False
    held: Held | None = None

    # Building

    @staticmethod
    def empty(spark: SparkSession, meta: ArrayMeta) -> ArrayFrame:
        head = "".join(f"c{i} long, " for i in range(meta.rank))
        return ArrayFrame(meta, spark.createDataFrame([], f"{head}key string, payload binary"))

    @staticmethod
    def from_cells(cells: DataFrame, meta: ArrayMeta, complete: bool = False) -> ArrayFrame:
        """From cells i0..., value; one shuffle brings a chunk's cells together.

        Of cells that repeat a place the highest value stays. complete is the
        caller's word that every chunk has a cell.
        """
        return ArrayFrame(meta, _encoded(meta, _gathered(meta, cells)), complete)

    @staticmethod
    def generate(spark: SparkSession, meta: ArrayMeta, values: Callable[[np.ndarray], np.ndarray]) -> ArrayFrame:
        """From a function of the places in C order (an array of 64-bit integers); chunks are made where they are encoded, without a shuffle."""
        plan = chunk_plan(spark, meta, normalized(None, meta.shape))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pipeline = Pipeline(meta.dtype, meta.chunks, meta.codecs)
            for batch in batches:
                for row, (coords, edge, _) in enumerate(_rows_of(batch, meta.rank)):
                    at = np.zeros(edge, np.int64)
                    for axis, (k, c, e, step) in enumerate(zip(coords, meta.chunks, edge, strides(meta.shape), strict=True)):
                        at = at + ((k * c + np.arange(e)) * step).reshape([-1 if i == axis else 1 for i in range(meta.rank)])
                    chunk = np.full(meta.chunks, meta.fill_scalar())
                    chunk[tuple(slice(0, e) for e in edge)] = coerced(values(at), meta.dtype)
                    part = batch.slice(row, 1)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in _coords(meta.rank)], part.column("key"), pa.array([pipeline.encode(chunk)], pa.binary())], names=[*_coords(meta.rank), "key", "payload"])

        return ArrayFrame(meta, plan.withColumn("payload", F.lit(None).cast("binary")).mapInArrow(run, _chunk_schema(meta)), True)

    @staticmethod
    def open(spark: SparkSession, path: str) -> ArrayFrame:
        return ArrayFrame(*store.load(spark, path))

    # Reading

    def shape_of(self, selection=None) -> list[int]:
        return result_shape(normalized(selection, self.meta.shape))

    def read(self, selection=None) -> DataFrame:
        """The selected cells: o0... for the dimensions that stay, value.

        Chunks are decoded where they are scanned, after pruning the table by
        the range of the selection, and their selected cells are cut out in
        numpy before any row is made; payloads are never shuffled. Chunks that
        hold a selected cell but are missing come from the plan by an anti join
        on keys alone.
        """
        meta, dims = self.meta, normalized(selection, self.meta.shape)
        kept = [i for i, d in enumerate(dims) if d.keep]
        if self.held and self.held.covers(dims, meta.chunks):
            return self.held.chunks.where(chunk_filter(dims, meta.chunks)).mapInArrow(_reader(meta, dims, kept, decoded=True), _out_schema(meta, kept))
        return self._rows(dims).mapInArrow(_reader(meta, dims, kept), _out_schema(meta, kept))

    def _rows(self, dims: Sequence[Dim]) -> DataFrame:
        """The chunks that hold a selected cell, the missing ones without a payload."""
        found = self.chunks.where(chunk_filter(dims, self.meta.chunks))
        rows = _with_edges(self.meta, found)
        if self.complete:
            return rows
        plan = chunk_plan(self.chunks.sparkSession, self.meta, dims)
        missing = plan.join(found.select("key"), "key", "left_anti").withColumn("payload", F.lit(None).cast("binary"))
        return rows.unionByName(missing.select(rows.columns))

    def scalar(self, selection):
        """The one value of a selection of whole numbers."""
        if self.shape_of(selection):
            raise ValueError("the selection leaves dimensions; use read()")
        return self.read(selection).first().value

    def dense(self, selection=None, limit: int = 1 << 24) -> np.ndarray:
        """A result of at most limit cells as one array in the driver."""
        shape = self.shape_of(selection)
        if size(shape) > limit:
            raise ValueError(f"{size(shape)} cells are more than {limit}")
        table = self.read(selection).toArrow()
        out = np.zeros(size(shape), numpy_type(self.meta.dtype))
        at = sum((table.column(f"o{j}").to_numpy() * s for j, s in enumerate(strides(shape))), np.zeros(table.num_rows, np.int64))
        out[at] = numpy_values(table.column("value").combine_chunks(), self.meta.dtype)
        return out.reshape(shape)

    # Writing

    def write(self, selection, value) -> ArrayFrame:
        """A new array with a number, or a table of cells o0..., value, in the selected places.

        A number changes all chunks that hold a selected cell, a table those
        that it has cells for. Chunks that are covered whole are made anew
        without reading the old ones; others are read, changed and encoded. The
        rest keep their bytes. The chunks in the selection's range are written
        to the shared folder at once, the others are only filtered, so a row of
        writes neither recomputes nor copies the whole array.
        """
        meta, dims = self.meta, normalized(selection, self.meta.shape)
        near = chunk_filter(dims, meta.chunks)
        far, touched = self.chunks.where(~near), self.chunks.where(near)
        if isinstance(value, DataFrame):
            cells = _selected(meta, dims, value)
            made = cells.join(touched.select("key", "payload"), "key", "left").mapInArrow(_writer(meta, dims, None), _chunk_schema(meta))
            new = store.staged(made)
            return ArrayFrame(meta, far.unionByName(touched.join(new.select("key"), "key", "left_anti").select(new.columns)).unionByName(new), self.complete)
        # A number changes chunks where they are scanned.
        made = self._rows(dims).mapInArrow(_writer(meta, dims, coerced([value], meta.dtype)[0]), _chunk_schema(meta))
        return ArrayFrame(meta, far.unionByName(store.staged(made)), self.complete)

    def save(self, path: str) -> ArrayFrame:
        """Stores the array as a new version at path, which may be where it was read from, and opens it."""
        store.save(self.meta, self.chunks, path)
        return ArrayFrame.open(self.chunks.sparkSession, path)

    # Caching

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> ArrayFrame:
        """Keeps the encoded chunks."""
        self.chunks.persist(level)
        return self

    def cache(self, selection=None, name: str = "frame", level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> ArrayFrame:
        """Keeps decoded chunks, fill values too, of a selection's range; reads within it decode nothing, others go past it."""
        return replace(self, held=_hold(self.meta, normalized(selection, self.meta.shape), self._rows, name + ":/:", None, level))

    def unpersist(self) -> ArrayFrame:
        self.chunks.unpersist()
        if self.held:
            self.held.chunks.unpersist()
        return replace(self, held=None)


@dataclass(frozen=True)
class StoredArray:
    """An array in a key store. The keys come from the plan of a selection, so executors fetch and put only chunks that hold a selected cell."""

    spark: SparkSession
    meta: ArrayMeta
    place: Location
    held: Held | None = None

    @staticmethod
    def open(spark: SparkSession, address, path: str = "", declared: ArrayMeta | None = None, probe: bool = False, **options) -> StoredArray:
        """address names files or a web server, or is a store; options go with every request.

        With probe the declared chunk shape is checked once, here, by chunk 0
        and what lies beyond the grid.
        """
        place = Location(store_of(address) if isinstance(address, str) else address, path, options)
        meta = read_metadata(place.get, declared)
        if probe:

            def decode(data: bytes) -> bytes:
                for _, step in reversed(Pipeline(meta.dtype, meta.chunks, meta.codecs).packs):
                    data = step(data)
                return data

            zero = chunk_key([0] * meta.rank, meta.encoding, meta.separator)
            meta = meta.with_chunks(probed(meta, lambda: place.get(zero), place.exists, decode))
        return StoredArray(spark, meta, place)

    @staticmethod
    def create(array: ArrayFrame, address, path: str = "") -> StoredArray:
        """Stores an array, a key for each chunk that it has."""
        place = Location(store_of(address) if isinstance(address, str) else address, path)
        store.write_directory(array.meta, array.chunks, place)
        return StoredArray(array.chunks.sparkSession, array.meta, place)

    def _rows(self, dims: Sequence[Dim]) -> DataFrame:
        return chunk_plan(self.spark, self.meta, dims)

    def shape_of(self, selection=None) -> list[int]:
        return result_shape(normalized(selection, self.meta.shape))

    def read(self, selection=None, **options) -> DataFrame:
        """The selected cells: o0... for the dimensions that stay, value. A key that isn't there holds the fill value."""
        meta, dims = self.meta, normalized(selection, self.meta.shape)
        kept = [i for i, d in enumerate(dims) if d.keep]
        if self.held and self.held.covers(dims, meta.chunks):
            return self.held.chunks.where(chunk_filter(dims, meta.chunks)).mapInArrow(_reader(meta, dims, kept, decoded=True), _out_schema(meta, kept))
        place = replace(self.place, options={**self.place.options, **options})
        return self._rows(dims).mapInArrow(_reader(meta, dims, kept, place.get), _out_schema(meta, kept))

    def frame(self, selection=None) -> ArrayFrame:
        """The encoded chunks of a selection as a table."""
        meta, place = self.meta, self.place

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, key in enumerate(batch.column("key").to_pylist()):
                    data = place.get(key)
                    if data is not None:
                        row = batch.slice(i, 1)
                        yield pa.RecordBatch.from_arrays([*[row.column(c) for c in _coords(meta.rank)], row.column("key"), pa.array([data], pa.binary())], names=[*_coords(meta.rank), "key", "payload"])

        return ArrayFrame(meta, self._rows(normalized(selection, meta.shape)).mapInArrow(fetch, _chunk_schema(meta)))

    def write(self, selection, value) -> int:
        """Puts a number, or a table of cells o0..., value, in the selected places, and tells how many chunks it has put.

        Only chunks that change are put, by the executors, and only those that
        aren't covered whole are fetched before. A task that runs again puts
        the same bytes; two writes at once to the same chunk aren't ordered.
        """
        meta, dims, place = self.meta, normalized(selection, self.meta.shape), self.place
        if isinstance(value, DataFrame):
            rows, make = _selected(meta, dims, value), _writer(meta, dims, None, place.get)
        else:
            rows, make = self._rows(dims), _writer(meta, dims, coerced([value], meta.dtype)[0], place.get)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in make(batches):
                for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    place.put(key, payload)
                yield batch.select(["key"])

        return rows.mapInArrow(run, "key string").count()

    def cache(self, selection=None, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> StoredArray:
        """Keeps decoded chunks, fill values too, of a selection's range; reads within it fetch and decode nothing, others go past it."""
        return replace(self, held=_hold(self.meta, normalized(selection, self.meta.shape), self._rows, cache_key(self.place.store, self.place.path, ""), self.place.get, level))

    def unpersist(self) -> StoredArray:
        if self.held:
            self.held.chunks.unpersist()
        return replace(self, held=None)


def _chunk_schema(meta: ArrayMeta) -> str:
    return "".join(f"c{i} long, " for i in range(meta.rank)) + "key string, payload binary"


def _with_edges(meta: ArrayMeta, chunks: DataFrame) -> DataFrame:
    """The chunks with their shape within the array."""
    edges = edge_columns(meta.shape, meta.chunks, [F.col(c) for c in _coords(meta.rank)])
    return chunks.select(*_coords(meta.rank), "key", *[e.alias(f"e{i}") for i, e in enumerate(edges)], "payload")


def _selected(meta: ArrayMeta, dims: Sequence[Dim], value: DataFrame) -> DataFrame:
    """The cells o0..., value of a selection by chunk: c0..., key, e0..., offs, vals."""
    kept = [i for i, d in enumerate(dims) if d.keep]
    if sorted(c for c in value.columns if c != "value") != sorted(f"o{j}" for j in range(len(kept))):
        raise ValueError(f"cells for this selection have the columns {[f'o{j}' for j in range(len(kept))]} and value")
    where = {i: F.lit(d.start).cast("long") + F.col(f"o{kept.index(i)}") * d.step if d.keep else F.lit(d.start).cast("long") for i, d in enumerate(dims)}
    inside = [F.col(f"o{j}").between(0, dims[i].count - 1) for j, i in enumerate(kept)]
    checked = value.select(*[F.when(ok, F.col(f"o{j}")).otherwise(F.raise_error(F.lit(f"o{j} lies outside the selection"))).alias(f"o{j}") for j, ok in enumerate(inside)], "value")
    cells = _gathered(meta, checked.select(*[where[i].alias(f"i{i}") for i in range(meta.rank)], "value"))
    edges = edge_columns(meta.shape, meta.chunks, [F.col(c) for c in _coords(meta.rank)])
    return cells.select(*_coords(meta.rank), "key", *[e.alias(f"e{i}") for i, e in enumerate(edges)], "offs", "vals")


def _gathered(meta: ArrayMeta, cells: DataFrame) -> DataFrame:
    """c0..., key, offs, vals: a chunk's cells, at most as many as it has places; a cell outside the array is an error."""
    index = [F.when(F.col(f"i{i}").between(0, n - 1), F.col(f"i{i}").cast("long")).otherwise(F.raise_error(F.lit(f"i{i} lies outside the array"))) for i, n in enumerate(meta.shape)]
    coords = [c.alias(f"c{i}") for i, c in enumerate(chunk_columns(index, meta.chunks))]
    placed = cells.select(*coords, offset_column(index, meta.chunks).alias("off"), wrapped(F.col("value"), meta.dtype).alias("val"))
    # Dealt once by chunk, which serves both groupings.
    dealt = placed.repartition(*_coords(meta.rank)) if meta.rank else placed.coalesce(1)
    one = dealt.groupBy(*_coords(meta.rank), "off").agg(F.max("val").alias("val"))
    both = one.groupBy(*_coords(meta.rank)).agg(F.collect_list(F.struct("off", "val")).alias("x"))
    key = chunk_key_column([F.col(c) for c in _coords(meta.rank)], meta.encoding, meta.separator)
    return both.select(*_coords(meta.rank), key.alias("key"), F.col("x.off").alias("offs"), F.col("x.val").alias("vals"))


def _encoded(meta: ArrayMeta, gathered: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipeline = Pipeline(meta.dtype, meta.chunks, meta.codecs)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                chunk = np.full(size(meta.chunks), meta.fill_scalar())
                _overlay(chunk, batch, i, meta.dtype)
                out.append(pipeline.encode(chunk.reshape(meta.chunks)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _coords(meta.rank)], batch.column("key"), pa.array(out, pa.binary())], names=[*_coords(meta.rank), "key", "payload"])

    return gathered.mapInArrow(run, _chunk_schema(meta))


def _overlay(chunk: np.ndarray, batch: pa.RecordBatch, i: int, dtype: str) -> None:
    """Sets the cells of row i in a flat chunk."""
    chunk[batch.column("offs")[i].values.to_numpy()] = numpy_values(batch.column("vals")[i].values, dtype)


def _rows_of(batch: pa.RecordBatch, rank: int) -> Iterator[tuple[list[int], list[int], bytes | None]]:
    """Coordinates, edge and payload of each row; without a payload column its key."""
    names = [*_coords(rank), *[f"e{i}" for i in range(rank)], "payload" if "payload" in batch.schema.names else "key"]
    for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
        yield list(row[:rank]), list(row[rank : 2 * rank]), row[-1]


def _decoder(meta: ArrayMeta, name: str, get: Callable[[str], bytes | None] | None):
    """Payloads, or what get gives for keys, as the bytes of the decoded part within the array; name and key are the chunk's cache key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipeline = Pipeline(meta.dtype, meta.chunks, meta.codecs)
        same = [*_coords(meta.rank), "key", *[f"e{i}" for i in range(meta.rank)]]
        for batch in batches:
            for i, (_, edge, payload) in enumerate(_rows_of(batch, meta.rank)):
                payload = get(payload) if get else payload
                chunk = np.full(edge, meta.fill_scalar()) if payload is None else pipeline.decode(payload, edge)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([pa.array([name + row.column("key")[0].as_py()]), *[row.column(n) for n in same], pa.array([np.ascontiguousarray(chunk).tobytes()], pa.binary())], names=["cache_key", *same, "payload"])

    return run


def _reader(meta: ArrayMeta, dims: Sequence[Dim], kept: list[int], get: Callable[[str], bytes | None] | None = None, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipeline = Pipeline(meta.dtype, meta.chunks, meta.codecs)
        for batch in batches:
            for coords, edge, payload in _rows_of(batch, meta.rank):
                inside = [d.inside(k, c) for d, k, c in zip(dims, coords, meta.chunks, strict=True)]
                shape = [len(x) for x in inside]
                if not all(shape):
                    continue
                payload = get(payload) if get else payload
                if payload is None:
                    cut = np.full(shape, meta.fill_scalar())
                else:
                    local = [x - k * c for x, k, c in zip(inside, coords, meta.chunks, strict=True)]
                    chunk = np.frombuffer(payload, numpy_type(meta.dtype)).reshape(edge) if decoded else pipeline.decode(payload, edge)
                    cut = chunk[np.ix_(*local)] if local else chunk
                flat, first = np.asarray(cut).ravel(), [(x[0] - d.start) // d.step for x, d in zip(inside, dims, strict=True)]
                for at in range(0, len(flat), CELLS):
                    part = flat[at : at + CELLS]
                    places = np.unravel_index(np.arange(at, at + len(part)), shape) if shape else []
                    yield pa.RecordBatch.from_arrays([*[pa.array(places[i].astype(np.int64) + first[i]) for i in kept], arrow_values(part, meta.dtype)], names=[*[f"o{j}" for j in range(len(kept))], "value"])

    return run


def _writer(meta: ArrayMeta, dims: Sequence[Dim], scalar, get: Callable[[str], bytes | None] | None = None):
    """Chunks with a number, or with the rows' own cells, in them; what is covered whole needs no old payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipeline = Pipeline(meta.dtype, meta.chunks, meta.codecs)
        for batch in batches:
            for row, (coords, edge, payload) in enumerate(_rows_of(batch, meta.rank)):
                inside = [d.inside(k, c) for d, k, c in zip(dims, coords, meta.chunks, strict=True)]
                total = is_total(dims, coords, meta.chunks, meta.shape) if scalar is not None else len(batch.column("offs")[row].values) == size(edge)
                if get:
                    payload = None if total else get(payload)
                same = batch.slice(row, 1)
                if scalar is not None and payload is not None and not all(len(x) for x in inside):
                    out = payload
                else:
                    chunk = np.full(meta.chunks, meta.fill_scalar())
                    if payload is not None and not total:
                        chunk[tuple(slice(0, e) for e in edge)] = pipeline.decode(payload, edge)
                    if scalar is None:
                        flat = chunk.reshape(-1)
                        _overlay(flat, batch, row, meta.dtype)
                        chunk = flat.reshape(meta.chunks)
                    else:
                        local = [x - k * c for x, k, c in zip(inside, coords, meta.chunks, strict=True)]
                        chunk[np.ix_(*local) if local else ()] = scalar
                    out = pipeline.encode(chunk)
                yield pa.RecordBatch.from_arrays([*[same.column(c) for c in _coords(meta.rank)], same.column("key"), pa.array([out], pa.binary())], names=[*_coords(meta.rank), "key", "payload"])

    return run
