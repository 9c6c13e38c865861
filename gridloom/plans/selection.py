"""Selections: integers, slices and whole dimensions, compiled into a plan of chunks."""

from __future__ import annotations

import builtins
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import chunk_key_column, edge_columns


#: Chunks of a plan's partition.
CHUNKS = 256


class SelectionError(IndexError):
    """A selection that doesn't fit the array."""


def slice_(start=None, stop=..., step=None) -> builtins.slice:
    """slice_(stop) or slice_(start, stop, step); None is open."""
    return builtins.slice(None, start, None) if stop is ... else builtins.slice(start, stop, step)


@dataclass(frozen=True)
class Dim:
    """One dimension: count indices from start by step; a whole number's dimension leaves the result."""

    start: int
    step: int
    count: int
    keep: bool

    @property
    def stop(self) -> int:
        return self.start + (self.count - 1) * self.step + 1 if self.count else self.start

    def chunk_count(self, c: int) -> int:
        """How many chunks hold a selected index."""
        if not self.count:
            return 0
        return self.count if self.step >= c else (self.stop - 1) // c - self.start // c + 1

    def inside(self, k: int, c: int) -> np.ndarray:
        """The selected indices within chunk k."""
        first = max(0, -(-(k * c - self.start) // self.step))
        last = min(self.count, -(-((k + 1) * c - self.start) // self.step))
        return self.start + self.step * np.arange(first, max(first, last))

    def covers(self, k: int, c: int, length: int) -> bool:
        """Whether every index of chunk k within the array is selected."""
        return len(self.inside(k, c)) == max(0, min(c, length - k * c))


def dimension(index, length: int) -> Dim:
    if index is None:
        return Dim(0, 1, length, True)
    if isinstance(index, builtins.slice):
        if index.step is not None and index.step == 0:
            raise SelectionError("slice step cannot be zero")
        start, stop, step = index.indices(length)
        if step < 1:
            raise SelectionError("only slices with step >= 1 are supported")
        return Dim(start, step, len(range(start, stop, step)), True)
    try:
        k = int(index) if isinstance(index, float) else operator.index(index)
    except TypeError as e:
        raise SelectionError(f"not an index: {index!r}") from e
    if not -length <= k < length:
        raise SelectionError(f"index out of bounds for dimension with length {length}")
    return Dim(k % length, 1, 1, False)


def normalized(selection, shape: Sequence[int]) -> list[Dim]:
    """One Dim a dimension; what the selection leaves out is whole."""
    given = [] if selection is None else list(selection) if isinstance(selection, list | tuple) else [selection]
    if len(given) > len(shape):
        raise SelectionError(f"too many indices for array; expected {len(shape)}, got {len(given)}")
    return [dimension(i, n) for i, n in zip([*given, *[None] * (len(shape) - len(given))], shape, strict=True)]


def result_shape(dims: Sequence[Dim]) -> list[int]:
    return [d.count for d in dims if d.keep]


def chunk_plan(spark: SparkSession, meta, dims: Sequence[Dim]) -> DataFrame:
    """One row a chunk that holds a selected cell: c0..., key, e0... (its shape within the array). Made by spark.range, not in the driver."""
    counts = [d.chunk_count(c) for d, c in zip(dims, meta.chunks, strict=True)]
    total = int(np.prod(counts, dtype=object)) if counts else 1
    # Fetching and decoding follow the plan's partitions, so large plans get more of them.
    parts = max(1, min(total, max(spark.sparkContext.defaultParallelism, total // CHUNKS)))
    plan, left, coords = spark.range(0, total, 1, parts), F.col("id"), []
    for d, c, n in reversed(list(zip(dims, meta.chunks, counts, strict=True))):
        j = F.pmod(left, F.lit(max(n, 1)).cast("long"))
        left = F.floor(left / F.lit(max(n, 1))).cast("long")
        coords.append(F.floor((F.lit(d.start).cast("long") + j * d.step) / F.lit(c)).cast("long") if d.step >= c else F.lit(d.start // c).cast("long") + j)
    coords.reverse()
    edges = edge_columns(meta.shape, meta.chunks, coords)
    return plan.select(*[x.alias(f"c{i}") for i, x in enumerate(coords)], chunk_key_column(coords, meta.encoding, meta.separator).alias("key"), *[x.alias(f"e{i}") for i, x in enumerate(edges)])


def chunk_filter(dims: Sequence[Dim], chunks: Sequence[int]):
    """A condition on c0... that holds for all planned chunks, for pruning what is scanned."""
    out = F.lit(True)
    for i, (d, c) in enumerate(zip(dims, chunks, strict=True)):
        out = out & F.col(f"c{i}").between(d.start // c, (d.stop - 1) // c) if d.count else F.lit(False)
    return out


def is_total(dims: Sequence[Dim], coords: Sequence[int], chunks: Sequence[int], shape: Sequence[int]) -> bool:
    return all(d.covers(k, c, n) for d, k, c, n in zip(dims, coords, chunks, shape, strict=True))
