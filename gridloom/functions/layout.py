"""Strides, chunk grids and chunk keys, as Python values and as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strides(shape: Sequence[int], order: str | Sequence[int] = "C") -> list[int]:
    """Strides in elements; order is C (last dimension fastest), F, or the dimensions from slowest to fastest."""
    rank = len(shape)
    dims = list(range(rank)) if order == "C" else list(range(rank))[::-1] if order == "F" else list(order)
    if sorted(dims) != list(range(rank)):
        raise ValueError(f"not an order of {rank} dimensions: {order}")
    out, step = [0] * rank, 1
    for d in reversed(dims):
        out[d] = step
        step *= shape[d]
    return out


def grid(shape: Sequence[int], chunks: Sequence[int]) -> list[int]:
    return [-(-n // c) for n, c in zip(shape, chunks, strict=True)]


def edge_shape(shape: Sequence[int], chunks: Sequence[int], coords: Sequence[int]) -> list[int]:
    """The part of a chunk that lies within the array."""
    return [max(0, min(c, n - k * c)) for n, c, k in zip(shape, chunks, coords, strict=True)]


def chunk_key(coords: Sequence[int], encoding: str = "default", separator: str | None = None) -> str:
    if encoding == "default":
        return (separator or "/").join(["c", *map(str, coords)])
    if encoding == "v2":
        return (separator or ".").join(map(str, coords)) or "0"
    raise ValueError(f"unknown chunk key encoding: {encoding}")


def chunk_key_column(coords: Sequence[Column], encoding: str = "default", separator: str | None = None) -> Column:
    chunk_key([], encoding, separator)
    texts = [c.cast("string") for c in coords]
    if encoding == "default":
        return F.concat_ws(separator or "/", F.lit("c"), *texts)
    return F.concat_ws(separator or ".", *texts) if texts else F.lit("0")


def edge_columns(shape: Sequence[int], chunks: Sequence[int], coords: Sequence[Column]) -> list[Column]:
    return [F.greatest(F.lit(0).cast("long"), F.least(F.lit(c).cast("long"), F.lit(n).cast("long") - k * c)) for n, c, k in zip(shape, chunks, coords, strict=True)]


def chunk_columns(cells: Sequence[Column], chunks: Sequence[int]) -> list[Column]:
    return [F.floor(i / F.lit(c)).cast("long") for i, c in zip(cells, chunks, strict=True)]


def offset_column(cells: Sequence[Column], chunks: Sequence[int]) -> Column:
    """Place of a cell within its chunk, in C order."""
    return reduce(lambda a, b: a + b, [F.pmod(i, F.lit(c).cast("long")) * s for i, c, s in zip(cells, chunks, strides(chunks), strict=True)], F.lit(0).cast("long"))


def size(shape: Sequence[int]) -> int:
    return math.prod(shape)
