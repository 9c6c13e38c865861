"""Element types: names, numpy and Spark types, and wrap-around coercion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (numpy, Spark); Spark has no unsigned types, so these take the next wider one.
DTYPES = {
    "int8": ("i1", "tinyint"),
    "int16": ("i2", "smallint"),
    "int32": ("i4", "int"),
    "int64": ("i8", "bigint"),
    "uint8": ("u1", "smallint"),
    "uint16": ("u2", "int"),
    "uint32": ("u4", "bigint"),
    "uint64": ("u8", "decimal(20,0)"),
    "float32": ("f4", "float"),
    "float64": ("f8", "double"),
}


def numpy_type(name: str, endian: str = "little") -> np.dtype:
    if name not in DTYPES:
        raise ValueError(f"unsupported data type: {name}")
    return np.dtype(DTYPES[name][0]).newbyteorder("<" if endian == "little" else ">")


def spark_type(name: str) -> str:
    numpy_type(name)
    return DTYPES[name][1]


def coerced(values: object, name: str) -> np.ndarray:
    """Values as the element type: integers are cut towards zero and wrap modulo their range; what isn't finite becomes 0; "NaN" and "Infinity" are numbers."""
    kind = numpy_type(name)
    if kind.kind == "f":
        return np.asarray(values, object).astype(np.float64).astype(kind) if not isinstance(values, np.ndarray) or values.dtype == object else values.astype(kind)
    a = np.asarray(values)
    if a.dtype.kind in "iu":
        return a.astype(kind)
    bits = 8 * kind.itemsize
    wrap = lambda v: int(v) % (1 << bits) if not isinstance(v, float) or np.isfinite(v) else 0
    flat = [wrap(float(v) if isinstance(v, str | np.floating) else v) for v in a.ravel().tolist()]
    return np.array(flat, np.uint64).reshape(a.shape).astype(kind)


def wrapped(column: Column, name: str) -> Column:
    """The same for a Spark column of whole or fractional numbers."""
    kind = numpy_type(name)
    if kind.kind == "f":
        return column.cast(spark_type(name))
    span = 1 << (8 * kind.itemsize)
    whole = F.when(F.isnan(column.cast("double")) | F.abs(column.cast("double")).isin(float("inf")), F.lit(0)).otherwise(F.expr("cast(0 as decimal(38,0))") + F.when(column < 0, F.ceil(column)).otherwise(F.floor(column)).cast("decimal(38,0)"))
    wide = lambda n: F.expr(f"cast({n} as decimal(38,0))")
    low = F.pmod(whole, wide(span))
    if kind.kind == "i":
        low = F.when(low >= wide(span // 2), low - wide(span)).otherwise(low)
    return low.cast(spark_type(name))


def arrow_values(a: np.ndarray, name: str) -> pa.Array:
    """An Arrow array of the Spark type."""
    kind = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}.get(spark_type(name))
    a = np.ascontiguousarray(a.astype(numpy_type(name)))
    if kind is None:
        return pa.array(a, pa.uint64()).cast(pa.decimal128(20, 0))
    return pa.array(a).cast(kind)


def numpy_values(a: pa.Array, name: str) -> np.ndarray:
    """Back from an Arrow array of the Spark type."""
    if name == "uint64":
        return np.array([int(x) for x in a.to_pylist()], np.uint64)
    return a.to_numpy(zero_copy_only=False).astype(numpy_type(name))
