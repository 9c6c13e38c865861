"""What the operators share: byte buffers of texts, spans, hashes, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that numpy works on at once.
SLICE_BYTES = 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where it is unset, a temporary one, on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there and lost executors cost no recomputation. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of text; a longer text stands alone and whole."""
    if not batch.num_rows:
        return
    lengths = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    total, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def buffer_of(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by a newline; the start of each, and the end of all."""
    raw = b"\n".join([*texts, b""])
    if lower:
        raw = raw.translate(LOWER)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def table_of(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            globals()[name] = np.cumprod(step)
    return _powers, _inverses


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, from which the hash of any span follows in constant time."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    out[1:] = buf
    out[1:] += np.uint64(1)
    out[1:] *= up[: len(buf)]
    return np.cumsum(out, out=out)


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def annotate(df: DataFrame, text_col: str, out_col: str, fields: T.StructType, make: Callable[[], Callable[[list[bytes]], list]], keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Adds out_col, a struct of fields, computed from text_col by Arrow slices.

    make() runs once a task and gives a function from a list of texts to one
    array (or list) for each field. keep names the columns to carry along,
    all by default; a column named out_col is refused.
    """
    keep = df.columns if keep is None else keep
    if out_col in keep:
        raise ValueError(f"the input has a column {out_col} already; name another out_col")
    names = [f"c{i}" for i in range(len(keep))]
    source = names[keep.index(text_col)] if text_col in keep else "t"
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], *([] if text_col in keep else [F.col(f"`{text_col}`").alias("t")]))
    schema = T.StructType([*[T.StructField(n, inner.schema[i].dataType) for i, n in enumerate(names)], T.StructField("out", fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = make()
        kind = to_arrow_type(fields)
        for batch in batches:
            for part in pieces(batch, source, limit):
                made = work(texts_of(part, source))
                arrays = [pa.array(a, kind.field(i).type) for i, a in enumerate(made)]
                out = pa.StructArray.from_arrays(arrays, fields=[kind.field(i) for i in range(kind.num_fields)])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], out], names=[*names, "out"])

    return inner.mapInArrow(run, schema).toDF(*keep, out_col)


def prior_shift(known: DataFrame, limit: int) -> float:
    """Log-odds of label 1 among all rows of known (column label) minus those among at most limit rows of either label; 0 unless both labels occur."""
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    zeros, ones = n.get(0, 0), n.get(1, 0)
    if not zeros or not ones:
        return 0.0
    return float(np.log(ones / zeros) - np.log(min(ones, limit) / min(zeros, limit)))


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
