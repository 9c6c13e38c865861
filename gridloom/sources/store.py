"""Versioned chunk tables, and directories of chunks, on any file system.

The native store is a Parquet table of encoded chunks, sorted by their
coordinates, beside its metadata; each save is a new version, and a pointer
that is replaced in one step names the current one, so readers see whole
versions only. A directory of chunks, one key each, is updated in place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import Location
from .metadata import ArrayMeta, from_v3


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file whole; None if there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes beside the place and renames over it in one step, so that a reader finds the old file or the new one, never none."""
    fs, at = _file_system(spark, path)
    _, part = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(data))
    stream.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(at), how)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share; where it is unset, a temporary one, on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def save(meta: ArrayMeta, chunks: DataFrame, path: str) -> None:
    """A new version of the store; the old one stays readable until the pointer moves.

    Chunks are dealt by ranges of their coordinates, so that a selection's
    ranges leave out whole files and row groups.
    """
    spark, version = chunks.sparkSession, uuid.uuid4().hex
    coords = [f"c{i}" for i in range(meta.rank)]
    dealt = chunks.repartitionByRange(*coords).sortWithinPartitions(*coords) if coords else chunks
    dealt.write.parquet(f"{path}/chunks-{version}")
    write_bytes(spark, f"{path}/chunks-{version}.json", meta.to_v3().encode())
    write_bytes(spark, f"{path}/current", version.encode())


def load(spark: SparkSession, path: str) -> tuple[ArrayMeta, DataFrame]:
    version = read_bytes(spark, f"{path}/current")
    if version is None:
        raise FileNotFoundError(path)
    at = f"{path}/chunks-{version.decode()}"
    return from_v3(read_bytes(spark, f"{at}.json")), spark.read.parquet(at)


def write_directory(meta: ArrayMeta, chunks: DataFrame, place: Location) -> int:
    """One key a chunk, put by the executors, and zarr.json; the number of chunks."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                place.put(key, payload)
            yield batch.select(["key"])

    n = chunks.select("key", "payload").mapInArrow(put, "key string").count()
    place.put("zarr.json", meta.to_v3().encode())
    return n


def synthetic(spark: SparkSession, meta: ArrayMeta) -> DataFrame:
    """Cells of the benchmark array: i % 256 for uint8, i % 65536 for uint16, i / 2 else, where i is the place in C order."""
    from ..functions.layout import size, strides

    i = F.col("id")
    value = i % 256 if meta.dtype == "uint8" else i % 65536 if meta.dtype == "uint16" else i * 0.5
    cells = [F.pmod(F.floor(i / F.lit(s)), F.lit(n)).cast("long").alias(f"i{d}") for d, (s, n) in enumerate(zip(strides(meta.shape), meta.shape, strict=True))]
    return spark.range(size(meta.shape)).select(*cells, value.alias("value"))
