"""Packing by concatenate and cut.

First pass: each task tokenises its rows and writes ids with the task's number
and the tokens before each row in that task. The tasks' totals, one row each,
are summed up in the driver and give each task its global offset. Second pass:
every row lies at a known place in one endless sequence, which fixed windows
cut; a row that crosses a window's edge leaves one boundary record a window.
Only the last sequence can be short.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, pieces, staged

LENGTH = 2048
END_ID = 1


@lru_cache(maxsize=4)
def encoder(name: str, added: bool = False):
    """A function from a text to the list of its ids, those of the tokenizers file name.json.

    With added, the file's added tokens (control strings) have their own ids
    inside a text, as by the tokenizer's default; without, they are ordinary
    text. The same vocabulary's ranks in name.tiktoken give the same ids
    several times faster; tests hold the two against each other.
    """
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    control = {}
    if added:
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            for t in json.load(f)["added_tokens"]:
                if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                    raise ValueError(f"{name}: the added token {t['content']} is not matched as it stands")
                control[t["content"]] = t["id"]
    made = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=control)
    return partial(made.encode, allowed_special=set(control), disallowed_special=()) if control else made.encode_ordinary


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """First pass: part, before (tokens earlier in the part), doc_id and ids (16-bit little-endian where they fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer, added=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "t"):
                ids = [np.array([*encode(t or ""), end_id], np.uint32) for t in piece.column("t").to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), piece.column("d"), pa.array(sizes), pa.array([x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids], pa.binary())], names=["part", "before", "doc_id", "n", "ids"])

    plain = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t"))
    return plain.mapInArrow(run, f"part int, before long, doc_id {plain.schema['d'].dataType.simpleString()}, n long, ids binary")


def padded(length: int, to: int = LENGTH) -> int:
    """A sequence's padded length: a power of two stays as it is, anything else is filled up."""
    return length if length & (length - 1) == 0 else to


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, 32-bit little-endian), doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens.

    A null text is an empty one and leaves its end id alone; repeated rows and
    null ids are packed like any others; an empty table gives no pieces; other
    columns are not read.
    """
    rows = staged(tokenised(docs, id_col, text_col, tokenizer, end_id), "ids")
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([n for _, n in totals])
    all_tokens = int(ends[-1]) if totals else 0
    # One number for each task of the first pass: its size follows the number of tasks, not of rows.
    offsets = rows.sparkSession.sparkContext.broadcast({p: int(e) - n for (p, n), e in zip(totals, ends, strict=True)})
    last = all_tokens // length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, before, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("part", "before", "n"))
            begin = np.array([offsets.value[p] for p in part.tolist()], np.int64) + before
            count = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = begin[row] // length + nth
            a = np.maximum(begin[row], sequence * length)
            b = np.minimum(begin[row] + n[row], (sequence + 1) * length)
            raw = batch.column("ids").to_pylist()
            cut = []
            for r, s, e in zip(row.tolist(), (a - begin[row]).tolist(), (b - begin[row]).tolist(), strict=True):
                wide = len(raw[r]) // int(n[r])
                cut.append(np.frombuffer(raw[r], f"<u{wide}", e - s, s * wide).astype("<u4").tobytes())
            tokens = np.where(sequence < last, length, all_tokens - last * length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (a - begin[row], b - a)), pa.array(cut, pa.binary()), *map(pa.array, (n[row], sequence, a - sequence * length, tokens, np.array([padded(int(x), length) for x in tokens], np.int64)))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long")


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """Whole padded sequences of pack()'s pieces: sequence_id, n_tokens, ids (binary, 32-bit little-endian). A sequence is at most one window."""
    fill = F.lpad(F.hex(F.lit(pad_id)), 8, "0")
    little = F.concat(*[F.substring(fill, i, 2) for i in (7, 5, 3, 1)])
    joined = packed.groupBy("sequence_id").agg(F.max("sequence_tokens").alias("n_tokens"), F.max("padded_tokens").alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("x")))), lambda s: s["x"]), "").alias("x"))
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat("x", F.repeat(little, (F.col("p") - F.col("n_tokens")).cast("int")))).alias("ids"))


def digested(packed: DataFrame) -> DataFrame:
    """pack()'s pieces with the CRC-32 of their ids in the place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_tokens")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack(docs_of(spark, sf_dir)))


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
