"""Quality by random-indexing word vectors and a small network.

Every token has a sparse random index vector: NONZERO places of DIM, plus or
minus one, from its hash. A token's vector is the sum of the index vectors of
its neighbours, up to WINDOW places away, over the whole corpus; tokens share
2**BITS rows by hash. A text is the mean of its tokens' unit vectors and the
spread around it. A network of two layers, fitted on at most SAMPLE labelled
rows, gives a log-odds, which a temperature fitted on rows it has not seen
calibrates. Where the sample has other shares of the labels than all labelled
rows, the difference of the log prior odds is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, annotate, buffer_of, docs_of, mixed, pieces, prefix_sums, prior_shift, span_hashes, table_of, texts_of

BITS, DIM, NONZERO, WINDOW = 14, 64, 4, 2
#: Labelled rows used for fitting, at most.
SAMPLE = 8000
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 32, 60, 3e-3, 1e-3, 64
ACCEPT = 0.3
#: Rows of the table that travel together.
ROWS = 128
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])
KIND = np.array([0 if b in SPACES else 1 if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 2 for b in range(256)], np.int8)
UPPER = table_of(lambda b: 0x41 <= b <= 0x5A)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each run of word bytes or of punctuation; a word in capitals is another token than in lower case."""
    buf, bounds = buffer_of(texts, lower=False)
    low = np.where(UPPER[buf], buf + 32, buf).astype(np.uint8)
    kind = KIND[buf]
    cut = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(buf) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(buf))
    some = kind[cut] > 0
    starts, ends = cut[some], ends[some]
    h = span_hashes(prefix_sums(low), starts, ends)
    caps = np.concatenate([[0], np.cumsum(UPPER[buf])])
    loud = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
    return doc, np.where(loud, mixed(h + np.uint64(1)), h)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each token's index vector."""
    r = mixed(h ^ np.uint64(0x27D4EB2F165667C5))
    places = np.stack([(r >> np.uint64(8 * k)) % np.uint64(DIM) for k in range(NONZERO)]).astype(np.int64)
    signs = np.stack([np.where(r >> np.uint64(40 + k) & np.uint64(1), 1.0, -1.0) for k in range(NONZERO)])
    return places, signs


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's share of the table, in blocks of ROWS rows that are not all zero."""
    table = np.zeros((1 << BITS) * DIM, np.int64)
    for batch in batches:
        for part in pieces(batch, "t"):
            doc, h = tokens(texts_of(part, "t"))
            row = (h >> np.uint64(64 - BITS)).astype(np.int64) * DIM
            places, signs = index_vectors(h)
            for d in range(1, WINDOW + 1):
                same = np.flatnonzero(doc[:-d] == doc[d:]) if len(doc) > d else np.zeros(0, np.int64)
                for a, b in ((same, same + d), (same + d, same)):
                    at = (row[a] + places[:, b]).ravel()
                    table += np.bincount(at, signs[:, b].ravel(), len(table)).astype(np.int64)
    blocks = table.reshape(-1, ROWS * DIM)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of blocks of the same number; one running sum a block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The unit vectors of all token rows, from the whole corpus. The table's size is fixed; rows never met are zero."""
    shares = docs.select(F.col(f"`{text_col}`").alias("t")).where("t is not null").mapInArrow(_context, "block int, sums binary")
    # Two rounds of running sums: the first over arbitrary groups of shares, so that no task has to read all shares of a block.
    some = shares.repartition(F.col("block"), F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(_added, "block int, sums binary")
    found = some.repartition("block").mapInArrow(_added, "block int, sums binary").toArrow()
    table = np.zeros((1 << BITS) // ROWS * ROWS * DIM).reshape(-1, ROWS * DIM)
    for k, x in zip(found.column("block").to_pylist(), found.column("sums").to_pylist(), strict=True):
        table[k] = np.frombuffer(x, np.int64)
    table = table.reshape(-1, DIM)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(size, 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's tokens; zeros for a text without tokens."""
    doc, h = tokens(texts)
    rows = (h >> np.uint64(64 - BITS)).astype(np.int64)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            which, count = np.unique(rows[a:b], return_counts=True)
            x, share = table[which], (count / (b - a)).astype(np.float32)
            mean = share @ x
            out[i, :DIM], out[i, DIM:] = mean, np.sqrt(np.maximum(share @ (x * x) - mean * mean, 0))
    return out


class Network:
    """Standardised inputs, one hidden layer of rectifiers, a log-odds divided by a temperature, moved by shift to the prior of all rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shift: float = 0.0):
        self.shift = shift
        rng = np.random.default_rng(7)
        aside = np.arange(len(y)) % 5 == 4
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        z = self.inputs(x)
        self.p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, step = [0 * q for q in self.p], [0 * q for q in self.p], 0
        own = np.flatnonzero(~aside)
        for _ in range(EPOCHS):
            rng.shuffle(own)
            for i in range(0, len(own), BATCH):
                at, step = own[i : i + BATCH], step + 1
                for k, g in enumerate(self.gradients(z[at], y[at])):
                    g = g + DECAY * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            raw = self.logits(x[aside])
            loss = lambda t: np.logaddexp(0, np.where(y[aside] == 1, -raw, raw) / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, u, c = self.p
        h = np.maximum(z @ w + b, 0)
        d = (1 / (1 + np.exp(-np.clip(h @ u + c, -35, 35))) - y) / len(y)
        back = np.outer(d, u) * (h > 0)
        return [z.T @ back, back.sum(axis=0), h.T @ d, d.sum(keepdims=True)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.p
        return np.maximum(self.inputs(x) @ w + b, 0) @ u + c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: str | None = None, sample: int = SAMPLE) -> Network | None:
    """A network from at most sample labelled rows (half of either label, if there are so many) whose ids don't fulfil held_out; None without both labels.

    Ids or labels that are null or labels other than 0 and 1 are left out; of
    several labels of an id the highest counts, and of rows that repeat an id
    one. The sample's shares of the labels differ from those of all rows where
    a label has more than half the sample; the network's shift makes up for it.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if held_out:
        known = known.where(f"not ({held_out})")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    first = lambda label: known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample // 2)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(first(0).unionByName(first(1))), "id")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                x = pooled(texts_of(part, "t"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "label", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, label int, x binary").groupBy("id", "label").agg(F.min("x").alias("x")).toArrow()
    y = found.column("label").to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    order = np.lexsort((*np.round(x, 5).T[:4], y))
    order = order[np.random.default_rng(5).permutation(len(order))]
    return Network(x[order], y[order], prior_shift(known, sample // 2))


def score_quality(docs: DataFrame, table: np.ndarray, network: Network | None, text_col: str = "text", out_col: str = "quality_score", keep: list[str] | None = None) -> DataFrame:
    """Adds out_col: score, 0 to 1. Texts without tokens, null ones too, share the score of zero vectors; without a network all scores are 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast((table, network))

    def make():
        table, network = shared.value
        return lambda texts: [network.score(pooled(texts, table).astype(np.float64)) if network else np.full(len(texts), 0.5)]

    return annotate(docs, text_col, out_col, FIELDS, make, keep)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    table = word_vectors(docs)
    network = train(docs, docs_of(spark, sf_dir, "labels"), table, held_out="crc32(cast(id as string)) % 5 = 0")
    scored = score_quality(docs, table, network, keep=["doc_id"], out_col="q")
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"), F.col("q.score").alias("score"), (F.col("q.score") >= ACCEPT).cast("int").alias("predicted"))
