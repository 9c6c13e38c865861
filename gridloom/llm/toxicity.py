"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are its distinct words, stems of longer words, pairs of
neighbours, and pairs with one or two words between them, hashed to 2**BITS
coordinates. FTRL-proximal gives every coordinate its own rate and an L1
penalty. A first phase under a strong penalty selects coordinates, a second
under a weak one sets their weights; the few that are not zero are broadcast.
The model is fitted in one task on a bounded sample of labelled rows: of either
label the first SAMPLE / 2 by a hash of their id. Where that changes the labels'
shares, the intercept is moved by the difference of the log prior odds, so that
scores don't depend on how many rows are labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, buffer_of, docs_of, mixed, pieces, prefix_sums, prior_shift, span_hashes, spans_of, table_of, texts_of

BITS = 20
#: Bytes of a longer word that count as a word of their own kind, its stem.
STEM = 5
#: Labelled rows used for fitting, at most.
SAMPLE = 8000
ALPHA, BETA, L2 = 1.0, 1.0, 0.1
#: L1 penalty and epochs of the phases; the penalty is a multiple of the root of the rarer label's rows, as noise is.
PHASES = ((0.6, 6), (0.03, 10))
REJECT = 0.7
INSIDE = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and coordinates of all features, repeats included, in order of the texts within each kind."""
    buf, bounds = buffer_of(texts)
    starts, ends = spans_of(INSIDE[buf])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
    sums = prefix_sums(buf)
    h = span_hashes(sums, starts, ends)
    long = ends - starts > STEM
    docs, hashes = [doc, doc[long]], [h, mixed(span_hashes(sums, starts[long], starts[long] + STEM))]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            hashes.append(mixed(h[:-gap][same] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + h[gap:][same]))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(docs: np.ndarray, coords: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct coordinates of each text."""
    keys = np.unique((docs << BITS) | coords)
    edges = np.searchsorted(keys, np.arange(n + 1) << BITS)
    return [keys[a:b] & ((1 << BITS) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Ftrl:
    """Coordinate 2**BITS is the intercept, which has no L1 penalty."""

    def __init__(self, l1: float):
        self.l1 = l1
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[np.ndarray, int]], phases: tuple = PHASES) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero."""
    every = np.arange((1 << BITS) + 1)
    positive = sum(label for _, label in rows)
    noise = max(1, min(positive, len(rows) - positive)) ** 0.5
    for l1, epochs in phases:
        model = Ftrl(l1 * noise)
        for _ in range(epochs):
            for at, label in rows:
                model.learn(at, label)
        w = model.weights(every)
        rows = [(at[w[at] != 0], label) for at, label in rows]
    return every[w != 0], w[w != 0]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: str | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The weights from at most sample labelled rows, whose ids don't fulfil held_out (SQL over the column id).

    Ids or labels that are null or labels other than 0 and 1 are left out; of
    several labels of an id the highest counts, and of rows that repeat an id
    one, so that no id fills the sample. The intercept holds for the labels'
    shares among all labelled rows. Without any labels the weights are empty
    and every score is 0.5.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if held_out:
        known = known.where(f"not ({held_out})")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    first = lambda label: known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample // 2)
    chosen = first(0).unionByName(first(1))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(chosen), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                per = distinct(*features(texts_of(part, "t")), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([x.astype("<u4").tobytes() for x in per], pa.binary())], names=["id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, "<u4"), y) for b in batches for x, y in zip(b.column("x").to_pylist(), b.column("label").to_pylist(), strict=True)]
        at, w = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    kind = rows.schema["id"].dataType.simpleString()
    each = rows.mapInArrow(extract, f"id {kind}, label int, x binary").groupBy("id", "label").agg(F.min("x").alias("x"))
    # Another hash than the sample's, whose first rows of either label reach differently far: in its order the last rows would all be of one label.
    found = each.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), "id"), "id", "x").mapInArrow(learn, "at long, w double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    shift = prior_shift(known, sample // 2) if len(at) else 0.0
    if shift:
        plain = at < 1 << BITS
        at, w = np.append(at[plain], 1 << BITS), np.append(w[plain], w[~plain].sum() + shift)
    order = np.argsort(at)
    return at[order], w[order]


def _scorer(at: np.ndarray, w: np.ndarray):
    table = np.zeros(1 << BITS)
    inside = at < 1 << BITS
    table[at[inside]] = w[inside]
    bias = float(w[~inside].sum())
    some = table != 0

    def work(texts: list[bytes]) -> list:
        docs, coords = features(texts)
        hit = some[coords]
        keys = np.unique((docs[hit] << BITS) | coords[hit])
        total = bias + np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], len(texts))
        return [1 / (1 + np.exp(-np.clip(total, -35, 35)))]

    return work


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", out_col: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Adds out_col: score, 0 to 1. Null and empty texts get the intercept's score; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, text_col, out_col, FIELDS, lambda: _scorer(*shared.value), keep)


def remainder(mod: int) -> str:
    return f"crc32(cast(id as string)) % {mod}"


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    model = train(docs, docs_of(spark, sf_dir, "labels"), held_out=f"{remainder(3)} = 1")
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= REJECT).cast("int").alias("predicted"))
