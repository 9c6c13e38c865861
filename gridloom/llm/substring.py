"""Substring dedup by sliding sentence spans.

A sentence ends after a word that ends in . ! or ?, at a line's end and at the
text's end. A span is a run of SEVERAL = 3 consecutive sentences, every one
of them, whatever its length; longer repeated runs consist of such. So that long
passages of few sentences are met too, two sentences of MIN_WORDS words together
and one of ALONE words are spans as well. Spans are hashed (128 bits, words in
lower case, any white space), joined over all documents, and every sentence
under a span that is not the first of its kind goes. First is the smallest
(id, text hash, place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, buffer_of, docs_of, mixed, pieces, powers, prefix_sums, span_hashes, spans_of, staged, table_of, texts_of

SEVERAL, MIN_WORDS, ALONE = 3, 25, 50
BLANK = table_of(lambda b: b in SPACES)
LINE = table_of(lambda b: b in b"\n\r")
STOP = table_of(lambda b: b in b".!?")
FIELDS = T.StructType([T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])


class Sentences:
    """The words and sentences of some texts: first and last + 1 word of each sentence, and its text."""

    def __init__(self, texts: list[bytes]):
        self.buf, bounds = buffer_of(texts)
        self.starts, self.ends = spans_of(~BLANK[self.buf])
        n = len(self.starts)
        edges = np.searchsorted(self.starts, bounds)
        doc = np.repeat(np.arange(len(texts)), np.diff(edges))
        lines = np.concatenate([[0], np.cumsum(LINE[self.buf])])
        # Each text is followed by a newline, so its last word ends a sentence.
        after = np.append(self.starts[1:], len(self.buf)) if n else self.starts
        last = STOP[self.buf[self.ends - 1]] | (lines[after] > lines[self.ends])
        self.to = np.flatnonzero(last) + 1
        self.at = np.concatenate([[0], self.to[:-1]])[: len(self.to)]
        self.doc = doc[self.at] if n else doc
        self.edges = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.bounds = bounds

    def spans(self, several: int, min_words: int, alone: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last sentence of every span: all runs of several sentences, pairs of min_words words and sentences of alone words."""
        n, first, last = len(self.at), [], []
        for size, least in {several: 0, **({2: min_words} if several > 2 else {}), **({1: alone} if several > 1 else {})}.items():
            a = np.arange(max(0, n - size + 1))
            b = a + size - 1
            fine = (self.doc[a] == self.doc[b]) & (self.to[b] - self.at[a] >= least)
            first.append(a[fine])
            last.append(b[fine])
        return np.concatenate(first), np.concatenate(last)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Two independent hashes of the words from sentence a to sentence b."""
        words = span_hashes(prefix_sums(self.buf), self.starts, self.ends)
        up, down = powers(len(words) + 1)
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mixed(words ^ np.uint64(salt)) * up[: len(words)], out=sums[1:])
            out.append(mixed((sums[self.to[b]] - sums[self.at[a]]) * down[self.at[a]]))
        return out


def _spans(keyed: DataFrame, several: int, min_words: int, alone: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                s = Sentences(texts_of(part, "t"))
                a, b = s.spans(several, min_words, alone)
                h, g = s.hashes(a, b) if len(a) else (np.zeros(0, np.uint64),) * 2
                own, first = s.doc[a], s.edges[s.doc[a]]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), part.column("id").take(pa.array(own)), part.column("th").take(pa.array(own)), pa.array((a - first).astype(np.int32)), pa.array((b - first).astype(np.int32))], names=["h", "g", "id", "th", "a", "b"])

    return keyed.mapInArrow(run, f"h long, g long, id {keyed.schema['id'].dataType.simpleString()}, th long, a int, b int")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "repeats", keep: list[str] | None = None, several: int = SEVERAL, min_words: int = MIN_WORDS, alone: int = ALONE) -> DataFrame:
    """Adds out_col: n_sentences, n_removed, spans (numbers of the removed sentences) and text, what is left of the text.

    A null text stays null with 0 sentences; rows of the same id and text are
    one document, which loses nothing to itself but what it repeats inside;
    null ids come first; an empty table gives an empty result; other columns
    pass through.
    """
    keep = docs.columns if keep is None else keep
    if out_col in keep:
        raise ValueError(f"the input has a column {out_col} already; name another out_col")
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("t"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True) if c != text_col])
    spans = staged(_spans(rows.select("id", "th", "t").where("t is not null"), several, min_words, alone), "spans")
    # Counts alone are shuffled first; the few spans that repeat are then named and compared.
    # Both sides of a join are tables, so that a span that stands in very many documents is split among tasks.
    often = staged(spans.groupBy("h", "g").count().where("count > 1").select("h", "g"), "often")
    met = staged(spans.join(often, ["h", "g"]), "met")
    firsts = staged(met.groupBy("h", "g").agg(F.min(F.struct("id", "th", "a")).alias("first")), "firsts")
    later = met.join(firsts, ["h", "g"]).where(~F.struct("id", "th", "a").eqNullSafe(F.col("first")))
    marks = later.groupBy(F.col("id").alias("mi"), F.col("th").alias("mt")).agg(F.collect_set(F.struct("a", "b")).alias("marks"))
    joined = rows.join(marks, rows.id.eqNullSafe(marks.mi) & (rows.th == marks.mt), "left").drop("id", "th", "mi", "mt")
    kept = [n for c, n in zip(keep, names, strict=True) if c != text_col]
    schema = T.StructType([*[joined.schema[n] for n in kept], T.StructField("t", T.StringType()), T.StructField("out", FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(FIELDS)
        for batch in batches:
            for part in pieces(batch, "t"):
                raw, marks = part.column("t").cast(pa.binary()).to_pylist(), part.column("marks").to_pylist()
                s = Sentences(texts_of(part, "t"))
                gone, texts = [], []
                for i, (text, own) in enumerate(zip(raw, marks, strict=True)):
                    first, end = s.edges[i], s.edges[i + 1]
                    out = np.zeros(end - first, bool)
                    for m in own or []:
                        out[m["a"] : m["b"] + 1] = True
                    gone.append(np.flatnonzero(out))
                    if text is None or not out.any():
                        texts.append(text)
                        continue
                    at = s.starts[s.at[first:end]] - s.bounds[i]
                    until = np.append(at[1:], len(text))
                    lead = text[: at[0]]
                    texts.append(lead + b"".join(text[a:b] for a, b in zip(at[~out].tolist(), until[~out].tolist(), strict=True)))
                arrays = [pa.array(np.diff(s.edges)), pa.array([len(x) for x in gone], pa.int64()), pa.array(gone, pa.list_(pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())]
                made = pa.StructArray.from_arrays([a.cast(kind.field(k).type) for k, a in enumerate(arrays)], fields=[kind.field(k) for k in range(4)])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], part.column("t"), made], names=[*kept, "t", "out"])

    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col("t" if c == text_col else n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("out").alias(out_col))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(docs_of(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"], out_col="r")
    return found.select("doc_id", "r.n_sentences", "r.n_removed", F.concat_ws(",", F.col("r.spans").cast("array<string>")).alias("removed"), F.col("r.text").alias("text"))
