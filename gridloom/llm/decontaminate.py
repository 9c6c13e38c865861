"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive benchmark words. A pattern of m words
is looked for with blocks of two words: a hashed shift table tells how far a
window may move when the block at its end stands nowhere near a pattern's end;
where the shift is zero, the bucket of the block's hash names the candidate
patterns, the first block filters them, and a comparison of bytes decides.
Many stretches of the texts move in step, one numpy lane each.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, annotate, buffer_of, docs_of, mixed, prefix_sums, span_hashes, spans_of, staged, table_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
INSIDE = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
STRETCH = 256
SHIFT_BITS = 18
#: Pattern bytes that one pass may broadcast; a larger benchmark is searched in as many passes as it takes.
PASS_BYTES = 48 << 20

FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T.LongType()))])


def windows_of(text: bytes, size: int) -> list[bytes]:
    """The windows of size words of one item; fewer words are one window, none are no window."""
    words = WORD.findall(text.translate(LOWER))
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _hash_words(patterns: list[bytes]) -> np.ndarray:
    words = [p.split(b" ") for p in patterns]
    flat = [w for ws in words for w in ws]
    buf, bounds = buffer_of(flat)
    return span_hashes(prefix_sums(buf), bounds[:-1], bounds[1:] - 1).reshape(len(patterns), -1)


class Searcher:
    """Tables for the patterns of one length in words."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        hashes = _hash_words(patterns)
        self.m = hashes.shape[1]
        self.block = min(2, self.m)
        self.bits = np.uint64(64 - SHIFT_BITS)
        blocks = self.blocks(hashes.ravel()).reshape(-1) if self.block == 1 else np.concatenate([self.blocks(row) for row in hashes])
        per = self.m - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, per, np.uint8 if per < 256 else np.int64)
        where = np.tile(np.arange(per), len(patterns))
        np.minimum.at(self.shift, (blocks >> self.bits).astype(np.int64), (per - 1 - where).astype(self.shift.dtype))
        last, first = blocks.reshape(-1, per)[:, -1], blocks.reshape(-1, per)[:, 0]
        self.order = np.argsort(last, kind="stable")
        self.suffix, self.prefix = last[self.order], first[self.order]

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return mixed(hashes)
        return mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])

    def search(self, hashes: np.ndarray, doc: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
        """First words and pattern numbers of the occurrences in a stream of words."""
        n, m = len(hashes), self.m
        if n < m:
            return [], []
        blocks = self.blocks(hashes)
        slots = (blocks >> self.bits).astype(np.int64)
        lead = m - self.block
        at = np.arange(0, n - m + 1, STRETCH)
        stop = np.minimum(at + STRETCH, n - m + 1)
        found = []
        while len(at):
            step = self.shift[slots[at + lead]].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return [], []
        at = np.sort(np.concatenate(found))
        at = at[doc[at] == doc[at + m - 1]]
        low, high = np.searchsorted(self.suffix, blocks[at + lead]), np.searchsorted(self.suffix, blocks[at + lead], "right")
        firsts, numbers = [], []
        for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            if a == b:
                continue
            same = np.flatnonzero(self.prefix[a:b] == blocks[i])
            if len(same):
                text = b" ".join([raw[s:e] for s, e in zip(starts[i : i + m].tolist(), ends[i : i + m].tolist(), strict=True)])
                for j in same.tolist():
                    number = int(self.order[a + j])
                    if self.patterns[number] == text:
                        firsts.append(i)
                        numbers.append(number)
        return firsts, numbers


def _worker(patterns: dict[bytes, list[str]]):
    by_length = defaultdict(list)
    for p in patterns:
        by_length[p.count(b" ") + 1].append(p)
    searchers = [Searcher(ps) for _, ps in sorted(by_length.items())]

    def work(texts: list[bytes]) -> list:
        buf, bounds = buffer_of(texts)
        raw = buf.tobytes()
        starts, ends = spans_of(INSIDE[buf])
        edges = np.searchsorted(starts, bounds)
        counts = np.diff(edges)
        doc = np.repeat(np.arange(len(texts)), counts)
        cover = np.zeros(len(starts) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        if len(starts):
            hashes = span_hashes(prefix_sums(buf), starts, ends)
            for s in searchers:
                firsts, numbers = s.search(hashes, doc, raw, starts, ends)
                for i, k in zip(firsts, numbers, strict=True):
                    cover[i] += 1
                    cover[i + s.m] -= 1
                    items[doc[i]].update(patterns[s.patterns[k]])
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        parts = np.searchsorted(hit, edges)
        hits = [hit[a:b] - e for a, b, e in zip(parts[:-1], parts[1:], edges[:-1], strict=True)]
        return [counts, np.diff(parts), [sorted(x) for x in items], hits]

    return work


def _passes(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int) -> Iterator[dict[bytes, list[str]]]:
    """The windows with the items that have them, in groups of at most limit bytes each, one group at a time."""
    out, room = defaultdict(list), limit
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null and i is not null")
    for row in rows.toLocalIterator():
        for w in dict.fromkeys(windows_of(bytes(row.t), size)):
            if room < len(w):
                yield dict(out)
                out, room = defaultdict(list), limit
            if row.i not in out[w]:
                out[w].append(row.i)
            room -= len(w) + 100
    yield dict(out)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, out_col: str = "contamination", keep: list[str] | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Adds out_col: n_words, n_hit, items (sorted ids as strings) and hits (numbers of the hit words).

    Nulls and texts without words have 0 words and no items; items without
    text or id have no windows; items that share a window are all named;
    an empty benchmark or document table is fine; other columns pass through.
    The benchmark is broadcast in parts of at most pass_bytes, one pass over
    the words for each part; what a pass finds is written to the shared folder,
    so driver and executors hold one part at a time.
    """
    keep = docs.columns if keep is None else keep
    if out_col in keep:
        raise ValueError(f"the input has a column {out_col} already; name another out_col")
    carried = keep if text_col in keep else [*keep, text_col]
    sc, df, done = docs.sparkSession.sparkContext, docs, 0
    groups = _passes(benchmark, item_col, item_text_col, window, pass_bytes)
    group = next(groups)
    while group is not None:
        after = next(groups, None)
        shared = sc.broadcast(group)
        work = lambda shared=shared: _worker(shared.value)
        if not done and after is None:
            return annotate(df, text_col, out_col, FIELDS, work, keep)
        made = annotate(df, text_col, "__new", FIELDS, work, [*carried, *(["__old"] if done else [])])
        if done:
            union = lambda f: F.array_sort(F.array_union(F.col("__old")[f], F.col("__new")[f]))
            both = F.struct(F.col("__new")["n_words"].alias("n_words"), F.size(union("hits")).cast("long").alias("n_hit"), union("items").alias("items"), union("hits").alias("hits"))
        else:
            both = F.col("__new")
        df = staged(made.select(*[F.col(f"`{c}`") for c in carried], both.alias("__old")), "pass")
        shared.destroy()
        group, done = after, done + 1
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col("__old").alias(out_col))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(docs_of(spark, sf_dir).select("doc_id", "text"), docs_of(spark, sf_dir, "benchmark"), keep=["doc_id"], out_col="c")
    n = F.size("c.items").cast("long")
    return found.select("doc_id", "c.n_words", "c.n_hit", n.alias("n_items"), F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


ORACLE = r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
item_windows as (
  select distinct item_id, least(len(w), 8) as k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') as p
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct k from item_windows),
doc_windows as (
  select r, i, k, array_to_string(w[i : i + k - 1], ' ') as p
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where len(w) >= k)),
hits as (select d.r, d.i, d.k, b.item_id from doc_windows d join item_windows b on d.k = b.k and d.p = b.p),
covered as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + k)) as x from hits) group by r),
named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from words left join covered using (r) left join named using (r)
"""
