"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from the XXH64 hashes of word shingles. Two fingerprints at
most RADIUS = 2 bits apart agree on at least two of any four blocks of bits, so
each distinct fingerprint goes to the six tables of two blocks; rows that agree
on a table's bits form a cell. A cell of more than CELL fingerprints is dealt
again by its remaining bits in the same way, up to three times, when at most 8
free bits are left: no cell is ever larger than CELL, and no pair is lost.

Wide fingerprints estimate similarity: of two sets of shingles with a Jaccard
similarity of s the cosine is 2 s / (1 + s), and a bit differs with the angle's
share of a half turn. They are met in tables of random bits; the number of bits
follows the number of fingerprints, the number of tables from the share of
links to be found. A cell of more than WIDE_CELL rows is cut into blocks, and
each two blocks meet in a task of their own.

Within a task the cells lie side by side. Bit planes are stored vertically, one
bit a fingerprint; for each shift d, plane XOR plane-shifted-by-d gives one bit
of the distance of all pairs (i, i + d) at once, and carry-save counters add
them up. Words whose 64 pairs all exceed the radius are abandoned. Only a star
for each local component leaves the task; stars are joined by large-star and
small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, annotate, buffer_of, docs_of, mixed, pieces, staged, table_of, texts_of

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
BLANK = table_of(lambda b: bytes([b]) in [SPACES[i : i + 1] for i in range(len(SPACES))])
RADIUS = 2
CELL = 2048
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Groups of 255 hashes whose bits are added up at once.
GROUPS = 256
#: Of the wide fingerprints: bits, words of a shingle, the least similarity of linked documents, the share of links of just that similarity that the tables find.
BITS, WORDS, SIMILARITY, FOUND = 512, 5, 0.8, 0.99
#: Mean rows of a cell, and rows of a cell that meet in one task.
MEAN_CELL, WIDE_CELL = 64, 4096


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of one buffer at once, from its published specification."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    w4 = np.ndarray((len(raw) - 3,), "<u4", buffer=raw, strides=(1,))
    with np.errstate(over="ignore"):
        s, n = np.uint64(seed), lengths.astype(np.int64)
        at, rest = starts.astype(np.int64).copy(), n & 31
        h = np.full(len(n), s + P5, np.uint64)
        wide = np.flatnonzero(n >= 32)
        if len(wide):
            acc = [np.full(len(wide), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            left, p = n[wide] // 32, at[wide]
            on = np.arange(len(wide))
            while len(on):
                for k in range(4):
                    acc[k][on] = _round(acc[k][on], w8[p[on] + 8 * k])
                p[on] += 32
                left[on] -= 1
                on = on[left[on] > 0]
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                v = (v ^ _round(np.zeros(len(wide), np.uint64), acc[k])) * P1 + P4
            h[wide], at[wide] = v, p
        h += n.astype(np.uint64)
        for _ in range(3):
            on = np.flatnonzero(rest >= 8)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), w8[at[on]]), 27) * P1 + P4
            at[on] += 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ (w4[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at[on] += 4
        rest[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(rest > 0)
            h[on] = _rotl(h[on] ^ (raw[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
            rest[on] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' word shingles, repeats included, and where each text's begin, with the end of all."""
    buf, bounds = buffer_of(texts)
    blank = BLANK[buf]
    before = np.concatenate([[True], blank[:-1]])
    words = np.diff(np.searchsorted(np.flatnonzero(~blank & before), bounds))
    kept = ~(blank & before)
    flat = np.where(blank[kept], np.uint8(32), buf[kept])
    ends = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    span = np.minimum(words, size)
    shingles = np.where(words > 0, words - span + 1, 0)
    edges = np.concatenate([[0], np.cumsum(shingles)])
    if not edges[-1]:
        return np.zeros(0, np.uint64), edges
    doc = np.repeat(np.arange(len(texts)), shingles)
    first = np.concatenate([[0], np.cumsum(words)])[doc] + np.arange(edges[-1]) - edges[doc]
    s = starts[first]
    return xxh64(flat, s, ends[first + span[doc] - 1] - s), edges


def majority(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each text the bits that over half its hashes have; no hashes give zero.

    Bits are unpacked to bytes and added eight columns at a time, 255 hashes a
    byte, some thousand hashes at once: a long text takes no more memory.
    """
    size = np.diff(edges)
    ones = np.zeros((len(size), 64), np.int64)
    groups = -(-size // 255)
    doc = np.repeat(np.arange(len(size)), groups)
    begin = edges[doc] + 255 * (np.arange(len(doc)) - np.repeat(np.cumsum(groups) - groups, groups))
    for at in range(0, len(doc), GROUPS):
        own, first = doc[at : at + GROUPS], begin[at : at + GROUPS]
        last = int(begin[at + GROUPS]) if at + GROUPS < len(doc) else len(h)
        bits = np.unpackbits(h[first[0] : last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits.view(np.uint64), first - first[0], axis=0).view(np.uint8)
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cut]] += np.add.reduceat(sums, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[bytes], size: int = 3) -> np.ndarray:
    """One fingerprint a text, of 64 bits."""
    return majority(*shingle_hashes(texts, size))


def wide_fingerprints(texts: list[bytes], size: int = WORDS) -> np.ndarray:
    """Fingerprints of BITS bits, a row of bytes each: the first 64 from the shingles' hashes, the others from what mixing makes of these."""
    h, edges = shingle_hashes(texts, size)
    parts = [majority(h if k == 0 else mixed(h + np.uint64(k * int(P5) & int(FULL))), edges) for k in range(BITS // 64)]
    return np.stack(parts, axis=1).astype("<u8").view(np.uint8).reshape(len(texts), BITS // 8)


def add_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "simhash", size: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Adds out_col, a struct with the fingerprint as a long. Null and blank texts have fingerprint zero."""
    fields = T.StructType([T.StructField("fingerprint", T.LongType())])
    return annotate(docs, text_col, out_col, fields, lambda: lambda texts: [fingerprints(texts, size).view(np.int64)], keep, limit=1 << 20)


def _blocks(free: list[int]) -> list[int]:
    """Masks of two of four blocks of the free bits, six in all."""
    cut = [free[len(free) * i // 4 : len(free) * (i + 1) // 4] for i in range(4)]
    return [sum(1 << b for b in (*cut[i], *cut[j])) for i, j in combinations(range(4), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shifted(plane: np.ndarray, d: int, words: np.ndarray) -> np.ndarray:
    """The named words of a plane moved down by d lanes."""
    w, r = words + d // 64, np.uint64(d % 64)
    return (plane[w] >> r) | (plane[w + 1] << (np.uint64(64) - r)) if r else plane[w]


def link_cells(cells: np.ndarray, prints: np.ndarray, mask: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, its component's first) among rows of the same cell; rows are sorted by cell."""
    change = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.concatenate([change, [len(cells)]]))
    some = np.flatnonzero(sizes > 1)
    if not len(some):
        return prints[:0], prints[:0]
    some = some[np.argsort(-sizes[some], kind="stable")]
    size = np.repeat(sizes[some], sizes[some])
    place = np.arange(len(size)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
    fp = prints[np.repeat(change[some], sizes[some]) + place]
    n = len(fp)
    width = (n + 63) // 64
    top = int(sizes[some[0]])
    planes = []
    for b in range(64):
        if not mask >> b & 1:
            packed = np.packbits(((fp >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            plane = np.zeros((width + top // 64 + 2) * 8, np.uint8)
            plane[: len(packed)] = packed
            planes.append(plane.view("<u8"))
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d in range(1, top):
        lanes = int(np.searchsorted(-size, -d))
        valid = np.zeros((lanes + 63) // 64 * 8, np.uint8)
        packed = np.packbits(place[:lanes] + d < size[:lanes], bitorder="little")
        valid[: len(packed)] = packed
        over = ~valid.view("<u8")
        words = np.flatnonzero(over != FULL)
        over = over[words]
        c0, c1 = np.zeros_like(over), np.zeros_like(over)
        for k, plane in enumerate(planes):
            x = plane[words] ^ _shifted(plane, d, words)
            carry = c0 & x
            c0 ^= x
            c1 |= carry
            over |= (c0 & c1, c1, c0)[RADIUS - radius]
            if k % 6 == 5:
                live = over != FULL
                if not live.all():
                    words, over, c0, c1 = words[live], over[live], c0[live], c1[live]
                    if not len(words):
                        break
        if not len(words):
            continue
        hit = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
        rows, cols = np.nonzero(hit)
        i = words[rows] * 64 + cols
        i = i[parent[i] != parent[i + d]]
        for a in i.tolist():
            p, q = root(a), root(a + d)
            if p != q:
                parent[max(p, q)] = min(p, q)
        if len(i):
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]
    own = np.flatnonzero(parent != np.arange(n))
    return fp[own], fp[parent[own]]


def _links_in_order(mask: int, radius: int):
    """A mapInArrow function over rows (cell, fp) sorted by cell; a cell that a batch cuts is carried over whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def made(c: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            a, b = link_cells(c, p.view(np.uint64), mask, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(cells) >= 1 << 16:
                cut = int(np.searchsorted(cells, cells[-1]))
                if cut:
                    yield made(cells[:cut], prints[:cut])
                    cells, prints = cells[cut:], prints[cut:]
        if len(cells):
            yield made(cells, prints)

    return run


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within radius bits; prints has one long column fp."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the tables hold for a radius of at most {RADIUS} bits")
    made, level = None, [(0, list(range(64)), prints.select(F.lit(0).cast("long").alias("cell"), "fp"))]
    for depth in range(3):
        after = []
        for mask, free, rows in level:
            for more in _blocks(free):
                new = mask | more
                dealt = rows.select(F.col("fp").bitwiseAND(F.lit(_signed(new))).alias("cell"), "fp")
                if depth < 2:
                    # Counts are combined before they are shuffled; cells over the limit are few or none.
                    big = staged(dealt.groupBy("cell").count().where(F.col("count") > cell).select("cell"), "cells")
                    if not big.isEmpty():
                        after.append((new, [b for b in free if not more >> b & 1], dealt.join(big, "cell", "left_semi")))
                        dealt = dealt.join(big, "cell", "left_anti")
                links = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links_in_order(new, radius), "a long, b long")
                made = links if made is None else made.unionByName(links)
        level = after
    return made


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for all nodes of links (a, b) but the roots; root is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer
    change. A hub's neighbours are never gathered: its least neighbour is a
    combinable minimum, joined back to its links.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = staged(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "simhash", keep: list[str] | None = None, radius: int = RADIUS) -> DataFrame:
    """Adds out_col: fingerprint and root (longs; the fingerprint that stands for the component), and component (smallest id of the texts reachable by links).

    Null or blank texts all have fingerprint zero and so form one component
    (with anything near zero). Repeated rows share their component. A null id
    takes part but never names a component unless all its ids are null. An
    empty table gives an empty result; other columns pass through.
    """
    keep = docs.columns if keep is None else keep
    marked = add_fingerprints(docs, text_col, out_col, keep=list(dict.fromkeys([*keep, id_col])))
    if text_col not in keep:
        marked = staged(marked, "marked")
    plain = staged(marked.select(F.col(f"`{id_col}`").alias("id"), F.col(out_col)["fingerprint"].alias("fp")).groupBy("fp").agg(F.min("id").alias("id")), "prints")
    roots = components(link_fingerprints(plain.select("fp"), radius))
    named = plain.join(roots, plain.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    classes = named.join(least, "root").select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component").alias("__component"))
    joined = marked.join(classes, marked[out_col]["fingerprint"] == classes["__fp"])
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.struct(F.col("__fp").alias("fingerprint"), F.col("__root").alias("root"), F.col("__component").alias("component")).alias(out_col))


def apart(similarity: float) -> float:
    """The share of bits in which the fingerprints of two sets of that Jaccard similarity differ, as expected."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def allowed(similarity: float) -> int:
    """Bits in which linked fingerprints may differ: what is expected at that similarity and a standard error."""
    p = apart(similarity)
    return int(BITS * p + (BITS * p * (1 - p)) ** 0.5)


def tables_for(n: int, similarity: float, found: float) -> list[np.ndarray]:
    """The bits of each table: so many that a cell has about MEAN_CELL of n fingerprints, and so many tables that a link of just that similarity shares a cell with probability found."""
    bits = max(8, ceil(log2(max(n, 1) / MEAN_CELL)))
    tables = ceil(log(1 - found) / log(1 - (1 - apart(similarity)) ** bits)) if similarity < 1 else 1
    rng = np.random.default_rng(11)
    return [rng.choice(BITS, bits, replace=False) for _ in range(tables)]


def _counter_added(counter: list[np.ndarray], x: list[np.ndarray]) -> np.ndarray:
    """Adds four planes to the counters by carry-save adders; the lanes in which the highest counter carries."""

    def full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = a ^ b
        return t ^ c, (a & b) | (t & c)

    counter[0], k = full(counter[0], x[0], x[1])
    counter[0], m = full(counter[0], x[2], x[3])
    counter[1], carry = full(counter[1], k, m)
    for i in range(2, len(counter)):
        carry, counter[i] = counter[i] & carry, counter[i] ^ carry
    return carry


def link_wide(cells: np.ndarray, nodes: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, its component's least) of the fingerprints of a cell within radius bits; rows are sorted by cell.

    Each cell's first row is held against all its rows before; what that
    connects lies side by side afterwards, and pairs known to be connected are
    not compared, so that a cell of like fingerprints costs one pass.
    """
    change = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(change, len(cells)))
    some = np.flatnonzero(sizes > 1)
    if not len(some):
        return nodes[:0], nodes[:0]
    some = some[np.argsort(-sizes[some], kind="stable")]
    size = np.repeat(sizes[some], sizes[some])
    head = np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
    rows = np.repeat(change[some], sizes[some]) + np.arange(len(size)) - head
    like = np.bitwise_count(prints[rows].view("<u8") ^ prints[rows[head]].view("<u8")).sum(axis=1, dtype=np.int64) <= radius
    order = np.lexsort((~like, head))
    rows, like = rows[order], like[order]
    n, top = len(rows), int(sizes[some[0]])
    place = np.arange(n) - head
    parent = np.where(like, head, np.arange(n))
    width = (n + 63) // 64
    planes = np.zeros((BITS, (width + top // 64 + 2) * 8), np.uint8)
    for at in range(0, BITS, 64):
        bits = np.unpackbits(np.ascontiguousarray(prints[rows, at // 8 : at // 8 + 8]), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        planes[at : at + 64, : packed.shape[1]] = packed
    planes = planes.view("<u8")
    depth = radius.bit_length()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d in range(1, top):
        lanes = int(np.searchsorted(-size, -d))
        fresh = place[:lanes] + d < size[:lanes]
        fresh[: n - d] &= parent[: min(lanes, n - d)] != parent[d : d + min(lanes, n - d)]
        packed = np.packbits(fresh, bitorder="little")
        valid = np.zeros((lanes + 63) // 64 * 8, np.uint8)
        valid[: len(packed)] = packed
        over = ~valid.view("<u8")
        words = np.flatnonzero(over != FULL)
        if not len(words):
            continue
        over = over[words]
        # Counters start so high that one more than radius carries out of the highest.
        start = (1 << depth) - 1 - radius
        counter = [np.full_like(over, FULL if start >> i & 1 else 0) for i in range(depth)]
        for b in range(0, BITS, 4):
            over |= _counter_added(counter, [planes[b + k][words] ^ _shifted(planes[b + k], d, words) for k in range(4)])
            if b % 16 == 12:
                live = over != FULL
                if not live.all():
                    words, over, counter = words[live], over[live], [c[live] for c in counter]
                    if not len(words):
                        break
        if not len(words):
            continue
        lane, bit = np.nonzero(np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64))
        for a in (words[lane] * 64 + bit).tolist():
            p, q = root(a), root(a + d)
            if p != q:
                parent[max(p, q)] = min(p, q)
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]
    own = np.flatnonzero(parent != np.arange(n))
    return nodes[rows[own]], nodes[rows[parent[own]]]


def _dealt(tables: list[np.ndarray]):
    """A mapInArrow function from (node, print) to a row for each table: cell, node, print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                for k, t in enumerate(tables):
                    cell = (bits[:, t] << np.arange(len(t))).sum(axis=1) << 12 | k
                    yield pa.RecordBatch.from_arrays([pa.array(cell), part.column("node"), part.column("print")], names=["cell", "node", "print"])

    return run


def _wide_links(radius: int):
    """A mapInArrow function over rows (cell, node, print) sorted by cell; a cell that a batch cuts is carried over whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, link_wide(*rows, radius))), names=["a", "b"])

        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8))
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "node")]
            raw = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            held = tuple(np.concatenate(x) for x in zip(held, (*new, raw), strict=True))
            if len(held[0]) >= 1 << 14:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield made(tuple(x[:cut] for x in held))
                    held = tuple(x[cut:].copy() for x in held)
        if len(held[0]):
            yield made(held)

    return run


def link_similar(prints: DataFrame, similarity: float = SIMILARITY, found: float = FOUND, cell: int = WIDE_CELL) -> DataFrame:
    """Links (a, b) between the nodes of distinct wide fingerprints, (node long, print binary), that are similar enough and share a cell of a table."""
    tables = tables_for(prints.count(), similarity, found)
    dealt = prints.select("node", "print").mapInArrow(_dealt(tables), "cell long, node long, print binary")
    big = staged(dealt.groupBy("cell").count().where(F.col("count") > cell).select("cell", F.ceil(F.col("count") / (cell // 2)).cast("int").alias("blocks")), "cells")
    if not big.isEmpty():
        # A row of a large cell goes to its block's meetings with every block.
        spread = dealt.join(big, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        met = spread.select("node", "print", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        parted = met.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "print")
        dealt = dealt.join(big, "cell", "left_anti").select("cell", "node", "print").unionByName(parted)
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_wide_links(allowed(similarity)), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """(id, th, group): each row's id, its text's hash and the number of its group, the documents reachable by links of that estimated similarity.

    Null and blank texts are alike and so one group; repeated rows share their
    group; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", 1 << 20):
                made = wide_fingerprints(texts_of(part, "t"), size)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array([x.tobytes() for x in made], pa.binary())], names=["id", "th", "print"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("t"))
    marked = staged(plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, th long, print binary"), "wide")
    prints = staged(marked.select("print").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(link_similar(prints, similarity))
    named = prints.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("group"))
    return marked.join(named, "print").select("id", "th", "group")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """One row of each group of similar documents, that of its smallest id, with all columns as they are.

    Of rows that repeat that id and text one stays; of several texts with that
    id the first by its hash. Rows without an id stay only where no row with an
    id is in their group. Null and blank texts are one group.
    """
    first = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    kept = similar_groups(docs, id_col, text_col, similarity, size).groupBy("group").agg(F.min(first).alias("k")).select(F.col("k.id").alias("__ki"), F.col("k.th").alias("__kt"))
    key = lambda i, t: F.xxhash64(i, t)  # noqa: E731  one column without nulls, by which the rows are dealt once
    kept = kept.withColumn("__kk", key("__ki", "__kt"))
    own = docs.withColumns({"__id": F.col(f"`{id_col}`"), "__th": F.xxhash64(F.col(f"`{text_col}`"))}).withColumn("__k", key("__id", "__th"))
    joined = own.join(kept, (F.col("__k") == F.col("__kk")) & F.col("__id").eqNullSafe(F.col("__ki")) & (F.col("__th") == F.col("__kt")), "left_semi")
    return joined.dropDuplicates(["__k", "__id", "__th"]).drop("__k", "__id", "__th")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs_of(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"], out_col="s")
    return found.select("doc_id", F.lower(F.lpad(F.hex("s.fingerprint"), 16, "0")).alias("fingerprint"), F.col("s.component").alias("component_id"))
