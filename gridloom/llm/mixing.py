"""Language-model scores by online logistic context mixing.

A text is a row of tokens: words, lower-cased, and one end. A token is coded in
bits. The first tells whether it is in the dictionary, the most frequent words
of the training texts; if so, the bits of its code, by halving, follow,
in an order that keeps words of like surroundings together; if not, the Huffman
codes of its bytes and a space. Hashed contexts predict each bit: for the dictionary the place in
the code, alone, with the surroundings (the last accented letter's byte, the
kind of the last word's last byte, or both) and with the previous word or two;
for spelled words the last one to four bytes and the word so far, partly with
the surroundings. A context's count
of zeros and ones gives a log-odds; the log-odds are added under weights that a
gate chooses by how much two of the contexts have seen, and adaptive maps
refine the sum. The probabilities of a token's bits multiply
to its own.

Counts come from all training texts: each task counts (word, surroundings,
previous words) within groups of tokens, and each of these pairs updates the
task's tables once with its count. Weights and maps are learned online in the
same pass, from the task's counts so far with one occurrence of the pair left
out. What no previous word enters is counted and looked up once a (word,
surroundings) key of some PAIRS pairs, in learning as in scoring. The tasks' tables are added up, their weights averaged by mass; the tables,
of fixed size, are broadcast. Scores of pairs are computed once for the texts of
a group.

The base score needs the exact count of every word: words of the dictionary
are broadcast, which bounds its size; all others are joined. Their counts also
join in the score: a spelled word's probability is its spelling's, by the share
of such tokens that were met once, and else its share of the counted ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, buffer_of, docs_of, mixed, pieces, prefix_sums, span_hashes, spans_of, staged, table_of, texts_of

BLANK = table_of(lambda b: b in SPACES)
#: Bits of the contexts' tables: six for the dictionary's codes, six for spelled words.
TABLES = (21, 21, 20, 21, 22, 22, 18, 20, 20, 21, 20, 20)
BASES = np.concatenate([[0], np.cumsum([1 << b for b in TABLES])])
SLOTS = int(BASES[-1])
#: The contexts of either kind of bit.
CODE, SPELL = (0, 1, 2, 3, 4, 5), (6, 7, 8, 9, 10, 11)
CONTEXTS = len(CODE)
#: Of CODE, the first that see no previous word.
SHARED = 4
BLOCK = 1 << 14
#: The block that holds what a task has learned besides counts.
LEARNED = -1
#: Bits of a code whose slots share a line of memory.
LINE = 4
ACCENTS, KINDS, RECENT = 18, 9, 12
CLASSES = ACCENTS * KINDS
GATES = 30
LEVELS = 32
#: Tokens that are gathered before their pairs are scored, and pairs a step.
TOKENS, PAIRS = 1_000_000, 20_000
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: Pairs between two changes of the weights.
STEP = 2500
#: Pairs of one key that are counted together.
SAME = 64
#: Words of the dictionary, at most.
FREQUENT = 1 << 20
#: Least count of a word of the dictionary; what is rarer teaches how words are spelled.
LEAST = 8
PRIOR = 0.15
PRIORS = np.float32(PRIOR)
RATE = 0.006
END = b"\n"


class Words:
    """The tokens of some texts: each token's text number, word number and class, and the distinct words' bytes. Word 0 is the end."""

    def __init__(self, texts: list[bytes]):
        buf, bounds = buffer_of(texts)
        starts, ends = spans_of(~BLANK[buf])
        doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
        h = span_hashes(prefix_sums(buf), starts, ends)
        sort = ordered(h)
        new = changes(picked(h, sort))
        first = picked(sort, np.flatnonzero(new))
        self.hashes = h[first]
        word = np.empty(len(h), np.int64)
        word[sort] = np.cumsum(new) - 1
        size = ends[first] - starts[first]
        at = np.cumsum(size) - size
        self.bytes = buf[np.arange(size.sum()) - np.repeat(at - starts[first], size)]
        self.size = size
        counts = np.bincount(doc, minlength=len(texts))
        # Held for many texts at once, so in 32 bits.
        self.doc = np.concatenate([doc, np.arange(len(texts))]).astype(np.int32)
        self.word = np.concatenate([word + 1, np.zeros(len(texts), np.int64)]).astype(np.int32)
        self.cls = self.surroundings(buf, starts, ends, doc, counts).astype(np.int32)
        self.before = self.previous(h, counts)
        self.n_tokens = counts + 1
        self.n_bytes = np.bincount(doc, ends - starts + 1, len(texts)).astype(np.int64) + 1

    @staticmethod
    def surroundings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For every word, then every text's end: the last accented letter within RECENT words and the kind of the last byte before it."""
        n, tail = len(starts), np.cumsum(counts)
        # A place for each word and, at the end, what a text's end has before it.
        first = tail - counts
        after = np.concatenate([np.arange(n), tail])
        begin = np.concatenate([np.repeat(first, counts), first])
        accent = np.flatnonzero((buf >= 0x80) & (buf < 0xC0))
        owner = np.searchsorted(starts, accent, "right") - 1
        last = np.full(n + 1, -1)
        value = np.zeros(n + 1, np.int64)
        value[owner + 1] = 1 + (buf[accent] & 63).astype(np.int64) % (ACCENTS - 1)
        last[owner + 1] = owner
        last = np.maximum.accumulate(last)
        near = last[after]
        a = np.where((near >= begin) & (near >= after - RECENT), value[near + 1], 0)
        byte = buf[ends - 1].astype(np.int64) if n else np.zeros(0, np.int64)
        kind = np.where((byte >= 0x30) & (byte <= 0x39) | (byte >= 0x61) & (byte <= 0x7A) | (byte >= 0x80), 0, np.where(byte == 0x2E, 1, np.where(byte == 0x2C, 2, np.where(byte == 0x21, 3, 4 + byte % 4))))
        kind = np.concatenate([[KINDS - 1], kind])
        return a * KINDS + np.where(after > begin, kind[after], KINDS - 1)


    @staticmethod
    def previous(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For every word, then every text's end: hashes of the one and of the two words before it, in 32 bits."""
        n, tail = len(h), np.cumsum(counts)
        after = np.concatenate([np.arange(n), tail])
        begin = np.concatenate([np.repeat(tail - counts, counts), tail - counts])
        padded = np.concatenate([np.zeros(2, np.uint64), h])
        one, two = (np.where(after - k >= begin, padded[after + 2 - k], np.uint64(k)) for k in (1, 2))
        return np.stack([_fold(one) >> np.uint64(32), _fold(one, two) >> np.uint64(32)]).astype(np.uint32).view(np.int32)


def merged(parts: list[Words]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct words of several parts: hashes, sizes, bytes, and for each part the numbers of its words; 0 is the end."""
    hashes, first, back = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    sizes, flat = np.concatenate([p.size for p in parts]), np.concatenate([p.bytes for p in parts])
    at = (np.cumsum(sizes) - sizes)[first]
    size = sizes[first]
    ends = np.cumsum(size)
    data = np.empty(int(size.sum()), np.uint8)
    for some in range(0, len(size), PAIRS):
        own = slice(some, some + PAIRS)
        low, high = ends[some] - size[some], ends[own][-1]
        data[low:high] = flat[np.arange(low, high) - np.repeat(ends[own] - size[own] - at[own], size[own])]
    edges = np.cumsum([0, *[len(p.hashes) for p in parts]])
    return hashes, size, data, [np.concatenate([[0], back[a:b] + 1]).astype(np.int32) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pair_keys(parts: list[Words], numbers: list[np.ndarray], words: int) -> np.ndarray:
    """word * CLASSES + class of every token of the parts, in 32 bits if the words' number allows it."""
    kind = np.int32 if (words + 1) * CLASSES < 1 << 31 else np.int64
    out, at = np.empty(sum(len(p.word) for p in parts), kind), 0
    for p, m in zip(parts, numbers, strict=True):
        own = out[at : at + len(p.word)]
        np.multiply(m[p.word], CLASSES, out=own, dtype=kind)
        own += p.cls
        at += len(p.word)
    return out


def grouped(keys: np.ndarray, before: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """The distinct (key, previous words) of some tokens: their keys, previous words, each token's place among them if places are asked for, and their counts."""
    h = _fold(keys, before[0].view(np.uint32), before[1].view(np.uint32))
    # As numpy's unique, with fewer arrays of all tokens at once.
    sort = ordered(h)
    new = changes(picked(h, sort))
    del h
    edges = np.flatnonzero(new).astype(np.int32)
    first, n = picked(sort, edges), np.diff(edges, append=np.int32(len(new)))
    del edges
    # By word, so that neighbours share their code and some slots.
    order = ordered(keys[first].astype(np.uint64) << np.uint64(len(first).bit_length()))
    back = None
    if places:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        back = np.empty(len(sort), np.int32)
        back[sort] = picked(rank, np.cumsum(new, dtype=np.int32) - np.int32(1))
    del sort, new
    first = first[order]
    return picked(keys, first), before.take(first, axis=1, mode="clip"), back, picked(n, order)


def ordered(values: np.ndarray) -> np.ndarray:
    """Places of 64-bit values in the order of the bits that a place's number leaves free, equal ones in their own order. Both are sorted as one number, which takes a sixth of argsort's time."""
    low = np.uint64((1 << len(values).bit_length()) - 1)
    both = values & ~low
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    both &= low
    return both.astype(np.int32)


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., n numbers for each, all in a row."""
    end = np.cumsum(n)
    out = np.repeat(first - end + n, n)
    out += np.arange(len(out))
    return out


class Dictionary:
    """Codes of the most frequent words by their hashes; the end's code stands apart."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, near: np.ndarray, ends: int, letters: np.ndarray):
        self.letters = huffman(letters)
        every = np.concatenate([[max(1, ends)], counts]).astype(np.float64)
        order = np.lexsort((np.concatenate([[0], hashes]), -every, np.concatenate([[-1], near])))
        length, code = halving(every[order])
        back = np.argsort(order)
        length, code = length[back], code[back]
        self.end = (length[0], code[0], max(1, ends) if ends else 0)
        self.order = np.argsort(hashes)
        self.hashes, self.counts = hashes[self.order], counts[self.order]
        self.length, self.code = length[1:][self.order], code[1:][self.order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, code length and code of the end and of each hash; length 0 if it isn't in the dictionary."""
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[place] == hashes
            found = [np.where(hit, x[place], 0) for x in (self.counts, self.length, self.code)]
        else:
            found = [np.zeros(len(hashes), np.int64)] * 3
        return tuple(np.concatenate([[e], x]) for e, x in zip((self.end[2], self.end[0], self.end[1]), found, strict=True))


def halving(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and code of each count by splits into two runs, as equal in their sums as can be; the order of the codes is that of the counts. A single count has one bit."""
    length, code = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(counts) == 1:
        return length + 1, code
    sums = np.concatenate([[0], np.cumsum(counts)])
    low, high = np.array([0]), np.array([len(counts)])
    while len(low):
        half = (sums[low] + sums[high]) / 2
        cut = np.searchsorted(sums, half)
        cut -= half - sums[np.maximum(cut - 1, 0)] < sums[np.minimum(cut, len(counts))] - half
        cut = np.clip(cut, low + 1, high - 1)
        inside = np.zeros(len(counts) + 1, np.int64)
        np.add.at(inside, low, 1)
        np.add.at(inside, high, -1)
        inside = np.cumsum(inside)[:-1]
        right = np.zeros(len(counts) + 1, np.int64)
        np.add.at(right, cut, 1)
        np.add.at(right, high, -1)
        length += inside
        code = (code << inside) | np.cumsum(right)[:-1]
        low, high = np.concatenate([low, cut]), np.concatenate([cut, high])
        more = high - low > 1
        low, high = low[more], high[more]
    return length, code


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and code of each byte by its count; bytes never met count as one."""
    heap = [(int(c) + 1, b, (b,)) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    length, code = np.zeros(256, np.int64), np.zeros(256, np.int64)
    while len(heap) > 1:
        (c, i, zeros), (d, _, ones) = heapq.heappop(heap), heapq.heappop(heap)
        code[list(ones)] |= 1 << length[list(ones)]
        length[list(zeros + ones)] += 1
        heapq.heappush(heap, (c + d, i, zeros + ones))
    return length, code


def _fold(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0)
    for p in parts:
        h = h ^ np.atleast_1d(p).astype(np.uint64)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(31)
    return h


def _short(*parts: np.ndarray | int) -> np.ndarray:
    return (_fold(*parts) >> np.uint64(32)).astype(np.uint32)


def _place(k: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot in table k of a context at a node of a code, both hashes of 32 bits. The nodes of the LINE bits that begin there differ from it in the last LINE bits only: they are met in one line of memory."""
    h = context ^ node
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - TABLES[k])
    out = h.astype(np.int64)
    out += BASES[k]
    return out


class Spelling:
    """The bytes of some words, a space after each, and their prefix sums."""

    def __init__(self, size: np.ndarray, data: np.ndarray):
        self.wide = size + 1
        self.flat = np.empty(int(self.wide.sum()), np.uint8)
        self.edges = np.cumsum(self.wide)
        self.flat[self.edges - 1] = 32
        inside = np.ones(len(self.flat), bool)
        inside[self.edges - 1] = False
        self.flat[inside] = data
        self.sums = prefix_sums(self.flat)


class Codes:
    """The bits of flag and code of some (word, surroundings) keys, and their slots in the contexts that see no previous word; these are the same for all previous words. Word 0 is the end."""

    def __init__(self, length: np.ndarray, code: np.ndarray, word: np.ndarray, cls: np.ndarray):
        own = length[word]
        # Place 0 is the flag, place 1 + i the code's bit i; a one stands before the code.
        self.n = own + 1
        lead = np.where(own > 0, (np.int64(1) << own) | code[word], 0)
        # Runs of LINE bits: their key, and how many bits are left from a run's first on.
        self.runs = -(-self.n // LINE)
        self.bits, self.lines = (np.cumsum(x) - x for x in (self.n, self.runs))
        key = np.repeat(np.arange(len(word)), self.runs)
        top = picked(self.n, key) - LINE * spread(np.zeros(len(word), np.int64), self.runs)
        lead = picked(lead, key)
        self.node, self.wide = _short(lead >> top), np.minimum(top, LINE)
        i = spread(np.zeros(len(key), np.int64), self.wide)
        left = np.repeat(top, self.wide) - i
        lead = np.repeat(lead, self.wide)
        self.bit = (lead >> (left - 1)) & 1
        # Where a bit's slot lies in its run's line.
        lead >>= left
        one = np.int64(1) << i
        lead &= one - 1
        lead |= one
        self.low = lead
        a, s = cls // KINDS, cls % KINDS
        contexts = _short(np.zeros_like(cls)), _short(1 + a), _short(101 + s), _short(201 + cls)
        self.slots = [np.repeat(_place(k, picked(c, key), self.node), self.wide) ^ lead for k, c in zip(CODE, contexts, strict=False)]

    def pairs(self, key: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of keys with previous words: how many bits each has, the place of each bit in this object's, and slots in the contexts of the previous words."""
        n, runs = picked(self.n, key), picked(self.runs, key)
        at, line = spread(picked(self.bits, key), n), spread(picked(self.lines, key), runs)
        node, wide, low = picked(self.node, line), picked(self.wide, line), picked(self.low, at)
        slots = []
        for k, b in zip(CODE[SHARED:], before, strict=True):
            context = np.repeat(_short(np.uint64(301 + k - SHARED), b.view(np.uint32)), runs)
            slots.append(np.repeat(_place(k, context, node), wide))
            slots[-1] ^= low
        return n, at, slots


def steps(letters: tuple[np.ndarray, np.ndarray], spelling: Spelling, length: np.ndarray, code: np.ndarray, word: np.ndarray, cls: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[int, ...], list[np.ndarray], np.ndarray]]:
    """The bits of some (word, surroundings, previous words) pairs, many at once: pair, contexts' numbers, slot in each context's table, bit. Word 0 is the end."""
    codes = Codes(length, code, word, cls)
    n, _, slots = codes.pairs(np.arange(len(word)), before)
    yield np.repeat(np.arange(len(word)), n), CODE, [*codes.slots, *slots], codes.bit
    which = np.flatnonzero(length[word] == 0)
    for pair, slots, bit in spelled(letters, spelling, word[which], cls[which]):
        yield picked(which, pair), SPELL, slots, bit


def spelled(letters: tuple[np.ndarray, np.ndarray], spelling: Spelling, word: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """The bits by which some (word, surroundings) keys are spelled, the first of all bytes, then the second and so on: key, slot in each context's table, bit."""
    if not len(word):
        return
    word = word - 1
    a, s = cls // KINDS, cls % KINDS
    n = spelling.wide[word]
    begin = spelling.edges[word] - n
    at = spread(begin, n)
    pair, begin = np.repeat(np.arange(len(word)), n), np.repeat(begin, n)
    i = at - begin
    byte = picked(spelling.flat, at)
    a, s, cls = picked(a, pair), picked(s, pair), picked(cls, pair)
    order = [span_hashes(spelling.sums, np.maximum(begin, at - k), at) + (i >= k).astype(np.uint64) for k in (1, 2, 3, 4)]
    prefix = span_hashes(spelling.sums, begin, at)
    contexts = [_short(order[0], 1 + a), _short(order[1], 101 + cls), _short(order[2], 301 + s), _short(order[3], 401), _short(prefix, 501 + a), _short(prefix, 601 + cls)]
    wide, own = picked(letters[0], byte), picked(letters[1], byte)
    place, lines = np.arange(len(pair)), []
    for b in range(int(wide.max())):
        on, i = np.flatnonzero(wide > b), b % LINE
        if len(on) < len(wide):
            pair, wide, own, place = picked(pair, on), picked(wide, on), picked(own, on), picked(place, on)
            lines = [picked(line, on) for line in lines] if i else []
        node = (1 << b) | (own >> (wide - b))
        if not i:
            lines = [_place(k, picked(c, place), _short(node)) for k, c in zip(SPELL, contexts, strict=True)]
        node = (1 << i) | (node & ((1 << i) - 1))
        yield pair, [line ^ node for line in lines], (own >> (wide - 1 - b)) & 1


def _met(texts: DataFrame) -> DataFrame:
    """(word, near, n) of the training texts, counted within groups of tokens; near is the last accented letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, _ in _groups(batches):
            _, size, data, numbers = merged(parts)
            keys = np.concatenate([m[p.word].astype(np.int64) * ACCENTS + p.cls // KINDS for p, m in zip(parts, numbers, strict=True)])
            keys.sort()
            edges = np.flatnonzero(changes(keys))
            keys, n = keys[edges], np.diff(edges, append=len(keys))
            for at in range(0, len(keys), PAIRS):
                own = keys[at : at + PAIRS]
                yield _rows(size, data, own // ACCENTS, [pa.array((own % ACCENTS).astype(np.int32)), pa.array(n[at : at + PAIRS])], ["near", "n"])

    return texts.mapInArrow(run, "word binary, near int, n long")


def _rows(size: np.ndarray, data: np.ndarray, word: np.ndarray, more: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """Rows whose first column holds the words' bytes, for the end a newline."""
    n = np.concatenate([[1], size])
    start = np.cumsum(n) - n
    flat = np.concatenate([np.frombuffer(END, np.uint8), data])
    own = n[word]
    out = flat[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - start[word], own)]
    offsets = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(out)]), *more], names=["word", *names])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[Words], list[pa.RecordBatch]]]:
    """The rows' words in groups of about TOKENS tokens, with the rows without their texts."""
    parts, rows, held = [], [], 0
    for batch in batches:
        for part in pieces(batch, "t", PIECE):
            parts.append(Words(texts_of(part, "t")))
            rows.append(part.drop_columns(["t"]))
            held += len(parts[-1].doc)
            if held >= TOKENS:
                yield parts, rows
                parts, rows, held = [], [], 0
    if parts:
        yield parts, rows


def _bits(batches: Iterator[pa.RecordBatch], dictionary: Dictionary, some: int) -> Iterator[tuple]:
    """Of each group of texts, some pairs at a time, spread over all words: their counts, and Spelling, lengths, codes, distinct keys' words and classes, each pair's key among these, its previous words.

    Pairs of one key stay together, SAME at most.
    """
    for parts, _ in _groups(batches):
        hashes, size, data, numbers = merged(parts)
        _, length, code = dictionary.find(hashes)
        keys, before = pair_keys(parts, numbers, len(size)), np.concatenate([p.before for p in parts], axis=1)
        # The group's tokens are not needed any more; _groups() holds the same list.
        parts.clear()
        del numbers
        keys, before, _, n = grouped(keys, before, places=False)
        spelling = Spelling(size, data)
        new = changes(keys)
        start = np.flatnonzero(new)
        new |= spread(np.zeros(len(start), np.int64), np.diff(start, append=len(keys))) % SAME == 0
        runs = -(-len(keys) // some)
        unit = np.cumsum(new, dtype=np.int32)
        del new, start
        dealt = (unit % runs).astype(np.uint16 if runs < 1 << 16 else np.int32)
        order, edges = np.argsort(dealt, kind="stable").astype(np.int32), np.cumsum([0, *np.bincount(dealt, minlength=runs)])
        del dealt
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            own = order[low:high]
            new = changes(unit[own])
            key = keys[own[new]].astype(np.int64)
            if len(own):
                yield n[own], (spelling, length, code, key // CLASSES, key % CLASSES, np.cumsum(new) - 1, before[:, own])
        # Nor are its pairs, while the next group's texts are cut into words.
        del hashes, size, data, length, code, keys, before, n, spelling, unit, order


def _hashed(words: list[bytes]) -> np.ndarray:
    buf, bounds = buffer_of(words, lower=False)
    return span_hashes(prefix_sums(buf), bounds[:-1], bounds[1:] - 1)


def _packed(counts: np.ndarray, kind: str) -> bytes:
    """Counts as integers of a kind, the bytes of equal weight together, compressed."""
    wide = np.ascontiguousarray(counts.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T)
    return pa.compress(wide, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, decompressed_size=2 * BLOCK * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _blocks(counts: np.ndarray) -> pa.RecordBatch:
    shaped = counts.reshape(-1, 2 * BLOCK)
    some = [i for i in range(len(shaped)) if shaped[i].any()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_packed(shaped[i], "<u4") for i in some], pa.binary())], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(x) if k == LEARNED else _unpacked(x, "<u4")
            if k not in sums:
                sums[k] = np.zeros(len(x))
            sums[k] += x
    for k, x in sums.items():
        out = x.tobytes() if k == LEARNED else _packed(halved(x.reshape(-1, 2)).ravel(), "<u2")
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out], pa.binary())], names=["block", "sums"])


def halved(counts: np.ndarray) -> np.ndarray:
    """Counts within 16 bits, with their proportions kept."""
    top = counts.max(axis=1, keepdims=True)
    return np.ceil(counts * np.minimum(1, 60_000 / np.maximum(top, 1))).astype(np.uint16)


def mixed_counts(texts: DataFrame, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zeros and ones that followed each slot, in 16 bits, SLOTS x 2; the tasks' mean weights by gate; the maps' zeros and ones."""
    shares = texts.mapInArrow(_mixed(shared), "block int, sums binary")
    found = shares.repartition("block").mapInArrow(_added, "block int, sums binary").toArrow()
    out, learned = np.zeros((SLOTS, 2), np.uint16), np.zeros(GATES * (CONTEXTS + 1 + 2 * LEVELS))
    for k, x in zip(found.column("block").to_pylist(), found.column("sums").to_pylist(), strict=True):
        if k == LEARNED:
            learned = np.frombuffer(x)
        else:
            at = k * BLOCK
            out[at : at + BLOCK] = _unpacked(x, "<u2").reshape(-1, 2)[: SLOTS - at]
    weights, mass, maps = np.split(learned, np.cumsum([GATES * CONTEXTS, GATES]))
    weights = np.where(mass[:, None] > 0, weights.reshape(GATES, CONTEXTS) / np.maximum(mass, 1)[:, None], start_weights())
    return out, weights, maps.reshape(-1, 2)


LOGS = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)
#: Levels of what a context has seen, and what they mean for the gate.
SEEN = np.array([0.5, 1.5, 3.5, 8.5, 60.5])
LEVEL_OF = np.searchsorted(SEEN, np.arange(62)).astype(np.uint8)
RICH, OTHER = np.array([0, 1, 2, 2, 3, 4]), np.array([0, 0, 0, 1, 1, 2])
#: The gate at a level of the richest context and six times that of the other.
GATE = (3 * RICH + OTHER[:, None]).ravel()


def evidence(n: np.ndarray) -> np.ndarray:
    """The level of each count."""
    return LEVEL_OF.take(n, mode="clip")


def gate(contexts: tuple[int, ...], rich: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Number of the weights: five levels of what the richest context has seen by three of another; spelled bits have their own."""
    return picked(GATE if contexts == CODE else GATE + GATES // 2, rich + 6 * other)


def deciding(contexts: tuple[int, ...]) -> tuple[int, int]:
    """The places of the two contexts that choose the gate."""
    return (5, 4) if contexts == CODE else (4, 1)


def picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at] of places that are known to be inside; numpy checks them fastest so."""
    return values.take(at, mode="clip")


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def level(x: np.ndarray) -> np.ndarray:
    return np.clip((x + 8) * (LEVELS / 16), 0, LEVELS - 1).astype(np.int64)


def start_weights() -> np.ndarray:
    w = np.full((GATES, CONTEXTS), 0.2)
    w[: GATES // 2] = (0.35, 0.2, 0.25, 0.2, 0.35, 0.35)
    return w


def _mixed(shared):
    """A mapInArrow function that reads this task's texts once: what follows each slot is counted, and weights and maps learn online from the counts so far.

    Gives the counts' blocks and, as block LEARNED, the weights by gate, times the mass behind them, the mass, and the maps' zeros and ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SLOTS, 2), np.float32)
        flat, both = counts.reshape(-1), counts.view(np.uint64).ravel()
        w, speed, mass = start_weights(), np.full((GATES, CONTEXTS), 1e-3), np.zeros(GATES)
        maps = np.zeros((GATES * LEVELS, 2))
        half = GATES // 2

        def met(slot: np.ndarray, less: tuple[np.ndarray, np.ndarray], one: np.ndarray, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
            """Counts some bits; what their slots now hold, and in x its log-odds but for one occurrence."""
            place = 2 * slot
            place += one
            np.add.at(flat, place, weight)
            n = picked(both, slot).view(np.float32).reshape(-1, 2)
            np.add(less[1], n[:, 1], out=x)
            x /= less[0] + n[:, 0]
            np.log(x, out=x)
            return n

        def learned(contexts: tuple[int, ...], x: np.ndarray, seen: list[np.ndarray], told: np.ndarray, one: np.ndarray, weight: np.ndarray) -> None:
            """One change of the weights by some bits, of which maps learn too."""
            first = 0 if contexts == CODE else half
            g = gate(contexts, *seen)
            g -= first
            part = w[first : first + half].T.astype(np.float32).take(g, axis=1, mode="clip")
            part *= x
            total = part.sum(axis=0)
            np.clip(total, -12, 12, out=total)
            place = level(total)
            place += g * LEVELS
            place *= 2
            place += one
            found = np.bincount(place, weight, half * LEVELS * 2).reshape(-1, 2)
            maps[first * LEVELS : (first + half) * LEVELS] += found
            m = found.reshape(half, -1).sum(axis=1)
            off = told - squash(total)
            off *= weight
            np.multiply(x, off, out=part)
            # Neighbours mostly have one gate; a sum need not wait for the one before if four take turns.
            g *= 4
            g += np.arange(len(g)) & 3
            slope = np.array([np.bincount(g, k, 4 * half) for k in part]).reshape(CONTEXTS, half, 4).sum(axis=2).T / np.maximum(m, 1)[:, None]
            speed[first : first + half] += slope * slope
            w[first : first + half] += RATE * slope / np.sqrt(speed[first : first + half])
            mass[first : first + half] += m

        def left_out(told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What is added to zeros and ones: the prior, less the occurrence itself."""
            return PRIORS - 1 + told, PRIORS - told

        def evident(n: np.ndarray) -> np.ndarray:
            return evidence((n[:, 0] + n[:, 1]).astype(np.int64) - 1)

        for n, (spelling, length, code, word, cls, key, before) in _bits(batches, shared.value, PAIRS):
            n = n.astype(np.float32)
            codes = Codes(length, code, word, cls)
            sums = np.bincount(key, n).astype(np.float32)
            told, weight = codes.bit.astype(np.float32), np.repeat(sums, codes.n)
            alike, less = np.empty((SHARED, len(told)), np.float32), left_out(told)
            for x, slot in zip(alike, codes.slots, strict=True):
                met(slot, less, codes.bit, weight, x)
            runs = -(-len(n) // STEP)
            for i in range(runs):
                own = slice(i, None, runs)
                wide, at, slots = codes.pairs(key[own], before[:, own])
                one, some, weight = picked(codes.bit, at), picked(told, at), np.repeat(n[own], wide)
                x = np.empty((CONTEXTS, len(at)), np.float32)
                alike.take(at, axis=1, out=x[:SHARED], mode="clip")
                less = left_out(some)
                found = [met(slot, less, one, weight, k) for slot, k in zip(slots, x[SHARED:], strict=True)]
                learned(CODE, x, [evident(found[k - SHARED]) for k in deciding(CODE)], some, one, weight)
            which = np.flatnonzero(length[word] == 0)
            for pair, slots, one in spelled(shared.value.letters, spelling, word[which], cls[which]):
                some, weight = one.astype(np.float32), picked(sums, picked(which, pair))
                x = np.empty((CONTEXTS, len(one)), np.float32)
                less = left_out(some)
                found = [met(slot, less, one, weight, k) for slot, k in zip(slots, x, strict=True)]
                seen = [evident(found[k]) for k in deciding(SPELL)]
                # As many changes as of the weights of codes.
                edges = np.arange(runs + 1) * len(one) // runs
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    if high > low:
                        learned(SPELL, x[:, low:high], [k[low:high] for k in seen], some[low:high], one[low:high], weight[low:high])
        yield _blocks(counts)
        more = np.concatenate([(w * mass[:, None]).ravel(), mass, maps.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([LEARNED], pa.int32()), pa.array([more.tobytes()], pa.binary())], names=["block", "sums"])

    return run


#: Steps of the log-odds from -12 to 12 in the table of costs; no step reaches over two of the maps' levels, which are a half wide.
FINE = 48 * 680
#: Log-odds are kept as multiples of its inverse in 8 bits.
ODDS = 9


class Model:
    """What scoring needs: log-odds and evidence of every slot, weights by gate, maps."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, maps: np.ndarray, dictionary: Dictionary, rare: int = 0, once: int = 0):
        self.dictionary = dictionary
        # Tokens of the words that are counted but have no code, and the share of such tokens to come that is known: all but what was met once.
        self.rare, self.known = rare, 1 - max(once, 1) / max(rare, 1)
        # Side by side, as both are wanted of the deciding contexts.
        self.both = np.empty((SLOTS, 2), np.int8)
        for at in range(0, SLOTS, 1 << 20):
            c = counts[at : at + (1 << 20)]
            self.both[at : at + (1 << 20), 0] = np.rint(ODDS * (LOGS[c[:, 1]] - LOGS[c[:, 0]]))
            self.both[at : at + (1 << 20), 1] = evidence(c.sum(axis=1, dtype=np.int64))
        self.weights = weights
        middle = squash((np.arange(LEVELS) + 0.5) * 16 / LEVELS - 8)
        self.maps = ((maps[:, 1] + 20 * np.tile(middle, GATES)) / (maps.sum(axis=1) + 20)).astype(np.float64)

        # Log10 probabilities of both bits by gate and log-odds, in fine steps.
        x = (np.arange(FINE) + 0.5) * 24 / FINE - 12
        self.costs = np.empty((GATES, FINE, 2), np.float32)
        for g in range(GATES):
            p = np.clip(0.5 * squash(x) + 0.5 * self.maps[g * LEVELS + level(x)], 1e-6, 1 - 1e-6)
            self.costs[g] = np.log10(np.stack([1 - p, p], axis=1))

    def told(self, size: np.ndarray, data: np.ndarray, length: np.ndarray, code: np.ndarray, word: np.ndarray, cls: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log10 probability of each (word, surroundings, previous words) pair, as two summands: of its code or, if it has none, of that; of its spelling."""
        out = np.zeros((2, len(word)))
        scaled = (self.weights.T * (FINE / 24 / ODDS)).astype(np.float32)
        costs, both = self.costs.ravel(), self.both.view(np.uint16).ravel()

        def bits(contexts: tuple[int, ...], odds: list[np.ndarray], seen: list[np.ndarray], one: np.ndarray) -> np.ndarray:
            g = gate(contexts, *seen)
            total = np.full(len(one), FINE / 2, np.float32)
            for k, x in enumerate(odds):
                part = picked(scaled[k], g)
                part *= x
                total += part
            np.clip(total, 0, FINE - 1, out=total)
            g *= FINE
            g += total.astype(np.int64)
            g *= 2
            g += one
            return picked(costs, g)

        for start in range(0, len(word), PAIRS):
            own = slice(start, start + PAIRS)
            new = changes(word[own]) | changes(cls[own])
            codes = Codes(length, code, word[own][new], cls[own][new])
            alike = [picked(both, slot).view(np.int8)[::2].astype(np.float32) for slot in codes.slots]
            n, at, slots = codes.pairs(np.cumsum(new) - 1, before[:, own])
            found = [picked(both, slot).view(np.int8) for slot in slots]
            told = bits(CODE, [*[picked(x, at) for x in alike], *[x[::2] for x in found]], [found[k - SHARED][1::2] for k in deciding(CODE)], picked(codes.bit, at))
            out[0, own] = np.add.reduceat(told, np.cumsum(n) - n, dtype=np.float64)
        rare = np.flatnonzero(length[word] == 0)
        spelling = Spelling(size, data)
        for start in range(0, len(rare), PAIRS):
            own = rare[start : start + PAIRS]
            for pair, slots, one in spelled(self.dictionary.letters, spelling, word[own], cls[own]):
                found = [picked(both, slot).view(np.int8) for slot in slots]
                out[1, own] += np.bincount(pair, bits(SPELL, [x[::2] for x in found], [found[k][1::2] for k in deciding(SPELL)], one), len(own))
        return out

    @property
    def odds(self) -> np.ndarray:
        return self.both[:, 0]

    @property
    def seen(self) -> np.ndarray:
        return self.both[:, 1]


def train(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT) -> tuple[Model, DataFrame, tuple[int, int]]:
    """The model of all texts given; the staged (word, n) counts of the words that its dictionary lacks; the numbers of tokens and of distinct tokens."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(f"`{text_col}`").alias("t"))
    near = _met(texts).repartition("word").groupBy("word", "near").agg(F.sum("n").alias("n"))
    words = staged(near.groupBy("word").agg(F.sum("n").alias("n"), (F.max(F.col("n") * ACCENTS + F.col("near")) % ACCENTS).cast("int").alias("near")), "words")
    ends, total, distinct = words.agg(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.sum("n"), F.count("*")).first()
    plain = words.where(F.col("word") != F.lit(END))
    least = _least(plain, frequent)
    found = plain.where(F.col("n") >= least).toArrow()
    spelled = plain.where(F.col("n") < least).select("word").mapInArrow(_letters, "sums binary").toArrow()
    letters = sum((np.frombuffer(x, np.int64) for x in spelled.column("sums").to_pylist()), np.zeros(256, np.int64))
    dictionary = Dictionary(_hashed(found.column("word").to_pylist()), found.column("n").to_numpy(), found.column("near").to_numpy(), ends or 0, letters)
    shared = sc.broadcast(dictionary)
    counts, weights, maps = mixed_counts(texts, shared)
    rest = plain.where(F.col("n") < least).select("word", "n")
    rare, once = rest.agg(F.sum("n"), F.count_if(F.col("n") == 1)).first()
    model = Model(counts, weights, maps, dictionary, rare or 0, once)
    shared.unpersist()
    return model, rest, (total or 0, distinct)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte stands in this task's words and the spaces after them."""
    sums = np.zeros(256, np.int64)
    for batch in batches:
        words = batch.column("word").to_pylist()
        sums += np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], names=["sums"])


def _least(words: DataFrame, limit: int) -> int:
    """The least power of two, LEAST or more, such that at most limit words have that count."""
    sizes = {r.k: r["count"] for r in words.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}
    total, least = 0, 1 << (max(sizes, default=0) + 1)
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > limit:
            break
        least = 1 << k
    return max(LEAST, least)


def score_texts(docs: DataFrame, model: Model, rest: DataFrame, trained: tuple[int, int], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns and out: n_tokens, n_known, n_bytes, train_tokens, base_score, score and bits_per_byte.

    A null or empty text is its end alone; repeated rows are scored each; with
    an empty training set all counts are 0; other columns pass through if keep
    names them.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    names = [f"c{i}" for i in range(len(keep))]
    total, distinct = trained
    below = float(np.log10(total + (distinct + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        part, row = TaskContext.get().partitionId(), 0
        for parts, rows in _groups(batches):
            hashes, size, data, numbers = merged(parts)
            count, length, code = model.dictionary.find(hashes)
            rare = length == 0
            keys, before, back, _ = grouped(pair_keys(parts, numbers, len(size)), np.concatenate([p.before for p in parts], axis=1))
            for p in parts:
                p.before = p.cls = None
            known, spelled = model.told(size, data, length, code, keys // CLASSES, keys % CLASSES, before)
            at = 0
            for p, m, own in zip(parts, numbers, rows, strict=True):
                n = own.num_rows
                word = m[p.word]
                pair = back[at : at + len(word)]
                score = np.bincount(p.doc, np.where(rare[word], 0, known[pair]), n)
                at += len(word)
                base = np.bincount(p.doc, np.log10(count[word] + 1), n)
                seen = np.bincount(p.doc, count[word] > 0, n).astype(np.int64)
                ids = row + np.arange(n)
                row += n
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in names], pa.array(np.full(n, part)), pa.array(ids), *map(pa.array, (p.n_tokens, seen, p.n_bytes, base, score)), nothing], names=[*names, "part", "row", "n", "known", "bytes", "base", "score", "word"])
                # Words that are not broadcast: one row a text and pair, for the join.
                odd = np.flatnonzero(rare[word])
                if len(odd):
                    left, first, tf = np.unique(p.doc[odd].astype(np.int64) * len(keys) + pair[odd], return_index=True, return_counts=True)
                    of, which = left // len(keys), left % len(keys)
                    words_only = _rows(size, data, word[odd[first]], [], [])
                    k = len(left)
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(k, own.column(c).type) for c in names], pa.array(np.full(k, part)), pa.array(ids[of]), pa.array(tf), *[pa.nulls(k, pa.int64())] * 2, pa.array(known[which]), pa.array(spelled[which]), words_only.column("word")], names=[*names, "part", "row", "n", "known", "bytes", "base", "score", "word"])

    head = "".join(f"{n} {plain.schema[n].dataType.simpleString()}, " for n in names)
    made = staged(plain.mapInArrow(run, f"{head}part long, row long, n long, known long, bytes long, base double, score double, word binary"), "scored")
    rare = made.where("word is not null").select("part", "row", "n", "base", "score", "word").join(rest.withColumnRenamed("n", "c"), "word", "left")
    # base holds the flag's log10 probability, score that of the spelling.
    mix = F.lit(1 - model.known) * F.pow(F.lit(10.0), "score") + (F.coalesce("c", F.lit(0)) * F.lit(model.known / max(model.rare, 1)))
    told = F.col("base") + F.greatest(F.log10(mix), F.col("score") + F.lit(float(np.log10(1 - model.known))))
    more = rare.groupBy("part", "row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"), F.sum(F.col("n") * told).alias("more_score"))
    whole = made.where("word is null").join(more, ["part", "row"], "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    out = F.struct(
        F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.col("bytes").alias("n_bytes"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n") * F.lit(below)).alias("base_score"), score.alias("score"), (-score * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )
    return whole.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], out.alias("out"))


HELD_OUT = "crc32(coalesce(cast(doc_id as string), '')) % 7 = 2"


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    scored = score_texts(docs, *train(docs.where(f"not ({HELD_OUT})")), keep=["doc_id"])
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "out.n_tokens", "out.n_known", "out.train_tokens", "out.base_score", "out.score", "out.bits_per_byte")
