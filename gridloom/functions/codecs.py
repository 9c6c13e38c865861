"""Codecs by name, and pipelines of them.

A pipeline turns a chunk into bytes: array-to-array codecs first, one
array-to-bytes codec, then bytes-to-bytes ones; decoding goes back. A decoded
chunk is always in C order.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .dtypes import numpy_type

REGISTRY: dict[str, tuple[str, Callable]] = {}
COMPRESSIONS = ("gzip", "zlib", "blosc", "zstd", "lz4", "bz2", "lzma", "snappy")


def register(name: str, kind: str = "bytes_to_bytes"):
    """Adds a codec: a function of its configuration that gives (encode, decode)."""

    def add(make: Callable) -> Callable:
        REGISTRY[name] = (kind, make)
        return make

    return add


@register("gzip")
def _gzip(level: int = 5, **_):
    return lambda b: gzip.compress(b, level, mtime=0), gzip.decompress


@register("zlib")
def _zlib(level: int = 5, **_):
    return lambda b: zlib.compress(b, level), zlib.decompress


@register("bz2")
def _bz2(level: int = 5, **_):
    return lambda b: bz2.compress(b, level), bz2.decompress


@register("lzma")
def _lzma(**_):
    return lzma.compress, lzma.decompress


@register("zstd")
def _zstd(level: int = 3, **_):
    import zstandard

    def decode(b: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompressobj().decompress(b)

    return lambda b: zstandard.ZstdCompressor(level=level).compress(b), decode


@register("lz4")
def _lz4(**_):
    """A block behind its length, four bytes little-endian."""
    codec = pa.Codec("lz4_raw")
    return lambda b: len(b).to_bytes(4, "little") + codec.compress(b, asbytes=True), lambda b: codec.decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True)


@register("snappy")
def _snappy(**_):
    codec = pa.Codec("snappy")

    def length(b: bytes) -> int:
        n = shift = 0
        for x in b:
            n |= (x & 127) << shift
            if x < 128:
                return n
            shift += 7
        raise ValueError("broken snappy header")

    return lambda b: codec.compress(b, asbytes=True), lambda b: codec.decompress(b, length(b), asbytes=True)


def _raw_zstd(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress, lambda b, n: zstandard.ZstdDecompressor().decompress(b, n)


def _raw_arrow(name: str):
    codec = pa.Codec(name)
    return lambda b: codec.compress(b, asbytes=True), lambda b, n: codec.decompress(b, n, asbytes=True)


#: Fixed values of the Blosc frame: flags, and the numbers of the compressions inside.
BYTE_SHUFFLE, STORED, BIT_SHUFFLE, WHOLE_BLOCKS = 1, 2, 4, 16
INSIDE = {"lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
MOST_SPLITS, LEAST_SPLIT = 16, 128


def _inside(number: int, level: int = 5):
    """(compress, decompress to n bytes) of a Blosc frame's blocks."""
    if number == 1:
        return _raw_arrow("lz4_raw")
    if number == 2:
        return _raw_arrow("snappy")
    if number == 3:
        return lambda b: zlib.compress(b, level), lambda b, n: zlib.decompress(b, bufsize=n)
    if number == 4:
        return _raw_zstd(level)
    raise ValueError("blosc chunks packed by blosclz can't be decoded here")


def _shuffled(block: bytes, width: int, bits: bool, back: bool) -> bytes:
    """The bytes (or bits) of all elements side by side by their place in the element; back undoes it. What fills no element, or no eight, stays."""
    n = len(block) // width
    n -= n % 8 if bits else 0
    a, rest = np.frombuffer(block, np.uint8, n * width), block[n * width :]
    if not bits:
        out = (a.reshape(width, n) if back else a.reshape(n, width)).T
    elif back:
        planes = np.unpackbits(a.reshape(8 * width, n // 8), axis=1, bitorder="little")
        out = np.packbits(planes.T.reshape(n, width, 8), axis=2, bitorder="little")
    else:
        planes = np.unpackbits(a.reshape(n, width, 1), axis=2, bitorder="little").reshape(n, 8 * width)
        out = np.packbits(planes.T, axis=1, bitorder="little")
    return np.ascontiguousarray(out).tobytes() + rest


def _unblosc(b: bytes) -> bytes:
    flags, width = b[2], b[3]
    whole, size = int.from_bytes(b[4:8], "little"), int.from_bytes(b[8:12], "little")
    if flags & STORED:
        return b[16 : 16 + whole]
    unpack, out = _inside(flags >> 5)[1], []
    for k in range(-(-whole // size)):
        at, long = int.from_bytes(b[16 + 4 * k : 20 + 4 * k], "little"), min(size, whole - k * size)
        parted = not flags & WHOLE_BLOCKS and width <= MOST_SPLITS and size // width >= LEAST_SPLIT and long == size
        parts = width if parted else 1
        block = b""
        for _ in range(parts):
            n = int.from_bytes(b[at : at + 4], "little")
            part = b[at + 4 : at + 4 + n]
            block += part if n == long // parts else unpack(part, long // parts)
            at += 4 + n
        if width > 1 and flags & (BYTE_SHUFFLE | BIT_SHUFFLE):
            block = _shuffled(block, width, bool(flags & BIT_SHUFFLE), True)
        out.append(block)
    return b"".join(out)


@register("blosc")
def _blosc(cname: str = "lz4", clevel: int = 5, shuffle: int | str = 1, blocksize: int = 0, typesize: int = 1, **_):
    """Frames of the first version of the format; any inner compression but blosclz."""
    kind = shuffle if isinstance(shuffle, int) else ("noshuffle", "shuffle", "bitshuffle").index(shuffle)
    number = INSIDE.get(cname, 0)

    def encode(b: bytes) -> bytes:
        flags = WHOLE_BLOCKS | number << 5 | (0, BYTE_SHUFFLE, BIT_SHUFFLE)[kind]
        size = min(blocksize or 1 << 18, max(1, len(b)))
        head = lambda flags, total: bytes([2, 1, flags, typesize]) + b"".join(x.to_bytes(4, "little") for x in (len(b), size, total))
        pack, blocks = _inside(number, clevel)[0], []
        for at in range(0, len(b), size):
            block = b[at : at + size]
            block = _shuffled(block, typesize, kind == 2, False) if kind and typesize > 1 else block
            packed = pack(block)
            packed = packed if len(packed) < len(block) else block
            blocks.append(len(packed).to_bytes(4, "little") + packed)
        starts = np.cumsum([16 + 4 * len(blocks), *[len(x) for x in blocks]])
        if not blocks or starts[-1] >= 16 + len(b):
            return head(flags | STORED, 16 + len(b)) + b
        return head(flags, int(starts[-1])) + starts[:-1].astype("<u4").tobytes() + b"".join(blocks)

    return encode, _unblosc


@register("transpose", "array_to_array")
def _transpose(order="C", **_):
    def dims(a: np.ndarray) -> list[int]:
        return list(range(a.ndim)) if order == "C" else list(range(a.ndim))[::-1] if order == "F" else list(order)

    def decode(a: np.ndarray) -> np.ndarray:
        return a.transpose(np.argsort(dims(a)))

    def shape(s: Sequence[int]) -> list[int]:
        return [s[d] for d in dims(np.empty([0] * len(s)))]

    decode.shape = shape
    return lambda a: a.transpose(dims(a)), decode


@register("bytes", "array_to_bytes")
def _bytes(endian: str = "little", **_):
    return endian


@lru_cache(maxsize=256)
def _built(spec: str, dtype: str) -> tuple[list, list, str]:
    import json

    arrays, packs, endian = [], [], "little"
    for c in json.loads(spec):
        if c["name"] not in REGISTRY:
            raise ValueError(f"Unknown codec: {c['name']}")
        kind, make = REGISTRY[c["name"]]
        made = make(**(c.get("configuration") or {}))
        if kind == "array_to_array":
            arrays.append(made)
        elif kind == "array_to_bytes":
            endian = made
        else:
            packs.append(made)
    return arrays, packs, endian


class Pipeline:
    """Encodes and decodes chunks of one array."""

    def __init__(self, dtype: str, chunks: Sequence[int], codecs: Sequence[dict]):
        import json

        self.dtype, self.chunks = dtype, tuple(chunks)
        self.arrays, self.packs, endian = _built(json.dumps(list(codecs)), dtype)
        self.stored = numpy_type(dtype, endian)

    def encode(self, chunk: np.ndarray) -> bytes:
        for encode, _ in self.arrays:
            chunk = encode(chunk)
        data = np.ascontiguousarray(chunk.astype(self.stored)).tobytes()
        for encode, _ in self.packs:
            data = encode(data)
        return data

    def decode(self, data: bytes, edge: Sequence[int]) -> np.ndarray:
        """The part of a chunk within the array, whose shape is edge; it may be stored padded to the whole chunk or cut to edge."""
        for _, decode in reversed(self.packs):
            data = decode(data)
        flat = np.frombuffer(data, self.stored)
        shape = list(self.chunks if len(flat) == np.prod(self.chunks, dtype=np.int64) else edge)
        if len(flat) != np.prod(shape, dtype=np.int64):
            raise ValueError(f"a chunk has {len(flat)} elements; {list(self.chunks)} or {list(edge)} are expected")
        for _, decode in self.arrays:
            shape = decode.shape(shape)
        a = flat.reshape(shape)
        for _, decode in reversed(self.arrays):
            a = decode(a)
        return a[tuple(slice(0, e) for e in edge)].astype(numpy_type(self.dtype))


def zstd_content_size(data: bytes) -> int | None:
    """The decompressed size a Zstandard frame's header gives, if it does."""
    if len(data) < 6 or data[:4] != b"\x28\xb5\x2f\xfd":
        return None
    flags = data[4]
    single = flags >> 5 & 1
    width = {0: 1 if single else 0, 1: 2, 2: 4, 3: 8}[flags >> 6]
    at = 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3]
    if not width or at + width > len(data):
        return None
    return int.from_bytes(data[at : at + width], "little") + (256 if width == 2 else 0)


def blosc_content_size(data: bytes) -> int | None:
    """The decompressed size a Blosc header gives, if it is one."""
    if len(data) < 16 or data[0] not in (1, 2) or not 1 <= data[3] <= 8:
        return None
    whole, packed = int.from_bytes(data[4:8], "little"), int.from_bytes(data[12:16], "little")
    return whole if whole and packed and packed <= len(data) + 16 else None
