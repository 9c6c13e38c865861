"""Finding the real chunk shape where the declared one is wrong."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import product

from ..functions.codecs import COMPRESSIONS, blosc_content_size, zstd_content_size
from ..functions.layout import chunk_key, grid

#: Fixed values of the scoring: penalties and common chunk sizes.
NOT_POWER_OF_TWO, NOT_DIVIDING, TOO_LARGE, LAST_SMALLER = 10, 5, 1000, 20
COMMON_SIZES = (256, 128, 96, 64, 48, 32)
NEAR = (1, -1, 2, -2, 3, -3)


def score(shape: Sequence[int], declared: Sequence[int], array: Sequence[int]) -> int:
    """Lower is likelier."""
    out = 0
    for s, m, n in zip(shape, declared, array, strict=True):
        out += abs(s - m) + NOT_POWER_OF_TWO * (s & (s - 1) != 0) + NOT_DIVIDING * (n % s != 0) + TOO_LARGE * (s > n)
    return out + LAST_SMALLER * (len(shape) >= 2 and shape[-1] < shape[-2])


def candidates(elements: int, declared: Sequence[int], array: Sequence[int]) -> list[list[int]]:
    """Shapes of that many elements, likeliest first."""
    declared = list(declared)
    if elements == math.prod(declared):
        return [declared]
    found: dict[tuple, None] = {}
    rank = len(declared)

    def solve(known: dict[int, int], d: int, bound: Sequence[int] = range(rank)) -> None:
        """Completes a shape whose dimensions but d are known, if those of bound fit the array."""
        rest, left = divmod(elements, math.prod(known.values()))
        shape = tuple({**known, d: rest}[i] for i in range(rank))
        if not left and all(0 < shape[i] <= array[i] for i in bound):
            found.setdefault(shape)

    for d in range(rank):
        # Declared sizes may be larger than the array; that only costs them score.
        solve({i: c for i, c in enumerate(declared) if i != d}, d, [d])
    if rank == 3:
        for y, x in product(COMMON_SIZES, COMMON_SIZES):
            solve({1: y, 2: x}, 0)
        for d, near, common in product(range(3), NEAR, COMMON_SIZES):
            first, second = (i for i in range(3) if i != d)
            if declared[d] + near > 0:
                solve({d: declared[d] + near, first: common}, second)
    return [list(s) for s in sorted(found, key=lambda s: score(s, declared, array))]


def decompressed_size(data: bytes, codecs: Sequence[dict], decode: Callable[[bytes], bytes] | None = None) -> int | None:
    """From the header of the codec that is declared, the raw length if none compresses, or a full decode."""
    names = [c["name"] for c in codecs]
    size = zstd_content_size(data) if names[-1:] == ["zstd"] else blosc_content_size(data) if names[-1:] == ["blosc"] else None
    if size is not None:
        return size
    if not any(n in COMPRESSIONS for n in names):
        return len(data)
    try:
        return len(decode(data)) if decode else None
    except Exception:  # noqa: BLE001  a chunk that can't be decoded tells nothing
        return None


def validated(shape: Sequence[int], array: Sequence[int], exists: Callable[[str], bool], encoding: str = "default", separator: str | None = None) -> bool:
    """A shape is wrong if there is a chunk just beyond its grid, along the shortest dimension that has more than one chunk; a look that fails finds none."""
    counts = grid(array, shape)
    more = [d for d, n in enumerate(counts) if n > 1]
    if not more:
        return True
    d = min(more, key=lambda i: counts[i])
    beyond = [counts[d] if i == d else 0 for i in range(len(counts))]
    try:
        return not exists(chunk_key(beyond, encoding, separator))
    except Exception:  # noqa: BLE001  what can't be looked up isn't there
        return True


def probed(meta, first: Callable[[], bytes | None], exists: Callable[[str], bool], decode: Callable[[bytes], bytes] | None = None) -> list[int]:
    """The chunk shape by chunk 0's size, the scores and the probes; the declared one where nothing better is found or anything fails."""
    import numpy as np

    from ..functions.dtypes import numpy_type

    declared = list(meta.chunks)
    try:
        data = first()
        size = decompressed_size(data, meta.codecs, decode) if data else None
        width = np.dtype(numpy_type(meta.dtype)).itemsize
        if not size or size % width or size // width == math.prod(declared):
            return declared
        ranked = candidates(size // width, declared, meta.shape)
        return next((s for s in ranked[:5] if validated(s, meta.shape, exists, meta.encoding, meta.separator)), ranked[0] if ranked else declared)
    except Exception:  # noqa: BLE001  a probe that fails leaves the array as it is declared
        return declared
