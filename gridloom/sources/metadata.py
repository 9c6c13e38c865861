"""Array metadata: Zarr v3 and v2 documents, or declared by hand."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from ..functions.codecs import REGISTRY
from ..functions.dtypes import coerced, numpy_type
from ..functions.layout import chunk_key, grid

#: Letters of v2 data types.
V2_KINDS = {"i": "int", "u": "uint", "f": "float"}
PLAIN = ({"name": "bytes", "configuration": {"endian": "little"}},)


@dataclass(frozen=True)
class ArrayMeta:
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codecs: tuple = PLAIN
    fill: object = None
    encoding: str = "default"
    separator: str | None = None
    attributes: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        object.__setattr__(self, "chunks", tuple(int(n) for n in self.chunks))
        object.__setattr__(self, "codecs", tuple(self.codecs))
        numpy_type(self.dtype)
        chunk_key([], self.encoding, self.separator)
        if len(self.shape) != len(self.chunks) or any(c < 1 for c in self.chunks):
            raise ValueError(f"chunks {self.chunks} don't fit the shape {self.shape}")
        for c in self.codecs:
            if c["name"] not in REGISTRY:
                raise ValueError(f"Unknown codec: {c['name']}")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def grid(self) -> list[int]:
        return grid(self.shape, self.chunks)

    def fill_scalar(self):
        """The fill value as the element type; zero where there is none."""
        return coerced([0 if self.fill is None else self.fill], self.dtype)[0]

    def with_chunks(self, chunks: Sequence[int]) -> ArrayMeta:
        return replace(self, chunks=tuple(chunks))

    def to_v3(self) -> str:
        key = {"name": self.encoding, "configuration": {"separator": self.separator or ("/" if self.encoding == "default" else ".")}}
        fill = self.fill
        if isinstance(fill, float) and not math.isfinite(fill):
            fill = "NaN" if fill != fill else "Infinity" if fill > 0 else "-Infinity"
        return json.dumps({"zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": self.dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.chunks)}}, "chunk_key_encoding": key, "codecs": list(self.codecs), "fill_value": fill, "attributes": self.attributes})


def from_v3(text: str | bytes) -> ArrayMeta:
    m = json.loads(text)
    key = m.get("chunk_key_encoding") or {"name": "default"}
    return ArrayMeta(m["shape"], m["chunk_grid"]["configuration"]["chunk_shape"], m["data_type"], m.get("codecs") or PLAIN, m.get("fill_value"), key["name"], (key.get("configuration") or {}).get("separator"), m.get("attributes") or {})


def from_v2(text: str | bytes) -> ArrayMeta:
    """Filters come before the compressor; F order is a transpose; big-endian types are stored so."""
    m = json.loads(text)
    found = re.fullmatch(r"([<>|])([iuf])([1248])", m["dtype"])
    if not found:
        raise ValueError(f"unsupported data type: {m['dtype']}")
    codecs = [{"name": "transpose", "configuration": {"order": "F"}}] if m.get("order") == "F" else []
    codecs.append({"name": "bytes", "configuration": {"endian": "big" if found[1] == ">" else "little"}})
    for c in [*(m.get("filters") or []), *([m["compressor"]] if m.get("compressor") else [])]:
        codecs.append({"name": c["id"], "configuration": {k: v for k, v in c.items() if k != "id"}})
    return ArrayMeta(m["shape"], m["chunks"], f"{V2_KINDS[found[2]]}{8 * int(found[3])}", codecs, m.get("fill_value"), "v2", m.get("dimension_separator") or ".")


def read_metadata(get: Callable[[str], bytes | None], declared: ArrayMeta | None = None) -> ArrayMeta:
    """From zarr.json, else .zarray, else as declared with plain little-endian bytes."""
    if (text := get("zarr.json")) is not None:
        return from_v3(text)
    if (text := get(".zarray")) is not None:
        return from_v2(text)
    if declared is None:
        raise FileNotFoundError("there is neither zarr.json nor .zarray, and no metadata was declared")
    return replace(declared, codecs=PLAIN, encoding="default", separator=None, fill=None)
