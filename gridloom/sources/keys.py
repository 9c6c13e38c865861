"""Key stores: what holds an array's metadata and chunks under keys.

Executors open them, so a store is a small picklable value: an address, and the
options that every request takes. A key that isn't there gives None.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen


@lru_cache(maxsize=64)
def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class FileStore:
    """Files below a URI or a local path, on any file system that Arrow opens."""

    uri: str

    def _at(self, key: str):
        system, root = _opened(self.uri)
        return system, f"{root.rstrip('/')}/{key}"

    def get(self, key: str, **options) -> bytes | None:
        """options: buffer_size, compression and the like of an input stream."""
        system, at = self._at(key)
        try:
            with system.open_input_stream(at, **({"compression": None} | options)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, key: str, data: bytes) -> None:
        system, at = self._at(key)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at) as f:
            f.write(data)

    def exists(self, key: str) -> bool:
        from pyarrow import fs

        system, at = self._at(key)
        return system.get_file_info(at).type == fs.FileType.File


@dataclass(frozen=True)
class HttpStore:
    """What lies below a web address; for reading only."""

    url: str
    headers: dict = field(default_factory=dict, hash=False)

    def get(self, key: str, timeout: float = 60.0, headers: dict | None = None) -> bytes | None:
        request = Request(f"{self.url.rstrip('/')}/{quote(key)}", headers={**self.headers, **(headers or {})})
        try:
            with urlopen(request, timeout=timeout) as f:
                return f.read()
        except HTTPError as e:
            if e.code in (403, 404, 410):
                return None
            raise

    def put(self, key: str, data: bytes) -> None:
        raise OSError("an HTTP store can't be written")

    def exists(self, key: str) -> bool:
        return self.get(key) is not None


def store_of(address: str) -> FileStore | HttpStore:
    return HttpStore(address) if address.startswith(("http://", "https://")) else FileStore(address)


_numbers: dict[object, int] = {}


def store_id(store) -> str:
    """store_N, the same for the same address in this process."""
    return f"store_{_numbers.setdefault(store, len(_numbers))}"


def cache_key(store, path: str, key: str) -> str:
    """Names a chunk among all stores: store_N:/path:key."""
    return f"{store_id(store)}:/{path.strip('/')}:{key}"


@dataclass(frozen=True)
class Location:
    """An array's place in a store, and the options that its requests take."""

    store: object
    path: str = ""
    options: dict = field(default_factory=dict, hash=False)

    def name(self, key: str) -> str:
        return f"{self.path.strip('/')}/{key}".lstrip("/")

    def get(self, key: str) -> bytes | None:
        return self.store.get(self.name(key), **self.options)

    def put(self, key: str, data: bytes) -> None:
        self.store.put(self.name(key), data)

    def exists(self, key: str) -> bool:
        return self.store.exists(self.name(key))
