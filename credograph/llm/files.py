"""Plain files in the shared folder, written and read by tasks through Arrow's file systems.

A file appears under its name only when it is whole (a temporary name, then a rename), so a
task that is run twice or killed leaves either the same file or none.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

_OPEN: dict[tuple, np.ndarray] = {}


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{os.path.abspath(uri)}")


def make_folder(uri: str) -> None:
    store, path = at(uri)
    store.create_dir(path, recursive=True)


@contextlib.contextmanager
def writing(uri: str) -> Iterator:
    """A binary stream; the file gets its name if the block ends well."""
    store, path = at(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part, compression=None) as out:
            yield out
        store.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(part)
        raise


def reading(uri: str):
    """A seekable binary file."""
    store, path = at(uri)
    return store.open_input_file(path)


def delete_file(uri: str) -> None:
    store, path = at(uri)
    store.delete_file(path)


def local(uri: str) -> str:
    """A path of the file on this machine: itself if the folder is mounted here, else a copy of
    it, one for all workers of the machine, which they take from the shared folder as they need it."""
    store, path = at(uri)
    if isinstance(store, fs.LocalFileSystem):
        return path
    own = os.path.join(tempfile.gettempdir(), "credograph-copies", hashlib.sha256(uri.encode()).hexdigest())
    if not os.path.exists(own):
        os.makedirs(os.path.dirname(own), exist_ok=True)
        part = f"{own}.{uuid.uuid4().hex}.part"
        fs.copy_files(path, part, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        os.replace(part, own)
    return own


def write_array(uri: str, values: np.ndarray) -> None:
    with writing(uri) as out:
        out.write(np.ascontiguousarray(values).tobytes())


def mapped(uri: str, kind) -> np.ndarray:
    """The file's values, memory-mapped; a worker keeps its last maps open."""
    key = (uri, np.dtype(kind).str)
    if key not in _OPEN:
        if len(_OPEN) > 4096:
            _OPEN.clear()
        path = local(uri)
        _OPEN[key] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    return _OPEN[key]
