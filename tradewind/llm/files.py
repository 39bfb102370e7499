"""Opening files of the shared folder from a Python worker, whatever store it is in."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes, attempt: str) -> None:
    """Write a file under another name and move it into place, so that no reader sees a part
    of it and a repeated task attempt simply replaces it."""
    draft = f"{uri}.{attempt}.part"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(draft), "wb") as f:
            f.write(data)
        os.replace(_local(draft), path)
        return
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(_store(draft)[1]) as f:
        f.write(data)
    store.move(_store(draft)[1], path)


def read_whole(uri: str) -> bytes:
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            return f.read()
    store, path = _store(uri)
    with store.open_input_stream(path) as f:
        return f.read()
