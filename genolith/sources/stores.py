"""Files by address, for workers and the driver: ranges of inputs, and streams of outputs, in the stores that pyarrow knows."""

from __future__ import annotations

import re

from pyarrow import fs

#: Schemes of addresses, and what pyarrow calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def known(path: str) -> bool:
    """Whether a file at ``path`` can be opened."""
    found = re.match(r"([a-z0-9]+):", path)
    return found is None or found[1] in SCHEMES


def _store(path: str) -> tuple[fs.FileSystem, str]:
    scheme, rest = path.split(":", 1) if re.match(r"[a-z0-9]+:", path) else ("file", path)
    if scheme not in SCHEMES:
        raise ValueError(f"{path} is in a store that can't be opened")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def open_input(path: str):
    """A file that can be read at any place."""
    store, name = _store(path)
    return store.open_input_file(name)


def open_output(path: str):
    """A stream to a new file, whose folder is made if need be."""
    store, name = _store(path)
    if "/" in name:
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(name)
