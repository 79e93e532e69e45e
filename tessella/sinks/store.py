"""Files from driver and executors in whatever store a path names, through Arrow's file systems."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import quote

from pyarrow import fs


def split(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; brackets and blanks in names stand for themselves."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@%")) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    store, at = split(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def write(path: str, *parts: bytes) -> None:
    """A whole file, under another name until it is complete: a task that dies or runs twice leaves no half of it."""
    store, at = split(path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    held = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(held) as f:
        for p in parts:
            f.write(p)
    store.move(held, at)


def move(path: str, to: str) -> None:
    """Renames a file or folder that is complete."""
    store, at = split(path)
    store.move(at, split(to)[1])


def remove(path: str) -> None:
    """Deletes a file or folder, if it is there."""
    store, at = split(path)
    kind = store.get_file_info(at).type
    if kind == fs.FileType.Directory:
        store.delete_dir(at)
    elif kind != fs.FileType.NotFound:
        store.delete_file(at)


def names(folder: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is not there."""
    store, at = split(folder)
    return [f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True))]


def unique_path(folder: str, name: str, extension: str) -> str:
    """name.extension, or with _2, _3 and so on before the extension if it is there (K6, K7)."""
    path, n = f"{folder}/{name}.{extension}", 2
    while exists(path):
        path, n = f"{folder}/{name}_{n}.{extension}", n + 1
    return path
