"""Whole files by URI (any file system that Arrow opens), for the binary formats."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs


def folder(uri: str, create: bool = False):
    """(file system, path) of a folder URI or an absolute path."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
    if create:
        fs.create_dir(path, recursive=True)
    return fs, path.rstrip("/")


def put(fs, path: str, payload: bytes) -> None:
    """Write under a temporary name, then move into place: a repeated task replaces the file whole."""
    head, _, name = path.rpartition("/")
    temp = f"{head}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(payload)
    fs.move(temp, path)


def get(fs, path: str, start: int = 0, size: int | None = None) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()


def get_json(fs, path: str):
    """A small JSON file, or None if absent."""
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    return json.loads(get(fs, path))


def list_files(fs, path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, sorted; hidden ones are left out."""
    infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.base_name.endswith(suffix) and not i.base_name.startswith((".", "_")))
