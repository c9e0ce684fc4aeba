"""Whole files in the shared folder, by URI, read and written inside tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_folder(uri: str):
    """(file system, path) of a folder URI or plain path; the folder is created."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
    fs.create_dir(path, recursive=True)
    return fs, path


class Writer:
    """One file under a temporary name; ``close`` moves it into place, so a repeated task replaces it whole."""

    def __init__(self, folder: str, name: str):
        self.fs, path = open_folder(folder)
        self.final, self.temp = f"{path}/{name}", f"{path}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


def open_input(folder: str, name: str):
    fs, path = open_folder(folder)
    return fs.open_input_stream(f"{path}/{name}", compression=None)
