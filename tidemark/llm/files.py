"""Plain files in a folder that all executors share, by local path or any URI that pyarrow.fs knows."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Output:
    """A file that appears under its name only when whole; a repeated task writes it anew."""

    def __init__(self, uri: str):
        self.fs, self.path = place(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex[:8]}.tmp"
        self.stream, self.size = self.fs.open_output_stream(self.draft), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.draft, self.path)


def read_range(uri: str, start: int, n: int) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        return f.read_at(n, start)


def read_all(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        return f.read()
