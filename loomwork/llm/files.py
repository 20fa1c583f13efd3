"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, of a URI (file:, hdfs:, s3:, gs:) or a plain local path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Output:
    """A new file that only its writer's successful attempt names: a repeated task writes another one."""

    def __init__(self, folder: str, prefix: str, suffix: str):
        self.name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
        system, path = located(folder)
        system.create_dir(path, recursive=True)
        self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends data; its offset."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


def reader(folder: str, name: str):
    """A file opened for reads at any place (read_at, read, seek)."""
    system, path = located(folder)
    return system.open_input_file(f"{path}/{name}")
