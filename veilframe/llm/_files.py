"""Files in the shared folder, written and read by executors."""

from __future__ import annotations

import uuid

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system and path of a Hadoop URI; s3a and s3n are names that only Hadoop has for s3."""
    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest)


class Appender:
    """Writes files under names of their own: a repeated task never touches what another has written."""

    def __init__(self, folder: str, suffix: str, roll_bytes: int):
        self.fs, self.root = file_system(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder, self.suffix, self.roll_bytes, self.out = folder, suffix, roll_bytes, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        """Appends; returns (file, offset, length)."""
        if self.out is not None and self.at >= self.roll_bytes:
            self.close()
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return f"{self.folder}/{self.name}", self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Ranges:
    """Range reads with one open file at a time."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            system, path = file_system(name)
            self.name, self.file = name, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
