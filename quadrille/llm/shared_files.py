"""Files in the folder that all executors share, opened from Python workers by URI."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, suffix: str):
    """Yields (uri, stream) of a file no other attempt writes; half-written ones are never referred to."""
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as stream:
        yield uri, stream


class RangeReader:
    """Random reads of one shared file, keeping it open while the URI stays the same."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = opened(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None
