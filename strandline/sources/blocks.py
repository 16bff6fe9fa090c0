"""Files by byte ranges, plain or as blocked gzip (BGZF)."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np


def opened(name: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(name) if ":" in name else (fs.LocalFileSystem(), name)


def whole(name: str) -> bytes | None:
    """All bytes of a file, None where there is no such file."""
    store, path = opened(name)
    if not store.get_file_info(path).is_file:
        return None
    with store.open_input_stream(path, compression=None) as file:
        return file.read()


class Blocks:
    """Bytes of an open blocked (or any multi-member) gzip file from a virtual offset on: a block's place in the file, shifted by
    16 bits, and a place in the block."""

    def __init__(self, file, at: int = 0):
        self.file, self.rest, self.inflate, self.inside = file, b"", zlib.decompressobj(31), False
        self.held, self.used, self.gone, self.taken = b"", 0, 0, at >> 16
        self.marks = deque([(0, at >> 16)])  # where blocks begin, here and in the file
        file.seek(at >> 16)
        self.read(at & 0xFFFF)

    def _more(self) -> bool:
        if not self.rest:
            self.rest = self.file.read(1 << 16)
            self.taken += len(self.rest)
            if not self.rest:
                if self.inside:
                    raise ValueError("gzip: the file ends inside a block")
                return False
        self.gone, self.held, self.used = self.gone + self.used, self.held[self.used :], 0
        self.held += self.inflate.decompress(self.rest)
        self.inside, self.rest = not self.inflate.eof, self.inflate.unused_data
        if not self.inside:
            self.inflate = zlib.decompressobj(31)
            self.marks.append((self.gone + len(self.held), self.taken - len(self.rest)))
        return True

    def read(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        while len(self.held) - self.used < n and self._more():
            pass
        out = self.held[self.used : self.used + n]
        self.used += len(out)
        return out

    def place(self) -> int:
        """The virtual offset of the next byte."""
        while self.used == len(self.held) and self._more():
            pass
        at = self.gone + self.used
        while len(self.marks) > 1 and self.marks[1][0] <= at:
            self.marks.popleft()
        return (self.marks[0][1] << 16) + at - self.marks[0][0]


class Ranges:
    """Byte ranges of an open file; of a blocked gzip file those of its content, by the .gzi index beside it."""

    def __init__(self, file, name: str):
        self.file, self.starts = file, None
        if file.read(2) == b"\x1f\x8b":
            raw = whole(f"{name}.gzi")
            if raw is None:
                raise ValueError(f"{name} is compressed and has no .gzi index")
            pairs = np.frombuffer(raw, "<u8", 2 * int.from_bytes(raw[:8], "little"), 8).reshape(-1, 2)
            self.starts = np.vstack([np.zeros((1, 2), "<u8"), pairs]).astype(np.int64)

    def read(self, at: int, n: int) -> bytes:
        if self.starts is None:
            self.file.seek(at)
            return self.file.read(n)
        place, start = self.starts[np.searchsorted(self.starts[:, 1], at, "right") - 1].tolist()
        content = Blocks(self.file, place << 16)
        content.read(at - start)
        return content.read(n)
