"""Named arrays in one block of bytes, which workers map into memory; and files on the shared folder, whatever its file system."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One block: a line that says where each array lies, then the arrays, each at a multiple of 8 bytes."""
    at, parts, head = 0, [], []
    for name, a in arrays.items():
        raw = a.tobytes()
        head.append(f"{name}:{a.dtype.str}:{at}:{len(a)}")
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    line = ",".join(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + b"".join(parts)


def view(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a block, without copying."""
    end = int(np.argmax(data[:4096] == 10)) + 1
    out = {}
    for item in bytes(data[:end]).decode().strip().split(","):
        name, kind, at, n = item.split(":")
        out[name] = data[end + int(at) : end + int(at) + int(n) * np.dtype(kind).itemsize].view(kind)
    return out


class Folder:
    """A folder below spark.checkpoint.dir as tasks see it. Files are published whole, by renaming, so that a repeated task finds them whole or not at all."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def names(self) -> list[str]:
        return [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))]

    def read(self, name: str) -> dict[str, np.ndarray]:
        """Arrays of a file: pages of a local file are mapped, so that only what is looked at is read; elsewhere the file is fetched."""
        at = f"{self.path}/{name}"
        if self.local:
            return view(np.asarray(np.memmap(at, np.uint8, "r")))
        with self.fs.open_input_file(at) as f:
            return view(np.frombuffer(f.read(), np.uint8))

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        self.fs.create_dir(self.path, recursive=True)
        temporary = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(pack(arrays))
        self.fs.move(temporary, f"{self.path}/{name}")

    def remove(self, names: list[str]) -> None:
        for name in names:
            try:
                self.fs.delete_file(f"{self.path}/{name}")
            except FileNotFoundError:
                pass
