"""Python data sources for files that Spark's own sources cannot split, look into, or write.

``lakeloom_ranges`` reads files as byte ranges, so that one large file is the work of many tasks.
``lakeloom_media`` reads what the headers of media files say, by seeking; the content stays where it is.
``lakeloom_files`` writes rows of path and content as files.

They reach local and shared folders, and the stores that pyarrow has file systems for. ``register`` makes them known to a session.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Bytes of a range, and of the files that one task looks into.
BLOCK = 8 << 20


def file_system(path: str):
    """A pyarrow file system and the path in it; a path without scheme is local."""
    from pyarrow import fs

    if re.match("^[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def listing(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of a file or of all files under a folder, in order; names that begin with a dot or underline are no data."""
    from pyarrow import fs

    store, at = file_system(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [(found.path, found.size)]
    files = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


@dataclass
class Pieces(InputPartition):
    """``path, size, offset, length`` of the ranges of one task."""

    pieces: list[tuple[str, int, int, int]]


def packed(pieces: list[tuple[str, int, int, int]], most: int) -> list[Pieces]:
    """Consecutive ranges together, as long as they hold no more than ``most`` bytes; a file costs some bytes of its own."""
    out, size = [], most + 1
    for piece in pieces:
        cost = piece[3] + 4096
        if size + cost > most:
            out.append(Pieces([]))
            size = 0
        out[-1].pieces.append(piece)
        size += cost
    return out


class RangeReader(DataSourceReader):
    def __init__(self, path: str, block: int, task: int):
        self.path, self.block, self.task = path, block, task

    def partitions(self) -> list[InputPartition]:
        pieces = [(p, n, a, min(self.block, n - a)) for p, n in listing(self.path) for a in range(0, max(n, 1), self.block)]
        return packed(pieces, self.task) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        for path, size, offset, length in partition.pieces:
            with store.open_input_file(path) as f:
                f.seek(offset)
                data = f.read(length)
            if len(data) != length:
                raise OSError(f"{path} has changed while it was read")
            yield path, size, offset, data


class RangeSource(DataSource):
    """Files as rows ``path, size, offset, content``; an empty file is one empty row. Options: ``path``, ``block`` (bytes of a range), ``task`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "lakeloom_ranges"

    def schema(self) -> str:
        return "path string, size long, offset long, content binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("task", BLOCK)))


# Headers. Each parser gets a file that can seek and its size and returns what it found of MEDIA's columns.

MEDIA = "kind string, mime string, width int, height int, seconds double, channels int, rate int, error string"


def png(f, size: int) -> dict:
    f.seek(8)
    length, name, width, height = struct.unpack(">I4sII", f.read(16))
    if name != b"IHDR" or length != 13:
        raise ValueError("no image header")
    return {"kind": "image", "mime": "image/png", "width": width, "height": height}


def gif(f, size: int) -> dict:
    f.seek(6)
    width, height = struct.unpack("<HH", f.read(4))
    return {"kind": "image", "mime": "image/gif", "width": width, "height": height}


def jpeg(f, size: int) -> dict:
    at = 2
    while at + 4 <= size:
        f.seek(at)
        mark, kind, length = struct.unpack(">BBH", f.read(4))
        if mark != 0xFF:
            raise ValueError("no marker where one should be")
        if kind == 0xFF:  # fill
            at += 1
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            _, height, width, channels = struct.unpack(">BHHB", f.read(6))
            return {"kind": "image", "mime": "image/jpeg", "width": width, "height": height, "channels": channels}
        if kind == 0xDA:
            break
        at += 2 if 0xD0 <= kind <= 0xD9 or kind == 1 else 2 + length
    raise ValueError("no frame header")


def wav(f, size: int) -> dict:
    at, byte_rate, out = 12, 0, {"kind": "audio", "mime": "audio/x-wav"}
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            _, out["channels"], out["rate"], byte_rate = struct.unpack("<HHII", f.read(12))
        elif name == b"data":
            if not byte_rate:
                raise ValueError("samples before their format")
            out["seconds"] = min(length, size - at - 8) / byte_rate
            return out
        at += 8 + length + length % 2
    raise ValueError("no samples")


def boxes(f, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the content of each box between two places."""
    at = start
    while at + 8 <= end:
        f.seek(at)
        length, name = struct.unpack(">I4s", f.read(8))
        head = 8
        if length == 1:
            (length,), head = struct.unpack(">Q", f.read(8)), 16
        length = end - at if length == 0 else length
        if length < head or at + length > end:
            raise ValueError(f"box {name.decode('latin-1')} does not fit")
        yield name, at + head, at + length
        at += length


def mp4(f, size: int) -> dict:
    out, kinds = {"mime": "video/mp4"}, set()
    todo, seen = [(0, size)], False
    while todo:
        for name, a, b in boxes(f, *todo.pop()):
            if name in (b"moov", b"trak", b"mdia"):
                todo.append((a, b))
            elif name == b"mvhd":
                seen = True
                f.seek(a)
                data = f.read(32)
                scale, length = struct.unpack(">IQ", data[20:32]) if data[0] else struct.unpack(">II", data[12:20])
                out["seconds"] = length / scale if scale else None
            elif name == b"tkhd":
                f.seek(b - 8)
                width, height = (x >> 16 for x in struct.unpack(">II", f.read(8)))
                if width and height:
                    out |= {"width": width, "height": height}
            elif name == b"hdlr":
                f.seek(a + 8)
                kinds.add(f.read(4))
    if not seen:
        raise ValueError("no movie header")
    video = b"vide" in kinds
    return out | {"kind": "video" if video else "audio", "mime": "video/mp4" if video else "audio/mp4"}


def sniffed(head: bytes):
    """The parser for a file that begins with these bytes."""
    for parser, found in ((png, head.startswith(b"\x89PNG\r\n\x1a\n")), (jpeg, head.startswith(b"\xff\xd8\xff")), (gif, head[:6] in (b"GIF87a", b"GIF89a")), (wav, head[:4] == b"RIFF" and head[8:12] == b"WAVE"), (mp4, head[4:8] == b"ftyp")):
        if found:
            return parser
    return None


def media_info(f, size: int) -> dict:
    """What a file's headers say. Bytes that are no known header are text if they are UTF-8 without control characters, else unknown."""
    head = f.read(512)
    parser = sniffed(head)
    if parser:
        try:
            return parser(f, size)
        except (ValueError, struct.error) as e:
            return {"kind": "unknown", "error": f"{parser.__name__}: {e}"}
    if head[:5] == b"%PDF-":
        return {"kind": "pdf", "mime": "application/pdf"}
    whole = head.decode("utf-8", "ignore")
    plain = len(head) - len(whole.encode()) <= 3 and not re.search(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]", whole)
    if not plain:
        return {"kind": "unknown"}
    return {"kind": "text", "mime": "text/html" if re.match(r"(?i)\s*<(!doctype html|html)", whole) else "text/plain"}


class MediaReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self) -> list[InputPartition]:
        # headers cost a few reads a file, whatever its size
        return packed([(p, n, 0, min(n, 65536)) for p, n in listing(self.path)], self.block) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        names = [c.split()[0] for c in MEDIA.split(", ")]
        for path, size, _, _ in partition.pieces:
            with store.open_input_file(path) as f:
                found = media_info(f, size)
            yield path, size, *(found.get(n) for n in names)


class MediaSource(DataSource):
    """Media files as rows ``path, size, kind, mime, width, height, seconds, channels, rate, error``. Options: ``path``, ``block``."""

    @classmethod
    def name(cls) -> str:
        return "lakeloom_media"

    def schema(self) -> str:
        return "path string, size long, " + MEDIA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("block", BLOCK)))


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.at = path, (columns.index("path"), columns.index("content"))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        made = {root}
        for row in iterator:
            name, content = row[self.at[0]], row[self.at[1]]
            parts = [p for p in (name or "").split("/") if p]
            if not parts or ".." in parts:
                raise ValueError(f"not a path below the folder: {name!r}")
            folder = "/".join([root, *parts[:-1]])
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            # whole under another name first: a lost or repeated task leaves no half file
            own = f"{folder}/.{parts[-1]}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(bytes(content or b""))
            store.move(own, f"{folder}/{parts[-1]}")
        return WriterCommitMessage()


class FileSink(DataSource):
    """Writes rows ``path, content`` as files below the folder of the option ``path``; a path that exists is replaced."""

    @classmethod
    def name(cls) -> str:
        return "lakeloom_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    for source in (RangeSource, MediaSource, FileSink):
        spark.dataSource.register(source)
