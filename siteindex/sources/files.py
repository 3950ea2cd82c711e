"""A sink that writes each file from parts which may come from different tasks.

Rows are ``(file, start, total, text)``: the text, or its bytes, that begins at byte ``start`` of a
file of ``total`` bytes. A task that holds a whole file in order writes it and moves it into place. Of
other files a task leaves stretches beside the target and names them in its commit message; the
commit checks that the stretches of a file meet and appends them to one another in chunks. So
the driver holds names and numbers of split files alone, and readers never see half a file. A
task that is repeated writes the same bytes again; what a failed one left is removed at the end.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_CHUNK = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" not in path:
        return pafs.LocalFileSystem(), posixpath.abspath(path)
    return pafs.FileSystem.from_uri(path)


@dataclass
class Stretch:
    """Some bytes of a file, kept in a file of their own."""

    file: str
    start: int
    size: int
    total: int
    path: str


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves to be joined."""

    stretches: list[Stretch] = field(default_factory=list)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.beside = f"_parts-{uuid.uuid4().hex}"

    def _place(self, system: pafs.FileSystem, root: str, source: str, file: str) -> None:
        target = posixpath.join(root, file)
        system.create_dir(posixpath.dirname(target), recursive=True)
        if system.get_file_info(target).type != pafs.FileType.NotFound:
            system.delete_file(target)
        system.move(source, target)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        beside = posixpath.join(root, self.beside)
        system.create_dir(beside, recursive=True)
        done, stream, now = Written(), None, None

        def end():
            stream.close()
            if now.start == 0 and now.size == now.total:
                self._place(system, root, now.path, now.file)
            else:
                done.stretches.append(now)

        for batch in iterator:
            names = ("file", "start", "total", "text")
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for file, start, total, text in zip(*columns, strict=True):
                if now is None or now.file != file or now.start + now.size != start:
                    if now is not None:
                        end()
                    now = Stretch(file, start, 0, total, posixpath.join(beside, uuid.uuid4().hex))
                    stream = system.open_output_stream(now.path)
                data = text if isinstance(text, bytes) else text.encode()
                stream.write(data)
                now.size += len(data)
        if now is not None:
            end()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        files: dict[str, list[Stretch]] = {}
        for message in messages:
            for stretch in message.stretches if message else ():
                files.setdefault(stretch.file, []).append(stretch)
        for file, stretches in files.items():
            stretches.sort(key=lambda s: s.start)
            ends = [0, *(s.start + s.size for s in stretches)]
            if [s.start for s in stretches] + [stretches[0].total] != ends:
                raise ValueError(f"parts of {file} do not meet")
            joined = posixpath.join(root, self.beside, uuid.uuid4().hex)
            with system.open_output_stream(joined) as out:
                for stretch in stretches:
                    with system.open_input_stream(stretch.path) as source:
                        while chunk := source.read(_CHUNK):
                            out.write(chunk)
            self._place(system, root, joined, file)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, system: pafs.FileSystem, root: str) -> None:
        beside = posixpath.join(root, self.beside)
        if system.get_file_info(beside).type == pafs.FileType.Directory:
            system.delete_dir(beside)


class OrderedFiles(DataSource):
    """``df.write.format("ordered_files").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_files"

    def schema(self) -> str:
        return "file string, start bigint, total bigint, text string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])
