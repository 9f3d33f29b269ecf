"""ZIP archives as a data source: a partition for each member, or for some tens of MB of small archives.

The driver reads the central directory of each large archive; a task seeks to its member and unpacks it as a stream. So an
archive of many members is read by many tasks, none holds an archive or a member whole, and there is no limit on sizes.
Where there are more than FEW archives, the driver opens only the large ones: the small ones are dealt out by size, and a
task reads their directories itself, so a folder of very many archives takes no job of as many tasks.
Paths are those pyarrow knows: local files and the stores it has a client for; ``read_zip`` reads any store Spark does."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = 20_000  # lines handed on at once
FEW = 64  # of so many archives each member is a task of its own
SMALL = 4 << 20  # bytes of an archive that is not split
TASK = 32 << 20  # bytes of small archives for one task, OPENING added for each
OPENING = 64 << 10
SCHEMA = "archive string, member string, line_no long, line string"


@dataclass
class Members(InputPartition):
    """Archives, each with the member that is wanted, or None for all that fit the pattern."""

    parts: list[tuple[str, str | None]]


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else os.path.abspath(path))


def _opened(path: str) -> pa.NativeFile:
    store, place = located(path)
    return store.open_input_file(place)


def archives_at(path: str) -> list[tuple[str, int]]:
    """The archives a path names, with their bytes: a file, the *.zip files of a folder, or those that fit a pattern."""
    scheme = re.match(r"\w+:", path)
    base = re.split(r"[*?\[]", path)[0]
    store, root = located(base if base == path else base.rpartition("/")[0] or "/")
    if base == path and (only := store.get_file_info(root)).type == fs.FileType.File:
        return [(path, only.size)]
    wanted = f"{root.rstrip('/')}/{'*.zip' if base == path else path[len(base.rpartition('/')[0]) + 1 :]}"
    found = [(i.path, i.size) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
    here = sorted((p, n) for p, n in found if fnmatchcase(p, wanted) and p.count("/") == wanted.count("/"))
    # back to paths of the same store: what stands before the root
    before = (base if base == path else base.rpartition("/")[0]).rstrip("/").removesuffix(root.rstrip("/")) if scheme else ""
    return [(before + p, n) for p, n in here]


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").option("pattern", ...).option("charset", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.pattern = options.get("pattern", ".*")
        self.charset = options.get("charset", "ISO-8859-1")

    def partitions(self) -> list[Members]:
        archives = archives_at(self.path)
        small = [(a, n) for a, n in archives if n <= SMALL] if len(archives) > FEW else []
        unsplit = {a for a, _ in small}
        found = [Members([(a, m)]) for a, _ in archives if a not in unsplit for m in self._wanted(a)]
        # as many tasks as there would be of few archives, and more once these are full
        room = min(TASK, sum(n + OPENING for _, n in small) // FEW)
        filled = room
        for archive, n in small:
            if filled >= room:
                found.append(Members([]))
                filled = 0
            found[-1].parts.append((archive, None))
            filled += n + OPENING
        return found or [Members([])]

    def _wanted(self, archive: str) -> list[str]:
        wanted = re.compile(self.pattern)
        try:
            with _opened(archive) as file, zipfile.ZipFile(file) as packed:
                return [i.filename for i in packed.infolist() if not i.is_dir() and wanted.match(i.filename)]
        except (zipfile.BadZipFile, OSError, pa.ArrowException) as why:
            raise ValueError(f"{archive} is no sound archive: {why}") from why

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for archive, member in partition.parts:
            for name in self._wanted(archive) if member is None else [member]:
                for batch in self._lines(archive, name):
                    held.append(batch)
                    n += batch.num_rows
                    if n >= LINES:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def _lines(self, archive: str, member: str) -> Iterator[pa.RecordBatch]:
        with _opened(archive) as file, zipfile.ZipFile(file) as packed:
            with io.TextIOWrapper(packed.open(member), encoding=self.charset, newline="") as lines:
                numbered = enumerate(line.rstrip("\r\n") for line in lines)
                while chunk := list(islice(numbered, LINES)):
                    n = len(chunk)
                    columns = [
                        pa.array([archive] * n), pa.array([member] * n), pa.array([i for i, _ in chunk], pa.int64()),
                        pa.array([x for _, x in chunk], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["archive", "member", "line_no", "line"])
