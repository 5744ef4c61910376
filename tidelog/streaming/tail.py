"""Growing and rotated log files as a stream of lines, every line once.

A file is known by its inode, so one that is renamed goes on where it stood and the new file of its name begins anew.
A file that has become shorter than what was read of it was cut off and begins anew too. Only whole lines are taken;
the rest of a file waits for its line break. What was read is the query's own checkpoint, so a batch that fails is
read again from the same places. Files lie in a folder that all machines share; a batch's bytes are cut into ranges,
which executors read by themselves.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one task, and bytes looked back at a time for a file's last line break.
RANGE, BACK = 32 * 1024 * 1024, 64 * 1024


def _line_end(path: str, start: int, size: int) -> int:
    """The end of the line that begins at ``start``; ``start`` if it has none within ``size`` bytes."""
    with open(path, "rb") as file:
        file.seek(start)
        line = file.readline(size - start)
    return start + len(line) if line.endswith(b"\n") else start


@dataclass
class Range(InputPartition):
    """A part of a file: lines that begin in it, or with it if ``first``."""

    path: str
    inode: str
    start: int
    end: int
    first: bool


def _whole_lines(path: str, size: int) -> int:
    """The end of the last whole line within the first ``size`` bytes."""
    with open(path, "rb") as file:
        while size > 0:
            begin = max(0, size - BACK)
            file.seek(begin)
            at = file.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("bytesPerTrigger", 0))
        self.read_to: dict[str, int] | None = None

    def _files(self) -> dict[str, tuple[str, int]]:
        found = {}
        for entry in os.scandir(self.folder):
            if entry.is_file() and fnmatch.fnmatchcase(entry.name, self.pattern):
                stat = entry.stat()
                found[str(stat.st_ino)] = (entry.path, stat.st_size)
        return found

    def initialOffset(self) -> dict:
        self.read_to = {}
        return {}

    def latestOffset(self) -> dict:
        left, out = self.most, {}
        for inode, (path, size) in sorted(self._files().items()):
            before = (self.read_to or {}).get(inode, 0)
            if before > size:
                before = 0
            upto = size
            if self.most and self.read_to is not None:  # unknown only for the first batch after a restart
                upto = min(size, before + max(left, 0))
            try:
                end = max(before, _whole_lines(path, upto)) if upto > before else before
                if before == end and before < upto < size:  # one line is longer than the bound
                    end = _line_end(path, before, size)
            except FileNotFoundError:
                continue
            left -= end - before
            out[inode] = end
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.read_to, files, out = dict(end), self._files(), []
        for inode, to in end.items():
            begin = start.get(inode, 0)
            if inode not in files or begin == to:
                continue
            begin = begin if begin < to else 0  # cut off since
            out += [Range(files[inode][0], inode, at, min(at + RANGE, to), at == begin) for at in range(begin, to, RANGE)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        path = part.path
        if not os.path.exists(path) or str(os.stat(path).st_ino) != part.inode:  # renamed since it was planned
            path = next((e.path for e in os.scandir(self.folder) if str(e.stat().st_ino) == part.inode), None)
            if path is None:
                raise FileNotFoundError(f"{part.path} is gone before it was read")
        with open(path, "rb") as file:
            file.seek(part.start)
            if not part.first:  # unless the range begins with a line, its first piece belongs to the range before
                file.seek(part.start - 1)
                file.readline()
            while file.tell() < part.end:
                at = file.tell()
                line = file.readline()
                yield (path, int(part.inode), at, line.rstrip(b"\n").decode("utf-8", "replace"))


class TailSource(DataSource):
    """Options: ``path`` (the folder), ``pattern`` of file names, ``bytesPerTrigger`` (0 for no bound; it doesn't bound
    the first batch after a restart)."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_tail"

    def schema(self) -> str:
        return "source string, inode long, at long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_growing(spark: SparkSession, folder: str, *, pattern: str = "*", bytes_per_trigger: int = 0) -> DataFrame:
    """Lines of growing and rotated files: ``source, inode, at`` (the byte at which the line begins) and ``value``."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tidelog_tail").option("pattern", pattern).option("bytesPerTrigger", str(bytes_per_trigger)).load(folder)
