"""A stream of the lines that are appended to open log files: the offset is a byte position in each file.

Only whole lines leave a file; what stands behind the last line break waits for the next batch. The offset
is in the query's checkpoint, so a restarted query goes on behind the last line it has given out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mnemo.sources.readers import ENVELOPE

#: Bytes of a task's range, and of a step when the last line break of a file is looked for.
RANGE, STEP = 32 << 20, 1 << 16


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, floor: int, ceiling: int):
        self.file, self.start, self.end, self.floor, self.ceiling = file, start, end, floor, ceiling


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_lines(f, start: int, size: int) -> int:
    """The position behind the last line break between start and size; start if there is none."""
    end = size
    while end > start:
        low = max(start, end - STEP)
        f.seek(low)
        at = f.read(end - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        end = low
    return start


def lines_of(f, r: Range) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in a range: a line belongs to the range its first byte is in."""
    f.seek(r.start)
    at = r.start
    if r.start > r.floor:  # the line that reaches into this range began in the one before
        f.seek(r.start - 1)
        at = r.start - 1
        skipped = _until_break(f, r.ceiling - at)
        at += len(skipped)
    while at < r.end:
        line = _until_break(f, r.ceiling - at)
        if not line:
            return
        yield at, line.rstrip(b"\r\n")
        at += len(line)


def _until_break(f, most: int) -> bytes:
    """Bytes up to and with the next line break, at most so many."""
    start, got = f.tell(), b""
    while len(got) < most:
        part = f.read(min(STEP, most - len(got)))
        if not part:
            break
        at = part.find(b"\n")
        got += part if at < 0 else part[: at + 1]
        if at >= 0:
            break
    f.seek(start + len(got))
    return got


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Behind the last whole line of each file of the folder. Files that are gone keep no offset."""
        store, root = _open(self.path)
        out = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            if info.type == fs.FileType.File and not name.startswith((".", "_")):
                with store.open_input_file(info.path) as f:
                    out[name] = whole_lines(f, 0, info.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """A file that has become shorter was replaced and is read from its start."""
        out = []
        for name, to in sorted(end.items()):
            low = start.get(name, 0)
            low = low if low <= to else 0
            out += [Range(name, at, min(at + RANGE, to), low, to) for at in range(low, to, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, root = _open(self.path)
        with store.open_input_file(f"{root.rstrip('/')}/{partition.file}") as f:
            for at, line in lines_of(f, partition):
                yield partition.file, at, line.decode(errors="replace")

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mnemo_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def tail(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): lines appended to the files of a folder, each once."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("mnemo_tail").option("path", path).load()


def tail_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The event log as envelopes while it is being written, and its lines that are no envelopes (file, at, line)."""
    lines = tail(spark, path).where(F.trim("line") != "").withColumn("e", F.from_json("line", ENVELOPE))
    return lines.where("e.id is not null").select("e.*"), lines.where("e.id is null").select("file", "at", "line")


def position(query) -> dict:
    """The offsets a query has come to, by file."""
    return json.loads(query.lastProgress["sources"][0]["endOffset"]) if query.lastProgress else {}
