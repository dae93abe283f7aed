"""A stream source for logs that grow: its offsets are bytes of files, so that only what was added is read.

The files lie where pyarrow's file systems reach them: a mounted folder, S3, GCS or HDFS.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracelake.sources.logs import EVENT_FIELDS

NAME = "tailed_lines"
SCHEMA = "path string, place long, value string"
PART_BYTES = 64 << 20
_BLOCK = 1 << 20


@dataclass
class Part(InputPartition):
    """Lines of a file that start in [first, last); the file's lines are whole up to `end`."""

    path: str
    first: int
    last: int
    end: int
    opens: bool


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def whole_lines(file: pa.NativeFile, size: int) -> int:
    """Bytes of a file up to its last line end, sought from behind."""
    at = size
    while at > 0:
        begin = max(0, at - _BLOCK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets are {path: bytes of whole lines}; a file that is shorter than its offset was begun anew and is read from its start."""

    def __init__(self, folder: str, suffix: str, part_bytes: int):
        self.folder, self.suffix, self.part_bytes = folder, suffix, part_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = opened(self.folder)
        out = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix):
                with files.open_input_file(info.path) as file:
                    out[info.path] = whole_lines(file, info.size)
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0) if start.get(path, 0) <= stop else 0
            out += [Part(path, at, min(at + self.part_bytes, stop), stop, at == begin) for at in range(begin, stop, self.part_bytes)]
        return out or [Part("", 0, 0, 0, True)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = opened(self.folder)
        with files.open_input_file(partition.path) as file:
            at = partition.first
            if not partition.opens:  # the line that runs into this part belongs to the one before
                at = _next_line(file, at - 1, partition.end)
            while at < partition.last:
                file.seek(at)
                block = file.read(min(_BLOCK, partition.end - at))
                cut = block.rfind(b"\n") + 1
                if not cut:
                    cut = _next_line(file, at, partition.end) - at
                    file.seek(at)
                    block = file.read(cut)
                lines, places, place = [], [], at
                for line in block[:cut].split(b"\n")[:-1]:
                    if place >= partition.last:
                        break
                    lines.append(line.decode("utf-8", "replace"))
                    places.append(place)
                    place += len(line) + 1
                at = place if place >= partition.last else at + cut
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["path", "place", "value"])

    def commit(self, end: dict) -> None:
        pass


def _next_line(file: pa.NativeFile, at: int, end: int) -> int:
    """Place after the first line end at or behind `at`; `end` closes a line."""
    while at < end:
        file.seek(at)
        found = file.read(min(_BLOCK, end - at)).find(b"\n")
        if found >= 0:
            return at + found + 1
        at = min(at + _BLOCK, end)
    return end


class TailSource(DataSource):
    """Options: path, suffix (.jsonl), partBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("partbytes", self.options.get("partBytes", PART_BYTES))))


def tail_lines(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES, suffix: str = ".jsonl") -> DataFrame:
    """Stream of (path, place, value): whole lines of the logs under a folder as they are added, place being where a line starts.

    A last line without its line end waits.  Long additions are read in parts by several tasks.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).option("path", folder).option("partBytes", part_bytes).option("suffix", suffix).load()


def tail_events(spark: SparkSession, folder: str, fields: str = EVENT_FIELDS, part_bytes: int = PART_BYTES, suffix: str = ".jsonl") -> DataFrame:
    """Stream of the events in those lines; blank and malformed lines are skipped."""
    parsed = F.from_json("value", fields + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = tail_lines(spark, folder, part_bytes, suffix).where("trim(value) <> ''").withColumn("p", parsed)
    return rows.where("p._corrupt_record is null").select("p.*").drop("_corrupt_record")
