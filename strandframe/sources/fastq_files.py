"""The data source ``fastq``: byte ranges of plain files and whole gzip files as records, and ordered files of records.

``spark.read.format("fastq").load(path)`` reads each file by one task. ``sources.fastq.read_fastq`` counts the lines of
byte ranges first, so that each range knows the number of its first line: nothing is shuffled to be numbered, and no
record border is guessed. Which files are gzip is told by their first two bytes, whatever their names.

Writing (``df.write.format("fastq").option("path", ...)``) puts each partition's texts into one part file, under a folder
that must be new. Nothing stands under its final name before all tasks have ended; if one fails, all is removed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FIELDS = ["header", "seq", "plus", "qual"]
OFFSETS = [f"off_{c}" for c in FIELDS]
SCHEMA = "src string, idx long, " + ", ".join(f"{c} string" for c in FIELDS) + ", " + ", ".join(f"{c} long" for c in OFFSETS) + ", end_offset long"
#: Fixed value: the first bytes of a gzip member.
GZIP_MAGIC = b"\x1f\x8b"
#: Bytes that are read at a time, and at most inflated at a time.
BLOCK = 4 << 20
#: Levels of compression by name; later ones take longer and give smaller files.
PRESETS = {"fast": 1, "even": 6, "dense": 9}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def reachable(uri: str) -> bool:
    """Whether tasks can open such a path themselves; Spark knows more kinds of file system."""
    try:
        opened(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def blocks_at(uri: str, start: int, size: int = BLOCK) -> Iterator[bytes]:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        while block := f.read(size):
            yield block


def is_gzip(uri: str) -> bool:
    return next(blocks_at(uri, 0, 2), b"") == GZIP_MAGIC


def inflated(blocks: Iterator[bytes], name: str) -> Iterator[bytes]:
    """The bytes of all members in turn. Checksums and sizes are verified; anything behind the last member is an error."""
    member, begun = zlib.decompressobj(31), False
    try:
        for block in blocks:
            while block:
                begun = True
                if out := member.decompress(block, BLOCK):
                    yield out
                block = member.unconsumed_tail
                if member.eof:
                    block, member, begun = member.unused_data, zlib.decompressobj(31), False
        while begun and (out := member.decompress(member.unconsumed_tail, BLOCK)):
            yield out
    except zlib.error as wrong:
        raise ValueError(f"{name}: not a valid gzip file: {wrong}") from None
    if begun and not member.eof:
        raise ValueError(f"{name}: a gzip member is cut short")


def count_lines(uri: str, start: int, stop: int) -> int:
    """How many lines begin in a byte range; -1 for a gzip file."""
    if is_gzip(uri):
        return -1
    n, at = int(start == 0 and stop > 0), max(start - 1, 0)  # a line begins behind each line feed
    for block in blocks_at(uri, at):
        part = np.frombuffer(block, np.uint8)[: stop - 1 - at]
        n += int(np.count_nonzero(part == 10))
        at += len(block)
        if at >= stop - 1:
            break
    return n


def records_from(blocks: Iterator[bytes], at: int, skip: int, stop: float, src: str) -> Iterator[pa.RecordBatch]:
    """Records out of blocks that begin with a line at offset ``at``: those that begin before ``stop``, after ``skip`` lines.

    A CR goes only before an LF. An incomplete last record has nulls for its missing lines.
    """
    rest, idx, blocks = b"", 0, chain(blocks, [None])
    for block in blocks:
        data = rest if block is None else rest + block
        cut = len(data) if block is None else data.rfind(b"\n") + 1
        lines = data[:cut].split(b"\n")
        ended = np.ones(len(lines), bool)
        if lines[-1] == b"":
            lines.pop()
        else:
            ended[-1] = False
        sizes = np.array([len(x) for x in lines], np.int64) + ended[: len(lines)]
        starts = at + np.concatenate([[0], np.cumsum(sizes)])
        drop = min(skip, len(lines))
        skip -= drop
        whole = (len(lines) - drop) // 4 if block is not None else -(-(len(lines) - drop) // 4)
        begins = starts[drop : drop + 4 * whole : 4]
        whole = int(np.searchsorted(begins, stop))
        if whole:
            last = min(drop + 4 * whole, len(lines))
            used = [x[:-1] if e and x.endswith(b"\r") else x for x, e in zip(lines[drop:last], ended[drop:last])]
            used += [None] * (4 * whole - len(used))
            offsets = np.append(starts[drop:last], np.zeros(4 * whole - (last - drop), np.int64))
            missing = np.array([x is None for x in used])
            arrays = [pa.array([src] * whole), pa.array(np.arange(idx, idx + whole))]
            arrays += [pa.array(used[k::4], pa.binary()).view(pa.string()) for k in range(4)]
            arrays += [pa.array(offsets[k::4], mask=missing[k::4]) for k in range(4)]
            ends = starts[np.minimum(drop + 4 * np.arange(1, whole + 1), len(lines))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ends)], ["src", "idx", *FIELDS, *OFFSETS, "end_offset"])
            idx += whole
        if len(begins) > whole:
            return
        keep = drop + 4 * whole if block is not None else len(lines)
        rest, at = data[int(starts[keep] - at) :], int(starts[keep])


@dataclass
class FileRange(InputPartition):
    """A byte range of a plain file with the number of lines before it; or a whole gzip file (no end)."""

    src: str
    start: int = 0
    stop: int | None = None
    lines_before: int = 0

    def records(self) -> Iterator[pa.RecordBatch]:
        if self.stop is None and is_gzip(self.src):
            return records_from(inflated(blocks_at(self.src, 0), self.src), 0, 0, float("inf"), self.src)
        blocks, at = blocks_at(self.src, max(self.start - 1, 0)), max(self.start - 1, 0)
        if self.start:  # up to the first line that begins in the range
            for block in blocks:
                found = block.find(b"\n")
                if found >= 0:
                    blocks, at = chain([block[found + 1 :]], blocks), at + found + 1
                    break
                at += len(block)
        first = -(-self.lines_before // 4)
        stop = float("inf") if self.stop is None else self.stop
        return (numbered(b, first) for b in records_from(blocks, at, -self.lines_before % 4, stop, self.src))


def numbered(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
    return batch.set_column(1, "idx", pa.array(batch.column(1).to_numpy() + first)) if first else batch


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[FileRange]:
        """Those given by ``ranges`` (JSON: src, start, stop, lines before), or each file below ``path`` as one."""
        if "ranges" in self.options:
            return [FileRange(*r) for r in json.loads(self.options["ranges"])]
        system, path = opened(self.options["path"])
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(i.path for i in found if i.is_file and not i.base_name.startswith(("_", ".")))
        prefix = "file://" if isinstance(system, fs.LocalFileSystem) else self.options["path"][: self.options["path"].find("://") + 3]
        return [FileRange(prefix + n) for n in names]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return partition.records() if partition else iter(())  # Spark gives none where there are no partitions


@dataclass
class Written(WriterCommitMessage):
    part: int
    names: list[str]


class FastqWriter(DataSourceArrowWriter):
    """Each string column of the rows goes to the folder of its place in ``paths``; part files are numbered by partition.

    One pass writes all folders, so mates written together have the same rows in parts of the same number.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.level = PRESETS[options.get("preset", "even")] if options.get("gzip", "false") == "true" else None
        self.ending = ".fastq.gz" if self.level is not None else ".fastq"
        if len(schema.fields) != len(self.paths) or any(f.dataType.typeName() != "string" for f in schema.fields):
            raise ValueError("a string column is needed for each folder")
        if len(set(self.paths)) < len(self.paths):
            raise ValueError("outputs must differ")
        for path in self.paths:  # before any work; what others create later is met by create_dir
            system, place = opened(path)
            if overwrite or system.get_file_info(place).type != fs.FileType.NotFound:
                raise FileExistsError(f"{path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        names = [f"{path}/_temporary/{task.partitionId():05d}-{task.taskAttemptId()}" for path in self.paths]
        packers = [zlib.compressobj(self.level, zlib.DEFLATED, 31) if self.level is not None else None for _ in names]
        outs, any_rows = [], False
        try:
            for batch in iterator:
                if not outs:
                    for name in names:
                        system, place = opened(name)
                        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        outs.append(system.open_output_stream(place))
                for out, packer, column in zip(outs, packers, batch.columns):
                    data = column.cast(pa.large_string())
                    begin, end = (int(x) for x in np.frombuffer(data.buffers()[1], np.int64)[[data.offset, data.offset + len(data)]])
                    text = memoryview(data.buffers()[2])[begin:end] if end > begin else b""
                    out.write(packer.compress(text) if packer else text)
                    any_rows = any_rows or end > begin
            for out, packer in zip(outs, packers):
                if packer:
                    out.write(packer.flush())
        finally:
            for out in outs:
                out.close()
        return Written(task.partitionId(), names if any_rows else [])

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m and m.names), key=lambda m: m.part)
        for k, path in enumerate(self.paths):
            system, place = opened(path)
            system.create_dir(place, recursive=True)
            for m in done:
                system.move(opened(m.names[k])[1], f"{place}/part-{m.part:05d}{self.ending}")
            if system.get_file_info(f"{place}/_temporary").type != fs.FileType.NotFound:
                system.delete_dir(f"{place}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        for path in self.paths:
            system, place = opened(path)
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FastqWriter:
        return FastqWriter(dict(self.options), schema, overwrite)
