"""spark.read / write.format("xz" | "lzma2" | "lzma"), and readStream.format("xz").

A read plans one input partition per group of blocks from the files' indexes and decodes at their offsets;
filters on block_no and out_offset that Spark pushes keep blocks out of the plan. A write puts one stream per
task down in a folder of the job's own; commit moves the files of the attempts that Spark committed to names with the
job's id, so jobs that append to one path, at once or in turn, keep out of each other's way; abort removes the folder.

Spark hands options over with keys in lower case; they are kept in its own mapping, which asks by any case.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sluice.errors import StreamError
from sluice.operators import codec
from sluice.plans.decode import _PIECES, PIECE_DDL, open_input
from sluice.sources import xz
from sluice.sources.lzma2 import Run, scan_runs


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


def limits_of(options: dict) -> codec.Limits:
    """memoryLimit, maxBlockSize, maxUnpackBytes, verify, allowUnverifiable, concatenated."""
    o = options
    return codec.Limits(
        int(o.get("memoryLimit", 2**40)), int(o.get("maxBlockSize", 64 << 30)), int(o["maxUnpackBytes"]) if "maxUnpackBytes" in o else None, _flag(o, "verify", True), _flag(o, "allowUnverifiable", False), _flag(o, "concatenated", True)
    )


def encoder_of(options: dict) -> codec.Encoder:
    """preset, check, blockSize, delta (a distance), bcj (a kind): filters in that order."""
    filters = []
    if "delta" in options:
        filters.append(xz.Filter(xz.DELTA_ID, bytes((int(options["delta"]) - 1,))))
    if "bcj" in options:
        filters.append(xz.Filter(next(k for k, v in xz.BCJ_KINDS.items() if v.lower() == options["bcj"].lower())))
    return codec.Encoder(int(options.get("preset", 6)), options.get("check", "crc64"), int(options.get("blockSize", 0)), tuple(filters))


def files_under(path: str, suffix: str) -> list[str]:
    uri = uri_of(path)
    fs, inner = pafs.FileSystem.from_uri(uri)
    scheme = uri.split("://")[0]
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [uri]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(f"{scheme}://{f.path}" for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix) and "/_" not in f.path)


@dataclass
class Units(InputPartition):
    path: str
    units: list | None  # None: not planned yet
    error: dict | None = None


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, options: dict):
        self.options = CaseInsensitiveDict(options)
        self.target = int(options.get("partitionBytes", 128 << 20))
        self.failfast = options.get("mode", "permissive").lower() == "failfast"
        self.bounds: list[tuple[str, str, int]] = []

    def units(self, path: str) -> list:
        raise NotImplementedError

    def place(self, unit) -> dict:
        raise NotImplementedError

    def decoded(self, f, unit) -> bytes:
        raise NotImplementedError

    def pushFilters(self, filters):
        from pyspark.sql import datasource as ds

        ops = {ds.EqualTo: "==", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
        for f in filters:
            # out_offset is the start of a piece, so a bound on it decides by whole blocks
            if type(f) in ops and f.attribute in (("block_no",), ("stream_no",), ("out_offset",)):
                self.bounds.append((f.attribute[0], ops[type(f)], f.value))
            yield f

    def _wanted(self, unit) -> bool:
        p = self.place(unit)
        test = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(test[op](p[name], v) for name, op, v in self.bounds)

    def _units(self, path: str) -> list[Units]:
        """The file's units in groups of about partitionBytes; of a file that can't be planned, its error."""
        out, held, size = [], [], 0
        try:
            for u in self.units(path):
                if self._wanted(u):
                    held.append(u)
                    size += self.place(u)["_size"]
                    if size >= self.target:
                        out.append(Units(path, held))
                        held, size = [], 0
        except StreamError as e:
            if self.failfast:
                raise
            return [*out, Units(path, held, e.as_row())]
        return [*out, Units(path, held)] if held else out

    def partitions(self):
        """Up to planFiles files (32 by default) are planned here, so that large ones spread over tasks; of more files
        each is a partition, and its index is read by the task that decodes it."""
        paths = files_under(self.options["path"], self.suffix)
        if len(paths) > int(self.options.get("planFiles", 32)):
            return [Units(path, None) for path in paths]
        return [u for path in paths for u in self._units(path)] or [Units("", [])]

    def read(self, partition: Units) -> Iterator[pa.RecordBatch]:
        if partition.units is None:
            for units in self._units(partition.path):
                yield from self.read(units)
            return
        row = {"path": partition.path, "stream_no": None, "block_no": None, "out_offset": None, "data": None, "error": partition.error}
        if partition.error:
            yield pa.RecordBatch.from_pylist([row], _PIECES)
        if not partition.units:
            return
        f, _ = open_input(partition.path)
        with f:
            for u in partition.units:
                out = row | {k: v for k, v in self.place(u).items() if k != "_size"}
                try:
                    out["data"] = self.decoded(f, u)
                except StreamError as e:
                    if self.failfast:
                        raise
                    out["error"] = e.as_row()
                yield pa.RecordBatch.from_pylist([out], _PIECES)


class XzReader(_Reader):
    suffix = ".xz"

    def units(self, path):
        limits = limits_of(self.options)
        f, size = open_input(path)
        with f:
            blocks = xz.located_blocks(xz.read_streams(f, size, concatenated=limits.concatenated))
        total = sum(b.uncompressed_size for b in blocks)
        if limits.max_unpack_bytes is not None and total > limits.max_unpack_bytes:
            raise StreamError("TooMuchOutput", needed=total, limit=limits.max_unpack_bytes)
        return blocks

    def place(self, b):
        return {"stream_no": b.stream_no, "block_no": b.block_no, "out_offset": b.uncompressed_offset, "_size": b.uncompressed_size}

    def decoded(self, f, b):
        f.seek(b.file_offset)
        return codec.decode_block(f.read(b.padded_size), b, limits_of(self.options))


class Lzma2Reader(_Reader):
    suffix = ".lzma2"

    def units(self, path):
        f, size = open_input(path)
        with f:
            return list(scan_runs(f, size))

    def place(self, r: Run):
        return {"stream_no": 0, "block_no": r.run_no, "out_offset": r.out_offset, "_size": r.unpacked_len}

    def decoded(self, f, r):
        f.seek(r.in_offset)
        return codec.decode_run(f.read(r.packed_len), r, int(self.options.get("dictProp", 40)), int(self.options.get("memoryLimit", 2**40)))


class LzmaReader(_Reader):
    suffix = ".lzma"

    def units(self, path):
        return [path]

    def place(self, path):
        return {"stream_no": 0, "block_no": 0, "out_offset": 0, "_size": self.target}

    def decoded(self, f, path):
        f.seek(0)
        return codec.lzma_alone_decode(f.read(), int(self.options.get("memoryLimit", 512 << 20)))


def uri_of(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}"


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    """The rows' `data` (or their first binary or string column) of a task, one after the other, are one stream. What a
    task holds is one block (`blockSize`; 16 MiB for LZMA2 where it isn't set), and for .lzma nothing."""

    def __init__(self, options: dict, schema, overwrite: bool, suffix: str):
        self.options, self.suffix, self.overwrite, self.job = CaseInsensitiveDict(options), suffix, overwrite, uuid.uuid4().hex
        names = [f.name for f in schema.fields if f.dataType.typeName() in ("binary", "string")]
        if not names:
            raise ValueError("a binary or string column is needed")
        self.column = "data" if "data" in names else names[0]
        self.encoder = encoder_of(self.options)

    def _place(self):
        """(file system, folder, the job's temporary folder)"""
        fs, inner = pafs.FileSystem.from_uri(uri_of(self.options["path"]))
        return fs, inner, f"{inner}/_temporary-{self.job}"

    def write(self, iterator):
        from pyspark import TaskContext

        c = TaskContext.get()
        name = f"part-{c.partitionId():05d}-{self.job}{self.suffix}"
        fs, inner, held = self._place()
        fs.create_dir(held, recursive=True)
        # attempts of one task don't meet
        temporary = f"{held}/{name}.{c.taskAttemptId()}"
        values = (v for row in iterator if (v := row[self.column]) is not None)
        values = (v.encode() if isinstance(v, str) else bytes(v) for v in values)
        with fs.open_output_stream(temporary) as out:
            for piece in self._encoded(values):
                out.write(piece)
        return Written(temporary, f"{inner}/{name}")

    def _encoded(self, values: Iterator[bytes]) -> Iterator[bytes]:
        if self.suffix == ".xz":
            w = codec.XzWriter(self.encoder)
        elif self.suffix == ".lzma2":
            w = codec.Lzma2Writer(self.encoder, self.encoder.block_size or 16 << 20)
        else:
            w = codec.LzmaWriter(self.encoder.preset)
        for v in values:
            yield w.push(v)
        yield w.finish()

    def commit(self, messages):
        fs, inner, held = self._place()
        done = [m for m in messages if m is not None]
        if self.overwrite and done:
            for f in fs.get_file_info(pafs.FileSelector(inner)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for m in done:
            fs.move(m.temporary, m.final)
        self._remove(fs, held)

    def abort(self, messages):
        fs, _, held = self._place()
        self._remove(fs, held)

    @staticmethod
    def _remove(fs, held: str) -> None:
        if fs.get_file_info(held).type == pafs.FileType.Directory:
            fs.delete_dir(held)


@dataclass
class Arrived(InputPartition):
    path: str


class XzStreamReader(DataSourceStreamReader):
    """Files that appear under the path, a partition each: executors read their indexes and decode them, the driver
    lists names. The offset numbers the batches; the files of each are in a journal under `journal` (by default the
    folder `_arrived` beside the files), so a new file is new under any name, an offset stays small, and a restarted
    query reads the same files in the same batch."""

    def __init__(self, options: dict):
        self.options = CaseInsensitiveDict(options)
        self.most = int(options.get("maxFilesPerTrigger", 100))
        path = options["path"]
        self.fs, inner = pafs.FileSystem.from_uri(uri_of(path))
        self.journal = options.get("journal") or f"{inner if self.fs.get_file_info(inner).type == pafs.FileType.Directory else inner + '-'}/_arrived".replace("-/_", "-_")
        self.batches = self._journalled()
        self.read_ = {f for b in self.batches for f in b}

    def _journalled(self) -> list[list[str]]:
        out: list[list[str]] = []
        while self.fs.get_file_info(self._entry(len(out))).type == pafs.FileType.File:
            with self.fs.open_input_stream(self._entry(len(out))) as f:
                out.append(json.loads(f.read()))
        return out

    def _entry(self, n: int) -> str:
        return f"{self.journal}/{n:09d}.json"

    def initialOffset(self):
        return {"batch": 0}

    def latestOffset(self):
        new = [f for f in files_under(self.options["path"], ".xz") if f not in self.read_][: self.most]
        if new:
            self.fs.create_dir(self.journal, recursive=True)
            part = f"{self._entry(len(self.batches))}.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(part) as out:
                out.write(json.dumps(new).encode())
            self.fs.move(part, self._entry(len(self.batches)))
            self.batches.append(new)
            self.read_.update(new)
        return {"batch": len(self.batches)}

    def partitions(self, start, end):
        return [Arrived(f) for b in self.batches[start["batch"] : end["batch"]] for f in b] or [Arrived("")]

    def read(self, partition: Arrived) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        r = XzReader(self.options)
        try:
            units = Units(partition.path, r.units(partition.path))
        except StreamError as e:
            if r.failfast:
                raise
            units = Units(partition.path, [], e.as_row())
        yield from r.read(units)

    def commit(self, end):
        pass


class _Source(DataSource):
    reader_class: type = XzReader

    def schema(self):
        return PIECE_DDL

    def reader(self, schema):
        return self.reader_class(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite, self.reader_class.suffix)


class XzSource(_Source):
    @classmethod
    def name(cls):
        return "xz"

    def streamReader(self, schema):
        return XzStreamReader(self.options)


class Lzma2Source(_Source):
    reader_class = Lzma2Reader

    @classmethod
    def name(cls):
        return "lzma2"


class LzmaSource(_Source):
    reader_class = LzmaReader

    @classmethod
    def name(cls):
        return "lzma"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (XzSource, Lzma2Source, LzmaSource):
        spark.dataSource.register(source)
