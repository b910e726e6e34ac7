"""Planning and running a distributed decode of .xz files and raw LZMA2 files.

Paths become block rows by reading headers, indexes and footers only; blocks are packed into tasks by their
uncompressed size; each task opens the file at its blocks' offsets. No payload is read to plan, and none is
shuffled to decode: what moves is a row of a few numbers per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.errors import ERROR_DDL, StreamError
from sluice.functions.props import admitted, block_memory
from sluice.operators import codec
from sluice.sources import xz
from sluice.sources.lzma2 import COUNTERS, Run, scan_runs

_ERROR = pa.struct([("kind", pa.string()), *((k, pa.int64()) for k in ("stream", "block", "offset", "needed", "limit"))])
BLOCK_DDL = f"path string, stream_no long, block_no long, file_offset long, uncompressed_offset long, unpadded_size long, padded_size long, uncompressed_size long, check_id int, error {ERROR_DDL}"
STREAM_DDL = f"path string, stream_no long, stream_offset long, stream_size long, check_id int, check_size int, block_count long, uncompressed_size long, index_size long, error {ERROR_DDL}"
RUN_DDL = "path string, run_no long, in_offset long, packed_len long, out_offset long, unpacked_len long, has_dict_reset boolean, chunks struct<" + ",".join(f"{k}:long" for k in COUNTERS) + f">, error {ERROR_DDL}"
PIECE_DDL = f"path string, stream_no long, block_no long, out_offset long, data binary, error {ERROR_DDL}"


def open_input(path: str):
    """(seekable file, size) on whatever file system the path names."""
    uri = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    fs, inner = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(inner), fs.get_file_info(inner).size


def _table(ddl_rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(ddl_rows, schema)


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """path and length of the files, listed by Spark; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


_STREAMS = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("stream_no", "stream_offset", "stream_size")), ("check_id", pa.int32()), ("check_size", pa.int32()), *((k, pa.int64()) for k in ("block_count", "uncompressed_size", "index_size")), ("error", _ERROR)])
_BLOCKS = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("stream_no", "block_no", "file_offset", "uncompressed_offset", "unpadded_size", "padded_size", "uncompressed_size")), ("check_id", pa.int32()), ("error", _ERROR)])
_RUNS = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("run_no", "in_offset", "packed_len", "out_offset", "unpacked_len")), ("has_dict_reset", pa.bool_()), ("chunks", pa.struct([(k, pa.int64()) for k in COUNTERS])), ("error", _ERROR)])
_PIECES = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("stream_no", "block_no", "out_offset")), ("data", pa.binary()), ("error", _ERROR)])


def _per_file(files: DataFrame, ddl: str, schema: pa.Schema, rows_of, batch: int = 4096) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[dict] = []
            for path in b.column(0).to_pylist():
                try:
                    f, size = open_input(path)
                    with f:
                        for row in rows_of(path, f, size):
                            held.append(row)
                            if len(held) >= batch:
                                yield _table(held, schema)
                                held = []
                except StreamError as e:
                    held.append({"path": path, "error": e.as_row()})
            yield _table(held, schema)

    return files.select("path").mapInArrow(run, ddl)


def xz_streams(files: DataFrame, concatenated: bool = True, most_records: int | None = None) -> DataFrame:
    """A row per stream, from footers, indexes and headers; a file that fails has one row with `error`."""

    def rows(path, f, size):
        for s in xz.read_streams(f, size, most_records, concatenated):
            yield {"path": path, "stream_no": s.stream_no, "stream_offset": s.offset, "stream_size": s.size, "check_id": s.check_id, "check_size": xz.check_size(s.check_id), "block_count": len(s.records), "uncompressed_size": s.uncompressed_size, "index_size": s.index_size}

    return _per_file(files, STREAM_DDL, _STREAMS, rows)


def xz_blocks(files: DataFrame, concatenated: bool = True, most_records: int | None = None) -> DataFrame:
    """A row per block with its places; a file that fails has one row with `error`."""

    def rows(path, f, size):
        for b in xz.located_blocks(xz.read_streams(f, size, most_records, concatenated)):
            yield {"path": path, "stream_no": b.stream_no, "block_no": b.block_no, "file_offset": b.file_offset, "uncompressed_offset": b.uncompressed_offset, "unpadded_size": b.unpadded_size, "padded_size": b.padded_size, "uncompressed_size": b.uncompressed_size, "check_id": b.check_id}

    return _per_file(files, BLOCK_DDL, _BLOCKS, rows)


def lzma2_runs(files: DataFrame) -> DataFrame:
    """A row per run of raw LZMA2 files; payloads are passed over."""

    def rows(path, f, size):
        for r in scan_runs(f, size):
            yield {"path": path, "run_no": r.run_no, "in_offset": r.in_offset, "packed_len": r.packed_len, "out_offset": r.out_offset, "unpacked_len": r.unpacked_len, "has_dict_reset": r.has_dict_reset, "chunks": r.chunks}

    return _per_file(files, RUN_DDL, _RUNS, rows)


def packed(units: DataFrame, size: str, target: int = 128 << 20) -> DataFrame:
    """Rows dealt into tasks of about `target` bytes, or less where there would be fewer tasks than two a core, by the
    running sum of `size` within a file; large units get a task of their own. The number of tasks is a plan-time total of
    one number."""
    total = units.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
    target = min(target, max(1 << 20, int(total["n"]) // (2 * units.sparkSession.sparkContext.defaultParallelism)))
    tasks = max(1, min(total["c"], -(-int(total["n"]) // target)))
    if tasks == 1:
        return units.coalesce(1)
    w = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    at = "file_offset" if "file_offset" in units.columns else "in_offset"
    rows = units.withColumn("_at", F.col(at)).withColumn("_bin", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / target))
    return rows.repartition(tasks, "path", "_bin").drop("_at", "_bin")


def decode_blocks(blocks: DataFrame, limits: codec.Limits | None = None, mode: str = "permissive", target: int = 128 << 20, piece: int = 16 << 20) -> DataFrame:
    """Decoded pieces of at most `piece` bytes: path, stream_no, block_no, out_offset, data, error.

    permissive: a block that fails is a row with `error` and no data, and so is a file that failed to plan.
    failfast: the first error met is raised. Only checked blocks are emitted. Any subset of blocks may be given:
    a filter on uncompressed_offset reads only what covers the range.
    """
    limits = limits or codec.Limits()
    if mode not in ("permissive", "failfast"):
        raise ValueError(mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            for row in batch.to_pylist():
                out = {"path": row["path"], "stream_no": row["stream_no"], "block_no": row["block_no"], "out_offset": row["uncompressed_offset"], "data": None, "error": row["error"]}
                if row["error"] is not None:
                    if mode == "failfast":
                        raise StreamError(**row["error"])
                    yield _table([out], _PIECES)
                    continue
                try:
                    if path != row["path"]:
                        if f is not None:
                            f.close()
                        path, (f, _) = row["path"], open_input(row["path"])
                    b = xz.Block(row["stream_no"], row["block_no"], row["file_offset"], row["uncompressed_offset"], row["unpadded_size"], row["uncompressed_size"], row["check_id"])
                    need = block_memory(b.uncompressed_size, b.padded_size)
                    if need > limits.memory:
                        raise StreamError("MemoryLimit", b.stream_no, b.block_no, b.file_offset, need, limits.memory)
                    f.seek(b.file_offset)
                    data = codec.decode_block(f.read(b.padded_size), b, limits)
                except StreamError as e:
                    if mode == "failfast":
                        raise
                    yield _table([out | {"error": e.as_row()}], _PIECES)
                    continue
                for k in range(0, max(1, len(data)), piece):
                    yield _table([out | {"out_offset": b.uncompressed_offset + k, "data": data[k : k + piece]}], _PIECES)

    return packed(blocks, "uncompressed_size", target).mapInArrow(run, PIECE_DDL)


def decode_runs(runs: DataFrame, prop: int, memory: int = 2**40, target: int = 128 << 20) -> DataFrame:
    """As decode_blocks for the runs of raw LZMA2 files (run_no in block_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {"path": row["path"], "stream_no": 0, "block_no": row["run_no"], "out_offset": row["out_offset"], "data": None, "error": row["error"]}
                if row["error"] is None:
                    try:
                        f, _ = open_input(row["path"])
                        with f:
                            f.seek(row["in_offset"])
                            r = Run(row["run_no"], row["in_offset"], row["out_offset"], row["packed_len"], row["unpacked_len"])
                            out["data"] = codec.decode_run(f.read(row["packed_len"]), r, prop, memory)
                    except StreamError as e:
                        out["error"] = e.as_row()
                yield _table([out], _PIECES)

    return packed(runs, "unpacked_len", target).mapInArrow(run, PIECE_DDL)


def decode_sequential(files: DataFrame, limits: codec.Limits | None = None, step: int = 1 << 20, chase: bool = False) -> DataFrame:
    """The forward path, one task per file, for files whose index can't be read: pieces in order, then an error row
    if there is one. Everything before the error comes out; with `chase` a block's chunks too, before its check is
    known, and no block is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                d, at, n = codec.SequentialDecoder(limits, chase), 0, 0
                row = {"path": path, "stream_no": 0, "block_no": 0, "out_offset": 0, "data": None, "error": None}
                f, _ = open_input(path)
                with f:
                    try:
                        while data := f.read(step):
                            for got in d.push(data):
                                yield _table([row | {"stream_no": d.stream, "block_no": n, "out_offset": at, "data": got}], _PIECES)
                                at, n = at + len(got), n + 1
                        d.finish()
                    except StreamError as e:
                        yield _table([row | {"stream_no": d.stream, "block_no": n, "out_offset": at, "error": e.as_row()}], _PIECES)

    return files.select("path").mapInArrow(run, PIECE_DDL)


def read_xz(spark: SparkSession, path: str | list[str], limits: codec.Limits | None = None, mode: str = "permissive", out_range: tuple[int, int] | None = None, glob: str = "*.xz") -> DataFrame:
    """Files -> decoded pieces. out_range: only blocks that overlap [start, end) of a file's output are read."""
    limits = limits or codec.Limits()
    blocks = xz_blocks(list_files(spark, path, glob), limits.concatenated)
    if limits.max_unpack_bytes is not None:
        over = blocks.groupBy("path").agg(F.sum("uncompressed_size").alias("n")).where(F.col("n") > limits.max_unpack_bytes)
        if bad := over.first():
            raise StreamError("TooMuchOutput", needed=bad["n"], limit=limits.max_unpack_bytes)
    if out_range:
        a, b = out_range
        blocks = blocks.where(F.col("error").isNotNull() | ((F.col("uncompressed_offset") < b) & (F.col("uncompressed_offset") + F.col("uncompressed_size") > a)))
    return decode_blocks(blocks, limits, mode)


def degraded_workers(blocks: DataFrame, threads: int, memory_limit: int) -> int:
    """Workers that a memory limit pays for, given the largest block's needs: fewer rather than failing."""
    r = blocks.agg(F.max("uncompressed_size").alias("o"), F.max("padded_size").alias("i"), F.count("*").alias("n")).first()
    return admitted(threads, memory_limit, block_memory(r["o"] or 0, r["i"] or 0), r["n"])


def encode_files(rows: DataFrame, encoder: codec.Encoder | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """One .xz stream per row, its blocks encoded in parallel: key, data. The bytes depend on the block size only.

    Blocks of all rows are spread over the tasks; a row's encoded blocks then meet to be put in order.
    """
    from sluice.operators.relational import cut_blocks

    enc = encoder or codec.Encoder(block_size=1 << 20)
    blocks = cut_blocks(rows.select(key, content), enc.block_size, content) if enc.block_size else rows.where(F.octet_length(content) > 0).select(key, F.lit(0).alias("block_no"), F.col(content).alias("block"))
    blocks = blocks.select(F.col(key).cast("string").alias("_key"), F.col("block_no").cast("int"), "block").repartition("_key", "block_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, no, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, unpadded, n = codec.encode_block(data, enc)
                yield pa.RecordBatch.from_pylist([{"_key": name, "block_no": no, "raw": raw, "unpadded": unpadded, "n": n}], pa.schema([("_key", pa.string()), ("block_no", pa.int32()), ("raw", pa.binary()), ("unpadded", pa.int64()), ("n", pa.int64())]))

    encoded = blocks.mapInArrow(run, "_key string, block_no int, raw binary, unpadded long, n long")
    parts = encoded.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("block_no", "raw", "unpadded", "n"))).alias("p"))
    check = codec.CHECK_IDS[enc.check]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [codec.assemble(check, [(x["raw"], x["unpadded"], x["n"]) for x in p or []]) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "data"])

    every = rows.select(F.col(key).cast("string").alias("_key")).distinct().join(parts, "_key", "left")
    return every.select("_key", "p").mapInArrow(put, f"`{key}` string, data binary")


def with_checks(pieces: DataFrame, plan) -> DataFrame:
    """Adds `segments`: the checks of each piece as a ChecksumPlan cuts the output, in the task that decoded it."""
    from sluice.functions.columns import segments

    return pieces.withColumn("segments", segments(F.col("out_offset"), F.col("data"), plan))


def block_counts(blocks: DataFrame) -> DataFrame:
    """path, streams, blocks, parallel: whether a file is one stream of several blocks. From metadata only."""
    counted = blocks.where("error is null").groupBy("path").agg((F.max("stream_no") + 1).alias("streams"), F.count("*").alias("blocks"))
    return counted.withColumn("parallel", (F.col("streams") == 1) & (F.col("blocks") > 1))


def observed(pieces: DataFrame, name: str = "decode") -> DataFrame:
    """pieces, reporting bytes, pieces and errors of the run to Observation or a streaming listener as `name`."""
    return pieces.observe(name, F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("pieces"), F.count("error").alias("errors"))


def encode_lzma2_files(rows: DataFrame, encoder: codec.Encoder | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """One raw LZMA2 stream per row from blocks that are encoded in parallel: key, prop, data."""
    from sluice.operators.relational import cut_blocks

    enc = encoder or codec.Encoder(block_size=1 << 20)
    prop = xz.prop_from_dict_size(enc.dict_size)
    blocks = cut_blocks(rows.select(F.col(key).cast("string").alias("_key"), content), enc.block_size or 2**31 - 1, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [codec.lzma2_encode(d, enc)[1][:-1] for d in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["_key", "block_no", "raw"])

    parts = blocks.select("_key", "block_no", "block").repartition("_key", "block_no").mapInArrow(run, "_key string, block_no int, raw binary")
    whole = parts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("block_no", "raw"))).alias("p"))
    every = rows.select(F.col(key).cast("string").alias("_key")).distinct().join(whole, "_key", "left")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b"".join([x["raw"] for x in p or []]) + b"\0" for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([prop] * b.num_rows, pa.int32()), pa.array(out, pa.binary())], names=[key, "prop", "data"])

    return every.select("_key", "p").mapInArrow(put, f"`{key}` string, prop int, data binary")
