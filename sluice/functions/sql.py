"""The same operators for SQL: table functions over paths and scalar functions over binary values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from sluice.errors import StreamError
from sluice.functions import checksum as cs
from sluice.operators import byte_filters as bf
from sluice.operators import codec
from sluice.sources import xz
from sluice.sources.lzma2 import scan_runs


class XzStreams:
    """xz_streams(path): a row per stream, from footers, indexes and headers."""

    def eval(self, path: str) -> Iterator[tuple]:
        from sluice.plans.decode import open_input

        f, size = open_input(path)
        with f:
            for s in xz.read_streams(f, size):
                yield s.stream_no, s.offset, s.size, s.check_id, len(s.records), s.uncompressed_size, s.index_size


class XzBlocks:
    """xz_blocks(path): a row per block with its places in the file and in the output."""

    def eval(self, path: str) -> Iterator[tuple]:
        from sluice.plans.decode import open_input

        f, size = open_input(path)
        with f:
            for b in xz.located_blocks(xz.read_streams(f, size)):
                yield b.stream_no, b.block_no, b.file_offset, b.uncompressed_offset, b.unpadded_size, b.padded_size, b.uncompressed_size


class Lzma2Runs:
    """lzma2_runs(path): a row per run of a raw LZMA2 file; payloads are passed over."""

    def eval(self, path: str) -> Iterator[tuple]:
        from sluice.plans.decode import open_input

        f, size = open_input(path)
        with f:
            for r in scan_runs(f, size):
                yield r.run_no, r.in_offset, r.packed_len, r.out_offset, r.unpacked_len


TABLES = {
    "xz_streams": (XzStreams, "stream_no long, stream_offset long, stream_size long, check_id int, block_count long, uncompressed_size long, index_size long"),
    "xz_blocks": (XzBlocks, "stream_no long, block_no long, file_offset long, uncompressed_offset long, unpadded_size long, padded_size long, uncompressed_size long"),
    "lzma2_runs": (Lzma2Runs, "run_no long, in_offset long, packed_len long, out_offset long, unpacked_len long"),
}


def _verdict(data: bytes) -> str:
    try:
        codec.xz_decode(data)
    except StreamError as e:
        return e.kind
    return "good"


#: name -> (function of a row's bytes, SQL type, Arrow type)
SCALARS = {
    "crc64_xz": (lambda x: cs.crc64_hex(cs.crc64_xz(x)), "string", pa.string()),
    "xz_compress": (codec.xz_encode, "binary", pa.binary()),
    "xz_decompress": (codec.xz_decode, "binary", pa.binary()),
    "xz_verdict": (_verdict, "string", pa.string()),
    "lzma_compress": (codec.lzma_alone_encode, "binary", pa.binary()),
    "lzma_decompress": (codec.lzma_alone_decode, "binary", pa.binary()),
    "delta_encode": (bf.delta_encode, "binary", pa.binary()),
    "delta_decode": (bf.delta_decode, "binary", pa.binary()),
} | {f"{kind.lower()}_{way}": (lambda x, kind=kind, encoding=way == "encode": bf.bcj(kind, x, encoding), "binary", pa.binary()) for kind in xz.BCJ_ALIGNMENT for way in ("encode", "decode")}


def _scalar(run, kind: pa.DataType, ddl: str):
    def call(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else run(v) for v in values.to_pylist()], kind)

    return arrow_udf(call, returnType=ddl)


def register(spark: SparkSession) -> None:
    for name, (cls, ddl) in TABLES.items():
        spark.udtf.register(name, udtf(cls, returnType=ddl))
    for name, (run, ddl, kind) in SCALARS.items():
        spark.udf.register(name, _scalar(run, kind, ddl))
