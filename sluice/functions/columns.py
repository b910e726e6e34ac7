"""Column functions. Expressions of Spark's own where they say it; Arrow UDFs for bulk byte work."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sluice.errors import StreamError
from sluice.functions import checksum as cs
from sluice.operators import byte_filters as bf
from sluice.operators import codec
from sluice.sources import xz


def _hex_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def bytes_at(content: Column, start: int, n: int) -> Column:
    return F.substring(content, start + 1, n)


def uint_le(raw: Column, n: int) -> Column:
    """Unsigned little-endian number of the n bytes of `raw` (n <= 7)."""
    text = F.hex(raw)
    return _hex_long(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))]))


def crc32(content: Column) -> Column:
    return F.crc32(content)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def crc64_hex_expr(content: Column) -> Column:
    """CRC-64/XZ by expressions only: for short values. crc64_hex() is the one for bulk."""
    table = F.array(*[F.lit(x - (x >> 63 << 64)) for x in cs.crc_table(64)])
    text = F.hex(content)
    octet = lambda i: _hex_long(F.substr(text, 2 * i + 1, F.lit(2)))
    step = lambda s, i: F.element_at(table, (s.bitwiseXOR(octet(i)).bitwiseAND(255) + 1).cast("int")).bitwiseXOR(F.shiftrightunsigned(s, 8))
    n = F.octet_length(content)
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(-1).cast("long"), step)
    return F.lpad(F.hex(F.when(n == 0, F.lit(0).cast("long")).otherwise(F.bitwise_not(folded))), 16, "0")


def _each(kind: str, run: Callable, *columns: Column) -> Column:
    """A scalar Arrow UDF: run(values of a row) -> value; null where any argument is null. Hash hooks go along."""
    run = cs.carried(run)

    def call(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if None in r else run(*r) for r in rows], out)

    out = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}.get(kind)
    if out is None:
        out = _STRUCTS[kind]
    parts = len(columns)
    # arrow_udf reads the signature's annotations, so one function for each number of arguments
    if parts == 1:
        def one(a: pa.Array) -> pa.Array:
            return call(a)
        f = one
    elif parts == 2:
        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return call(a, b)
        f = two
    elif parts == 3:
        def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return call(a, b, c)
        f = three
    else:
        def five(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array) -> pa.Array:
            return call(a, b, c, d, e)
        f = five
    return arrow_udf(f, returnType=_DDL.get(kind, kind))(*columns)


_STRUCTS = {
    "bcj2": pa.struct([("main", pa.binary()), ("call", pa.binary()), ("jump", pa.binary()), ("rc", pa.binary())]),
    "lzma2": pa.struct([("prop", pa.int32()), ("data", pa.binary())]),
    "segments": pa.list_(pa.struct([("offset", pa.int64()), ("len", pa.int64()), ("crc32", pa.int64()), ("crc64_hex", pa.string())])),
}
_DDL = {"bcj2": "main binary, call binary, jump binary, rc binary", "lzma2": "prop int, data binary", "segments": "array<struct<offset:long,len:long,crc32:long,crc64_hex:string>>"}
# fmt: off
def crc64_hex(content: Column) -> Column:
    def run(values: pa.Array) -> pa.Array:
        rows = values.to_pylist()
        found = iter(cs.crc64_many([v for v in rows if v is not None]))
        return pa.array([None if v is None else cs.crc64_hex(next(found)) for v in rows], pa.string())

    return arrow_udf(run, returnType="string")(content)


def crc32_combine(a: Column, b: Column, len_b: Column) -> Column:
    return _each("long", cs.crc32_combine, a, b, len_b)


def crc64_combine_hex(a: Column, b: Column, len_b: Column) -> Column:
    return _each("string", lambda x, y, n: cs.crc64_hex(cs.crc64_combine(int(x, 16), int(y, 16), n)), a, b, len_b)


def segments(offset: Column, content: Column, plan: cs.ChecksumPlan) -> Column:
    """Segments of each row's bytes as the plan cuts them, with their CRCs."""
    def run(at, data):
        return [{"offset": s["offset"], "len": s["len"], "crc32": s["check"] if plan.kind == "Crc32" else None, "crc64_hex": cs.crc64_hex(s["check"]) if plan.kind == "Crc64Xz" else None} for s in plan.segments(at, data)]
    return _each("segments", run, offset, content)


def delta_encode(content: Column, distance: int = 1) -> Column:
    return _each("binary", lambda x: bf.delta_encode(x, distance), content)


def delta_decode(content: Column, distance: int = 1) -> Column:
    return _each("binary", lambda x: bf.delta_decode(x, distance), content)


def bcj_encode(content: Column, kind: str, start_offset: int = 0) -> Column:
    return _each("binary", lambda x: bf.bcj(kind, x, True, start_offset), content)


def bcj_decode(content: Column, kind: str, start_offset: int = 0) -> Column:
    return _each("binary", lambda x: bf.bcj(kind, x, False, start_offset), content)


def bcj2_encode(content: Column, relat_limit: int = bf.RELAT_LIMIT) -> Column:
    return _each("bcj2", lambda x: bf.bcj2_encode(x, relat_limit).__dict__, content)


def bcj2_decode(streams: Column, size: Column) -> Column:
    return _each("binary", bf.bcj2_decode, streams["main"], streams["call"], streams["jump"], streams["rc"], size)


def filter_encode(content: Column, filters: list[xz.Filter]) -> Column:
    return _each("binary", lambda x: bf.encode_chain(filters, x), content)


def filter_decode(content: Column, filters: list[xz.Filter]) -> Column:
    return _each("binary", lambda x: bf.decode_chain(filters, x), content)


def xz_compress(content: Column, encoder: codec.Encoder | None = None) -> Column:
    return _each("binary", lambda x: codec.xz_encode(x, encoder), content)


def xz_decompress(content: Column, limits: codec.Limits | None = None) -> Column:
    return _each("binary", lambda x: codec.xz_decode(x, limits), content)


def try_xz_decompress(content: Column, limits: codec.Limits | None = None) -> Column:
    """As xz_decompress; null where that is an error."""
    def run(x):
        try:
            return codec.xz_decode(x, limits)
        except StreamError:
            return None
    return _each("binary", run, content)


def xz_verdict(content: Column, limits: codec.Limits | None = None) -> Column:
    """good, or the kind of the error that decoding meets."""
    def run(x):
        try:
            codec.xz_decode(x, limits)
        except StreamError as e:
            return e.kind
        return "good"
    return _each("string", run, content)


def lzma2_compress(content: Column, encoder: codec.Encoder | None = None) -> Column:
    def run(x):
        prop, data = codec.lzma2_encode(x, encoder)
        return {"prop": prop, "data": data}
    return _each("lzma2", run, content)


def lzma2_decompress(packed: Column) -> Column:
    return _each("binary", lambda prop, x: codec.lzma2_decode(x, prop), packed["prop"], packed["data"])


def lzma_compress(content: Column, preset: int = 6) -> Column:
    return _each("binary", lambda x: codec.lzma_alone_encode(x, preset), content)


def lzma_decompress(content: Column, memory_limit: int = 512 << 20) -> Column:
    return _each("binary", lambda x: codec.lzma_alone_decode(x, memory_limit), content)


def stored_lzma2(content: Column, chunk: int = 65536) -> Column:
    from sluice.sources.lzma2 import stored_chunks
    return _each("binary", lambda x: stored_chunks(x, chunk), content)
# fmt: on


# ---- numbers of the format, as expressions


def padded_size(unpadded: Column) -> Column:
    return F.expr("bigint(0)") + (unpadded + 3 - F.pmod(unpadded + 3, F.lit(4)))


def check_size(check_id: Column) -> Column:
    return F.when(check_id == 0, 0).otherwise(F.call_function("shiftleft", F.lit(4), F.floor((check_id - 1) / 3).cast("int")))


def check_name(check_id: Column) -> Column:
    out = F.concat(F.lit("Reserved("), check_id.cast("string"), F.lit(")"))
    for k, v in xz.CHECK_NAMES.items():
        out = F.when(check_id == k, v).otherwise(out)
    return out


def is_verifiable(check_id: Column) -> Column:
    return check_id.isin(list(xz.CHECK_NAMES))


def vli_len(value: Column) -> Column:
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(value < (1 << 7 * n), n).otherwise(out)
    return out


def vli_hex(value: Column) -> Column:
    """The encoding, as hex digits."""
    n = vli_len(value)
    group = lambda i: F.call_function("shiftright", value, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("long"))
    octets = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(group(i) + F.when(i < n - 1, 128).otherwise(0)), 2, "0"))
    return F.array_join(octets, "")


def vli_value(text: Column) -> Column:
    """The number that hex digits encode; null unless it is the shortest encoding of at most nine bytes."""
    n = F.length(text) / 2
    octet = lambda i: _hex_long(F.substr(text, 2 * i + 1, F.lit(2)))
    places = F.sequence(F.lit(0), (n - 1).cast("int"))
    value = F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", octet(i).bitwiseAND(F.lit(127).cast("long")), (i * 7).cast("int"))))
    good = F.forall(places, lambda i: (octet(i) >= 128) == (i < n - 1)) & ((n == 1) | (octet((n - 1).cast("int")) != 0))
    return F.when((n >= 1) & (n <= 9) & good, value)


def dict_size_from_prop(prop: Column) -> Column:
    size = F.call_function("shiftleft", F.lit(2).cast("long") + F.pmod(prop, F.lit(2)), F.floor(prop / 2).cast("int") + 11)
    return F.when((prop < 0) | (prop > 40), None).when(prop == 40, F.lit(0xFFFFFFFF)).otherwise(size)


def window_len(dict_size: Column) -> Column:
    """Bytes of the buffer for a dictionary: a multiple of 4 KiB, 1 MiB or 4 MiB."""
    unit = F.when(dict_size >= 1 << 30, F.lit(1 << 22)).when(dict_size >= 1 << 22, F.lit(1 << 20)).otherwise(F.lit(1 << 12))
    return (F.ceil(dict_size / unit) * unit).cast("long")


def auto_block_size(dict_size: Column) -> Column:
    """Four dictionaries, from 1 to 256 MiB, no less than one, in whole MiB."""
    size = F.greatest(F.least(F.greatest(dict_size * 4, F.lit(1 << 20)), F.lit(1 << 28)), dict_size)
    return (F.ceil(size / (1 << 20)) * (1 << 20)).cast("long")


def worker_window(prop: Column) -> Column:
    size = dict_size_from_prop(prop)
    return F.greatest(auto_block_size(size), window_len(size))


def clamped_dict(prop: Column, unpacked: Column) -> Column:
    return F.least(dict_size_from_prop(prop), F.greatest(unpacked, F.lit(4096)))


def lzma_props_hex(lc: Column, lp: Column, pb: Column, dict_size: Column) -> Column:
    size = F.lpad(F.hex(dict_size), 8, "0")
    return F.concat(F.lpad(F.hex((pb * 5 + lp) * 9 + lc), 2, "0"), *[F.substring(size, k, 2) for k in (7, 5, 3, 1)])


def stream_header(content: Column) -> Column:
    """struct(kind, check_id) of the first 12 bytes: magic, then CRC, then flags are tested."""
    flags = bytes_at(content, 6, 2)
    high, low = uint_le(bytes_at(content, 6, 1), 1), uint_le(bytes_at(content, 7, 1), 1)
    kind = (
        F.when(F.octet_length(content) < 12, "TruncatedInput")
        .when(bytes_at(content, 0, 6) != F.unhex(F.lit(xz.MAGIC.hex())), "BadMagic")
        .when(uint_le(bytes_at(content, 8, 4), 4) != F.crc32(flags), "HeaderCrc")
        .when((high != 0) | (low >= 16), "BadStreamFlags")
        .otherwise("good")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "good", low).alias("check_id"))


def stream_footer(content: Column) -> Column:
    """struct(kind, check_id, index_size) of 12 bytes."""
    high, low = uint_le(bytes_at(content, 8, 1), 1), uint_le(bytes_at(content, 9, 1), 1)
    kind = (
        F.when(F.octet_length(content) < 12, "TruncatedInput")
        .when(bytes_at(content, 10, 2) != F.unhex(F.lit(xz.FOOTER_MAGIC.hex())), "BadFooterMagic")
        .when(uint_le(bytes_at(content, 0, 4), 4) != F.crc32(bytes_at(content, 4, 6)), "HeaderCrc")
        .when((high != 0) | (low >= 16), "BadStreamFlags")
        .otherwise("good")
    )
    good = kind == "good"
    return F.struct(kind.alias("kind"), F.when(good, low).alias("check_id"), F.when(good, (uint_le(bytes_at(content, 4, 4), 4) + 1) * 4).alias("index_size"))


def lzma_header(content: Column) -> Column:
    """struct(lc, lp, pb, dict_size, unpacked) of the 13-byte .lzma header; null where the properties are not legal.
    unpacked is null for "unknown" (all ones)."""
    first = uint_le(bytes_at(content, 0, 1), 1)
    size = bytes_at(content, 5, 8)
    parts = F.struct(
        (first % 9).cast("int").alias("lc"), (F.floor(first / 9) % 5).cast("int").alias("lp"), F.floor(first / 45).cast("int").alias("pb"),
        F.greatest(uint_le(bytes_at(content, 1, 4), 4), F.lit(4096)).alias("dict_size"),
        F.when(size != F.unhex(F.lit("F" * 16)), uint_le(F.substring(size, 1, 7), 7)).alias("unpacked"),
    )
    return F.when((F.octet_length(content) >= 13) & (first < 225), parts)


def block_header(content: Column) -> Column:
    """struct(kind, header_size, compressed, uncompressed, dict_prop, filters) of a block header's bytes."""
    from sluice.sources.xz import parse_block_header

    filters = pa.list_(pa.struct([("id", pa.int64()), ("props", pa.binary())]))
    kind = pa.struct([("kind", pa.string()), ("header_size", pa.int32()), ("compressed", pa.int64()), ("uncompressed", pa.int64()), ("dict_prop", pa.int32()), ("filters", filters)])

    def run(a: pa.Array) -> pa.Array:
        out = []
        for raw in a.to_pylist():
            try:
                h = parse_block_header(raw or b"")
                out.append({"kind": "good", "header_size": h.size, "compressed": h.compressed, "uncompressed": h.uncompressed, "dict_prop": h.dict_prop, "filters": [{"id": f.id, "props": f.props} for f in h.filters]})
            except StreamError as e:
                out.append({"kind": e.kind})
        return pa.array(out, kind)

    return arrow_udf(run, returnType="kind string, header_size int, compressed long, uncompressed long, dict_prop int, filters array<struct<id:long,props:binary>>")(content)


def chain_is_legal(filters: Column) -> Column:
    """Of array<struct<id, props>>: one to four filters, the last LZMA2 with a property of at most 40, the others
    delta or converters whose start offset is aligned."""
    last = F.element_at(filters, -1)
    prop = lambda f: F.coalesce(uint_le(F.substring(f["props"], 1, 1), 1), F.lit(-1))

    def earlier(f):
        unit = F.lit(1)
        for k, name in xz.BCJ_KINDS.items():
            unit = F.when(f["id"] == k, xz.BCJ_ALIGNMENT[name]).otherwise(unit)
        n = F.octet_length(f["props"])
        delta = (f["id"] == xz.DELTA_ID) & (n == 1)
        bcj = f["id"].isin(list(xz.BCJ_KINDS)) & ((n == 0) | ((n == 4) & (uint_le(f["props"], 4) % unit == 0)))
        return delta | bcj

    head = F.slice(filters, 1, F.greatest(F.size(filters) - 1, F.lit(0)))
    return F.size(filters).between(1, 4) & (last["id"] == xz.LZMA2_ID) & (F.octet_length(last["props"]) == 1) & prop(last).between(0, 40) & F.forall(head, earlier)
