"""The .xz container: pure parsers, and the walk over a seekable file that never reads a block's payload."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import BinaryIO

from sluice.errors import StreamError

# Fixed values of the format.
MAGIC = bytes.fromhex("FD377A585A00")
FOOTER_MAGIC = b"YZ"
CHECK_NAMES = {0: "None", 1: "Crc32", 4: "Crc64", 10: "Sha256"}
LZMA2_ID, DELTA_ID = 0x21, 0x03
BCJ_KINDS = {4: "X86", 5: "Ppc", 6: "Ia64", 7: "Arm", 8: "ArmThumb", 9: "Sparc", 10: "Arm64", 11: "RiscV"}
BCJ_ALIGNMENT = {"X86": 1, "Ppc": 4, "Ia64": 16, "Arm": 4, "ArmThumb": 2, "Sparc": 4, "Arm64": 4, "RiscV": 2}
BCJ_LOOKAHEAD = {"X86": 4, "Ppc": 0, "Ia64": 0, "Arm": 0, "ArmThumb": 2, "Sparc": 0, "Arm64": 0, "RiscV": 6}
VLI_MAX = 2**63 - 1
HEADER_SIZE = FOOTER_SIZE = 12


def check_size(check_id: int) -> int:
    return 0 if check_id == 0 else 4 << ((check_id - 1) // 3)


def check_name(check_id: int) -> str:
    return CHECK_NAMES.get(check_id, f"Reserved({check_id})")


def is_verifiable(check_id: int) -> bool:
    return check_id in CHECK_NAMES


def max_carry(kind: str) -> int:
    """Most bytes that a converter leaves for the next call."""
    return BCJ_ALIGNMENT[kind] + BCJ_LOOKAHEAD[kind] - 1


# ---- variable-length integers


def vli_decode(buf: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it). Shortest encodings of at most 63 bits only."""
    value = 0
    for i in range(9):
        if at + i >= len(buf):
            raise StreamError("TruncatedVli")
        b = buf[at + i]
        if b == 0 and i:
            raise StreamError("BadVli")
        value |= (b & 0x7F) << (7 * i)
        if b < 0x80:
            return value, at + i + 1
    raise StreamError("BadVli")


def vli_encode(value: int) -> bytes:
    if not 0 <= value <= VLI_MAX:
        raise StreamError("BadVli")
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def vli_len(value: int) -> int:
    return max(1, -(-value.bit_length() // 7))


# ---- stream header and footer


def _flags(raw: bytes) -> int:
    if raw[0] or raw[1] & 0xF0:
        raise StreamError("BadStreamFlags")
    return raw[1]


def parse_header(buf: bytes) -> int:
    """12 bytes -> check id. The CRC is trusted before the flags, so corrupt and unsupported are told apart."""
    if len(buf) < HEADER_SIZE:
        raise StreamError("TruncatedInput")
    if buf[:6] != MAGIC:
        raise StreamError("BadMagic")
    if struct.unpack_from("<I", buf, 8)[0] != zlib.crc32(buf[6:8]):
        raise StreamError("HeaderCrc")
    return _flags(buf[6:8])


def parse_footer(buf: bytes) -> tuple[int, int]:
    """12 bytes -> (check id, index size)."""
    if len(buf) < FOOTER_SIZE:
        raise StreamError("TruncatedInput")
    if buf[10:12] != FOOTER_MAGIC:
        raise StreamError("BadFooterMagic")
    crc, backward = struct.unpack_from("<II", buf)
    if crc != zlib.crc32(buf[4:10]):
        raise StreamError("HeaderCrc")
    return _flags(buf[8:10]), (backward + 1) * 4


def probe(buf: bytes) -> int | None:
    """Check id of what starts as an .xz file, else None."""
    try:
        return parse_header(bytes(buf[:HEADER_SIZE]))
    except StreamError:
        return None


def make_header(check_id: int) -> bytes:
    flags = bytes((0, check_id))
    return MAGIC + flags + struct.pack("<I", zlib.crc32(flags))


def make_footer(check_id: int, index_size: int) -> bytes:
    body = struct.pack("<I", index_size // 4 - 1) + bytes((0, check_id))
    return struct.pack("<I", zlib.crc32(body)) + body + FOOTER_MAGIC


# ---- filters and block headers


@dataclass(frozen=True)
class Filter:
    id: int
    props: bytes = b""

    def encoded(self) -> bytes:
        return vli_encode(self.id) + vli_encode(len(self.props)) + self.props


def dict_size_from_prop(prop: int) -> int:
    if not 0 <= prop <= 40:
        raise StreamError("UnsupportedProps")
    return 0xFFFFFFFF if prop == 40 else (2 | (prop & 1)) << (prop // 2 + 11)


def prop_from_dict_size(size: int) -> int:
    return next(p for p in range(41) if dict_size_from_prop(p) >= min(size, 0xFFFFFFFF))


def validate_chain(filters: list[Filter]) -> int:
    """Dictionary property of a legal chain: one to four filters, LZMA2 last and only there, repeats allowed."""
    if not 1 <= len(filters) <= 4:
        raise StreamError("BadFilterChain")
    for i, f in enumerate(filters):
        last = i == len(filters) - 1
        if f.id != LZMA2_ID and f.id != DELTA_ID and f.id not in BCJ_KINDS:
            raise StreamError("UnsupportedFilter")
        if (f.id == LZMA2_ID) != last:
            raise StreamError("BadFilterChain")
        if f.id == DELTA_ID and len(f.props) != 1:
            raise StreamError("BadFilterChain")
        if f.id in BCJ_KINDS:
            if len(f.props) not in (0, 4):
                raise StreamError("BadFilterChain")
            if f.props and int.from_bytes(f.props, "little") % BCJ_ALIGNMENT[BCJ_KINDS[f.id]]:
                raise StreamError("BadFilterChain")
    prop = filters[-1].props
    if len(prop) != 1 or prop[0] > 40:
        raise StreamError("BadFilterChain")
    return prop[0]


@dataclass(frozen=True)
class BlockHeader:
    size: int
    compressed: int | None
    uncompressed: int | None
    filters: tuple[Filter, ...]

    @property
    def dict_prop(self) -> int:
        return self.filters[-1].props[0]

    @property
    def plain(self) -> bool:
        return len(self.filters) == 1

    def unpadded(self, check_id: int) -> int | None:
        return None if self.compressed is None else self.size + self.compressed + check_size(check_id)


def block_header_size(first: int) -> int | None:
    """Size of the header that starts with this byte; None: it is the index."""
    return (first + 1) * 4 if first else None


def parse_block_header(buf: bytes) -> BlockHeader:
    size = block_header_size(buf[0]) if buf else None
    if size is None:
        raise StreamError("BadBlockHeader")
    if len(buf) < size:
        raise StreamError("TruncatedInput")
    body = buf[: size - 4]
    if zlib.crc32(body) != struct.unpack_from("<I", buf, size - 4)[0]:
        raise StreamError("HeaderCrc")
    flags, at = body[1], 2
    if flags & 0x3C:
        raise StreamError("BadBlockHeader")
    sizes: list[int | None] = [None, None]
    for k, bit in enumerate((0x40, 0x80)):
        if flags & bit:
            sizes[k], at = vli_decode(body, at)
    if sizes[0] == 0:
        raise StreamError("BadBlockHeader")
    filters = []
    for _ in range((flags & 3) + 1):
        fid, at = vli_decode(body, at)
        n, at = vli_decode(body, at)
        if at + n > len(body):
            raise StreamError("BadBlockHeader")
        filters.append(Filter(fid, body[at : at + n]))
        at += n
    if any(body[at:]):
        raise StreamError("BadPadding")
    validate_chain(filters)
    return BlockHeader(size, sizes[0], sizes[1], tuple(filters))


def make_block_header(filters: list[Filter], compressed: int | None = None, uncompressed: int | None = None) -> bytes:
    flags = len(filters) - 1 | (0x40 if compressed is not None else 0) | (0x80 if uncompressed is not None else 0)
    body = bytes((flags,)) + b"".join(vli_encode(x) for x in (compressed, uncompressed) if x is not None) + b"".join(f.encoded() for f in filters)
    size = -(-(1 + len(body) + 4) // 4) * 4
    raw = bytes((size // 4 - 1,)) + body
    raw += bytes(size - 4 - len(raw))
    return raw + struct.pack("<I", zlib.crc32(raw))


# ---- the index


def padded(size: int) -> int:
    return (size + 3) & ~3


def parse_index(buf: bytes, most: int | None = None) -> list[tuple[int, int]]:
    """(unpadded, uncompressed) of each record; `buf` is the whole index field. `most` bounds the records."""
    if len(buf) < 8 or len(buf) % 4 or buf[0]:
        raise StreamError("IndexMismatch")
    body = buf[:-4]
    if zlib.crc32(body) != struct.unpack("<I", buf[-4:])[0]:
        raise StreamError("HeaderCrc")
    count, at = vli_decode(body, 1)
    if count > (len(body) - at) // 2:
        raise StreamError("IndexMismatch")
    if most is not None and count > most:
        raise StreamError("MemoryLimit", needed=count, limit=most)
    out = []
    for _ in range(count):
        unpadded, at = vli_decode(body, at)
        uncompressed, at = vli_decode(body, at)
        if unpadded < 5:
            raise StreamError("IndexMismatch")
        out.append((unpadded, uncompressed))
    rest = body[at:]
    if len(rest) > 3 or any(rest):
        raise StreamError("BadPadding")
    return out


def make_index(records: list[tuple[int, int]]) -> bytes:
    body = b"\0" + vli_encode(len(records)) + b"".join(vli_encode(a) + vli_encode(b) for a, b in records)
    body += bytes(-len(body) % 4)
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass(frozen=True)
class Block:
    stream_no: int
    block_no: int
    file_offset: int
    uncompressed_offset: int
    unpadded_size: int
    uncompressed_size: int
    check_id: int

    @property
    def padded_size(self) -> int:
        return padded(self.unpadded_size)


@dataclass(frozen=True)
class Stream:
    stream_no: int
    offset: int
    size: int
    check_id: int
    index_size: int
    records: tuple[tuple[int, int], ...]

    @property
    def uncompressed_size(self) -> int:
        return sum(u for _, u in self.records)

    @property
    def blocks_size(self) -> int:
        return sum(padded(p) for p, _ in self.records)

    @property
    def largest_block(self) -> int:
        return max((u for _, u in self.records), default=0)


def _read(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) < n:
        raise StreamError("TruncatedInput", offset=at)
    return got


def stream_ending_at(f: BinaryIO, end: int, most_records: int | None = None) -> Stream:
    """The stream whose footer ends at `end`: footer, index, header; payloads are not read."""
    if end < HEADER_SIZE + FOOTER_SIZE:
        raise StreamError("TruncatedInput", offset=end)
    try:
        check, index_size = parse_footer(_read(f, end - FOOTER_SIZE, FOOTER_SIZE))
        index_at = end - FOOTER_SIZE - index_size
        if index_at < HEADER_SIZE:
            raise StreamError("IndexMismatch")
        records = parse_index(_read(f, index_at, index_size), most_records)
        start = index_at - sum(padded(p) for p, _ in records) - HEADER_SIZE
        if start < 0:
            raise StreamError("IndexMismatch")
        if parse_header(_read(f, start, HEADER_SIZE)) != check:
            raise StreamError("StreamFlagsMismatch")
    except StreamError as e:
        raise e.at(offset=end - FOOTER_SIZE) from None
    return Stream(0, start, end - start, check, index_size, tuple(records))


def read_streams(f: BinaryIO, size: int, most_records: int | None = None, concatenated: bool = True) -> list[Stream]:
    """All streams of a file, found backward from its end over padding of whole null 4-byte groups."""
    out: list[Stream] = []
    end = size
    if not size:
        raise StreamError("TruncatedInput", offset=0)
    while end > 0:
        pad = 0
        while end - pad >= 4 and _read(f, end - pad - 4, 4) == b"\0\0\0\0":
            pad += 4
        if pad and end == pad:
            raise StreamError("BadMagic", offset=0)
        try:
            s = stream_ending_at(f, end - pad, most_records)
        except StreamError as e:
            if out and e.kind in ("BadFooterMagic", "TruncatedInput"):
                raise StreamError("BadMagic", offset=0) from None
            if e.kind == "BadFooterMagic" and not out:
                raise (StreamError("BadMagic", 0, offset=0) if probe(_read(f, 0, min(12, size))) is None else _tail_error(f, size, e)) from None
            raise
        if (size - end) + pad and not concatenated and not out:
            raise StreamError("TrailingGarbage", offset=end - pad)
        out.append(s)
        end = s.offset
    if len(out) > 1 and not concatenated:
        raise StreamError("TrailingGarbage", offset=out[-1].offset + out[-1].size)
    return [Stream(i, s.offset, s.size, s.check_id, s.index_size, s.records) for i, s in enumerate(reversed(out))]


def _tail_error(f: BinaryIO, size: int, e: StreamError) -> StreamError:
    """The file begins well but no footer ends it: something follows a whole stream, or the end is missing."""
    f.seek(0)
    data = f.read(min(size, 1 << 20))
    at = data.rfind(FOOTER_MAGIC)
    while at >= 10:
        try:
            parse_footer(data[at - 10 : at + 2])
            return StreamError("TrailingGarbage", offset=at + 2)
        except StreamError:
            at = data.rfind(FOOTER_MAGIC, 0, at)
    return e.at(0)


def located_blocks(streams: list[Stream]) -> list[Block]:
    """Every block with its place in the file and in the output."""
    out, unpacked = [], 0
    for s in streams:
        at = s.offset + HEADER_SIZE
        for n, (unpadded, uncompressed) in enumerate(s.records):
            out.append(Block(s.stream_no, n, at, unpacked, unpadded, uncompressed, s.check_id))
            at += padded(unpadded)
            unpacked += uncompressed
    return out


def stored_stream(blocks: list[dict], check_id: int = 0) -> bytes:
    """A hand-built stream for tests: blocks of stored chunks, whose header and index sizes may be made to lie.

    Each block: payload, and optionally header_compressed, header_uncompressed, index_uncompressed, first_control.
    """
    from sluice.sources.lzma2 import stored_chunks

    out, records = bytearray(make_header(check_id)), []
    for b in blocks:
        packed = stored_chunks(b["payload"], first=b.get("first_control", 1))
        head = make_block_header([Filter(LZMA2_ID, b"\0")], b.get("header_compressed"), b.get("header_uncompressed"))
        body = head + packed + bytes(-len(packed) % 4) + bytes(check_size(check_id))
        out += body
        records.append((len(head) + len(packed) + check_size(check_id), b.get("index_uncompressed", len(b["payload"]))))
    index = make_index(records)
    return bytes(out + index + make_footer(check_id, len(index)))
