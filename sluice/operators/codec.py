"""Compressing and decompressing buffers, blocks and runs with liblzma underneath.

Structure is checked by this package's own parsers; liblzma decodes LZMA2 and nothing else is asked of it, so
corrupt data, a failed check and an exceeded limit are told apart.
"""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator
from dataclasses import dataclass, field

from sluice.errors import StreamError
from sluice.functions.checksum import RunningCheck, check_bytes
from sluice.operators.byte_filters import ChunkedChain, decode_chain, encode_chain
from sluice.sources import xz
from sluice.sources.lzma2 import LzmaProps, Run, chunks, parse_lzma_header, scan_runs

CHECK_IDS = {"none": 0, "crc32": 1, "crc64": 4, "sha256": 10}


@dataclass(frozen=True)
class Encoder:
    """How to compress: liblzma preset, check, block size (0: solid), filters before LZMA2, other LZMA2 settings."""

    preset: int = 6
    check: str = "crc64"
    block_size: int = 0
    filters: tuple[xz.Filter, ...] = ()
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.check not in CHECK_IDS or not 0 <= self.preset & ~lzma.PRESET_EXTREME <= 9 or self.block_size < 0:
            raise StreamError("Param")
        xz.validate_chain([*self.filters, xz.Filter(xz.LZMA2_ID, b"\0")])

    @property
    def spec(self) -> list[dict]:
        return [{"id": lzma.FILTER_LZMA2, "preset": self.preset, **self.settings}]

    @property
    def dict_size(self) -> int:
        # fixed values: dictionary sizes of the presets
        powers = (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)
        return self.settings.get("dict_size") or 1 << powers[self.preset & ~lzma.PRESET_EXTREME]


@dataclass(frozen=True)
class Limits:
    """What a decode may use: dictionary memory, bytes of a block and of the whole output; and how checks are taken."""

    memory: int = 2**40
    max_block_size: int = 64 << 30
    max_unpack_bytes: int | None = None
    verify: bool = True
    allow_unverifiable: bool = False
    concatenated: bool = True


# ---- LZMA2


def lzma2_encode(data: bytes, enc: Encoder | None = None) -> tuple[int, bytes]:
    """(dictionary property, stream). Block sizes cut the input into runs that decode independently."""
    enc = enc or Encoder()
    prop = xz.prop_from_dict_size(enc.dict_size)
    size = enc.block_size or max(1, len(data))
    parts = [lzma.compress(data[i : i + size], lzma.FORMAT_RAW, filters=enc.spec)[:-1] for i in range(0, len(data), size)]
    return prop, b"".join(parts) + b"\0"


def lzma2_decode(data: bytes, prop: int, size: int | None = None, memory: int = 2**40) -> bytes:
    """A whole LZMA2 stream, end marker included. `size`: the most bytes it may come to."""
    dictionary = xz.dict_size_from_prop(prop)
    if size is not None:
        dictionary = min(dictionary, max(size, 4096))
    if dictionary > memory:
        raise StreamError("MemoryLimit", needed=dictionary, limit=memory)
    # the dictionary need not be larger than the chunks say the output is; liblzma allocates what it is told
    total = sum(c.unpacked_len for c in chunks(data))
    if size is not None and total > size:
        raise StreamError("SizeMismatch", needed=total, limit=size)
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, min(dictionary, total))}])
    try:
        out = d.decompress(data)
    except lzma.LZMAError:
        raise StreamError("CorruptData") from None
    if not d.eof:
        raise StreamError("Truncated")
    if d.unused_data:
        raise StreamError("TrailingGarbage")
    return out


def decode_run(packed: bytes, run: Run, prop: int, memory: int = 2**40) -> bytes:
    """One run on its own: its bytes and an end marker are a stream."""
    try:
        out = lzma2_decode(packed + b"\0", prop, run.unpacked_len, memory)
    except StreamError as e:
        raise (StreamError("CorruptRun", block=run.run_no, offset=run.in_offset) if e.kind != "MemoryLimit" else e) from None
    if len(out) != run.unpacked_len:
        raise StreamError("CorruptRun", block=run.run_no, offset=run.in_offset)
    return out


def runs_of(data: bytes) -> list[Run]:
    return list(scan_runs(io.BytesIO(data), len(data)))


# ---- LZMA1 and .lzma


def lzma1_encode(data: bytes, preset: int = 6) -> tuple[LzmaProps, bytes]:
    """(props, raw LZMA1 with an end marker)."""
    raw = lzma.compress(data, lzma.FORMAT_ALONE, preset=preset)
    return LzmaProps.parse(raw[:5]), raw[13:]


def lzma1_decode(data: bytes, props: LzmaProps, size: int | None = None, memory: int = 512 << 20) -> bytes:
    if props.dict_size > memory:
        raise StreamError("MemoryLimit", needed=props.dict_size, limit=memory)
    head = props.encoded() + (size if size is not None else 2**64 - 1).to_bytes(8, "little")
    return lzma_alone_decode(head + data, memory)


def lzma_alone_encode(data: bytes, preset: int = 6) -> bytes:
    """A .lzma file that names its size. It also keeps the end marker, which readers accept."""
    raw = lzma.compress(data, lzma.FORMAT_ALONE, preset=preset)
    return raw[:5] + len(data).to_bytes(8, "little") + raw[13:]


def lzma_alone_decode(data: bytes, memory: int = 512 << 20) -> bytes:
    props, size = parse_lzma_header(data)
    if props.dict_size > memory:
        raise StreamError("MemoryLimit", needed=props.dict_size, limit=memory)
    d = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
    try:
        out = d.decompress(data)
    except lzma.LZMAError:
        raise StreamError("CorruptData") from None
    if size is not None and len(out) != size:
        raise StreamError("Truncated" if len(out) < size else "CorruptData")
    if size is None and not d.eof:
        raise StreamError("Truncated")
    return out


# ---- .xz


def encode_block(data: bytes, enc: Encoder) -> tuple[bytes, int, int]:
    """(header, payload, padding and check; unpadded size; uncompressed size). The check covers the data as given. The
    dictionary is no larger than the block needs, so neither side allocates more."""
    size = min(enc.dict_size, max(4096, 1 << (len(data) - 1).bit_length()))
    filters = [*enc.filters, xz.Filter(xz.LZMA2_ID, bytes((xz.prop_from_dict_size(size),)))]
    spec = [{**enc.spec[0], "dict_size": size}]
    packed = lzma.compress(encode_chain(list(enc.filters), data), lzma.FORMAT_RAW, filters=spec)
    head = xz.make_block_header(filters, len(packed), len(data))
    check = check_bytes(CHECK_IDS[enc.check], data)
    return head + packed + bytes(-len(packed) % 4) + check, len(head) + len(packed) + len(check), len(data)


def assemble(check_id: int, blocks: list[tuple[bytes, int, int]]) -> bytes:
    """A stream of encoded blocks in their order."""
    index = xz.make_index([(u, n) for _, u, n in blocks])
    return xz.make_header(check_id) + b"".join(b for b, _, _ in blocks) + index + xz.make_footer(check_id, len(index))


def cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] if size else ([data] if data else [])


def xz_encode(data: bytes, enc: Encoder | None = None) -> bytes:
    enc = enc or Encoder()
    return assemble(CHECK_IDS[enc.check], [encode_block(p, enc) for p in cut(data, enc.block_size)])


class XzWriter:
    """Push bytes; blocks are cut at block_size; finish() gives the rest, index and footer."""

    def __init__(self, enc: Encoder | None = None):
        self.enc, self.held, self.records, self.begun = enc or Encoder(), bytearray(), [], False

    def push(self, data: bytes) -> bytes:
        out = b"" if self.begun else xz.make_header(CHECK_IDS[self.enc.check])
        self.begun = True
        self.held += data
        size = self.enc.block_size
        while size and len(self.held) >= size:
            out += self._block(bytes(self.held[:size]))
            del self.held[:size]
        return out

    def _block(self, data: bytes) -> bytes:
        raw, unpadded, n = encode_block(data, self.enc)
        self.records.append((unpadded, n))
        return raw

    def finish(self) -> bytes:
        out = self.push(b"")
        if self.held:
            out += self._block(bytes(self.held))
        index = xz.make_index(self.records)
        return out + index + xz.make_footer(CHECK_IDS[self.enc.check], len(index))


class Lzma2Writer:
    """Push bytes to a raw LZMA2 stream: each `size` of them are a run that decodes on its own."""

    def __init__(self, enc: Encoder | None = None, size: int = 16 << 20):
        self.enc, self.size, self.held = enc or Encoder(), size, bytearray()

    def push(self, data: bytes) -> bytes:
        self.held += data
        out = []
        while len(self.held) >= self.size:
            out.append(lzma2_encode(bytes(self.held[: self.size]), self.enc)[1][:-1])
            del self.held[: self.size]
        return b"".join(out)

    def finish(self) -> bytes:
        return lzma2_encode(bytes(self.held), self.enc)[1]


class LzmaWriter:
    """Push bytes to a .lzma stream; the encoder holds its window only. The size isn't known ahead, so the header says
    so, and the stream ends by its marker."""

    def __init__(self, preset: int = 6):
        self.c = lzma.LZMACompressor(lzma.FORMAT_ALONE, preset=preset)

    def push(self, data: bytes) -> bytes:
        return self.c.compress(data)

    def finish(self) -> bytes:
        return self.c.flush()


class Lzma1Writer(LzmaWriter):
    """Push bytes to raw LZMA1; `props` are known once something has been put out."""

    def __init__(self, preset: int = 6):
        super().__init__(preset)
        self.head, self.props = b"", None

    def _bare(self, out: bytes) -> bytes:
        if self.props is None:
            self.head += out
            if len(self.head) < 13:
                return b""
            self.props, out = LzmaProps.parse(self.head[:5]), self.head[13:]
        return out

    def push(self, data: bytes) -> bytes:
        return self._bare(super().push(data))

    def finish(self) -> bytes:
        return self._bare(super().finish())


def decode_block(raw: bytes, block: xz.Block, limits: Limits | None = None) -> bytes:
    """One block (its unpadded bytes, or padded) that the index describes."""
    limits = limits or Limits()
    where = {"stream": block.stream_no, "block": block.block_no, "offset": block.file_offset}
    try:
        if limits.verify and not limits.allow_unverifiable and not xz.is_verifiable(block.check_id):
            raise StreamError("UnsupportedCheck")
        if block.uncompressed_size > limits.max_block_size:
            raise StreamError("SizeMismatch", needed=block.uncompressed_size, limit=limits.max_block_size)
        if len(raw) < block.unpadded_size:
            raise StreamError("TruncatedInput")
        head = xz.parse_block_header(raw)
        tail = xz.check_size(block.check_id)
        n = block.unpadded_size - head.size - tail
        if n <= 0 or head.compressed not in (None, n) or head.uncompressed not in (None, block.uncompressed_size):
            raise StreamError("SizeMismatch")
        pad = -n % 4
        at = head.size + n
        if any(raw[at : at + pad]):
            raise StreamError("BadPadding")
        try:
            data = lzma2_decode(raw[head.size : at], head.dict_prop, block.uncompressed_size, limits.memory)
        except StreamError as e:
            if e.kind in ("MemoryLimit", "SizeMismatch"):
                raise
            raise StreamError("SizeMismatch" if e.kind == "TrailingGarbage" else "Lzma") from None
        if len(data) != block.uncompressed_size:
            raise StreamError("SizeMismatch")
        data = decode_chain(list(head.filters[:-1]), data)
        if limits.verify and xz.is_verifiable(block.check_id) and raw[at + pad : at + pad + tail] != check_bytes(block.check_id, data):
            raise StreamError("CheckMismatch")
    except StreamError as e:
        raise e.at(**where) from None
    return data


def blocks_of(data: bytes, limits: Limits | None = None) -> list[xz.Block]:
    limits = limits or Limits()
    return xz.located_blocks(xz.read_streams(io.BytesIO(data), len(data), concatenated=limits.concatenated))


def iter_decoded(data: bytes, limits: Limits | None = None) -> Iterator[tuple[xz.Block, bytes]]:
    """Blocks in file order. Those before a bad one come out first; then the error is raised."""
    limits, total = limits or Limits(), 0
    for b in blocks_of(data, limits):
        total += b.uncompressed_size
        if limits.max_unpack_bytes is not None and total > limits.max_unpack_bytes:
            raise StreamError("TooMuchOutput", b.stream_no, b.block_no, b.file_offset, total, limits.max_unpack_bytes)
        yield b, decode_block(data[b.file_offset : b.file_offset + b.padded_size], b, limits)


def xz_decode(data: bytes, limits: Limits | None = None) -> bytes:
    return b"".join(d for _, d in iter_decoded(data, limits))


class _OpenBlock:
    """A block that is decoded as its chunks arrive: liblzma holds the dictionary, the filters their tails, the check
    its sum."""

    def __init__(self, header: bytes, check: int, limits: Limits):
        from sluice.sources.lzma2 import RunScanner

        self.head, self.header_size, self.check_id, self.limits = xz.parse_block_header(header), len(header), check, limits
        size = xz.dict_size_from_prop(self.head.dict_prop)
        if size > limits.memory:
            raise StreamError("MemoryLimit", needed=size, limit=limits.memory)
        self.raw = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, size)}])
        self.filters = ChunkedChain(list(self.head.filters[:-1]), False) if len(self.head.filters) > 1 else None
        self.sum = RunningCheck(check) if limits.verify and xz.is_verifiable(check) else None
        self.scanner, self.ended, self.packed, self.decoded, self.unpacked = RunScanner(), False, 0, 0, 0

    def chunk_size(self, held: bytearray) -> int | None:
        """Bytes of the chunk at the front, once its header is there."""
        if held and held[0] == 0:
            return 1
        self.scanner.head = bytes(held[:6])
        try:
            c = self.scanner._parse()
        except StreamError:
            raise StreamError("Lzma") from None
        if c is None:
            return None
        self.next = c
        return c.header_len + c.payload_len

    def push(self, chunk: bytes, left: int | None) -> bytes:
        self.packed += len(chunk)
        if chunk[0] == 0:
            self.ended = True
        else:
            self.scanner._take(self.next)
            self.decoded += self.next.unpacked_len
            if left is not None and self.next.unpacked_len > left:
                raise StreamError("TooMuchOutput", needed=self.next.unpacked_len, limit=left)
            if self.decoded > min(self.limits.max_block_size, self.head.uncompressed if self.head.uncompressed is not None else self.limits.max_block_size):
                raise StreamError("SizeMismatch", needed=self.decoded)
        try:
            out = self.raw.decompress(chunk)
        except lzma.LZMAError:
            raise StreamError("Lzma") from None
        return self._checked(self.filters.push(out) if self.filters else out)

    def _checked(self, out: bytes) -> bytes:
        self.unpacked += len(out)
        if self.sum:
            self.sum.push(out)
        return out

    def finish(self, pad: bytes, check: bytes) -> bytes:
        rest = self._checked(self.filters.finish()) if self.filters else b""
        if any(pad):
            raise StreamError("BadPadding")
        if self.head.compressed not in (None, self.packed) or self.head.uncompressed not in (None, self.unpacked) or self.unpacked != self.decoded:
            raise StreamError("SizeMismatch")
        if self.sum and self.sum.digest() != check:
            raise StreamError("CheckMismatch")
        return rest


class SequentialDecoder:
    """The forward path: header, blocks, index, footer, padding; the index is compared with what was decoded.

    For files whose end can't be read first. Block ends are found from the chunk headers, each looked at once however
    the bytes arrive, so sizes need not be declared. push() returns decoded bytes of whole, checked blocks; with
    `chase`, what is decoded of a block as its chunks arrive, and the error if its check fails at the end. Then no more
    than a chunk and the dictionary is held, however large a block is.
    """

    def __init__(self, limits: Limits | None = None, chase: bool = False):
        self.limits, self.held, self.at, self.chase = limits or Limits(), bytearray(), 0, chase
        self.open: _OpenBlock | None = None
        self.scanned: tuple | None = None  # scanner and place of the block that is arriving
        self.stream = self.block = self.total = 0
        self.state, self.check, self.records = "header", 0, []
        self.error: StreamError | None = None

    def push(self, data: bytes) -> Iterator[bytes]:
        if self.error:
            raise self.error
        self.held += data
        try:
            while (got := self._step()) is not None:
                if got:
                    yield got
        except StreamError as e:
            self.error = e.at(self.stream, self.block, self.at)
            raise self.error from None

    def finish(self) -> None:
        if self.error:
            raise self.error
        if self.state == "padding" and not self.held and not self.pad % 4:
            return
        if self.state == "padding":
            raise StreamError("TrailingGarbage" if any(self.held) else "BadPadding", self.stream, offset=self.at)
        raise StreamError("TruncatedInput", self.stream, self.block, self.at)

    def _drop(self, n: int) -> bytes:
        raw = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return raw

    def _step(self) -> bytes | None:
        """Some output, b"" for progress without any, None for too little input."""
        h = self.held
        if self.state == "header":
            if len(h) < 12:
                if h and not xz.MAGIC.startswith(bytes(h[:6])):
                    raise StreamError("BadMagic" if self.stream == 0 else "TrailingGarbage")
                return None
            if self.stream and h[:6] != xz.MAGIC:
                raise StreamError("TrailingGarbage")
            self.check = xz.parse_header(bytes(h[:12]))
            if self.limits.verify and not self.limits.allow_unverifiable and not xz.is_verifiable(self.check):
                raise StreamError("UnsupportedCheck")
            self._drop(12)
            self.state, self.records, self.block = "block", [], 0
            return b""
        if self.state == "block":
            return self._block()
        if self.state == "chased":
            return self._chased()
        if self.state == "footer":
            if len(h) < 12:
                return None
            check, size = xz.parse_footer(bytes(h[:12]))
            if check != self.check:
                raise StreamError("StreamFlagsMismatch")
            if size != self.index_size:
                raise StreamError("IndexMismatch")
            self._drop(12)
            self.state, self.pad = "padding", 0
            return b""
        while h and h[0] == 0:
            if not self.limits.concatenated:
                raise StreamError("TrailingGarbage")
            self._drop(1)
            self.pad += 1
        if not h:
            return None
        if self.pad % 4 or not self.limits.concatenated:
            raise StreamError("BadPadding" if self.pad % 4 else "TrailingGarbage")
        self.state = "header"
        self.stream += 1
        return b""

    def _block(self) -> bytes | None:
        h = self.held
        if not h:
            return None
        size = xz.block_header_size(h[0])
        if size is None:
            return self._index()
        if len(h) < size:
            return None
        if self.chase:
            self.open = _OpenBlock(bytes(h[:size]), self.check, self.limits)
            self._drop(size)
            self.state = "chased"
            return b""
        head = xz.parse_block_header(bytes(h[:size]))
        end = self._payload_end(size)
        if end is None:
            return None
        n = end - size
        tail = xz.check_size(self.check)
        whole = size + n + -n % 4 + tail
        if len(h) < whole:
            return None
        unpacked = sum(c.unpacked_len for c in chunks(bytes(h[size:end])))
        if head.compressed not in (None, n) or head.uncompressed not in (None, unpacked):
            raise StreamError("SizeMismatch")
        self.total += unpacked
        if self.limits.max_unpack_bytes is not None and self.total > self.limits.max_unpack_bytes:
            raise StreamError("TooMuchOutput", needed=self.total, limit=self.limits.max_unpack_bytes)
        b = xz.Block(self.stream, self.block, self.at, 0, size + n + tail, unpacked, self.check)
        data = decode_block(bytes(h[:whole]), b, self.limits)
        self.records.append((b.unpadded_size, unpacked))
        self._drop(whole)
        self.block += 1
        self.scanned = None
        return data

    def _chased(self) -> bytes | None:
        """What the next whole chunk of the open block gives; at its end, its padding and check."""
        b, h = self.open, self.held
        if not b.ended:
            n = b.chunk_size(h)
            if n is None or len(h) < n:
                return None
            left = None if self.limits.max_unpack_bytes is None else self.limits.max_unpack_bytes - self.total
            out = b.push(self._drop(n), left)
            self.total += len(out)
            return out
        pad, tail = -b.packed % 4, xz.check_size(self.check)
        if len(h) < pad + tail:
            return None
        rest = b.finish(bytes(h[:pad]), bytes(h[pad : pad + tail]))
        self.total += len(rest)
        self._drop(pad + tail)
        self.records.append((b.header_size + b.packed + tail, b.unpacked))
        self.open, self.state = None, "block"
        self.block += 1
        return rest

    def _payload_end(self, at: int) -> int | None:
        """Where the LZMA2 data that begins at `at` ends, from its chunk headers; None if that hasn't arrived."""
        from sluice.sources.lzma2 import RunScanner

        s, at = self.scanned or (RunScanner(), at)
        h = self.held
        while at < len(h):
            if h[at] == 0:
                return at + 1
            s.head = bytes(h[at : at + 6])
            try:
                c = s._parse()
            except StreamError:
                raise StreamError("Lzma") from None
            if c is None:
                return None
            s._take(c)
            at += c.header_len + c.payload_len
            self.scanned = s, at
        return None

    def _index(self) -> bytes | None:
        """The records, each compared with the block that was decoded."""
        h, at = bytes(self.held), 1
        try:
            count, at = xz.vli_decode(h, at)
            if count != len(self.records):
                raise StreamError("IndexMismatch")
            for want in self.records:
                a, at = xz.vli_decode(h, at)
                b, at = xz.vli_decode(h, at)
                if (a, b) != want:
                    raise StreamError("IndexMismatch")
        except StreamError as e:
            if e.kind == "TruncatedVli" and len(h) < 16 + 18 * len(self.records):
                return None
            raise
        size = at + -at % 4 + 4
        if len(h) < size:
            return None
        xz.parse_index(h[:size])
        self.index_size = size
        self._drop(size)
        self.state = "footer"
        return b""
