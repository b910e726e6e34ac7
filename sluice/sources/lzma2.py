"""Raw LZMA2: chunk headers, runs that decode independently, stored chunks; and the 13-byte .lzma header."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from sluice.errors import StreamError

COUNTERS = ("stored", "stored_reset", "lzma", "lzma_state_reset", "lzma_new_props", "lzma_dict_reset", "header_bytes", "payload_bytes")


def starts_run(control: int) -> bool:
    """A chunk that resets the dictionary: what follows needs nothing before it."""
    return control == 1 or control >= 0xE0


def kind_of(control: int) -> str:
    if control < 0x80:
        return "stored_reset" if control == 1 else "stored"
    return ("lzma", "lzma_state_reset", "lzma_new_props", "lzma_dict_reset")[(control >> 5) - 4]


@dataclass
class Run:
    run_no: int
    in_offset: int
    out_offset: int
    packed_len: int = 0
    unpacked_len: int = 0
    has_dict_reset: bool = True
    chunks: dict = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))


@dataclass(frozen=True)
class Chunk:
    control: int
    offset: int
    header_len: int
    payload_len: int
    unpacked_len: int


class RunScanner:
    """Finds runs in bytes that arrive in any portions; keeps a header's bytes and a few numbers, no payload."""

    def __init__(self) -> None:
        self.need, self.head, self.skip = 0xE0, b"", 0
        self.at = self.out = 0
        self.run: Run | None = None
        self.ended = False
        self._done: list[Run] = []
        self._runs = 0

    def _parse(self) -> Chunk | None:
        """The chunk whose header is whole in `head`, or None."""
        h = self.head
        control = h[0]
        if control < 0x80:
            if control > 2 or (control == 2 and self.need == 0xE0):
                raise StreamError("CorruptData", offset=self.at)
            if len(h) < 3:
                return None
            n = (h[1] << 8 | h[2]) + 1
            return Chunk(control, self.at, 3, n, n)
        if control < self.need:
            raise StreamError("CorruptData", offset=self.at)
        size = 6 if control & 0x40 else 5
        if len(h) < size:
            return None
        if size == 6:
            props = h[5]
            if props >= 225 or props % 9 + props // 9 % 5 > 4:
                raise StreamError("CorruptData", offset=self.at)
        return Chunk(control, self.at, size, (h[3] << 8 | h[4]) + 1, ((control & 0x1F) << 16 | h[1] << 8 | h[2]) + 1)

    def feed(self, data: bytes) -> int:
        """Takes bytes up to the end marker; the number taken."""
        pos, n = 0, len(data)
        while pos < n and not self.ended:
            if self.skip:
                step = min(self.skip, n - pos)
                self.skip -= step
                pos += step
                continue
            self.head += data[pos : pos + 1]
            pos += 1
            if self.head == b"\0":
                self._close()
                self.ended = True
                self.at += 1
                break
            if (c := self._parse()) is not None:
                self._take(c)
        return pos

    def _take(self, c: Chunk) -> None:
        if c.control == 1:
            self.need = 0xC0
        elif c.control >= 0x80:
            self.need = 0
        if starts_run(c.control):
            self._close()
            self.run = Run(self._runs, self.at, self.out)
            self._runs += 1
        r = self.run
        r.packed_len += c.header_len + c.payload_len
        r.unpacked_len += c.unpacked_len
        r.chunks[kind_of(c.control)] += 1
        r.chunks["header_bytes"] += c.header_len
        r.chunks["payload_bytes"] += c.payload_len
        self.at += c.header_len + c.payload_len
        self.out += c.unpacked_len
        self.skip, self.head = c.payload_len, b""

    def _close(self) -> None:
        if self.run is not None:
            self._done.append(self.run)
            self.run = None

    def runs(self) -> Iterator[Run]:
        """Complete runs that weren't handed out yet."""
        while self._done:
            yield self._done.pop(0)

    def skip_payload(self, n: int) -> int:
        """Passes over up to n payload bytes that the caller has skipped by a seek."""
        step = min(n, self.skip)
        self.skip -= step
        return step

    @property
    def payload_remaining(self) -> int:
        return self.skip

    def end(self) -> None:
        if not self.ended:
            raise StreamError("Truncated", offset=self.at)


def scan_runs(f: BinaryIO, size: int) -> Iterator[Run]:
    """Runs of a seekable stream. Payloads are passed over by seeks."""
    s, pos = RunScanner(), 0
    while not s.ended:
        if s.payload_remaining:
            step = min(s.payload_remaining, size - pos)
            if not step:
                break
            s.skip_payload(step)
            pos += step
            continue
        f.seek(pos)
        head = f.read(1)
        if not head:
            break
        s.feed(head)
        pos += 1
        yield from s.runs()
    s.end()
    yield from s.runs()


def chunks(data: bytes) -> Iterator[Chunk]:
    """Headers of all chunks of a whole stream."""
    s, pos = RunScanner(), 0
    while True:
        if pos >= len(data):
            raise StreamError("Truncated", offset=pos)
        if data[pos] == 0:
            return
        s.head = bytes(data[pos : pos + 6])
        c = s._parse()
        if c is None or pos + c.header_len + c.payload_len > len(data):
            raise StreamError("Truncated", offset=pos)
        s._take(c)
        yield c
        pos += c.header_len + c.payload_len


def stored_chunks(data: bytes, size: int = 65536, first: int = 1) -> bytes:
    """An LZMA2 stream of stored chunks: no encoder, the bytes follow from the arguments."""
    out = bytearray()
    for i in range(0, len(data), size):
        part = data[i : i + size]
        out.append(first if i == 0 else 2)
        out += (len(part) - 1).to_bytes(2, "big") + part
    return bytes(out + b"\0")


# ---- .lzma


@dataclass(frozen=True)
class LzmaProps:
    lc: int
    lp: int
    pb: int
    dict_size: int

    def __post_init__(self):
        if not (0 <= self.lc <= 8 and 0 <= self.lp <= 4 and 0 <= self.pb <= 4):
            raise StreamError("UnsupportedProps")
        object.__setattr__(self, "dict_size", max(4096, self.dict_size))

    @classmethod
    def parse(cls, raw: bytes) -> LzmaProps:
        if len(raw) < 5:
            raise StreamError("Truncated")
        if raw[0] >= 225:
            raise StreamError("UnsupportedProps")
        return cls(raw[0] % 9, raw[0] // 9 % 5, raw[0] // 45, int.from_bytes(raw[1:5], "little"))

    def encoded(self) -> bytes:
        return bytes(((self.pb * 5 + self.lp) * 9 + self.lc,)) + self.dict_size.to_bytes(4, "little")


def parse_lzma_header(raw: bytes) -> tuple[LzmaProps, int | None]:
    """13 bytes -> (props, uncompressed size or None for unknown)."""
    if len(raw) < 13:
        raise StreamError("Truncated")
    size = int.from_bytes(raw[5:13], "little")
    return LzmaProps.parse(raw[:5]), None if size == 2**64 - 1 else size
