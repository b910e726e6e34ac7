"""CRC-32, CRC-64/XZ and SHA-256; combining checks of adjacent pieces; folding pieces that tile a range."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from sluice.errors import StreamError

# Reflected polynomials of CRC-32/ISO-HDLC and CRC-64/XZ.
POLY = {32: 0xEDB88320, 64: 0xC96C5795D7870F42}
KINDS = ("None", "Crc32", "Crc64Xz", "Sha256")


def crc_table(width: int) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (POLY[width] if i & 1 else 0)
        out.append(i)
    return out


_T64 = crc_table(64)


@lru_cache(maxsize=None)
def _power(width: int, k: int) -> tuple[int, ...]:
    """Columns of the matrix that appends 2 ** k zero bytes to a raw CRC state."""
    if k == 0:
        step = (POLY[width], *(1 << i for i in range(width - 1)))
        for _ in range(3):
            step = tuple(_times(step, c) for c in step)
        return step
    half = _power(width, k - 1)
    return tuple(_times(half, c) for c in half)


def _times(matrix: Sequence[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def combine(width: int, a: int, b: int, len_b: int) -> int:
    """CRC of A followed by B, from their CRCs and the length of B."""
    k = 0
    while len_b:
        if len_b & 1:
            a = _times(_power(width, k), a)
        len_b >>= 1
        k += 1
    return a ^ b if k else a


def crc32_combine(a: int, b: int, len_b: int) -> int:
    return combine(32, a, b, len_b)


def crc64_combine(a: int, b: int, len_b: int) -> int:
    return combine(64, a, b, len_b)


#: A CRC is the exclusive or of what its bytes add, each by its distance from the end; spans of so many bytes are looked
#: up byte by byte, then groups of so many spans likewise, by the eight bytes of what each came to.
_SPAN, _GROUP = 256, 16


@lru_cache(maxsize=1)
def _contributions() -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """What a byte adds with p bytes after it in its span, at p' * 256 + byte with p' its place; what the byte j of a
    span's sum adds from the span's place in its group, at (place * 8 + j) * 256 + byte; the same over a whole group."""
    table = np.array(_T64, np.uint64)
    span = np.empty((_SPAN, 256), np.uint64)
    span[-1] = table
    for p in range(_SPAN - 2, -1, -1):
        span[p] = table[(span[p + 1] & np.uint64(255)).astype(np.intp)] ^ (span[p + 1] >> np.uint64(8))

    def by_bytes(columns: Sequence[int]) -> np.ndarray:
        out = np.zeros((8, 256), np.uint64)
        number = np.arange(256)
        for i, c in enumerate(columns):
            out[i // 8] ^= np.where(number >> (i % 8) & 1, np.uint64(c), np.uint64(0))
        return out

    step, columns = _power(64, _SPAN.bit_length() - 1), tuple(1 << i for i in range(64))
    group = np.empty((_GROUP + 1, 8, 256), np.uint64)
    for p in range(_GROUP, -1, -1):
        group[p] = by_bytes(columns)
        columns = tuple(_times(step, c) for c in columns)
    return span.ravel(), group[1:].ravel(), group[0].tolist()


_IN_SPAN = np.arange(_SPAN, dtype=np.intp) * 256
_IN_GROUP = np.arange(_GROUP * 8, dtype=np.intp).reshape(_GROUP, 8) * 256


def crc64_xz(data: bytes, portion: int = 1 << 14) -> int:
    """CRC-64/XZ. The opening state counts as if it were in the first eight bytes, and zeros before them add nothing, so
    data is filled up at its front to whole groups."""
    n = len(data)
    if n < 64:
        return _crc64_plain(data)
    span, group, whole = _contributions()
    size = _SPAN * _GROUP
    raw = np.zeros(-(-n // size) * size, np.uint8)
    raw[-n:] = np.frombuffer(data, np.uint8)
    raw[len(raw) - n : len(raw) - n + 8] ^= 255
    state = 0
    for at in range(0, len(raw), portion):
        sums = np.bitwise_xor.reduce(span.take(raw[at : at + portion].reshape(-1, _SPAN) + _IN_SPAN), axis=1)
        parts = group.take(sums.view(np.uint8).reshape(-1, _GROUP, 8) + _IN_GROUP).reshape(-1, _GROUP * 8)
        for x in np.bitwise_xor.reduce(parts, axis=1).tolist():
            for j in range(8):
                x ^= whole[j][state >> 8 * j & 255]
            state = x
    return state ^ 2**64 - 1


def crc64_many(values: Sequence[bytes]) -> list[int]:
    """CRC-64/XZ of each value."""
    return [crc64_xz(v) for v in values]


def _crc64_plain(data: bytes) -> int:
    state = 2**64 - 1
    for x in data:
        state = _T64[(state ^ x) & 255] ^ state >> 8
    return state ^ 2**64 - 1


def crc64_hex(value: int) -> str:
    return f"{value:016X}"


# ---- pluggable backends


_HOOKS: dict[str, Callable] = {}
_OWN: dict[str, Callable] = {"crc32": zlib.crc32, "crc64": crc64_xz, "sha256": lambda x: hashlib.sha256(x).digest()}


def install_hooks(**functions: Callable) -> None:
    """Replaces crc32(bytes) -> int, crc64(bytes) -> int or sha256(bytes) -> bytes in this process."""
    unknown = set(functions) - set(_OWN)
    if unknown:
        raise StreamError("Param")
    _HOOKS.update(functions)


def clear_hooks() -> None:
    _HOOKS.clear()


def hooks_installed() -> bool:
    return bool(_HOOKS)


def carried(run: Callable) -> Callable:
    """run, for a worker process: the hooks that are installed here and now are installed there while it runs."""
    hooks = dict(_HOOKS)
    if not hooks:
        return run

    def hooked(*arguments):
        # the module's own table: this function travels, and its globals would with it
        from sluice.functions.checksum import _HOOKS as here

        before = dict(here)
        here.clear()
        here.update(hooks)
        try:
            return run(*arguments)
        finally:
            here.clear()
            here.update(before)

    return hooked


def digest(name: str, data: bytes):
    return (_HOOKS.get(name) or _OWN[name])(data)


def check_bytes(check_id: int, data: bytes) -> bytes:
    """The check field of a block with this content."""
    if check_id == 0:
        return b""
    if check_id == 1:
        return digest("crc32", data).to_bytes(4, "little")
    if check_id == 4:
        return digest("crc64", data).to_bytes(8, "little")
    if check_id == 10:
        return digest("sha256", data)
    raise StreamError("UnsupportedCheck")


class RunningCheck:
    """The check of a block whose content arrives in portions."""

    def __init__(self, check_id: int):
        if check_id not in (0, 1, 4, 10):
            raise StreamError("UnsupportedCheck")
        self.check_id, self.value, self.sha = check_id, 0, hashlib.sha256()

    def push(self, data: bytes) -> None:
        if self.check_id == 10:
            self.sha.update(data)
        elif self.check_id:
            width, name = (32, "crc32") if self.check_id == 1 else (64, "crc64")
            self.value = combine(width, self.value, digest(name, data), len(data)) if data else self.value

    def digest(self) -> bytes:
        return self.sha.digest() if self.check_id == 10 else self.value.to_bytes({0: 0, 1: 4, 4: 8}[self.check_id], "little")


# ---- plans and folders


@dataclass(frozen=True)
class ChecksumPlan:
    """What to compute over a stream, and where segments are cut: sorted, distinct, without 0. SHA-256 ignores cuts."""

    kind: str = "None"
    split_points: tuple[int, ...] = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise StreamError("Param")
        object.__setattr__(self, "split_points", tuple(sorted({p for p in self.split_points if p > 0})))

    def cuts(self, offset: int, length: int) -> list[int]:
        """Bounds of the segments of [offset, offset + length), both ends included."""
        inside = () if self.kind == "Sha256" else self.split_points[bisect_right(self.split_points, offset) : bisect_left(self.split_points, offset + length)]
        return [offset, *inside, offset + length] if length else []

    def segments(self, offset: int, data: bytes) -> list[dict]:
        """offset, len and check of each segment of the block `data` that begins at `offset`."""
        if self.kind == "None":
            return []
        name = {"Crc32": "crc32", "Crc64Xz": "crc64", "Sha256": "sha256"}[self.kind]
        bounds = self.cuts(offset, len(data))
        return [{"offset": a, "len": b - a, "check": digest(name, data[a - offset : b - offset])} for a, b in zip(bounds, bounds[1:], strict=False)]

    def memory(self, offset: int, length: int) -> int:
        """Bytes that the segments' records take, 24 each."""
        return 24 * max(0, len(self.cuts(offset, length)) - 1) if self.kind in ("Crc32", "Crc64Xz") else 0


class CrcFolder:
    """Pieces in any order; a range is answered only if pieces tile it. The last piece at an offset counts."""

    def __init__(self, width: int = 32):
        self.width, self.pieces = width, {}

    def push(self, offset: int, length: int, crc: int) -> None:
        if length:
            self.pieces[offset] = (length, crc)

    def extend(self, pieces: Iterable[tuple[int, int, int]]) -> None:
        for p in pieces:
            self.push(*p)

    def range(self, offset: int, length: int) -> int | None:
        total, at, end = 0, offset, offset + length
        while at < end:
            n, crc = self.pieces.get(at, (0, 0))
            if not n or at + n > end:
                return None
            total = combine(self.width, total, crc, n)
            at += n
        return total


class IndexFold:
    """The records of an index as (count, sum of padded sizes, sum of unpacked sizes, CRC-64 of the record list): two
    lists agree if and, but for a collision, only if their folds do. Constant memory, whatever the number of records."""

    def __init__(self):
        self.count = self.padded = self.unpacked = self.crc = 0

    def push(self, unpadded: int, uncompressed: int) -> None:
        if unpadded < 5 or self.padded + unpadded >= 2**63 or self.unpacked + uncompressed >= 2**63:
            raise StreamError("SizeMismatch")
        self.count += 1
        self.padded += unpadded + 3 & ~3
        self.unpacked += uncompressed
        record = unpadded.to_bytes(8, "little") + uncompressed.to_bytes(8, "little")
        self.crc = combine(64, self.crc, crc64_xz(record), 16)

    def finish(self) -> tuple[int, int, int, int]:
        return self.count, self.padded, self.unpacked, self.crc
