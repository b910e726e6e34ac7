"""Byte filters in both directions: delta, the branch converters and BCJ2.

The word-wise converters are numpy over whole buffers. x86, IA-64 and ARM-Thumb come from liblzma by
difference: encode with [filter, LZMA2] and decode with [LZMA2], or the other way round. RISC-V is written out
here, since this liblzma build has no such filter.
"""

from __future__ import annotations

import lzma
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from sluice.errors import StreamError
from sluice.sources.xz import BCJ_ALIGNMENT, BCJ_KINDS, DELTA_ID, Filter

_LIBLZMA = {"X86": lzma.FILTER_X86, "Ia64": lzma.FILTER_IA64, "ArmThumb": lzma.FILTER_ARMTHUMB}


# ---- delta


def delta_encode(data: bytes, distance: int = 1) -> bytes:
    _distance(distance)
    x = np.frombuffer(data, np.uint8)
    out = x.copy()
    out[distance:] -= x[:-distance]
    return out.tobytes()


def delta_decode(data: bytes, distance: int = 1) -> bytes:
    """Running sums modulo 256, one per lane of bytes that are `distance` apart."""
    _distance(distance)
    n = len(data)
    lanes = np.zeros(-(-n // distance) * distance, np.uint8)
    lanes[:n] = np.frombuffer(data, np.uint8)
    return np.cumsum(lanes.reshape(-1, distance), axis=0, dtype=np.uint8).ravel()[:n].tobytes()


def _distance(distance: int) -> None:
    if not 1 <= distance <= 256:
        raise StreamError("BadFilterChain")


# ---- converters of 4-byte words


def _words(data: bytes, order: str) -> np.ndarray:
    return np.frombuffer(data, f"{order}u4", len(data) // 4).astype(np.int64)


def _joined(words: np.ndarray, data: bytes, order: str) -> bytes:
    return words.astype(f"{order}u4").tobytes() + data[len(words) * 4 :]


def _pcs(n: int, pc: int) -> np.ndarray:
    return (pc + 4 * np.arange(n, dtype=np.int64)) & 0xFFFFFFFF


def _arm(data: bytes, pc: int, sign: int) -> bytes:
    w = _words(data, "<")
    target = (w + sign * ((_pcs(len(w), pc) + 8) >> 2)) & 0xFFFFFF
    return _joined(np.where(w >> 24 == 0xEB, 0xEB000000 | target, w), data, "<")


def _ppc(data: bytes, pc: int, sign: int) -> bytes:
    w = _words(data, ">")
    target = (w + sign * _pcs(len(w), pc)) & 0x03FFFFFC
    return _joined(np.where(w & 0xFC000003 == 0x48000001, 0x48000001 | target, w), data, ">")


def _sparc(data: bytes, pc: int, sign: int) -> bytes:
    """Calls whose 30-bit displacement is a sign-extended 22-bit one."""
    w = _words(data, ">")
    call = (w >> 22 == 0x100) | (w >> 22 == 0x1FF)
    d = ((w << 2) + sign * _pcs(len(w), pc) & 0xFFFFFFFF) >> 2
    low = d & 0x3FFFFF
    return _joined(np.where(call, 0x40000000 | np.where(d >> 22 & 1, 0x3FC00000, 0) | low, w), data, ">")


def _arm64(data: bytes, pc: int, sign: int) -> bytes:
    """BL by 26-bit words; ADRP by 4 KiB pages, where the page distance fits 18 bits with sign."""
    w = _words(data, "<")
    here = _pcs(len(w), pc)
    out = np.where(w >> 26 == 0x25, 0x94000000 | (w + sign * (here >> 2) & 0x3FFFFFF), w)
    page = (w >> 29 & 3) | (w >> 3 & 0x1FFFFC)
    near = (w & 0x9F000000 == 0x90000000) & (((page + 0x20000) & 0x1C0000) == 0)
    moved = page + sign * (here >> 12)
    adrp = (w & 0x9000001F) | ((moved & 3) << 29) | ((moved & 0x3FFFC) << 3) | (-(moved & 0x20000) & 0xE00000)
    return _joined(np.where(near, adrp & 0xFFFFFFFF, out), data, "<")


# ---- RISC-V

#: Fields of an instruction: (lowest bit, bits).
_LENGTH, _RD, _RS1 = (0, 2), (7, 5), (15, 5)
#: Of the length field: an instruction of four bytes. Registers: those that calls link with, those that no pair that
#: is converted has as its base, and the one that marks a converted pair.
_FOUR_BYTES, _LINKS, _NO_BASE, _MARK = 0b11, (1, 5), (0, 2), 2


def _bits(x: int, low: int, n: int) -> int:
    return x >> low & (1 << n) - 1


def _riscv(data: bytes, pc: int, encoding: bool) -> bytes:
    """JAL to x1 and x5, and AUIPC with the instruction after it.

    A real pair becomes AUIPC x2 with the second instruction's upper bits and a big-endian absolute address; an
    AUIPC x2 (or x0) that would look like that is exchanged into a form that can't be mistaken.
    """
    buf = bytearray(data)
    n = len(buf)
    if n < 8:
        return data
    x = np.frombuffer(data, np.uint8, n & ~1)
    even = x[0::2]
    opcode = np.flatnonzero((even == 0xEF) | (even & 0x7F == 0x17)) * 2
    u32 = lambda at, order="little": int.from_bytes(buf[at : at + 4], order)
    M = 0xFFFFFFFF

    def put(at: int, v: int, order: str = "little") -> None:
        buf[at : at + 4] = (v & M).to_bytes(4, order)

    free = 0  # positions below it belong to instructions that were dealt with
    for at in opcode.tolist():
        if at < free or at + 8 > n:
            continue
        here = (pc + at) & M
        if buf[at] == 0xEF:
            b1, b2, b3 = buf[at + 1], buf[at + 2], buf[at + 3]
            if _bits(buf[at] | b1 << 8, *_RD) not in _LINKS:
                continue
            if encoding:
                addr = (b1 & 0xF0) << 8 | (b2 & 0x0F) << 16 | (b2 & 0x10) << 7 | (b2 & 0xE0) >> 4 | (b3 & 0x7F) << 4 | (b3 & 0x80) << 13
                addr = (addr + here) & M
                buf[at + 1 : at + 4] = bytes(((b1 & 0x0F) | (addr >> 13 & 0xF0), addr >> 9 & 0xFF, addr >> 1 & 0xFF))
            else:
                addr = ((b1 & 0xF0) << 13 | b2 << 9 | b3 << 1) - here & M
                buf[at + 1 : at + 4] = bytes(((b1 & 0x0F) | (addr >> 8 & 0xF0), (addr >> 16 & 0x0F) | (addr >> 7 & 0x10) | (addr << 4 & 0xE0), (addr >> 4 & 0x7F) | (addr >> 13 & 0x80)))
            free = at + 4
            continue
        first = u32(at)
        if _bits(first, *_RD) not in _NO_BASE:
            second = u32(at + 4)
            if _bits(second, *_LENGTH) != _FOUR_BYTES or _bits(second, *_RS1) != _bits(first, *_RD):
                free = at + 6
                continue
            if encoding:
                addr = (first & 0xFFFFF000) + (second >> 20) - (second >> 19 & 0x1000) + here
                put(at, 0x117 | second << 12)
                put(at + 4, addr, "big")
            else:
                put(at, 0x117 | second << 12)
                put(at + 4, (first & 0xFFFFF000) | second >> 20)
        else:
            # an encoded pair has AUIPC x2 first; its upper 20 bits are the second instruction's lower ones
            rest = _bits(first, 12, 20)
            rs1 = _bits(rest, *_RS1)
            if _bits(first, *_RD) != _MARK or _bits(rest, *_LENGTH) != _FOUR_BYTES or rs1 in _NO_BASE:
                free = at + 4
                continue
            if encoding:
                put_second = first >> 12 | u32(at + 4) << 20
                put(at, 0x17 | rs1 << 7 | u32(at + 4) & 0xFFFFF000)
                put(at + 4, put_second)
            else:
                addr = u32(at + 4, "big") - here & M
                put(at, 0x17 | rs1 << 7 | addr + 0x800 & 0xFFFFF000)
                put(at + 4, first >> 12 | addr << 20)
        free = at + 8
    return bytes(buf)


# ---- by liblzma


def _by_difference(kind: str, data: bytes, pc: int, encoding: bool) -> bytes:
    plain = [{"id": lzma.FILTER_LZMA2, "preset": 0, "dict_size": 4096}]
    both = [{"id": _LIBLZMA[kind], "start_offset": pc}, *plain]
    w, r = (both, plain) if encoding else (plain, both)
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=w), lzma.FORMAT_RAW, filters=r)


def bcj(kind: str, data: bytes, encoding: bool, start_offset: int = 0) -> bytes:
    """Converts a whole block; bytes at its end that make no whole instruction stay."""
    if kind not in BCJ_ALIGNMENT:
        raise StreamError("UnsupportedFilter")
    if start_offset % BCJ_ALIGNMENT[kind]:
        raise StreamError("BadFilterChain")
    if not data:
        return data
    if kind == "RiscV":
        return _riscv(data, start_offset, encoding)
    if kind in _LIBLZMA:
        return _by_difference(kind, data, start_offset, encoding)
    word = {"Arm": _arm, "Ppc": _ppc, "Sparc": _sparc, "Arm64": _arm64}[kind]
    return word(data, start_offset, 1 if encoding else -1)


def _converter(f: Filter, encoding: bool) -> Callable[[bytes], bytes]:
    if f.id == DELTA_ID:
        distance = f.props[0] + 1
        return lambda x: (delta_encode if encoding else delta_decode)(x, distance)
    kind, start = BCJ_KINDS[f.id], int.from_bytes(f.props, "little")
    return lambda x: bcj(kind, x, encoding, start)


def encode_chain(filters: list[Filter], data: bytes) -> bytes:
    """Runs the filters before LZMA2 in the order of the list."""
    for f in filters:
        data = _converter(f, True)(data)
    return data


def decode_chain(filters: list[Filter], data: bytes) -> bytes:
    for f in reversed(filters):
        data = _converter(f, False)(data)
    return data


class ChunkedChain:
    """A chain over a block that arrives in portions. Delta passes bytes on at once; converters keep their tail
    back, and the last bytes of the block pass unconverted."""

    def __init__(self, filters: list[Filter], encoding: bool):
        order = filters if encoding else list(reversed(filters))
        self.stages = [_DeltaStage(f, encoding) if f.id == DELTA_ID else _BcjStage(f, encoding) for f in order]

    def push(self, data: bytes) -> bytes:
        for s in self.stages:
            data = s.push(data)
        return data

    def finish(self, data: bytes = b"") -> bytes:
        for s in self.stages:
            data = s.push(data) + s.finish()
        return data


class _DeltaStage:
    def __init__(self, f: Filter, encoding: bool):
        self.distance, self.encoding, self.past = f.props[0] + 1, encoding, bytes(f.props[0] + 1)

    def push(self, data: bytes) -> bytes:
        d = self.distance
        if self.encoding:
            joined = self.past + data
            self.past = joined[-d:]
            return delta_encode(joined, d)[d:]
        out = delta_decode(self.past + data, d)
        self.past = out[-d:]
        return out[d:]

    def finish(self) -> bytes:
        return b""


class _BcjStage:
    """Converters look at instructions across portions, so a block is held until its end: with liblzma and
    numpy underneath, one call over the whole costs less than carrying state."""

    def __init__(self, f: Filter, encoding: bool):
        self.convert, self.held = _converter(f, encoding), bytearray()

    def push(self, data: bytes) -> bytes:
        self.held += data
        return b""

    def finish(self) -> bytes:
        return self.convert(bytes(self.held))


# ---- BCJ2


@dataclass(frozen=True)
class Bcj2Streams:
    main: bytes
    call: bytes
    jump: bytes
    rc: bytes


RELAT_LIMIT = 0x0F << 24
_TOP = 1 << 24


def _is_branch(prev: int, b: int) -> bool:
    return b & 0xFE == 0xE8 or (prev == 0x0F and b & 0xF0 == 0x80)


def _slot(prev: int, b: int) -> int:
    """Which adaptive bit a branch uses: calls by the byte before, near jumps one, conditional jumps one."""
    return 2 + prev if b == 0xE8 else int(b == 0xE9)


class _BitWriter:
    """A carrying binary range coder with 11-bit probabilities that move by a 32nd."""

    def __init__(self):
        self.low, self.range, self.out, self.p = 0, 0xFFFFFFFF, bytearray(), [1024] * 258
        self.held, self.cache = 0, 0

    def _shift(self) -> None:
        if self.low < 0xFF000000 or self.low >> 32:
            carry = self.low >> 32
            self.out.append(self.cache + carry & 0xFF)
            self.out += bytes((0xFF + carry & 0xFF,)) * self.held
            self.held, self.cache = 0, self.low >> 24 & 0xFF
        else:
            self.held += 1
        self.low = (self.low & 0xFFFFFF) << 8

    def bit(self, slot: int, bit: int) -> None:
        if self.range < _TOP:
            self._shift()
            self.range = self.range << 8 & 0xFFFFFFFF
        p = self.p[slot]
        bound = (self.range >> 11) * p
        if bit:
            self.low += bound
            self.range -= bound
            self.p[slot] = p - (p >> 5)
        else:
            self.range = bound
            self.p[slot] = p + (2048 - p >> 5)

    def done(self) -> bytes:
        if self.range < _TOP:
            self._shift()
        for _ in range(5):
            self._shift()
        return bytes(self.out)


def bcj2_encode(src: bytes, relat_limit: int = RELAT_LIMIT, file_size: int | None = None, ip: int = 0, file_ip: int = 0) -> Bcj2Streams:
    """x86 code -> main, call, jump and range-coded streams. A branch is converted if its 4-byte offset is within
    relat_limit and its target inside a file of file_size bytes, where that is given."""
    relat_limit = min(relat_limit, 1 << 31)
    main, call, jump, rc = bytearray(), bytearray(), bytearray(), _BitWriter()
    at, prev, n = 0, 0, len(src)
    marks = _branch_marks(src)
    k = 0
    while at < n:
        while k < len(marks) and marks[k] < at:
            k += 1
        # a byte right after a converted target has the target's last byte before it
        nxt = marks[k] if k < len(marks) else n
        if prev == 0x0F and src[at] & 0xF0 == 0x80:
            nxt = at
        elif nxt == at and not _is_branch(prev, src[at]):
            main.append(src[at])
            prev = src[at]
            at += 1
            continue
        main += src[at : nxt + 1]
        if nxt >= n:
            break
        before = src[nxt - 1] if nxt > at else prev
        b = src[nxt]
        at, prev = nxt + 1, b
        convert = False
        if n - at >= 4:
            relat = int.from_bytes(src[at : at + 4], "little")
            distance = int.from_bytes(src[at : at + 4], "little", signed=True)
            place = ip + at - file_ip  # of the offset, in the file
            opcode = place - (1 if b & 0xFE == 0xE8 else 2)
            whole = opcode >= 0 or place < 0  # not cut by the file's beginning
            inside = not file_size or 0 <= place + 4 + distance < file_size
            convert = whole and inside and -relat_limit <= distance < relat_limit
        rc.bit(_slot(before, b), int(convert))
        if convert:
            target = ip + at + 4 + relat & 0xFFFFFFFF
            (call if b == 0xE8 else jump).extend(target.to_bytes(4, "big"))
            prev = src[at + 3]
            at += 4
    return Bcj2Streams(bytes(main), bytes(call), bytes(jump), rc.done())


def _branch_marks(src: bytes) -> list[int]:
    x = np.frombuffer(src, np.uint8)
    hit = x & 0xFE == 0xE8
    hit[1:] |= (x[:-1] == 0x0F) & (x[1:] & 0xF0 == 0x80)
    return np.flatnonzero(hit).tolist()


def bcj2_decode(main: bytes, call: bytes, jump: bytes, rc: bytes, size: int) -> bytes:
    """The code back from its four streams, `size` bytes of it."""
    if len(call) % 4 or len(jump) % 4:
        raise StreamError("UnalignedStream")
    if size > len(main) + len(call) + len(jump) or len(rc) < 5 or rc[0] or rc[1:5] == b"\xff" * 4:
        raise StreamError("CorruptData")
    code, rng, rpos = int.from_bytes(rc[1:5], "big"), 0xFFFFFFFF, 5
    probs = [1024] * 258
    out = bytearray()
    at, prev, places = 0, 0, {0xE8: 0, 0: 0}
    marks = _branch_marks(main)
    k, n = 0, len(main)
    while at < n and len(out) < size:
        while k < len(marks) and marks[k] < at:
            k += 1
        nxt = marks[k] if k < len(marks) else n
        if prev == 0x0F and main[at] & 0xF0 == 0x80:
            nxt = at
        elif nxt == at and not _is_branch(prev, main[at]):
            out.append(main[at])
            prev = main[at]
            at += 1
            continue
        out += main[at : nxt + 1]
        if nxt >= n:
            at = n
            break
        before, b = (main[nxt - 1] if nxt > at else prev), main[nxt]
        at, prev = nxt + 1, b
        if len(out) >= size and at >= n:
            break
        if rng < _TOP:
            if rpos >= len(rc):
                raise StreamError("CorruptData")
            rng, code, rpos = rng << 8 & 0xFFFFFFFF, (code << 8 | rc[rpos]) & 0xFFFFFFFF, rpos + 1
        slot = _slot(before, b)
        p = probs[slot]
        bound = (rng >> 11) * p
        if code < bound:
            rng, probs[slot] = bound, p + (2048 - p >> 5)
            continue
        rng, code, probs[slot] = rng - bound, code - bound, p - (p >> 5)
        which, source = (0xE8, call) if b == 0xE8 else (0, jump)
        if places[which] + 4 > len(source):
            raise StreamError("CorruptData")
        target = int.from_bytes(source[places[which] : places[which] + 4], "big")
        places[which] += 4
        raw = (target - (len(out) + 4) & 0xFFFFFFFF).to_bytes(4, "little")
        out += raw
        prev = raw[3]
    if len(out) != size or at < n:
        raise StreamError("CorruptData")
    return bytes(out)
