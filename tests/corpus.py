"""Byte corpora for the tests, by rule: SplitMix64 and simple generators."""

from __future__ import annotations


def splitmix(seed: int):
    mask = 2**64 - 1
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = seed
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        yield z ^ z >> 31


def noise(n: int, seed: int = 1) -> bytes:
    g = splitmix(seed ^ n)
    return b"".join(next(g).to_bytes(8, "little") for _ in range(-(-n // 8)))[:n]


def text(n: int, seed: int = 2) -> bytes:
    words = [b"stream", b"block", b"index", b"filter", b"chunk", b"check", b"footer", b"header", b"run", b"props", b"window", b"delta", b"branch", b"match", b"literal", b"range"]
    g, out = splitmix(seed ^ n), bytearray()
    while len(out) < n:
        out += words[next(g) % 16] + b" "
    return bytes(out[:n])


def code(n: int, kind: str, seed: int = 3) -> bytes:
    """Bytes rich in the branch instructions of an architecture."""
    op = {"X86": b"\xe8", "Arm": b"\xeb", "Ppc": b"\x48", "Sparc": b"\x40\x00", "Arm64": b"\x94", "RiscV": b"\xef\x00", "ArmThumb": b"\xf0", "Ia64": b"\x10"}[kind]
    g, out = splitmix(seed ^ n), bytearray()
    while len(out) < n:
        r = next(g)
        small = (r >> 8 & 0xFFFF).to_bytes(3, "little") + (b"\0" if r & 1 else b"\xff")
        if kind == "Arm" and r & 3 == 0:
            out += small[:3] + op
        elif kind == "Arm64" and r & 3 == 0:
            out += (0x94000000 | r >> 20 & 0x3FFFFFF).to_bytes(4, "little")
        elif kind == "Arm64" and r & 3 == 1:
            out += (0x90000000 | (r >> 9 & 0x60FFFFFF)).to_bytes(4, "little")
        elif kind == "Ppc" and r & 3 == 0:
            out += (0x48000001 | r >> 20 & 0x3FFFFFC).to_bytes(4, "big")
        elif kind == "Sparc" and r & 3 == 0:
            out += (0x40000000 | r >> 20 & 0x3FFFFF).to_bytes(4, "big")
        elif kind == "RiscV" and r & 3 == 0:
            out += (0xEF | (r >> 20 & 1) << 7 | (r >> 12 & 0xFFFFF000)).to_bytes(8, "little")[:4]
        elif kind == "RiscV" and r & 3 == 1:
            rd = r >> 10 & 31
            out += (0x17 | rd << 7 | r >> 20 & 0xFFFFF000).to_bytes(4, "little") + (0x03 | rd << 15 | r >> 30 & 0xFFF07F80).to_bytes(4, "little")
        elif kind == "RiscV" and r & 3 == 2:
            out += (0x17 | 2 << 7 | r >> 20 & 0xFFFFF000).to_bytes(4, "little") + (r >> 24 & 0xFFFFFFFF).to_bytes(4, "little")
        elif kind == "X86" and r & 3 == 0:
            out += (op if r & 8 else b"\xe9" if r & 16 else b"\x0f\x85") + small
        else:
            out += (r >> 16 & 0xFFFFFFFF).to_bytes(4, "little")
    return bytes(out[:n])


def cases() -> dict[str, bytes]:
    out = {"empty": b"", "one": b"*", "two": b"\xff\xff"}
    for n in (65535, 65536, 65537):
        out[f"zeros-{n}"] = bytes(n)
    for n in (7, 999, 65535, 65537, 150_000):
        out[f"noise-{n}"], out[f"text-{n}"] = noise(n), text(n)
    return out
