"""Encoder settings: presets, defaults by level, property bytes; and the memory formulas of decoders."""

from __future__ import annotations

from dataclasses import dataclass, replace

from sluice.errors import StreamError
from sluice.sources.lzma2 import LzmaProps
from sluice.sources.xz import dict_size_from_prop

# Match finders as (binary tree, hash bytes); dictionary powers and hash-chain depths by preset.
MATCH_FINDERS = {"Hc4": (0, 4), "Hc5": (0, 5), "Bt2": (1, 2), "Bt3": (1, 3), "Bt4": (1, 4), "Bt5": (1, 5)}
DICT_POWERS = (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)
CHAIN_DEPTHS = (4, 8, 24, 48)


@dataclass(frozen=True)
class Settings:
    """None: by the level."""

    level: int | None = None
    dict_size: int | None = None
    lc: int | None = None
    lp: int | None = None
    pb: int | None = None
    normal: bool | None = None
    fast_bytes: int | None = None
    match_finder: str | None = None
    cycles: int | None = None
    threads: int | None = None
    reduce_size: int | None = None
    end_mark: bool = False

    def resolved(self) -> Settings:
        level = 5 if self.level is None else self.level
        size = self.dict_size or 1 << (2 * level + 16 if level <= 4 else level + 20 if level <= 8 else 28)
        if self.reduce_size is not None and size > self.reduce_size:
            size = min(size, max(self.reduce_size, 4096))
        normal = level >= 5 if self.normal is None else self.normal
        fast_bytes = (32 if level < 7 else 64) if self.fast_bytes is None else self.fast_bytes
        finder = self.match_finder or ("Bt4" if normal else "Hc5")
        cycles = self.cycles or (16 + fast_bytes // 2) >> (not MATCH_FINDERS[finder][0])
        pick = lambda v, d: d if v is None else v
        return replace(self, level=level, dict_size=size, lc=pick(self.lc, 3), lp=pick(self.lp, 0), pb=pick(self.pb, 2), normal=normal, fast_bytes=fast_bytes, match_finder=finder, cycles=cycles, threads=pick(self.threads, 1))


def preset(level: int, extreme: bool = False) -> Settings:
    """The settings of `xz -N` and `xz -Ne`."""
    if not 0 <= level <= 9:
        raise StreamError("Param")
    if extreme:
        nice = 192 if level in (3, 5) else 273
        normal, finder, cycles = True, "Bt4", 16 + 192 // 2 if nice == 192 else 512
    elif level <= 3:
        nice = 128 if level <= 1 else 273
        normal, finder, cycles = False, "Hc4", CHAIN_DEPTHS[level]
    else:
        nice = {4: 16, 5: 32}.get(level, 64)
        normal, finder, cycles = True, "Bt4", 16 + nice // 2
    return Settings(level, 1 << DICT_POWERS[level], 3, 0, 2, normal, nice, finder, cycles)


def aligned_dict(size: int) -> int:
    """The dictionary size that properties carry: whole MiB from 2 MiB on, else the next 2^n or 3 * 2^n."""
    if size >= 1 << 21:
        up = size + (1 << 20) - 1 & ~((1 << 20) - 1)
        return size if up > 0xFFFFFFFF else up
    return next(v for i in range(22, 64) if (v := (2 + i % 2) << i // 2) >= size)


def property_bytes(lc: int, lp: int, pb: int, dict_size: int) -> bytes:
    return bytes(((pb * 5 + lp) * 9 + lc,)) + aligned_dict(dict_size).to_bytes(4, "little")


def window_len(dict_size: int) -> int:
    unit = 1 << (22 if dict_size >= 1 << 30 else 20 if dict_size >= 1 << 22 else 12)
    return -(-dict_size // unit) * unit


def auto_block_size(dict_size: int) -> int:
    size = max(min(max(4 * dict_size, 1 << 20), 1 << 28), dict_size)
    return -(-size // (1 << 20)) * (1 << 20)


def capped_window(prop: int, cap: int = 2**32 - 1) -> int:
    return window_len(max(4096, min(dict_size_from_prop(prop), cap)))


def worker_window(prop: int) -> int:
    return max(auto_block_size(dict_size_from_prop(prop)), capped_window(prop))


# Probability counters of a decoder (2 bytes each), and bytes of the buffers beside them.
_BASE_PROBS, _IN_BUFFER, _RUN_STATE, _BLOCK_STATE = 1984, 1 << 16, 64 << 10, 32 << 10
_IN_BUFFER_SERIAL, _IN_BUFFER_WORKER = 1 << 20, 1 << 18


def reader_memory(props: LzmaProps) -> int:
    """Dictionary, probabilities and input buffer of an LZMA1 reader."""
    return window_len(props.dict_size) + 2 * (_BASE_PROBS + (0x300 << (props.lc + props.lp))) + _IN_BUFFER


def run_memory(prop: int, unpacked: int) -> int:
    """What decoding one run takes: its dictionary, no larger than the run, and the coder's state."""
    return capped_window(prop, unpacked) + _RUN_STATE


def admitted(threads: int, memory_limit: int, per_worker: int, units: int) -> int:
    """Workers that the limit pays for: fewer rather than failing, and one at least."""
    return max(1, min(threads, memory_limit // max(1, per_worker), max(1, units)))


def block_memory(unpacked: int, packed: int) -> int:
    """What decoding one .xz block takes: output, input, state."""
    return unpacked + packed + _BLOCK_STATE


def parallel_memory(prop: int, threads: int, memory_limit: int) -> int:
    """Upper bound on what a block-parallel LZMA2 decode holds."""
    size = dict_size_from_prop(prop)
    block = auto_block_size(size)
    per = block + block + block // 16 + _IN_BUFFER_WORKER + (1 << 16)
    n = admitted(threads, memory_limit, per, threads)
    return size + _IN_BUFFER_SERIAL + (n * per if n > 1 else 0)


def encoder_memory(settings: Settings, block_size: int = 0) -> int:
    """About what one encoding task takes: the match finder's tables over the dictionary, the block and its output."""
    r = settings.resolved()
    tree = MATCH_FINDERS[r.match_finder][0]
    tables = r.dict_size * (8 if tree else 4) + min(1 << 26, r.dict_size * 2)
    block = block_size or r.dict_size
    return r.dict_size + tables + 2 * block + (block >> 10) + (1 << 20)
