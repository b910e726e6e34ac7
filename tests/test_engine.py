"""Parsers, checksums, filters and codecs against the standard library, the xz tool and each other."""

from __future__ import annotations

import hashlib
import io
import lzma
import shutil
import subprocess
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.errors import StreamError
from sluice.functions import checksum as cs
from sluice.functions import props
from sluice.operators import byte_filters as bf
from sluice.operators import codec
from sluice.queries import verdict_cases
from sluice.sources import xz
from sluice.sources.lzma2 import LzmaProps, RunScanner, chunks, parse_lzma_header, scan_runs, stored_chunks
from tests import corpus

XZ = shutil.which("xz")
CASES = corpus.cases()


def kind_of(f, *a, **k) -> str:
    with pytest.raises(StreamError) as e:
        f(*a, **k)
    return e.value.kind


# ---- numbers and headers


@given(st.integers(0, 2**63 - 1), st.binary(max_size=4))
def test_vli_round_trip(v, more):
    raw = xz.vli_encode(v)
    assert xz.vli_decode(raw + more) == (v, len(raw)) and len(raw) == xz.vli_len(v) <= 9
    assert kind_of(xz.vli_decode, raw[:-1]) == "TruncatedVli" if len(raw) > 1 or not raw[:-1] else True


def test_vli_refuses_long_forms():
    for bad in (b"\x80\x00", b"\xff\x00", b"\x80" * 8 + b"\x00", b"\xff" * 9 + b"\x01", b"\x80" * 9 + b"\x01"):
        assert kind_of(xz.vli_decode, bad) == "BadVli"
    assert kind_of(xz.vli_encode, 2**63) == "BadVli"


def test_header_and_footer():
    for check in range(16):
        assert xz.parse_header(xz.make_header(check)) == check == xz.probe(xz.make_header(check) + b"x")
        assert xz.parse_footer(xz.make_footer(check, 64)) == (check, 64)
    h, f = xz.make_header(4), xz.make_footer(4, 8)
    assert kind_of(xz.parse_header, b"x" + h[1:]) == "BadMagic"
    assert kind_of(xz.parse_header, h[:11] + b"\0") == "HeaderCrc"
    raw = h[:6] + b"\0\x14"
    assert kind_of(xz.parse_header, raw + zlib.crc32(raw[6:]).to_bytes(4, "little")) == "BadStreamFlags"
    assert kind_of(xz.parse_footer, f[:-1] + b"X") == "BadFooterMagic"
    assert kind_of(xz.parse_footer, b"\0" + f[1:]) == "HeaderCrc"
    assert xz.probe(b"nothing") is None
    assert [xz.check_size(i) for i in (0, 1, 3, 4, 6, 7, 10, 13, 15)] == [0, 4, 4, 8, 8, 16, 32, 64, 64]


L2 = xz.Filter(0x21, b"\x10")


def test_block_headers():
    for filters in ([L2], [xz.Filter(3, b"\x07"), L2], [xz.Filter(7, (8).to_bytes(4, "little")), xz.Filter(3, b"\0"), xz.Filter(3, b"\0"), L2]):
        for sizes in ((None, None), (5, None), (None, 0), (2**40, 2**50)):
            got = xz.parse_block_header(xz.make_block_header(filters, *sizes) + b"rest")
            assert (got.filters, got.compressed, got.uncompressed) == (tuple(filters), *sizes)
    bad = bytearray(xz.make_block_header([L2]))
    bad[1] |= 4
    bad[-4:] = zlib.crc32(bytes(bad[:-4])).to_bytes(4, "little")
    assert kind_of(xz.parse_block_header, bytes(bad)) == "BadBlockHeader"
    assert kind_of(xz.parse_block_header, b"\0abc") == "BadBlockHeader"
    assert xz.parse_block_header(xz.make_block_header([L2], 100, 5)).unpadded(4) == 100 + 8 + len(xz.make_block_header([L2], 100, 5))


def test_chains():
    d = xz.Filter(3, b"\0")
    assert xz.validate_chain([d, d, d, L2]) == 16
    for chain, kind in (([], "BadFilterChain"), ([d], "BadFilterChain"), ([L2, d], "BadFilterChain"), ([d] * 4 + [L2], "BadFilterChain"), ([xz.Filter(0x99), L2], "UnsupportedFilter"), ([xz.Filter(7, b"\x01\0\0\0"), L2], "BadFilterChain"), ([xz.Filter(0x21, b"\x29")], "BadFilterChain")):
        assert kind_of(xz.validate_chain, chain) == kind
    assert xz.max_carry("RiscV") == 7 and xz.max_carry("Ia64") == 15


@given(st.lists(st.tuples(st.integers(5, 2**40), st.integers(0, 2**40)), max_size=40))
def test_index_round_trip(records):
    raw = xz.make_index(records)
    assert xz.parse_index(raw) == records and len(raw) % 4 == 0


def test_index_refuses():
    assert kind_of(xz.parse_index, xz.make_index([(4, 1)])) == "IndexMismatch"
    assert kind_of(xz.parse_index, xz.make_index([(9, 1)] * 5), 4) == "MemoryLimit"
    body = b"\0" + xz.vli_encode(2**40) + bytes(4)
    body += bytes(-len(body) % 4)
    assert kind_of(xz.parse_index, body + zlib.crc32(body).to_bytes(4, "little")) == "IndexMismatch"


def test_dictionary_numbers():
    assert [xz.dict_size_from_prop(p) for p in (0, 1, 2, 39, 40)] == [4096, 6144, 8192, 3 << 30, 0xFFFFFFFF]
    assert all(xz.prop_from_dict_size(xz.dict_size_from_prop(p)) == p for p in range(41))
    assert kind_of(xz.dict_size_from_prop, 41) == "UnsupportedProps"
    assert props.auto_block_size(1 << 16) == 1 << 20 and props.auto_block_size(1 << 30) == 1 << 30 and props.auto_block_size(64 << 20) == 256 << 20
    assert props.window_len(5000) == 8192 and props.capped_window(40, 10) == 4096
    assert props.admitted(16, 100, 30, 50) == 3 and props.admitted(16, 1, 30, 50) == 1 and props.admitted(16, 10**9, 1, 2) == 2
    assert props.parallel_memory(18, 1, 2**40) == (2 << 20) + (1 << 20)
    assert props.run_memory(18, 100) == 4096 + (64 << 10) and props.worker_window(20) == props.auto_block_size(4 << 20)
    p = LzmaProps(3, 0, 2, 1 << 20)
    assert props.reader_memory(p) == (1 << 20) + 2 * (1984 + (0x300 << 3)) + (1 << 16)
    assert LzmaProps.parse(p.encoded()) == p and p.encoded() == props.property_bytes(3, 0, 2, 1 << 20)
    assert kind_of(LzmaProps, 9, 0, 0, 4096) == "UnsupportedProps"
    assert parse_lzma_header(p.encoded() + b"\xff" * 8) == (p, None) and parse_lzma_header(p.encoded() + (77).to_bytes(8, "little")) == (p, 77)
    assert props.aligned_dict(3_000_000) == 3 << 20 and props.aligned_dict(5000) == 6144
    assert kind_of(props.preset, 10) == "Param" and props.preset(6).fast_bytes == 64


# ---- checksums


def test_known_checks():
    assert zlib.crc32(b"123456789") == 0xCBF43926 and cs.crc64_xz(b"123456789") == 0x995DC9BBDF1939FA
    for data in CASES.values():
        raw = lzma.compress(data, check=lzma.CHECK_CRC64)
        if data:
            b = codec.blocks_of(raw)[0]
            assert raw[b.file_offset + b.padded_size - 8 : b.file_offset + b.padded_size] == cs.crc64_xz(data).to_bytes(8, "little")


@settings(deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_combine(a, b):
    assert cs.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert cs.crc64_combine(cs.crc64_xz(a), cs.crc64_xz(b), len(b)) == cs.crc64_xz(a + b)


@settings(deadline=None)
@given(st.binary(max_size=300), st.lists(st.integers(0, 400), max_size=8), st.integers(0, 50))
def test_segments_fold_to_the_whole(data, cuts, offset):
    plan = cs.ChecksumPlan("Crc32", tuple(cuts))
    assert list(plan.split_points) == sorted(set(cuts) - {0})
    got = plan.segments(offset, data)
    folder = cs.CrcFolder()
    folder.extend((s["offset"], s["len"], s["check"]) for s in reversed(got))
    assert folder.range(offset, len(data)) == zlib.crc32(data)
    assert folder.range(offset, 0) == 0
    assert not data or folder.range(offset + 1, len(data)) is None
    whole = cs.ChecksumPlan("Sha256", tuple(cuts)).segments(offset, data)
    assert [s["check"] for s in whole] == ([hashlib.sha256(data).digest()] if data else [])
    assert plan.memory(offset, len(data)) == 24 * len(got)


def test_hooks():
    cs.install_hooks(crc32=lambda x: 7)
    try:
        assert cs.hooks_installed() and cs.check_bytes(1, b"x") == (7).to_bytes(4, "little")
    finally:
        cs.clear_hooks()
    assert not cs.hooks_installed() and kind_of(cs.install_hooks, md5=len) == "Param"


# ---- byte filters


@given(st.binary(max_size=700), st.integers(1, 256))
def test_delta(data, d):
    assert bf.delta_encode(data, d) == bytes((x - (data[i - d] if i >= d else 0)) % 256 for i, x in enumerate(data))
    assert bf.delta_decode(bf.delta_encode(data, d), d) == data


@pytest.mark.parametrize("kind", list(xz.BCJ_ALIGNMENT))
def test_converters_round_trip_and_convert(kind):
    start = 4096
    for n in (0, 1, 5, 8, 17, 4000, 40_003):
        data = corpus.code(n, kind)
        for pc in (0, start):
            e = bf.bcj(kind, data, True, pc)
            assert len(e) == n and bf.bcj(kind, e, False, pc) == data
            noise = corpus.noise(n)
            assert bf.bcj(kind, bf.bcj(kind, noise, False, pc), True, pc) == noise or kind in ("X86", "RiscV")
    assert kind == "Ia64" or bf.bcj(kind, corpus.code(40_003, kind), True) != corpus.code(40_003, kind)
    if xz.BCJ_ALIGNMENT[kind] > 1:
        assert kind_of(bf.bcj, kind, b"", True, 1) == "BadFilterChain"


@pytest.mark.skipif(not XZ, reason="no xz tool")
@pytest.mark.parametrize("kind,flag", [("Arm", "--arm"), ("Ppc", "--powerpc"), ("Sparc", "--sparc"), ("Arm64", "--arm64"), ("RiscV", "--riscv"), ("X86", "--x86"), ("ArmThumb", "--armthumb"), ("Ia64", "--ia64")])
def test_converters_equal_the_tool(kind, flag):
    for data in (corpus.code(60_003, kind), corpus.noise(60_000), corpus.code(9, kind)):
        for start in (0, 4096):
            name = f"{flag}=start={start}" if start else flag
            run = subprocess.run([XZ, "--format=raw", name, "--lzma2=preset=0", "-c"], input=data, capture_output=True)
            if run.returncode:
                pytest.skip(run.stderr.decode()[:80])
            converted = lzma.decompress(run.stdout, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6}])
            assert bf.bcj(kind, data, True, start) == converted
            assert bf.bcj(kind, converted, False, start) == data


@settings(deadline=None)
@given(st.binary(max_size=400), st.sampled_from(["X86", "Arm", "RiscV"]), st.lists(st.integers(0, 400), max_size=5))
def test_chunked_chain_equals_whole(data, kind, cuts):
    chain = [xz.Filter(3, b"\x02"), xz.Filter(next(k for k, v in xz.BCJ_KINDS.items() if v == kind)), xz.Filter(3, b"\0")]
    for encoding, whole in ((True, bf.encode_chain(chain, data)), (False, bf.decode_chain(chain, data))):
        c, out, bounds = bf.ChunkedChain(chain, encoding), b"", sorted({0, len(data), *(x for x in cuts if x < len(data))})
        for a, b in zip(bounds, bounds[1:]):
            out += c.push(data[a:b])
        assert out + c.finish() == whole


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=300))
def test_bcj2_round_trip(data):
    s = bf.bcj2_encode(data)
    assert bf.bcj2_decode(s.main, s.call, s.jump, s.rc, len(data)) == data


def test_bcj2():
    for n in (0, 5, 100, 50_001):
        data = corpus.code(n, "X86")
        s = bf.bcj2_encode(data)
        assert len(s.main) + len(s.call) + len(s.jump) == n and s.rc[0] == 0
        assert bf.bcj2_decode(s.main, s.call, s.jump, s.rc, n) == data
    assert len(s.call) > 1000 and len(s.jump) > 1000
    near = bf.bcj2_encode(data, relat_limit=0)
    assert not near.call and not near.jump and near.main == data
    inside = bf.bcj2_encode(data, file_size=1000)
    assert len(inside.call) < len(s.call) and bf.bcj2_decode(inside.main, inside.call, inside.jump, inside.rc, n) == data
    assert kind_of(bf.bcj2_decode, s.main, s.call[:-1], s.jump, s.rc, n) == "UnalignedStream"
    assert kind_of(bf.bcj2_decode, s.main, s.call, s.jump, b"\1" + s.rc[1:], n) == "CorruptData"
    assert kind_of(bf.bcj2_decode, s.main, s.call, s.jump, s.rc, n + 1) == "CorruptData"


# ---- LZMA2 and .lzma


@pytest.mark.parametrize("name", list(CASES))
def test_round_trips(name):
    data = CASES[name]
    for enc in (codec.Encoder(0), codec.Encoder(1, "sha256", 10_000), codec.Encoder(0, "crc32", 0, (xz.Filter(3, b"\x03"), xz.Filter(4)))):
        raw = codec.xz_encode(data, enc)
        assert codec.xz_decode(raw) == data == lzma.decompress(raw)
        prop, packed = codec.lzma2_encode(data, enc)
        assert codec.lzma2_decode(packed, prop) == data
        w = codec.XzWriter(enc)
        assert b"".join(w.push(data[i : i + 7000]) for i in range(0, len(data), 7000)) + w.finish() == raw
    alone = codec.lzma_alone_encode(data, 1)
    assert parse_lzma_header(alone)[1] == len(data) and codec.lzma_alone_decode(alone) == data == lzma.decompress(alone)
    p, raw1 = codec.lzma1_encode(data, 1)
    assert codec.lzma1_decode(raw1, p) == data == codec.lzma1_decode(raw1, p, len(data))
    assert codec.xz_decode(lzma.compress(data)) == data


def test_runs_decode_on_their_own():
    data = CASES["text-150000"] + CASES["noise-65537"]
    prop, packed = codec.lzma2_encode(data, codec.Encoder(1, block_size=40_000))
    runs = codec.runs_of(packed)
    assert len(runs) == -(-len(data) // 40_000)
    assert b"".join(codec.decode_run(packed[r.in_offset : r.in_offset + r.packed_len], r, prop) for r in runs) == data
    assert sum(r.packed_len for r in runs) == len(packed) - 1
    for r in runs:
        c = r.chunks
        assert c["header_bytes"] + c["payload_bytes"] == r.packed_len
    r = runs[1]
    bad = bytearray(packed[r.in_offset : r.in_offset + r.packed_len])
    bad[len(bad) // 2] ^= 255
    assert kind_of(codec.decode_run, bytes(bad), r, prop) in ("CorruptRun",)


@settings(deadline=None, max_examples=50)
@given(st.integers(0, 3000), st.integers(1, 700), st.lists(st.integers(1, 400), min_size=1, max_size=9))
def test_scanner_in_any_portions(n, size, steps):
    data = stored_chunks(corpus.noise(n), size)
    s, at, got, k = RunScanner(), 0, [], 0
    while at < len(data):
        step = steps[k % len(steps)]
        s.feed(data[at : at + step])
        got += s.runs()
        at, k = at + step, k + 1
    s.end()
    assert got == list(scan_runs(io.BytesIO(data), len(data)))
    assert sum(r.unpacked_len for r in got) == n and len(got) == (n > 0)
    assert codec.lzma2_decode(data, 0) == corpus.noise(n)


def test_scanner_refuses():
    for bad in (b"\x02\0\0x\0", b"\x03\0\0x\0", b"\x80\0\0\0\0\0x\0", b"\xe0\0\0\0\0\xff"):
        assert kind_of(codec.runs_of, bad) == "CorruptData"
    assert kind_of(codec.runs_of, stored_chunks(b"abc")[:-1]) == "Truncated"
    assert kind_of(lambda: list(chunks(stored_chunks(b"abc")[:4]))) == "Truncated"


def test_memory_limits():
    prop, packed = codec.lzma2_encode(CASES["text-150000"], codec.Encoder(6))
    assert kind_of(codec.lzma2_decode, packed, prop, None, 1 << 20) == "MemoryLimit"
    assert kind_of(codec.lzma_alone_decode, codec.lzma_alone_encode(b"x", 9), 1 << 20) == "MemoryLimit"
    raw = codec.xz_encode(CASES["text-150000"], codec.Encoder(1, block_size=50_000))
    assert kind_of(codec.xz_decode, raw, codec.Limits(max_unpack_bytes=120_000)) == "TooMuchOutput"
    assert kind_of(codec.xz_decode, raw, codec.Limits(max_block_size=10_000)) == "SizeMismatch"
    out = []
    with pytest.raises(StreamError):
        for _, d in codec.iter_decoded(raw, codec.Limits(max_unpack_bytes=120_000)):
            out.append(d)
    assert len(out) == 2


# ---- the container


@pytest.mark.parametrize("name,raw,expect", verdict_cases(), ids=[n for n, _, _ in verdict_cases()])
def test_verdicts_of_both_paths(name, raw, expect):
    def planned():
        return codec.xz_decode(raw)

    def forward():
        d = codec.SequentialDecoder()
        out = b"".join(d.push(raw))
        d.finish()
        return out

    if expect == "good":
        assert planned() == forward()
    else:
        assert kind_of(planned) in expect.split("|")
        with pytest.raises(StreamError):
            forward()


def both(raw):
    """What the planned and the forward path make of a file: the output, or None for an error."""
    out = []
    for f in (codec.xz_decode, lambda r: (lambda d: (b"".join(d.push(r)), d.finish())[0])(codec.SequentialDecoder())):
        try:
            out.append(f(raw))
        except StreamError:
            out.append(None)
    return out


def test_every_truncation_and_flip():
    data = b"some text, some more text " * 4
    for check in ("crc32", "crc64", "sha256"):
        raw = codec.xz_encode(data, codec.Encoder(0, check, 40))
        for n in range(len(raw)):
            assert both(raw[:n]) == [None, None], n
        for n in range(len(raw)):
            bad = raw[:n] + bytes((raw[n] ^ 0x55,)) + raw[n + 1 :]
            assert all(x is None or x == data for x in both(bad)), n
            assert both(bad)[0] is None, n


@settings(deadline=None, max_examples=30)
@given(st.binary(max_size=500), st.integers(1, 200), st.lists(st.integers(1, 90), min_size=1, max_size=6), st.integers(0, 3))
def test_forward_path_in_any_portions(data, block, steps, pads):
    raw = codec.xz_encode(data, codec.Encoder(0, "crc32", block))
    raw = raw + bytes(4 * pads) + raw
    assert codec.xz_decode(raw) == data * 2
    d, at, k, out = codec.SequentialDecoder(), 0, 0, b""
    while at < len(raw):
        step = steps[k % len(steps)]
        out += b"".join(d.push(raw[at : at + step]))
        at, k = at + step, k + 1
    d.finish()
    assert out == data * 2


def test_concatenation_and_offsets():
    a, b = codec.xz_encode(b"a" * 100, codec.Encoder(0, "crc32", 30)), codec.xz_encode(b"bb" * 50, codec.Encoder(0, "none"))
    raw = a + bytes(8) + b
    blocks = codec.blocks_of(raw)
    assert [(x.stream_no, x.block_no, x.uncompressed_offset) for x in blocks] == [(0, 0, 0), (0, 1, 30), (0, 2, 60), (0, 3, 90), (1, 0, 100)]
    assert blocks[-1].file_offset == len(a) + 8 + 12
    assert kind_of(codec.xz_decode, raw, codec.Limits(concatenated=False)) == "TrailingGarbage"
    s = xz.read_streams(io.BytesIO(raw), len(raw))
    assert [x.uncompressed_size for x in s] == [100, 100] and s[0].largest_block == 30
    reserved = xz.stored_stream([{"payload": b"abc"}], 2)
    assert kind_of(codec.xz_decode, reserved) == "UnsupportedCheck"
    assert codec.xz_decode(reserved, codec.Limits(allow_unverifiable=True)) == b"abc" == codec.xz_decode(reserved, codec.Limits(verify=False))
    bad = bytearray(codec.xz_encode(b"abc", codec.Encoder(0, "crc32")))
    at = codec.blocks_of(bytes(bad))[0]
    bad[at.file_offset + at.padded_size - 1] ^= 1
    assert kind_of(codec.xz_decode, bytes(bad)) == "CheckMismatch" and codec.xz_decode(bytes(bad), codec.Limits(verify=False)) == b"abc"


def tool(data, *options):
    """The tool's output, or None if this build of it lacks an option."""
    got = subprocess.run([XZ, *options], input=data, capture_output=True, check=False)
    return got.stdout if got.returncode == 0 else None


@pytest.mark.skipif(not XZ, reason="no xz tool")
@pytest.mark.parametrize("options", [["-1", "-T1"], ["-T+1", "-1", "--block-size=16KiB"], ["--check=sha256"], ["--check=none", "--delta=dist=4", "--lzma2=preset=1"], ["--arm64", "--lzma2=preset=0"], ["--riscv", "--lzma2=preset=0"], ["--x86", "--delta=dist=1", "--lzma2=preset=0"]])
def test_files_of_the_tool(options):
    data = CASES["text-150000"] + corpus.code(30_000, "X86")
    raw = tool(data, "-c", *options)
    if raw is None and {"--arm64", "--riscv"} & set(options):
        pytest.skip(f"the tool has no {options[0]}")
    assert both(raw) == [data, data]


@pytest.mark.skipif(not XZ, reason="no xz tool")
@pytest.mark.parametrize("filters", [(), (xz.Filter(3, b"\0"),), (xz.Filter(4), xz.Filter(3, b"\x03")), (xz.Filter(10),), (xz.Filter(11), xz.Filter(3, b"\0"))])
def test_our_files_for_the_tool(filters):
    data = CASES["text-150000"] + corpus.code(30_000, "X86")
    ours = codec.xz_encode(data, codec.Encoder(0, "crc64", 50_000, filters))
    if {f.id for f in filters} & {10, 11} and tool(data, "-c", "--arm64" if filters[0].id == 10 else "--riscv", "--lzma2=preset=0") is None:
        pytest.skip("the tool lacks the filter")
    assert tool(ours, "-dc") == data


def test_chase_gives_a_block_as_it_arrives():
    data = CASES["text-150000"] + corpus.code(90_000, "Arm64")
    for enc in (codec.Encoder(0, "crc32"), codec.Encoder(1, "crc64", 70_000), codec.Encoder(0, "sha256", 0, (xz.Filter(3, b"\x03"),)), codec.Encoder(0, "none", 100_000, (xz.Filter(10),))):
        raw = codec.xz_encode(data, enc) + bytes(4) + codec.xz_encode(b"more", enc)
        for step in (1 if len(raw) < 2000 else 97, 5000, len(raw)):
            d, out, first = codec.SequentialDecoder(chase=True), bytearray(), None
            for k in range(0, len(raw), step):
                for got in d.push(raw[k : k + step]):
                    first = k if first is None else first
                    out += got
            d.finish()
            assert bytes(out) == data + b"more"
            if step == 97 and not enc.block_size and not enc.filters:
                assert first < len(raw) * 2 / 3  # long before the one block's end
    raw = bytearray(codec.xz_encode(data, codec.Encoder(0, "crc64")))
    b = codec.blocks_of(bytes(raw))[0]
    raw[b.file_offset + b.padded_size - 1] ^= 1
    d, out = codec.SequentialDecoder(chase=True), bytearray()
    with pytest.raises(StreamError) as e:
        for got in d.push(bytes(raw)):
            out += got
    assert e.value.kind == "CheckMismatch" and bytes(out) == data
    assert kind_of(lambda: [*codec.SequentialDecoder(codec.Limits(max_unpack_bytes=1000), chase=True).push(codec.xz_encode(data))]) == "TooMuchOutput"
    lies = xz.stored_stream([{"payload": b"abc", "header_uncompressed": 9}])
    assert kind_of(lambda: [*codec.SequentialDecoder(chase=True).push(lies)]) == "SizeMismatch"


def test_blocks_that_arrive_are_walked_once():
    """Chunk headers of a block in many portions: as many looks as there are chunks."""
    from sluice.sources import lzma2

    data = corpus.noise(400_000)
    raw = codec.xz_encode(data, codec.Encoder(0, "crc32"))
    looks, parse = [], lzma2.RunScanner._parse
    lzma2.RunScanner._parse = lambda self: looks.append(1) or parse(self)
    try:
        d = codec.SequentialDecoder()
        got = b"".join(x for k in range(0, len(raw), 500) for x in d.push(raw[k : k + 500]))
    finally:
        lzma2.RunScanner._parse = parse
    assert got == data and len(looks) < 2 * len(raw) / 500


def test_push_writers():
    import lzma

    data = CASES["text-150000"]
    for w in (codec.LzmaWriter(1), codec.Lzma1Writer(1), codec.Lzma2Writer(codec.Encoder(1), 40_000)):
        out = b"".join([*(w.push(data[k : k + 7001]) for k in range(0, len(data), 7001)), w.finish()])
        if isinstance(w, codec.Lzma1Writer):
            assert codec.lzma1_decode(out, w.props) == data
        elif isinstance(w, codec.LzmaWriter):
            assert lzma.decompress(out) == data == codec.lzma_alone_decode(out)
        else:
            assert codec.lzma2_decode(out, 40) == data and len(codec.runs_of(out)) == 4


def test_riscv_pairs_by_their_fields():
    """Random instruction words: converted exactly where the fields say, and back."""
    from sluice.operators.byte_filters import bcj

    rng = __import__("random").Random(8)
    seen = set()
    for _ in range(4000):
        kind = rng.randrange(4)
        rd, base = rng.choice([0, 1, 2, 5, 9, 31]), rng.choice([0, 1, 2, 5, 9, 31])
        if kind == 0:
            words = [0x6F | rd << 7 | rng.randrange(1 << 20) << 12, rng.randrange(1 << 32)]
        elif kind == 3:
            low = rng.choice([0b11, 0b11, rng.randrange(4)]) | rng.randrange(1 << 13) << 2
            words = [0x17 | 2 << 7 | low << 12 | base << 27, rng.randrange(1 << 32)]
        else:
            words = [0x17 | rd << 7 | rng.randrange(1 << 20) << 12, rng.choice([0b11, 0b11, rng.randrange(4)]) | rng.randrange(1 << 13) << 2 | base << 15 | rng.randrange(1 << 12) << 20]
        data = b"".join(w.to_bytes(4, "little") for w in words) + bytes(8)
        pc = rng.randrange(1 << 20) * 2
        out = bcj("RiscV", data, True, pc)
        assert bcj("RiscV", out, False, pc) == data
        if kind == 0:
            # an offset of 0 - place keeps its bytes; any other link changes
            moved = rd in (1, 5)
            assert moved or out[:4] == data[:4]
        elif kind == 3:
            moved = low & 3 == 3 and base not in (0, 2)
            assert (out[:4] != data[:4]) == moved
        else:
            moved = rd not in (0, 2) and words[1] & 3 == 3 and base == rd
            if rd not in (0, 2) and not {data[4], data[6]} & {0xEF, 0x17, 0x97}:  # else a later instruction may begin there
                assert (out[:4] != data[:4] or out[4:8] != data[4:8]) == moved
        seen.add((kind, moved))
    assert seen == {(k, m) for k in range(4) for m in (False, True)}


def test_index_fold():
    def fold(records):
        f = cs.IndexFold()
        for r in records:
            f.push(*r)
        return f.finish()

    records = [(100, 3), (55, 9), (77, 0)]
    assert fold(records)[:3] == (3, 100 + 56 + 80, 12)
    assert fold(records) == fold(list(records)) != fold(records[::-1])
    assert kind_of(fold, [(4, 1)]) == "SizeMismatch" and kind_of(fold, [(2**62, 1)] * 3) == "SizeMismatch"
    assert props.encoder_memory(props.preset(9)) > props.encoder_memory(props.preset(1))
