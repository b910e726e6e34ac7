"""Container algebra on DataFrames: located blocks, index verification, segments, ordered folds, runs, prefixes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from sluice.functions import checksum as cs
from sluice.functions.columns import padded_size


def located(blocks: DataFrame, stream: Sequence[str] = ("path", "stream_no"), order: str = "block_no", base: Column | int = 12) -> DataFrame:
    """Adds padded_size, file_offset and uncompressed_offset: exclusive prefix sums within a stream.

    Sums past 63 bits come out as null (try_add would have overflowed). A stream is sorted in one task: its
    records are index entries of a few bytes, and files have many streams.
    """
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("padded_size", padded_size(F.col("unpadded_size")))
    before = lambda c: F.coalesce(F.try_sum(c).over(w), F.lit(0))
    return rows.withColumns({"file_offset": before("padded_size") + base, "uncompressed_offset": before("uncompressed_size")})


def located_across(blocks: DataFrame, path: str = "path") -> DataFrame:
    """located(), then the second level: streams of a file follow one another in the output."""
    totals = blocks.groupBy(path, "stream_no").agg(F.sum("uncompressed_size").alias("_n"))
    w = Window.partitionBy(path).orderBy("stream_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    rows = located(blocks, (path, "stream_no")).join(totals, [path, "stream_no"])
    return rows.withColumn("uncompressed_offset", F.col("uncompressed_offset") + F.col("_before")).drop("_before")


def index_mismatches(blocks: DataFrame, index: DataFrame, keys: Sequence[str] = ("stream_no", "block_no")) -> DataFrame:
    """Where index records and decoded blocks disagree: keys, reason (missing_record, missing_block, sizes)."""
    sizes = ["unpadded_size", "uncompressed_size"]
    a = blocks.select(*keys, F.struct(*sizes).alias("_b"))
    b = index.select(*keys, F.struct(*sizes).alias("_i"))
    both = a.join(b, list(keys), "full_outer")
    reason = F.when(F.col("_i").isNull(), "missing_record").when(F.col("_b").isNull(), "missing_block").when(F.col("_i") != F.col("_b"), "sizes")
    return both.select(*keys, reason.alias("reason")).where("reason is not null")


def split_segments(blocks: DataFrame, cuts: Sequence[int], offset: str = "uncompressed_offset", length: str = "uncompressed_size") -> DataFrame:
    """A row per segment of each block as the cuts divide it: seg_offset, seg_len. Cuts are sorted, distinct, not 0;
    those outside a block don't touch it. The cuts are a literal of the plan, not a table."""
    points = list(cs.ChecksumPlan("Crc32", tuple(cuts)).split_points)
    end = F.col(offset) + F.col(length)
    inside = F.filter(F.lit(points).cast("array<bigint>") if points else F.array().cast("array<bigint>"), lambda c: (c > F.col(offset)) & (c < end))
    bounds = F.concat(F.array(F.col(offset)), inside, F.array(end))
    spans = F.transform(F.sequence(F.lit(1), F.size("_cut") - 1), lambda i: F.struct(F.get("_cut", i - 1).alias("seg_offset"), (F.get("_cut", i) - F.get("_cut", i - 1)).alias("seg_len")))
    rows = blocks.where(F.col(length) > 0).withColumn("_cut", bounds)
    return rows.withColumn("_s", F.explode(spans)).select(*blocks.columns, "_s.*")


def _folded(width: int):
    @arrow_udf("len long, crc string")
    def fold(pieces: pa.Array) -> pa.Array:
        out = []
        for row in pieces.to_pylist():
            n = total = 0
            for p in row or []:
                total = cs.combine(width, total, int(p["crc"], 16), p["len"])
                n += p["len"]
            out.append({"len": n, "crc": f"{total:0{width // 4}X}"})
        return pa.array(out, pa.struct([("len", pa.int64()), ("crc", pa.string())]))

    return fold


def fold_crcs(pieces: DataFrame, keys: Sequence[str], order: str, length: str, crc_hex: str, width: int = 32, fan_in: int = 4096) -> DataFrame:
    """CRC of the concatenation of each key's pieces in order: keys, len, crc (hex).

    combine() is associative but not commutative, so pieces are gathered by position: `fan_in` neighbours fold
    into one piece, in as many rounds as it takes; no group ever holds more than that. (The numbering sorts a
    key's pieces, a few bytes each, in one task.)
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    rows = pieces.select(*keys, (F.row_number().over(w) - 1).alias("_n"), F.col(length).cast("long").alias("len"), F.col(crc_hex).alias("crc"))
    fold = _folded(width)
    while True:
        rows = rows.withColumn("_g", F.floor(F.col("_n") / fan_in))
        grouped = rows.groupBy(*keys, "_g").agg(F.sort_array(F.collect_list(F.struct("_n", "len", "crc"))).alias("_p"))
        done = fold(F.transform("_p", lambda p: F.struct(p["len"].alias("len"), p["crc"].alias("crc"))))
        rows = grouped.withColumn("_f", done).select(*keys, F.col("_g").alias("_n"), "_f.len", "_f.crc")
        if rows.where("_n > 0").isEmpty():
            break
    return rows.select(*keys, "len", "crc")


def split_every(blocks: DataFrame, step: int, offset: str = "uncompressed_offset", length: str = "uncompressed_size") -> DataFrame:
    """split_segments() at every multiple of `step`, which takes no list of cuts: however long a stream is."""
    at, end = F.col(offset), F.col(offset) + F.col(length)
    cut = lambda i: F.least(end, F.greatest(at, i * step))
    spans = F.transform(F.sequence(F.floor(at / step), F.floor((end - 1) / step)), lambda i: F.struct(cut(i).alias("seg_offset"), (cut(i + 1) - cut(i)).alias("seg_len")))
    return blocks.where(F.col(length) > 0).withColumn("_s", F.explode(spans)).select(*blocks.columns, "_s.*")


def answer_ranges(ranges: DataFrame, pieces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ranges (offset, len) with crc: folded from the pieces (p_offset, p_len, crc hex) that lie within; null unless
    they tile the range exactly. Of pieces at one offset the longest counts.

    Ranges and pieces meet by key and by the stretch of the stream in which a piece begins; stretches are as long as
    the ranges are on average, so a range is in a few of them. Its pieces are folded in rounds, as fold_crcs() does."""
    keys = list(keys)
    best = pieces.groupBy(*keys, "p_offset").agg(F.max_by(F.struct("p_len", "crc"), "p_len").alias("_v")).select(*keys, "p_offset", "_v.*").where("p_len > 0")
    r = ranges.withColumn("_id", F.xxhash64(*keys, "offset", "len"))
    asked = r.where("len > 0").select(*keys, "_id", "offset", "len").distinct()
    width = max(1, int(asked.agg(F.avg("len")).first()[0] or 1))
    stretches = F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("len") - 1) / width))
    met = asked.withColumn("_at", F.explode(stretches)).join(best.withColumn("_at", F.floor(F.col("p_offset") / width)), [*keys, "_at"])
    inside = (F.col("p_offset") >= F.col("offset")) & (F.col("p_offset") + F.col("p_len") <= F.col("offset") + F.col("len"))
    w = Window.partitionBy("_id").orderBy("p_offset")
    end = F.col("p_offset") + F.col("p_len")
    rows = met.where(inside).withColumn("_ok", F.col("p_offset") == F.coalesce(F.lag(end).over(w), F.col("offset")))
    whole = rows.groupBy("_id", "offset", "len").agg(F.min("_ok").alias("_ok"), F.max(end).alias("_end")).where(F.col("_ok") & (F.col("_end") == F.col("offset") + F.col("len"))).select("_id")
    folded = fold_crcs(rows.join(whole, "_id", "left_semi").select("_id", "p_offset", "p_len", "crc"), ["_id"], "p_offset", "p_len", "crc").select("_id", "crc")
    out = r.join(folded, "_id", "left")
    return out.withColumn("crc", F.when(F.col("len") == 0, "00000000").otherwise(F.col("crc"))).select(*ranges.columns, "crc")


def number_runs(chunks: DataFrame, keys: Sequence[str] = ("path",), order: str = "in_offset", control: str = "control") -> DataFrame:
    """Adds run_no: chunks that reset the dictionary start a run (gaps and islands)."""
    start = ((F.col(control) == 1) | (F.col(control) >= 0xE0)).cast("long")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("run_no", F.sum(start).over(w) - 1)


def runs_of(chunks: DataFrame, keys: Sequence[str] = ("path",), order: str = "in_offset") -> DataFrame:
    """A row per run: offsets, lengths, chunk counts by kind."""
    c = F.col("control")
    n = lambda cond: F.count_if(cond)
    rows = number_runs(chunks, keys, order)
    return rows.groupBy(*keys, "run_no").agg(
        F.min(order).alias("in_offset"),
        F.sum(F.col("header_len") + F.col("payload_len")).alias("packed_len"),
        F.sum("unpacked_len").alias("unpacked_len"),
        n(c == 1).alias("stored_reset"),
        n(c == 2).alias("stored"),
        n(c.between(0x80, 0x9F)).alias("lzma"),
        n(c.between(0xA0, 0xBF)).alias("lzma_state_reset"),
        n(c.between(0xC0, 0xDF)).alias("lzma_new_props"),
        n(c >= 0xE0).alias("lzma_dict_reset"),
    )


def before_first_error(rows: DataFrame, keys: Sequence[str], order: str, error: Column) -> DataFrame:
    """The rows before each key's first error, and the row with the error itself. One pre-aggregated minimum per
    key, then a join: no window over a whole stream."""
    first = rows.where(error).groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, list(keys), "left").where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")


def take_bytes(pieces: DataFrame, limit: int, keys: Sequence[str] = ("path",), order: str = "out_offset", data: str = "data") -> DataFrame:
    """At most `limit` bytes of each key's pieces in order; the last piece is cut."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("_before", F.coalesce(F.sum(F.octet_length(data)).over(w), F.lit(0))).where(F.col("_before") < limit)
    return rows.withColumn(data, F.substring(F.col(data), F.lit(1), (F.lit(limit) - F.col("_before")).cast("int"))).drop("_before")


def cut_blocks(rows: DataFrame, size: int, content: str = "content") -> DataFrame:
    """A row per block of `size` bytes: block_no, offset, block (binary). Empty content has none."""
    n = F.octet_length(content)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = rows.select("*", F.explode(numbers).alias("block_no"))
    out = out.withColumn("offset", F.col("block_no").cast("long") * size)
    return out.withColumn("block", F.substring(F.col(content), (F.col("offset") + 1).cast("int"), F.lit(size))).drop(content)
