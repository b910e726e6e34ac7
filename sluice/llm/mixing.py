"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded selection.

Targets come from the weights, no target above `most_repeats` times its source. Blocks go to sources by the
highest quotients target / (2 k + 1), then within a source to groups of shards and to its shards in the same way, so
every shard gets an integer quota. Within a shard of m blocks with quota q, each block is taken q div m times and
q mod m blocks once more: whole runs of neighbouring blocks in the order of a seeded permutation, and of the last run
its first blocks, so texts are cut once in a run, not once in a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluice.llm.runtime import documents, n_words, staged, unused


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, most_repeats: float = 3) -> list[float]:
    """Shares of total by weight; what a source can't take goes to the others by weight, until none is above its cap."""
    caps = [most_repeats * s for s in sizes]
    out, free = [0.0] * len(caps), list(range(len(caps)))
    left = float(total)
    while free:
        whole = sum(weights[i] for i in free)
        share = {i: left * weights[i] / whole if whole else 0.0 for i in free}
        full = [i for i in free if share[i] > caps[i]]
        if not full:
            for i in free:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(caps[i])
            left -= caps[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), none above its cap; ties go to the earlier one.

    A divisor is searched for that gives at most `seats`; the few that remain are dealt out one by one.
    """
    v, c = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, c[v > 0].sum())) if len(v) else 0
    if seats <= 0:
        return np.zeros(len(v), np.int64)
    given = lambda d: np.minimum(np.floor(v / d + 0.5).astype(np.int64), c)
    low, high = v.sum() / (4.0 * seats + 4 * len(v) + 4), 2 * v.max() + 1
    while given(low).sum() <= seats and low > 1e-300:
        if given(low).sum() == seats:
            return given(low)
        low /= 4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
        if high - low <= 1e-15 * high:
            break
    out = given(high)
    heap = [(-v[i] / (2 * out[i] + 1), i) for i in range(len(v)) if v[i] > 0 and out[i] < c[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < c[i]:
            heapq.heappush(heap, (-v[i] / (2 * out[i] + 1), i))
    return out


def ranked_weights(sources: Sequence[str | None], cycle: Sequence[float] = (1, 2, 3)) -> dict:
    """Sources by code point (UTF-8 bytes order alike), null last, weigh as the cycle goes."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


#: Shards that are apportioned in one group.
GROUP = 8192
_ROW = ("_file", "_at")


def identified(docs: DataFrame, names: tuple[str, str] = _ROW) -> DataFrame:
    """docs with two columns that tell its rows apart, whatever they hold, and name them again when docs is read once
    more: the file and the row's number in it. What doesn't come from files is written first."""
    where = [F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    try:
        return docs.select("*", *where)
    except AnalysisException:
        return staged(docs, "rows").select("*", *where)


def places(blocks: int, run_blocks: int, name: int) -> np.ndarray:
    """For each run of run_blocks blocks (the last may be shorter), how many blocks come before it in an order of the
    runs that is drawn by `name`."""
    runs = -(-blocks // run_blocks)
    order = np.array(sorted(range(runs), key=lambda r: xxhash.xxh3_64_intdigest(r.to_bytes(8, "little"), seed=name)), np.int64)
    size = np.full(runs, run_blocks, np.int64)
    if runs:
        size[-1] = blocks - (runs - 1) * run_blocks
    out = np.zeros(runs, np.int64)
    out[order] = np.cumsum(size[order]) - size[order]
    return out


#: (from, to, times): the words of a document that are taken `times` times, run by run of its shard's blocks. Block b
#: begins at word b * shard size div blocks; of a run, the first blocks up to the extra ones are taken once more.
_SPANS = """CASE WHEN _size = 0 OR _blocks = 0 THEN array() ELSE filter(flatten(transform(
  sequence((((_offset + 1) * _blocks - 1) div _in) div {run}, (((_offset + _size) * _blocks - 1) div _in) div {run}),
  c -> transform(array(least(greatest(_extra - _places[cast(c AS int)], 0L), least({run}L, _blocks - c * {run}))), n -> array(
    named_struct('from', greatest((c * {run} * _in) div _blocks - _offset, 0L), 'to', least(((c * {run} + n) * _in) div _blocks - _offset, _size), 'times', _base + 1),
    named_struct('from', greatest(((c * {run} + n) * _in) div _blocks - _offset, 0L), 'to', least((least((c + 1) * {run}, _blocks) * _in) div _blocks - _offset, _size), 'times', _base)))[0])),
  x -> x.from < x.to AND x.times > 0) END"""


def mix_plan(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    share: float = 1.0,
    most_repeats: int = 3,
    block_words: int = 16,
    run_blocks: int = 32,
    shard_words: int = 262_144,
    most_sources: int = 1_000_000,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, taken, and spans (from, to, times) of its words,
    with the columns `keep` of docs. Only key, text, source and those are read, under names of this function's own.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null or repeated ids, equal rows: each row has a
    place of its own; equal ids and sizes are dealt over the source's shards. Texts of any length: a document is what
    lies between two places of its shard's words. Empty table: no rows. `weights` missing: the cycle 1, 2, 3; a source
    that `weights` lacks weighs 0.

    The driver gets one row per source (as many as there are weights; more than most_sources is an error). Shards have
    about shard_words words, at any size of a source; a source's seats go to groups of GROUP shards, a group's to its
    shards, and a window places the documents of a shard.
    """
    spark = docs.sparkSession
    sizes = docs.select(*keep, F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(F.col(text)).alias("_size"))
    sizes = staged(sizes, "sizes")
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("n")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    by = {r["_source"]: int(r["n"]) for r in totals}
    chosen = dict(weights) if weights is not None else ranked_weights(list(by))
    order = [*sorted((s for s in by if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")), *([None] if None in by else [])]
    whole = share * sum(by.values())
    targets = capped_targets([by[s] for s in order], [chosen.get(s, 0) for s in order], whole, most_repeats)
    blocks = [max(1, round(by[s] / block_words)) if by[s] else 0 for s in order]
    # a target of 0 has no seat; a capped source gets all its blocks most_repeats times
    seats = sainte_lague(targets, round(sum(targets) / block_words), [most_repeats * b for b in blocks])
    schema = T.StructType(
        [T.StructField("_s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_seats", T.LongType()), T.StructField("_shards", T.LongType())]
    )
    plan = spark.createDataFrame([(s, by[s], float(t), int(q), max(1, -(-by[s] // shard_words))) for s, t, q in zip(order, targets, seats, strict=True)], schema)
    plan = F.broadcast(plan)  # one row per source, checked above
    # rows that share id and size, which are alike but for what isn't looked at, are told apart by their number
    several = sizes.groupBy("_key", "_size").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_k"), F.col("_size").alias("_z"), F.lit(True).alias("_several"))
    salt = F.when(F.col("_several"), F.xxhash64(*keep) if keep else F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    placed = sizes.join(several, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_size") == F.col("_z")), "left").drop("_k", "_z").withColumn("_salt", salt).drop("_several")
    placed = placed.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_key", "_size", "_salt"), F.col("_shards")))
    placed = staged(placed.drop("_shards"), "placed")

    def dealt(rows: pd.DataFrame) -> pd.DataFrame:
        """Seats of rows of `_in` words and `_blocks` blocks that share `_seats`."""
        q = sainte_lague(rows["_in"].to_numpy(float), int(rows["_seats"].iloc[0]), most_repeats * rows["_blocks"].to_numpy(np.int64))
        return rows.assign(_quota=q)

    def to_groups(rows: pd.DataFrame) -> pd.DataFrame:
        return dealt(rows.sort_values("_group"))[["_source", "_group", "_quota"]]

    def to_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = dealt(rows.sort_values("_shard"))
        name = lambda s, n: xxhash.xxh3_64_intdigest(f"{n} {s}".encode("utf-8", "surrogatepass"), seed=seed)
        rows["_places"] = [places(int(m), run_blocks, name(s, n)) for s, n, m in zip(rows["_source"], rows["_shard"], rows["_blocks"], strict=True)]
        return rows[["_source", "_shard", "_in", "_blocks", "_quota", "_places"]]

    sums = placed.groupBy("_source", "_shard").agg(F.sum("_size").alias("_in"), F.max("_seats").alias("_seats"))
    m = F.when(F.col("_in") > 0, F.greatest(F.lit(1), F.round(F.col("_in") / block_words))).otherwise(0).cast("long")
    sums = staged(sums.withColumns({"_blocks": m, "_group": F.floor(F.col("_shard") / GROUP)}), "shards")
    groups = sums.groupBy("_source", "_group").agg(F.sum("_in").alias("_in"), F.sum("_blocks").alias("_blocks"), F.max("_seats").alias("_seats"))
    groups = groups.groupBy("_source").applyInPandas(to_groups, "_source string, _group long, _quota long")
    groups = groups.select(F.col("_source").alias("_gs"), F.col("_group").alias("_gn"), F.col("_quota").alias("_seats"))
    shards = sums.drop("_seats").join(groups, F.col("_source").eqNullSafe(F.col("_gs")) & (F.col("_group") == F.col("_gn")))
    quotas = shards.groupBy("_source", "_group").applyInPandas(to_shards, "_source string, _shard long, _in long, _blocks long, _quota long, _places array<long>")
    quotas = quotas.select(F.col("_source").alias("_qs"), F.col("_shard").alias("_qn"), "_in", "_blocks", "_places", F.expr("_quota div greatest(_blocks, 1)").alias("_base"), F.expr("_quota % greatest(_blocks, 1)").alias("_extra"))
    inside = Window.partitionBy("_source", "_shard").orderBy("_key", "_size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_offset", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    rows = rows.join(quotas, F.col("_source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qn")))
    spans = F.expr(_SPANS.format(run=run_blocks)).cast("array<struct<from:bigint,to:bigint,times:bigint>>")
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["to"] - x["from"]) * x["times"])
    rows = rows.withColumn("spans", spans).withColumn("taken", taken)
    return rows.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target", "taken", "spans", *keep)


def of_copy(spans: Sequence[Mapping[str, int]], copy: int) -> list[tuple[int, int]]:
    """Word ranges of a document that the mix takes at least `copy` times."""
    out: list[tuple[int, int]] = []
    for x in spans:
        if x["times"] >= copy:
            if out and out[-1][1] == x["from"]:
                out[-1] = (out[-1][0], x["to"])
            else:
                out.append((x["from"], x["to"]))
    return out


def mixed_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy that is taken of a document, its text cut to the taken
    words (white space between them as it was). Rows meet their own part of the plan by their place in docs' files, so
    null and repeated ids, equal rows and columns of any names are as good as others. Odd rows: as mix_plan() says."""
    import re

    file, at, spans = (unused(docs.columns, x) for x in ("file", "at", "spans"))
    rows = identified(docs, (file, at))
    plan = mix_plan(rows, weights, key=key, text=text, source=source, keep=(file, at), **options).where("taken > 0")
    joined = rows.join(plan.select(file, at, F.col("spans").alias(spans)), [file, at]).drop(file, at)
    out = docs.schema
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            rows, texts = [], []
            for n, (t, parts) in enumerate(zip(column(text).to_pylist(), column(spans).to_pylist(), strict=True)):
                found = None
                for copy in range(1, max(x["times"] for x in parts) + 1):
                    got = of_copy(parts, copy)
                    found = found or [m.span() for m in word.finditer(t)]
                    rows.append(n)
                    texts.append(t if got == [(0, len(found))] else " ".join(t[found[a][0] : found[b - 1][1]] for a, b in got))
            kept = batch.select(out.fieldNames()).take(pa.array(rows, pa.int64()))
            columns = [pa.array(texts, pa.string()) if f == text else kept.column(i) for i, f in enumerate(out.fieldNames())]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return joined.mapInArrow(cut, out)


def op1_mix_sources(spark, sf_dir):
    return mix_plan(identified(documents(spark, sf_dir)), keep=_ROW).select("doc_id", "size", "source_size", "target", "taken")
