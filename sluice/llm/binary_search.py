"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits; every segment has an index from its value to codes. By the pigeonhole
principle a code within distance r of the query agrees with it, in some segment, within r // segments. So the
search grows one segment's radius by one at a time; after segments 0..j are at radius t and the others at
t - 1, everything nearer than segments * t + j + 1 has been met. It stops when the kth verified distance is
within that. Equal codes are one entry with its smallest k ids, which is all of them that can rank.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.runtime import documents, staged

#: Bits of a word of a code, and of a segment.
WORD, WIDTH = 64, 16


def sign_code(vector: Column) -> Column:
    """The code as words of 64 bits: bit i is set where component i is over 0, components of a word from its highest
    bit used. A vector of any length but 0 has one; null and empty vectors: null. A null or NaN component counts as 0."""
    bit = F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), F.expr("1L")).otherwise(F.expr("0L")))
    word = lambda at: F.aggregate(F.slice(bit, at * WORD + 1, WORD), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    code = F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / WORD).cast("int")), word)
    return F.when(F.size(vector) > 0, code)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hamming distances of codes (rows of words) from one."""
    return np.bitwise_count(codes ^ code).sum(axis=1).astype(np.int64)


@lru_cache(maxsize=64)
def flips(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits with `radius` of them set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.uint64)


class MultiIndex:
    """Segment indexes over distinct codes: rows of words."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, WORD * codes.shape[1]
        self.segments, self.width = self.bits // WIDTH, WIDTH
        self.order, self.start = [], []
        for j in range(self.segments):
            value = self.value(codes, j).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.start.append(np.searchsorted(value[order], np.arange((1 << self.width) + 1)))

    def value(self, codes: np.ndarray, j: int):
        per = WORD // self.width
        return (codes[..., j // per] >> np.uint64(j % per * self.width)) & np.uint64((1 << self.width) - 1)

    def met(self, code: np.ndarray, j: int, radius: int) -> np.ndarray:
        """Entries whose segment j is at just this distance from the query's."""
        value = (self.value(code, j) ^ flips(self.width, radius)).astype(np.int64)
        a, b = self.start[j][value], self.start[j][value + 1]
        n = b - a
        on = n > 0
        a, n = a[on], n[on]
        if not len(n):
            return np.empty(0, np.int64)
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.order[j][at]

    def search(self, code: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entries, distances, probes): every entry that can be among the k nearest rows, weight[i] rows being
        at entry i."""
        seen = np.zeros(len(self.codes), bool)
        entries, dists = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        histogram = np.zeros(self.bits + 1, np.int64)
        probes = 0
        for radius in range(self.width + 1):
            for j in range(self.segments):
                found = self.met(code, j, radius)
                probes += 1
                found = np.unique(found[~seen[found]])
                if len(found):
                    seen[found] = True
                    d = distances(self.codes[found], code)
                    entries.append(found)
                    dists.append(d)
                    histogram += np.bincount(d, weight[found], self.bits + 1).astype(np.int64)
                covered = self.segments * radius + j
                kth = int(np.searchsorted(np.cumsum(histogram), k))  # over bits: fewer than k rows yet
                if kth <= covered:
                    e, d = np.concatenate(entries), np.concatenate(dists)
                    return e[d <= kth], d[d <= kth], probes
        return np.concatenate(entries), np.concatenate(dists), probes


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, *, block_codes: int = 1 << 20, query_block: int = 1 << 18, least_groups: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (1 first), key, distance: for each query the k rows nearest by Hamming distance of the sign
    codes, ties by id; the query's own row is not among them. Vectors have any number of components; those of another
    number than the query's are no neighbours of it.

    Rows or queries whose vector is null or empty, or whose id is null, have no code and are in no result. Rows that
    repeat an id count once if their codes are equal, else once per code. With fewer than k rows, all are returned; of
    an empty table, none. Other columns aren't read.

    Blocks of about block_codes distinct codes (hash of the code) meet blocks of query_block queries, one group
    each; a group returns k rows per query at most, and a last ranking keeps the nearest k.
    """
    columns = (F.col(key).cast("long"), F.size(vector), sign_code(F.col(vector)))
    coded = rows.select(*(c.alias(n) for c, n in zip(columns, ("id", "dim", "code"), strict=True))).where("id is not null and code is not null")
    asked = queries.select(*(c.alias(n) for c, n in zip(columns, ("q", "dim", "qcode"), strict=True))).where("q is not null and qcode is not null")
    asked = staged(asked.distinct(), "queries")
    # the smallest k + 1 ids of a code: one of them may be the query itself
    ranked = Window.partitionBy("dim", "code", "_salt").orderBy("id")
    few = coded.distinct().withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k + 1)
    codes = few.groupBy("dim", "code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    codes = staged(codes, "codes")
    n_codes, n_asked = codes.count(), asked.count()
    blocks = max(1, -(-n_codes // block_codes))
    parts = max(1, -(-n_asked // query_block), min(n_asked // 64, least_groups // blocks))
    left = codes.withColumn("_b", F.pmod(F.xxhash64("code"), F.lit(blocks))).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("_b", "_p", "dim", "code", "ids")
    right = asked.withColumn("_p", F.pmod(F.xxhash64("q"), F.lit(parts))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("_b", "_p", "dim", "q", "qcode")

    def words(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return flat.reshape(len(column), -1)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if a.num_rows and b.num_rows:
            codes, ids = words(a.column("code")), a.column("ids").to_pylist()
            index, weight = MultiIndex(codes), np.array([len(x) for x in ids])
            for q, code in zip(b.column("q").to_pylist(), words(b.column("qcode")), strict=True):
                entries, dist, _ = index.search(code, k + 1, weight)
                order = np.argsort(dist, kind="stable")
                best, last = [], -1
                for e, d in zip(entries[order].tolist(), dist[order].tolist(), strict=True):
                    if len(best) >= k and d > last:
                        break
                    last = d
                    best += [(d, i) for i in ids[e] if i != q]
                out += [(q, i, d) for d, i in sorted(best)[:k]]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "id": pa.array([x[1] for x in out], pa.int64()), "distance": pa.array([x[2] for x in out], pa.int32())})

    met = left.groupBy("_b", "_p", "dim").cogroup(right.groupBy("_b", "_p", "dim")).applyInArrow(meet, "query_id long, id long, distance int")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    found = met.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(key), "distance")


def op5_binary_top_k(spark, sf_dir):
    rows = documents(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP5_SQL = """
WITH c AS (SELECT vec_id, list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)::BIT AS code FROM embeddings),
p AS (SELECT q.vec_id AS query_id, r.vec_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
      FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM n WHERE rank <= 10
"""


def brute_force(ids: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The same by comparing everything; for tests."""
    out = []
    for q in query_ids:
        d = distances(codes, codes[np.flatnonzero(ids == q)[0]])
        rows = sorted((int(x), int(i)) for x, i in zip(d, ids, strict=True) if i != q)[:k]
        out += [(int(q), r + 1, i, x) for r, (x, i) in enumerate(rows)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "distance"])
