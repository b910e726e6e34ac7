"""LM scoring with a probabilistic suffix tree over words.

Counting covers every training document. Each context of one to `depth` words, and each edge (a word after it), is a
candidate if it is seen EDGE_LEAST times or more, at any size of the corpus and whatever its own first word's count;
a context stays in the tree if its next-word distribution diverges from that of its suffix by more than the code
length of its edges (count * KL > df / 2 * log N). The tree is a written table keyed by hashes, which grows with the
corpus; documents meet it in joins. Only its head, by shares of all tokens, is broadcast as a fast path.

    P(x | s) = (c(s, x) + (o(s) + mu) P(x | suffix(s))) / (n(s) + mu),   P(x) = (c(x) + 0.1) / (N + 0.1 (V + 1))

with o(s) the occurrences whose next word is no edge of s. The state of a token is the longest context in the
tree that ends before it. A document's log-probability is a sum over its runs of up to depth + 1 words: a run adds
log(P(x | s) / P(x | suffix(s)) / b(s)) if it is an edge s x of the tree, and log b(s) if it is a context s of it with
a word after it, where b(s) = (o(s) + mu) / (n(s) + mu) is what s leaves to its suffix. So one table of numbers by
run is all that scoring needs.

A run's key is the hash of two keys: of the run without its last word, and without its first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sluice.llm.runtime import crc_of_key, documents, staged

#: No word has a line break, so this is no word's hash.
END = xxhash.xxh3_64_intdigest(b"\n")
#: A run of words seen once says nothing that its suffix doesn't.
EDGE_LEAST = 2
#: The multipliers of 64-bit xxHash, and the seed that Spark's xxhash64 takes.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)


@dataclass
class Tree:
    """The head of the tree, and the table that has the rest of it."""

    total: int  # N
    types: int  # V
    head_count: float  # words with as many are in the head
    edge_count: float  # and runs of more words with as many
    depth: int
    slices: int
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0))
    leaves: np.ndarray = field(default_factory=lambda: np.empty(0))  # log10 b of the words as contexts
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    adds: np.ndarray = field(default_factory=lambda: np.empty(0))
    rest: np.ndarray | None = None  # bits of the keys of runs that only the table has
    table: DataFrame | None = None  # slice, key, word (or run), v: what a word adds to both scores, a run to one

    @property
    def bottom(self) -> float:
        return self.total + 0.1 * (self.types + 1)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """staged(); the shuffle files go when the table is written, not when the driver collects garbage, and joins whose
    partitions are all small, which is known when they are there, hash them instead of sorting both sides. Almost every
    key of the aggregations is new to its task, so a small table before the large one would only be in the way."""
    conf = df.sparkSession.conf
    options = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB", "spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}
    before = {k: conf.get(k) for k in options}
    for k, v in options.items():
        conf.set(k, v)
    try:
        return staged(df, name, by)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def removed(table: DataFrame) -> None:
    """Deletes what written() wrote for this table."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """xxhash64(a, b) of Spark, of arrays of 64-bit numbers."""
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = _SEED
    with np.errstate(over="ignore"):
        for x in (a.view(np.uint64), b.view(np.uint64)):
            h = (h + _P5 + np.uint64(8)) ^ (turned(x * _P2, 31) * _P1)
            h = turned(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def bits_of(keys: DataFrame, bits: int = 28) -> np.ndarray:
    """A bit for each value of the first `bits` bits of a key; so many at any number of rows."""
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")
    got = keys.groupBy(F.shiftrightunsigned("key", 70 - bits).alias("i")).agg(F.bit_or(one).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("i").to_numpy()] = got.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that bits_of did not get."""
    at = keys.view(np.uint64) >> np.uint64(64 - (len(bits) << 6).bit_length() + 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def grouped(batches: Iterator[pa.RecordBatch], column: int, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches, and their texts, of about so many bytes."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, side="right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, which of them each token has, the texts' token counts); tokens of all texts one after the
    other, ends included. Words are split and told apart by Arrow: its ASCII functions know A-Z and [\\x20\\x09-\\x0D]."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    hashes = np.append(hashes, np.uint64(END)).view(np.int64)
    which = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    blank = pc.index(coded.dictionary, "").as_py()  # before or after white space at a text's end
    real = which != blank
    which, doc = which[real], doc[real]
    lengths = np.bincount(doc, minlength=len(texts)) + 1
    out = np.full(int(lengths.sum()), len(hashes) - 1, np.int64)
    out[np.arange(len(which)) + doc] = which
    return hashes, out, lengths


def runs(h: np.ndarray, lengths: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from 1 to depth: (level, s, x, key, place of the last word) of the texts' runs of level + 1
    words, s the key of the run without its last word, x without its first."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = h  # of the run that ends at each place, where there is one
    for level in range(1, depth + 1):
        at = np.flatnonzero(place >= level)
        s, x = keys[at - 1], keys[at]
        key = paired(s, x)
        yield level, s, x, key, at
        keys = np.zeros(len(h), np.int64)
        keys[at] = key


def run_counts(train: DataFrame, level: int, below: np.ndarray | None = None) -> DataFrame:
    """(s, x, c) of the runs of level + 1 words seen EDGE_LEAST times or more; at level 1 also (null, x, c) of all
    words. Tasks count first. below: bits of the runs of one word less that are as frequent, as both parts must be."""
    shared = train.sparkSession.sparkContext.broadcast(below)
    schema = pa.schema([("s", pa.int64()), ("x", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for _, texts in grouped(batches, 0):
            distinct, which, lengths = token_hashes(texts)
            if level == 1:
                n = np.bincount(which, minlength=len(distinct))
                on = n > 0
                yield pa.RecordBatch.from_arrays([pa.nulls(int(on.sum()), pa.int64()), pa.array(distinct[on]), pa.array(n[on])], schema=schema)
            for at, s, x, key, _ in runs(distinct[which], lengths, level):
                if at == level:
                    if known is not None:
                        on = may_have(known, s) & may_have(known, x)
                        s, x, key = s[on], x[on], key[on]
                    order = np.argsort(key)
                    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else order
                    n = np.diff(np.append(first, len(key)))
                    yield pa.RecordBatch.from_arrays([pa.array(s[order[first]]), pa.array(x[order[first]]), pa.array(n.astype(np.int64))], schema=schema)

    counted = train.mapInArrow(count, "s long, x long, c long").groupBy("s", "x").agg(F.sum("c").alias("c"))
    return counted.where(F.col("s").isNull() | (F.col("c") >= EDGE_LEAST))


def grown(edges: DataFrame, lower: DataFrame, total: int, mu: float, name: str, last: bool) -> tuple[DataFrame, DataFrame]:
    """The contexts (s, n, b) that stay, and the level's runs: key, c, add where the context is one that stays, and,
    unless it is the last level, p, their last word's probability after the others. Deletes edges' table.

    lower: (key, c, p) of the runs that are one word shorter."""
    e = written(edges.join(lower.select(F.col("key").alias("x"), F.col("p").alias("q")), "x"), f"suffixes-{name}")
    removed(edges)
    sums = e.groupBy("s").agg(F.sum("c").alias("inside"), F.count("*").alias("df"), F.sum(F.col("c") * F.log(F.col("c") / F.col("q"))).alias("gain"), F.sum("q").alias("covered"))
    at = sums.join(lower.select(F.col("key").alias("s"), F.col("c").alias("n")), "s").withColumn("o", F.col("n") - F.col("inside"))
    other = F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / F.col("n") / F.greatest(1 - F.col("covered"), F.lit(1e-12)))).otherwise(0.0)
    gain = F.col("gain") - F.col("inside") * F.log("n") + other
    stay = at.where(gain > 0.5 * F.col("df") * float(np.log(max(total, 2)))).select("s", "n", ((F.col("o") + mu) / (F.col("n") + mu)).alias("b"))
    stay = written(stay, f"contexts-{name}")
    # (o + mu) / (n + mu) = b
    p = F.coalesce(F.col("c") / (F.col("n") + mu) + F.col("b") * F.col("q"), F.col("q"))
    rows = e.join(stay, "s", "left").select(F.xxhash64("s", "x").alias("key"), "c", p.alias("p"), F.log10(p / F.col("q") / F.col("b")).alias("add"))
    rows = written(rows.where("add is not null").drop("p") if last else rows, f"runs-{name}")
    removed(e)
    return stay, rows


def columns(rows: DataFrame, *names: str) -> list[np.ndarray]:
    got = rows.select(*names).toArrow()
    return [got.column(k).to_numpy() for k in names]


def added(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, c, add) of the contexts of two words or more and of the runs that are edges, of all levels."""
    parts = []
    for k, (stay, edges) in enumerate(levels):
        if k:
            parts.append(stay.select(F.col("s").alias("key"), F.col("n").alias("c"), F.log10("b").alias("add")))
        parts.append(edges.where("add is not null").select("key", "c", "add"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def learn(docs: DataFrame, *, depth: int = 2, head_share: float = 2.5e-7, edge_share: float = 1e-7, mu: float = 5.0, slices: int = 8, text: str = "text") -> Tree:
    """The tree of contexts of up to `depth` words. The shares bound the head only: 1 / head_share words, and as many
    runs of each length as 1 / edge_share. What documents score does not depend on them. Null and empty texts are an
    end token each; repeated rows count as often as they are there; of an empty table comes a tree without words.

    Tables of a step are deleted when the next one's are written; the last one is partitioned by `slices` of keys."""
    train = docs.select(text)
    counts = written(run_counts(train, 1), "counts")
    words = written(counts.where("s is null").select(F.col("x").alias("key"), "c"), "words")
    total, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tree = Tree(total, types, max(1.0, head_share * total), max(float(EDGE_LEAST), edge_share * total), depth, slices)
    lower = words.withColumn("p", (F.col("c") + 0.1) / F.lit(tree.bottom))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for level in range(1, depth + 1):
        if level > 1:
            counts = written(run_counts(train, level, bits_of(lower)), f"counts-{level}")
        levels.append(grown(counts.where("s is not null"), lower, total, mu, str(level), level == depth))
        lower = levels[-1][1]
    key, c = columns(words.where(F.col("c") >= tree.head_count), "key", "c")
    tree.hashes, tree.counts, tree.leaves = key.astype(np.int64), c.astype(float), np.zeros(len(key))
    leaves = levels[0][0].select(F.col("s").alias("key"), F.col("n").alias("c"), F.log10("b").alias("add"))
    key, add = columns(leaves.where(F.col("c") >= tree.head_count), "key", "add")
    tree.leaves[pd.Index(tree.hashes).get_indexer(key.astype(np.int64))] = add
    runs_ = added(levels)
    key, add = columns(runs_.where(F.col("c") >= tree.edge_count).groupBy("key").agg(F.sum("add").alias("add")), "key", "add")
    tree.keys, tree.adds = key.astype(np.int64), add.astype(float)
    if tree.edge_count > EDGE_LEAST:
        tree.rest = bits_of(runs_.where(F.col("c") < tree.edge_count))
    base = F.log10((F.col("c") + 0.1) / 0.1)
    parts = [(words.where(F.col("c") < tree.head_count), True, base), (leaves.where(F.col("c") < tree.head_count), False, F.col("add")), (runs_.where(F.col("c") < tree.edge_count), False, F.col("add"))]
    rest = None
    for rows, word, v in parts:
        rows = rows.select(F.pmod("key", F.lit(slices)).cast("int").alias("slice"), "key", F.lit(word).alias("word"), v.alias("v"))
        rest = rows if rest is None else rest.unionByName(rows)
    tree.table = written(rest, "tree", "slice")
    for table in (words, *(t for pair in levels for t in pair)):
        removed(table)
    return tree


class Head:
    """What of the tree is broadcast; the indexes over it are built once in each worker process."""

    def __init__(self, tree: Tree):
        self.bottom, self.depth, self.rest = tree.bottom, tree.depth, tree.rest
        self.hashes, self.counts, self.leaves, self.keys, self.adds = tree.hashes, tree.counts, tree.leaves, tree.keys, tree.adds

    def indexes(self) -> tuple[pd.Index, pd.Index]:
        if "_indexes" not in self.__dict__:
            self._indexes = pd.Index(self.hashes), pd.Index(self.keys)
        return self._indexes


def head_scores(docs: DataFrame, tree: Tree, *, key: str, text: str) -> DataFrame:
    """Per row what the broadcast head can say, and `tail0` to `tail{slices - 1}`: the keys of the runs it doesn't
    list, once for each time they are there, by the key's rest by `slices`. Its words count as unknown until they
    meet the table."""
    shared, slices = docs.sparkSession.sparkContext.broadcast(Head(tree)), tree.slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head = shared.value
        of_word, of_run = head.indexes()
        row = TaskContext.get().partitionId() << 36
        for batch, texts in grouped(batches, 1, 1_000_000):
            distinct, which, lengths = token_hashes(texts)
            h = distinct[which]
            doc = np.repeat(np.arange(len(texts)), lengths)
            at = of_word.get_indexer(distinct)
            known = at >= 0
            base = np.full(len(distinct), np.log10(0.1 / head.bottom))
            base[known] = np.log10((head.counts[at[known]] + 0.1) / head.bottom)
            leaf = np.zeros(len(distinct))
            leaf[known] = head.leaves[at[known]]
            known, base, more = known[which], base[which], leaf[which]
            # nothing follows a text's end, so as a context it adds nothing; its leaf is 0
            rare, rare_doc = [h[~known]], [doc[~known]]
            for _, _, _, keys, last in runs(h, lengths, head.depth):
                at = of_run.get_indexer(keys)
                on = at >= 0
                more[last[on]] += head.adds[at[on]]
                if head.rest is not None:
                    on = np.flatnonzero(~on)
                    on = on[may_have(head.rest, keys[on])]
                    rare.append(keys[on])
                    rare_doc.append(doc[last[on]])
            rare, rare_doc = np.concatenate(rare), np.concatenate(rare_doc)
            place = (rare % slices) * len(texts) + rare_doc
            order = np.argsort(place)
            rare, place = pa.array(rare[order]), place[order]
            tails = []
            for k in range(slices):
                bounds = np.searchsorted(place, np.arange(k * len(texts), (k + 1) * len(texts) + 1))
                tails.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rare))
            sums = lambda x: np.bincount(doc, x, len(texts))  # noqa: E731, B023
            out = [batch.column(0), pa.array(row + np.arange(len(texts)), pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(sums(known.astype(float)).astype(np.int64)), pa.array(sums(base)), pa.array(sums(base + more)), *tails]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(out, names=["_key", "_row", "n_tokens", "n_known", "base_score", "score", *(f"tail{k}" for k in range(slices))])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text))
    return rows.mapInArrow(run, "_key long, _row long, n_tokens long, n_known long, base_score double, score double, " + ", ".join(f"tail{k} array<long>" for k in range(slices)))


def score_documents(docs: DataFrame, tree: Tree, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score, score for every row of docs, over whole texts of any length. A null or
    empty text is the end token only. Every row has a score of its own, also where keys repeat or are null; an empty
    table gives no rows; other columns aren't read.

    Runs that the head doesn't list are written beside the row once, and meet the tables slice by slice, so that only
    a slice of them is shuffled at a time."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer column")
    part = written(head_scores(docs, tree, key=key, text=text), "scores")
    met = None
    word = F.col("word")
    sums = [F.sum(word.cast("int")).alias("_known"), F.sum(F.when(word, F.col("v")).otherwise(0.0)).alias("_base"), F.sum("v").alias("_score")]
    for k in range(tree.slices):
        tail = part.select("_row", F.explode(f"tail{k}").alias("key"))
        got = tail.join(tree.table.where(F.col("slice") == k).drop("slice"), "key").groupBy("_row").agg(*sums)
        got = written(got, f"tail{k}")
        met = got if met is None else met.unionByName(got)
    more = ("_known", "_base", "_score")
    out = part.select("_key", "_row", "n_tokens", "n_known", "base_score", "score").join(met.groupBy("_row").agg(*(F.sum(x).alias(x) for x in more)), "_row", "left")
    known, base, score = F.coalesce("_known", F.lit(0)), F.coalesce("_base", F.lit(0.0)), F.coalesce("_score", F.lit(0.0))
    return out.select(F.col("_key").alias(key), "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base_score") + base).alias("base_score"), (F.col("score") + score).alias("score"))


def op8_lm_scores(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    tree = learn(docs.where(crc_of_key(F.col("doc_id")) % 10 != 0))
    scored = score_documents(docs, tree)
    held = crc_of_key(F.col("doc_id")) % 10 == 0
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
