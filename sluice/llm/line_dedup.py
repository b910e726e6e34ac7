"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.runtime import ascii_lower, documents, staged, trimmed, unused

NO_ID = -(2**63)


def line_keys(text: Column) -> Column:
    """Array of the keys of the text's lines: ends stripped, A-Z lowered."""
    return F.transform(F.split(ascii_lower(text), "\n"), trimmed)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, key: str = "doc_id", text: str = "text", counts: bool = True, most_common: int = 100_000) -> DataFrame:
    """docs with `text` deduplicated, and with counts `n_lines`, `n_dropped` (long), in place of columns of that name.

    A line whose key has `min_chars` code points and is in `min_docs` documents or more stays only in the
    smallest id that has it. Null texts count as empty; null ids as one document before all others. Rows of
    one id are one document: repeats of a line within it all stay or all go. Texts are whole, of any length and in any
    number of lines; an empty table stays empty. Other columns pass through, whatever their names.

    Only (hash, id, position) is shuffled. For counting, a task sums up its own rows of a hash first. In the join back,
    lines that are a most_common-th of all or more (so there are most_common at most) are broadcast, and their rows, met
    already, are dealt out evenly; the others' rows meet a written table. Texts move once, to meet the positions to drop.
    """
    t, i, of, drop = (unused(docs.columns, x) for x in ("text_of", "id_of", "hash_of", "drop_of"))
    rows = docs.withColumns({t: F.coalesce(F.col(text), F.lit("")), i: F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))}).withColumn(of, F.xxhash64(t))
    lines = (
        rows.select(F.col(i).alias("id"), F.col(of).alias("of"), F.posexplode(line_keys(F.col(t))).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select("id", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    counted = lines.groupBy("h1", "h2")
    if min_docs == 2:
        shared = counted.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first <> last")
    else:
        once = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
        shared = once.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.count("*").alias("in")).where(F.col("in") >= min_docs)
    shared = staged(shared.select("h1", "h2", "first", "n"), "lines")
    least = max(1000.0, (shared.agg(F.sum("n")).first()[0] or 0) / most_common)
    common = F.broadcast(shared.where(F.col("n") >= least).select("h1", "h2", F.col("first").alias("known")))  # most_common rows
    spread = lines.join(common, ["h1", "h2"], "left").withColumn("h1", F.when(F.col("known").isNull(), F.col("h1")).otherwise(F.xxhash64("id", "of", "pos")))
    rare = shared.where(F.col("n") < least).select("h1", "h2", "first")
    first = F.coalesce("known", "first")
    drops = spread.join(rare, ["h1", "h2"], "left").where(first.isNotNull() & (F.col("id") != first))
    drops = drops.groupBy("id", "of").agg(F.collect_set("pos").alias(drop)).select(F.col("id").alias(i), F.col("of").alias(of), drop)
    got = rows.join(drops, [i, of], "left")
    split = F.split(F.col(t), "\n")
    n = F.size(split)
    kept = F.transform(
        F.array(split), lambda line: F.transform(F.sort_array(F.array_except(F.sequence(F.lit(0), n - 1), F.col(drop))), lambda k: F.get(line, k))
    )[0]
    out = F.when(F.col(drop).isNull(), F.col(t)).otherwise(F.array_join(kept, "\n"))
    added = [n.cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    kept_columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return got.select(*[out.alias(c) if c == text else F.col(c) for c in kept_columns], *added)


def op10_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(range(len(s)), lambda i: {'pos': i, 'line': s[i + 1]})) AS u
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), d AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, (d.k IS NOT NULL AND l.doc_id <> d.first) AS gone FROM l LEFT JOIN d ON l.k = d.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
