"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A record is: payload length (8 bytes, little-endian), masked CRC-32 of those 8 bytes (4), payload, masked
CRC-32 of the payload (4), newline (1). A payload is: id of the document (8, signed), bytes per token id (1),
the token ids. Files are in ascending id order, by the numbers in their names and within. Spark's own text writer puts the raw
bytes down, so its commit protocol holds and any store it can write to will do.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.runtime import documents, shared_dir

NO_ID = -(2**63)
_MASK = 0xA282EAD8


def masked(data) -> bytes:
    crc = zlib.crc32(data)
    return ((((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF).to_bytes(4, "little")


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head), payload, masked(payload), b"\n"))


def record_at(data: memoryview, at: int) -> tuple[int, memoryview, int]:
    """(document id, token-id bytes with their width first, end) of the record at `at`; ValueError if damaged."""
    head = data[at : at + 8]
    if len(head) < 8 or data[at + 8 : at + 12] != masked(head):
        raise ValueError(f"bad record length at {at}")
    end = at + 12 + int.from_bytes(head, "little")
    payload = data[at + 12 : end]
    if data[end : end + 4] != masked(payload) or data[end + 4 : end + 5] != b"\n":
        raise ValueError(f"bad record at {at}")
    return int.from_bytes(payload[:8], "little", signed=True), payload[8:], end + 5


def token_ids(part: memoryview) -> np.ndarray:
    return np.frombuffer(part[1:], {2: "<u2", 4: "<u4"}[part[0]])


#: Where a text can be cut without a change to its ids: at a space or line break between two characters that aren't
#: white space. What the pattern of byte-level tokenizers takes for one pre-token never spans such a place.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_MARK = "\x1f"
#: Texts with white space elsewhere, or with the mark; \s of the tokenizers is within [\t-\r\x1c-\x20\x85\p{Z}].
_UNEVEN = r"[ \n][\t-\r\x1c-\x20\x85\p{Z}]|[\t-\r\x1c-\x20\x85\p{Z}][ \n]|^[ \n]|[\t-\r\x1c-\x20\x85\p{Z}]$|\x1f"
#: Punctuation after a letter or digit, up to where a cut is, is a pre-token.
_TAIL = r"([\p{L}0-9])([!-/:-@\[-`{-~]+)(\x1f|$)"


class ByteBpe:
    """Encodes with a tokenizer file of the tokenizers library, with its settings as they are. Texts are cut into
    pieces, and what the pieces consist of is encoded once and remembered: the `most` / 2 newest parts, and as many
    of before."""

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        #: the library looks for these before all else
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        alone = self.tok.encode("\n", add_special_tokens=False).ids
        self.newline = alone[0] if len(alone) == 1 else None
        self.most = most
        self.recent: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_library(self, words: list[str]) -> list[bytes]:
        """Ids of the words. Those that neither have a line break nor end in white space go in one text, a line each:
        a line break before a word or a space is a pre-token, and here a token, of its own."""
        if self.newline is None:
            return self._encode(words)
        lined = [w for w in words if w and "\n" not in w and not w[-1].isspace() and not w[:2].isspace()]
        found: dict[str, bytes] = {}
        if lined:
            ids = np.array(self.tok.encode_batch_fast(["\n".join([*lined, ""])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.newline) * self.width
            raw = ids.tobytes()
            found = dict(zip(lined, [raw[a:b] for a, b in zip([0, *(ends[:-1] + self.width).tolist()], ends.tolist(), strict=True)], strict=True))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._encode(rest), strict=True))
        return [found[w] for w in words]

    def parts(self, wanted: list[str]) -> list[bytes]:
        """Ids of the parts. What is found stays in a list of its own, so forgetting can't take it away meanwhile."""
        got = list(map(self.recent.get, wanted))
        missing = [k for k, ids in enumerate(got) if ids is None]
        for k in missing:
            got[k] = self.before.get(wanted[k])
        new = [k for k in missing if got[k] is None]
        for k, ids in zip(new, self._by_library([wanted[k] for k in new]), strict=True):
            got[k] = ids
        self.recent.update((wanted[k], got[k]) for k in missing)
        if len(self.recent) > self.most // 2:
            self.before, self.recent = self.recent, {}
        return got

    def _even(self, text: pa.Array) -> list[bytes]:
        """Ids of texts in which every space and line break is where a text can be cut."""
        text = pc.replace_substring(text, " ", _MARK + " ")
        text = pc.replace_substring(text, "\n", f"{_MARK}\n{_MARK}")
        text = pc.replace_substring_regex(text, _TAIL, f"\\1{_MARK}\\2\\3")
        split = pc.split_pattern(text, _MARK)
        coded = split.flatten().dictionary_encode()
        ids = pa.array(self.parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes, self.width a token. Texts that hold an added token's string go to the library
        whole; so do, cut where they can be, those with other white space than single spaces and line breaks."""
        text = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(text, _UNEVEN).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        for x in self.special:
            whole |= pc.match_substring(text, x).to_numpy(zero_copy_only=False)
        out = np.empty(len(texts), object)
        even = np.flatnonzero(~uneven & ~whole)
        if len(even):
            out[even] = self._even(text.take(pa.array(even)))
        cut = {k: _CUT.split(texts[k]) for k in np.flatnonzero(uneven & ~whole).tolist()}
        distinct = list({u for c in cut.values() for u in c})
        known = dict(zip(distinct, self.parts(distinct), strict=True))
        for k, c in cut.items():
            out[k] = b"".join([known[u] for u in c])
        at = np.flatnonzero(whole).tolist()
        for k, ids in zip(at, self._encode([texts[k] for k in at]), strict=True):
            out[k] = ids
        return out.tolist()


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBpe:
    """One encoder per worker process: what it remembers serves all of the process's tasks."""
    return ByteBpe(path)


#: Characters that are encoded at once.
GROUP = 4_000_000


def groups(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) in groups of about so many characters; null is empty."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        n += len(held[-1])
        if n >= chars:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, files: int | None = None, most_records: int = 50_000, key: str = "doc_id", text: str = "text") -> None:
    """Writes docs' token ids to record files under path, in ascending order of the ids (null first; rows that
    share an id by a hash of their texts, equal rows side by side). Null and empty texts are a record with the end id
    only, a text of any length is one record; an empty table is a folder without records. Only key and text are read,
    under names of this function's own, so other columns don't matter.

    Texts are range-partitioned once, into `files` tasks (twice the input's partitions, if none are named), by id and
    hash, so rows that share an id are dealt over several; a task begins a new file after most_records, so that its
    equal rows, however many, make files of a size that can be read."""
    files = files or max(1, 2 * docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        width, end = bytes([bpe.width]), end_id.to_bytes(bpe.width, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, group in groups(texts, GROUP):
                out = [frame(b"".join((k.to_bytes(8, "little", signed=True), width, e, end))) for k, e in zip(ids[at : at + len(group)], bpe.encode(group), strict=True)]
                # the record's own newline is the writer's line end
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], names=["value"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text).alias("_t"))
    rows = rows.withColumn("_h", F.xxhash64("_t")).repartitionByRange(files, "_id", "_h").sortWithinPartitions("_id", "_h", "_t")
    out = rows.select("_id", "_t").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", most_records).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, doc_id, offset and length in the file (bytes), n_tokens, ids_crc32, start (ids of
    all records before it in the file). This is the offset index, too: a reader takes (file, offset, length)
    in any order. A damaged record is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data, at, start, rows = memoryview(content.as_buffer()).cast("B"), 0, 0, []
                file = name.as_py().rsplit("/", 1)[-1]
                while at < len(data):
                    doc, part, end = record_at(data, at)
                    ids = token_ids(part)
                    rows.append((None if doc == NO_ID else doc, at, end - at, len(ids), zlib.crc32(ids.astype("<u4")), start))
                    start, at = start + len(ids), end
                for k in range(0, len(rows), 10_000):
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(columns[0])), *columns], names=["file", "doc_id", "offset", "length", "n_tokens", "ids_crc32", "start"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, doc_id long, offset long, length long, n_tokens long, ids_crc32 long, start long")


def file_order(file: Column) -> Column:
    """Numbers of a file's task and of the file among the task's: names of many files don't sort as their numbers do."""
    number = lambda pattern: F.regexp_extract(file, pattern, 1).try_cast("long")
    return F.struct(number(r"^part-(\d+)").alias("task"), F.coalesce(number(r"-c(\d+)[^-]*$"), F.lit(0)).alias("file"))


def with_starts(index: DataFrame) -> DataFrame:
    """The index with `start` counted over all files; only a row per file goes through the one-task running sum."""
    before = Window.orderBy(file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return index.join(totals, "file").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Writes the offset index beside the files and reads it again, `start` counted over all files."""
    read_token_files(spark, path).write.parquet(index)
    return with_starts(spark.read.parquet(index))


def read_record(path: str, offset: int, length: int) -> tuple[int, np.ndarray]:
    """One record of a local file by its index entry."""
    with open(path, "rb") as f:
        f.seek(offset)
        doc, part, _ = record_at(memoryview(f.read(length)), 0)
    return doc, token_ids(part)


def op6_token_files(spark, sf_dir):
    import public_tokenizers

    base = f"{shared_dir(spark)}/sluice-tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir).select("doc_id", "text"), f"{base}/records", public_tokenizers.path("byte_bpe_50k.json"))
    return write_index(spark, f"{base}/records", f"{base}/index").select("doc_id", "start", "n_tokens", "ids_crc32")
