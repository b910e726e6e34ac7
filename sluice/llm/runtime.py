"""What the operators share: staging in the cluster's shared folder, words, ASCII folding, stable hashes."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of `[\x20\x09-\x0D]`; `bytes.split()` splits at exactly these.
WS = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary one is set, if the master is this machine;
    on a cluster that is an error, since executors don't share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors.
    by: a column that the files are partitioned by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: Iterable[str], name: str) -> str:
    """A column name that none of `columns` has, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(WS))


def words(text: Column) -> Column:
    """Array of `[^\\x20\\x09-\\x0D]+`; null and blank texts have none."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_SPLIT))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed. lower() does the same, and faster, unless there are
    other upper-case letters."""
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered; emptied when it holds `most` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def given_back() -> None:
    """Hands memory that is free, but held by Arrow's pool or the C library's heap, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


class WhileUsed:
    """What `make` makes of its arguments, one thing at a time, for as long as tasks of this process use it and `seconds`
    beyond, so that a stage's tasks share it. Worker processes outlive a stage, and what idle ones hold counts beside
    the next one's."""

    def __init__(self, make: Callable, seconds: float = 1.0):
        self.make, self.seconds = make, seconds
        self.lock, self.users, self.found = threading.Lock(), 0, {}
        self.timer: threading.Timer | None = None

    @contextmanager
    def __call__(self, *args) -> Iterator:
        with self.lock:
            if self.timer is not None:
                self.timer.cancel()
            if args not in self.found:
                self.found = {args: self.make(*args)}
            got = self.found[args]
            self.users += 1
        try:
            yield got
        finally:
            del got
            with self.lock:
                self.users -= 1
                if not self.users:
                    self.timer = threading.Timer(self.seconds, self.forget)
                    self.timer.daemon = True
                    self.timer.start()

    def forget(self) -> None:
        with self.lock:
            if self.users:
                return
            self.found = {}
        given_back()


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered, as UTF-8. bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def key_crc(doc_id) -> int:
    """crc32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_of_key(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
