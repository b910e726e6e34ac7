"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and once for the time; results go to Spark's noop sink. `throughput` is decoded
MiB per second of the block-parallel read of .xz files and of the checksums, to set beside codec figures.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = ("q_crc32_docs", "q_crc64_docs", "q_sha256_docs", "q_crc64_combine", "q_xz_roundtrip", "q_lzma_roundtrip", "q_block_parallel_encode", "q_xz_blocks", "q_prefix_offsets", "q_index_verify", "q_runs_stored", "q_gaps_islands", "q_first_error_prefix", "q_filter_chain", "q_bcj2_roundtrip", "q_xz_files", "q_xz_datasource")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sluice import queries
    from sluice.functions import columns as C
    from sluice.plans.decode import read_xz

    times = {}
    try:
        for name in HEADLINE:
            for again in (False, True):
                began = time.perf_counter()
                queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
                if again:
                    times[name] = round(time.perf_counter() - began, 3)
        # the read alone, over larger files than the query's
        path = f"{shared}/large"
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("data"))
        big = docs.crossJoin(spark.range(8)).repartition(int(cpus)).select("data").persist()
        mib = big.agg(F.sum(F.octet_length("data"))).first()[0] / 2**20
        big.write.format("xz").option("preset", 1).option("blockSize", 4 << 20).mode("append").save(path)
        rates = {}
        runs = {
            "decode": lambda: read_xz(spark, path).select(F.octet_length("data")),
            "crc32": lambda: big.select(C.crc32(F.col("data"))),
            "crc64": lambda: big.select(C.crc64_hex(F.col("data"))),
            "delta": lambda: big.select(F.octet_length(C.delta_encode(F.col("data"), 4))),
            "arm64": lambda: big.select(F.octet_length(C.bcj_encode(F.col("data"), "Arm64"))),
        }
        for name, run in runs.items():
            run().write.format("noop").mode("overwrite").save()
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            rates[f"{name}_mib_s"] = round(mib / (time.perf_counter() - began), 1)
    finally:
        spark.stop()
        shutil.rmtree(shared, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "throughput": rates, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
