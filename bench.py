"""Time the headline queries; prints one JSON line. The warm-up run of each query is left out."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from packloom.operators.assembly import assemble_packs, pad_packs  # noqa: E402
from packloom.operators.packing import plan_packs  # noqa: E402
from packloom.plans import flows  # noqa: E402
from packloom.plans.queries import QUERIES  # noqa: E402
from packloom.workspace import ship_package  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Registered queries that compute digests for comparison are timed without them below.
NAMES = (
    "triplet_build",
    "tokenize_words",
    "vocab_build",
    "vocab_encode",
    "pack_assign_orders",
    "shuffle_order",
    "split_samples",
    "jsonl_positions",
    "resume_filter",
    "last_token_pool",
    "l2_normalize",
    "project_gelu",
    "infonce_loss",
    "infonce_metrics",
    "infonce_negative_sweep",
    "infonce_blocks",
    "mean_pool",
    "vector_stats",
    "jsonl_triplets",
    "slot_order_check",
    "row_outcomes",
    "resume_shuffled",
    "stream_pack",
    "stream_ingest",
)


def pack_chats(spark: SparkSession, folder: str) -> DataFrame:
    return flows.packed(flows.chat_samples(spark, folder), flows.CHAT)[0]


def pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    samples = flows.document_samples(spark, folder)
    return pad_packs(assemble_packs(samples, plan_packs(samples, flows.DOCS)), flows.DOCS)


def timed(query, spark: SparkSession) -> float:
    begin = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    queries = {name: QUERIES[name] for name in NAMES}
    queries |= {"pack_chats": pack_chats, "pack_documents": pack_documents}
    seconds = {}
    for name, query in queries.items():
        timed(query, spark)
        seconds[name] = round(timed(query, spark), 3)
    samples = flows.document_samples(spark, FOLDER)
    totals = samples.selectExpr("count(*) AS samples", "sum(n_tokens) AS tokens").first()
    rate = seconds["pack_documents"]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "pack_documents_samples_per_sec": round(totals["samples"] / rate, 1),
                "pack_documents_million_tokens_per_sec": round(totals["tokens"] / rate / 1e6, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
