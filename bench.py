"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores. A query
runs twice and the second time counts, so that class loading and code compilation do not;
planning, the small jobs a search starts while planning, and the full result are timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import recipes  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "parse_messages_core",
    "parse_headers_long",
    "mail_csv_read",
    "emails_row_id",
    "search_tables_build",
    "body_tokens",
    "postings",
    "term_stats",
    "vector_table",
    "hash_embedding",
    "token_ids",
    "model_embed_batch",
    "mean_pool",
    "quantise_int8",
    "knn_exact",
    "knn_ivf",
    "knn_int8",
    "bm25_any",
    "keyword_search",
    "match_all",
    "match_phrase",
    "match_fuzzy",
    "match_prefix",
    "rrf_fuse",
    "semantic_only",
    "keyword_only",
    "hybrid_search",
    "hit_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mailrank-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    recipes.search_tables(spark, sf_dir)
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
