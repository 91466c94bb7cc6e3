"""Headline queries at one scale: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS the local cores.
Every query is run to the end into a sink that keeps nothing; the second of two
runs is reported, so one-off code generation does not count.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeworks.entries import QUERIES  # noqa: E402
from gaugeworks.session import local_session  # noqa: E402

HEADLINE = (
    "unit_normalization",
    "activity_extract",
    "stage_compound",
    "fact_star",
    "exclusion_reason",
    "curated_mart",
    "target_activity_summary",
    "compound_profile",
    "assay_quality",
    "dq_summary",
    "edge_mart",
    "jaccard_similarity",
    "promiscuous_topk",
    "token_postings",
    "evidence_search",
    "bm25_topk",
    "knn_cosine",
    "embed_documents",
    "governed_sql",
    "sql_log_audit",
)


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(timed(spark, name, sf_dir), 3)
    total = round(sum(seconds.values()), 3)
    line = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
