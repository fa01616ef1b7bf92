"""Headline benchmark: prints one JSON line with per-query seconds.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion with a no-op sink (every row and column is
produced, nothing is collected to the driver).  ``queries`` holds the first
(cold) run of each plan and is what ``value`` sums; ``warm`` holds a second
run of the same plan, which no longer pays for code generation and Python
worker start-up -- the part that dominates at small scale factors.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagequality.plans import queries as Q  # noqa: E402
from pagequality.session import local_session  # noqa: E402

HEADLINE = {
    "page_score": Q.q_page_score,
    "document_score": Q.q_document_score,
    "search_results": Q.q_search_results,
    "near_duplicates": Q.q_near_duplicates,
    "digest_parts": Q.q_digest_parts,
    "session_stats": Q.q_session_stats,
    "vector_relevance": Q.q_vector_relevance,
    "lexical_relevance": Q.q_lexical_relevance,
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="pagequality-bench")
    times, warm = {}, {}
    for name, fn in HEADLINE.items():
        for bucket in (times, warm):
            t0 = time.time()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            bucket[name] = round(time.time() - t0, 3)
            spark.catalog.clearCache()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "warm": warm,
                      "warm_total": round(sum(warm.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
