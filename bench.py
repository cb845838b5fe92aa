"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pairsift.registry import QUERIES
from pairsift.session import local_session

HEADLINE = (
    "clean_text",
    "route_three_way",
    "stage_c",
    "dedup_keep_first",
    "langid_predict",
    "pct_rank_avg",
    "score_pairs",
    "curate",
    "score_systems",
    "qc_generations",
    "pad_batches",
    "teacher_confidence",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the Python workers and the JVM's compiler on the smallest query
    QUERIES["char_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
