"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores. Every query is run to its last row
into the no-op sink, once to warm up and then `RUNS` times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from maskwright.plans.catalog import QUERIES
from maskwright.session import build_session

HEADLINE = [
    "sanitize_documents",
    "find_email",
    "find_phone",
    "find_api_key",
    "find_jwt",
    "resolve_first_longest",
    "resolve_prefer",
    "mappings",
    "restore_text",
    "sanitize_conversations",
    "sanitize_body",
    "hybrid_detect",
    "sanitize_json",
    "encode_corpus",
    "policy_rules_table",
    "restore_chunks",
    "restore_stream",
    "sanitize_stream",
    "words",
    "wordpiece",
    "policy",
    "audit_read",
    "stats_by_type",
    "stats_top_domains",
    "stats_latency",
    "stats_snapshot",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        app_name="bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    best: dict[str, float] = {}
    for name in names:
        for run in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run:
                best[name] = min(took, best.get(name, took))
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    n, size = documents.selectExpr("count(*)", "sum(octet_length(text))").first()
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    spark.stop()
    result = {
        "metric": "headline queries, total",
        "value": round(sum(best.values()), 3),
        "unit": "sec",
        "queries": {name: round(sec, 3) for name, sec in best.items()},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "sanitize_documents" in best:
        result["documents_per_sec"] = round(n / best["sanitize_documents"])
        result["mb_per_sec"] = round(size / 1e6 / best["sanitize_documents"], 2)
    if "stats_snapshot" in best:
        result["audit_rows_per_sec"] = round(events / best["stats_snapshot"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
