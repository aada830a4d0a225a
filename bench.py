"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casegraph.session import build_session  # noqa: E402
from casegraph.workloads.queries import QUERIES  # noqa: E402

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark",
    "conversations",
]

HEADLINE = [
    "channel_counts",
    "access_log_lines",
    "normalized_processes",
    "normalized_files",
    "normalized_security",
    "web_row_rules",
    "process_row_rules",
    "file_row_rules",
    "html_rules",
    "web_brute_force",
    "web_recon_scan",
    "web_login_after_failures",
    "logon_brute_force",
    "mass_deletion",
    "script_blocks",
    "nearest_view",
    "contract_ranges",
    "lineage_ranges",
    "fused_components",
    "fused_findings",
    "identity_groups",
    "actor_summary",
    "host_rollup",
    "reassembled_requests",
    "longest_path_rank",
    "rule_contracts",
    "resolved_logons",
    "flattened_events",
    "fuzzy_passages",
]


def loaded(spark, sf_dir: str, parts: int) -> str:
    """The tables in as many files as the machine has task slots times two, as a cluster would hold them.

    The given tables are one file with one row group each, which one task reads; loading is not timed.
    """
    folder = tempfile.mkdtemp(prefix="casegraph-bench-")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            spark.read.parquet(path).repartition(parts).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "casegraph-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    tables = loaded(spark, sf_dir, 2 * int(cpus))
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "casegraph headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
