"""Times the headline queries; prints one JSON line.

The log is derived from a table of one Parquet split, which a single task would scan while all others
wait. So the table is written anew in ``BENCH_SPLITS`` files before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spoor.contract.queries import QUERIES  # noqa: E402
from spoor.session import build_session  # noqa: E402

HEADLINES = ["parse_combined", "parse_iis", "tag_url", "find_signatures", "find_brute_force",
             "find_enum_404", "find_exfil_bytes", "find_traffic_spike", "all_findings", "sessionize",
             "session_rollup", "session_samples", "timeline", "attack_chains", "pivot_time",
             "phase_transition", "stats_summary", "top_urls", "top_ip_bytes", "traffic_histogram",
             "tokenize_clf", "profile_summary", "chk_non_chronological", "screen_ips",
             "reputation_to_refresh"]


def split_table(spark, sf_dir: str, splits: int) -> tuple[str, int]:
    """A folder whose ``events.parquet`` has the same rows in so many files, and their number."""
    folder = tempfile.mkdtemp(prefix="bench-")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.repartitionByRange(splits, "event_id").write.parquet(f"{folder}/events.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")       # one task per file
    return folder, rows.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    splits = int(os.environ.get("BENCH_SPLITS", "16"))
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    source, rows = split_table(spark, sf_dir, splits)
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, source).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
    print(json.dumps({"metric": f"headline queries over {splits} splits, median of repeats, summed",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "rows": rows, "rows_per_second_and_core": {q: round(rows / t / int(cpus)) for q, t in times.items()},
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
