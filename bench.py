"""Headline queries on a data folder; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm up and once timed, writing to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "a01_fold": "a01_fold_web", "j01_classify": "j01_classify_domains", "w1_windows": "w1_windows",
    "a03_profiles": "a03_profiles", "j13_baseline": "j13_baseline_asof", "d02_trigger": "d02_trigger",
    "d11_verdicts": "d11_verdicts", "a13_efficiency": "a13_efficiency", "a15_who_visited": "a15_who_visited_folded",
    "d03_archive_then_send": "d03_archive_then_send", "l01_alerts": "l01_alerts", "d17_risk_board": "d17_risk_board",
    "s10_agent_messages": "s10_agent_messages",
}


def main() -> None:
    from tidewatch.catalog import load
    from tidewatch.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("tidewatch-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    wanted = os.environ.get("BENCH_ONLY", "")
    times = {}
    for label, name in HEADLINE.items():
        if wanted and label not in wanted.split(","):
            continue
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - start
        times[label] = round(elapsed, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
