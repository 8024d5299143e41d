"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["edge_collapse", "changed_functions", "signature_diff", "method_diffs", "direct_callers", "level_walk_reverse", "entrypoints", "data_surfaces",
            "now_depends_on", "classify_calls", "build_graph", "routes", "candidates", "supersede", "await_base_graph", "stream_dedupe"]


def main():
    from ripple.plans import registry
    from ripple.session import build_session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.log.level": "ERROR"})
    timings = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        registry.forget()
        start = time.time()
        registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
