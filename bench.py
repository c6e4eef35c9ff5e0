"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from newsquant.plans.catalog import QUERIES
from newsquant.session import build_session

HEADLINE = [
    "clean_events", "slot_stats", "nearest_centroid", "day_summary", "joined_features", "impact_cells_h3",
    "co_actors", "five_number_events", "sample_equal", "sample_prop", "bootstrap", "kmedoid_assign", "medoid_step",
    "rolling_means", "price_moves", "kelly_sweep", "phrase_scores", "ols_r2", "url_domains", "latest_by_key",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rolling_means"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up, not timed
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
