"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; the median of up to three runs, for about eight seconds, each; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidemark.plans import load  # noqa: F401
from tidemark.plans import registry

HEADLINE = [
    "minimum_slice", "w09_rank_avg", "w15_winsorize", "a14_sector_rollup", "j02_asof_backward", "j05_range_join", "j10_diff_builds", "v05_fold_consecutive", "g20_evaluate_graph",
    "d05_universe_daily", "d09_price_adj_forward", "d24_fin_latest", "m01_price_indicators", "m06_score_rank_model", "b04_cap_weights", "e02_rank_ic", "e07_performance", "r08_breadth", "t01_bollinger",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    registry.QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # compiles, warms up
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < 3 and sum(runs) < 8:
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
