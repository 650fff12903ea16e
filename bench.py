"""Times the headline match queries, the median of three runs each, and prints one JSON line. BENCH_SF_DIR: folder of tables;
BENCH_CPUS: cores."""

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from touchline.plans.catalog import QUERIES

HEADLINE = ["fair_probs", "rolling_form_5", "rolling_stats_diffs", "points_form", "last_k_sequence_rows", "strength_decayed_asof", "elo_day_frozen", "dixon_coles_outcome", "probability_quality", "bet_grouping_sets", "selector_grid", "xg_nearest_date", "matchday_block", "state_resumed"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fair_probs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "match queries, median of three runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
