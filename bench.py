"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every output row is produced (written to the no-op sink); nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from featherfold.catalog import QUERIES
from featherfold.session import build_session

HEADLINE = [
    "flagship_customer_features", "g1_spec_aggregate", "g4_filtered_by_flag", "g7_loan_history_window", "g9_group_statistics",
    "g_bureau_features", "g_previous_features", "g_instalment_features", "g_cash_features", "g_card_features",
    "g9_application_features", "e3_relationship_roll_up", "e4_whole_feature_build",
    "a8_null_ratios", "a13_describe", "b9_outlier_report", "w2_latest_row_per_key", "w3_last_rows_mean", "w6_same_group_number",
    "j1_features_to_parent", "f1_label_correlation", "f4_distance_correlation", "f5_anova_f", "m5_auc", "m8_fold_metrics",
    "m12_neighbour_share", "m14_blend_weight_search", "g15_class_density",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    names = [n for n in (only.split(",") if only else HEADLINE)]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
