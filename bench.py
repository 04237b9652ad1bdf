"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retentia.checks import QUERIES  # noqa: E402
from retentia.session import get_session  # noqa: E402

HEADLINE = [
    "q1_churn_target",
    "q2_labelled_transactions",
    "q4_cohort_transactions",
    "q5_consolidated_logs",
    "q6_logs_last_row",
    "q7_logs_2ndlast_row",
    "q8_logs_3rdlast_row",
    "q9_logs_lifetime_sums",
    "q10_logs_last_3_sums",
    "q10_activity_features",
    "q11_clean_members",
    "q12_encoded_members",
    "q13_wide_features",
    "q16_survival_table",
    "q16_survival_curves",
    "q17_churn_by_segment",
    "r2_undersample",
    "m3_nearest_neighbours",
    "v4_roc_auc",
    "v8_metric_report",
    "x4_feature_elimination",
    "m1_logistic_regression",
    "m4_random_forest",
    "q14_reduced_features",
    "q15_model_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "retentia-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the executors and the code generator; not counted.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
