"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of cores. Each
query runs ``BENCH_RUNS`` times (2 by default) and the fastest run counts, so
that JVM warm-up is left out. ``transactions`` is the join that stores the
transaction table the other queries read.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from creditgrain.plans import catalog  # noqa: E402
from creditgrain.plans.training import fit_credit_model  # noqa: E402
from creditgrain.session import session, store  # noqa: E402
from creditgrain.sources import txns_from_lines  # noqa: E402

HEADLINE = (
    "account_features",
    "account_rfm",
    "rfm_summary_signed",
    "profile_describe",
    "profile_histogram",
    "profile_kde",
    "profile_box_stats",
    "profile_corr_matrix",
    "profile_value_counts",
    "standardize",
    "woe_fit",
    "woe_transform",
    "preprocess_all",
    "split_stratified",
    "oversample_minority",
    "roc_auc",
    "pr_auc",
    "classification_report",
    "score_report",
    "score_transactions",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            action()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    only = sys.argv[1:]
    timed("transactions", lambda: store(txns_from_lines(spark, directory)))
    txns = catalog.lines(spark, directory)
    for name in HEADLINE:
        if not only or name in only:
            timed(
                name,
                lambda: catalog.REGISTRY[name](spark, directory)
                .write.format("noop")
                .mode("overwrite")
                .save(),
            )
    if not only or "fit_logistic_regression" in only:
        timed("fit_logistic_regression", lambda: fit_credit_model(txns))
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
