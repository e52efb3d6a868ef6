"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tapewise.operators import indicators as ind  # noqa: E402
from tapewise.plans import catalog  # noqa: E402
from tapewise.plans.tables import Tables  # noqa: E402
from tapewise.sources import fixtures  # noqa: E402

HEADLINE = [
    "indicators_all", "latest_signals", "features_sentiment", "dataset", "sentiment_windows", "upsert_prices",
    "describe_bars", "class_balance", "walkforward_windows", "roc_auc", "regime_performance", "risk_metrics",
    "threshold_sweep", "top_features", "template_explanation", "chunk_documents", "retrieve_topk", "build_context",
]
#: The dear ones, run once and not part of the headline total.
HEAVY = ["train_logistic", "walkforward_backtest", "per_ticker_models", "incremental_update", "qa_prompts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.codegen.cache.maxEntries", "2000")  # plans of many windows have more classes than the default
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def run(name: str, build, repeat: int = 2) -> None:
        best = float("inf")
        for _ in range(repeat):
            started = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        times[name] = round(best, 3)

    spark.range(10).selectExpr("sum(id)").collect()  # start the executor threads
    # From the raw tables, nothing written before: trades -> bars, trades -> bars -> all indicators.
    run("raw_to_bars", lambda: fixtures.bars(spark, sf_dir))
    run("raw_to_indicators", lambda: ind.indicators_all(fixtures.bars(spark, sf_dir)))
    # One write of every shared table; the queries below read them.
    started = time.perf_counter()
    tables = Tables(spark, sf_dir)
    for name in ("bars", "indicators", "dataset", "sentiment"):
        getattr(tables, name)()
    times["stage_tables"] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        run(name, lambda: catalog.QUERIES[name](spark, sf_dir))
    total = round(sum(times.values()), 3)
    for name in HEAVY:
        run(name, lambda: catalog.QUERIES[name](spark, sf_dir), repeat=1)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
