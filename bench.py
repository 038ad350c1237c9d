"""Run the headline queries and print one JSON line with their times in seconds."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketgrade.plans.catalog import QUERIES  # noqa: E402
from marketgrade.session import build_session  # noqa: E402

HEADLINE = [
    "source_trade_messages",
    "ascending_trades",
    "feature_rows",
    "feature_rows_by_user",
    "momentum_forecasts",
    "sentiment_asof",
    "verdict_runs",
    "ensemble_forecasts",
    "strategy_union",
    "scored_outcomes",
    "backtest_accuracy",
    "standings",
    "rolling_accuracy",
    "degradation_alerts",
    "standings_snapshots",
    "lake_round_trip",
    "training_labels",
    "pooled_folds",
    "cleaned_bars",
    "rolling_indicators",
    "recursive_indicators",
    "message_counts",
    "articles_by_title",
    "top_markets",
    "page_text",
    "last_json",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__sql__adaptive__coalescePartitions__minPartitionSize="256k",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy().count().collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
