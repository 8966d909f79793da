"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from loomframe.plans import registry

HEADLINE = (
    "s01_bars_from_trades", "s01_scan_bars", "c01_clean_ohlcv", "t01_cum_returns", "t05_realized_vol", "t06_parkinson_vol", "m02_kyle_lambda", "v02_vpin", "f02_fracdiff",
    "f02_fracdiff_long", "i04_bollinger", "i05_rolling_stats", "i06_entropy", "x01_normalise", "x09_supervised", "l02_l03_barrier_events",
    "k02_daily_ic", "u05_liquidity_filter", "b09_result", "st_hourly_bars",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    registry.QUERIES["s01_scan_bars"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the engine
    for name in HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
