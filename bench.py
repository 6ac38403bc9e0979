"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The queries over daily bars are small and measure what a job costs. ``many_*`` run over about three million bars of 400 series, read from a table that is written before the clock starts; ``ns_per_bar`` is their time over the number of bars.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = ("bars_daily", "ind_sma", "ind_ema", "ind_macd", "ind_rsi", "ind_adx", "ind_bbands", "ind_cci", "ind_msw", "ind_psar", "sweep_ema", "chunks_ema", "pivotpoint", "candlestick")
MANY = ("sma", "ema", "macd", "rsi", "adx", "psar", "kama")
LEVELS = 400


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tickloom.operators.indicators import indicator
    from tickloom.plans.catalog import QUERIES as ALL
    from tickloom.plans.catalog import daily

    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        # The daily bars at several hundred price levels, a series each.
        levels = spark.range(LEVELS).withColumnRenamed("id", "k")
        d = daily(spark, sf_dir).crossJoin(F.broadcast(levels))  # LEVELS rows
        d = d.withColumn("symbol", F.concat_ws("-", "symbol", "k")).withColumns({c: F.col(c) * (1 + F.col("k") / 100) for c in ("open", "high", "low", "close")}).drop("k")
        d.repartition(4 * int(cpus)).write.parquet(f"{folder}/bars")
        many = spark.read.parquet(f"{folder}/bars")
        n = many.count()
        took: dict[str, float] = {}

        def timed(name: str, make) -> None:
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)

        indicator(many, "ema", 14).write.format("noop").mode("overwrite").save()  # start-up isn't timed
        for name in QUERIES:
            timed(name, lambda: ALL[name](spark, sf_dir))
        for name in MANY:
            timed(f"many_{name}", lambda: indicator(many, name))
        per_bar = {k.removeprefix("many_"): round(took[k] / n * 1e9) for k in took if k.startswith("many_")}
        print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "bars": n, "ns_per_bar": per_bar, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
