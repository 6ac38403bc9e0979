"""Readers and writers of bars."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.sources import bars


def tables(spark):
    listing = spark.createDataFrame([(1, "BHP", "ASX"), (2, "CBA", "ASX"), (3, "BHP", "NYSE")], "listing_id int, code string, exchange_code string")
    rows = [(i, dt.date(2024, 1, d), f"{10 * i + d}", f"{10 * i + d + 1}", f"{10 * i + d - 1}", "x" if d == 3 else f"{10 * i + d}.5", 0 if d == 4 else 100 * d) for i in (1, 2, 3) for d in range(1, 8)]
    prices = spark.createDataFrame([*rows, (9, dt.date(2024, 1, 1), "1", "1", "1", "1", 5), (1, dt.date(2024, 2, 1), "1", "1", "1", "1", None)], "listing_id int, ts date, open string, high string, low string, close string, volume long")
    return prices, listing


def test_end_of_day(spark):
    prices, listing = tables(spark)
    every = bars.end_of_day(prices, listing)
    assert every.columns == list(bars.COLUMNS) and every.count() == 18  # neither without volume nor without listing
    assert {r["symbol"] for r in every.collect()} == {"BHP_ASX", "CBA_ASX", "BHP_NYSE"}
    some = bars.end_of_day(prices, listing, [("BHP", "ASX"), ("CBA", "NYSE")])
    assert {r["symbol"] for r in some.collect()} == {"BHP_ASX"}
    last = bars.end_of_day(prices, listing, limit=2)
    assert sorted({r["ts"].day for r in last.collect()}) == [6, 7] and last.count() == 6
    assert [r["close"] for r in some.where("ts = date'2024-01-03'").collect()] == [0.0]  # what is no number counts as 0
    assert bars.end_of_day(prices.limit(0), listing).count() == 0


def test_resample_and_write(spark, tmp_path):
    daily = bars.synthetic(spark, ("A", "B"), 70)
    months = {(r["symbol"], r["ts"].month): r for r in bars.resample(daily, "month").collect()}
    own = daily.where("symbol = 'A' and month(ts) = 2").orderBy("ts").collect()
    m = months["A", 2]
    assert (m["open"], m["close"]) == (own[0]["open"], own[-1]["close"]) and m["high"] == max(r["high"] for r in own) and m["low"] == min(r["low"] for r in own) and m["volume"] == sum(r["volume"] for r in own)
    path = str(tmp_path / "bars")
    bars.write(daily, path)
    back = spark.read.parquet(path)
    assert back.count() == 140 and back.where("symbol = 'A'").select(*daily.columns).exceptAll(daily.where("symbol = 'A'")).count() == 0
    assert "PartitionFilters: [isnotnull(symbol" in back.where("symbol = 'A'")._jdf.queryExecution().toString()
    bars.write(daily.where("symbol = 'A'"), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 70


def test_build_breaks_ties_by_sequence(spark):
    ticks = spark.createDataFrame([("a", 1, 5.0, 2), ("a", 1, 7.0, 1), ("a", 1, 6.0, 3), (None, 1, 1.0, 1), ("a", None, 1.0, 1)], "s string, t int, p double, n int")
    assert [tuple(r) for r in bars.build(ticks, "s", "t", "p", ["n"]).collect()] == [("a", 1, 7.0, 7.0, 5.0, 6.0, 3.0)]


def test_database(spark, tmp_path):
    """Through JDBC, with the database that Spark brings along; the filter reaches it."""
    prices, listing = tables(spark)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for name, df in (("prices", prices.withColumn("ts", F.col("ts").cast("string"))), ("listing", listing)):
        df.write.option("createTableColumnTypes", ", ".join(f"{c} VARCHAR(20)" for c, k in df.dtypes if k == "string")).jdbc(url, name, properties=driver)
    read = lambda name, **more: bars.read_jdbc(spark, url, name, driver, **more)
    got = bars.end_of_day(read("prices", partition=("listing_id", 1, 4, 3)), read("listing"), [("CBA", "ASX")])
    want = bars.end_of_day(prices.withColumn("ts", F.col("ts").cast("string")), listing, [("CBA", "ASX")])
    assert got.count() == 6 and got.exceptAll(want).count() == 0
    assert read("prices", partition=("listing_id", 1, 4, 3)).rdd.getNumPartitions() == 3
