"""Streams of bars against the same bars in one table."""

from pyspark.sql import functions as F

from tickloom.operators.indicators import indicator
from tickloom.sources.bars import synthetic
from tickloom.streaming.stateful import chunked, stream


def test_stream_equals_batch(spark, tmp_path):
    bars = synthetic(spark, ("AAA", "BBB"), 45)
    day = F.date_format("ts", "yyyyMMdd").cast("int")
    src = tmp_path / "in"
    cuts = (20200115, 20200201, 20300101)
    before = 0
    for k, cut in enumerate(cuts):
        bars.where((day > before) & (day <= cut)).coalesce(1).write.parquet(str(src / f"p={k}"))
        before = cut
    incoming = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "p=*"))
    q = stream(incoming, "macd", 3, 6, 4).writeStream.format("memory").queryName("macd_stream").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(120)
    got = {(r["symbol"], r["ts"]): (r["macd_line"], r["signal_line"]) for r in spark.table("macd_stream").collect()}
    want = {(r["symbol"], r["ts"]): (r["macd_line"], r["signal_line"]) for r in indicator(bars, "macd", 3, 6, 4).collect()}
    assert got == want


def test_chunked(spark):
    bars = synthetic(spark, ("AAA",), 30)
    cut = F.lit("2020-01-11").cast("timestamp_ntz")
    one, states = chunked(bars.where(F.col("ts") < cut), "rsi", 5)
    two, _ = chunked(bars.where(F.col("ts") >= cut), "rsi", 5, states=states)
    got = {r["ts"]: r["rsi"] for r in one.unionByName(two).collect()}
    assert got == {r["ts"]: r["rsi"] for r in indicator(bars, "rsi", 5).collect()}


def test_stream_with_other_orders(spark, tmp_path):
    """Numbers, dates and decimals as order: no batch is taken for late because 10 comes before 9 as text."""
    for kind, of in (("int", lambda k: str(k)), ("date", lambda k: f"date_add(date'2020-01-01', cast({k} as int))"), ("decimal(9,2)", lambda k: f"cast({k} as decimal(9,2))"), ("double", lambda k: f"cast({k} as double)")):
        src = tmp_path / kind[:4]
        for part in range(3):
            spark.range(10 * part, 10 * part + 10).select(F.lit("a").alias("symbol"), F.expr(of("id")).cast(kind).alias("ts"), F.col("id").cast("double").alias("close")).coalesce(1).write.parquet(str(src / f"p={part}"))
        schema = f"symbol string, ts {kind}, close double"
        incoming = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "p=*"))
        name = f"orders_{kind[:4]}"
        stream(incoming, "ema", 3).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
        got = [r["ema"] for r in spark.table(name).orderBy("ts").collect()]
        want = [r["ema"] for r in indicator(spark.read.schema(schema).parquet(str(src / "p=*")), "ema", 3).orderBy("ts").collect()]
        assert len(got) == 30 and got == want
