"""Bars: (symbol, ts, open, high, low, close, volume) from ticks, transactions and databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")


def build(df: DataFrame, symbol: Column | str, ts: Column | str, price: Column | str, sequence: Sequence[str], volume: Column | None = None) -> DataFrame:
    """Bars of what falls on one symbol and time. ``sequence``: columns that order trades inside a bar, unique there; ``volume``: an aggregate, the count of trades by default. Combined before the shuffle."""
    p = F.col(price) if isinstance(price, str) else price
    at = F.struct(*sequence)
    own = df.withColumns({"_symbol": F.col(symbol) if isinstance(symbol, str) else symbol, "_ts": F.col(ts) if isinstance(ts, str) else ts})
    return own.where("_symbol is not null and _ts is not null").groupBy(F.col("_symbol").alias("symbol"), F.col("_ts").alias("ts")).agg(F.min_by(p, at).cast("double").alias("open"), F.max(p).cast("double").alias("high"), F.min(p).cast("double").alias("low"), F.max_by(p, at).cast("double").alias("close"), (volume if volume is not None else F.count(F.lit(1))).cast("double").alias("volume"))


def daily(lineitem: DataFrame) -> DataFrame:
    """A bar for each return flag and ship date."""
    return build(lineitem, "l_returnflag", "l_shipdate", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.sum("l_quantity"))


def hourly(events: DataFrame) -> DataFrame:
    """A bar for each event type and hour."""
    return build(events, "event_type", F.date_trunc("hour", "ts"), "value", ["ts", "event_id"])


def weekly(orders: DataFrame) -> DataFrame:
    """A bar for each order priority and week."""
    return build(orders, "o_orderpriority", F.date_trunc("week", "o_orderdate"), "o_totalprice", ["o_orderkey"])


def lattice(lineitem: DataFrame) -> DataFrame:
    """Bars on a coarse lattice of prices, one for each line item, in forty series by supplier: steps, bodies and wicks are small multiples of 0.5 taken from its numbers, and now and then none. Prices so coarse touch, gap and repeat often, as pattern tests need."""
    from pyspark.sql import Window

    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    w = Window.partitionBy("symbol").orderBy(*key)
    own = lineitem.select(*key, F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("symbol"), cents.alias("c"), (F.col("l_partkey") * 31 + cents).alias("d"))
    n = own.withColumn("ts", F.row_number().over(w).cast("long"))
    # Spells of nine bars up and nine down; steps between bars, bodies, and wicks above and below.
    way = F.when(F.floor(F.col("ts") / 9) % 2 == 0, 1).otherwise(-1)
    pick = lambda x, *values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), (x % len(values)).cast("int") + 1)
    gap = pick(F.col("c"), 0, 0, 0, 0.5, -0.5, 1, -1, 1.5, -1.5, 2.5, -2.5, -4, 4)
    body = pick(F.floor(F.col("c") / 13), 1, 1, 2, 2, 3, 0.5, 0, 0.5, -0.5, -1, -2, 5, 4) * way
    up, down = pick(F.col("d"), 0, 0, 0.5, 0.5, 1, 3, 0), pick(F.floor(F.col("d") / 7), 0, 0.5, 0, 0.5, 1, 3, 0)
    parts = n.select("symbol", "ts", gap.alias("g"), body.alias("b"), up.alias("u"), down.alias("d"))
    close = 1000 + F.sum(F.col("g") + F.col("b")).over(Window.partitionBy("symbol").orderBy("ts"))
    priced = parts.withColumn("close", close).withColumn("open", F.col("close") - F.col("b"))
    return priced.select("symbol", "ts", "open", (F.greatest("open", "close") + F.col("u")).alias("high"), (F.least("open", "close") - F.col("d")).alias("low"), "close", F.lit(1.0).alias("volume"))


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a longer unit ('week', 'month', ...) from shorter ones."""
    t = F.date_trunc(unit, F.col("ts"))
    return bars.groupBy("symbol", t.alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def sound(bars: DataFrame) -> DataFrame:
    """Bars without nulls whose high and low enclose open and close."""
    return bars.where(" and ".join(f"{c} is not null" for c in COLUMNS) + " and low <= least(open, close) and high >= greatest(open, close)")


def end_of_day(prices: DataFrame, listing: DataFrame, codes: Sequence[tuple[str, str]] | None = None, limit: int | None = None) -> DataFrame:
    """Adjusted end-of-day prices joined to their listing: bars with a volume, the last ``limit`` of each code, by time. Both tables may come from any reader, JDBC among them; the filter reaches it."""
    own = listing.select("listing_id", "code", "exchange_code")
    if codes is not None:
        own = own.where(F.concat_ws("\x1f", "code", "exchange_code").isin([f"{c}\x1f{x}" for c, x in codes]))
    doubles = [F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    bars = prices.where("volume > 0").join(own, "listing_id").select(F.concat_ws("_", "code", "exchange_code").alias("symbol"), "ts", *doubles)
    if limit is not None:
        from pyspark.sql import Window

        bars = bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_n") <= limit).drop("_n")
    return bars


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database table; ``partition``: (numeric column, lower bound, upper bound, parts) to read in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition:
        column, lower, upper, parts = partition
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


def synthetic(spark: SparkSession, symbols: Sequence[str] = ("AAA", "BBB", "CCC", "DDD"), bars: int = 1500) -> DataFrame:
    """Made-up daily bars from 2020-01-01: slow and fast swings around a level of each symbol's own, with a little noise from a hash. The same call always gives the same bars."""
    own = [F.struct(F.lit(s).alias("symbol"), F.lit(float(k + 1)).alias("k")) for k, s in enumerate(symbols)]
    days = spark.range(bars).withColumn("_s", F.explode(F.array(*own)))
    k = F.col("_s.k")

    def noise(day: Column, salt: int) -> Column:
        """From 0 to 1, in steps of a thousandth."""
        return F.pmod(F.xxhash64(day, F.col("_s.symbol"), F.lit(salt)), F.lit(1001)) / 1000

    def close(day: Column) -> Column:
        return F.round(40 + 20 * k + (6 + k) * F.sin(day / (17 + k)) + 2 * F.sin(day / 3.7) + 1.5 * noise(day, 1), 2)

    before, now = close(F.col("id") - 1), close(F.col("id"))
    opened = F.round(before + noise(F.col("id"), 2) - 0.5, 2)
    high = F.round(F.greatest(opened, now) + noise(F.col("id"), 3), 2)
    low = F.round(F.least(opened, now) - noise(F.col("id"), 4), 2)
    at = F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id as int))")
    return days.select(F.col("_s.symbol").alias("symbol"), at.alias("ts"), opened.alias("open"), high.alias("high"), low.alias("low"), now.alias("close"), F.round(1e6 * (1 + noise(F.col("id"), 5))).alias("volume"))


def write(df: DataFrame, path: str, by: Sequence[str] = ("symbol",), mode: str = "errorifexists") -> None:
    """A Parquet table in folders by symbol, so that a filter on it prunes what is read."""
    df.write.mode(mode).partitionBy(*by).parquet(path)
