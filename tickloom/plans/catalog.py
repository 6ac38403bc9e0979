"""Named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths
from ..operators import candlesticks
from ..operators.indicators import crossover, indicator, pivotpoint, resume, sweep
from ..operators.registry import INFO
from ..sources import bars
from . import optionals, oracles, report, report_sql

Query = Callable[[SparkSession, str], DataFrame]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.weekly(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def shown(df: DataFrame, outputs: list[str], extra: list[str] | None = None) -> DataFrame:
    """Symbol, time as text, and outputs rounded as the SQL twins round them."""

    def scaled(k: str) -> F.Column:
        return F.log(F.col(k)) if k in oracles.LOGGED else F.col(k) * oracles.SCALED.get(k, 1.0)

    return df.select("symbol", F.col("ts").cast("string").alias("ts"), *(extra or []), *(F.round(scaled(k) + oracles.SHIFT, oracles.DIGITS).alias("ln_" * (k in oracles.LOGGED) + k) for k in outputs))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    both = indicator(indicator(d, "sma", 14), "ema", 14)
    return shown(both, ["close", "sma", "ema"])


def of_indicator(name: str) -> Query:
    info = INFO[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = daily(spark, sf_dir)
        named = {k: f"_{k}" for k in info.outputs if k in own.columns}
        out = indicator(own, name, names=named)
        return shown(out.select("symbol", "ts", *(F.col(named.get(k, k)).alias(k) for k in info.outputs)), list(info.outputs))

    return query


def of_bars(make: Query) -> Query:
    return lambda spark, sf_dir: shown(make(spark, sf_dir), ["open", "high", "low", "close", "volume"])


def bars_sql(sql: str) -> str:
    return f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, " + ", ".join(f"round({c} + {oracles.SHIFT}, {oracles.DIGITS}) AS {c}" for c in ("open", "high", "low", "close", "volume")) + f" FROM ({sql}) AS b"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample(daily(spark, sf_dir), "month")


MONTHLY_SQL = f"SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({oracles.DAILY}) AS d GROUP BY symbol, date_trunc('month', ts)"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred bars of two listings, by the loader of end-of-day prices; the daily bars stand for its tables."""
    own = daily(spark, sf_dir).withColumn("listing_id", F.ascii("symbol"))
    prices = own.drop("symbol").withColumn("volume", F.when(F.dayofmonth("ts") == 13, 0).otherwise(F.col("volume")))
    listing = own.select("listing_id", F.col("symbol").alias("code"), F.lit("XX").alias("exchange_code")).distinct()
    return bars.end_of_day(prices, listing, [("A", "XX"), ("N", "XX"), ("A", "YY")], limit=100)


LATEST_SQL = f"SELECT symbol || '_XX' AS symbol, ts, open, high, low, close, volume FROM ({oracles.DAILY}) AS d WHERE day(ts) <> 13 AND volume > 0 AND symbol IN ('A', 'N') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"


MATHS = ("abs", "acos", "ln", "exp", "pow", "sqrt", "atan", "sin", "cos", "sum")


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions over daily bars."""
    o, c = F.col("open"), F.col("close")
    sine, cosine = maths.sin_cos(c / 1000)
    f = maths.SCALAR
    values = (f["abs"](o - c), f["acos"](F.col("low") / F.col("high")), f["ln"](c), f["exp"](-o / c), f["pow"](c / o, F.lit(0.5)), f["sqrt"](c), f["atan"](o / c), sine, cosine, maths.rolling_sum(c, 14))
    return shown(daily(spark, sf_dir).select("symbol", "ts", *(v.alias(k) for k, v in zip(MATHS, values))), list(MATHS))


_SCALARS = ("abs(open - close)", "acos(low / high)", "ln(close)", "exp(-open / close)", "pow(close / open, 0.5)", "sqrt(close)", "atan(open / close)", "sin(close / 1000)", "cos(close / 1000)", "CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 14 THEN sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END")
SCALARS_SQL = f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {', '.join(f'round({v} + {oracles.SHIFT}, {oracles.DIGITS}) AS {k}' for k, v in zip(MATHS, _SCALARS))} FROM ({oracles.DAILY}) AS d"


def crosses(either: bool) -> Query:
    return lambda spark, sf_dir: shown(crossover(daily(spark, sf_dir), "close", "open", either=either, name="crossed"), ["crossed"])


def crosses_sql(either: bool) -> str:
    back = " OR (pc > po AND close < open)" if either else ""
    return f"WITH b AS ({oracles.DAILY}), t AS (SELECT *, lag(close) {oracles.S} AS pc, lag(open) {oracles.S} AS po FROM b) SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN pc IS NOT NULL THEN CAST((pc < po AND close > open){back} AS DOUBLE) END + {oracles.SHIFT}, {oracles.DIGITS}) AS crossed FROM t"


PIVOTS = ["s3", "s2", "s1", "pp", "r1", "r2", "r3"]


def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pivotpoint(daily(spark, sf_dir), 20)
    return p.select("symbol", *(F.round(F.col(k) + oracles.SHIFT, oracles.DIGITS).alias(k) for k in PIVOTS))


PIVOTS_SQL = f"""WITH b AS ({oracles.DAILY}), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM b),
g AS (SELECT symbol, max(high) AS h, min(low) AS l, arg_min(close, n) AS c FROM l WHERE n <= 20 GROUP BY symbol HAVING count(*) = 20),
p AS (SELECT symbol, h, l, (h + l + c) / 3 AS pp, h - l AS r FROM g),
q AS (SELECT symbol, 2 * pp - h - r AS s3, pp - r AS s2, 2 * pp - h AS s1, pp, 2 * pp - l AS r1, pp + r AS r2, 2 * pp - l + r AS r3 FROM p)
SELECT symbol, {", ".join(f"round({k} + {oracles.SHIFT}, {oracles.DIGITS}) AS {k}" for k in PIVOTS)} FROM q"""

SWEEP = {
    "sma": [(5,), (20,), (50,)], "ema": [(5,), (20,), (50,)], "rsi": [(7,), (14,), (21,)], "bbands": [(10, 1.5), (20, 2)],
    "macd": [(3, 8, 4), (12, 26, 9)], "adx": [(2,), (14,), (40,)], "atr": [(1,), (14,)], "stoch": [(5, 1, 1), (14, 3, 3)], "psar": [(0.02, 0.2), (0.1, 0.3)], "kama": [(2,), (30,)], "wma": [(1,), (9,)], "linreg": [(3,), (30,)], "mfi": [(1,), (14,)], "wilders": [(1,), (30,)], "adosc": [(1, 2), (3, 10)], "vidya": [(2, 5, 0.5), (5, 20, 0.2)],
}


def of_sweep(name: str) -> Query:
    return lambda spark, sf_dir: shown(sweep(daily(spark, sf_dir), name, SWEEP[name]), list(INFO[name].outputs), ["param_id"])


def sweep_sql(name: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS param_id, * FROM ({oracles.build(name, INFO[name].check(o))}) AS q{k}" for k, o in enumerate(SWEEP[name]))


def of_chunks(name: str) -> Query:
    """The series in two chunks, the second from the first one's states."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = daily(spark, sf_dir)
        early = F.col("ts") < F.lit("1995-01-01").cast("timestamp")
        info = INFO[name]
        one = resume(d.where(early), name).persist()  # read twice: for its rows and for its states
        states = one.where("state is not null").select("symbol", "state")
        two = resume(d.where(~early), name, states=states)
        return shown(one.unionByName(two), list(info.outputs))

    return query


#: What is fed in two chunks: all that is recursive, and some that are not.
CHUNKS = (*(k for k, i in INFO.items() if i.recursive), "stoch", "obv", "wma")


def of_optional(name: str) -> Query:
    """An indicator's optional outputs."""
    info = INFO[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = indicator(daily(spark, sf_dir), name, optional=True, names={k: f"_{k}" for k in (*info.outputs, *info.optional)})
        return shown(out.select("symbol", "ts", *(F.col(f"_{k}").alias(k) for k in info.optional)), list(info.optional))

    return query


def hourly_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicator(hourly(spark, sf_dir), "macd"), list(INFO["macd"].outputs))


def weekly_bbands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicator(weekly(spark, sf_dir), "bbands"), list(INFO["bbands"].outputs))


def candles(forecast: str | None = None, periods: tuple[int, int, int] = (5, 3, 3)) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = candlesticks.scan(daily(spark, sf_dir), *periods, forecast=forecast)
        return candlesticks.exploded(found).withColumn("ts", F.col("ts").cast("string"))

    return query


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns over bars on a coarse lattice, where nearly all of them occur."""
    found = candlesticks.scan(bars.lattice(spark.read.parquet(f"{sf_dir}/lineitem.parquet")), 5, 3, 3)
    return candlesticks.exploded(found).withColumn("ts", F.col("ts").cast("string"))


def benchmark_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, results and indicators of a benchmark, made from the driver's tables: nations stand for runs and for indicators, line items for results."""
    nation, item = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "lineitem"))
    key, region = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("string")
    start = F.lit("2024-01-01").cast("timestamp")
    runs = nation.select((key + 1).alias("id"), F.timestamp_micros(F.unix_micros(start) + key * 30 * 3_600_000_000).alias("run_timestamp"), F.concat(F.lit('{"hostname": "host'), region, F.lit('"}')).alias("system_info"))
    kinds = nation.select((key + 1).alias("id"), F.when(key == 24, "Rust_Candlestick").otherwise(F.lower("n_name")).alias("name"), F.concat(F.lit("about "), "n_name").alias("description"), (key % 4 + 1).cast("int").alias("input_count"), (key % 3 + 1).cast("int").alias("output_count"), (key % 3 != 0).alias("has_options"), F.when(F.col("n_regionkey") == 4, "candlestick").otherwise(F.concat(F.lit("kind"), region)).alias("category"))
    time = F.round(F.col("l_extendedprice") * 100).cast("long")
    results = item.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 25 + 1).alias("run_id"), (F.col("l_partkey") % 25 + 1).alias("indicator_id"),
        F.element_at(F.array(*map(F.lit, report_sql.KINDS)), (F.col("l_orderkey") % 11 + 1).cast("int")).alias("implementation_type"), F.col("l_returnflag").alias("stock_symbol"), F.col("l_linestatus").alias("data_source"),
        F.concat(F.lit("["), (F.col("l_linenumber") % 3 * 7 + 7).cast("string"), F.lit("]")).alias("options"), time.alias("mean_time_ns"), F.round(F.col("l_discount") * 1000).cast("long").alias("std_dev_ns"), (time - 500).alias("min_time_ns"), (time + 700).alias("max_time_ns"),
        F.col("l_quantity").cast("int").alias("sample_count"), (1000 * (F.col("l_linenumber") % 2 + 1)).cast("int").alias("input_size"), F.col("l_shipdate").alias("created_at"),
    )
    return runs, results, kinds


def of_report(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = report.views(*benchmark_tables(spark, sf_dir))[name]
        return out.withColumns({k: F.col(k).cast("string") for k, kind in out.dtypes if kind.startswith("timestamp")})

    return query


QUERIES: dict[str, Query] = {
    "candlestick_lattice": lattice,
    "candlestick": candles(),
    **{f"candlestick_{f.lower()}": candles(f) for f in candlesticks.FORECASTS},
    "bars_daily": of_bars(daily),
    "bars_hourly": of_bars(hourly),
    "bars_weekly": of_bars(weekly),
    "bars_monthly": of_bars(monthly),
    "scalar_math": scalars,
    "bars_latest": of_bars(latest),
    "crossover": crosses(False),
    "crossany": crosses(True),
    "pivotpoint": pivots,
    **{f"ind_{k}": of_indicator(k) for k in INFO},
    **{f"sweep_{k}": of_sweep(k) for k in SWEEP},
    **{f"chunks_{k}": of_chunks(k) for k in CHUNKS},
    **{f"optional_{k}": of_optional(k) for k in optionals.TWINS},
    "hourly_macd": hourly_macd,
    "weekly_bbands": weekly_bbands,
    **{f"report_{k}": of_report(k) for k in report_sql.ALL},
}

ORACLE_SQL: dict[str, str] = {
    "candlestick_lattice": oracles.candles((5, 3, 3), bars=oracles.LATTICE),
    "candlestick": oracles.candles((5, 3, 3)),
    **{f"candlestick_{f.lower()}": oracles.candles((5, 3, 3), f) for f in candlesticks.FORECASTS},
    "bars_daily": bars_sql(oracles.DAILY),
    "bars_hourly": bars_sql(oracles.HOURLY),
    "bars_weekly": bars_sql(oracles.WEEKLY),
    "bars_monthly": bars_sql(MONTHLY_SQL),
    "scalar_math": SCALARS_SQL,
    "bars_latest": bars_sql(LATEST_SQL),
    "crossover": crosses_sql(False),
    "crossany": crosses_sql(True),
    "pivotpoint": PIVOTS_SQL,
    **{f"ind_{k}": oracles.build(k, i.defaults) for k, i in INFO.items()},
    **{f"sweep_{k}": sweep_sql(k) for k in SWEEP},
    **{f"chunks_{k}": oracles.build(k, INFO[k].defaults) for k in CHUNKS},
    **{f"optional_{k}": optionals.sql(k) for k in optionals.TWINS},
    "hourly_macd": oracles.build("macd", INFO["macd"].defaults, oracles.HOURLY),
    "weekly_bbands": oracles.build("bbands", INFO["bbands"].defaults, oracles.WEEKLY),
    **{f"report_{k}": report_sql.sql(k) for k in report_sql.ALL},
}
