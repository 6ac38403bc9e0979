"""Reports over a benchmark's own tables: comparisons of implementations, changes from run to run, summaries.

Tables: ``indicators(id, name, description, input_count, output_count, has_options, category)``, ``runs(id, run_timestamp, system_info)`` with JSON text, and ``results(id, run_id, indicator_id, implementation_type, stock_symbol, data_source, options, mean_time_ns, std_dev_ns, min_time_ns, max_time_ns, sample_count, input_size, created_at)``.

``views`` gives all reports under the names that the harness's database has for them (where such a name holds another library's, 'c' stands for it). Implementations go by labels, from which column names are made; ``VALUES`` says what a label's rows hold as implementation_type. Ratios whose divisor is 0 are null. Means are rounded half away from zero. Every report is a few aggregations and lags; none is sorted, ``ORDER`` says how the harness shows it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ("run_id", "benchmark_date", "hostname", "indicator_name")
SERIES = ("stock_symbol", "data_source", "input_size")
# Labels of implementations and what the results call them.
VALUES = {
    "rust": "Rust", "c": "C", "talib": "talib", "rustta": "RustTa", "rust_ta": "RustTa",
    "rust_fromstate": "Rust_FromState", "rust_optional": "Rust_optional", "rust_fromstate_1_bar": "Rust_FromState_1_Bar", "rust_fromstate_1_bar_json": "Rust_FromState_1_Bar_json",
    "rust_simd": "Rust_SIMD", "rust_simd_asset": "Rust_SIMD_by_assets",
}
LIBRARIES = ("rust", "c", "talib", "rustta")
VARIANTS = ("rust", "rust_fromstate", "rust_optional", "rust_fromstate_1_bar", "rust_fromstate_1_bar_json", "rust_ta")
CANDLESTICK, SCAN = "candlestick", "Rust_Candlestick"


def joined(runs: DataFrame, results: DataFrame, indicators: DataFrame) -> DataFrame:
    r = runs.select(F.col("id").alias("run_id"), F.col("run_timestamp").alias("benchmark_date"), F.get_json_object("system_info", "$.hostname").alias("hostname"))
    i = indicators.select(F.col("id").alias("indicator_id"), F.col("name").alias("indicator_name"), "category")
    return results.join(r, "run_id").join(i, "indicator_id")


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero, as exact decimals are: what is binary noise behind the sixth further digit goes first."""
    return F.round(F.round(c, digits + 6), digits)


def percent(now: Column, then: Column) -> Column:
    """By how many per cent ``now`` is above ``then``."""
    return rounded(over(now - then, then) * 100, 2)


def compared(rows: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), count: str = "", exact: bool = False, least: int = 1, base: str | None = None, values: Mapping[str, str] = VALUES) -> DataFrame:
    """A row for each run, indicator and ``keys`` with ``least`` of the implementations or more: the time of each. ``exact``: the greatest time instead of the mean; ``count``: 'options' (different ones), 'symbol' (rows) or 'sample' (the greatest number) beside it; ``base``: the others as multiples of this one, and its difference from them in per cent."""
    of = lambda n, c: F.when(F.col("implementation_type") == values[n], c)
    known = F.col("implementation_type").isin(*(values[n] for n in labels))
    time = "_mean_time_ns" if exact else "_avg_mean_time_ns"
    counts = {"options": lambda n: F.countDistinct(of(n, F.col("options"))), "symbol": lambda n: F.count(of(n, F.lit(1))), "sample": lambda n: F.max(of(n, F.col("sample_count")))}
    parts = [(F.max if exact else F.avg)(of(n, F.col("mean_time_ns"))).alias(n) for n in labels]
    parts += [counts[count](n).alias(f"{n}_{count}_count") for n in labels] if count else []
    g = rows.groupBy(*RUN, *keys).agg(*parts, F.countDistinct(F.when(known, F.col("implementation_type"))).alias("kinds")).where(F.col("kinds") >= least)
    shown = [F.col(n) if exact else F.round(n) for n in labels]
    out = [c.alias(n + time) for n, c in zip(labels, shown)] + [F.col(f"{n}_{count}_count") for n in labels if count]
    if base:
        b = F.col(base)
        out += [rounded(over(F.col(n), b), 2).alias(f"{n}_to_{base}_ratio") for n in labels if n != base]
        out += [percent(b, F.col(n)).alias(f"{base}_vs_{n}_percent_diff") for n in labels if n != base]
    return g.select(*RUN, *keys, *out)


def previous(report: DataFrame, times: Mapping[str, str], ratios: Mapping[str, tuple[str, str]], keys: Sequence[str] = (), differences: Mapping[str, tuple[str, str, int]] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Each row beside the same host's, indicator's and ``keys``' row of the run before; first runs, and rows with a null among those, are left out.

    ``times``: label -> column, as current_<label>_avg_time_ns, prev_..., <label>_performance_change_pct. ``ratios``: column -> (its name behind current_ and prev_, name of its change in per cent); ``differences``: the same with a plain difference and its digits. ``also``: columns shown as current_<column>.
    """
    by = ["hostname", "indicator_name", *keys]
    w = Window.partitionBy(*by).orderBy("benchmark_date", "run_id")
    differences = differences or {}
    used = [*times.values(), *ratios, *differences]
    with_last = report.where(" and ".join(f"{k} is not null" for k in by)).withColumns({"prev_run_id": F.lag("run_id").over(w), "prev_benchmark_date": F.lag("benchmark_date").over(w)} | {f"last_{c}": F.lag(c).over(w) for c in used}).where("prev_run_id is not null")
    now, last = (lambda c: F.col(c)), (lambda c: F.col(f"last_{c}"))
    out = [f(c).alias(f"{when}_{n}_avg_time_ns") for when, f in (("current", now), ("prev", last)) for n, c in times.items()]
    out += [f(c).alias(f"{when}_{n}") for when, f in (("current", now), ("prev", last)) for c, (n, *_) in (*ratios.items(), *differences.items())]
    out += [percent(now(c), last(c)).alias(f"{n}_performance_change_pct") for n, c in times.items()]
    out += [percent(now(c), last(c)).alias(n) for c, (_, n) in ratios.items()]
    out += [rounded(now(c) - last(c), digits).alias(n) for c, (_, n, digits) in differences.items()]
    out += [now(c).alias(f"current_{c}") for c in also]
    days = (F.unix_micros(F.col("benchmark_date").cast("timestamp")) - F.unix_micros(F.col("prev_benchmark_date").cast("timestamp"))) / 86_400_000_000
    return with_last.select(*RUN, *keys, "prev_run_id", "prev_benchmark_date", *out, days.alias("days_between_runs"))


def latest(report: DataFrame) -> DataFrame:
    """The last run's row of each host and indicator."""
    w = Window.partitionBy("hostname", "indicator_name").orderBy(F.desc("benchmark_date"), F.desc("run_id"))
    return report.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def slower(report: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """Of each host's and indicator's last run, those in which ``base`` takes longer than one of the others, and by how much."""
    now = lambda n: F.col(f"current_{n}_avg_time_ns")
    behind = {n: F.coalesce(now(base) > now(n), F.lit(False)) for n in others}
    some = behind[others[0]]
    for n in others[1:]:
        some = some | behind[n]
    return latest(report).where(some).withColumns({f"{base}_slower_than_{n}_by_pct": F.when(behind[n], percent(now(base), now(n))) for n in others})


def totals(rows: DataFrame, base: str, simd: str = "rust_simd", values: Mapping[str, str] = VALUES) -> DataFrame:
    """One vectorised call for all options against ``base``'s calls for each, added up; groups that have both."""
    of = lambda n, c: F.when(F.col("implementation_type") == values[n], c)
    own = rows.where(F.col("implementation_type").isin(values[base], values[simd]))
    g = own.groupBy(*RUN, *SERIES).agg(F.sum(of(base, F.col("mean_time_ns"))).alias("t"), F.count(of(base, F.lit(1))).alias("n"), F.max(of(simd, F.col("mean_time_ns"))).alias("s"), F.max(of(simd, F.col("sample_count"))).alias("k"), F.count(of(simd, F.lit(1))).alias("m")).where("n > 0 and m > 0")
    t, s = F.col("t"), F.col("s")
    return g.select(*RUN, *SERIES, t.alias(f"{base}_total_mean_time_ns"), F.col("n").alias(f"{base}_options_count"), s.alias(f"{simd}_mean_time_ns"), F.col("k").alias(f"{simd}_sample_count"), rounded(over(s, t), 4).alias(f"simd_to_{base}_ratio"), rounded(over(t, s), 4).alias(f"{base}_to_simd_ratio"), rounded(over(t, s) * 100, 2).alias(f"simd_vs_{base}_percent_improvement"), rounded(over(t, s), 2).alias(f"simd_speedup_vs_{base}"))


def asset_totals(rows: DataFrame, bases: Sequence[str] = ("rust", "c", "talib"), simd: str = "rust_simd_asset", values: Mapping[str, str] = VALUES) -> DataFrame:
    """One vectorised call for all assets against the calls for each, added up (0 where there are none); groups with such a call and one of the others."""
    of = lambda n, c: F.when(F.col("implementation_type") == values[n], c)
    own = rows.where(F.col("implementation_type").isin(*(values[n] for n in (*bases, simd))))
    g = own.groupBy(*RUN, "options", "data_source").agg(*(F.coalesce(F.sum(of(n, F.col("mean_time_ns"))), F.lit(0)).alias(n) for n in bases), F.avg(of(simd, F.col("mean_time_ns"))).alias("s"), F.count(F.when(F.col("implementation_type") != values[simd], 1)).alias("others")).where("s is not null and others > 0")
    s = F.col("s")
    part = lambda n: F.when(F.col(n) != 0, F.col(n))
    return g.select(*RUN, "options", "data_source", *(F.col(n).alias(f"{n}_total_mean_time_ns") for n in bases), s.alias(f"{simd}_mean_time_ns"), rounded(over(s, part(bases[0])), 4).alias(f"simd_asset_to_{bases[0]}_ratio"), *(rounded(over(part(n), s) * 100, 2).alias(f"simd_asset_vs_{n}_percent_improvement") for n in bases))


def coarser(report: DataFrame, keys: Sequence[str], **columns: tuple[str, str, int | None]) -> DataFrame:
    """Aggregates by run, indicator and ``keys``: name = (aggregate, column, digits or None)."""
    f = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    one = lambda how, c, digits: f[how](c) if digits is None else rounded(f[how](c), digits)
    return report.groupBy(*RUN, *keys).agg(*(one(*spec).alias(name) for name, spec in columns.items()))


def candlesticks(rows: DataFrame, name: str = SCAN) -> DataFrame:
    """Times of the candlestick scan by forecast (kept as the implementation), input size and options."""
    keys = ["run_id", "benchmark_date", "hostname", F.col("implementation_type").alias("forecast_name"), "input_size", "options"]
    return rows.where(F.col("indicator_name") == name).groupBy(*keys).agg(F.round(F.avg("mean_time_ns")).alias("avg_mean_time_ns"), F.count(F.lit(1)).alias("symbol_count"), F.round(F.avg("std_dev_ns")).alias("avg_std_dev_ns"), F.min("min_time_ns").alias("overall_min_time_ns"), F.max("max_time_ns").alias("overall_max_time_ns"))


def summary(indicators: DataFrame, results: DataFrame) -> DataFrame:
    """Every indicator with the number of its results and the last one's time."""
    r = results.groupBy(F.col("indicator_id").alias("id")).agg(F.count("id").alias("n"), F.max("created_at").alias("last_benchmarked"))
    return indicators.join(r, "id", "left").select("name", "description", "category", "input_count", "output_count", "has_options", F.coalesce("n", F.lit(0)).alias("benchmark_count"), "last_benchmarked")


def _vector(rows: DataFrame, base: str, values: Mapping[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """By series, by input size, by indicator, and against the run before."""
    gain, speed, share = f"simd_vs_{base}_percent_improvement", f"simd_speedup_vs_{base}", f"simd_to_{base}_ratio"
    series = totals(rows, base, values=values)
    sizes = coarser(
        series, ["input_size"], **{f"{base}_avg_total_time_ns": ("avg", f"{base}_total_mean_time_ns", 0), f"{base}_avg_options_count": ("avg", f"{base}_options_count", None), f"{base}_stock_count": ("count", f"{base}_total_mean_time_ns", None), "rust_simd_avg_time_ns": ("avg", "rust_simd_mean_time_ns", 0), "rust_simd_stock_count": ("count", "rust_simd_mean_time_ns", None), f"avg_{share}": ("avg", share, 4), f"avg_{base}_to_simd_ratio": ("avg", f"{base}_to_simd_ratio", 4), "avg_simd_improvement_pct": ("avg", gain, 2), "min_simd_improvement_pct": ("min", gain, 2), "max_simd_improvement_pct": ("max", gain, 2), "avg_simd_speedup_factor": ("avg", speed, 2), "min_simd_speedup": ("min", speed, 2), "max_simd_speedup": ("max", speed, 2)}
    )
    whole = coarser(
        sizes, [], **{f"{base}_overall_avg_time_ns": ("avg", f"{base}_avg_total_time_ns", 0), f"{base}_overall_avg_options": ("avg", f"{base}_avg_options_count", 0), "rust_simd_overall_avg_time_ns": ("avg", "rust_simd_avg_time_ns", 0), f"overall_{share}": ("avg", f"avg_{share}", 4), f"overall_{base}_to_simd_ratio": ("avg", f"avg_{base}_to_simd_ratio", 4), "overall_simd_improvement_pct": ("avg", "avg_simd_improvement_pct", 2), "overall_simd_speedup_factor": ("avg", "avg_simd_speedup_factor", 2), "best_case_improvement_pct": ("min", "min_simd_improvement_pct", 2), "worst_case_improvement_pct": ("max", "max_simd_improvement_pct", 2), "best_case_speedup": ("min", "min_simd_speedup", 2), "worst_case_speedup": ("max", "max_simd_speedup", 2), f"total_{base}_measurements": ("sum", f"{base}_stock_count", None), "total_simd_measurements": ("sum", "rust_simd_stock_count", None)}
    )
    before = previous(whole, {base: f"{base}_overall_avg_time_ns", "simd": "rust_simd_overall_avg_time_ns"}, {"overall_simd_speedup_factor": ("simd_speedup_factor", "simd_speedup_change_pct")}, differences={"overall_simd_improvement_pct": ("simd_improvement_pct", "simd_improvement_change_pct", 2)})
    return series, sizes, whole, before


def _assets(rows: DataFrame, values: Mapping[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    bases = ("rust", "c", "talib")
    series = asset_totals(rows, bases, values=values)
    sources = coarser(
        series, ["data_source"], **{f"{n}_avg_total_time_ns": ("avg", f"{n}_total_mean_time_ns", 0) for n in bases}, rust_simd_asset_avg_time_ns=("avg", "rust_simd_asset_mean_time_ns", 0), avg_simd_asset_to_rust_ratio=("avg", "simd_asset_to_rust_ratio", 4), **{f"avg_simd_asset_vs_{n}_improvement_pct": ("avg", f"simd_asset_vs_{n}_percent_improvement", 2) for n in bases}
    )
    whole = coarser(
        sources, [], **{f"{n}_overall_avg_time_ns": ("avg", f"{n}_avg_total_time_ns", 0) for n in bases}, rust_simd_asset_overall_avg_time_ns=("avg", "rust_simd_asset_avg_time_ns", 0), overall_simd_asset_to_rust_ratio=("avg", "avg_simd_asset_to_rust_ratio", 4), **{f"overall_simd_asset_vs_{n}_improvement_pct": ("avg", f"avg_simd_asset_vs_{n}_improvement_pct", 2) for n in bases}
    )
    gains = {f"overall_simd_asset_vs_{n}_improvement_pct": (f"overall_simd_asset_vs_{n}_improvement_pct", f"simd_asset_vs_{n}_improvement_change_pct", 2) for n in bases}
    before = previous(whole, {"simd_asset": "rust_simd_asset_overall_avg_time_ns"}, {}, differences={"overall_simd_asset_to_rust_ratio": ("overall_simd_asset_to_rust_ratio", "simd_asset_to_rust_ratio_change", 4)} | gains)
    return series, sources, whole, before


def views(runs: DataFrame, results: DataFrame, indicators: DataFrame, values: Mapping[str, str] = VALUES, scan: str = SCAN) -> dict[str, DataFrame]:
    """All reports by name."""
    rows = joined(runs, results, indicators)
    plain = rows.where(F.col("category") != CANDLESTICK)
    out = {"candlestick_simplified_comparison": candlesticks(rows, scan), "indicator_summary": summary(indicators, results)}
    for prefix, of, labels, least, base, counts in (("", rows, LIBRARIES, 2, "rust", ("options", "symbol", "sample")), ("rust_impl_", plain, VARIANTS, 1, None, ("", "symbol", "sample"))):
        out[f"{prefix}avg_options_comparison"] = compared(of, labels, (), counts[0], least=least, base=base, values=values)
        out[f"{prefix}simplified_comparison"] = compared(of, labels, ("input_size", "options"), counts[1], least=least, base=base, values=values)
        out[f"{prefix}performance_comparison"] = compared(of, labels, (*SERIES, "options"), counts[2], exact=True, least=least, base=base, values=values)
        times = {n: f"{n}_avg_mean_time_ns" for n in labels}
        ratios = {f"{n}_to_rust_ratio": (f"{n}_to_rust_ratio", f"{n}_ratio_change_pct") for n in labels[1:]} if base else {}
        out[f"{prefix}prev_avg_run_comparison"] = previous(out[f"{prefix}avg_options_comparison"], times, ratios, also=["rust_options_count"] if base else [])
        out[f"{prefix}prev_run_comparison"] = previous(out[f"{prefix}simplified_comparison"], times, ratios, ("input_size", "options"))
    out["rust_slower_indicators"] = slower(out["prev_avg_run_comparison"], "rust", ("c", "talib", "rustta"))
    out["rust_impl_slower_indicators"] = latest(out["rust_impl_prev_avg_run_comparison"])
    for prefix, found in (("rust_simd", _vector(rows, "rust", values)), ("rust_simd_c", _vector(rows, "c", values)), ("rust_simd_asset", _assets(rows, values))):
        out |= dict(zip((f"{prefix}_performance_comparison", f"{prefix}_simplified_comparison", f"{prefix}_avg_comparison", f"{prefix}_prev_run_comparison"), found))
    return out


#: How the harness orders a report: the latest run first, then indicators; and the reports that it orders otherwise.
ORDER = ("-benchmark_date", "indicator_name")
OTHER_ORDER = {"indicator_summary": ("category", "name"), "candlestick_simplified_comparison": ("-benchmark_date", "forecast_name"), "rust_slower_indicators": ("hostname", "indicator_name"), "rust_impl_slower_indicators": ("hostname", "indicator_name")}


def ordered(name: str, report: DataFrame) -> DataFrame:
    keys = list(OTHER_ORDER.get(name, ORDER))
    keys += [k for k in ("stock_symbol",) if k in report.columns and name not in OTHER_ORDER]
    return report.orderBy(*(F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in keys))
