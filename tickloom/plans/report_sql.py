"""The reports as SQL: benchmark tables made from the driver's, filtered aggregates, and a join with the run before."""

from __future__ import annotations

import re
from collections.abc import Sequence

from . import report
from .report import LIBRARIES, VALUES, VARIANTS

RUN = ", ".join(report.RUN)
SERIES = ", ".join(report.SERIES)
#: The benchmark tables: runs and indicators from nations, results from line items.
KINDS = ("Rust", "C", "talib", "RustTa", "Rust_FromState", "Rust_optional", "Rust_FromState_1_Bar", "Rust_FromState_1_Bar_json", "Rust_SIMD", "Rust_SIMD_by_assets", "other")
names_of = ", ".join(f"'{k}'" for k in KINDS)
BASE = f"""runs AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS run_id, TIMESTAMP '2024-01-01' + to_hours(CAST(n_nationkey * 30 AS BIGINT)) AS benchmark_date, 'host' || n_regionkey AS hostname FROM nation),
kinds AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS indicator_id, CASE WHEN n_nationkey = 24 THEN 'Rust_Candlestick' ELSE lower(n_name) END AS indicator_name, 'about ' || n_name AS description, CAST(n_nationkey % 4 + 1 AS INT) AS input_count, CAST(n_nationkey % 3 + 1 AS INT) AS output_count, n_nationkey % 3 <> 0 AS has_options, CASE WHEN n_regionkey = 4 THEN 'candlestick' ELSE 'kind' || n_regionkey END AS category FROM nation),
results AS (SELECT l_suppkey % 25 + 1 AS run_id, l_partkey % 25 + 1 AS indicator_id, ([{names_of}])[l_orderkey % 11 + 1] AS implementation_type, l_returnflag AS stock_symbol, l_linestatus AS data_source, '[' || (l_linenumber % 3 * 7 + 7) || ']' AS options,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS mean_time_ns, CAST(round(l_discount * 1000) AS BIGINT) AS std_dev_ns, CAST(round(l_extendedprice * 100) AS BIGINT) - 500 AS min_time_ns, CAST(round(l_extendedprice * 100) AS BIGINT) + 700 AS max_time_ns, CAST(l_quantity AS INT) AS sample_count, CAST(1000 * (l_linenumber % 2 + 1) AS INT) AS input_size, l_shipdate AS created_at FROM lineitem),
rows_ AS (SELECT * FROM results JOIN runs USING (run_id) JOIN kinds USING (indicator_id))"""


def of(f: str, label: str, column: str = "mean_time_ns") -> str:
    return f"{f}({column}) FILTER (implementation_type = '{VALUES[label]}')"


def names(labels: Sequence[str]) -> str:
    return ", ".join(f"'{VALUES[n]}'" for n in labels)


def exact(sql: str) -> str:
    """``round(x, digits)`` by decimals, half away from zero, wherever it stands in a text."""
    while (m := re.search(r"\bround\(", sql)) is not None:
        depth, at = 1, m.end()
        comma = -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            comma = at if sql[at] == "," and depth == 1 else comma
            at += 1
        inside, digits = (sql[m.end() : comma], int(sql[comma + 1 : at - 1])) if comma >= 0 else (sql[m.end() : at - 1], 0)
        sql = f"{sql[: m.start()]}CAST(CAST(CAST({inside} AS DECIMAL(30, {digits + 6})) AS DECIMAL(30, {digits})) AS DOUBLE){sql[at:]}"
    return sql


def pct(now: str, then: str) -> str:
    return f"round(({now} - {then}) / nullif({then}, 0) * 100, 2)"


def compared(labels: Sequence[str], keys: str, count: str, exact: bool, least: int, base: str | None, where: str) -> str:
    time = "_mean_time_ns" if exact else "_avg_mean_time_ns"
    cols = [f"{n} AS {n}{time}" if exact else f"round({n}) AS {n}{time}" for n in labels]
    cols += [f"{n}_k AS {n}_{count}_count" for n in labels if count]
    if base:
        cols += [f"round({n} / nullif({base}, 0), 2) AS {n}_to_{base}_ratio" for n in labels if n != base]
        cols += [f"{pct(base, n)} AS {base}_vs_{n}_percent_diff" for n in labels if n != base]
    how = {"options": lambda n: of("count", n, "DISTINCT options"), "symbol": lambda n: of("count", n, "*"), "sample": lambda n: of("max", n, "sample_count")}
    inner = [f"{of('max' if exact else 'avg', n)} AS {n}" for n in labels] + [f"{how[count](n)} AS {n}_k" for n in labels if count]
    group = f"{RUN}{', ' * bool(keys)}{keys}"
    return f"SELECT {group}, {', '.join(cols)} FROM (SELECT {group}, {', '.join(inner)} FROM rows_ WHERE {where} GROUP BY {group} HAVING count(DISTINCT implementation_type) FILTER (implementation_type IN ({names(labels)})) >= {least})"


def before(view: str, times: dict[str, str], ratios: dict[str, tuple[str, str]], keys: Sequence[str] = (), differences: dict[str, tuple[str, str, int]] | None = None, also: Sequence[str] = ()) -> str:
    differences = differences or {}
    own = ["hostname", "indicator_name", *keys]
    cols = [f"{t}.{c} AS {when}_{n}_avg_time_ns" for when, t in (("current", "a"), ("prev", "b")) for n, c in times.items()]
    cols += [f"{t}.{c} AS {when}_{v[0]}" for when, t in (("current", "a"), ("prev", "b")) for c, v in (*ratios.items(), *differences.items())]
    cols += [f"{pct(f'a.{c}', f'b.{c}')} AS {n}_performance_change_pct" for n, c in times.items()]
    cols += [f"{pct(f'a.{c}', f'b.{c}')} AS {v[1]}" for c, v in ratios.items()]
    cols += [f"round(a.{c} - b.{c}, {v[2]}) AS {v[1]}" for c, v in differences.items()]
    cols += [f"a.{c} AS current_{c}" for c in also]
    run = ", ".join(f"a.{k}" for k in (*report.RUN, *keys))
    return f"SELECT {run}, b.run_id AS prev_run_id, b.benchmark_date AS prev_benchmark_date, {', '.join(cols)}, epoch(a.benchmark_date - b.benchmark_date) / 86400 AS days_between_runs FROM (SELECT *, lag(run_id) OVER (PARTITION BY {', '.join(own)} ORDER BY benchmark_date) AS p FROM ({view})) AS a JOIN ({view}) AS b ON b.run_id = a.p AND " + " AND ".join(f"a.{k} = b.{k}" for k in own)


def last(view: str) -> str:
    return f"SELECT * FROM ({view}) QUALIFY row_number() OVER (PARTITION BY hostname, indicator_name ORDER BY benchmark_date DESC) = 1"


def slower(view: str, others: Sequence[str]) -> str:
    now = lambda n: f"current_{n}_avg_time_ns"
    cols = ", ".join(f"CASE WHEN {now('rust')} > {now(n)} THEN {pct(now('rust'), now(n))} END AS rust_slower_than_{n}_by_pct" for n in others)
    return f"SELECT *, {cols} FROM ({last(view)}) WHERE " + " OR ".join(f"{now('rust')} > {now(n)}" for n in others)


def totals(base: str) -> str:
    inner = f"SELECT {RUN}, {SERIES}, CAST({of('sum', base)} AS BIGINT) AS t, {of('count', base, '*')} AS n, {of('max', 'rust_simd')} AS s, {of('max', 'rust_simd', 'sample_count')} AS k FROM rows_ GROUP BY {RUN}, {SERIES}"
    return f"SELECT {RUN}, {SERIES}, t AS {base}_total_mean_time_ns, n AS {base}_options_count, s AS rust_simd_mean_time_ns, k AS rust_simd_sample_count, round(s / nullif(t, 0), 4) AS simd_to_{base}_ratio, round(t / nullif(s, 0), 4) AS {base}_to_simd_ratio, round(t / nullif(s, 0) * 100, 2) AS simd_vs_{base}_percent_improvement, round(t / nullif(s, 0), 2) AS simd_speedup_vs_{base} FROM ({inner}) WHERE t IS NOT NULL AND s IS NOT NULL"


def sizes(base: str) -> str:
    gain, speed = f"simd_vs_{base}_percent_improvement", f"simd_speedup_vs_{base}"
    each = lambda c, name: ", ".join(f"round({f}({c}), 2) AS {f}_{name}" for f in ("min", "max"))
    return f"SELECT {RUN}, input_size, round(avg({base}_total_mean_time_ns)) AS {base}_avg_total_time_ns, avg({base}_options_count) AS {base}_avg_options_count, count({base}_total_mean_time_ns) AS {base}_stock_count, round(avg(rust_simd_mean_time_ns)) AS rust_simd_avg_time_ns, count(rust_simd_mean_time_ns) AS rust_simd_stock_count, round(avg(simd_to_{base}_ratio), 4) AS avg_simd_to_{base}_ratio, round(avg({base}_to_simd_ratio), 4) AS avg_{base}_to_simd_ratio, round(avg({gain}), 2) AS avg_simd_improvement_pct, {each(gain, 'simd_improvement_pct')}, round(avg({speed}), 2) AS avg_simd_speedup_factor, {each(speed, 'simd_speedup')} FROM ({totals(base)}) GROUP BY {RUN}, input_size"


def whole(base: str) -> str:
    return f"SELECT {RUN}, round(avg({base}_avg_total_time_ns)) AS {base}_overall_avg_time_ns, round(avg({base}_avg_options_count)) AS {base}_overall_avg_options, round(avg(rust_simd_avg_time_ns)) AS rust_simd_overall_avg_time_ns, round(avg(avg_simd_to_{base}_ratio), 4) AS overall_simd_to_{base}_ratio, round(avg(avg_{base}_to_simd_ratio), 4) AS overall_{base}_to_simd_ratio, round(avg(avg_simd_improvement_pct), 2) AS overall_simd_improvement_pct, round(avg(avg_simd_speedup_factor), 2) AS overall_simd_speedup_factor, round(min(min_simd_improvement_pct), 2) AS best_case_improvement_pct, round(max(max_simd_improvement_pct), 2) AS worst_case_improvement_pct, round(min(min_simd_speedup), 2) AS best_case_speedup, round(max(max_simd_speedup), 2) AS worst_case_speedup, CAST(sum({base}_stock_count) AS BIGINT) AS total_{base}_measurements, CAST(sum(rust_simd_stock_count) AS BIGINT) AS total_simd_measurements FROM ({sizes(base)}) GROUP BY {RUN}"


def vector_before(base: str) -> str:
    return before(whole(base), {base: f"{base}_overall_avg_time_ns", "simd": "rust_simd_overall_avg_time_ns"}, {"overall_simd_speedup_factor": ("simd_speedup_factor", "simd_speedup_change_pct")}, differences={"overall_simd_improvement_pct": ("simd_improvement_pct", "simd_improvement_change_pct", 2)})


ASSETS = ("rust", "c", "talib")
_sums = ", ".join(f"CAST(coalesce({of('sum', n)}, 0) AS BIGINT) AS {n}" for n in ASSETS)
ASSET_SERIES = f"SELECT {RUN}, options, data_source, {', '.join(f'{n} AS {n}_total_mean_time_ns' for n in ASSETS)}, s AS rust_simd_asset_mean_time_ns, round(s / nullif(rust, 0), 4) AS simd_asset_to_rust_ratio, {', '.join(f'round(nullif({n}, 0) / s * 100, 2) AS simd_asset_vs_{n}_percent_improvement' for n in ASSETS)} FROM (SELECT {RUN}, options, data_source, {_sums}, {of('avg', 'rust_simd_asset')} AS s, count(*) FILTER (implementation_type IN ({names(ASSETS)})) AS m FROM rows_ GROUP BY {RUN}, options, data_source) WHERE s IS NOT NULL AND m > 0"
ASSET_SOURCES = f"SELECT {RUN}, data_source, {', '.join(f'round(avg({n}_total_mean_time_ns)) AS {n}_avg_total_time_ns' for n in ASSETS)}, round(avg(rust_simd_asset_mean_time_ns)) AS rust_simd_asset_avg_time_ns, round(avg(simd_asset_to_rust_ratio), 4) AS avg_simd_asset_to_rust_ratio, {', '.join(f'round(avg(simd_asset_vs_{n}_percent_improvement), 2) AS avg_simd_asset_vs_{n}_improvement_pct' for n in ASSETS)} FROM ({ASSET_SERIES}) GROUP BY {RUN}, data_source"
ASSET_WHOLE = f"SELECT {RUN}, {', '.join(f'round(avg({n}_avg_total_time_ns)) AS {n}_overall_avg_time_ns' for n in ASSETS)}, round(avg(rust_simd_asset_avg_time_ns)) AS rust_simd_asset_overall_avg_time_ns, round(avg(avg_simd_asset_to_rust_ratio), 4) AS overall_simd_asset_to_rust_ratio, {', '.join(f'round(avg(avg_simd_asset_vs_{n}_improvement_pct), 2) AS overall_simd_asset_vs_{n}_improvement_pct' for n in ASSETS)} FROM ({ASSET_SOURCES}) GROUP BY {RUN}"


def _all() -> dict[str, str]:
    out = {
        "candlestick_simplified_comparison": "SELECT run_id, benchmark_date, hostname, implementation_type AS forecast_name, input_size, options, round(avg(mean_time_ns)) AS avg_mean_time_ns, count(*) AS symbol_count, round(avg(std_dev_ns)) AS avg_std_dev_ns, min(min_time_ns) AS overall_min_time_ns, max(max_time_ns) AS overall_max_time_ns FROM rows_ WHERE indicator_name = 'Rust_Candlestick' GROUP BY ALL",
        "indicator_summary": "SELECT indicator_name AS name, description, category, input_count, output_count, has_options, count(run_id) AS benchmark_count, max(created_at) AS last_benchmarked FROM kinds LEFT JOIN results USING (indicator_id) GROUP BY ALL",
    }
    for prefix, where, labels, least, base, counts in (("", "true", LIBRARIES, 2, "rust", ("options", "symbol", "sample")), ("rust_impl_", "category <> 'candlestick'", VARIANTS, 1, None, ("", "symbol", "sample"))):
        wide, narrow = compared(labels, "", counts[0], False, least, base, where), compared(labels, "input_size, options", counts[1], False, least, base, where)
        out[f"{prefix}avg_options_comparison"], out[f"{prefix}simplified_comparison"] = wide, narrow
        out[f"{prefix}performance_comparison"] = compared(labels, f"{SERIES}, options", counts[2], True, least, base, where)
        times = {n: f"{n}_avg_mean_time_ns" for n in labels}
        ratios = {f"{n}_to_rust_ratio": (f"{n}_to_rust_ratio", f"{n}_ratio_change_pct") for n in labels[1:]} if base else {}
        out[f"{prefix}prev_avg_run_comparison"] = before(wide, times, ratios, also=["rust_options_count"] if base else [])
        out[f"{prefix}prev_run_comparison"] = before(narrow, times, ratios, ("input_size", "options"))
    out["rust_slower_indicators"] = slower(out["prev_avg_run_comparison"], ("c", "talib", "rustta"))
    out["rust_impl_slower_indicators"] = last(out["rust_impl_prev_avg_run_comparison"])
    for prefix, base in (("rust_simd", "rust"), ("rust_simd_c", "c")):
        out |= {f"{prefix}_performance_comparison": totals(base), f"{prefix}_simplified_comparison": sizes(base), f"{prefix}_avg_comparison": whole(base), f"{prefix}_prev_run_comparison": vector_before(base)}
    gains = {f"overall_simd_asset_vs_{n}_improvement_pct": (f"overall_simd_asset_vs_{n}_improvement_pct", f"simd_asset_vs_{n}_improvement_change_pct", 2) for n in ASSETS}
    change = before(ASSET_WHOLE, {"simd_asset": "rust_simd_asset_overall_avg_time_ns"}, {}, differences={"overall_simd_asset_to_rust_ratio": ("overall_simd_asset_to_rust_ratio", "simd_asset_to_rust_ratio_change", 4)} | gains)
    return out | {"rust_simd_asset_performance_comparison": ASSET_SERIES, "rust_simd_asset_simplified_comparison": ASSET_SOURCES, "rust_simd_asset_avg_comparison": ASSET_WHOLE, "rust_simd_asset_prev_run_comparison": change}


def sql(name: str) -> str:
    body = exact(ALL[name])
    times = {"indicator_summary": ("last_benchmarked",)}.get(name, ("benchmark_date", "prev_benchmark_date") if "prev" in name or "slower" in name else ("benchmark_date",))
    return f"WITH {BASE} SELECT * REPLACE ({', '.join(f'CAST({t} AS VARCHAR) AS {t}' for t in times)}) FROM ({body})"


ALL = _all()
