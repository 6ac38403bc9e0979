"""Reports over small benchmark tables, by hand; the named queries compare all of them with SQL."""

import datetime as dt

import pytest

from tickloom.plans import report, report_sql

RESULTS = "id long, run_id long, indicator_id long, implementation_type string, stock_symbol string, data_source string, options string, mean_time_ns long, std_dev_ns long, min_time_ns long, max_time_ns long, sample_count int, input_size int, created_at timestamp"


@pytest.fixture(scope="module")
def tables(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    runs = spark.createDataFrame([(1, t(1), '{"hostname": "a"}'), (2, t(3), '{"hostname": "a"}'), (3, t(4), "{}")], "id long, run_timestamp timestamp, system_info string")
    ind = spark.createDataFrame([(1, "ema", "d", 1, 1, True, "trend"), (2, "idle", "d", 1, 1, False, "price"), (3, "Rust_Candlestick", "d", 4, 1, True, "candlestick")], "id long, name string, description string, input_count int, output_count int, has_options boolean, category string")
    rows, n = [], 0
    for run, scale in ((1, 1), (2, 2), (3, 3)):
        for kind, time in (("Rust", 100), ("ours-c", 250), ("RustTa", 0), ("Rust_optional", 130), ("Rust_SIMD", 80), ("Rust_SIMD_by_assets", 90)):
            for sym in ("x", "y"):
                for o in ("[7]", "[14]"):
                    if kind == "Rust_SIMD" and o == "[7]":
                        continue
                    n += 1
                    rows.append((n, run, 1, kind, sym, "db", o, time * scale + (sym == "y"), 1, time, time, 10, 500, t(run)))
    rows.append((99, 1, 3, "BullishReversal", "x", "db", "[5]", 40, 2, 30, 50, 10, 500, t(1)))
    return runs, spark.createDataFrame(rows, RESULTS), ind


def test_views_by_hand(tables):
    v = report.views(*tables, values=report.VALUES | {"c": "ours-c"})
    assert set(v) == set(report_sql.ALL) and len(v) == 26
    first = {r["run_id"]: r for r in v["avg_options_comparison"].collect()}
    assert first[1]["rust_avg_mean_time_ns"] == 101.0 and first[1]["c_avg_mean_time_ns"] == 251.0  # 100.5 and 250.5
    assert first[1]["rust_options_count"] == 2 and first[1]["talib_avg_mean_time_ns"] is None and first[1]["talib_options_count"] == 0
    assert first[1]["c_to_rust_ratio"] == 2.49 and first[1]["rust_vs_c_percent_diff"] == -59.88 and first[3]["hostname"] is None
    assert v["simplified_comparison"].where("run_id = 1").count() == 2 and v["performance_comparison"].where("run_id = 1").count() == 4
    assert v["performance_comparison"].where("run_id = 1 and stock_symbol = 'x'").select("rustta_to_rust_ratio", "rust_vs_rustta_percent_diff").collect()[0] == (0.0, None)  # nothing is divided by 0
    p = v["prev_avg_run_comparison"].collect()
    assert len(p) == 1 and p[0]["prev_run_id"] == 1 and p[0]["days_between_runs"] == 2.0 and p[0]["rust_performance_change_pct"] == 99.01  # 201 after 101
    assert v["rust_slower_indicators"].select("rust_slower_than_rustta_by_pct", "rust_slower_than_c_by_pct").collect()[0][1] is None
    assert v["rust_impl_avg_options_comparison"].where("run_id = 2").collect()[0]["rust_optional_avg_mean_time_ns"] == 261.0
    assert [r["run_id"] for r in v["rust_impl_slower_indicators"].collect()] == [2]
    s = v["rust_simd_performance_comparison"].where("run_id = 1 and stock_symbol = 'x'").collect()[0]
    assert (s["rust_total_mean_time_ns"], s["rust_options_count"], s["rust_simd_mean_time_ns"], s["simd_to_rust_ratio"], s["simd_speedup_vs_rust"]) == (200, 2, 80, 0.4, 2.5)
    assert v["rust_simd_simplified_comparison"].where("run_id = 1").collect()[0]["rust_stock_count"] == 2
    assert v["rust_simd_c_avg_comparison"].where("run_id = 1").collect()[0]["total_c_measurements"] == 2
    assert v["rust_simd_asset_performance_comparison"].where("run_id = 1 and options = '[7]'").collect()[0]["rust_total_mean_time_ns"] == 201
    assert v["rust_simd_prev_run_comparison"].count() == 1 and v["rust_simd_asset_prev_run_comparison"].count() == 1
    assert v["candlestick_simplified_comparison"].collect()[0]["avg_mean_time_ns"] == 40
    assert {r["name"]: r["benchmark_count"] for r in v["indicator_summary"].collect()} == {"ema": 66, "idle": 0, "Rust_Candlestick": 1}


def test_order_and_empty_tables(tables, spark):
    runs, results, ind = tables
    v = report.views(runs, results.limit(0), ind)
    assert all(df.count() == (3 if name == "indicator_summary" else 0) for name, df in v.items())
    v = report.views(*tables)
    assert [r["run_id"] for r in report.ordered("rust_impl_avg_options_comparison", v["rust_impl_avg_options_comparison"]).collect()] == [3, 2, 1]
    assert [r["name"] for r in report.ordered("indicator_summary", v["indicator_summary"]).collect()] == ["Rust_Candlestick", "idle", "ema"]


def test_decimal_ties(spark):
    df = spark.createDataFrame([(0.145,), (1.005,), (-2.675,), (0.14499,), (None,)], "x double")
    assert [r[0] for r in df.select(report.rounded(df.x, 2)).collect()] == [0.15, 1.01, -2.68, 0.14, None]
