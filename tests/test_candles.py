"""Candlesticks: one made window where a pattern is found and one where it isn't, filters and the empty table."""

import random

import pytest

from tickloom.operators import candlesticks as C

SCHEMA = "symbol string, ts int, open double, high double, low double, close double"


def falling(n=14, at=120.0):
    """Bars that fall by two, with bodies of two and wicks of a half."""
    return [(at - 2 * k, at - 2 * k + 0.5, at - 2 * k - 2.5, at - 2 * k - 2) for k in range(n)]


def rising(n=14, at=80.0):
    return [(at + 2 * k, at + 2 * k + 2.5, at + 2 * k - 0.5, at + 2 * k + 2) for k in range(n)]


CASES = {
    "BullishEngulfing": (falling() + [(91.5, 96.0, 91.0, 95.5)], falling() + [(92.5, 93.5, 91.8, 93.0)]),
    "BearishEngulfing": (rising() + [(108.5, 109.0, 103.0, 103.5)], rising() + [(107.5, 108.0, 106.5, 107.0)]),
    "Hammer": (falling() + [(91.0, 91.9, 89.0, 91.8)], falling() + [(91.0, 93.9, 90.9, 91.6)]),
    "FallingWindow": (falling() + [(88.0, 88.4, 85.5, 86.0), (84.0, 84.2, 81.9, 82.0)], falling() + [(91.9, 92.1, 90.0, 90.1)]),
    "ThreeBlackCrows": (rising() + [(107.0, 107.2, 103.8, 104.0), (105.5, 105.7, 101.8, 102.0), (103.5, 103.7, 99.8, 100.0)], rising() + [(107.0, 109.2, 106.8, 109.0)]),
    "MorningStar": (falling() + [(92.0, 92.3, 87.7, 88.0), (86.6, 87.0, 86.2, 86.8), (88.5, 91.8, 88.2, 91.5)], falling() + [(92.0, 92.3, 87.7, 88.0), (86.6, 87.0, 86.2, 86.8), (86.7, 87.2, 86.0, 86.9)]),
    "BullSidebySideWhiteLines": (rising() + [(108.0, 112.3, 107.8, 112.0), (113.0, 114.8, 112.8, 114.5), (113.05, 114.9, 112.9, 114.55)], rising() + [(108.0, 112.3, 107.8, 112.0), (113.0, 114.8, 112.8, 114.5), (113.6, 115.4, 113.4, 115.1)]),
    "BullishTriStar": (falling() + [(90.5, 91.0, 90.0, 90.5), (89.0, 89.5, 88.5, 89.0), (90.0, 90.5, 89.5, 90.0)], falling() + [(90.5, 91.0, 90.0, 90.5), (89.0, 89.5, 88.5, 89.0), (88.0, 88.5, 87.5, 88.0)]),
    "ConcealingBabySwallow": (falling() + [(91.5, 91.5, 89.0, 89.0), (90.0, 90.0, 86.5, 86.5), (86.0, 89.5, 85.5, 85.5), (90.0, 90.1, 84.9, 85.0)], falling() + [(91.5, 91.5, 89.0, 89.0), (90.0, 90.0, 86.5, 86.5), (86.0, 89.5, 85.5, 85.5), (89.0, 89.1, 84.9, 85.0)]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{name}{k}", ts, *map(float, b)) for name, both in CASES.items() for k, bars in enumerate(both) for ts, b in enumerate(bars)]
    df = C.scan(spark.createDataFrame(rows, SCHEMA), 5, 5, 3)
    out = {}
    for r in df.orderBy("symbol", "ts").collect():
        out[r["symbol"]] = r["patterns"]
    return out


@pytest.mark.parametrize("name", sorted(CASES))
def test_found_and_not(found, name):
    assert name in found[name + "0"]
    assert name not in found[name + "1"]


def test_lattice_has_nearly_all(spark):
    """On a coarse lattice of prices patterns fire that free prices hardly ever make. The named query has the same over line items, beside its SQL."""
    rng = random.Random(5)
    rows = []
    for s in range(30):
        close = 1000.0
        for t in range(2000):
            body = rng.choice((1, 1, 2, 2, 3, 0.5, 0, 0.5, -0.5, -1, -2, 5, 4)) * (1 if t // 9 % 2 else -1)
            opened = close + rng.choice((0, 0, 0, 0.5, -0.5, 1, -1, 1.5, -1.5, 2.5, -2.5, -4, 4))
            close = opened + body
            rows.append((f"s{s}", t, opened, max(opened, close) + rng.choice((0, 0, 0.5, 0.5, 1, 3, 0)), min(opened, close) - rng.choice((0, 0, 0.5, 0.5, 1, 3, 0)), close))
    found = {r["pattern"] for r in C.exploded(C.scan(spark.createDataFrame(rows, SCHEMA), 5, 3, 3)).select("pattern").distinct().collect()}
    assert len(found | set(CASES)) >= 75, sorted({p.name for p in C.ALL} - found)


def test_any_column_names(spark):
    rows = [("x", ts, *map(float, b), 1, 2, 3, 4) for ts, b in enumerate(CASES["MorningStar"][0])]
    df = spark.createDataFrame(rows, "_o string, _n int, open double, high double, low double, close double, _type int, _m0 int, u0 int, x0 int")
    out = C.scan(df, 5, 5, 3, by=["_o"], order=["_n"]).orderBy("_n").collect()
    assert "MorningStar" in out[-1]["patterns"] and (out[-1]["_type"], out[-1]["_m0"], out[-1]["u0"], out[-1]["x0"]) == (1, 2, 3, 4)
    assert "MorningStar" in {r["pattern"] for r in C.exploded(C.scan(df, 5, 5, 3, by=["_o"], order=["_n"]), ["_o"], ["_n"]).collect()}


def test_series_over_batches(spark):
    """The same bars in batches of three rows: what is carried from batch to batch is complete."""
    rows = [(f"{name}", ts, *map(float, b)) for name, both in CASES.items() for ts, b in enumerate(both[0])]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = {(r["symbol"], r["ts"]): r["patterns"] for r in C.scan(df, 5, 5, 3).collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = {(r["symbol"], r["ts"]): r["patterns"] for r in C.scan(df, 5, 5, 3).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == want


def test_table():
    kinds = [len(p.bars) for p in C.ALL]
    assert len(C.ALL) == 77 and [kinds.count(k) for k in (1, 2, 3, 4)] == [12, 34, 28, 3]
    assert all(p.forecast in C.FORECASTS for p in C.ALL)
    assert C.first_row(5, 3, 3) == 11 and C.first_row(9, 1, 1) == 13


def test_forecast_and_edges(spark):
    rows = [("x", ts, *map(float, b)) for ts, b in enumerate(CASES["BullishEngulfing"][0])]
    df = spark.createDataFrame(rows, SCHEMA)
    only = C.exploded(C.scan(df, forecast="BullishReversal")).collect()
    assert {r["forecast"] for r in only} == {"BullishReversal"}
    assert C.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    early = C.scan(df).where("ts < 9").select("patterns").collect()
    assert all(r["patterns"] is None for r in early[: C.first_row(5, 1, 1)])
    with pytest.raises(ValueError):
        C.scan(df, forecast="Sideways")
    with pytest.raises(ValueError):
        C.scan(df, 0)
