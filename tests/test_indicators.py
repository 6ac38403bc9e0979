"""Window expressions against step functions, chunks against whole series, first rows, and known answers."""

import math
import random

import pytest

from tickloom.functions.steps import STEPS
from tickloom.operators.frames import FRAMES
from tickloom.operators.indicators import crossover, indicator, pivotpoint, resume, sweep
from tickloom.operators.registry import INFO, catalog
from tickloom.functions.scans import SCANS
from tickloom.sources.bars import sound, synthetic


def series(n=90, seed=3):
    random.seed(seed)
    out, c = [], 100.0
    for k in range(n):
        o = c
        c = max(1.0, c + random.gauss(0, 1.5))
        out.append({"open": o, "high": max(o, c) + random.random(), "low": min(o, c) - random.random(), "close": c, "volume": float(random.randint(100, 200))})
    return out


def by_steps(name, rows, o):
    info, s, out = INFO[name], {"i": -1}, []
    for r in rows:
        s["i"] += 1
        out.append(STEPS[name](s, o, *(r["close" if k == "real" else k] for k in info.inputs)))
    return out


@pytest.fixture(scope="module")
def two(spark):
    a, b = series(), series(70, 8)
    rows = [("a", k, *r.values()) for k, r in enumerate(a)] + [("b", k, *r.values()) for k, r in enumerate(b)]
    random.seed(1)
    random.shuffle(rows)
    return {"a": a, "b": b}, spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume double").repartition(3).cache()


def close(x, y):
    return (x is None and y is None) or (x is not None and y is not None and (math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-8) or (math.isnan(x) and math.isnan(y))))


@pytest.mark.parametrize("name", sorted(FRAMES))
def test_frames_equal_steps(two, name):
    rows, df = two
    info = INFO[name]
    every = [*info.outputs, *info.optional]
    got = {(r["symbol"], r["ts"]): [r[f"x_{k}"] for k in every] for r in indicator(df, name, optional=True, names={k: f"x_{k}" for k in every}).collect()}
    for sym, own in rows.items():
        for k, want in enumerate(by_steps(name, own, info.defaults)):
            assert all(close(a, b) for a, b in zip(got[sym, k], want)), (name, sym, k, got[sym, k], want)


def test_first_rows_and_registry(spark):
    rows = series(120)
    for name, info in INFO.items():
        out = by_steps(name, rows, info.defaults)
        assert next(k for k, r in enumerate(out) if r[0] is not None) == info.first_row(), name
        assert info.min_data() == info.first_row() + 1
        assert info.output_length(120) == 120 - info.first_row()
    assert set(INFO) == set(STEPS) and len(INFO) == 70
    assert catalog(spark).count() == 70
    assert INFO["ema"].min_data_accuracy(6) > INFO["ema"].min_data()


@pytest.mark.parametrize("name", sorted(INFO))
def test_chunks_equal_whole(name):
    import json

    rows, info = series(110), INFO[name]
    whole = by_steps(name, rows, info.defaults)
    s, out = {"i": -1}, []
    for k, r in enumerate(rows):
        if k in (1, 2, 40, 77):
            s = json.loads(json.dumps(s))
        s["i"] += 1
        out.append(STEPS[name](s, info.defaults, *(r["close" if q == "real" else q] for q in info.inputs)))
    assert all(all(a == b or (a != a and b != b) for a, b in zip(x, y)) for x, y in zip(whole, out))


def test_resume_sweep_and_partitions(two):
    rows, df = two
    want = {(r["symbol"], r["ts"]): r["ema"] for r in indicator(df, "ema", 9).collect()}
    first = resume(df.where("ts < 33"), "ema", 9)
    states = first.where("state is not null").select("symbol", "state")
    assert states.count() == 2
    second = resume(df.where("ts >= 33"), "ema", 9, states=states)
    got = {(r["symbol"], r["ts"]): r["ema"] for r in first.drop("state").unionByName(second.drop("state")).collect()}
    assert got == want
    again = {(r["symbol"], r["ts"]): r["ema"] for r in indicator(df.repartition(7), "ema", 9).collect()}
    assert again == want
    s = sweep(df, "ema", [(9,), (3,)])
    assert {(r["symbol"], r["ts"]): r["ema"] for r in s.where("param_id = 0").collect()} == want
    assert s.count() == 2 * df.count()
    step = {(r["symbol"], r["ts"]): r["sma"] for r in indicator(df, "sma", 5, stepwise=True, trim=True).collect()}
    frame = {(r["symbol"], r["ts"]): r["sma"] for r in indicator(df, "sma", 5, trim=True).collect()}
    assert step.keys() == frame.keys() and all(close(step[k], frame[k]) for k in step)


def test_options_and_names(two):
    _, df = two
    for name, o in (("sma", (0,)), ("macd", (26, 12, 9)), ("bbands", (5, -1)), ("vidya", (2, 5, 1.5)), ("psar", (0.3, 0.2)), ("sma", (1, 2))):
        with pytest.raises(ValueError):
            indicator(df, name, *o)
    with pytest.raises(ValueError):
        indicator(df, "sma", 5, names={"sma": "close"})
    with pytest.raises(ValueError):
        indicator(df, "sma", 5, optional=["ema"])


def test_edges(spark):
    schema = "symbol string, ts int, open double, high double, low double, close double, volume double"
    empty = spark.createDataFrame([], schema)
    for name in ("sma", "ema", "psar", "hma"):
        assert indicator(empty, name).count() == 0
    holes = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, None, 1.0), ("a", None, 1.0, 1.0, 1.0, 2.0, 1.0), ("a", 3, 1.0, 1.0, 1.0, 3.0, 1.0)], schema)
    assert [r["ts"] for r in indicator(holes, "sma", 1).collect()] == [3]


def test_cross_and_pivot(spark):
    opens, closes = (5.0, 6.0, 6.0, 4.0, 7.0, 5.0, 5.0, 2.0), (4.0, 7.0, 6.0, 5.0, 3.0, 5.0, 6.0, 1.0)
    df = spark.createDataFrame([("x", k, a, max(a, b) + 1, min(a, b) - 1, b) for k, (a, b) in enumerate(zip(opens, closes))], "symbol string, ts int, open double, high double, low double, close double")
    got = [r["crossany"] for r in crossover(df, "close", "open", either=True).orderBy("ts").collect()]
    assert got == [None, 1, 0, 0, 1, 0, 0, 1]
    assert [r["crossover"] for r in crossover(df, "close", "open").orderBy("ts").collect()] == [None, 1, 0, 0, 0, 0, 0, 0]
    p = pivotpoint(df, 3).collect()[0]
    h, l, c = 7.0, 0.0, 1.0
    assert close(p["pp"], (h + l + c) / 3) and close(p["r3"], 2 * p["pp"] - l + h - l)
    assert pivotpoint(df, 9).count() == 0
    clash = pivotpoint(df.withColumnRenamed("symbol", "n").withColumnRenamed("ts", "h"), 3, by="n", order="h").collect()[0]
    assert clash["n"] == "x" and close(clash["pp"], p["pp"])
    s = synthetic(spark, bars=60)
    assert s.count() == 240 and sound(s).count() == 240 and s.exceptAll(synthetic(spark, bars=60)).count() == 0


def test_nan_has_one_rule(spark):
    nan = math.nan
    df = spark.createDataFrame([("x", k, a, b) for k, (a, b) in enumerate(((5.0, nan), (9.0, 3.0), (nan, 4.0), (2.0, 4.0), (5.0, 4.0)))], "symbol string, ts int, a double, b double")
    assert [r["crossover"] for r in crossover(df, "a", "b").orderBy("ts").collect()] == [None, 0, 0, 0, 1]
    bars = spark.createDataFrame([("x", k, v, v + 1, v - 1) for k, v in enumerate((3.0, nan, 4.0, 2.0, 7.0, 5.0, 6.0, 1.0))], "symbol string, ts int, close double, high double, low double")
    for name, o in (("max", (3,)), ("min", (3,)), ("willr", (2,)), ("stoch", (2, 1, 1))):
        out = INFO[name].outputs[0]
        a, b = ([r[out] for r in indicator(bars, name, *o, stepwise=s).orderBy("ts").collect()] for s in (False, True))
        assert all(close(x, y) for x, y in zip(a, b)), (name, a, b)
    assert [r["min"] for r in indicator(bars, "min", 3).orderBy("ts").collect()][4:] == [2.0, 2.0, 5.0, 1.0]


def test_any_column_names(spark):
    """Columns that are called as those inside: they come out as they went in."""
    names = ("u0", "x0", "bar", "out_0_0", "state", "after", "was", "_in_0", "_bar", "_stage_1", "stage_1", "one")
    rows = [("s", k, float(k * k % 7), *(float(100 * j + k) for j in range(len(names)))) for k in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts int, close double, " + ", ".join(f"{n} double" for n in names))
    plain = df.select("symbol", "ts", "close")
    for name in ("ema", "hma", "stochrsi"):
        want = [r[name] for r in indicator(plain, name, 3).orderBy("ts").collect()]
        got = indicator(df, name, 3).orderBy("ts").collect()
        assert [r[name] for r in got] == want
        assert [tuple(r[n] for n in names) for r in got] == [r[3:] for r in rows]
    s = sweep(df.withColumnRenamed("u0", "_set"), "ema", [(3,), (2,)]).where("param_id = 0").orderBy("ts").collect()
    assert [r["_set"] for r in s] == [r[3] for r in rows] and [r["ema"] for r in s] == [r["ema"] for r in indicator(plain, "ema", 3).orderBy("ts").collect()]
    first = resume(df.drop("state").where("ts < 5"), "ema", 3, by="symbol")
    assert first.where("state is not null").count() == 1
    with pytest.raises(ValueError, match="state"):
        resume(df, "ema", 3)
    with pytest.raises(ValueError, match="no column"):
        indicator(df, "ema", 3, columns={"real": "price"})
    renamed = df.withColumnRenamed("symbol", "x0x").withColumnRenamed("ts", "u1")
    assert [r["ema"] for r in indicator(renamed, "ema", 3, by="x0x", order="u1").orderBy("u1").collect()] == [r["ema"] for r in indicator(plain, "ema", 3).orderBy("ts").collect()]


OPTIONS = {1: [(1.0,), (2.0,), (3.0,), (7.0,)], 2: [(1.0, 2.0), (2.0, 9.0)], 3: [(1.0, 2.0, 1.0), (3.0, 5.0, 4.0)]}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans_equal_steps(name):
    """Whole arrays, in pieces of any length, against one bar at a time: outputs and states."""
    import json

    import numpy as np

    info = INFO[name]
    assert info.recursive
    some = {"vidya": [(2.0, 5.0, 0.5), (1.0, 2.0, 0.9)], "psar": [(0.02, 0.2), (0.1, 0.1)]}.get(name, OPTIONS.get(len(info.options), []))
    for kind in ("walk", "flat", "no volume", "whole numbers"):
        for n in (1, 2, 5, 40, 400):
            rows = series(n, n)
            if kind == "flat":
                rows = [dict.fromkeys(r, 50.0) for r in rows]
            elif kind == "no volume":
                rows = [r | {"volume": 0.0} for r in rows]
            elif kind == "whole numbers":
                rows = [{k: float(round(v)) for k, v in r.items()} for r in rows]
            x = [np.array([r["close" if k == "real" else k] for r in rows]) for k in info.inputs]
            for o in [info.defaults, *some]:
                s, t, got = {"i": -1}, {"i": -1}, []
                want = []
                for r in zip(*(a.tolist() for a in x)):
                    s["i"] += 1
                    want.append(STEPS[name](s, o, *r))
                random.seed(n)
                cuts = sorted({0, n, *(random.randint(0, n) for _ in range(3))})
                for a, b in zip(cuts, cuts[1:]):
                    out = SCANS[name](t, o, np.arange(a, b), *(v[a:b] for v in x))
                    t = json.loads(json.dumps(t | {"i": b - 1}))
                    got += zip(*([float(v) if ok else None for v, ok in zip(*c)] for c in out))
                assert len(got) == n and all(len(g) == len(w) and all(close(p, q) for p, q in zip(g, w)) for g, w in zip(got, want)), (kind, n, o)
                same = lambda p, q: len(p) == len(q) and all(close(a, b) for a, b in zip(p, q)) if isinstance(p, list) else p == q or close(float(p), float(q))
                s, t = ({k: v for k, v in d.items() if v is not None} for d in (s, t))
                assert s.keys() == t.keys() and all(same(s[k], t[k]) for k in s), (kind, n, o)


def test_scans_with_gaps_in_numbers(spark):
    """A run with a NaN or an infinity goes bar by bar, and gives what the steps give."""
    rows = [("x", k, math.nan if k == 30 else math.inf if k == 45 else float(k % 9)) for k in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts int, close double")
    s, want = {"i": -1}, []
    for r in rows:
        s["i"] += 1
        want.append(STEPS["ema"](s, (5.0,), r[2])[0])
    assert all(close(a["ema"], b) for a, b in zip(indicator(df, "ema", 5).orderBy("ts").collect(), want))
