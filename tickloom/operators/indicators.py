"""Indicators over bars in a DataFrame: any number of series, and any number of option sets."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import SCANS
from ..functions.steps import STEPS
from .frames import FRAMES, Stage
from .registry import INFO, Info

def inputs_of(info: Info, columns: dict[str, str] | None) -> list[str]:
    """Columns of an indicator's inputs: those named, else 'real' is the close and the others go by their own names."""
    chosen = {"real": "close"} | (columns or {})
    return [chosen.get(k, k) for k in info.inputs]


def wanted(info: Info, optional: Sequence[str] | bool) -> list[str]:
    own = list(info.optional) if optional is True else list(optional or ())
    if unknown := set(own) - set(info.optional):
        raise ValueError(f"{info.name} has no optional outputs {sorted(unknown)}; it has {list(info.optional)}")
    return [*info.outputs, *(k for k in info.optional if k in own)]


class Series:
    """Bars under names of our own, whatever the user's are: u0, u1, ... for the user's columns, x0, x1, ... for the inputs as doubles. Bars with a null in what is used are left out."""

    def __init__(self, df: DataFrame, inputs: list[str], by: list[str], order: list[str]):
        own = {c: f"u{k}" for k, c in enumerate(df.columns)}
        for c in [*inputs, *by, *order]:
            if c not in own:
                raise ValueError(f"there is no column {c!r} among {df.columns}")
        self.names, self.by, self.order = own, [own[c] for c in by], [own[c] for c in order]
        self.inputs = [f"x{k}" for k in range(len(inputs))]
        used = dict.fromkeys([*inputs, *order])
        whole = df.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())).where(" and ".join(f"{own[c]} is not null" for c in used) or "true")
        self.df = whole.withColumns({f"x{k}": F.col(own[c]).cast("double") for k, c in enumerate(inputs)})

    def restored(self) -> list[Column]:
        return [F.col(n).alias(c) for c, n in self.names.items()]


def _frame_outputs(own: Series, info: Info, sets: list[tuple[float, ...]]) -> tuple[DataFrame, list[list[Column]]]:
    """Outputs for each option set, over one sort of the series."""
    t = Stage(own.df.withColumn("bar", F.row_number().over(Window.partitionBy(*own.by).orderBy(*own.order)) - 1), own.by, own.order, "bar")
    x = [F.col(k) for k in own.inputs]
    out = []
    for o in sets:
        columns = FRAMES[info.name](t, o, *x)
        first = F.lit(info.first_row(*o))
        n = len(info.outputs)
        shown = [F.when(t.number >= first, t.keep(c)) for c in columns[:n]] + [t.keep(c) for c in columns[n:]]
        if info.name not in ("ao", "cci", "fosc", "vosc", "dpo", "mfi", "emv"):  # their optional outputs have beginnings of their own
            shown = shown[:n] + [F.when(t.number >= first, c) for c in shown[n:]]
        out.append(shown)
    return t.df, out


def _advance(info: Info, state: dict, o: tuple[float, ...], x: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The outputs of consecutive bars of one series, as (values, whether there is one); the state moves on. Whole arrays where the indicator has a scan, a step for each bar otherwise, and where a value isn't finite."""
    n, start = len(x[0]), state["i"] + 1
    if info.name in SCANS and all(np.isfinite(a).all() for a in x):
        out = SCANS[info.name](state, o, np.arange(start, start + n), *x)
        state["i"] = start + n - 1
        return out
    run_step, rows = STEPS[info.name], []
    for values in zip(*(a.tolist() for a in x)):
        state["i"] += 1
        rows.append(run_step(state, o, *values))
    columns = list(zip(*rows))
    return [(np.array([math.nan if v is None else v for v in c], float), np.array([v is not None for v in c], bool)) for c in columns]


def _kernel(info: Info, sets: list[tuple[float, ...]], by: int, inputs: list[int], names: list[str], carry: bool, state_at: int | None):
    """Runs over rows sorted by series; keeps one state for each option set. ``carry``: the last bar of a series also gets the states, as JSON."""
    count = len(info.outputs) + len(info.optional)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states, held = None, [], None

        def finish(b: pa.RecordBatch, columns: list[pa.Array], marks: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, *columns, *([pa.array(marks, pa.string())] if carry else [])], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            starts = heads([b.column(k) for k in range(by)], b.num_rows)
            x = [b.column(k).to_numpy(zero_copy_only=False) for k in inputs]
            marks: list = [None] * b.num_rows
            parts: list[list] = [[] for _ in range(len(sets) * count)]
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                key = tuple(b.column(k)[a].as_py() for k in range(by))
                if key != current:
                    if carry and states:
                        if a:
                            marks[a - 1] = json.dumps(states)
                        elif held:
                            held[2][-1] = json.dumps(states)
                    current = key
                    was = b.column(state_at)[a].as_py() if state_at is not None else None
                    states = json.loads(was) if was else [{"i": -1} for _ in sets]
                for k, (s, o) in enumerate(zip(states, sets)):
                    for j, out in enumerate(_advance(info, s, o, [v[a:z] for v in x])):
                        parts[k * count + j].append(out)
            columns = [pa.array(np.concatenate([v for v, _ in p]), pa.float64(), mask=~np.concatenate([ok for _, ok in p])) for p in parts]
            if held:
                yield finish(*held)
            held = (b, columns, marks)
            if not carry:
                yield finish(*held)
                held = None
        if held:
            held[2][-1] = json.dumps(states)
            yield finish(*held)

    return run


def heads(keys: list[pa.Array], n: int) -> list[int]:
    """Where the rows of a new series begin. Keys of equal rows are equal or both null."""
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        a, b = k.slice(0, n - 1), k.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def _kernel_outputs(own: Series, info: Info, sets: list[tuple[float, ...]], carry: bool = False, state: str | None = None) -> tuple[DataFrame, list[list[str]]]:
    """A series' bars stream through one task in order; memory holds its state and a batch."""
    count = len(info.outputs) + len(info.optional)
    columns = [*own.by, *(c for c in own.df.columns if c not in own.by)]
    dealt = (own.df.repartition(*own.by) if own.by else own.df.repartition(1)).sortWithinPartitions(*own.by, *own.order).select(*columns)
    produced = [[f"out_{k}_{j}" for j in range(count)] for k in range(len(sets))]
    flat = [c for p in produced for c in p]
    names = [*columns, *flat, *(["after"] if carry else [])]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema] + [f"{c} double" for c in flat] + ["after string"] * carry)
    run = _kernel(info, sets, len(own.by), [columns.index(c) for c in own.inputs], names, carry, columns.index(state) if state else None)
    return dealt.mapInArrow(run, schema), produced


def _parts(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def indicator(df: DataFrame, name: str, *options: float, by: str | Sequence[str] = "symbol", order: str | Sequence[str] = "ts", columns: dict[str, str] | None = None, optional: Sequence[str] | bool = (), names: dict[str, str] | None = None, trim: bool = False, stepwise: bool = False) -> DataFrame:
    """The bars with an indicator's outputs as further columns; null while it warms up, or those bars left out (``trim``).

    Names of the user's columns don't matter: inside, all have names of their own. ``columns``: input -> column; ``optional``: optional outputs to add; ``names``: output -> new column. Bars with a null input or order are left out; NaN goes through as it comes. ``stepwise`` takes the step function where a window frame would do. Series are independent; rows of equal order are taken as they come, so the order should be unique in a series.
    """
    info = INFO[name]
    o = info.check(options)
    by, order = _parts(by), _parts(order)
    outputs = wanted(info, optional)
    named = {k: (names or {}).get(k, k) for k in outputs}
    if clash := set(named.values()) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist; give new ones in names=")
    own = Series(df, inputs_of(info, columns), by, order)
    every = [*info.outputs, *info.optional]
    if name in FRAMES and not stepwise:
        done, (cols,) = _frame_outputs(own, info, [o])
    else:
        done, (produced,) = _kernel_outputs(own, info, [o])
        cols = [F.col(c) for c in produced]
    out = done.select(*own.restored(), *(cols[every.index(k)].alias(named[k]) for k in outputs))
    return out.where(f"`{named[info.outputs[0]]}` is not null") if trim else out


def sweep(df: DataFrame, name: str, sets: Sequence[Sequence[float]], by: str | Sequence[str] = "symbol", order: str | Sequence[str] = "ts", columns: dict[str, str] | None = None, optional: Sequence[str] | bool = ()) -> DataFrame:
    """An indicator under several option sets: the bars once for each set, with ``param_id``. The series are sorted and read once."""
    info = INFO[name]
    checked = [info.check(tuple(o)) for o in sets]
    by, order = _parts(by), _parts(order)
    outputs = wanted(info, optional)
    every = [*info.outputs, *info.optional]
    if clash := {"param_id", *outputs} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    own = Series(df, inputs_of(info, columns), by, order)
    if name in FRAMES:
        done, cols = _frame_outputs(own, info, checked)
    else:
        done, produced = _kernel_outputs(own, info, checked)
        cols = [[F.col(c) for c in p] for p in produced]
    packed = F.array(*(F.struct(F.lit(k).alias("param_id"), *(c[every.index(n)].alias(n) for n in outputs)) for k, c in enumerate(cols)))
    kept = done.select(*own.names.values(), F.explode(packed).alias("one"))
    return kept.select(*own.restored(), F.col("one.param_id").alias("param_id"), *(F.col(f"one.{n}").alias(n) for n in outputs))


def resume(df: DataFrame, name: str, *options: float, states: DataFrame | None = None, by: str | Sequence[str] = "symbol", order: str | Sequence[str] = "ts", columns: dict[str, str] | None = None, optional: Sequence[str] | bool = ()) -> DataFrame:
    """As ``indicator``, from the states that an earlier call left, with ``state`` on each series' last bar: JSON that the next call takes.

    ``states``: (by..., state), at most one row for each series; series without a row begin anew. Fed in chunks, a series gives what it gives in one piece.
    """
    info = INFO[name]
    o = info.check(options)
    by, order = _parts(by), _parts(order)
    outputs = wanted(info, optional)
    every = [*info.outputs, *info.optional]
    if clash := {"state", *outputs} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    own = Series(df, inputs_of(info, columns), by, order)
    if states is not None:
        own.df = own.df.join(states.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(by, own.by)), F.col("state").alias("was")), own.by, "left")
    else:
        own.df = own.df.withColumn("was", F.lit(None).cast("string"))
    done, (produced,) = _kernel_outputs(own, info, [o], carry=True, state="was")
    return done.select(*own.restored(), *(F.col(produced[every.index(k)]).alias(k) for k in outputs), F.col("after").alias("state"))


def crossover(df: DataFrame, a: str, b: str, by: str | Sequence[str] = "symbol", order: str | Sequence[str] = "ts", either: bool = False, name: str | None = None) -> DataFrame:
    """1.0 where a crosses above b (or either way) from the bar before, else 0.0; null on a series' first bar. Equality on the bar before is no crossing, nor is anything where one of the four values is NaN."""
    w = Window.partitionBy(*_parts(by)).orderBy(*_parts(order))
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    hit = (px < py) & (x > y)
    if either:
        hit = hit | ((px > py) & (x < y))
    numbers = ~(F.isnan(x) | F.isnan(y) | F.isnan(px) | F.isnan(py))
    return df.withColumn(name or ("crossany" if either else "crossover"), F.when(px.isNotNull() & py.isNotNull(), (hit & numbers).cast("double")))


def pivotpoint(df: DataFrame, period: int = 1, by: str | Sequence[str] = "symbol", order: str | Sequence[str] = "ts", high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    """One row for each series with at least ``period`` bars: s3, s2, s1, pp, r1, r2, r3 of its last bars."""
    if period < 1:
        raise ValueError(f"pivotpoint: period is {period}")
    by, order = _parts(by), _parts(order)
    keys = [f"b{k}" for k in range(len(by))]
    own = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)), F.struct(*order).alias("at"), *(F.col(f"`{c}`").cast("double").alias(k) for c, k in ((high, "h"), (low, "l"), (close, "c"))))
    last = own.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("at").desc()))).where(F.col("n") <= period)
    g = last.groupBy(*keys).agg(F.max("h").alias("h"), F.min("l").alias("l"), F.min_by("c", "n").alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") == period)
    pp, r = (F.col("h") + F.col("l") + F.col("c")) / 3, F.col("h") - F.col("l")
    s1, r1 = 2 * pp - F.col("h"), 2 * pp - F.col("l")
    return g.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), (s1 - r).alias("s3"), (pp - r).alias("s2"), s1.alias("s1"), pp.alias("pp"), r1.alias("r1"), (pp + r).alias("r2"), (r1 + r).alias("r3"))
