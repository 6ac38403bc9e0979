"""Scalar functions over columns, by name; all of them are Spark's own, so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SCALAR: dict[str, Callable[..., Column]] = {"abs": F.abs, "acos": F.acos, "ln": F.log, "exp": F.exp, "pow": F.pow, "sqrt": F.sqrt, "atan": F.atan, "sin": F.sin, "cos": F.cos}


def sin_cos(x: Column) -> tuple[Column, Column]:
    return F.sin(x), F.cos(x)


def rolling_sum(x: Column, period: int, by: str | Sequence[str] = "symbol", order: str | Sequence[str] = "ts") -> Column:
    """The sum of the last ``period`` values; null until there are as many."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*([order] if isinstance(order, str) else order))
    own = w.rowsBetween(-(period - 1), 0)
    return F.when(F.count(x).over(own) >= period, F.sum(x).over(own))
