"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it.

    Plain column reuse is inlined by the optimizer, which repeats costly expressions.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
