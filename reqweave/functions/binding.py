"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    For long expressions that use a value many times. Spelled out, those become
    generated methods beyond the 8000 bytes up to which the JVM compiles them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
