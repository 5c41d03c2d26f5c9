"""Computing a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    Keeps the expression small also where Spark copies it, as it does when it
    pushes a filter on the result below a projection.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
