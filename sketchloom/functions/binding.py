"""Values that are computed once and used many times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value bound to a variable.

    A column that only a lambda reads may be inlined into it by the optimizer
    and then be computed again for each element; a bound value is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
