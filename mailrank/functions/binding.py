"""Use one computed value several times within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``, also from within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
