"""Binding of intermediate values in native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    A column that stands inside a lambda is computed for each element of the
    array; a lambda variable is not, so one-element transform() is a binding.
    """
    return F.transform(F.array(value), body)[0]
