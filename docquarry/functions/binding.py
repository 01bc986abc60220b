"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    A Column that is mentioned twice is computed twice wherever code generation
    does not reach, as in array functions.  Binding it as a lambda variable
    avoids that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
