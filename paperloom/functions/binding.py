"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    Column expressions are trees: a value mentioned twice is there twice, and nested mentions
    multiply.  A one-element array and its element's name keep the tree small.
    """
    return F.transform(F.array(value), use)[0]
