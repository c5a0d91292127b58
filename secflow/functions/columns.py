"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is computed once a row, however often ``use`` names it."""
    return F.transform(F.array(column), use)[0]
