"""Arithmetic on columns with missing values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part, whole, scale: float = 100.0) -> Column:
    """part / whole * scale; missing when the whole is 0 or missing."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(part, whole) * F.lit(scale)


def clip(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bound a value; a missing value stays missing."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Replace a key by its entry in a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def total(value: Column | str) -> Column:
    """Sum that is 0 for a group of missing values."""
    return F.coalesce(F.sum(value), F.lit(0.0))
