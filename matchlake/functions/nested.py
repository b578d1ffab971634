"""Helpers for values inside a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: a one-element array binds it to a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
