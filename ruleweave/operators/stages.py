"""Evaluation barrier for expensive columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, keep: Sequence[str | Column], columns: dict[str, Column]) -> DataFrame:
    """Compute the columns exactly once, whatever is filtered or projected on top of them.

    The optimizer moves a filter below the projection it reads from and repeats the projected
    expressions inside it; a chain of such steps repeats its first expressions at every step. A
    one-element generator stays where it is, and a predicate on its output stays above it.
    """
    fields = [item for name, column in columns.items() for item in (F.lit(name), column)]
    return df.select(*keep, F.inline(F.array(F.named_struct(*fields))))
