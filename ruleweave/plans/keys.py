"""Reproducible surrogate keys in place of identity columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ruleweave.functions.text import col


def surrogate(*parts: Column | str) -> Column:
    """Positive 63-bit key of the natural key; the same rows get the same key in every run."""
    return F.xxhash64(*[F.coalesce(col(part).cast("string"), F.lit("\x00")) for part in parts]).bitwiseAND(
        F.lit(0x7FFFFFFFFFFFFFFF)
    )
