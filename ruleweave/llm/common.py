"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ruleweave.session import cut_lineage, ship

__all__ = ["by_rows", "cut", "free", "release", "ship"]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; the step's shuffle files can then be dropped."""
    return cut_lineage(df)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer until no column of ``df`` has them in any case of letters."""
    taken, out = {column.lower() for column in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def by_rows(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose binary or text column holds about ``most`` bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)
