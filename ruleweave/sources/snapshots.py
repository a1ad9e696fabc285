"""JSON snapshots: one document per file with a list of records, read and written whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ruleweave.sources import pointers


def read_records(spark: SparkSession, path: str, record: T.StructType, field: str = "records") -> DataFrame:
    """Records of ``{field: [...]}`` snapshot files; many files are read in parallel."""
    schema = T.StructType([T.StructField(field, T.ArrayType(record))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(field))


def parse_records(df: DataFrame, column: str, record: T.StructType, field: str, keep: Sequence[str]) -> DataFrame:
    """The same for snapshots that arrive as a text column."""
    schema = T.StructType([T.StructField(field, T.ArrayType(record))])
    parsed = df.select(*keep, F.from_json(F.col(column), schema).alias("_body"))
    return parsed.select(*keep, F.inline(F.col(f"_body.{field}")))


def write_versioned(df: DataFrame, root: str, version: str, order: Sequence[Column], files: int | None = None) -> str:
    """Write a snapshot into its own version folder and return the path the pointer should take.

    Rows are range-partitioned by the sort key, so the files concatenate in order without one task
    holding everything. The folder must be new: a failed job leaves the current version untouched.
    """
    path = f"{root.rstrip('/')}/version={version}"
    arranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    arranged.sortWithinPartitions(*order).write.mode("errorifexists").json(path)
    return path


def _pointers(root: str) -> str:
    return f"{root.rstrip('/')}/_current"


def publish_pointer(spark: SparkSession, root: str, path: str, after: int | None = None) -> int:
    """Point readers to a complete version and return the pointer's number.

    Pointers are numbered files that only one writer can make each, and the highest counts: a reader or
    a crash in between finds the version before. A writer that gives the number its snapshot was made
    ``after`` gets ``pointers.Conflict`` if another one was published since, and has to make it anew.
    """
    return pointers.commit(spark, _pointers(root), {"path": path}, after)


def current_number(spark: SparkSession, root: str) -> int:
    """Number of the pointer that counts, 0 before the first: what a writer gives back as ``after``."""
    found = pointers.current(spark, _pointers(root))
    return 0 if found is None else found[0]


def current_version(spark: SparkSession, root: str) -> str | None:
    found = pointers.current(spark, _pointers(root))
    return None if found is None else found[1]["path"]


def read_current(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    path = current_version(spark, root)
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).json(path)
