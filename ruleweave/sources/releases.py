"""Versions of several tables that become visible together."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ruleweave.schemas import TABLES
from ruleweave.sources import pointers


def _manifests(root: str) -> str:
    return f"{root.rstrip('/')}/_releases"


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the release that counts and the folder of each of its tables; 0 and none before the first."""
    found = pointers.current(spark, _manifests(root))
    return (0, {}) if found is None else (found[0], found[1]["tables"])


def read(spark: SparkSession, root: str, names: Iterable[str] | None = None, release: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of one release (the current one unless given), all of the same commit; a table it lacks is empty."""
    folders = current(spark, root)[1] if release is None else release
    wanted = folders if names is None else names
    return {
        name: spark.read.schema(TABLES[name]).parquet(folders[name]) if name in folders else spark.createDataFrame([], TABLES[name])
        for name in wanted
    }


def _sums(frame: DataFrame) -> list[Column]:
    """Size and order-free checksums of a table's rows."""
    row = F.xxhash64(*frame.columns)
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("xor"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("sum")]


def _digest(frame: DataFrame) -> dict:
    return frame.agg(*_sums(frame)).first().asDict()


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], after: int) -> int:
    """Write new versions of some tables and make them visible with one manifest; return the number that counts.

    Every table goes to a folder of its own that no release names yet; the manifest, made last and only
    if the release that the tables were made ``after`` is still the current one, names them together
    with the folders of the tables that stay. Until then, and if anything fails or another release came
    first (``pointers.Conflict``), readers see the release before and the new folders belong to nobody.
    A table whose rows are those of the release before keeps its folder; if all do, there is no new
    release, so the same work done twice is published once. The manifest holds the checksums of the
    tables, taken while they are written, so neither version is read for the comparison; those that it
    lacks are taken from the folder.
    """
    found = pointers.current(spark, _manifests(root))
    number, entry = found or (0, {"tables": {}})
    if number != after:
        raise pointers.Conflict(f"{root} has moved on from {after}")
    folders, digests, changed = entry["tables"], dict(entry.get("digests", {})), {}
    for name, frame in tables.items():
        schema = TABLES[name]
        folder = f"{root.rstrip('/')}/{name}/version={uuid.uuid4().hex}"
        shaped, written = frame.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema]), Observation()
        shaped.observe(written, *_sums(shaped)).write.parquet(folder)
        if name in folders and name not in digests:
            digests[name] = _digest(spark.read.schema(schema).parquet(folders[name]))
        if name not in folders or written.get != digests[name]:
            changed[name], digests[name] = folder, written.get
    return pointers.commit(spark, _manifests(root), {"tables": folders | changed, "digests": digests}, after) if changed else number
