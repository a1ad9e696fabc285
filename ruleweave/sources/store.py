"""Content-addressed documents: raw bytes once per hash, and tables in version folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ruleweave.operators.ordered import keep_first
from ruleweave.schemas import TABLES
from ruleweave.sources import pointers


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Raw files with hash and size; the bytes stay in the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.col("path").alias("url"),
        F.col("modificationTime").alias("fetched_at"),
        F.col("length").alias("content_size_bytes"),
        F.sha2("content", 256).alias("content_sha256"),
        F.decode("content", "UTF-8").alias("body"),
    )


def address(fetched: DataFrame, body: str, source: str, order: Sequence[str]) -> DataFrame:
    """One row per (source, content hash), the first fetch naming it.

    The body is left behind before the shuffle; only its hash and size travel.
    """
    hashed = fetched.select(
        *[c for c in fetched.columns if c != body],
        F.sha2(F.col(body).cast("binary"), 256).alias("content_sha256"),
        F.octet_length(body).cast("long").alias("content_size_bytes"),
    )
    return keep_first(hashed, [source, "content_sha256"], list(order))


#: Hexadecimal digits of a hash that name its folder.
PREFIX = 2
BODIES = "content_sha256 string, content_size_bytes long, body binary, batch string, prefix string"


def storage_key(digest: Column | str, suffix: Column | str = ".bin") -> Column:
    """Where a body lies: folder of its hash's first digits, hash, suffix."""
    end = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.substring(digest, 1, PREFIX), F.lit("/"), digest, end)


def stored_bodies(spark: SparkSession, root: str) -> DataFrame | None:
    """All bodies of a store, None before the first is stored."""
    return spark.read.schema(BODIES).parquet(f"{root}/bodies") if pointers.exists(spark, f"{root}/bodies/_SUCCESS") else None


def store_bodies(fetched: DataFrame, body: str, root: str, batch: str) -> None:
    """Add the bodies of ``fetched`` that the store does not hold yet, each under its SHA-256.

    Folders are named by the first digits of the hash. A batch is compared with the hashes (no bodies)
    in the folders that it has bodies for, so it reads a part of the store that its own size bounds,
    and what is new is written once, however often it stands in the batch. A batch that is repeated,
    whole or after a crash, adds what is missing and nothing else. Null bodies are no bodies. Folders
    are written in parts of even size: one folder's bodies are not one task's.
    """
    spark = fetched.sparkSession
    content = F.col(body).cast("binary")
    hashed = fetched.filter(F.col(body).isNotNull()).select(F.sha2(content, 256).alias("content_sha256"), content.alias("body"))
    hashed = hashed.withColumn("prefix", F.substring("content_sha256", 1, PREFIX))
    stored = stored_bodies(spark, root)
    if stored is not None:
        asked = [row["prefix"] for row in hashed.select("prefix").distinct().collect()]  # 256 at most
        held = stored.filter(F.col("prefix").isin(asked)).select("prefix", "content_sha256")
        hashed = hashed.join(held, ["prefix", "content_sha256"], "left_anti")
    fresh = hashed.dropDuplicates(["content_sha256"]).select(
        "content_sha256", F.octet_length("body").cast("long").alias("content_size_bytes"), "body", F.lit(batch).alias("batch"), "prefix"
    )
    fresh.hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(f"{root}/bodies")


def read_bodies(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Bodies by the hashes in ``wanted`` (content_sha256), from the folders of those hashes only.

    Two batches that were stored at the same time may both have added a body; it is returned once.
    """
    keys = wanted.select("content_sha256").distinct().withColumn("prefix", F.substring("content_sha256", 1, PREFIX))
    stored = stored_bodies(spark, root)
    if stored is None:
        stored = spark.createDataFrame([], BODIES)
    found = stored.join(keys, ["prefix", "content_sha256"], "left_semi")
    return found.dropDuplicates(["content_sha256"]).select("content_sha256", "content_size_bytes", "body")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def write_table(df: DataFrame, root: str, name: str, version: str, partition_by: Sequence[str] = ()) -> str:
    """Write the next version of a table to a new folder; a job never overwrites what it reads."""
    path = f"{root.rstrip('/')}/{name}/version={version}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
