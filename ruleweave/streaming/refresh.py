"""Incremental refresh: the batch operators driven by a file stream of fetched documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ruleweave.operators.generic import find_candidates
from ruleweave.operators.strict import rule_candidates, strict_rules
from ruleweave import vocab
from ruleweave.schemas import struct

FETCHED = struct(
    "target_id long, adapter_code string, adapter_version string, fetched_at timestamp, content string"
)


def fetched_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FETCHED)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def extract(batch: DataFrame) -> DataFrame:
    """Candidates of a batch of documents, strict formats by their reader, all others by the generic one.

    A document without an adapter is read like any other free text. A body that several targets share
    is read once per adapter and its rules go only to the targets of that adapter.
    """
    keep = ["target_id", "adapter_code", "adapter_version", "sha256"]
    is_strict = F.coalesce(F.col("adapter_code").isin(*vocab.STRICT_CODES), F.lit(False))
    strict = batch.filter(is_strict)
    found = find_candidates(batch.filter(~is_strict), keep, "content", "sha256")
    # As many rows as targets: the planner, which knows only the batch's compressed bytes, would broadcast them.
    owners = strict.select("sha256", "adapter_code", "target_id", "adapter_version").distinct().hint("merge")
    bodies = strict.select("sha256", "adapter_code", "content").dropDuplicates(["sha256", "adapter_code"])
    rules = rule_candidates(
        strict_rules(bodies, "sha256", "adapter_code", "content").join(owners, ["sha256", "adapter_code"]), "sha256"
    )
    return found.unionByName(
        rules.select(
            *keep, "candidate_key", "line_no", "source_locator", "source_excerpt", "payload_kind", "benefit_kind",
            "diploma_status", "subject_code", "min_score", "confidence", "olympiad_title", "profile_title",
            "programme_selector",
        )
    ).withColumn(
        "automatic_status",
        F.when(F.col("adapter_code").isin(*vocab.STRICT_CODES) | (F.col("confidence") == 100), "pending_resolution").otherwise(
            "not_applicable"
        ),
    )


SEEN = ["target_id", "adapter_version", "sha256"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changed(stream: DataFrame) -> DataFrame:
    """Fetched documents whose body is new for their target and adapter version, with its hash.

    What was seen is keyed state without a watermark: the first fetch of a body passes however old it
    is, and every later one is dropped. A batch looks up the keys that it holds and no others.
    """
    return stream.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(SEEN)


def start_refresh(
    stream: DataFrame, runs_path: str, candidates_path: str, checkpoint: str,
    reader: Callable[[DataFrame], DataFrame] = extract,
) -> StreamingQuery:
    """Process only bodies that their target has not had, appending candidates first and runs last.

    The hashes that each target and version has had are the query's state, in ``checkpoint``, kept on
    the executors' disks; the run table is written and never read. Output folders carry the batch id,
    so a batch repeated after a failure starts from the state before it and replaces its own files; a
    run row is written only when its candidates are complete.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.persist()  # written twice, and a batch of a stateful plan is computed once
        try:
            reader(fresh).write.mode("overwrite").parquet(f"{candidates_path}/batch_id={batch_id}")
            fresh.select(*SEEN).write.mode("overwrite").parquet(f"{runs_path}/batch_id={batch_id}")
        finally:
            fresh.unpersist()

    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKS)  # taken over by the query when it starts
    try:
        return (
            changed(stream).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(STATE_STORE, before)


def runs(spark: SparkSession, runs_path: str) -> DataFrame:
    """The run table: (target_id, adapter_version, sha256, batch_id)."""
    return spark.read.schema("target_id long, adapter_version string, sha256 string, batch_id long").parquet(runs_path)
