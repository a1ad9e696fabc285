"""Polling, run states and logs. Time is always an argument, so every result is reproducible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.operators.merge import insert_missing, upsert
from ruleweave.operators.ordered import top_per_key


def _hours(value: Column | int) -> Column:
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, zero, F.lit(value) if isinstance(value, int) else value)


def due_targets(
    targets: DataFrame, runs: DataFrame, key: str, as_of: Column, *, adapters: Sequence[str] = (),
    excluded: Sequence[int] = (), force: bool = False, limit: int | None = None, stale_hours: int = 1,
) -> DataFrame:
    """Active targets that are due and not being worked on, oldest first.

    ``targets`` has is_active, next_check_at, adapter_code; ``runs`` has status and started_at. A run
    that has been running for longer than ``stale_hours`` no longer blocks its target.
    """
    due = targets.filter("is_active")
    if adapters:
        due = due.filter(F.col("adapter_code").isin(*adapters))
    if excluded:
        due = due.filter(~F.col(key).isin(*excluded))
    if not force:
        due = due.filter(F.col("next_check_at").isNull() | (F.col("next_check_at") <= as_of))
    busy = runs.filter((F.col("status") == "running") & (F.col("started_at") > as_of - _hours(stale_hours)))
    queue = due.join(busy.select(key).distinct(), key, "left_anti")
    if limit is None:
        return queue
    return queue.orderBy(F.col("next_check_at").asc_nulls_first(), F.col(key).asc()).limit(limit)


def bump_schedule(targets: DataFrame, checked: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Move checked targets to their next poll, whether the check succeeded, failed or was deferred.

    ``checked`` may carry document_id, the document of a successful check.
    """
    seen = checked.select(key, F.lit(True).alias("_seen"), *(["document_id"] if "document_id" in checked.columns else []))
    hit = F.coalesce(F.col("_seen"), F.lit(False))
    joined = targets.join(seen, key, "left").withColumns(
        {
            "last_checked_at": F.when(hit, as_of).otherwise(F.col("last_checked_at")),
            "next_check_at": F.when(hit, as_of + _hours(F.col("poll_interval_hours"))).otherwise(F.col("next_check_at")),
        }
    )
    if "document_id" in checked.columns and "last_successful_document_id" in targets.columns:
        joined = joined.withColumn(
            "last_successful_document_id",
            F.coalesce(F.when(hit, F.col("document_id")), F.col("last_successful_document_id")),
        )
    return joined.select(*targets.columns)


def latest_documents(documents: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest stored document per key, later order columns breaking ties."""
    return top_per_key(documents, keys, [F.desc_nulls_last(c) for c in order])


def run_actions(
    fetched: DataFrame, documents: DataFrame, runs: DataFrame, version: str = "adapter_version"
) -> DataFrame:
    """What to do with each fetched body: skip, retry, new_run or new_document.

    ``fetched`` (target_id, source_id, sha256, adapter_version); ``documents`` (document_id,
    source_id, sha256, fetched_at); ``runs`` (run_id, target_id, document_id, adapter_version, status).
    The anti-pattern of parsing first is avoided: unchanged, already parsed bodies stop here.
    """
    prior = latest_documents(documents, ["source_id", "sha256"], ["fetched_at", "document_id"]).select(
        "source_id", "sha256", "document_id"
    )
    states = runs.groupBy("target_id", "document_id", version).agg(
        F.max("run_id").alias("run_id"), F.bool_or(F.col("status") == "succeeded").alias("_done")
    )
    joined = fetched.join(prior, ["source_id", "sha256"], "left").join(
        states, ["target_id", "document_id", version], "left"
    )
    action = (
        F.when(F.col("document_id").isNull(), "new_document")
        .when(F.coalesce(F.col("_done"), F.lit(False)), "skip")
        .when(F.col("run_id").isNotNull(), "retry")
        .otherwise("new_run")
    )
    return joined.withColumn("action", action).drop("_done")


def supersede_pending(candidates: DataFrame, runs: DataFrame, current_runs: DataFrame) -> DataFrame:
    """Pending candidates of earlier runs of the re-read targets become superseded.

    ``candidates`` (run_id, review_status, ...), ``runs`` (run_id, target_id), ``current_runs``
    (target_id, current_run_id), one row per re-read target.
    """
    owners = runs.select("run_id", "target_id").join(current_runs, "target_id").select("run_id", "current_run_id")
    joined = candidates.join(owners, "run_id", "left")
    stale = (F.col("review_status") == "pending") & (F.col("run_id") != F.col("current_run_id"))
    return joined.withColumn(
        "review_status", F.when(F.coalesce(stale, F.lit(False)), "superseded").otherwise(F.col("review_status"))
    ).select(*candidates.columns)


def publish_queue(candidates: DataFrame, limit: int | None = None, codes: Sequence[str] = vocab.STRICT_CODES) -> DataFrame:
    """Candidates for automatic publication, new ones before earlier blocked ones, then first in first out."""
    waiting = candidates.filter(
        (F.col("review_status") == "pending")
        & F.col("automatic_status").isin("pending_resolution", "blocked")
        & (F.col("adapter_code").isin(*codes) | (F.col("confidence") == 100))
    ).withColumn("queue_class", F.when(F.col("automatic_status") == "pending_resolution", 0).otherwise(1))
    if limit is None:
        return waiting
    return waiting.orderBy("queue_class", "created_at", "candidate_id").limit(limit)


def run_counters(runs: DataFrame, results: DataFrame, key: str, published: Column) -> DataFrame:
    """records_seen and rows published per run; a run without results counts zero."""
    counted = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("records_seen"), F.count_if(published).alias("rows_published")
    )
    return runs.join(counted, key, "left").na.fill(0, ["records_seen", "rows_published"])


def observe(log: DataFrame, seen: DataFrame, keys: Sequence[str] = ("rule_id", "document_id")) -> DataFrame:
    """Observation log with one row per (rule, document), the newest observation replacing it."""
    return upsert(log, seen, keys)


def due_reminders(jobs: DataFrame, trackers: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """Oldest unsent reminders whose time has come and whose tracker is active."""
    ready = jobs.filter(F.col("sent_at").isNull() & (F.col("scheduled_for") <= as_of))
    active = trackers.filter("is_active").drop("is_active")
    return ready.join(active, "tracker_id").orderBy("scheduled_for", "job_id").limit(limit)


def mark_sent(jobs: DataFrame, delivered: DataFrame, as_of: Column) -> DataFrame:
    """Stamp the delivered jobs."""
    done = delivered.select("job_id").distinct().withColumn("_done", F.lit(True))
    return jobs.join(done, "job_id", "left").withColumn(
        "sent_at", F.when(F.col("_done"), as_of).otherwise(F.col("sent_at"))
    ).select(*jobs.columns)


def reminder_schedule(
    trackers: DataFrame, existing: DataFrame | None = None, stages: DataFrame | None = None
) -> DataFrame:
    """Reminder jobs of active trackers: opening, days before closing, and stage starts.

    ``trackers`` (tracker_id, is_active, registration_opens_at, registration_closes_at, profile_id);
    ``stages`` (profile_id, starts_at). Jobs that ``existing`` holds are not made again.
    """
    active = trackers.filter("is_active")
    dated = F.array(
        F.struct(F.lit(vocab.REGISTRATION_KIND).alias("kind"), F.col("registration_opens_at").alias("at")),
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                (F.col("registration_closes_at") - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days))).alias("at"),
            )
            for kind, days in vocab.DEADLINE_KINDS
        ],
    )
    jobs = active.select("tracker_id", F.explode(F.filter(dated, lambda d: d["at"].isNotNull())).alias("job")).select(
        "tracker_id", F.col("job.kind").alias("notification_kind"), F.col("job.at").alias("scheduled_for")
    )
    if stages is not None:
        starts = active.join(stages, "profile_id").select(
            "tracker_id", F.lit(vocab.STAGE_KIND).alias("notification_kind"), F.col("starts_at").alias("scheduled_for")
        )
        jobs = jobs.unionByName(starts.filter("scheduled_for IS NOT NULL")).distinct()
    if existing is None:
        return jobs
    keys = ["tracker_id", "notification_kind", "scheduled_for"]
    return insert_missing(existing.select(*keys), jobs, keys)


def version_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """present, changed or missing per key between two versions of a document's rules; is_new marks
    what only the newer version has."""
    before = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*values).alias("_old"))
    after = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.struct(*values).alias("_new"))
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"_o_{key}").eqNullSafe(F.col(f"_n_{key}"))
    joined = before.join(after, condition, "full_outer")
    status = (
        F.when(F.col("_new").isNull(), "missing")
        .when(F.col("_old").isNull() | F.col("_old").eqNullSafe(F.col("_new")), "present")
        .otherwise("changed")
    )
    return joined.select(
        *[F.coalesce(F.col(f"_o_{k}"), F.col(f"_n_{k}")).alias(k) for k in keys], status.alias("observed_status"),
        F.col("_old").isNull().alias("is_new"),
    )


def diploma_is_valid(diploma_year: Column, campaign_year: Column, years: int = 4) -> Column:
    """A diploma counts for the four years after it; a diploma of the future is refused as well."""
    return (diploma_year + years >= campaign_year) & (diploma_year <= campaign_year)
