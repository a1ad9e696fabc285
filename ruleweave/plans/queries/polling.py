"""Polling, run states, queues and reminders: customers are targets, events are runs."""

from pyspark.sql import DataFrame, functions as F

from ruleweave.operators import incremental as inc
from ruleweave.plans.queries.base import Source, at, query

AS_OF = "2024-01-20"
TARGETS = """
targets AS (
  SELECT c_custkey AS target_id, c_acctbal > -900 AS is_active,
         CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '2024-01-10' + to_hours((floor(c_acctbal / 20))::INTEGER) END AS next_check_at,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'other' ELSE 'strict' END AS adapter_code, c_nationkey + 1 AS poll_interval_hours FROM customer)
"""


def hours(value):
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, zero, value)


def targets(s: Source) -> DataFrame:
    later = at("2024-01-10") + hours(F.floor(F.col("c_acctbal") / 20).cast("int"))
    return s.customer.select(
        F.col("c_custkey").alias("target_id"), (F.col("c_acctbal") > -900).alias("is_active"),
        F.when(F.col("c_acctbal") >= 0, later).alias("next_check_at"),
        F.when(F.col("c_mktsegment") == "BUILDING", "other").otherwise("strict").alias("adapter_code"),
        (F.col("c_nationkey") + 1).alias("poll_interval_hours"),
    )


def runs(s: Source) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return s.events.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("target_id"), status.alias("status"), F.col("ts").alias("started_at")
    )


@query(
    "due_targets",
    f"""
    WITH {TARGETS}
    SELECT target_id, next_check_at FROM targets t
    WHERE is_active AND adapter_code IN ('strict') AND target_id NOT IN (1, 2, 3) AND (next_check_at IS NULL OR next_check_at <= TIMESTAMP '{AS_OF}')
      AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = t.target_id AND event_type = 'view' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)
    ORDER BY next_check_at NULLS FIRST, target_id LIMIT 100
    """,
)
def due_targets(s: Source):
    due = inc.due_targets(
        targets(s), runs(s), "target_id", at(AS_OF), adapters=["strict"], excluded=[1, 2, 3], limit=100, stale_hours=24
    )
    return due.select("target_id", "next_check_at")


@query(
    "next_check_schedule",
    f"""
    WITH {TARGETS}, seen AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15')
    SELECT target_id, CASE WHEN user_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS last_checked_at,
           CASE WHEN user_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' + to_hours(poll_interval_hours) ELSE next_check_at END AS next_check_at
    FROM targets LEFT JOIN seen ON user_id = target_id
    """,
)
def next_check_schedule(s: Source):
    known = targets(s).withColumn("last_checked_at", F.lit(None).cast("timestamp_ntz"))
    seen = s.events.filter((F.col("event_type") == "purchase") & (F.col("ts") >= at("2024-01-15"))).select(
        F.col("user_id").alias("target_id")
    ).distinct()
    return inc.bump_schedule(known, seen, "target_id", at(AS_OF)).select("target_id", "last_checked_at", "next_check_at")


@query(
    "run_action",
    """
    WITH hashed AS (SELECT doc_id, source, sha256(text) AS sha FROM documents),
    store AS (SELECT h.doc_id AS document_id, source, sha FROM hashed h JOIN labels USING (doc_id)),
    prior AS (SELECT source, sha, max(document_id) AS document_id FROM store GROUP BY ALL),
    runs AS (SELECT doc_id AS target_id, doc_id AS document_id, CASE WHEN quality = 1 THEN 'succeeded' ELSE 'failed' END AS status FROM labels WHERE toxic = 0)
    SELECT h.doc_id AS target_id, p.document_id, r.target_id AS run_id,
           CASE WHEN p.document_id IS NULL THEN 'new_document' WHEN r.status = 'succeeded' THEN 'skip' WHEN r.status IS NOT NULL THEN 'retry' ELSE 'new_run' END AS action
    FROM hashed h LEFT JOIN prior p ON p.source = h.source AND p.sha = h.sha
    LEFT JOIN runs r ON r.target_id = h.doc_id AND r.document_id = p.document_id
    """,
)
def run_action(s: Source):
    hashed = s.documents.select("doc_id", F.col("source").alias("source_id"), F.sha2("text", 256).alias("sha256"))
    fetched = hashed.withColumnRenamed("doc_id", "target_id").withColumn("adapter_version", F.lit("v1"))
    store = hashed.join(s.labels.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("document_id"), "source_id", "sha256", F.col("doc_id").alias("fetched_at")
    )
    done = s.labels.filter("toxic = 0").select(
        F.col("doc_id").alias("run_id"), F.col("doc_id").alias("target_id"), F.col("doc_id").alias("document_id"),
        F.lit("v1").alias("adapter_version"), F.when(F.col("quality") == 1, "succeeded").otherwise("failed").alias("status"),
    )
    return inc.run_actions(fetched, store, done).select("target_id", "document_id", "run_id", "action")


EVENT_RUN = "user_id * 100 + day(ts)"


@query(
    "supersede_pending",
    f"""
    WITH owned AS (SELECT event_id AS candidate_id, user_id, {EVENT_RUN} AS run_id, CASE WHEN event_type IN ('view', 'click') THEN 'pending' ELSE 'approved' END AS review_status FROM events),
    latest AS (SELECT user_id, max(run_id) AS current_run FROM owned WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id)
    SELECT candidate_id, run_id, CASE WHEN review_status = 'pending' AND run_id <> current_run THEN 'superseded' ELSE review_status END AS review_status
    FROM owned LEFT JOIN latest USING (user_id)
    """,
)
def supersede_pending(s: Source):
    run = (F.col("user_id") * 100 + F.day("ts")).alias("run_id")
    candidates = s.events.select(
        F.col("event_id").alias("candidate_id"), run, F.when(F.col("event_type").isin("view", "click"), "pending").otherwise("approved").alias("review_status")
    )
    known = s.events.select(run, F.col("user_id").alias("target_id")).distinct()
    read = s.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("target_id"))
    current = known.join(read, "target_id", "left_semi").groupBy("target_id").agg(F.max("run_id").alias("current_run_id"))
    return inc.supersede_pending(candidates, known, current)


@query(
    "publish_queue",
    """
    SELECT event_id AS candidate_id, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS queue_class, ts AS created_at
    FROM events WHERE event_type IN ('view', 'signup', 'click') AND ((props ->> 'k')::INTEGER = 50 OR user_id < 40)
    ORDER BY queue_class, ts, event_id LIMIT 500
    """,
)
def publish_queue(s: Source):
    kind = F.col("event_type")
    candidates = s.events.select(
        F.col("event_id").alias("candidate_id"), F.col("ts").alias("created_at"),
        F.when(kind == "error", "approved").otherwise("pending").alias("review_status"),
        F.when(kind == "purchase", "published").when(kind == "signup", "blocked").otherwise("pending_resolution").alias("automatic_status"),
        F.when(F.col("user_id") < 40, "strict-hse-2026-v1").otherwise("requests-bs4-keyword-v1").alias("adapter_code"),
        (F.get_json_object("props", "$.k").cast("int") * 2).alias("confidence"),
    )
    return inc.publish_queue(candidates, 500).select("candidate_id", "queue_class", "created_at")


@query(
    "run_counters",
    """
    SELECT c_custkey AS run_id, count(event_id) AS records_seen, count(event_id) FILTER (WHERE event_type = 'purchase') AS rows_published
    FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey
    """,
)
def run_counters(s: Source):
    known = s.customer.select(F.col("c_custkey").alias("run_id"))
    results = s.events.select(F.col("user_id").alias("run_id"), "event_type")
    return inc.run_counters(known, results, "run_id", F.col("event_type") == "purchase")


@query(
    "latest_per_key",
    """
    SELECT user_id, event_type, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def latest_per_key(s: Source):
    return inc.latest_documents(s.events.drop("props"), ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "due_reminders",
    f"""
    SELECT event_id AS job_id, user_id AS tracker_id, ts AS scheduled_for, c_name FROM events JOIN customer ON c_custkey = user_id
    WHERE event_type IN ('view', 'click') AND ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '2024-01-05' AND c_acctbal > 0 ORDER BY ts, event_id LIMIT 20
    """,
)
def due_reminders(s: Source):
    sent = F.when(~F.col("event_type").isin("view", "click") | (F.col("ts") <= at("2024-01-05")), F.col("ts"))
    jobs = s.events.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("tracker_id"), F.col("ts").alias("scheduled_for"), sent.alias("sent_at")
    )
    trackers = s.customer.select(F.col("c_custkey").alias("tracker_id"), "c_name", (F.col("c_acctbal") > 0).alias("is_active"))
    return inc.due_reminders(jobs, trackers, at(AS_OF)).select("job_id", "tracker_id", "scheduled_for", "c_name")


@query(
    "reminder_schedule",
    """
    WITH jobs AS (
      SELECT o_orderkey AS tracker_id, k AS notification_kind,
             CASE k WHEN 'registration_open' THEN o_orderdate ELSE o_orderdate + INTERVAL 30 DAY - to_days(d) END AS scheduled_for
      FROM orders, (VALUES ('registration_open', 0), ('deadline_7d', 7), ('deadline_3d', 3), ('deadline_1d', 1)) v(k, d) WHERE o_orderstatus <> 'P'
      UNION SELECT o_orderkey, 'stage_start', l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag = 'A')
    SELECT * FROM jobs UNION SELECT o_orderkey, 'registration_open', o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'
    """,
)
def reminder_schedule(s: Source):
    trackers = s.orders.select(
        F.col("o_orderkey").alias("tracker_id"), F.col("o_orderkey").alias("profile_id"), (F.col("o_orderstatus") != "P").alias("is_active"),
        F.col("o_orderdate").alias("registration_opens_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("registration_closes_at"),
    )
    existing = s.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("tracker_id"), F.lit("registration_open").alias("notification_kind"), F.col("o_orderdate").alias("scheduled_for")
    )
    stages = s.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("profile_id"), F.col("l_shipdate").alias("starts_at"))
    return inc.reminder_schedule(trackers, existing, stages)
