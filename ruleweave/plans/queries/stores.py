"""What jobs leave behind: bodies, run tables, published snapshots, attached targets."""

import uuid

from pyspark.sql import DataFrame, functions as F

from ruleweave import vocab
from ruleweave.operators.contracts import public_rule_contract, split_valid
from ruleweave.plans import catalog, discovery
from ruleweave.plans.queries.base import ORACLES, Source, catalogue, long, query
from ruleweave.plans.queries.links import CAPPED, capped_candidates
from ruleweave.schemas import TABLES
from ruleweave.session import shared_folder
from ruleweave.sources import pointers, snapshots, store
from ruleweave.streaming import refresh


def _folder(s: Source, name: str) -> str:
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "stored_bodies",
    """
    WITH bodies AS (SELECT sha256(html) AS content_sha256, strlen(html) AS n, 1 AS run FROM pages WHERE html IS NOT NULL
                    UNION ALL SELECT sha256(text), strlen(text), 2 FROM documents WHERE text IS NOT NULL)
    SELECT content_sha256, n AS content_size_bytes, substr(content_sha256, 1, 2) || '/' || content_sha256 || '.html' AS storage_key,
           'run ' || min(run) AS batch, 1::BIGINT AS times_stored, TRUE AS is_intact
    FROM bodies GROUP BY ALL
    """.replace("GROUP BY ALL", "GROUP BY content_sha256, n"),
)
def stored_bodies(s: Source):
    """Pages are stored; then pages and documents, of which only the documents' bodies are new; then all that once more."""
    root, pages = _folder(s, "bodies"), s.pages.select(F.col("html").alias("body"))
    store.store_bodies(pages, "body", root, "run 1")
    for run in ("run 2", "run 3"):
        store.store_bodies(pages.unionByName(s.documents.select(F.col("text").alias("body"))), "body", root, run)
    held = store.stored_bodies(s.spark, root).select(
        "content_sha256", "content_size_bytes", "batch", (F.sha2("body", 256) == F.col("content_sha256")).alias("_intact"),
    )
    times = held.groupBy("content_sha256").agg(
        F.min("content_size_bytes").alias("content_size_bytes"), F.min("batch").alias("batch"),
        F.count(F.lit(1)).alias("times_stored"), F.bool_and("_intact").alias("is_intact"),
    )
    return times.withColumn("storage_key", store.storage_key(F.col("content_sha256"), ".html"))


@query(
    "refresh_runs",
    """
    SELECT DISTINCT doc_id % 50 AS target_id, 'v1' AS adapter_version, sha256(text) AS sha256, 1::BIGINT AS n_runs FROM documents
    UNION ALL SELECT DISTINCT doc_id % 50, 'v2', sha256(text), 1 FROM documents WHERE lang = 'en'
    """,
)
def refresh_runs(s: Source):
    """Documents arrive; then the same once more, fetched five days before, and some of them for a new version."""
    root = _folder(s, "refresh")
    feed, out, done = (f"{root}/{name}" for name in ("feed", "candidates", "runs"))

    def deliver(docs: DataFrame, version: str, fetched: str) -> None:
        rows = docs.select(
            (long("doc_id") % 50).alias("target_id"), F.lit(vocab.GENERIC_ADAPTER).alias("adapter_code"), F.lit(version).alias("adapter_version"),
            F.lit(fetched).cast("timestamp").alias("fetched_at"), F.col("text").alias("content"),
        )
        rows.write.mode("append").parquet(feed)

    def run() -> None:
        started = refresh.start_refresh(refresh.fetched_stream(s.spark, feed), done, out, f"{root}/checkpoint")
        started.awaitTermination()

    docs = s.dealt("documents", "doc_id", "lang", "text")
    deliver(docs, "v1", "2026-01-10")
    run()
    deliver(docs, "v1", "2026-01-05")
    deliver(docs.filter("lang = 'en'"), "v2", "2026-01-10")
    run()
    return refresh.runs(s.spark, done).groupBy("target_id", "adapter_version", "sha256").agg(F.count(F.lit(1)).alias("n_runs"))


@query("snapshot_round_trip", f"SELECT *, 3::BIGINT AS pointer, 1 AS conflicts FROM ({ORACLES['public_rules_snapshot']})")
def snapshot_round_trip(s: Source):
    """Two writers start from the same snapshot; the second to publish has to start anew, and its rows are read back."""
    root = _folder(s, "snapshot")
    valid, _ = split_valid(catalog.public_rules(catalogue(s), 1997), public_rule_contract())
    order = [F.col(c) for c in catalog.PUBLIC_RULE_ORDER]
    first = snapshots.write_versioned(valid.filter("false"), root, "0", order)
    snapshots.publish_pointer(s.spark, root, first)
    start = snapshots.current_number(s.spark, root)
    mine = snapshots.write_versioned(valid, root, "1-mine", order)
    snapshots.publish_pointer(s.spark, root, snapshots.write_versioned(valid.filter("benefit_kind = 'bvi'"), root, "1-other", order), after=start)
    conflicts = 0
    try:
        snapshots.publish_pointer(s.spark, root, mine, after=start)
    except pointers.Conflict:
        conflicts += 1
        snapshots.publish_pointer(s.spark, root, mine, after=snapshots.current_number(s.spark, root))
    number = snapshots.current_number(s.spark, root)
    return snapshots.read_current(s.spark, root, valid.schema).withColumns({"pointer": F.lit(number).cast("long"), "conflicts": F.lit(conflicts)})


@query(
    "attached_targets",
    CAPPED + """,
    judged AS (SELECT *, CASE WHEN class <> 'eligible' THEN class WHEN n <= room THEN 'attached' ELSE 'discovered' END AS status FROM ranked)
    SELECT j.campaign, j.url, CASE WHEN status = 'attached' THEN TRUE ELSE t.is_active END AS is_active,
           CASE WHEN status = 'attached' THEN 'found' WHEN t.discovered THEN 'found' ELSE 'configured' END AS made_by,
           CASE WHEN status = 'attached' THEN j.kind ELSE 'old' END AS document_kind, CASE WHEN status = 'attached' THEN 'requests-bs4-keyword-v1' ELSE 'old' END AS adapter_code,
           CASE WHEN status = 'attached' THEN length(j.campaign)::BIGINT ELSE -1 END AS university_location_id,
           status IN ('attached', 'already_tracked') AS has_candidate, FALSE AS attached_again
    FROM judged j LEFT JOIN targets t USING (campaign, url) WHERE t.url IS NOT NULL OR status = 'attached'
    """,
)
def attached_targets(s: Source):
    candidates, known = capped_candidates(s)
    number = F.xxhash64("campaign")
    candidates = candidates.withColumn("site", number)
    sites = candidates.select("site", "campaign").distinct().select(
        "site", number.alias("campaign_id"), F.lit(38).alias("minimum_score"), (3 + F.length("campaign")).alias("max_attachments"),
        F.length("campaign").cast("long").alias("university_location_id"), F.lit(1).cast("long").alias("source_id"), F.array(F.lit("c")).alias("allow_hosts"),
    )
    config = F.when(F.col("discovered_by").isNotNull(), F.to_json(F.struct("discovered_by"))).otherwise("{}")
    own = {
        "id": F.xxhash64("url"), "admission_campaign_id": number, "university_location_id": F.lit(-1), "url": F.col("url"), "document_kind": F.lit("old"),
        "adapter_code": F.lit("old"), "adapter_config": config, "is_active": F.col("is_active"),
    }
    base = known.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["admission_source_targets"]])
    found = candidates.drop("campaign", "cap", "minimum")
    now = F.lit("2026-03-01").cast("timestamp")
    once, judged = discovery.attach_targets(found, sites, base, now)
    twice, again = discovery.attach_targets(found, sites, once, now)
    anew = again.filter("status = 'attached'").select(F.col("admission_source_target_id").alias("id"), F.lit(True).alias("anew"))
    owned = judged.filter("admission_source_target_id IS NOT NULL").select(F.col("admission_source_target_id").alias("id"), F.lit(True).alias("owned"))
    names = candidates.select(F.col("site").alias("admission_campaign_id"), "campaign").distinct()
    made_by = F.when(F.get_json_object("adapter_config", "$.discovered_by").isNotNull(), "found").otherwise("configured")
    rows = twice.join(names, "admission_campaign_id").join(owned, "id", "left").join(anew, "id", "left")
    return rows.select(
        "campaign", "url", "is_active", made_by.alias("made_by"), "document_kind", "adapter_code", "university_location_id",
        F.coalesce("owned", F.lit(False)).alias("has_candidate"), F.coalesce("anew", F.lit(False)).alias("attached_again"),
    )
