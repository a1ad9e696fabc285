"""Publish resolved candidates: queue, gate, resolve, match, level check, guarded upsert, logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ruleweave.functions.text import FULL_CODE, level_of_code
from ruleweave.operators.incremental import observe, publish_queue
from ruleweave.operators.merge import upsert
from ruleweave.operators.ordered import keep_last
from ruleweave.operators.resolve import (
    alternatives, catalogue_match, expanded, gate_reason, named_scope, unique_programme, unknown_scopes,
)
from ruleweave.plans.catalog import approved_profiles
from ruleweave.plans.keys import surrogate
from ruleweave.session import cut_lineage, stored
from ruleweave.sources import pointers, releases

Tables = Mapping[str, DataFrame]
RULE_KEY = ["admission_campaign_id", "university_program_id", "olympiad_profile_id", "diploma_status", "benefit_kind"]
QUEUE_ORDER = ["queue_class", "created_at", "candidate_id"]
LOCATION = ["university_location_id"]
#: What the queue takes of a candidate, what its resolution reads of it, and what is still read once it is judged.
CLAIMED = (
    "created_at", "review_status", "automatic_status", "automatic_note", "confidence", "raw_programme_name", "raw_olympiad_name",
    "raw_profile_name", "suggested_olympiad_level", "suggested_diploma_status", "suggested_benefit_kind",
)
JUDGED = ("candidate_id", "created_at", "queue_class", "automatic_status", "automatic_note", "adapter_code", "payload_kind")
PLACED = (*JUDGED, "university_id", "university_location_id", "raw_programme_name", "suggested_olympiad_level", "catalogue_year", "identity", "reason")
#: Alternatives that are written into a candidate's own record.
INLINE = 200


def _derived_level() -> Column:
    return F.coalesce((F.col("catalogue_status") == "code_only") & F.col("external_code").rlike(FULL_CODE), F.lit(False))


def sync_code_levels(programmes: DataFrame) -> DataFrame:
    """Degree level of code-only rows follows from their code."""
    return programmes.withColumn(
        "degree_level", F.when(_derived_level(), level_of_code("external_code")).otherwise(F.col("degree_level"))
    )


def queue(t: Tables, limit: int | None = None) -> DataFrame:
    """Waiting candidates with what their resolution needs; texts of any length stay in the table."""
    runs = t["admission_parse_runs"].select(
        F.col("id").alias("parse_run_id"), "adapter_code", "admission_source_target_id"
    )
    targets = t["admission_source_targets"].select(
        F.col("id").alias("admission_source_target_id"), "university_location_id",
        F.get_json_object("adapter_config", "$.rsosh_catalogue_year").cast("int").alias("config_year"),
    )
    campaigns = t["admission_campaigns"].select(
        F.col("id").alias("admission_campaign_id"), "university_id", "campaign_year"
    )
    documents = t["source_documents"].select(F.col("id").alias("source_document_id"))
    candidates = t["admission_rule_candidates"].select(
        F.col("id").alias("candidate_id"), F.col("admission_parse_run_id").alias("parse_run_id"), "admission_campaign_id", "source_document_id",
        F.coalesce("payload_kind", F.get_json_object("raw_payload", "$.kind")).alias("payload_kind"), *CLAIMED,
    )
    # What a run stands for is joined once a run, not once a candidate.
    joined = (
        candidates.join(runs.join(targets, "admission_source_target_id").drop("admission_source_target_id"), "parse_run_id")
        .join(campaigns, "admission_campaign_id")
        .join(documents, "source_document_id", "left_semi")
        .withColumn("catalogue_year", F.coalesce("config_year", F.col("campaign_year") - 1))
        .drop("campaign_year", "config_year", "parse_run_id", "admission_campaign_id", "source_document_id")
    )
    return publish_queue(joined, limit)


def outcomes(t: Tables, waiting: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(outcome per candidate, programmes with the scopes that had to be created or None if there are none of these).

    Resolution runs twice: scopes are created from what the first pass leaves open, then only the
    open candidates are resolved again.
    """
    gated = waiting.withColumn(
        "reason",
        gate_reason(
            F.col("adapter_code"), F.col("payload_kind"), F.col("confidence"), F.col("university_location_id"),
            [F.col("raw_programme_name"), F.col("raw_olympiad_name"), F.col("raw_profile_name")],
            F.col("suggested_diploma_status"), F.col("suggested_benefit_kind"),
        ),
    ).withColumns(
        {
            "catalogue_year": F.col("catalogue_year").cast("int"),
            "identity": F.concat_ws(" | ", "raw_olympiad_name", "raw_profile_name"),
        }
    )
    gated = gated.select(*[c for c in PLACED if c in gated.columns])
    programmes = sync_code_levels(t["university_programs"])

    def known(table: DataFrame) -> DataFrame:
        return table.filter("is_active").select(
            F.col("id").alias("programme_id"), "university_location_id", "external_code", "name", "catalogue_status"
        )

    # The claimed queue with its first resolution is read several times below.
    hits = ["_code_hits", "_title_hits"]
    placed = stored(unique_programme(gated, "raw_programme_name", known(programmes), LOCATION, keep=hits))
    blocked = placed.filter("reason IS NOT NULL").drop("programme_id", *hits)
    complete = placed.filter("reason IS NULL")
    open_rows = complete.filter("programme_id IS NULL").withColumn(
        "named", named_scope(F.col("adapter_code"), F.col("payload_kind"), F.col("raw_programme_name"))
    )
    scope_keys = ["university_id", *LOCATION, "external_code", "name"]
    created = unknown_scopes(open_rows, "raw_programme_name", "named", LOCATION, QUEUE_ORDER)
    owners = complete.select(*LOCATION, "university_id").distinct()
    fresh = stored(
        created.join(owners, LOCATION).select(
            surrogate(*scope_keys).alias("id"), *scope_keys, "catalogue_status", "degree_level",
            F.lit(True).alias("is_active"),
        )
    )
    grown, second = None, open_rows.drop("named", *hits)
    if not fresh.isEmpty():  # without a new scope the open candidates stay open
        grown = stored(upsert(programmes, fresh, scope_keys, update=["is_active", "degree_level", "catalogue_status"]))
        # Matching reads what follows in many steps: without a cut each would join the whole catalogue anew.
        second = stored(unique_programme(second.drop("programme_id"), "raw_programme_name", known(grown), LOCATION))
    resolved = complete.filter("programme_id IS NOT NULL").drop(*hits).unionByName(second).withColumn(
        "reason", F.when(F.col("programme_id").isNull(), "programme_not_exactly_mapped_for_location")
    )
    profiles = approved_profiles(t).withColumn("catalogue_year", F.col("campaign_year").cast("int")).drop("campaign_year")
    # Many candidates state the same competition, so each distinct identity is matched once.
    texts = cut_lineage(resolved.filter("reason IS NULL").select("catalogue_year", "identity").distinct())
    keyed = texts.withColumn("identity_key", F.col("identity"))
    matched = stored(catalogue_match(keyed, "identity_key", "identity", profiles, ["catalogue_year"]).select(
        "catalogue_year", "identity", "match_status", "match_reason", "matched_profile_id", "matched_level"
    ))
    joined = resolved.join(matched, ["catalogue_year", "identity"], "left").withColumn(
        "matched_profile_id", F.when(F.col("reason").isNull(), F.col("matched_profile_id"))
    )
    differs = F.col("suggested_olympiad_level").isNotNull() & ~F.col("matched_level").eqNullSafe(
        F.col("suggested_olympiad_level")
    )
    judged = joined.withColumn(
        "reason",
        F.coalesce(
            "reason",
            F.when(F.col("match_status") != "resolved", F.concat(F.lit("rsosh_"), "match_reason")),
            F.when(differs, "rsosh_level_mismatch"),
        ),
    )
    all_rows = judged.unionByName(blocked, allowMissingColumns=True)
    return stored(all_rows.select(*[c for c in JUDGED if c in gated.columns], "reason", "programme_id", "matched_profile_id")), grown


def publish(t: Tables, as_of: Column, limit: int | None = None) -> dict[str, DataFrame]:
    """New versions of programmes, rules, candidates, reviews and observations, plus all outcomes.

    A table that the queue changes nothing in is given back as it came.
    """
    judged, grown = outcomes(t, queue(t, limit))
    result = {name: t[name] for name in PUBLISHED} | {"outcomes": judged}
    if grown is not None:
        result["university_programs"] = grown
    else:
        level = level_of_code("external_code")
        stale = t["university_programs"].filter(_derived_level() & ~F.col("degree_level").eqNullSafe(level))
        if not stale.isEmpty():
            result["university_programs"] = sync_code_levels(t["university_programs"])
    good = judged.filter("reason IS NULL")
    numbered = None if good.isEmpty() else _numbered(t, good, as_of, result)
    published = (
        judged.sparkSession.createDataFrame([], "candidate_id long, rule_id long, programme_id long, matched_profile_id long")
        if numbered is None
        else numbered.select("candidate_id", "rule_id", "programme_id", "matched_profile_id")
    )
    same = F.col("automatic_status").eqNullSafe("blocked") & F.col("automatic_note").eqNullSafe(F.col("reason"))
    marks = (
        judged.select("candidate_id", "reason", same.alias("_same"))
        .join(published, "candidate_id", "left")
        .filter(F.col("rule_id").isNotNull() | ~F.col("_same"))
        .drop("_same")
        .withColumnRenamed("candidate_id", "id")
    )
    if not marks.isEmpty():
        result["admission_rule_candidates"] = _marked(t["admission_rule_candidates"], marks, as_of)
    return result


def _numbered(t: Tables, good: DataFrame, as_of: Column, result: dict[str, DataFrame]) -> DataFrame:
    """Publish the resolved candidates into ``result`` and return them with their rules."""
    subjects = t["subjects"].select(
        F.col("id").alias("suggested_confirmation_subject_id"), F.col("id").alias("confirmation_subject_id")
    )
    documents = t["source_documents"].select(F.col("id").alias("source_document_id"), F.col("url").alias("source_url"))
    texts = t["admission_rule_candidates"].select(
        F.col("id").alias("candidate_id"), "admission_campaign_id", "source_document_id", F.col("admission_parse_run_id").alias("parse_run_id"),
        "source_locator", "source_excerpt", "suggested_diploma_status", "suggested_benefit_kind", "suggested_confirmation_subject_id",
        "suggested_confirmation_min_score",
    )
    prefix = F.when(F.col("payload_kind") == "automatic_explicit_table_row", "automatic-table:").otherwise("strict-adapter:")
    good = stored(
        good.select("candidate_id", "programme_id", "matched_profile_id", "adapter_code", "payload_kind", "queue_class", "created_at")
        .join(texts, "candidate_id")
        .join(documents, "source_document_id")
        .join(subjects, "suggested_confirmation_subject_id", "left")
        .withColumns(
            {
                "university_program_id": F.col("programme_id"),
                "olympiad_profile_id": F.col("matched_profile_id"),
                "diploma_status": F.col("suggested_diploma_status"),
                "benefit_kind": F.col("suggested_benefit_kind"),
                "actor": F.concat(prefix, "adapter_code"),
            }
        )
    )
    changes = keep_last(good, RULE_KEY, QUEUE_ORDER).select(
        surrogate(*RULE_KEY).alias("id"), *RULE_KEY, "confirmation_subject_id",
        F.col("suggested_confirmation_min_score").alias("confirmation_min_score"), "source_url", "source_document_id",
        F.col("parse_run_id").alias("admission_parse_run_id"), "source_locator", "source_excerpt",
        as_of.alias("checked_at"), F.lit(True).alias("is_verified"), F.lit("verified").alias("verification_status"),
        F.lit("strict_adapter").alias("publication_method"), as_of.alias("verified_at"),
        F.col("actor").alias("verified_by"), as_of.alias("last_seen_at"), F.lit(True).alias("is_active"),
    )
    rules = result["benefit_rules"] = upsert(
        t["benefit_rules"], changes, RULE_KEY,
        update=[
            "confirmation_subject_id", "confirmation_min_score", "source_url", "source_document_id",
            "admission_parse_run_id", "source_locator", "source_excerpt", "checked_at", "verified_at", "verified_by",
            "last_seen_at", "is_active",
        ],
        guard="publication_method = 'strict_adapter'",
    )
    # Reviews, observations and marks follow from it: without a cut each would merge the rules anew.
    numbered = stored(
        good.join(rules.select(F.col("id").alias("rule_id"), *RULE_KEY), RULE_KEY).select(
            "rule_id", "programme_id", "matched_profile_id", "olympiad_profile_id", "actor", "source_document_id", "parse_run_id",
            "source_locator", "source_excerpt", *QUEUE_ORDER,
        )
    )
    reviews = numbered.select(
        surrogate("candidate_id", F.lit("approved"), as_of).alias("id"),
        F.col("candidate_id").alias("admission_rule_candidate_id"), F.lit("approved").alias("action"),
        F.col("actor").alias("reviewer_id"),
        F.lit("Automatically published after exact programme and profile resolution.").alias("notes"),
        F.to_json(
            F.struct("programme_id", "olympiad_profile_id", F.lit("strict_adapter").alias("method"))
        ).alias("resolved_payload"),
        as_of.alias("created_at"),
    )
    seen = keep_last(numbered, ["rule_id", "source_document_id"], QUEUE_ORDER).select(
        F.col("rule_id").alias("benefit_rule_id"), "source_document_id",
        F.col("parse_run_id").alias("admission_parse_run_id"),
        F.col("candidate_id").alias("admission_rule_candidate_id"), F.lit("present").alias("observed_status"),
        "source_locator", "source_excerpt", as_of.alias("observed_at"),
    )
    result["benefit_rule_observations"] = observe(t["benefit_rule_observations"], seen, ["benefit_rule_id", "source_document_id"])
    result["admission_rule_reviews"] = t["admission_rule_reviews"].unionByName(reviews)
    return numbered


def _marked(candidates: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """Candidates with the marks (id, reason, rule_id, programme_id, matched_profile_id) written to those that still wait."""
    done, waiting = F.col("rule_id").isNotNull(), F.col("review_status") == "pending"
    joined = candidates.join(marks.withColumn("_judged", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_judged") & waiting, F.lit(False))

    def mark(name: str, published_value: Column, blocked_value: Column | None = None) -> Column:
        blocked_result = blocked_value if blocked_value is not None else F.col(name)
        return F.when(hit & done, published_value).when(hit, blocked_result).otherwise(F.col(name))

    return joined.select(
        *[
            {
                "university_program_id": mark("university_program_id", F.col("programme_id")),
                "olympiad_profile_id": mark("olympiad_profile_id", F.col("matched_profile_id")),
                "match_status": mark("match_status", F.lit("resolved")),
                "review_status": mark("review_status", F.lit("approved")),
                "reviewed_at": mark("reviewed_at", as_of),
                "published_benefit_rule_id": mark("published_benefit_rule_id", F.col("rule_id")),
                "automatic_status": mark("automatic_status", F.lit("published"), F.lit("blocked")),
                "automatic_note": mark("automatic_note", F.lit("exact_programme_and_rsosh_profile"), F.col("reason")),
            }.get(c, F.col(c)).alias(c)
            for c in candidates.columns
        ]
    )


PUBLISHED = (
    "university_programs", "benefit_rules", "admission_rule_candidates", "admission_rule_reviews", "benefit_rule_observations"
)
READ = (
    "admission_parse_runs", "admission_source_targets", "admission_campaigns", "source_documents", "subjects", "olympiads",
    "olympiad_profiles", "sources",
)


def publish_release(spark: SparkSession, root: str, as_of: Column, limit: int | None = None, attempts: int = 3) -> int:
    """Publish the queue of the current release as one commit and return the number of the release that counts.

    Programmes, rules, reviews, observations and candidate marks become visible together or not at all.
    If another job commits meanwhile, the queue is worked off anew from what it left. A queue that
    changes nothing, such as one that has been published already, makes no release.
    """
    for attempt in range(attempts):
        number, folders = releases.current(spark, root)
        t = releases.read(spark, root, PUBLISHED + READ, folders)
        result = publish(t, as_of, limit)
        try:
            return releases.commit(spark, root, {name: result[name] for name in PUBLISHED if result[name] is not t[name]}, number)
        except pointers.Conflict:
            if attempt + 1 == attempts:
                raise


def summary(judged: DataFrame) -> DataFrame:
    """Published and blocked counts with the reason."""
    status = F.when(F.col("reason").isNull(), "published").otherwise("blocked")
    return judged.groupBy(status.alias("outcome"), F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def match_pending(t: Tables, identities: DataFrame, catalogue_year: int) -> DataFrame:
    """Write profile links to pending candidates without publishing anything.

    ``identities`` (id, identity) holds the identity text of a candidate or NULL. Unresolved candidates
    stay as they are, resolved ones keep the larger confidence. Ambiguous ones name the titles that they
    could mean, and the profiles themselves as long as those are no more than ``INLINE``; the profiles of
    a title are its class (``resolve.alternatives``).
    """
    pending = t["admission_rule_candidates"].filter("review_status = 'pending' AND match_status = 'unresolved'")
    texts = identities.join(pending.select("id"), "id", "left_semi").filter("identity IS NOT NULL")
    profiles = approved_profiles(t, catalogue_year).drop("campaign_year")
    outcome = cut_lineage(catalogue_match(texts, "id", "identity", profiles).filter("match_status <> 'unresolved'").select(
        "id", "identity", F.col("match_status").alias("_status"), "match_reason", "matched_profile_id", "matched_level"
    ))
    unclear = outcome.filter("_status = 'ambiguous'").select("id", "identity")
    choices, classes = alternatives(unclear, "id", "identity", profiles)
    sizes = classes.groupBy("title_key").agg(F.count(F.lit(1)).alias("_n"))
    few = choices.join(sizes, "title_key").groupBy("id").agg(F.sum("_n").alias("_n")).filter(F.col("_n") <= INLINE)
    listed = expanded(choices.join(few.select("id"), "id", "left_semi"), classes).groupBy("id").agg(
        F.sort_array(F.collect_list("profile_id")).alias("_options")  # INLINE at most
    )
    titles = choices.groupBy("id").agg(F.sort_array(F.collect_set("title_key")).alias("_titles"))  # the titles in one text
    matched = outcome.drop("identity").join(listed, "id", "left").join(titles, "id", "left")
    joined = t["admission_rule_candidates"].join(matched, "id", "left")
    resolved = F.coalesce(F.col("_status") == "resolved", F.lit(False))
    link = F.struct(
        F.col("_status").alias("status"), F.col("match_reason").alias("reason"), F.col("matched_profile_id").alias("profile_id"),
        F.coalesce("_options", F.array().cast("array<bigint>")).alias("alternatives"),
        F.coalesce("_titles", F.array().cast("array<string>")).alias("alternative_titles"),
    )
    held = F.coalesce(F.from_json("raw_payload", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(held, lambda name, _: name != "rsosh_match")
    own = F.create_map(F.lit("rsosh_match"), F.parse_json(F.to_json(link, {"ignoreNullFields": "false"})))
    merged = F.to_json(F.map_concat(others, own))
    return joined.withColumns(
        {
            "olympiad_profile_id": F.when(resolved, F.col("matched_profile_id")).otherwise(F.col("olympiad_profile_id")),
            "suggested_olympiad_level": F.when(resolved, F.col("matched_level")).otherwise(F.col("suggested_olympiad_level")),
            "match_status": F.coalesce("_status", "match_status"),
            "confidence": F.when(resolved, F.lit(100)).otherwise(F.col("confidence")).cast("short"),
            "raw_payload": F.when(F.col("_status").isNotNull(), merged).otherwise(F.col("raw_payload")),
        }
    ).select(*t["admission_rule_candidates"].columns)

