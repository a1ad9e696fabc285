"""Load official snapshots: competitions with profiles and subjects, and university locations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions.text import campaign_year_of, competition_key, level_number
from ruleweave.functions.urls import allowed_host
from ruleweave.operators import contracts
from ruleweave.operators.merge import replace_children, upsert
from ruleweave.operators.ordered import keep_last
from ruleweave.plans.keys import surrogate

Tables = Mapping[str, DataFrame]


def source_code(source: Column) -> Column:
    return F.when(F.startswith(F.coalesce(source, F.lit("")), F.lit(vocab.LIST_SOURCE_PREFIX)), "rsosh").otherwise(
        "ya-professional"
    )


def subject_codes(names: Column) -> Column:
    """Codes of subject names; an unknown name counts as ``other``."""
    table = F.create_map(*[F.lit(item) for pair in vocab.SUBJECT_NAME_CODES for item in pair])
    return F.array_distinct(F.transform(names, lambda name: F.coalesce(F.try_element_at(table, name), F.lit("other"))))


def merge_sources(records: DataFrame, order: str = "seq") -> DataFrame:
    """One record per competition, audience and profile; the last source in order replaces earlier ones."""
    keyed = records.withColumns(
        {"_t": F.lower("title"), "_p": F.lower(F.coalesce("profile", F.lit(""))), "_a": F.col("audience")}
    )
    return keep_last(keyed, ["_t", "_a", "_p"], [order]).drop("_t", "_p", "_a")


def derive(records: DataFrame) -> DataFrame:
    """Keys, year, level, source and subject codes of catalogue records."""
    profile = F.when(F.coalesce(F.col("profile"), F.lit("")) == "", vocab.DEFAULT_PROFILE).otherwise(F.col("profile"))
    return records.withColumns(
        {
            "external_key": competition_key("audience", "title"),
            "profile_title": profile,
            "campaign_year": campaign_year_of("source"),
            "level_number": level_number("level"),
            "source_code": source_code(F.col("source")),
            "subject_codes": subject_codes(F.coalesce("subjects", F.array("subject"))),
        }
    )


def load_competitions(t: Tables, records: DataFrame, as_of: Column, order: str = "seq") -> dict[str, DataFrame]:
    """New versions of olympiads, olympiad_profiles and olympiad_profile_subjects.

    The last record in order wins where several state the same competition or profile.
    """
    derived = derive(records)
    titles = keep_last(derived, ["external_key"], [order]).select(
        surrogate("external_key").alias("id"), "external_key", "title", "audience", "kind",
        F.col("source_url").alias("official_url"), F.lit(True).alias("is_active"), as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    olympiads = upsert(
        t["olympiads"], titles, ["external_key"],
        update=["title", "audience", "kind", "official_url", "updated_at", "is_active"],
    )
    sources = t["sources"].select(F.col("id").alias("source_id"), F.col("code").alias("source_code"))
    owners = olympiads.select(F.col("id").alias("olympiad_id"), "external_key")
    unique = keep_last(derived, ["external_key", "campaign_year", "profile_title"], [order])
    placed = unique.join(owners, "external_key").join(sources, "source_code")
    profiles = placed.select(
        surrogate("external_key", "campaign_year", "profile_title").alias("id"), "olympiad_id", "source_id",
        F.col("campaign_year").cast("short").alias("campaign_year"), "profile_title",
        F.col("level_number").cast("short").alias("level"), F.lit("approved").alias("approval_status"), "source_url",
        as_of.alias("last_checked_at"), F.lit(True).alias("is_active"),
    )
    keys = ["olympiad_id", "campaign_year", "profile_title"]
    merged = upsert(
        t["olympiad_profiles"], profiles, keys,
        update=["source_id", "level", "approval_status", "source_url", "last_checked_at", "is_active"],
    )
    ids = merged.select(F.col("id").alias("olympiad_profile_id"), *keys)
    touched = placed.select(*keys[:1], F.col("campaign_year").cast("short").alias("campaign_year"), "profile_title", "subject_codes").join(ids, keys)
    subjects = t["subjects"].select(F.col("id").alias("subject_id"), F.col("code").alias("_code"))
    children = (
        touched.select("olympiad_profile_id", F.explode("subject_codes").alias("_code"))
        .join(subjects, "_code")
        .select("olympiad_profile_id", "subject_id")
    )
    bridge = replace_children(t["olympiad_profile_subjects"], children, touched, "olympiad_profile_id")
    return {"olympiads": olympiads, "olympiad_profiles": merged, "olympiad_profile_subjects": bridge}


def load_locations(t: Tables, records: DataFrame, as_of: Column) -> DataFrame:
    """New version of university_locations; the snapshot is refused as a whole if it breaks its contract."""
    contracts.enforce(records, contracts.location_contract(), ["id"])
    if contracts.duplicate_keys(records, ["university_code", "id"]).first() is not None:
        raise contracts.ContractViolation("duplicate location key")
    missing = contracts.missing_parents(records, t["universities"], "university_code", "code").first()
    if missing is not None:
        raise contracts.ContractViolation(f"parent university is missing: {missing['university_code']}")
    known = F.col("admission_status").isin("rules_discovered", "benefits_verified")
    owners = t["universities"].select(F.col("id").alias("university_id"), F.col("code").alias("university_code"))
    rows = records.join(owners, "university_code").select(
        surrogate("university_id", "id").alias("id"), "university_id", F.col("id").alias("code"),
        F.col("campus_name").alias("name"), F.col("campus_type").alias("location_type"), "city", "region",
        F.when(F.coalesce("country", F.lit("")) == "", vocab.DEFAULT_COUNTRY).otherwise(F.col("country")).alias("country"),
        "official_url", F.col("location_source_url").alias("directory_url"), as_of.alias("location_checked_at"),
        "admission_status", F.when(known, F.col("official_url")).alias("admission_rules_url"),
        F.when(known, as_of).alias("admission_checked_at"), F.lit(True).alias("is_active"),
    )
    updated = [c for c in rows.columns if c not in ("id", "university_id", "code")]
    return upsert(t["university_locations"], rows, ["university_id", "code"], update=updated)


DOCUMENT_KINDS = ("html", "pdf", "xlsx")


def check_targets(
    config: DataFrame, sources: DataFrame, universities: DataFrame, locations: DataFrame, adapters: Sequence[str]
) -> DataFrame:
    """Configured targets with all ``reasons`` that speak against them (none for a good row), source_id and location id.

    ``config`` (source_code, university_code, location_code, url, document_kind, adapter_code,
    adapter_config). Reasons: unknown_source, unknown_location, several_sources, several_locations,
    unknown_adapter, unknown_document_kind, not_https, no_approved_host, foreign_host, repeated_target (two
    rows for one page of one location: neither is taken). Nothing is dropped: a code that matches nothing
    or several rows is a reason, and NULL matches nothing.
    """
    by_source = sources.groupBy(F.col("code").alias("source_code")).agg(
        F.count(F.lit(1)).alias("_sources"), F.min("id").alias("source_id"), F.min("base_url").alias("_base")
    )
    owners = universities.select(F.col("id").alias("university_id"), F.col("code").alias("university_code"))
    by_place = locations.join(owners, "university_id").groupBy("university_code", F.col("code").alias("location_code")).agg(
        F.count(F.lit(1)).alias("_places"), F.min("id").alias("university_location_id")
    )
    target = ["university_code", "location_code", "url"]
    repeated = config.groupBy(*target).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    joined = config.join(by_source, "source_code", "left").join(by_place, ["university_code", "location_code"], "left").join(repeated, target, "left")
    hosts = F.coalesce(F.from_json(F.get_json_object("adapter_config", "$.allow_hosts"), "array<string>"), F.array().cast("array<string>"))
    is_https = F.coalesce(F.startswith(F.lower("url"), F.lit("https://")), F.lit(False))
    reason = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), name)
    reasons = F.array_compact(F.array(
        reason(F.col("_sources").isNull(), "unknown_source"), F.when(F.col("_sources") > 1, "several_sources"),
        reason(F.col("_places").isNull(), "unknown_location"), F.when(F.col("_places") > 1, "several_locations"),
        reason(~F.col("adapter_code").isin(*adapters), "unknown_adapter"), reason(~F.col("document_kind").isin(*DOCUMENT_KINDS), "unknown_document_kind"),
        F.when(~is_https, "not_https"), F.when(F.size(hosts) == 0, "no_approved_host"),
        F.when((F.size(hosts) > 0) & is_https & ~allowed_host("url", F.coalesce("_base", F.lit("")), hosts), "foreign_host"),
        F.when(F.col("_rows").isNotNull(), "repeated_target"),
    ))
    return joined.withColumn("reasons", reasons).drop("_sources", "_base", "_places", "_rows")


def bind_targets(
    config: DataFrame, targets: DataFrame, sources: DataFrame, universities: DataFrame, locations: DataFrame,
    adapters: Sequence[str] = vocab.CATALOGUE_CODES,
) -> tuple[DataFrame, DataFrame]:
    """(targets with the good rows of ``config`` upserted, rows that bind nothing with their reasons).

    Each good row binds to exactly one source and one location of its own university; see ``check_targets``.
    """
    checked = check_targets(config, sources, universities, locations, adapters)
    bound = checked.filter(F.size("reasons") == 0).select(
        surrogate("university_location_id", "url").alias("id"), "university_location_id", "source_id", "url",
        "document_kind", "adapter_code", "adapter_config", F.lit(True).alias("is_active"),
    )
    merged = upsert(
        targets, bound, ["university_location_id", "url"],
        update=["source_id", "document_kind", "adapter_code", "adapter_config", "is_active"],
    )
    return merged, checked.filter(F.size("reasons") > 0).select(*config.columns, "reasons")


def upsert_programmes(t: Tables, parsed: DataFrame, as_of: Column) -> DataFrame:
    """Named programmes of a location's catalogue; code-only rows of rule documents stay as they are.

    ``parsed`` (university_id, university_location_id, external_code, name, degree_level, target_id,
    run_id, source_url). The key compares null-safely.
    """
    keys = ["university_id", "university_location_id", "external_code", "name"]
    rows = parsed.select(
        surrogate(*keys).alias("id"), *keys, F.lit("named_verified").alias("catalogue_status"), "degree_level",
        F.col("target_id").alias("catalogue_source_target_id"), F.col("run_id").alias("catalogue_parse_run_id"),
        F.col("source_url").alias("catalogue_source_url"), as_of.alias("catalogue_checked_at"),
        F.lit(True).alias("is_active"),
    )
    return upsert(
        t["university_programs"], rows, keys,
        update=[
            "catalogue_status", "degree_level", "catalogue_source_target_id", "catalogue_parse_run_id",
            "catalogue_source_url", "catalogue_checked_at", "is_active",
        ],
    )


def update_profile_setup(t: Tables, requests: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Apply a table of setup requests: profile fields, and the subject set where one is given.

    ``requests`` (user_id, audience, grade_or_course, default_diploma_year, subject_codes). A NULL
    list means no change of subjects, an empty list clears them.
    """
    fields = requests.select(
        F.col("user_id").alias("id"), "audience", "grade_or_course", "default_diploma_year", as_of.alias("updated_at")
    )
    users = t["app_users"].join(fields.select("id").distinct(), "id", "left_semi")
    changed = upsert(t["app_users"], fields.join(users.select("id"), "id", "left_semi"), ["id"])
    given = requests.filter(F.col("subject_codes").isNotNull())
    codes = t["subjects"].select(F.col("id").alias("subject_id"), F.col("code").alias("_code"))
    children = given.select("user_id", F.explode("subject_codes").alias("_code")).join(codes, "_code").select(
        "user_id", "subject_id"
    )
    return {"app_users": changed, "user_subjects": replace_children(t["user_subjects"], children, given, "user_id")}


def set_tracking(t: Tables, requests: DataFrame, as_of: Column) -> DataFrame:
    """Apply a table of tracking requests; a request without a diploma year keeps the known one."""
    rows = requests.select(
        surrogate("user_id", "olympiad_profile_id").alias("id"), "user_id", "olympiad_profile_id", "is_active",
        "diploma_year", as_of.alias("added_at"),
    )
    return upsert(
        t["tracked_olympiads"], rows, ["user_id", "olympiad_profile_id"],
        update=["is_active", "diploma_year"], keep_old_if_null=["diploma_year"],
    )
