"""Reads of the verified catalogue: star joins, conditional counts, top-1 policy, faceted search.

Every function takes the tables it joins and returns a DataFrame. Small dimensions are broadcast by
the planner from their measured size; no side is forced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave.functions.text import col

Tables = Mapping[str, DataFrame]
LOCATION_LIMIT, UNIVERSITY_LIMIT = 200, 50


def matches_query(columns: Sequence[Column | str], query: str) -> Column:
    """Case-insensitive substring search over several columns; wildcards in the query stay active."""
    text = " ".join(query.split())
    return F.lit(True) if not text else F.concat_ws(" ", *[col(c) for c in columns]).ilike(f"%{text}%")


def faceted(df: DataFrame, columns: Sequence[str], query: str = "", **facets: str | None) -> DataFrame:
    """Search plus optional facets: an unset facet adds no predicate at all."""
    found = df.filter(matches_query(columns, query)) if query.strip() else df
    for name, value in facets.items():
        if value is not None:
            found = found.filter(F.col(name) == value)
    return found


def is_verified(prefix: str = "") -> Column:
    return F.col(f"{prefix}is_active") & (F.col(f"{prefix}verification_status") == "verified")


def top1(df: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """First row per key by a partial aggregate over (order, fields): no window, no hot task.

    Order columns must sort ascending with the best row last.
    """
    best = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *fields))
    return df.groupBy(key).agg(best.alias("_best")).select(key, *[F.col(f"_best.{f}").alias(f) for f in fields])


def verified_rule_stats(rules: DataFrame, programmes: DataFrame, campaigns: DataFrame, key: Sequence[str]) -> DataFrame:
    """Verified rules per key, aggregated before anything is joined to the outer rows."""
    verified = rules.filter(is_verified()).select(
        F.col("university_program_id").alias("program_id"), "admission_campaign_id", "source_url", "checked_at"
    )
    joined = verified.join(programmes, "program_id").join(campaigns, "admission_campaign_id")
    return joined.groupBy(*key).agg(
        F.count(F.lit(1)).alias("verified_benefits_count"),
        F.min("source_url").alias("rule_source_url"),
        F.max("checked_at").alias("rule_checked_at"),
    )


def _campaigns(t: Tables, year: int) -> DataFrame:
    return t["admission_campaigns"].filter(F.col("campaign_year") == year)


def search_locations(
    t: Tables, campaign_year: int = 2026, q: str = "", region: str | None = None, location_type: str | None = None,
    limit: int | None = LOCATION_LIMIT,
) -> DataFrame:
    """Locations with verified rule counts and the campaign's general policy."""
    universities = t["universities"].filter("is_active").select(
        F.col("id").alias("university_id"), F.col("code").alias("university_code"), F.col("name").alias("university_name")
    )
    locations = t["university_locations"].filter("is_active").withColumnsRenamed(
        {"id": "location_id", "code": "location_code", "name": "location_name"}
    )
    found = faceted(
        locations.join(universities, "university_id"),
        ["university_name", "location_name", "city", "region", "country"],
        q, region=region, location_type=location_type,
    )
    campaigns = _campaigns(t, campaign_year).select(
        F.col("id").alias("admission_campaign_id"), "university_id", F.col("rules_url").alias("campaign_rules_url")
    )
    policies = top1(
        t["admission_policies"].filter("is_verified AND university_program_id IS NULL"),
        "admission_campaign_id",
        [F.col("policy_kind") == "general", F.col("checked_at")],
        ["description", "source_url"],
    ).withColumnsRenamed({"description": "verified_policy_description", "source_url": "verified_policy_source_url"})
    programmes = t["university_programs"].filter("is_active").select(
        F.col("id").alias("program_id"), F.col("university_location_id").alias("location_id")
    )
    counts = (
        t["benefit_rules"]
        .filter(is_verified())
        .select(F.col("university_program_id").alias("program_id"), "admission_campaign_id")
        .join(programmes, "program_id")
        .groupBy("location_id", "admission_campaign_id")
        .agg(F.count(F.lit(1)).alias("verified_benefits_count"))
    )
    result = (
        found.join(campaigns, "university_id", "left")
        .join(policies, "admission_campaign_id", "left")
        .join(counts, ["location_id", "admission_campaign_id"], "left")
        .select(
            "university_code", "university_name", "location_code", "location_name", "location_type", "city", "region",
            "country", "official_url", "directory_url", "admission_status", "location_checked_at",
            "admission_checked_at", "campaign_rules_url", "verified_policy_description", "verified_policy_source_url",
            F.coalesce("verified_benefits_count", F.lit(0)).alias("verified_benefits_count"),
        )
    )
    order = ["university_name", F.desc(F.col("location_type") == "main"), "location_name", "location_code"]
    return result.orderBy(*order).limit(limit) if limit else result


def programmes(t: Tables, campaign_year: int = 2026, location_code: str | None = None) -> DataFrame:
    """Programmes with rule counts, first known source and last check; one location or the whole catalogue."""
    locations = t["university_locations"].filter("is_active")
    if location_code is not None:
        locations = locations.filter(F.col("code") == location_code)
    places = locations.select(
        F.col("id").alias("university_location_id"), F.col("code").alias("university_location_code"),
        F.col("name").alias("location_name"), "admission_rules_url", "official_url", "admission_checked_at",
        "location_checked_at",
    )
    universities = t["universities"].filter("is_active").select(
        F.col("id").alias("university_id"), F.col("code").alias("university_code"), F.col("name").alias("university_name")
    )
    own = t["university_programs"].filter("is_active").withColumnsRenamed({"id": "program_id", "name": "programme_name"})
    campaigns = _campaigns(t, campaign_year).select(F.col("id").alias("admission_campaign_id"), F.col("university_id").alias("campaign_university_id"))
    stats = verified_rule_stats(
        t["benefit_rules"], own.select("program_id", "university_id"), campaigns, ["program_id", "university_id", "campaign_university_id"]
    ).filter(F.col("university_id") == F.col("campaign_university_id")).drop("university_id", "campaign_university_id")
    checked = F.coalesce("catalogue_checked_at", "rule_checked_at", "admission_checked_at", "location_checked_at")
    return (
        own.join(places, "university_location_id")
        .join(universities, "university_id")
        .join(stats, "program_id", "left")
        .select(
            "university_code", "university_name", "university_location_code", "location_name", "external_code",
            "programme_name", "catalogue_status", "degree_level",
            F.coalesce("verified_benefits_count", F.lit(0)).alias("verified_benefits_count"),
            F.coalesce("catalogue_source_url", "rule_source_url", "admission_rules_url", "official_url").alias("source_url"),
            F.date_format(checked, "yyyy-MM-dd").alias("checked_at"),
        )
        .orderBy("university_code", "university_location_code", F.asc_nulls_last("external_code"), "programme_name")
    )


def discover_profiles(
    t: Tables, campaign_year: int, audience: str = "school", subjects: Sequence[str] = (), user_id: int | None = None
) -> DataFrame:
    """Approved profiles with their subjects and the user's tracking flag."""
    competitions = t["olympiads"].filter(F.col("audience") == audience).select(
        F.col("id").alias("olympiad_id"), "title", "kind"
    )
    profiles = (
        t["olympiad_profiles"]
        .filter((F.col("campaign_year") == campaign_year) & (F.col("approval_status") == "approved") & F.col("is_active"))
        .select(F.col("id").alias("profile_id"), "olympiad_id", "profile_title", "level", "source_url")
        .join(competitions, "olympiad_id")
    )
    bridge = t["olympiad_profile_subjects"].join(
        t["subjects"].select(F.col("id").alias("subject_id"), "code", "name"), "subject_id"
    ).select(F.col("olympiad_profile_id").alias("profile_id"), "code", "name")
    if subjects:
        profiles = profiles.join(bridge.filter(F.col("code").isin(*subjects)), "profile_id", "left_semi")
    # A profile has few subjects, and a set cannot outgrow the subject dimension.
    named = bridge.groupBy("profile_id").agg(
        F.array_sort(F.collect_set("code")).alias("subject_codes"), F.array_sort(F.collect_set("name")).alias("subject_names")
    )
    tracked = t["tracked_olympiads"].filter(F.col("is_active") & F.col("user_id").eqNullSafe(F.lit(user_id)))
    flag = tracked.select(F.col("olympiad_profile_id").alias("profile_id")).distinct().withColumn("_tracked", F.lit(True))
    empty = F.array().cast("array<string>")
    return (
        profiles.join(named, "profile_id", "left")
        .join(flag, "profile_id", "left")
        .select(
            "profile_id", "title", "kind", "profile_title", "level", "source_url",
            F.coalesce("subject_codes", empty).alias("subject_codes"),
            F.coalesce("subject_names", empty).alias("subject_names"),
            F.col("_tracked").isNotNull().alias("is_tracked"),
        )
        .orderBy(F.asc_nulls_last("level"), "title", "profile_id")
    )


def university_policies(t: Tables, university_code: str, campaign_year: int = 2026) -> DataFrame:
    universities = t["universities"].filter(F.col("code") == university_code).select(
        F.col("id").alias("university_id"), F.col("name").alias("university_name")
    )
    campaigns = _campaigns(t, campaign_year).select(F.col("id").alias("admission_campaign_id"), "university_id", "rules_url")
    return (
        campaigns.join(universities, "university_id")
        .join(t["admission_policies"].drop("id"), "admission_campaign_id")
        .orderBy(F.asc_nulls_first("university_program_id"), "policy_kind")
        .select("university_name", "rules_url", "policy_kind", "description", "is_verified", "checked_at")
    )


def _rule_star(t: Tables, campaign_year: int | None, placed: str) -> DataFrame:
    """Verified rules joined to their dimensions; ``placed`` is inner or left for programme and location."""
    rules = t["benefit_rules"].filter(is_verified()).select(
        F.col("university_program_id").alias("program_id"), "admission_campaign_id", "olympiad_profile_id",
        "diploma_status", "benefit_kind", "point_value", "confirmation_subject_id", "confirmation_min_score",
        "is_verified", "verification_status", "source_url", "source_locator", "checked_at",
    )
    campaigns = t["admission_campaigns"].select(F.col("id").alias("admission_campaign_id"), "university_id", "campaign_year")
    if campaign_year is not None:
        campaigns = campaigns.filter(F.col("campaign_year") == campaign_year)
    universities = t["universities"].select(
        F.col("id").alias("university_id"), F.col("code").alias("university_code"), F.col("name").alias("university_name")
    )
    own = t["university_programs"].select(
        F.col("id").alias("program_id"), F.col("name").alias("programme_name"), "university_location_id"
    )
    places = t["university_locations"].select(
        F.col("id").alias("university_location_id"), F.col("code").alias("university_location_code"),
        F.col("is_active").alias("location_is_active"), F.col("admission_status").alias("location_status"),
    )
    profiles = t["olympiad_profiles"].select(
        F.col("id").alias("olympiad_profile_id"), "olympiad_id", "profile_title", F.col("level").alias("olympiad_level")
    )
    competitions = t["olympiads"].select(F.col("id").alias("olympiad_id"), F.col("title").alias("olympiad_title"))
    confirmation = t["subjects"].select(
        F.col("id").alias("confirmation_subject_id"), F.col("name").alias("confirmation_subject_name")
    )
    return (
        rules.join(campaigns, "admission_campaign_id")
        .join(universities, "university_id")
        .join(own, "program_id", placed)
        .join(places, "university_location_id", placed)
        .join(profiles, "olympiad_profile_id")
        .join(competitions, "olympiad_id")
        .join(confirmation, "confirmation_subject_id", "left")
    )


def university_benefits(t: Tables, university_code: str, campaign_year: int = 2026) -> DataFrame:
    """Exact rules of one university, one row per rule."""
    star = _rule_star(t, campaign_year, "left").filter(F.col("university_code") == university_code)
    return star.orderBy(
        F.asc_nulls_first("programme_name"), "olympiad_title", "profile_title", "diploma_status"
    ).select(
        "university_location_code", "programme_name", "olympiad_title", "profile_title", "olympiad_level",
        "diploma_status", "benefit_kind", "point_value", "confirmation_subject_name", "confirmation_min_score",
        "source_url", "source_locator", "checked_at",
    )


def search_universities(t: Tables, q: str = "", campaign_year: int = 2026, limit: int | None = UNIVERSITY_LIMIT) -> DataFrame:
    """Universities of a campaign ranked by verified rules."""
    universities = t["universities"].filter("is_active").select(
        F.col("id").alias("university_id"), "code", "name", "city", "official_url"
    )
    if q.strip():
        text = " ".join(q.split())
        universities = universities.filter(
            F.col("name").ilike(f"%{text}%") | F.coalesce("city", F.lit("")).ilike(f"%{text}%")
        )
    campaigns = _campaigns(t, campaign_year).select(
        F.col("id").alias("admission_campaign_id"), "university_id", "rules_url", "rules_checked_at"
    )
    counts = t["benefit_rules"].filter(is_verified()).groupBy("admission_campaign_id").agg(
        F.count(F.lit(1)).alias("verified_benefits_count")
    )
    result = campaigns.join(universities, "university_id").join(counts, "admission_campaign_id", "left").select(
        "code", "name", "city", "official_url", "rules_url", "rules_checked_at",
        F.coalesce("verified_benefits_count", F.lit(0)).alias("verified_benefits_count"),
    )
    return result.orderBy(F.desc("verified_benefits_count"), "name").limit(limit) if limit else result


def verified_catalog(t: Tables) -> DataFrame:
    """The verified catalogue: one row per rule and subject of its profile."""
    subjects = t["olympiad_profile_subjects"].join(
        t["subjects"].select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name")), "subject_id", "left"
    ).drop("subject_id")
    return _rule_star(t, None, "left").join(subjects, "olympiad_profile_id", "left").select(
        "campaign_year", "university_name", F.col("programme_name").alias("program_name"), "olympiad_title",
        "profile_title", F.col("olympiad_level").alias("level"), "subject_name", "diploma_status", "benefit_kind",
        "point_value", "confirmation_subject_name", "confirmation_min_score", "is_verified", "verification_status",
        "source_url", "source_locator", "checked_at",
    )


def public_rules(t: Tables, campaign_year: int) -> DataFrame:
    """Rules of the public snapshot: placed at an active location whose benefits are verified."""
    star = _rule_star(t, campaign_year, "inner").filter(
        F.col("location_is_active") & (F.col("location_status") == "benefits_verified")
    )
    return star.withColumn("checked_at", F.date_format("checked_at", "yyyy-MM-dd")).select(*PUBLIC_RULE)


PUBLIC_RULE = (
    "university_code", "university_location_code", "programme_name", "olympiad_title", "profile_title",
    "olympiad_level", "diploma_status", "benefit_kind", "point_value", "confirmation_subject_name",
    "confirmation_min_score", "source_url", "source_locator", "checked_at",
)
PUBLIC_RULE_ORDER = (
    "university_code", "university_location_code", "programme_name", "olympiad_title", "profile_title",
    "diploma_status", "benefit_kind",
)
PUBLIC_PROGRAMME = (
    "university_code", "university_location_code", "external_code", "programme_name", "catalogue_status",
    "degree_level", "verified_benefits_count", "source_url", "checked_at",
)


def approved_profiles(t: Tables, campaign_year: int | None = None, source_code: str = "rsosh") -> DataFrame:
    """Catalogue of approved profiles of the official list, for matching."""
    source = t["sources"].filter(F.col("code") == source_code).select(F.col("id").alias("source_id"))
    competitions = t["olympiads"].filter("is_active").select(F.col("id").alias("olympiad_id"), "title")
    profiles = t["olympiad_profiles"].filter((F.col("approval_status") == "approved") & F.col("is_active"))
    if campaign_year is not None:
        profiles = profiles.filter(F.col("campaign_year") == campaign_year)
    return (
        profiles.join(source, "source_id", "left_semi")
        .join(competitions, "olympiad_id")
        .select(F.col("id").alias("profile_id"), "title", "profile_title", "level", "campaign_year")
    )
