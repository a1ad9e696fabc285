"""Explicit schemas of the catalogue tables and file inputs; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "short": T.ShortType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,int>": T.MapType(T.StringType(), T.IntegerType()),
}


def struct(fields: str) -> T.StructType:
    """Schema of a ``name type, name type`` list; needs no session, so it can stand at module level."""
    pairs = (field.split(" ", 1) for field in fields.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_DDL = {
    "sources": "id long, code string, name string, base_url string, source_kind string, is_active boolean, created_at timestamp",
    "source_documents": "id long, source_id long, url string, fetched_at timestamp, content_sha256 string, storage_key string, content_type string, content_size_bytes long, http_etag string, source_last_modified_at timestamp, title string, metadata string",
    "subjects": "id short, code string, name string",
    "olympiads": "id long, external_key string, title string, audience string, kind string, organizer_name string, official_url string, is_active boolean, created_at timestamp, updated_at timestamp",
    "olympiad_profiles": "id long, olympiad_id long, source_id long, campaign_year short, profile_title string, level short, approval_status string, source_url string, registration_opens_at timestamp, registration_closes_at timestamp, last_checked_at timestamp, is_active boolean",
    "olympiad_profile_subjects": "olympiad_profile_id long, subject_id short",
    "olympiad_stages": "olympiad_profile_id long, stage_kind string, starts_at timestamp, ends_at timestamp, source_url string, checked_at timestamp",
    "universities": "id long, code string, name string, city string, official_url string, is_active boolean",
    "university_locations": "id long, university_id long, code string, name string, location_type string, city string, region string, country string, official_url string, directory_url string, location_checked_at timestamp, admission_status string, admission_rules_url string, admission_checked_at timestamp, is_active boolean",
    "admission_campaigns": "id long, university_id long, campaign_year short, status string, rules_url string, rules_checked_at timestamp",
    "admission_source_targets": "id long, admission_campaign_id long, university_location_id long, source_id long, url string, source_role string, document_kind string, adapter_code string, adapter_config string, poll_interval_hours short, next_check_at timestamp, last_checked_at timestamp, last_successful_document_id long, is_active boolean",
    "university_catalogue_targets": "id long, university_location_id long, source_id long, url string, document_kind string, adapter_code string, adapter_config string, poll_interval_hours short, next_check_at timestamp, last_checked_at timestamp, last_successful_document_id long, is_active boolean",
    "admission_parse_runs": "id long, admission_source_target_id long, source_document_id long, adapter_code string, adapter_version string, started_at timestamp, finished_at timestamp, status string, records_seen int, candidates_created int, error_message string",
    "university_catalogue_parse_runs": "id long, university_catalogue_target_id long, source_document_id long, adapter_code string, adapter_version string, started_at timestamp, finished_at timestamp, status string, records_seen int, programmes_upserted int, error_message string",
    "official_source_discovery_targets": "id long, admission_campaign_id long, university_location_id long, source_id long, seed_url string, adapter_config string, poll_interval_hours short, next_check_at timestamp, last_checked_at timestamp, is_active boolean",
    "official_source_discovery_runs": "id long, official_source_discovery_target_id long, started_at timestamp, finished_at timestamp, status string, pages_seen int, candidates_found int, targets_attached int, error_message string",
    "official_source_discovery_candidates": "id long, official_source_discovery_run_id long, url string, document_kind string, title string, source_excerpt string, score short, signals map<string,int>, status string, admission_source_target_id long",
    "university_programs": "id long, university_id long, university_location_id long, external_code string, name string, catalogue_status string, degree_level string, catalogue_source_target_id long, catalogue_parse_run_id long, catalogue_source_url string, catalogue_checked_at timestamp, is_active boolean",
    "admission_policies": "id long, admission_campaign_id long, university_program_id long, policy_kind string, description string, source_url string, checked_at timestamp, is_verified boolean",
    "benefit_rules": "id long, admission_campaign_id long, university_program_id long, olympiad_profile_id long, diploma_status string, benefit_kind string, point_value short, confirmation_subject_id short, confirmation_min_score short, source_url string, source_document_id long, admission_parse_run_id long, source_locator string, source_excerpt string, checked_at timestamp, is_verified boolean, verification_status string, publication_method string, verified_at timestamp, verified_by string, last_seen_at timestamp, is_active boolean, notes string",
    "admission_rule_candidates": "id long, admission_parse_run_id long, source_document_id long, admission_campaign_id long, university_program_id long, olympiad_profile_id long, candidate_key string, source_locator string, source_excerpt string, payload_kind string, raw_payload string, raw_programme_name string, raw_olympiad_name string, raw_profile_name string, raw_rule_text string, suggested_olympiad_level short, suggested_diploma_status string, suggested_benefit_kind string, suggested_point_value short, suggested_confirmation_subject_id short, suggested_confirmation_min_score short, match_status string, review_status string, automatic_status string, automatic_note string, confidence short, published_benefit_rule_id long, created_at timestamp, reviewed_at timestamp",
    "admission_rule_reviews": "id long, admission_rule_candidate_id long, action string, reviewer_id string, notes string, resolved_payload string, created_at timestamp",
    "benefit_rule_observations": "benefit_rule_id long, source_document_id long, admission_parse_run_id long, admission_rule_candidate_id long, observed_status string, source_locator string, source_excerpt string, observed_at timestamp",
    "app_users": "id long, external_id string, audience string, grade_or_course string, default_diploma_year short, region string, updated_at timestamp",
    "user_subjects": "user_id long, subject_id short",
    "tracked_olympiads": "id long, user_id long, olympiad_profile_id long, is_active boolean, diploma_year short, added_at timestamp, last_notified_at timestamp",
    "notification_jobs": "id long, tracked_olympiad_id long, notification_kind string, scheduled_for timestamp, sent_at timestamp, payload string",
    "import_runs": "id long, source_document_id long, started_at timestamp, finished_at timestamp, status string, records_seen int, records_changed int, error_message string",
}

TABLES: dict[str, T.StructType] = {name: struct(ddl) for name, ddl in _DDL.items()}

COMPETITION_RECORD = struct(
    "id string, title string, audience string, subject string, subjects array<string>, subject_detail string, "
    "profile string, level string, level_label string, organizer string, deadline string, deadline_label string, "
    "source string, source_url string, kind string"
)
LOCATION_RECORD = struct(
    "id string, university_code string, name string, campus_name string, campus_type string, city string, "
    "region string, country string, official_url string, location_source_url string, admission_status string"
)
