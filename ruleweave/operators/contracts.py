"""Validation: rule tables, duplicate keys, missing parents, and the guard on empty results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions.text import FULL_CODE


class ContractViolation(ValueError):
    """A published payload would break its contract; nothing of it may be written."""


def blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def required(*names: str) -> dict[str, Column]:
    return {f"missing_{name}": blank(name) for name in names}


def one_of(name: str, values: Sequence[str]) -> dict[str, Column]:
    return {f"unsupported_{name}": ~blank(name) & ~F.col(name).isin(*values)}


def in_range(name: str, low: int, high: int) -> dict[str, Column]:
    return {f"out_of_range_{name}": F.col(name).isNotNull() & ~F.col(name).between(low, high)}


def public_rule_contract() -> dict[str, Column]:
    points = F.col("benefit_kind") == "individual_points"
    return (
        required(
            "university_code", "university_location_code", "programme_name", "olympiad_title", "profile_title",
            "olympiad_level", "diploma_status", "benefit_kind", "source_url", "checked_at",
        )
        | one_of("diploma_status", vocab.DIPLOMAS)
        | one_of("benefit_kind", vocab.BENEFITS)
        | in_range("olympiad_level", 1, 3)
        | {
            "invalid_points": points & ~F.coalesce(F.col("point_value").between(1, 10), F.lit(False)),
            "unexpected_points": ~points & F.col("point_value").isNotNull(),
        }
    )


def public_programme_contract() -> dict[str, Column]:
    code_only = F.col("catalogue_status") == "code_only"
    return (
        required(
            "university_code", "university_location_code", "programme_name", "catalogue_status", "degree_level",
            "source_url", "checked_at",
        )
        | one_of("catalogue_status", vocab.PROGRAMME_STATUSES)
        | one_of("degree_level", vocab.DEGREE_LEVELS)
        | {"incomplete_code": code_only & ~F.coalesce(F.col("external_code").rlike(FULL_CODE), F.lit(False))}
    )


def location_contract() -> dict[str, Column]:
    return (
        required(
            "id", "university_code", "name", "campus_name", "campus_type", "official_url", "location_source_url",
            "admission_status",
        )
        | one_of("campus_type", vocab.LOCATION_TYPES)
        | one_of("admission_status", vocab.LOCATION_STATUSES)
    )


def violations(df: DataFrame, rules: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per broken rule of each row; NULL outcomes of a rule count as kept."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(*keep, F.explode(broken).alias("violation"))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    bad = F.lit(False)
    for rule in rules.values():
        bad = bad | F.coalesce(rule, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def enforce(df: DataFrame, rules: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """All or nothing: raise on the first broken rule, else return the frame unchanged."""
    first = violations(df, rules, keep).first()
    if first is not None:
        raise ContractViolation(f"{first['violation']}: {first.asDict()}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; NULL equals NULL."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def missing_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct child references that no parent has."""
    known = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.select(child_key).filter(F.col(child_key).isNotNull()).distinct().join(known, child_key, "left_anti")


def zero_row_guard(current: DataFrame, parsed: DataFrame, attempted: DataFrame, target: str) -> DataFrame:
    """New version of a catalogue: targets that parsed no row keep their current rows."""
    parsed_targets = parsed.select(target).distinct()
    refreshed = attempted.select(target).distinct().join(parsed_targets, target, "left_semi")
    kept = current.join(refreshed, target, "left_anti")
    return kept.unionByName(parsed)
