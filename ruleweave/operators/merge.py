"""Upserts as pure functions: (base, changes) -> new base, written to a new version by the caller.

All keys compare null-safely (NULL equals NULL), as the unique keys of the catalogue do. Base and
changes hold one row per key; ``ordered.keep_last`` makes a change set so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ACTION = "merge_action"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def upsert(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    *,
    update: Sequence[str] | None = None,
    keep_old_if_null: Sequence[str] = (),
    guard: str | None = None,
    with_action: bool = False,
) -> DataFrame:
    """Insert new keys, update known ones.

    ``update`` limits the columns an existing row takes from its change; ``keep_old_if_null`` names
    columns where a NULL change keeps the old value; ``guard`` is a predicate on the base row
    without which it stays as it is. Columns that changes lack are NULL in inserted rows.
    """
    given = set(changes.columns)
    updated = [c for c in (update if update is not None else base.columns) if c in given and c not in keys]
    old = base.withColumn("_known", F.lit(True)).withColumn("_open", F.expr(guard) if guard else F.lit(True))
    old = old.select(*[F.col(c).alias(f"_o_{c}") for c in base.columns], "_known", "_open")
    new = changes.select(*[F.col(c).alias(f"_n_{c}") for c in changes.columns]).withColumn("_given", F.lit(True))
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"_o_{key}").eqNullSafe(F.col(f"_n_{key}"))
    joined = old.join(new, condition, "full_outer")
    inserted = F.col("_known").isNull()
    replaced = F.col("_given").isNotNull() & F.coalesce(F.col("_open"), F.lit(False))

    def value(name: str) -> Column:
        if name in keys:
            return F.when(inserted, F.col(f"_n_{name}")).otherwise(F.col(f"_o_{name}"))
        fresh = F.col(f"_n_{name}") if name in given else F.lit(None).cast(base.schema[name].dataType)
        if name not in updated:
            return F.when(inserted, fresh).otherwise(F.col(f"_o_{name}"))
        change = F.coalesce(fresh, F.col(f"_o_{name}")) if name in keep_old_if_null else fresh
        return F.when(inserted, fresh).when(replaced, change).otherwise(F.col(f"_o_{name}"))

    columns = [value(c).cast(base.schema[c].dataType).alias(c) for c in base.columns]
    if with_action:
        columns.append(
            F.when(inserted, "inserted")
            .when(replaced, "updated")
            .when(F.col("_given").isNotNull(), "guarded")
            .otherwise("kept")
            .alias(ACTION)
        )
    return joined.select(*columns)


def insert_missing(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert only the keys that the base does not have."""
    fresh = changes.alias("n").join(base.alias("o"), _same(changes, base, keys), "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def replace_children(
    children: DataFrame, new_children: DataFrame, touched_parents: DataFrame, parent: str
) -> DataFrame:
    """Replace the whole child set of the touched parents, even by nothing; others keep theirs."""
    kept = children.join(touched_parents.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(new_children.select(*children.columns).distinct())


def update_from(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Overwrite columns of matched rows, change nothing else and insert nothing."""
    new = updates.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    joined = base.join(new, list(keys), "left")
    return joined.select(
        *[
            (F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c)
            for c in base.columns
        ]
    )


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Drop children whose parent is gone; a child without a parent reference stays."""
    live = parents.select(F.col(parent_key).alias("_parent")).distinct()
    kept = children.filter(F.col(child_key).isNotNull()).join(live, F.col(child_key) == F.col("_parent"), "left_semi")
    return kept.unionByName(children.filter(F.col(child_key).isNull()))


def set_null(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Keep children, but clear a reference whose parent is gone."""
    live = parents.select(F.col(parent_key).alias("_parent")).distinct().withColumn("_live", F.lit(True))
    joined = children.join(live, F.col(child_key) == F.col("_parent"), "left")
    return joined.select(
        *[F.when(F.col("_live"), F.col(c)).alias(c) if c == child_key else F.col(c) for c in children.columns]
    )
