"""Order-dependent operators over long-form tables, safe against one huge group.

A window over a whole document would put that document into one task. The scans below cut every
group into chunks of consecutive order values, work inside the chunks, and hand over only one
summary row per chunk, so the serial part shrinks by the chunk length.

The order column is an integer that is unique within its group (a line number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 65_536


def _chunk(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk))


def carry_forward(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    marks: dict[str, Column],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add one struct column (order value, value) per mark: its last non-NULL value so far.

    ``marks`` maps an output name to the expression that is carried; NULL means "nothing here".
    The struct's position tells whether something newer has reset the value.
    """
    names = list(marks)
    cut = df.withColumns(
        {"_chunk": _chunk(order, chunk)}
        | {
            f"_mark_{name}": F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("value")))
            for name, value in marks.items()
        }
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns(
        {f"_local_{name}": F.last(f"_mark_{name}", ignorenulls=True).over(inside) for name in names}
    ).drop(*[f"_mark_{name}" for name in names])
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        cut.groupBy(*group, "_chunk")
        .agg(*[F.max(f"_mark_{name}").alias(f"_end_{name}") for name in names])
        .select(
            *group,
            "_chunk",
            *[F.last(f"_end_{name}", ignorenulls=True).over(before).alias(f"_prior_{name}") for name in names],
        )
    )
    return (
        local.join(handed, [*group, "_chunk"], "left")
        .withColumns({name: F.coalesce(f"_local_{name}", f"_prior_{name}") for name in names})
        .drop("_chunk", *[f"_local_{name}" for name in names], *[f"_prior_{name}" for name in names])
    )


def table_islands(df: DataFrame, group: Sequence[str], order: str, is_row: Column, chunk: int = CHUNK) -> DataFrame:
    """Number maximal runs of consecutive table lines by their first line; other lines drop out.

    The last line that is no table line names the run, so an island needs no look-behind.
    """
    flagged = df.withColumn("_is_row", is_row)
    scanned = carry_forward(flagged, group, order, {"_break": F.when(~F.col("_is_row"), F.col(order))}, chunk)
    return (
        scanned.filter("_is_row")
        .withColumn("table_no", F.coalesce(F.col("_break.at") + 1, F.lit(1)).cast("long"))
        .drop("_is_row", "_break")
    )


def scoped_carry(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    scope: Column,
    values: dict[str, Column],
    chunk: int = CHUNK,
) -> DataFrame:
    """Carry values inside the scope opened by the latest scope row.

    A scope row resets every carried value. Scope rows themselves and rows before the first
    scope are dropped.
    """
    scanned = carry_forward(df.withColumn("_scope_here", scope), group, order, {"_scope": F.col("_scope_here"), **{f"_v_{k}": v for k, v in values.items()}}, chunk)
    inside = scanned.filter(F.col("_scope").isNotNull() & F.col("_scope_here").isNull())
    return inside.withColumns(
        {"scope": F.col("_scope.value"), "scope_line": F.col("_scope.at")}
        | {k: F.when(F.col(f"_v_{k}.at") > F.col("_scope.at"), F.col(f"_v_{k}.value")) for k in values}
    ).drop("_scope_here", "_scope", *[f"_v_{k}" for k in values])


def context_window(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    text: str,
    before: int = 2,
    after: int = 2,
    chunk: int = CHUNK,
    output: str = "context",
) -> DataFrame:
    """Text of the neighbouring lines joined by spaces; order values must be dense.

    Only lines next to a chunk border are copied, into the chunk whose windows need them.
    """
    own = _chunk(order, chunk)
    homes = F.array_distinct(
        F.array(
            own,
            F.floor(F.greatest(F.col(order) - after, F.lit(0)) / F.lit(chunk)),
            F.floor((F.col(order) + before) / F.lit(chunk)),
        )
    )
    copies = df.withColumn("_own", own).withColumn("_home", F.explode(homes))
    near = Window.partitionBy(*group, "_home").orderBy(order).rowsBetween(-before, after)
    joined = copies.withColumn(output, F.array_join(F.collect_list(text).over(near), " "))
    return joined.filter(F.col("_own") == F.col("_home")).drop("_own", "_home")


def header_argmax(
    rows: DataFrame, table: Sequence[str], order: str, score: Column, tie: str = "first", minimum: int = 0
) -> DataFrame:
    """Header line of each table: the best score, ties to the first or the last line.

    One partial aggregate per table; nothing is sorted and no table is collected.
    """
    rank = F.struct(score.alias("score"), (-F.col(order) if tie == "first" else F.col(order)).alias("tie"))
    best = rows.groupBy(*table).agg(
        F.max(rank).alias("_best"), F.count(F.lit(1)).alias("n_rows")
    )
    line = -F.col("_best.tie") if tie == "first" else F.col("_best.tie")
    return best.select(
        *table, line.alias("header_line"), F.col("_best.score").alias("header_score"), "n_rows"
    ).filter(F.col("header_score") >= minimum)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key in the given order.

    The planner pushes the limit below the shuffle (a group limit per task), so a hot key sends at
    most ``n`` rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """De-duplicate by key, the first row in order wins."""
    return top_per_key(df, keys, [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """De-duplicate by key, the last row in order wins."""
    return top_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])
