"""Pipe-table column functions: cells, separators, header scores, header look-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ruleweave.functions import arrays
from ruleweave.functions.text import (
    QUOTES, SOFT_HYPHEN, SPACE, col, collapse, compact, contains_all, contains_any, fold_compacted, let, strip,
)

TABLE_LINE = rf"^{SPACE}*\|"
HEADING_LINE = rf"^{SPACE}*#"
RULE_CELL = r"^:?-{3,}:?$"


def is_table_line(line: Column | str) -> Column:
    return col(line).rlike(TABLE_LINE)


def is_heading_line(line: Column | str) -> Column:
    return col(line).rlike(HEADING_LINE)


def table_cells(line: Column | str) -> Column:
    """Compacted cells of a pipe row; outer pipes do not make cells.

    White space is collapsed in the whole row at once, so that a cell without soft hyphens only needs trimming.
    """
    cells = F.split(F.btrim(collapse(line), F.lit("|")), r"\|", -1)
    return F.transform(cells, lambda cell: F.when(F.contains(cell, F.lit(SOFT_HYPHEN)), compact(cell)).otherwise(F.trim(cell)))


def folded_cells(cells: Column) -> Column:
    """``fold`` of the cells of ``table_cells``, in one pass over the row."""
    return F.split(fold_compacted(F.array_join(cells, "\n")), "\n", -1)


def unquoted_cells(cells: Column) -> Column:
    """``fold_unquoted`` of the cells of ``table_cells``, in one pass over the row."""

    def bare(row: Column) -> Column:
        return F.when(row.rlike(QUOTES), F.regexp_replace(F.regexp_replace(row, QUOTES, ""), "  +", " ")).otherwise(row)

    joined = let(fold_compacted(F.array_join(cells, "\n")), bare)
    return F.transform(F.split(joined, "\n", -1), lambda cell: F.trim(cell))


def cells_are_rule(cells: Column) -> Column:
    """All cells are dashes; an empty cell counts as dashes."""
    return F.forall(cells, lambda cell: (cell == "") | cell.rlike(RULE_CELL))


def is_separator(line: Column | str) -> Column:
    return let(col(line), lambda text: (strip(text) != "") & cells_are_rule(table_cells(text)))


def term_score(cells: Column, terms: tuple[str, ...]) -> Column:
    """Number of (cell, term) pairs where the folded cell contains the term.

    ``cells`` are those of ``table_cells``, and are folded as one text. A term that the row does not hold is not
    looked for in its cells.
    """

    def cells_with(row: Column, term: Column) -> Column:
        inside = F.filter(F.split(row, "\n", -1), lambda cell: F.contains(cell, term))
        return F.when(F.contains(row, term), F.size(inside)).otherwise(0)

    def hits(row: Column) -> Column:
        total = F.lit(0)
        for term in terms:
            total = total + cells_with(row, F.lit(term))
        return total

    return let(fold_compacted(F.array_join(cells, "\n")), hits)


def any_alias(headers: Column, aliases: tuple[str, ...]) -> Column:
    """Indexes of all headers that contain any alias."""
    return arrays.all_indexes(headers, lambda header: contains_any(header, aliases))


def by_alias_priority(headers: Column, aliases: tuple[str, ...]) -> Column:
    """First header that contains the first alias that occurs at all: alias order decides."""
    return F.coalesce(
        *[arrays.first_index(headers, lambda header, a=alias: F.contains(header, F.lit(a))) for alias in aliases]
    )


def with_all_fragments(
    headers: Column, fragments: tuple[str, ...], exclude: tuple[str, ...] = ()
) -> Column:
    """First header that contains every fragment and none of the excluded ones."""
    return arrays.first_index(
        headers, lambda header: contains_all(header, fragments) & ~contains_any(header, exclude)
    )
