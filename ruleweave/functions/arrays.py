"""Array expressions over the lines or cells of one row.

A document is one row, so everything that looks at neighbouring lines of the same document is an
array expression: linear in the lines, and without any shuffle. The long-form counterparts, for
line tables whose documents do not fit a row, are in ``operators.ordered``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ruleweave.functions.text import let


def positions(flags: Column) -> Column:
    """One-based positions of the true entries."""
    numbered = F.transform(flags, lambda flag, index: F.when(flag, index + 1))
    return F.array_compact(numbered)


def runs(flags: Column) -> Column:
    """Maximal runs of true entries as structs (first, last), one-based."""

    def edges(f: Column, step: int) -> Column:
        return positions(F.transform(f, lambda flag, i: flag & ~F.coalesce(F.get(f, i + step), F.lit(False))))

    return let(
        flags,
        lambda f: F.zip_with(
            edges(f, -1),
            edges(f, 1),
            lambda first, last: F.named_struct(F.lit("first"), first, F.lit("last"), last),
        ),
    )


def last_position(flags: Column) -> Column:
    """For each entry the position of the last true entry at or before it, NULL when none.

    Each stretch between two true entries is one ``array_repeat``, so the cost is linear.
    """

    def fill(marks: Column, size: Column) -> Column:
        head = F.array_repeat(F.lit(None).cast("int"), F.coalesce(F.get(marks, F.lit(0)), size + 1) - 1)
        stretches = F.transform(
            marks, lambda mark, k: F.array_repeat(mark, F.coalesce(F.get(marks, k + 1), size + 1) - mark)
        )
        return F.concat(head, F.flatten(stretches))

    return let(flags, lambda f: let(positions(f), lambda marks: let(F.size(f), lambda size: fill(marks, size))))


def carry(values: Column) -> Column:
    """Carry the last non-empty value forward; entries before the first one stay empty strings."""

    def carried(v: Column) -> Column:
        spots = last_position(F.transform(v, lambda value: F.coalesce(value, F.lit("")) != ""))
        return F.transform(spots, lambda spot: F.coalesce(F.get(v, spot - 1), F.lit("")))

    return let(values, carried)


def first_index(values: Column, test: Callable[[Column], Column]) -> Column:
    """Zero-based index of the first entry that passes, NULL when none does."""
    spot = F.array_position(F.transform(values, lambda value: F.coalesce(test(value), F.lit(False))), True)
    return F.nullif(spot, F.lit(0)).cast("int") - 1


def all_indexes(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform(values, lambda value, index: F.when(test(value), index)))


def cell_at(cells: Column, index: Column) -> Column:
    """Cell by zero-based index; a missing column or a short row reads as empty."""
    return F.coalesce(F.get(cells, index), F.lit(""))


def first_value(values: Column) -> Column:
    """First non-NULL entry."""
    return F.get(F.array_compact(values), F.lit(0))
