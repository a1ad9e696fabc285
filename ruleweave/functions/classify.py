"""Keyword classification of free text and of single table cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ruleweave import vocab
from ruleweave.functions.text import (
    DIRECTION_CODE, SOFT_HYPHEN,
    col, compact, contains_any, direction_code, distinct_codes, fold_compacted, fold_unquoted, let, level_of_code,
)


def first_kind(folded: Column, kinds: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """First kind, in the given order, one of whose terms occurs in the folded text."""
    result = None
    for kind, terms in kinds:
        hit = contains_any(folded, terms)
        result = F.when(hit, kind) if result is None else result.when(hit, kind)
    return result


def first_fragment(folded: Column, fragments: tuple[tuple[str, str], ...]) -> Column:
    return first_kind(folded, tuple((code, (fragment,)) for fragment, code in fragments))


def single_holder(
    folded: Column, winner: str = vocab.WINNER_FRAGMENT, prize: str = vocab.PRIZE_FRAGMENT
) -> Column:
    """One holder kind only; both or none is left to a reviewer."""
    has_winner, has_prize = F.contains(folded, F.lit(winner)), F.contains(folded, F.lit(prize))
    return F.when(has_winner & ~has_prize, "winner").when(has_prize & ~has_winner, "prize_winner")


def pattern_score(folded: Column, pattern: str = vocab.MIN_SCORE_PATTERN) -> Column:
    """Number caught by the pattern, kept only inside 0..100."""
    number = F.regexp_extract(folded, pattern, 1).try_cast("int")
    return let(number, lambda n: F.when(n.between(0, 100), n))


def cell_score(value: Column | str) -> Column:
    """First free-standing number of two or three digits, kept only inside 0..100."""
    return score_in(fold_unquoted(value))


def score_in(unquoted: Column) -> Column:
    return pattern_score(unquoted, r"(?U)\b(\d{2,3})\b")


def holder_statuses(value: Column | str) -> Column:
    """All holder kinds named in a cell, winner first."""
    return let(fold_unquoted(value), holders_in)


def holders_in(unquoted: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.contains(unquoted, F.lit(vocab.WINNER_FRAGMENT)), "winner"),
            F.when(F.contains(unquoted, F.lit(vocab.PRIZE_FRAGMENT)), "prize_winner"),
        )
    )


def exact_subject(value: Column | str, aliases: tuple[tuple[str, str], ...] = vocab.SUBJECT_ALIASES) -> Column:
    return subject_in(fold_unquoted(value), aliases)


def subject_in(unquoted: Column, aliases: tuple[tuple[str, str], ...] = vocab.SUBJECT_ALIASES) -> Column:
    names = F.create_map(*[F.lit(item) for pair in aliases for item in pair])
    return F.try_element_at(names, unquoted)


def selectors(value: Column | str) -> Column:
    """All full codes of a cell, else its one exact name, else nothing for a collective phrase."""
    return let(compact(value), selectors_in)


def selectors_in(cell: Column) -> Column:
    """``selectors`` of a cell that is compacted already."""
    collective = let(fold_unquoted(cell), lambda folded: contains_any(folded, vocab.PROHIBITED_SELECTORS))
    return (
        F.when(cell.rlike(DIRECTION_CODE), distinct_codes(cell))
        .when((cell == "") | collective, F.array().cast("array<string>"))
        .otherwise(F.array(cell))
    )


def cell_benefit(header: Column | str, value: Column | str, generic: Column | bool = False) -> Column:
    """Benefit granted by a (header, cell) pair; 100 points is tested before admission without exams."""
    return let(fold_unquoted(header), lambda head: let(fold_unquoted(value), lambda text: benefit_in(head, text, generic)))


def benefit_in(head: Column, text: Column, generic: Column | bool = False) -> Column:
    """``cell_benefit`` of a header and a cell that are folded already."""
    is_generic = F.lit(generic) if isinstance(generic, bool) else generic
    hundred = F.contains(head, F.lit(vocab.HUNDRED_HEADER)) | (is_generic & contains_any(text, vocab.HUNDRED_VALUES))
    bvi = contains_any(head, vocab.BVI_WORDS) | (is_generic & contains_any(text, vocab.BVI_WORDS))
    granted = ~((text == "") | text.isin(*vocab.NO_BENEFIT))
    return F.when(granted & hundred, "hundred_points").when(granted & bvi, "bvi")


def _list_pattern(separator: str, starts: tuple[str, ...]) -> str:
    return f"(?iuU){separator}(?=(?:{'|'.join(starts)})\\b)"


def marked_titles(value: Column | str, markers: tuple[str, ...] = vocab.LIST_MARKERS) -> Column:
    """Split a list after a comma or semicolon where the next part starts a new title."""
    parts = F.split(col(value), _list_pattern(r"[,;]\s+", markers), -1)
    return F.filter(F.transform(parts, lambda part: compact(part)), lambda part: part != "")


def strict_titles(
    value: Column | str,
    starts: tuple[str, ...] = vocab.LIST_STARTS,
    noun: str = vocab.LIST_NOUN,
    exception: str = vocab.LIST_EXCEPTION,
) -> Column:
    """Split at semicolons and at commas before a new title; a part without the noun voids the list."""
    pattern = rf"(?iuU)\s*(?:;|,\s+(?=(?:{'|'.join(starts)})\b))\s*"
    none = F.array().cast("array<string>")

    def sound(part: Column) -> Column:
        return let(fold_unquoted(part), lambda text: F.contains(text, F.lit(noun)) | (text == exception))

    def titles(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, pattern, -1), lambda p: compact(p)), lambda p: p != "")
        return F.when(text.isin("", "*"), none).otherwise(
            let(parts, lambda found: F.when(F.forall(found, sound), F.array_distinct(found)).otherwise(none))
        )

    return let(compact(value), titles)


def subject_tags(value: Column | str) -> Column:
    """Distinct subject tags in rule order, or the default tag."""
    none = F.array().cast("array<string>")

    def tagged(text: Column) -> Column:
        hits = [
            F.when(F.contains(text, F.lit(word)), F.array(*[F.lit(tag) for tag in tags])).otherwise(none)
            for word, tags in vocab.SUBJECT_TAGS
        ]
        return F.array_distinct(F.flatten(F.array(*hits)))

    return let(
        let(F.lower(col(value)), tagged),
        lambda tags: F.when(F.size(tags) == 0, F.array(F.lit(vocab.DEFAULT_SUBJECT))).otherwise(tags),
    )


def split_code(value: Column | str) -> Column:
    """Struct (code, title): the title is the text after the code, else the text before it."""
    return let(compact(value), split_code_in)


def split_code_in(text: Column) -> Column:
    """``split_code`` of a text that is compacted already."""
    pattern = r"(?s)^(.*?)(?<!\d)(\d{2}\.\d{2}\.\d{2})(?!\d)(.*)$"

    def part(group: int) -> Column:
        return F.btrim(F.regexp_extract(text, pattern, group), F.lit(" —–-:;,"))

    titled = let(part(3), lambda after: F.when(after != "", after).otherwise(part(1)))
    found = text.rlike(DIRECTION_CODE)
    return F.struct(
        F.when(found, F.regexp_extract(text, DIRECTION_CODE, 1)).alias("code"),
        F.when(found, titled).otherwise(text).alias("title"),
    )


def is_direction(code: Column | str) -> Column:
    """Bachelor and specialist directions only: local course identifiers are not admitted."""
    return F.coalesce(direction_code(code).rlike(r"^(?!00)\d\d\.0[35]\.(?!00)\d\d$"), F.lit(False))


def valid_name(value: Column | str) -> Column:
    return let(compact(value), valid_name_in)


def valid_name_in(text: Column) -> Column:
    """``valid_name`` of a text that is compacted already."""
    blocked = let(fold_compacted(text), lambda folded: contains_any(folded, vocab.BLOCKED_NAMES))
    return F.length(text).between(3, 240) & text.rlike(r"\p{L}") & ~blocked


def programme_level(code: Column, context: Column) -> Column:
    by_code = level_of_code(code)
    # a word without spaces is found whether or not they are collapsed
    folded = fold_compacted(F.replace(context, F.lit(SOFT_HYPHEN), F.lit("")))
    by_word = F.when(F.contains(folded, F.lit(vocab.SPECIALIST_WORD)), "specialist").otherwise("bachelor")
    return F.when(code.isNotNull() & (by_code == "specialist"), "specialist").otherwise(by_word)
