"""Text column functions: whitespace, folding, keys, dates, codes.

Everything here returns a Column built from JVM expressions, so it stays inside the scan stage.
"""

from __future__ import annotations

import html.entities
import json
import string
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Every character that counts as white space, besides the plain space. Written for the matcher's
# speed: single Latin characters share one bit set, and the rare ones hide behind one range test.
ODD = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
SPACE = f"[ {ODD}]"
# A run that is not already one plain space, so that tidy text passes without any replacement.
UNTIDY = f"{SPACE}(?:{SPACE}+|(?<=[{ODD}]))"
EDGES = f"^{SPACE}+|{SPACE}+$"
SOFT_HYPHEN = "\u00ad"
QUOTES = "[«»\"'`]+"
NO_TOKEN = f"[^{string.ascii_lowercase}{string.digits}а-я]+"
LINE_BREAK = r"[\n\x0b\f\r\x1c\x1d\x1e\x85[\u2028-\u2029]]"
DIRECTION_CODE = r"(?<!\d)(\d{2}\.\d{2}\.\d{2})(?!\d)"
FULL_CODE = r"^\d{2}\.\d{2}\.\d{2}$"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times.

    Inside array lambdas the engine shares no common subexpressions, so an expression that is
    written n times runs n times there; a one-element array binds it to a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column | str) -> Column:
    return F.regexp_replace(col(value), EDGES, "")


def collapse(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(value), UNTIDY, " "))


def compact(value: Column | str) -> Column:
    """Drop soft hyphens, collapse white space of any kind, trim."""
    return collapse(F.replace(col(value), F.lit(SOFT_HYPHEN), F.lit("")))


def casefold(value: Column | str) -> Column:
    """Lower case with the one full folding that occurs in European text (sharp s)."""
    return F.replace(F.lower(col(value)), F.lit("ß"), F.lit("ss"))


def _plain_yo(value: Column) -> Column:
    return F.replace(value, F.lit("ё"), F.lit("е"))


def fold(value: Column | str) -> Column:
    """Comparison form that keeps quotes: compacted, case-folded, yo written as ye."""
    return fold_compacted(compact(value))


def fold_compacted(value: Column | str) -> Column:
    """``fold`` of a text that is compacted already."""
    return _plain_yo(casefold(value))


def fold_unquoted(value: Column | str) -> Column:
    """Comparison form of the strict readers: as ``fold`` without any quote marks."""
    plain = fold_compacted(F.replace(col(value), F.lit(SOFT_HYPHEN), F.lit("")))
    return collapse(F.regexp_replace(plain, QUOTES, ""))


def fold_tokens(value: Column | str) -> Column:
    """Comparison form of titles: letters and digits separated by single spaces."""
    return F.trim(F.regexp_replace(_plain_yo(casefold(value)), NO_TOKEN, " "))


def contains_any(value: Column, fragments: list[str] | tuple[str, ...]) -> Column:
    """Any of the fragments occurs, by searches in the stored bytes: a pattern of alternatives would decode the
    text and try each alternative at each character. ``value`` is written once per fragment, so it should be a name."""
    result = F.lit(False)
    for fragment in fragments:
        hit = F.contains(value, F.lit(fragment))
        result = hit if fragment == fragments[0] else result | hit
    return result


def contains_all(value: Column, fragments: list[str] | tuple[str, ...]) -> Column:
    result = F.lit(True)
    for fragment in fragments:
        result = result & F.contains(value, F.lit(fragment))
    return result


def stable_key(*parts: Column | str, length: int = 32) -> Column:
    """Reproducible key in place of an identity column; NULL parts count as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(part).cast("string"), F.lit("")) for part in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def competition_key(audience: Column | str, title: Column | str) -> Column:
    digest = F.substring(F.sha2(collapse(casefold(title)), 256), 1, 20)
    return F.concat(col(audience), F.lit(":"), digest)


def split_lines(value: Column | str) -> Column:
    """Array of lines at every Unicode line boundary, without a final empty line."""
    lines = F.split(F.replace(col(value), F.lit("\r\n"), F.lit("\n")), LINE_BREAK, -1)
    return let(
        lines,
        lambda found: F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found),
    )


def distinct_codes(value: Column | str) -> Column:
    """Full direction codes in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(col(value), F.lit(DIRECTION_CODE), 1))


def direction_code(value: Column | str) -> Column:
    return let(strip(value), lambda stripped: F.when(stripped.rlike(FULL_CODE), stripped))


def level_of_code(code: Column | str) -> Column:
    """The middle block 05 marks a specialist programme."""
    return F.when(F.split_part(col(code), F.lit("."), F.lit(2)) == "05", "specialist").otherwise("bachelor")


def campaign_year_of(source: Column | str, default: int = 2025) -> Column:
    year = F.regexp_extract(F.coalesce(col(source), F.lit("")), r"(20\d{2})\s*/\s*20\d{2}", 1)
    return F.when(year != "", year.cast("int")).otherwise(F.lit(default))


def level_number(level: Column | str) -> Column:
    return F.when(col(level).isin("1", "2", "3"), col(level).cast("int"))


def http_date(value: Column | str) -> Column:
    """RFC 1123 date as a timestamp, NULL when it does not parse."""
    bare = F.regexp_replace(strip(value), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z"))


@lru_cache(maxsize=1)
def _entity_table() -> tuple[str, str]:
    """Named references of HTML5 from the standard library, as JSON, and the bare legacy names."""
    named = {"&" + name: value for name, value in html.entities.html5.items()}
    bare = sorted((name for name in html.entities.html5 if not name.endswith(";")), key=len, reverse=True)
    return json.dumps(named), "|".join(bare)


def unescape(value: Column | str) -> Column:
    """Decode character references without leaving the JVM.

    The distinct references of a value are decoded once each and put between the pieces of text around
    them, so what a reference decodes to is never read again.
    """
    return let(col(value), _unescaped)


def _unescaped(text: Column) -> Column:
    table, bare = _entity_table()
    names = F.from_json(F.lit(table), "map<string,string>")
    token = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"

    def decoded(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#([0-9]+)", 1)
        hexa = F.regexp_extract(ref, r"^&#[xX]([0-9a-fA-F]+)", 1)
        point = F.coalesce(
            F.expr("CAST(NULL AS BIGINT)"),
            F.when(digits != "", digits.try_cast("bigint")),
            F.when(hexa != "", F.conv(hexa, 16, 10).try_cast("bigint")),
        )
        legacy = F.regexp_extract(ref, f"^&({bare})", 1)
        numeric = F.when(point.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        prefix = F.when(
            legacy != "",
            F.concat(F.try_element_at(names, F.concat(F.lit("&"), legacy)), F.substring(ref, F.length(legacy) + 2, F.length(ref))),
        )
        return F.coalesce(numeric, F.try_element_at(names, ref), prefix, ref)

    def joined(pieces: Column, refs: Column) -> Column:
        known = let(F.array_distinct(refs), lambda names: F.map_from_arrays(names, F.transform(names, decoded)))
        plain = let(known, lambda table: F.transform(refs, lambda ref: F.element_at(table, ref)))
        return F.array_join(F.flatten(F.zip_with(pieces, plain, lambda piece, ref: F.array(piece, ref))), "", "")

    done = let(F.split(text, token, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(token), 0), lambda refs: joined(pieces, refs)))
    return F.when(F.contains(text, F.lit("&")), done).otherwise(text)


def strip_tags(value: Column | str) -> Column:
    """Text of an HTML fragment: tags become spaces, references decoded, spaces collapsed."""
    return collapse(unescape(F.regexp_replace(col(value), r"<[^>]+>", " ")))
