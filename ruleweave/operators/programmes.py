"""Programme names and codes from catalogue documents."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions import arrays
from ruleweave.functions.classify import is_direction, programme_level, split_code_in, valid_name_in
from ruleweave.functions.tables import by_alias_priority, folded_cells, is_heading_line, is_table_line
from ruleweave.functions.text import DIRECTION_CODE, FULL_CODE, compact, fold, fold_compacted, let, split_lines, strip
from ruleweave.operators.documents import tables_in
from ruleweave.operators.ordered import keep_first
from ruleweave.operators.stages import settle

TABLE = "struct<header_line: int, headers: array<string>, rows: array<struct<line: int, cells: array<string>>>>"
ITEMS = "array<struct<external_code: string, name: string, degree_level: string, source_locator: string, source_excerpt: string, line_no: int>>"
PROGRAMME = ("external_code", "name", "degree_level", "source_locator", "source_excerpt")
FORMAT = "map<string, struct<marker:string, name_headers:array<string>, require_code:boolean, readers:array<string>>>"


def formats(config: Sequence[vocab.CatalogueFormat] = vocab.CATALOGUE_FORMATS) -> Column:
    """The format table as one constant map; documents find their format without a join."""
    return F.from_json(F.lit(json.dumps({item.code: asdict(item) for item in config}, ensure_ascii=False)), FORMAT)


def _name_index(heads: Column, aliases: Column) -> Column:
    """First header with the first alias that occurs at all: alias order is semantic priority."""
    return arrays.first_value(
        F.transform(aliases, lambda alias: arrays.first_index(heads, lambda head: F.contains(head, alias)))
    )


def _excerpt(value: Column) -> Column:
    return F.substring(value, 1, vocab.EXCERPT_LENGTH)


def _item(code: Column, name: Column, level: Column, locator: Column, excerpt: Column, line_no: Column) -> Column:
    """What every reader makes of a programme."""
    named = {
        "external_code": code, "name": name, "degree_level": level, "source_locator": locator, "source_excerpt": excerpt,
        "line_no": line_no.cast("int"),
    }
    return F.struct(*[value.alias(name_) for name_, value in named.items()])


def _with(fields: dict[str, Column], body) -> Column:
    """Evaluate several values of a row once each and use them by name."""
    return let(F.struct(*[value.alias(name) for name, value in fields.items()]), body)


def _table_locator(table: Column, line: Column) -> Column:
    return F.concat(F.lit("markdown:table:"), table["header_line"], F.lit(":row:"), line)


def _by_name(table: Column, form: Column, read) -> Column:
    """Read a table whose folded headers have a name column."""

    def named(heads: Column) -> Column:
        return let(_name_index(heads, form["name_headers"]), lambda at: F.when(at.isNotNull(), read(heads, at)))

    return let(folded_cells(table["headers"]), named)


def table_programmes(table: Column, form: Column) -> Column:
    """Rows of a labelled table, whatever the column order."""

    def read(heads: Column, name_at: Column) -> Column:
        return let(by_alias_priority(heads, ("код",)), lambda code_at: F.array_compact(F.transform(table["rows"], lambda row: of(row, code_at, name_at))))

    def of(row: Column, code_at: Column, name_at: Column) -> Column:
        cells, name_cell = row["cells"], arrays.cell_at(row["cells"], name_at)
        own = F.when(code_at.isNotNull(), let(arrays.cell_at(cells, code_at), split_code_in))
        return _with({"own": own, "embedded": let(name_cell, split_code_in)}, lambda parts: parted(row, name_cell, parts))

    def parted(row: Column, name_cell: Column, parts: Column) -> Column:
        filled = lambda value: F.when(value != "", value)
        name = F.coalesce(filled(parts["own"]["title"]), filled(parts["embedded"]["title"]), name_cell)
        return _with({"code": F.coalesce(parts["own"]["code"], parts["embedded"]["code"]), "name": name}, lambda found: made(row, found))

    def made(row: Column, found: Column) -> Column:
        code, coded = found["code"], found["code"].isNotNull()
        level = programme_level(code, F.array_join(F.concat(table["headers"], row["cells"]), " "))
        kept = (~coded | is_direction(code)) & (coded | ~form["require_code"]) & valid_name_in(found["name"])
        return F.when(kept, _item(code, found["name"], level, _table_locator(table, row["line"]), _excerpt(F.array_join(row["cells"], " | ")), row["line"]))

    return _by_name(table, form, read)


def code_line_programmes(lines: Column) -> Column:
    """Lines with a full code; a line without a title takes the nearest heading above it."""
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("raw")))
    texts = F.transform(
        F.filter(numbered, lambda row: ~is_table_line(row["raw"])),
        lambda row: row.withField("text", compact(F.ltrim(row["raw"], F.lit("# ")))),
    )

    def read(free: Column) -> Column:
        titles = F.transform(free, lambda row: F.when(is_heading_line(row["raw"]) & valid_name_in(row["text"]), row["text"]).otherwise(""))
        return let(titles, lambda t: let(arrays.carry(t), lambda above: F.array_compact(F.transform(free, lambda row, i: coded(row, F.get(t, i), F.get(above, i))))))

    def coded(row: Column, title: Column, above: Column) -> Column:
        return F.when((title == "") & row["text"].rlike(DIRECTION_CODE), let(split_code_in(row["text"]), lambda parts: parted(row, above, parts)))

    def parted(row: Column, above: Column, parts: Column) -> Column:
        name = F.when(parts["title"] != "", parts["title"]).otherwise(above)
        return let(name, lambda own: F.when(is_direction(parts["code"]) & valid_name_in(own), _item(
            parts["code"], own, programme_level(parts["code"], F.concat_ws(" ", row["text"], above)),
            F.concat(F.lit("markdown:line:"), row["line_no"]), _excerpt(row["text"]), row["line_no"],
        )))

    return let(F.filter(texts, lambda row: row["text"] != ""), read)


def card_programmes(lines: Column) -> Column:
    """Third-level headings inside a programme section; the code stays unknown."""
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), strip(line).alias("text")))
    heads = F.transform(
        F.filter(numbered, lambda row: F.startswith(row["text"], F.lit("#"))),
        lambda row: F.struct(
            row["line_no"].alias("line_no"),
            F.length(F.substring_index(row["text"], " ", 1)).alias("level"),
            compact(F.regexp_extract(row["text"], r"(?s)^[^ ]* (.*)$", 1)).alias("title"),
        ),
    )

    def read(found: Column) -> Column:
        sections = arrays.last_position(F.transform(found, lambda h: h["level"] <= 2))
        return let(sections, lambda at: F.array_compact(F.transform(found, lambda head, i: of(head, F.get(found, F.get(at, i) - 1)["title"]))))

    def of(head: Column, section: Column) -> Column:
        title = head["title"]
        kept = (head["level"] == 3) & section.isNotNull() & F.contains(fold_compacted(section), F.lit(vocab.SECTION_WORD)) & valid_name_in(title)
        place = F.concat(F.lit("markdown:heading:"), head["line_no"])
        return F.when(kept, _item(F.lit(None).cast("string"), title, F.lit("bachelor"), place, title, head["line_no"]))

    return let(heads, read)


def summary_programmes(table: Column, form: Column) -> Column:
    """Rows of units below a code-only summary row, whose code they carry."""

    def code_of(row: Column) -> Column:
        first = F.substring_index(arrays.cell_at(row["cells"], F.lit(0)), " ", 1)
        code = F.regexp_extract(F.array_join(row["cells"], " "), DIRECTION_CODE, 1)
        return F.when(first.rlike(FULL_CODE) & is_direction(code), code).otherwise("")

    def read(heads: Column, name_at: Column) -> Column:
        def carried(codes: Column) -> Column:
            return let(arrays.carry(codes), lambda above: F.array_compact(F.transform(table["rows"], lambda row, i: of(row, F.get(codes, i), F.get(above, i), name_at))))

        return let(F.transform(table["rows"], code_of), carried)

    def of(row: Column, own: Column, above: Column, name_at: Column) -> Column:
        unit, name = arrays.cell_at(row["cells"], F.lit(0)), arrays.cell_at(row["cells"], name_at)
        is_unit = (unit != "") & (F.upper(unit) == unit) & unit.rlike(r"\p{L}")
        level = programme_level(above, F.array_join(row["cells"], " "))
        made = _item(above, name, level, _table_locator(table, row["line"]), _excerpt(F.array_join(row["cells"], " | ")), row["line"])
        return F.when((own == "") & (above != "") & is_unit & valid_name_in(name), made)

    return _by_name(table, form, read)


def catalogue_programmes(
    docs: DataFrame, key: str, adapter: str, text: str,
    config: Sequence[vocab.CatalogueFormat] = vocab.CATALOGUE_FORMATS,
) -> DataFrame:
    """Programmes of every document with a known adapter and its marker, first statement kept.

    Documents are read once: a document is exploded into its tables and, for readers of lines, its
    lines, and the readers of its format work on each inside the row. Readers are ranked per format; an
    earlier reader's row supersedes a later equal one. Only finished programmes cross the shuffle.
    """
    keep = [key, adapter]
    own = docs.filter(F.col(adapter).isin([item.code for item in config]))
    bound = own.withColumn("format", F.try_element_at(formats(config), F.col(adapter)))
    bound = bound.filter(F.col("format.marker").isNull() | F.contains(fold(text), F.col("format.marker")))
    lines = settle(bound, [*keep, "format"], {"lines": split_lines(text)})
    wants = lambda *readers: F.arrays_overlap("format.readers", F.array(*[F.lit(name) for name in readers]))
    none, no_table = F.lit(None).cast("array<string>"), F.lit(None).cast(TABLE)
    tables = F.when(wants("table", "summary"), F.transform(
        tables_in(F.col("lines"), vocab.CATALOGUE_HEADER_TERMS, minimum=2),
        lambda t: F.struct(F.struct(t["header_line"].alias("header_line"), t["headers"].alias("headers"), t["rows"].alias("rows")).alias("table"), none.alias("lines")),
    ))
    free = F.when(wants("code_line", "card"), F.array(F.struct(no_table.alias("table"), F.col("lines").alias("lines"))))
    empty = F.array().cast(f"array<struct<table: {TABLE}, lines: array<string>>>")
    units = lines.select(*keep, "format", F.explode(F.concat(F.coalesce(tables, empty), F.coalesce(free, empty))).alias("unit"))

    def read(here: Column) -> Column:
        table, text_of, form = here["unit"]["table"], here["unit"]["lines"], here["format"]
        readers = {
            "table": F.when(table.isNotNull(), table_programmes(table, form)), "code_line": F.when(text_of.isNotNull(), code_line_programmes(text_of)),
            "card": F.when(text_of.isNotNull(), card_programmes(text_of)), "summary": F.when(table.isNotNull(), summary_programmes(table, form)),
        }

        def ranked(name: str, found: Column) -> Column:
            own = F.coalesce(F.when(F.array_contains(form["readers"], name), found), F.array().cast(ITEMS))
            return F.transform(own, lambda item: F.struct(item.alias("item"), F.array_position(form["readers"], name).alias("reader_rank")))

        return F.concat(*[ranked(name, found) for name, found in readers.items()])

    # bound as one value: the optimizer would else cut the fields that only lambdas use
    rows = units.select(*keep, F.explode(let(F.struct("format", "unit"), read)).alias("found")).select(*keep, "found.item.*", "found.reader_rank")
    keyed = rows.withColumn("_name", fold("name"))
    return keep_first(keyed, [key, adapter, "external_code", "_name"], ["reader_rank", "line_no"]).select(*keep, *PROGRAMME, "reader_rank", "line_no")


def unsupported(docs: DataFrame, adapter: str, codes: Sequence[str]) -> DataFrame:
    """Documents bound to an adapter that does not exist: a configuration error, not an empty result."""
    return docs.filter(~F.col(adapter).isin(*codes))
