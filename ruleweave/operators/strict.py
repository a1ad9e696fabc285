"""Config-driven readers of checked table formats; one plan over the documents of all formats."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions import arrays
from ruleweave.functions.classify import (
    benefit_in, exact_subject, holders_in, score_in, selectors_in, strict_titles, subject_in,
)
from ruleweave.functions.tables import cells_are_rule, is_table_line, table_cells, unquoted_cells, with_all_fragments
from ruleweave.functions.text import compact, distinct_codes, fold_unquoted, let, split_lines, stable_key
from ruleweave.operators.documents import tables_in
from ruleweave.operators.ordered import keep_first
from ruleweave.operators.stages import settle

FORMAT = """map<string, struct<reader:string, markers:array<string>, columns:map<string,array<string>>,
carried:array<string>, holders:array<string>, traits:array<string>>>"""
TABLE = "array<struct<line: int, cells: array<string>>>"
KEY = ("programme_selector", "olympiad_title", "profile_title", "diploma_status", "benefit_kind")
RULE = (*KEY, "subject_code", "min_score", "line_no", "source_locator", "source_excerpt", "payload_kind")


def formats(config: Sequence[vocab.StrictFormat] = vocab.STRICT_FORMATS) -> Column:
    """The format table as one constant map, so no join is needed to configure a document."""
    return F.from_json(F.lit(json.dumps({item.code: asdict(item) for item in config}, ensure_ascii=False)), FORMAT)


def dispatch(
    docs: DataFrame, adapter: str, text: str, config: Sequence[vocab.StrictFormat] = vocab.STRICT_FORMATS
) -> DataFrame:
    """Add the format of each document and what the reader does with it.

    dispatch_status is ``read``, ``recognised_not_emitted`` (the format is known to carry no exact
    programme), ``foreign_document`` (its markers are missing) or ``unsupported_adapter``.
    """
    marked = docs.withColumn("format", F.try_element_at(formats(config), F.col(adapter)))
    own = let(
        fold_unquoted(text), lambda folded: F.forall("format.markers", lambda marker: F.contains(folded, marker))
    )
    return marked.withColumn(
        "dispatch_status",
        F.when(F.col("format").isNull(), "unsupported_adapter")
        .when((F.size("format.markers") > 0) & ~own, "foreign_document")
        .when(F.col("format.reader") == "none", "recognised_not_emitted")
        .otherwise("read"),
    )


def _aliased(headers: Column, aliases: Column) -> Column:
    return arrays.all_indexes(headers, lambda h: F.exists(aliases, lambda alias: F.contains(h, alias)))


def _excerpt(cells: Column) -> Column:
    return F.substring(compact(F.array_join(cells, " | ")), 1, vocab.EXCERPT_LENGTH)


def _locator(line: Column) -> Column:
    return F.concat(F.lit("markdown:line:"), line)


def _row(line: Column, cells: Column, titles: Column, profile: Column, statuses: Column, grants: Column, subject: Column, score: Column) -> Column:
    """What every reader makes of a row."""
    named = {
        "line_no": line.cast("int"), "cells": cells, "titles": titles, "profile": profile, "statuses": statuses, "grants": grants,
        "subject_code": subject, "min_score": score.cast("int"),
    }
    return F.struct(*[value.alias(name) for name, value in named.items()])


def _with(fields: dict[str, Column], body) -> Column:
    """Evaluate several values of a row once each and use them by name."""
    return let(F.struct(*[value.alias(name) for name, value in fields.items()]), body)


def _granted(grants: Column) -> Column:
    return F.filter(grants, lambda g: g["kind"].isNotNull())


def grid_rows(headers: Column, rows: Column, form: Column) -> Column:
    """Rows of a grid table with their facts; merged cells of the carried roles are carried."""

    def aliased(heads: Column, role: str) -> Column:
        return _aliased(heads, F.element_at(form["columns"], role))

    def read(heads: Column) -> Column:
        roles = {role: aliased(heads, role) for role in ("programme", "profile", "holder", "subject", "score", "benefit", "olympiad")}
        return _with(roles | {"named": arrays.all_indexes(heads, lambda h: benefit_in(h, F.lit("да")).isNotNull())}, lambda at: placed(at, heads))

    def placed(at: Column, heads: Column) -> Column:
        one = {
            "programme": F.get(at["programme"], F.lit(0)), "profile": F.get(at["profile"], F.lit(0)),
            "olympiad": F.get(F.array_except(at["olympiad"], at["profile"]), F.lit(0)), "benefits": F.array_distinct(F.concat(at["named"], at["benefit"])),
        }
        return _with(one, lambda spot: F.when(
            spot["olympiad"].isNotNull() & spot["profile"].isNotNull() & (F.size(spot["benefits"]) > 0),
            _with({"programmes": carried("programme", F.transform(rows, lambda row: programme(row, spot))),
                   "olympiads": carried("olympiad", F.transform(rows, lambda row: arrays.cell_at(row["cells"], spot["olympiad"])))},
                  lambda columns: F.array_compact(F.transform(rows, lambda row, i: of(row, F.get(columns["programmes"], i), F.get(columns["olympiads"], i), at, spot, heads)))),
        ))

    def carried(role: str, values: Column) -> Column:
        return let(values, lambda v: F.when(F.array_contains(form["carried"], role), arrays.carry(v)).otherwise(v))

    def programme(row: Column, spot: Column) -> Column:
        own, first = arrays.cell_at(row["cells"], spot["programme"]), F.get(row["cells"], F.lit(0))
        alone = F.size(F.filter(row["cells"], lambda cell: cell != "")) == 1
        starts = fold_unquoted(first).rlike("^(?:" + "|".join(vocab.GROUP_STARTS) + ")")
        return F.when((own == "") & F.array_contains(form["traits"], "group_row") & alone & starts, first).otherwise(own)

    def of(row: Column, chosen: Column, title: Column, at: Column, spot: Column, heads: Column) -> Column:
        cells, profile = row["cells"], arrays.cell_at(row["cells"], spot["profile"])
        in_benefit = F.array_contains(form["traits"], "codes_in_benefit")

        def made(plain: Column) -> Column:
            stated = F.array_distinct(F.flatten(F.transform(at["holder"], lambda i: holders_in(arrays.cell_at(plain, i)))))

            def grant(i: Column) -> Column:
                kind = benefit_in(F.get(heads, i), arrays.cell_at(plain, i), F.array_contains(at["benefit"], i))
                named = selectors_in(F.when(in_benefit, arrays.cell_at(cells, i)).otherwise(chosen))
                return F.struct(kind.alias("kind"), named.alias("selectors"))

            return _row(
                row["line"], cells, F.array(title), profile, let(stated, lambda found: F.when(F.size(found) > 0, found).otherwise(form["holders"])),
                _granted(F.transform(spot["benefits"], grant)), arrays.first_value(F.transform(at["subject"], lambda i: subject_in(arrays.cell_at(plain, i)))),
                arrays.first_value(F.transform(at["score"], lambda i: score_in(arrays.cell_at(plain, i)))),
            )

        return F.when(((chosen != "") | in_benefit) & (title != "") & (profile != ""), let(unquoted_cells(cells), made))

    return let(unquoted_cells(headers), read)


def expand_rules(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One rule per benefit x selector x title x status of a row, with its place in that order."""
    return (
        rows.select("*", F.posexplode("grants").alias("p1", "grant"))
        .select("*", F.posexplode("grant.selectors").alias("p2", "programme_selector"))
        .select("*", F.posexplode("titles").alias("p3", "olympiad_title"))
        .select("*", F.posexplode("statuses").alias("p4", "diploma_status"))
        .select(
            *keep,
            "programme_selector",
            "olympiad_title",
            F.col("profile").alias("profile_title"),
            "diploma_status",
            F.col("grant.kind").alias("benefit_kind"),
            "subject_code",
            "min_score",
            "line_no",
            _locator(F.col("line_no")).alias("source_locator"),
            _excerpt(F.col("cells")).alias("source_excerpt"),
            "payload_kind",
            F.struct("line_no", "p1", "p2", "p3", "p4").alias("_seq"),
        )
    )


def programme_first_rows(headers: Column, rows: Column) -> Column:
    """Rows of a programme-first table: four carried columns and a list of titles per row."""

    def read(heads: Column) -> Column:
        at = {
            "programme": with_all_fragments(heads, ("направление подготовки",)), "profile": with_all_fragments(heads, ("профиль олимпиады",)),
            "list": with_all_fragments(heads, ("перечень олимпиад",)), "holder": with_all_fragments(heads, ("победитель", "призер")),
            "subject": with_all_fragments(heads, ("общеобразовательный предмет", "егэ")), "benefit": with_all_fragments(heads, ("льгота",)),
        }
        return _with(at, lambda spots: placed(spots, heads))

    def placed(at: Column, heads: Column) -> Column:
        complete = F.lit(True)
        for role in ("programme", "profile", "list", "holder", "benefit"):
            complete = complete & at[role].isNotNull()
        column = lambda spot: arrays.carry(F.transform(rows, lambda row: arrays.cell_at(row["cells"], spot)))
        columns = {role: column(at[role]) for role in ("programme", "profile", "list", "subject")}
        return F.when(complete, _with(columns, lambda c: F.array_compact(F.transform(rows, lambda row, i: of(row, i, c, at, heads)))))

    def of(row: Column, i: Column, columns: Column, at: Column, heads: Column) -> Column:
        value = lambda role: F.get(columns[role], i)

        def made(plain: Column) -> Column:
            kind = benefit_in(F.get(heads, at["benefit"]), arrays.cell_at(plain, at["benefit"]), True)
            grants = F.array(F.struct(kind.alias("kind"), selectors_in(value("programme")).alias("selectors")))
            return _row(
                row["line"], row["cells"], strict_titles(value("list")), value("profile"), holders_in(arrays.cell_at(plain, at["holder"])), _granted(grants),
                exact_subject(value("subject")), F.when(value("subject") != "", vocab.CONFIRMATION_SCORE),
            )

        return F.when(value("profile") != "", let(unquoted_cells(row["cells"]), made))

    return let(unquoted_cells(headers), read)


def scope_rows(lines: Column) -> Column:
    """Rows below a "for directions ..." row, which sets their codes and clears the carried title.

    The carried title is void once a later scope row has come, or when no scope with codes is open.
    """
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")))
    piped = F.filter(numbered, lambda row: is_table_line(row["text"]))
    celled = F.transform(piped, lambda row: F.struct(row["line"].alias("line"), table_cells(row["text"]).alias("cells")))
    kept = F.filter(celled, lambda row: ~cells_are_rule(row["cells"]))

    def scope_of(row: Column) -> Column:
        said = F.array_join(F.filter(row["plain"], lambda cell: cell != ""), " ")
        return F.when(F.contains(said, F.lit(vocab.SCOPE_PHRASE)), F.array_join(row["cells"], " "))

    def marked(rows: Column) -> Column:
        titles = F.transform(rows, lambda row: F.when(F.size(row["cells"]) >= 8, F.nullif(F.get(row["cells"], F.lit(1)), F.lit(""))))
        return _with({"scopes": F.transform(rows, scope_of), "titles": titles}, lambda said: _with(
            {"scope": arrays.last_position(F.transform(said["scopes"], lambda scope: scope.isNotNull())),
             "title": arrays.last_position(F.transform(said["titles"], lambda title: title.isNotNull()))},
            lambda last: F.array_compact(F.transform(rows, lambda row, i: of(row, i, said, last)))))

    def of(row: Column, i: Column, said: Column, last: Column) -> Column:
        cells, plain, scope_at, title_at = row["cells"], row["plain"], F.get(last["scope"], i), F.get(last["title"], i)
        title = F.when(title_at > scope_at, F.get(said["titles"], title_at - 1))
        holder = lambda at, status: F.when(F.get(plain, F.lit(at)) == vocab.GRANTED, status)
        codes = distinct_codes(F.get(said["scopes"], scope_at - 1))
        made = _row(
            row["line"], cells, F.array(title), F.get(cells, F.lit(2)), F.array_compact(F.array(holder(6, "winner"), holder(7, "prize_winner"))),
            F.array(F.struct(F.lit("bvi").alias("kind"), codes.alias("selectors"))), subject_in(F.get(plain, F.lit(5))), F.lit(vocab.CONFIRMATION_SCORE),
        )
        open_ = F.get(said["scopes"], i).isNull() & scope_at.isNotNull() & (F.size(cells) >= 8)
        return F.when(open_ & (F.coalesce(title, F.lit("")) != "") & (F.get(cells, F.lit(2)) != ""), made)

    return let(F.transform(kept, lambda row: row.withField("plain", unquoted_cells(row["cells"]))), marked)


def strict_rules(
    docs: DataFrame, key: str, adapter: str, text: str, config: Sequence[vocab.StrictFormat] = vocab.STRICT_FORMATS
) -> DataFrame:
    """Complete rules of all documents whose adapter and markers are known, first statement kept.

    Documents are read once: the format of each says which reader makes rows of it, inside the row. A
    table is exploded before its rows are read, so a row never holds its document. Only finished rules
    cross the one shuffle, for the de-duplication within a document.
    """
    keep = [key, adapter]
    own = docs.filter(F.col(adapter).isin([item.code for item in config if item.reader != "none"]))
    ready = dispatch(own, adapter, text, config).filter(F.col("dispatch_status") == "read")
    reader = F.col("format.reader")
    lines = settle(ready, [*keep, "format"], {"lines": split_lines(text)})
    # a table, or all lines of a document that is read across its tables
    whole = F.array(F.struct(F.lit(None).cast("array<string>").alias("headers"), F.array().cast(TABLE).alias("rows")))
    tables = F.transform(tables_in(F.col("lines"), vocab.STRICT_HEADER_TERMS), lambda t: F.struct(t["headers"].alias("headers"), t["rows"].alias("rows")))
    across = reader == "scope_rows"
    units = F.when(across, whole).otherwise(tables)
    parted = lines.select(*keep, "format", F.when(across, F.col("lines")).alias("lines"), F.explode(units).alias("unit"))

    def read(here: Column) -> Column:
        form, headers, rows = here["format"], here["unit"]["headers"], here["unit"]["rows"]
        return F.when(form["reader"] == "grid", grid_rows(headers, rows, form)).when(
            form["reader"] == "programme_first", programme_first_rows(headers, rows)
        ).when(form["reader"] == "scope_rows", scope_rows(here["lines"]))

    # bound as one value: the optimizer would else cut the fields that only lambdas use
    made = F.explode(let(F.struct("format", "unit", "lines"), read)).alias("row")
    kind = F.when(reader == "grid", "strict_table_row").when(across, vocab.SCOPE_ROW_KIND).otherwise(vocab.PROGRAMME_FIRST_KIND)
    found = parted.select(*keep, kind.alias("payload_kind"), made).select(*keep, "payload_kind", "row.*")
    return keep_first(expand_rules(found, keep), [key, adapter, *KEY], ["_seq"]).select(*keep, *RULE)


def rule_candidates(rules: DataFrame, digest: str) -> DataFrame:
    """Strict rules in the shape of the candidate table, with their reproducible key."""
    return rules.withColumn(
        "candidate_key",
        stable_key(
            digest, "source_locator", "programme_selector", "olympiad_title", "profile_title", "diploma_status",
            "benefit_kind",
        ),
    ).withColumn("confidence", F.lit(100))
