"""Generic rule candidates from any document: table rows, paragraphs, five-fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions import arrays
from ruleweave.functions.classify import (
    benefit_in, first_fragment, first_kind, holders_in, marked_titles, pattern_score, score_in, selectors_in,
    single_holder, subject_in,
)
from ruleweave.functions.tables import folded_cells, table_cells, unquoted_cells, with_all_fragments
from ruleweave.functions.text import compact, contains_all, contains_any, fold_compacted, let, stable_key
from ruleweave.operators.documents import dense_lines
from ruleweave.operators.stages import settle

LINE = "markdown:line:"


def _benefit(folded: Column) -> Column:
    return first_kind(folded, vocab.BENEFIT_TERMS)


def _is_relevant(folded: Column) -> Column:
    return _benefit(folded).isNotNull() | contains_any(folded, vocab.CONTEXT_TERMS)


def _title_index(headers: Column) -> Column:
    return arrays.first_index(
        headers, lambda cell: cell.isin(*vocab.TITLE_HEADERS) | contains_any(cell, vocab.TITLE_HEADER_PARTS)
    )


def header_index(table: Column, terms: tuple[str, ...] = vocab.TABLE_HEADER_TERMS) -> Column:
    """Zero-based header row of compacted lines: the last best row by vocabulary, if it has two terms; else the row
    above the dashes, else the first."""

    def terms_in(folded: Column) -> Column:
        total = F.lit(0)
        for term in terms:
            total = total + F.contains(folded, F.lit(term)).cast("int")
        return total

    best = F.array_max(
        F.transform(
            table,
            lambda line, i: F.when(
                ~F.contains(line, F.lit("---")), F.struct(let(fold_compacted(line), terms_in).alias("n"), i.alias("at"))
            ),
        )
    )
    dashes = F.coalesce(arrays.first_index(table, lambda line: F.contains(line, F.lit("---"))), F.lit(0))
    return F.when(best["n"] >= 2, best["at"]).otherwise(F.greatest(F.lit(0), dashes - 1))


def relevant_tables(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Tables whose heading, header and first rows mention a benefit or its context."""
    lines = settle(docs, keep, {"lines": dense_lines(text)})
    marked = settle(
        lines, [*keep, "lines"],
        {
            "spans": arrays.runs(F.transform("lines", lambda line: F.startswith(line, F.lit("|")))),
            "heading_at": arrays.last_position(F.transform("lines", lambda line: F.startswith(line, F.lit("#")))),
        },
    )
    # Tables are cut out before they are exploded, so a row holds its own lines and not the document's.
    cut = F.transform(
        "spans",
        lambda span: F.struct(
            span["first"].alias("first_line"), F.slice("lines", span["first"], span["last"] - span["first"] + 1).alias("table"),
            F.get("lines", F.get("heading_at", span["first"] - 1) - 1).alias("above"),
        ),
    )
    tables = marked.select(*keep, F.explode(cut).alias("t")).select(*keep, "t.first_line", "t.table", "t.above")
    placed = settle(
        tables, [*keep, "first_line", "table"], {"heading": F.coalesce(compact(F.ltrim("above", F.lit("# "))), F.lit(""))}
    )
    tables = settle(placed, [*keep, "first_line", "table", "heading"], {"head": header_index(F.col("table"))})
    # the lines are compacted, so that joining them leaves nothing to collapse
    context = F.trim(F.array_join(F.concat(F.array("heading"), F.slice("table", F.col("head") + 1, F.lit(4))), " "))
    judged = settle(tables, [*keep, "first_line", "table", "heading", "head"], {"context": fold_compacted(context)})
    return judged.filter(_is_relevant(F.col("context"))).select(
        *keep, "first_line", "table", "heading", "head", F.get("table", F.col("head")).alias("header")
    )


def table_rows(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Rows of the relevant tables with heading, header, excerpt and the inherited title."""
    tables = relevant_tables(docs, keep, text).withColumn(
        "header_cells", folded_cells(table_cells("header"))
    )
    below = F.filter(
        F.transform(
            F.slice("table", F.col("head") + 2, F.size("table")),
            lambda row, i: F.struct(
                (F.col("first_line") + F.col("head") + 1 + i).alias("line_no"),
                row.alias("row"),
                table_cells(row).alias("cells"),
                F.trim(F.concat_ws(" ", "heading", "header", row)).alias("text"),
            ),
        ),
        lambda item: ~F.contains(item["row"], F.lit("---")) & (F.length(item["text"]) > 20),
    )
    held = tables.withColumn("below", below).withColumn("title_at", _title_index(F.col("header_cells")))
    titled = held.withColumn(
        "titles",
        F.transform("below", lambda item: arrays.cell_at(item["cells"], F.col("title_at"))),
    ).withColumn("carried", arrays.carry(F.col("titles")))
    rows = titled.select(
        *keep,
        "heading",
        "header",
        "header_cells",
        F.explode(F.arrays_zip("below", "titles", "carried")).alias("item"),
    )
    return rows.select(
        *keep,
        F.lit("table_row").alias("kind"),
        F.col("item.below.line_no").alias("line_no"),
        F.substring("item.below.text", 1, vocab.EXCERPT_LENGTH).alias("excerpt"),
        "heading",
        "header",
        "header_cells",
        F.col("item.below.row").alias("row"),
        F.col("item.below.cells").alias("cells"),
        F.col("item.titles").alias("title"),
        F.when((F.col("item.titles") == "") & (F.col("item.carried") != ""), F.col("item.carried")).alias(
            "inherited_title"
        ),
    )


def paragraphs(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Lines of twenty characters or more whose surroundings name a benefit and its context."""
    lines = settle(docs, keep, {"lines": dense_lines(text)})
    blocks = F.transform(
        "lines",
        lambda line, i: F.struct(
            (i + 1).alias("line_no"),
            line.alias("line"),
            F.array_join(F.slice("lines", F.greatest(i - 1, F.lit(1)), i + 3 - F.greatest(i - 2, F.lit(0))), " ").alias(
                "context"
            ),
        ),
    )
    wanted = F.filter(blocks, lambda b: ~F.startswith(b["line"], F.lit("|")) & (F.length(b["line"]) >= 20))
    blocks_of = lines.select(*keep, F.explode(wanted).alias("block"))
    rows = settle(blocks_of, [*keep, "block"], {"folded": fold_compacted("block.context")})
    return rows.filter(
        _benefit(F.col("folded")).isNotNull() & contains_any(F.col("folded"), vocab.CONTEXT_TERMS)
    ).select(
        *keep,
        F.lit("paragraph").alias("kind"),
        F.col("block.line_no").alias("line_no"),
        F.substring("block.context", 1, vocab.EXCERPT_LENGTH).alias("excerpt"),
        F.col("block.line").alias("row"),
    )


def explicit_facts(rows: DataFrame) -> DataFrame:
    """Add the facts of rows that name programme, title, profile, holder and benefit in own cells.

    Adds ``facts`` (selectors, statuses, benefits, subject, score, title, profile), NULL where any
    fact is not explicit.
    """
    heads, cells = F.col("header_cells"), F.col("cells")
    staged = rows.withColumns(
        {
            "_programme_at": arrays.first_index(heads, lambda h: contains_any(h, vocab.EXPLICIT_PROGRAMME)),
            "_title_at": with_all_fragments(heads, (vocab.EXPLICIT_TITLE,), vocab.EXPLICIT_TITLE_EXCLUDES),
            "_profile_at": with_all_fragments(heads, (vocab.EXPLICIT_PROFILE,)),
            "_subject_at": arrays.first_index(
                heads,
                lambda h: F.contains(h, F.lit(vocab.EXPLICIT_SUBJECT)) | contains_all(h, vocab.EXPLICIT_SUBJECT_PAIR),
            ),
            "_score_at": arrays.first_index(heads, lambda h: contains_any(h, vocab.EXPLICIT_SCORE)),
            "_pairs": F.transform(
                heads,
                lambda h, i: F.struct(h.alias("head"), arrays.cell_at(F.col("cells"), i).alias("cell"), i.alias("at")),
            ),
            "_plain_heads": unquoted_cells(heads),
            "_plain": unquoted_cells(cells),
        }
    )

    def plain(at: Column) -> Column:
        return arrays.cell_at(F.col("_plain"), at)

    def statuses(pair: Column) -> Column:
        granted = fold_compacted(pair["cell"]).isin(*vocab.EXPLICIT_GRANTED)
        by_column = F.array_compact(
            F.array(
                F.when(F.contains(pair["head"], F.lit(vocab.WINNER_FRAGMENT)) & granted, "winner"),
                F.when(F.contains(pair["head"], F.lit(vocab.PRIZE_FRAGMENT)) & granted, "prize_winner"),
            )
        )
        return F.when(contains_any(pair["head"], vocab.EXPLICIT_HOLDER), holders_in(plain(pair["at"]))).otherwise(
            by_column
        )

    valued = staged.withColumns(
        {
            "_selectors": let(arrays.cell_at(cells, F.col("_programme_at")), selectors_in),
            "_statuses": F.array_distinct(F.flatten(F.transform("_pairs", statuses))),
            "_benefits": F.array_distinct(
                F.array_compact(
                    F.transform(
                        "_pairs",
                        lambda p: benefit_in(
                            F.get("_plain_heads", p["at"]), plain(p["at"]), contains_any(p["head"], vocab.EXPLICIT_BENEFIT)
                        ),
                    )
                )
            ),
            "_title": arrays.cell_at(cells, F.col("_title_at")),
            "_profile": arrays.cell_at(cells, F.col("_profile_at")),
        }
    )
    complete = (
        (F.size("cells") >= F.size("header_cells"))
        & F.col("_programme_at").isNotNull()
        & (F.size("_selectors") > 0)
        & (F.col("_title") != "")
        & (F.col("_profile") != "")
        & (F.size("_statuses") > 0)
        & (F.size("_benefits") > 0)
    )
    facts = F.struct(
        F.col("_selectors").alias("selectors"),
        F.col("_statuses").alias("statuses"),
        F.col("_benefits").alias("benefits"),
        F.when(F.col("_subject_at").isNotNull(), subject_in(plain(F.col("_subject_at")))).alias("subject"),
        F.when(F.col("_score_at").isNotNull(), score_in(plain(F.col("_score_at")))).alias("score"),
        F.col("_title").alias("title"),
        F.col("_profile").alias("profile"),
    )
    kept = [c for c in valued.columns if not c.startswith("_")]
    return settle(valued, kept, {"facts": F.when(complete, facts)})


def row_identities(headers: Column, cells: Column, inherited: Column) -> Column:
    """(title, profile) pairs of a row: title cell, inherited title, or the list column."""
    profile = arrays.cell_at(cells, arrays.first_index(headers, lambda h: F.contains(h, F.lit(vocab.PROFILE_HEADER))))
    own = arrays.cell_at(cells, _title_index(headers))
    title = F.when(own != "", own).otherwise(F.coalesce(inherited, F.lit("")))
    listed = arrays.cell_at(cells, arrays.first_index(headers, lambda h: F.contains(h, F.lit(vocab.LIST_HEADER))))
    titles = F.when(title != "", F.array(title)).otherwise(marked_titles(listed))
    pairs = F.transform(titles, lambda t: F.struct(t.alias("title"), profile.alias("profile")))
    none = F.array().cast("array<struct<title:string,profile:string>>")
    return F.array_distinct(F.when(profile == "", none).otherwise(pairs))


def identity_text(kind: Column, headers: Column, cells: Column, identity: Column) -> Column:
    """Text used to match a stored candidate: its identity pair, else the two named cells."""
    title = arrays.cell_at(cells, _title_index(headers))
    profile = arrays.cell_at(cells, arrays.first_index(headers, lambda h: F.contains(h, F.lit(vocab.PROFILE_HEADER))))
    stored = F.when(
        (F.coalesce(identity["title"], F.lit("")) != "") & (F.coalesce(identity["profile"], F.lit("")) != ""),
        F.concat_ws(" | ", identity["title"], identity["profile"]),
    )
    read = F.when((kind == "table_row") & (title != "") & (profile != ""), F.concat_ws(" | ", title, profile))
    return F.coalesce(stored, read)


def find_candidates(docs: DataFrame, keep: list[str], text: str, digest: str) -> DataFrame:
    """All candidates of each document, explicit rows superseding the weaker reading of the row.

    ``digest`` (a column of ``keep``) is the content hash of the document. A row expands inside its
    own array, made distinct there, so the whole extraction is one narrow stage.
    """
    rows = explicit_facts(table_rows(docs, keep, text))
    item = "struct<title:string,profile:string,selector:string,diploma:string,benefit:string>"
    facts = F.col("facts")
    proven = F.flatten(
        F.transform(
            facts["benefits"],
            lambda benefit: F.flatten(
                F.transform(
                    facts["selectors"],
                    lambda selector: F.transform(
                        facts["statuses"],
                        lambda diploma: F.struct(
                            facts["title"].alias("title"),
                            facts["profile"].alias("profile"),
                            selector.alias("selector"),
                            diploma.alias("diploma"),
                            benefit.alias("benefit"),
                        ),
                    ),
                )
            ),
        )
    )
    absent = F.lit(None).cast("string")
    named = F.transform(
        "identities",
        lambda pair: F.struct(
            pair["title"].alias("title"), pair["profile"].alias("profile"), absent.alias("selector"),
            absent.alias("diploma"), absent.alias("benefit"),
        ),
    )
    identified = rows.withColumn(
        "identities", row_identities(F.col("header_cells"), F.col("cells"), F.col("inherited_title"))
    )
    from_tables = identified.select(
        *keep, "kind", "line_no", "excerpt",
        facts.isNotNull().alias("is_proven"), facts["subject"].alias("fact_subject"), facts["score"].alias("fact_score"),
        F.explode_outer(F.when(facts.isNotNull(), proven).otherwise(named).cast(f"array<{item}>")).alias("item"),
    )
    prose = paragraphs(docs, keep, text).select(
        *keep, "kind", "line_no", "excerpt",
        F.lit(False).alias("is_proven"), absent.alias("fact_subject"), F.lit(None).cast("int").alias("fact_score"),
        F.lit(None).cast(item).alias("item"),
    )
    found = (
        from_tables.unionByName(prose)
        .withColumn("folded", fold_compacted(F.trim("excerpt")))
        .withColumn("read_benefit", _benefit(F.col("folded")))
        .withColumn("source_locator", F.concat(F.lit(LINE), F.col("line_no")))
    )

    def pick(proof: Column, reading: Column) -> Column:
        return F.when(F.col("is_proven"), proof).otherwise(reading)

    weight = F.when((F.col("kind") == "table_row") & F.col("read_benefit").isNotNull(), 72).otherwise(52)
    proof_key = stable_key(
        digest, "source_locator", "item.selector", "item.title", "item.profile", "item.diploma", "item.benefit"
    )
    read_key = stable_key(digest, "line_no", "excerpt", "item.title", "item.profile")
    return found.select(
        *keep,
        pick(proof_key, read_key).alias("candidate_key"),
        "line_no",
        "source_locator",
        F.col("excerpt").alias("source_excerpt"),
        pick(F.lit("automatic_explicit_table_row"), F.col("kind")).alias("payload_kind"),
        pick(F.col("item.benefit"), F.col("read_benefit")).alias("benefit_kind"),
        pick(F.col("item.diploma"), single_holder(F.col("folded"))).alias("diploma_status"),
        pick(F.col("fact_subject"), first_fragment(F.col("folded"), vocab.SUBJECT_FRAGMENTS)).alias("subject_code"),
        pick(F.col("fact_score"), pattern_score(F.col("folded"))).alias("min_score"),
        pick(F.lit(100), weight).alias("confidence"),
        F.col("item.title").alias("olympiad_title"),
        F.col("item.profile").alias("profile_title"),
        F.col("item.selector").alias("programme_selector"),
    )
