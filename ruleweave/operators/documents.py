"""Documents to lines and tables. A document is one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave.functions import arrays
from ruleweave.functions.tables import cells_are_rule, is_table_line, table_cells, term_score
from ruleweave.functions.text import compact, let, split_lines
from ruleweave.operators.markup import page_blocks

def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per block of a page: (key, line_no, kind, level, line)."""
    return pages.select(F.col(key), F.posexplode(page_blocks(F.col(html))).alias("pos", "block")).select(
        key, (F.col("pos") + 1).alias("line_no"), "block.kind", "block.level", "block.line"
    )


def html_text(html: str) -> Column:
    """The page as pipe-table text, the common input of all extractors."""
    return F.array_join(F.transform(page_blocks(F.col(html)), lambda block: block["line"]), "\n")


def document_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with its one-based raw line number."""
    return docs.select(key, F.posexplode(split_lines(text)).alias("pos", "line")).select(
        key, (F.col("pos") + 1).cast("long").alias("line_no"), "line"
    )


def dense_lines(text: str) -> Column:
    """Compacted non-blank lines, the numbering of the generic extractor."""
    return F.filter(F.transform(split_lines(text), lambda line: compact(line)), lambda line: line != "")


def tables_in(lines: Column, terms: tuple[str, ...], minimum: int = 0) -> Column:
    """Tables among the lines of one row: array of (table_line, header_line, headers, rows of (line, cells)).

    A table needs two rows that are no separators; the first row that scores best by vocabulary is the
    header; tables scoring below the minimum and tables without rows below it are left out.
    """

    def cut(found: Column) -> Column:
        def table(span: Column) -> Column:
            block = F.slice(found, span["first"], span["last"] - span["first"] + 1)
            celled = F.transform(block, lambda line, i: F.struct((span["first"] + i).alias("line"), table_cells(line).alias("cells")))
            return let(F.filter(celled, lambda row: ~cells_are_rule(row["cells"])), lambda rows: headed(span["first"], rows))

        return F.array_compact(F.transform(arrays.runs(F.transform(found, lambda line: is_table_line(line))), table))

    def headed(first: Column, rows: Column) -> Column:
        scores = F.transform(rows, lambda row, i: F.struct(term_score(row["cells"], terms).alias("score"), (-i).alias("at")))

        def chosen(best: Column) -> Column:
            head = 1 - best["at"]
            whole = F.struct(
                first.alias("table_line"), F.get(rows, head - 1)["line"].alias("header_line"), F.get(rows, head - 1)["cells"].alias("headers"),
                F.slice(rows, head + 1, F.size(rows)).alias("rows"),
            )
            return F.when((F.size(rows) >= 2) & (best["score"] >= minimum) & (head < F.size(rows)), whole)

        return let(F.array_max(scores), chosen)

    return let(lines, cut)


def document_tables(
    docs: DataFrame, keep: list[str], text: str, terms: tuple[str, ...], minimum: int = 0
) -> DataFrame:
    """One row per table of ``tables_in``: ``keep``, table_line, header_line, headers, rows (array of line, cells)."""
    return docs.select(*keep, F.explode(tables_in(split_lines(text), terms, minimum)).alias("found")).select(*keep, "found.*")
