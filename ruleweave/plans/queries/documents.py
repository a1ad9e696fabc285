"""Lines and tables of whole documents: prose lines with commas become pipe rows, short ones headings."""

from pyspark.sql import DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions import tables as tb
from ruleweave.functions.text import fold, fold_unquoted, split_lines
from ruleweave.operators import markup as mk, ordered as o
from ruleweave.operators.documents import dense_lines, document_lines, document_tables, html_blocks as page_block_rows, html_text
from ruleweave.operators.generic import find_candidates, relevant_tables as relevant
from ruleweave.operators.stages import settle
from ruleweave.plans.queries.base import Source, long, query
from ruleweave.plans.queries.scalars import sql_compact, sql_fold, sql_unquoted

TERMS = ("the", "en", "la", "de", "of", "und")


def piped(s: Source) -> DataFrame:
    """Documents as pipe-table text: (doc_id, text)."""
    line = F.transform(
        F.split("text", "\n", -1),
        lambda x: F.when(F.contains(x, F.lit(",")) & (F.length(x) % 7 == 0), F.lit("| --- | :---: |"))
        .when(F.contains(x, F.lit(",")), F.concat(F.lit("| "), F.replace(x, F.lit(","), F.lit(" |")), F.lit(" |")))
        .when(F.length(x) < 70, F.concat(F.lit("## "), x))
        .otherwise(x),
    )
    return s.dealt("documents", "doc_id", "text").select("doc_id", F.array_join(line, "\n").alias("text"))


PIPED = """
piped AS (
  SELECT doc_id, i AS line_no,
         CASE WHEN contains(x, ',') AND length(x) % 7 = 0 THEN '| --- | :---: |'
              WHEN contains(x, ',') THEN '| ' || replace(x, ',', ' |') || ' |'
              WHEN length(x) < 70 THEN '## ' || x ELSE x END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
"""
ROWS = f"""
rows AS (
  SELECT doc_id, line_no, line, list_transform(string_split(trim(trim(line), '|'), '|'), lambda c: {sql_compact('c')}) AS cells
  FROM piped WHERE line LIKE '|%'),
ruled AS (
  SELECT *, list_bool_and(list_transform(cells, lambda c: c = '' OR regexp_full_match(c, ':?-{{3,}}:?'))) AS is_rule FROM rows)
"""
ISLANDS = """
islands AS (
  SELECT *, min(line_no) OVER (PARTITION BY doc_id, line_no - rn) AS table_no
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM ruled))
"""
BASE = f"WITH {PIPED}, {ROWS}, {ISLANDS}"


def _score(cells: str, folded) -> str:
    terms = ", ".join(f"'{term}'" for term in TERMS)
    return (
        f"list_sum(list_transform({cells}, lambda c: len(list_filter([{terms}], lambda w: contains({folded('c')}, w)))))::BIGINT"
    )


def lines_of(s: Source) -> DataFrame:
    return document_lines(piped(s), "doc_id", "text")


def rows_of(s: Source) -> DataFrame:
    """Long-form table rows numbered by table: the input of the line-table operators."""
    rows = o.table_islands(lines_of(s), ["doc_id"], "line_no", tb.is_table_line("line"))
    return rows.withColumn("cells", tb.table_cells("line"))


@query("table_cells", f"WITH {PIPED}, {ROWS} SELECT doc_id, line_no::BIGINT AS line_no, array_to_string(cells, '¦') AS cells, len(cells)::INTEGER AS n_cells, is_rule FROM ruled")
def table_cells(s: Source):
    rows = lines_of(s).filter(tb.is_table_line("line"))
    return rows.select(
        "doc_id", "line_no", F.array_join(tb.table_cells("line"), "¦").alias("cells"),
        F.size(tb.table_cells("line")).alias("n_cells"), tb.is_separator("line").alias("is_rule"),
    )


@query(
    "table_islands",
    BASE + "SELECT doc_id, table_no::BIGINT AS table_no, count(*) AS n_rows, max(line_no)::BIGINT AS last_line FROM islands GROUP BY ALL",
)
def table_islands(s: Source):
    rows = o.table_islands(lines_of(s), ["doc_id"], "line_no", tb.is_table_line("line"))
    return rows.groupBy("doc_id", "table_no").agg(F.count(F.lit(1)).alias("n_rows"), F.max("line_no").alias("last_line"))


@query(
    "header_argmax",
    BASE + f""",
    scored AS (SELECT doc_id, table_no, line_no, {_score('cells', sql_unquoted)} AS score FROM islands WHERE NOT is_rule),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY score DESC, line_no) AS f,
                      row_number() OVER (PARTITION BY doc_id, table_no ORDER BY score DESC, line_no DESC) AS l,
                      count(*) OVER (PARTITION BY doc_id, table_no) AS n_rows FROM scored)
    SELECT a.doc_id, a.table_no::BIGINT AS table_no, a.line_no::BIGINT AS header_line, a.score AS header_score, a.n_rows,
           b.line_no::BIGINT AS last_header_line
    FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND a.table_no = b.table_no AND b.l = 1 WHERE a.f = 1 AND a.score >= 2
    """,
)
def header_argmax(s: Source):
    rows = rows_of(s).filter(~tb.cells_are_rule(F.col("cells")))
    scored = rows.select("doc_id", "table_no", "line_no", tb.term_score(F.col("cells"), TERMS).cast("long").alias("score"))
    table = ["doc_id", "table_no"]
    first = o.header_argmax(scored, table, "line_no", F.col("score"), "first", 2)
    last = o.header_argmax(scored, table, "line_no", F.col("score"), "last", 2)
    return first.join(last.select(*table, F.col("header_line").alias("last_header_line")), table)


@query(
    "header_resolve",
    BASE + f""",
    body AS (SELECT *, count(*) OVER (PARTITION BY doc_id, table_no) AS n_body FROM islands WHERE NOT is_rule),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY {_score('cells', sql_unquoted)} DESC, line_no) AS f,
                      row_number() OVER (PARTITION BY doc_id, table_no ORDER BY line_no) AS place FROM body WHERE n_body >= 2),
    heads AS (SELECT doc_id, table_no, line_no, n_body - place AS n_data, list_transform(cells, lambda c: {sql_fold('c')}) AS h
              FROM ranked WHERE f = 1 AND n_body > place)
    SELECT doc_id, table_no::BIGINT AS table_no, line_no::BIGINT AS header_line, n_data::BIGINT AS n_data,
           array_to_string(list_transform(list_filter(range(1, len(h) + 1), lambda i: contains(h[i], 'the') OR contains(h[i], 'los')), lambda i: i - 1), ',') AS any_at,
           coalesce(nullif(list_position(list_transform(h, lambda c: contains(c, 'ion')), TRUE), 0),
                    nullif(list_position(list_transform(h, lambda c: contains(c, 'en')), TRUE), 0)) - 1 AS priority_at,
           nullif(list_position(list_transform(h, lambda c: contains(c, 'e') AND contains(c, 'n') AND NOT contains(c, 'th')), TRUE), 0) - 1 AS fragments_at
    FROM heads
    """,
)
def header_resolve(s: Source):
    tables = document_tables(piped(s), ["doc_id"], "text", TERMS).withColumn(
        "h", F.transform("headers", lambda cell: fold(cell))
    )
    return tables.select(
        "doc_id", long("table_line").alias("table_no"), long("header_line").alias("header_line"), long(F.size("rows")).alias("n_data"),
        F.array_join(tb.any_alias(F.col("h"), ("the", "los")).cast("array<string>"), ",").alias("any_at"),
        long(tb.by_alias_priority(F.col("h"), ("ion", "en"))).alias("priority_at"),
        long(tb.with_all_fragments(F.col("h"), ("e", "n"), ("th",))).alias("fragments_at"),
    )


@query(
    "carry_forward",
    BASE + """
    SELECT doc_id, table_no::BIGINT AS table_no, line_no::BIGINT AS line_no,
           last_value(CASE WHEN length(cells[2]) <= 12 AND cells[2] <> '' THEN cells[2] END IGNORE NULLS)
             OVER (PARTITION BY doc_id, table_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS carried
    FROM islands
    """,
)
def carry_forward(s: Source):
    second = F.get("cells", F.lit(1))
    kept = F.when((F.length(second) <= 12) & (second != ""), second)
    carried = o.carry_forward(rows_of(s), ["doc_id", "table_no"], "line_no", {"last": kept})
    return carried.select("doc_id", "table_no", "line_no", F.col("last.value").alias("carried"))


@query(
    "previous_heading",
    f"""
    WITH {PIPED}
    SELECT doc_id, line_no::BIGINT AS line_no,
           last_value(CASE WHEN line LIKE '#%' THEN {sql_compact("ltrim(line, '# ')")} END IGNORE NULLS)
             OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading,
           last_value(CASE WHEN line LIKE '#%' THEN line_no END IGNORE NULLS)
             OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS heading_line
    FROM piped
    """,
)
def previous_heading(s: Source):
    from ruleweave.functions.text import compact

    title = F.when(tb.is_heading_line("line"), compact(F.ltrim("line", F.lit("# "))))
    carried = o.carry_forward(lines_of(s), ["doc_id"], "line_no", {"above": title})
    return carried.select("doc_id", "line_no", F.col("above.value").alias("heading"), F.col("above.at").alias("heading_line"))


@query(
    "scope_carry",
    f"""
    WITH {PIPED}, {ROWS},
    marked AS (
      SELECT p.doc_id, p.line_no, CASE WHEN p.line LIKE '#%' THEN p.line END AS scope, r.cells[1] AS first,
             CASE WHEN length(r.cells[2]) <= 20 THEN nullif(r.cells[2], '') END AS title
      FROM piped p LEFT JOIN ruled r ON p.doc_id = r.doc_id AND p.line_no = r.line_no),
    scoped AS (
      SELECT *, max(CASE WHEN scope IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS scope_line FROM marked)
    SELECT doc_id, line_no::BIGINT AS line_no, scope_line::BIGINT AS scope_line,
           first_value(scope) OVER (PARTITION BY doc_id, scope_line ORDER BY line_no) AS scope,
           last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id, scope_line ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS title
    FROM scoped WHERE scope_line IS NOT NULL QUALIFY first IS NOT NULL
    """,
)
def scope_carry(s: Source):
    second = F.get(tb.table_cells("line"), F.lit(1))
    title = F.when(tb.is_table_line("line") & (F.length(second) <= 20), F.nullif(second, F.lit("")))
    scope = F.when(tb.is_heading_line("line"), F.col("line"))
    carried = o.scoped_carry(lines_of(s), ["doc_id"], "line_no", scope, {"title": title})
    return carried.filter(tb.is_table_line("line")).select("doc_id", "line_no", "scope_line", "scope", "title")


@query(
    "context_window",
    f"""
    WITH dense AS (
      SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
      FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_compact('x')}), lambda x: x <> '') AS l FROM documents)),
    near AS (SELECT doc_id, line_no, line, string_agg(line, ' ') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM dense)
    SELECT doc_id, line_no::BIGINT AS line_no, md5(context) AS context FROM near
    WHERE length(line) >= 20 AND regexp_matches(lower(context), 'the|los') AND regexp_matches(lower(context), 'en|ion')
    """,
)
def context_window(s: Source):
    lines = s.documents.select("doc_id", "text").select("doc_id", F.posexplode(dense_lines("text")).alias("p", "line")).select(
        "doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line"
    )
    near = o.context_window(lines, ["doc_id"], "line_no", "line")
    wanted = F.lower("context").rlike("the|los") & F.lower("context").rlike("en|ion")
    return near.filter((F.length("line") >= 20) & wanted).select("doc_id", "line_no", F.md5("context").alias("context"))


# Words that stand for rule vocabulary, so that whole documents carry it.
WORDS = ((" of ", " наименование олимпиады "), (" le ", " профиль олимпиады "), (" der ", " егэ "), (" los ", " победителям "))


@query(
    "relevant_tables",
    f"""
    WITH worded AS (
      SELECT doc_id, {''.join('replace(' for _ in WORDS)}text{''.join(f", '{a}', '{b}')" for a, b in WORDS)} AS text FROM documents),
    piped AS (
      SELECT doc_id, CASE WHEN contains(x, ',') AND length(x) % 7 = 0 THEN '| --- | :---: |'
             WHEN contains(x, ',') THEN '| ' || replace(x, ',', ' |') || ' |' WHEN length(x) < 70 THEN '## ' || x ELSE x END AS line, i
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM worded)),
    dense AS (SELECT doc_id, {sql_compact('line')} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no
              FROM piped WHERE {sql_compact('line')} <> ''),
    headed AS (SELECT *, last_value(CASE WHEN line LIKE '#%' THEN {sql_compact("ltrim(line, '# ')")} END IGNORE NULLS)
                 OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM dense),
    islands AS (SELECT *, min(line_no) OVER (PARTITION BY doc_id, line_no - rn) AS first_line
                FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM headed WHERE line LIKE '|%')),
    scored AS (SELECT *, line_no - first_line AS pos, contains(line, '---') AS is_rule,
                      contains({sql_fold('line')}, 'наименование олимпиады')::INTEGER + contains({sql_fold('line')}, 'профиль олимпиады')::INTEGER AS n FROM islands),
    best AS (SELECT doc_id, first_line, any_value(heading) AS heading,
                    max(CASE WHEN NOT is_rule THEN n * 1000000 + pos END) AS top, coalesce(min(CASE WHEN is_rule THEN pos END), 0) AS rule_at
             FROM scored GROUP BY ALL),
    heads AS (SELECT doc_id, first_line, coalesce(heading, '') AS heading,
                     CASE WHEN top >= 2000000 THEN top % 1000000 ELSE greatest(0, rule_at - 1) END AS head FROM best),
    texts AS (SELECT h.doc_id, h.first_line, h.heading, h.head, string_agg(s.line, ' ' ORDER BY s.pos) AS body,
                     any_value(CASE WHEN s.pos = h.head THEN s.line END) AS header
              FROM heads h JOIN scored s ON s.doc_id = h.doc_id AND s.first_line = h.first_line AND s.pos BETWEEN h.head AND h.head + 3 GROUP BY ALL)
    SELECT doc_id, first_line::BIGINT AS first_line, head::BIGINT AS head, heading, header FROM texts
    WHERE regexp_matches({sql_fold("heading || ' ' || body")}, 'олимпиад|победител|егэ')
    """,
)
def relevant_tables(s: Source):
    text = F.col("text")
    for word, term in WORDS:
        text = F.replace(text, F.lit(word), F.lit(term))
    worded = s.documents.select("doc_id", "text").select("doc_id", text.alias("text"))
    line = F.transform(
        split_lines("text"),
        lambda x: F.when(F.contains(x, F.lit(",")) & (F.length(x) % 7 == 0), F.lit("| --- | :---: |"))
        .when(F.contains(x, F.lit(",")), F.concat(F.lit("| "), F.replace(x, F.lit(","), F.lit(" |")), F.lit(" |")))
        .when(F.length(x) < 70, F.concat(F.lit("## "), x))
        .otherwise(x),
    )
    docs = worded.select("doc_id", F.array_join(line, "\n").alias("text"))
    return relevant(docs, ["doc_id"], "text").select(
        "doc_id", long("first_line").alias("first_line"), long("head").alias("head"), "heading", "header"
    )


def _names(names) -> str:
    return ", ".join(f"'{name}'" for name in names)


def sql_lines(pages: str) -> str:
    """Blocks of pages (page_id, html) as ``lines`` (page_id, pos, turn, kind, level, line): the stack is a list in a recursion."""
    element = "STRUCT(pos BIGINT, name VARCHAR, t BOOLEAN, d BOOLEAN, r BIGINT)[]"
    pattern, value = mk.TOKEN.replace("'", "''"), mk.OPEN_VALUE.replace("'", "''")
    return f"""
tok AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '<([^A-Za-z/!?])', '&lt;\\1', 'g'), '{pattern}') AS t FROM {pages}),
each AS (SELECT page_id, len(t) AS n, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tok),
tags AS (
  SELECT page_id, i, name, kind, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM (
    SELECT *, lower(regexp_extract(x, '{mk.NAME}', 1)) AS name, CASE WHEN x LIKE '</%' THEN 'end' WHEN x LIKE '%/>' AND NOT regexp_matches(x, '{value}') THEN 'empty' ELSE 'start' END AS kind FROM each WHERE x LIKE '<%')
  WHERE name NOT IN ('', {_names((*mk.VOID, *mk.RAW))})),
fold AS (
  SELECT page_id, 0::BIGINT AS k, []::{element} AS stack, []::{element} AS closed, 0::BIGINT AS stop FROM tok
  UNION ALL
  SELECT page_id, k, CASE WHEN kind = 'start' THEN list_prepend(made, stack) WHEN kind = 'end' AND depth > 0 THEN stack[depth + 1:] ELSE stack END,
         CASE WHEN kind = 'empty' THEN [made] WHEN kind = 'end' AND depth > 0 THEN stack[:depth] ELSE []::{element} END, CASE WHEN kind = 'empty' THEN i + 1 ELSE i END
  FROM (SELECT f.page_id, g.k, g.i, g.kind, f.stack, coalesce(list_position(list_transform(f.stack, lambda e: e.name), g.name), 0) AS depth,
               struct_pack(pos := g.i, name := g.name, t := coalesce(f.stack[1].t OR f.stack[1].name = 'table', FALSE),
                           d := coalesce(f.stack[1].d OR f.stack[1].name IN ({_names(mk.DROPPED)}), FALSE), r := CASE WHEN f.stack[1].name = 'tr' THEN f.stack[1].pos ELSE -1 END) AS made
        FROM fold f JOIN tags g ON g.page_id = f.page_id AND g.k = f.k + 1)),
els AS (
  SELECT page_id, unnest(closed, recursive := true), stop FROM fold
  UNION ALL SELECT page_id, unnest(stack, recursive := true), n + 1 FROM (SELECT f.*, tok.page_id AS p, len(t) AS n FROM fold f JOIN tok USING (page_id) QUALIFY row_number() OVER (PARTITION BY f.page_id ORDER BY f.k DESC) = 1)),
roots AS (SELECT page_id, min(pos) AS low, arg_min(stop, pos) AS high FROM els WHERE name = 'body' AND NOT d GROUP BY page_id),
texts AS (SELECT page_id, i, x FROM each WHERE x NOT LIKE '<%' AND regexp_matches(x, '\\S')
          AND NOT EXISTS (SELECT 1 FROM els e WHERE e.page_id = each.page_id AND e.name IN ({_names(mk.DROPPED)}) AND each.i > e.pos AND each.i < e.stop)),
said AS (
  SELECT e.page_id, e.pos, e.name, e.t, e.r, {sql_compact(f"regexp_replace(replace(replace(replace(replace(replace(coalesce(string_agg(x, ' ' ORDER BY i), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')")} AS s
  FROM els e LEFT JOIN roots USING (page_id) LEFT JOIN texts x ON x.page_id = e.page_id AND x.i > e.pos AND x.i < e.stop
  WHERE NOT e.d AND (low IS NULL OR (e.pos > low AND e.pos < high)) AND (e.name IN ({_names(mk.BLOCKS)}) AND NOT e.t OR e.name IN ({_names(mk.CELLS)}) AND e.r >= 0) GROUP BY ALL),
rows AS (SELECT page_id, r AS pos, '| ' || string_agg(s, ' | ' ORDER BY pos) || ' |' AS line, '| ' || string_agg('---', ' | ') || ' |' AS rule, bool_or(name = 'th') AS head
         FROM said WHERE name IN ({_names(mk.CELLS)}) GROUP BY page_id, r HAVING bool_or(s <> '')),
lines AS (
  SELECT page_id, pos, 0 AS turn, CASE WHEN name LIKE 'h%' THEN 'heading' WHEN name = 'li' THEN 'item' ELSE 'paragraph' END AS kind,
         CASE WHEN name LIKE 'h%' THEN name[2]::INTEGER ELSE 0 END AS level, CASE WHEN name LIKE 'h%' THEN repeat('#', name[2]::INTEGER) || ' ' WHEN name = 'li' THEN '- ' ELSE '' END || s AS line
  FROM said WHERE name NOT IN ({_names(mk.CELLS)}) AND s <> ''
  UNION ALL SELECT page_id, pos, 0, 'row', 0, line FROM rows UNION ALL SELECT page_id, pos, 1, 'separator', 0, rule FROM rows WHERE head)
"""


@query(
    "html_blocks",
    f"WITH RECURSIVE {sql_lines('pages')} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, turn)::INTEGER AS line_no, kind, level, line FROM lines",
)
def html_blocks(s: Source):
    return page_block_rows(s.dealt("pages", "page_id", "html"), "page_id", "html")


# Words of the pages that stand for rule vocabulary, and lists that stand for tables of benefits.
TERMED = (
    (" the ", " победителям "), (" and ", " олимпиад "), (" of ", " бви "), (" la ", " егэ "), (" der ", " 100 баллов "), (" und ", " призёрам "),
    ("<ul>", "<table><tr><th>Олимпиада</th><th>Льгота</th></tr>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td><td>БВИ</td></tr>"),
)


def _any(text: str, terms) -> str:
    return f"regexp_matches({text}, '{'|'.join(terms)}')"


def _benefit(text: str) -> str:
    return f"CASE {' '.join(f'WHEN {_any(text, terms)} THEN {kind!r}' for kind, terms in vocab.BENEFIT_TERMS)} END"


@query(
    "page_candidates",
    f"""
    WITH RECURSIVE termed AS (SELECT page_id, {'replace(' * len(TERMED)}html{''.join(f", '{a}', '{b}')" for a, b in TERMED)} AS html FROM pages),
    {sql_lines('termed')},
    numbered AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, turn) AS line_no, line FROM lines),
    headed AS (SELECT *, coalesce(last_value(CASE WHEN line LIKE '#%' THEN {sql_compact("ltrim(line, '# ')")} END IGNORE NULLS)
                 OVER (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS heading FROM numbered),
    islands AS (SELECT *, line_no - min(line_no) OVER (PARTITION BY page_id, line_no - rn) AS place, line_no - rn AS island
                FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS rn FROM headed WHERE line LIKE '|%')),
    heads AS (SELECT page_id, island, greatest(0, coalesce(min(place) FILTER (WHERE contains(line, '---')), 0) - 1) AS head FROM islands GROUP BY ALL),
    tables AS (SELECT page_id, island, any_value(head) AS head, any_value(line) FILTER (WHERE place = head) AS header,
                      {sql_fold("any_value(heading) || ' ' || string_agg(line, ' ' ORDER BY place) FILTER (WHERE place BETWEEN head AND head + 3)")} AS context
               FROM islands JOIN heads USING (page_id, island) GROUP BY ALL),
    below AS (SELECT page_id, line_no, 'table_row' AS payload_kind, {sql_compact("concat_ws(' ', nullif(heading, ''), header, line)")} AS excerpt
             FROM islands JOIN tables USING (page_id, island) WHERE place > head AND NOT contains(line, '---') AND ({_benefit('context')} IS NOT NULL OR {_any('context', vocab.CONTEXT_TERMS)})),
    near AS (SELECT *, string_agg(line, ' ') OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS excerpt FROM numbered),
    found AS (
      SELECT * FROM below WHERE length(excerpt) > 20
      UNION ALL SELECT page_id, line_no, 'paragraph', excerpt FROM near
      WHERE line NOT LIKE '|%' AND length(line) >= 20 AND {_benefit(sql_fold('excerpt'))} IS NOT NULL AND {_any(sql_fold('excerpt'), vocab.CONTEXT_TERMS)}),
    folded AS (SELECT page_id, line_no, payload_kind, left(excerpt, {vocab.EXCERPT_LENGTH}) AS excerpt, {sql_fold(f'left(excerpt, {vocab.EXCERPT_LENGTH})')} AS f FROM found)
    SELECT page_id, line_no::INTEGER AS line_no, payload_kind, {_benefit('f')} AS benefit_kind,
           CASE WHEN contains(f, 'победител') AND NOT contains(f, 'призер') THEN 'winner' WHEN contains(f, 'призер') AND NOT contains(f, 'победител') THEN 'prize_winner' END AS diploma_status,
           CASE WHEN try_cast(regexp_extract(f, '(?:егэ|ви)[^0-9]{{0,56}}\\b(\\d{{2,3}})\\s*бал', 1) AS INTEGER) <= 100
                THEN try_cast(regexp_extract(f, '(?:егэ|ви)[^0-9]{{0,56}}\\b(\\d{{2,3}})\\s*бал', 1) AS INTEGER) END AS min_score,
           CASE WHEN payload_kind = 'table_row' AND {_benefit('f')} IS NOT NULL THEN 72 ELSE 52 END AS confidence, md5(excerpt) AS excerpt
    FROM folded
    """,
)
def page_candidates(s: Source):
    """All given pages from markup to rule candidates: blocks, pipe text, tables and paragraphs."""
    html = F.col("html")
    for word, term in TERMED:
        html = F.replace(html, F.lit(word), F.lit(term))
    pages = s.dealt("pages", "page_id", "html").select("page_id", html.alias("html"))
    docs = settle(pages, ["page_id"], {"text": html_text("html")}).withColumn("digest", F.sha2("text", 256))
    found = find_candidates(docs, ["page_id", "digest"], "text", "digest")
    return found.select(
        "page_id", F.col("line_no").cast("int").alias("line_no"), "payload_kind", "benefit_kind", "diploma_status", "min_score", "confidence",
        F.md5("source_excerpt").alias("excerpt"),
    )


@query(
    "document_markers",
    f"""
    SELECT doc_id, lang, contains({sql_unquoted('text')}, 'the') AND contains({sql_unquoted('text')}, 'and') AS is_own FROM documents
    """,
)
def document_markers(s: Source):
    folded = fold_unquoted("text")
    return s.dealt("documents", "doc_id", "lang", "text").select(
        "doc_id", "lang", (F.contains(folded, F.lit("the")) & F.contains(folded, F.lit("and"))).alias("is_own")
    )
