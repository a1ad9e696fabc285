"""Rule and programme extraction: one document per part, built from its columns.

The SQL twins state the rules a document must give straight from the columns, so they share no
reading logic with the extractors.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions import classify as k
from ruleweave.functions.text import fold
from ruleweave.operators import competitions as comp
from ruleweave.operators.generic import find_candidates, identity_text, row_identities as identities, table_rows
from ruleweave.operators.programmes import catalogue_programmes
from ruleweave.operators.strict import dispatch, strict_rules
from ruleweave.plans.queries.base import Source, long, query
from ruleweave.plans.queries.documents import WORDS
from ruleweave.plans.queries.scalars import sql_fold


def text(*parts: str | Column) -> Column:
    """Concatenate literals and ``{column}`` references."""
    pieces = []
    for part in parts:
        if isinstance(part, Column):
            pieces.append(part)
            continue
        for i, piece in enumerate(part.split("{")):
            if i == 0:
                pieces.append(F.lit(piece))
                continue
            name, rest = piece.split("}", 1)
            pieces += [F.col(name).cast("string"), F.lit(rest)]
    return F.concat(*pieces)


SQL_PARTS = """
parts AS (
  SELECT *, printf('%02d.03.%02d', p_size, p_size) AS code1, printf('%02d.05.01', p_size) AS code2, p_size + 50 AS score FROM part)
"""


def parts(s: Source) -> DataFrame:
    size = F.format_string("%02d", "p_size")
    return s.dealt("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").withColumns(
        {
            "code1": F.concat(size, F.lit(".03."), size),
            "code2": F.concat(size, F.lit(".05.01")),
            "score": F.col("p_size") + 50,
        }
    )


def generic_docs(s: Source) -> DataFrame:
    first = F.when(F.col("p_size") <= 25, "БВИ для призёров").otherwise("Приём на общих основаниях")
    body = text(
        "## Права победителей {p_brand}\n| Полное наименование олимпиады | Профиль олимпиады | Льгота |\n| --- | --- | --- |\n"
        "| Олимпиада {p_name} | {p_type} | ", first, " |\n|  | {p_brand} | 100 баллов при ЕГЭ от {score} баллов |\n\n"
        "Победителям олимпиад по теме {p_name} вуз даёт БВИ без экзаменов.",
    )
    docs = parts(s).select("p_partkey", body.alias("text"))
    return docs.withColumn("digest", F.sha2("text", 256))


@query(
    "candidate_extract",
    f"""
    WITH {SQL_PARTS},
    docs AS (
      SELECT *, CASE WHEN p_size <= 25 THEN 'БВИ для призёров' ELSE 'Приём на общих основаниях' END AS first,
             'Олимпиада ' || p_name AS title, 'Победителям олимпиад по теме ' || p_name || ' вуз даёт БВИ без экзаменов.' AS prose FROM parts),
    lined AS (
      SELECT *, '| Олимпиада ' || p_name || ' | ' || p_type || ' | ' || first || ' |' AS row1,
             '| | ' || p_brand || ' | 100 баллов при ЕГЭ от ' || score || ' баллов |' AS row2,
             'Права победителей ' || p_brand || ' | Полное наименование олимпиады | Профиль олимпиады | Льгота | ' AS lead,
             sha256('## Права победителей ' || p_brand || chr(10) || '| Полное наименование олимпиады | Профиль олимпиады | Льгота |' || chr(10)
               || '| --- | --- | --- |' || chr(10) || '| Олимпиада ' || p_name || ' | ' || p_type || ' | ' || first || ' |' || chr(10)
               || '|  | ' || p_brand || ' | 100 баллов при ЕГЭ от ' || score || ' баллов |' || chr(10) || chr(10) || prose) AS digest FROM docs),
    found AS (
      SELECT p_partkey, digest, 4 AS line_no, lead || row1 AS source_excerpt, 'table_row' AS payload_kind,
             CASE WHEN p_size <= 25 THEN 'bvi' END AS benefit_kind, CASE WHEN p_size > 25 THEN 'winner' END AS diploma_status,
             'law' AS subject_code, NULL AS min_score, CASE WHEN p_size <= 25 THEN 72 ELSE 52 END AS confidence, title AS olympiad_title, p_type AS profile_title FROM lined
      UNION ALL
      SELECT p_partkey, digest, 5, lead || row2, 'table_row', 'hundred_points', 'winner', 'law', score, 72, title, p_brand FROM lined
      UNION ALL
      SELECT p_partkey, digest, 6, row1 || ' ' || row2 || ' ' || prose, 'paragraph', 'bvi', CASE WHEN p_size > 25 THEN 'winner' END,
             NULL, score, 52, NULL, NULL FROM lined)
    SELECT p_partkey, line_no, source_excerpt, payload_kind, benefit_kind, diploma_status, subject_code, min_score, confidence,
           olympiad_title, profile_title,
           substr(sha256(digest || chr(31) || line_no || chr(31) || source_excerpt || chr(31) || coalesce(olympiad_title, '') || chr(31) || coalesce(profile_title, '')), 1, 32) AS candidate_key
    FROM found
    """,
)
def candidate_extract(s: Source):
    found = find_candidates(generic_docs(s), ["p_partkey", "digest"], "text", "digest")
    return found.drop("digest", "source_locator", "programme_selector")


def explicit_docs(s: Source) -> DataFrame:
    selector = F.when(F.col("p_size") > 40, "Все направления").when(F.col("p_size") > 20, text("{code1}, {code2}")).otherwise(text("Программа {p_brand}"))
    prize = F.when(F.col("p_retailprice") > 950, "+").otherwise("нет")
    body = text(
        "| Программа | Олимпиада | Профиль олимпиады | Победители | Призёры | БВИ | Подтверждающий предмет | Минимальный балл |\n"
        "| --- | --- | --- | --- | --- | --- | --- | --- |\n| ", selector, " | Олимпиада {p_name} | {p_type} | да | ", prize,
        " | есть | Физика | {score} |",
    )
    return parts(s).select("p_partkey", body.alias("text")).withColumn("digest", F.sha2("text", 256))


EXPLICIT = f"""
WITH {SQL_PARTS},
chosen AS (
  SELECT *, CASE WHEN p_size > 40 THEN [] WHEN p_size > 20 THEN [code1, code2] ELSE ['Программа ' || p_brand] END AS selectors,
         CASE WHEN p_retailprice > 950 THEN ['winner', 'prize_winner'] ELSE ['winner'] END AS statuses FROM parts)
"""


@query(
    "explicit_rows",
    EXPLICIT + """
    SELECT p_partkey, 3 AS line_no, 100 AS confidence, 'bvi' AS benefit_kind, diploma_status, programme_selector,
           'Олимпиада ' || p_name AS olympiad_title, p_type AS profile_title, 'physics' AS subject_code, score AS min_score
    FROM (SELECT *, unnest(selectors) AS programme_selector FROM chosen), unnest(statuses) AS t(diploma_status)
    """,
)
def explicit_rows(s: Source):
    found = find_candidates(explicit_docs(s), ["p_partkey", "digest"], "text", "digest")
    return found.filter("payload_kind = 'automatic_explicit_table_row'").select(
        "p_partkey", "line_no", "confidence", "benefit_kind", "diploma_status", "programme_selector", "olympiad_title",
        "profile_title", "subject_code", "min_score",
    )


@query(
    "prefer_explicit",
    EXPLICIT + """
    SELECT p_partkey, CASE WHEN len(selectors) > 0 THEN 'automatic_explicit_table_row' ELSE 'table_row' END AS payload_kind,
           CASE WHEN len(selectors) > 0 THEN len(selectors) * len(statuses) ELSE 1 END::BIGINT AS n
    FROM chosen
    """,
)
def prefer_explicit(s: Source):
    found = find_candidates(explicit_docs(s), ["p_partkey", "digest"], "text", "digest")
    return found.groupBy("p_partkey", "payload_kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "row_identities",
    f"""
    WITH {SQL_PARTS}
    SELECT p_partkey, 4 AS line_no, 'Олимпиада ' || p_name AS title, p_type AS profile, 'Олимпиада ' || p_name || ' | ' || p_type AS identity FROM parts
    UNION ALL SELECT p_partkey, 5, 'Олимпиада ' || p_name, p_brand, NULL FROM parts
    """,
)
def row_identities(s: Source):
    rows = table_rows(generic_docs(s), ["p_partkey"], "text")
    none = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("profile"))
    heads = F.col("header_cells")
    return rows.select(
        "p_partkey", "line_no", F.explode(identities(heads, F.col("cells"), F.col("inherited_title"))).alias("pair"),
        identity_text(F.col("kind"), heads, F.col("cells"), none).alias("identity"),
    ).select("p_partkey", "line_no", "pair.title", "pair.profile", "identity")


def hse_text() -> Column:
    benefit = F.when(F.col("p_retailprice") < 940, "БВИ").when(F.col("p_retailprice") < 970, "100 баллов").otherwise("нет")
    holder = F.when(F.col("p_size") < 20, "Победителям и призёрам").when(F.col("p_size") < 40, "Призёр").otherwise("участник")
    codes = F.when(F.col("p_type") == "PROMO", text("{code1}, {code2}")).otherwise(F.col("code1"))
    return text(
        "Правила приёма\n| Образовательная программа | Наименование олимпиады | Профиль олимпиады | Предоставляемая льгота | Диплом | Предмет подтверждения | Количество баллов ЕГЭ |\n"
        "| --- | --- | --- | --- | --- | --- | --- |\n| Направление ", codes, ": {p_brand} | | | | | | |\n|  | Турнир {p_name} | {p_type} | ",
        benefit, " | ", holder, " | физика | {score} и более |\n|  |  | {p_brand} | Право на 100 баллов | Победителям | химия | 75 |\n"
        "|  |  | {p_brand} | Право на 100 баллов | Победителям | химия | 99 |",
    )


HSE_RULES = """
hse AS (
  SELECT p_partkey, code AS programme_selector, 'Турнир ' || p_name AS olympiad_title, profile AS profile_title, status AS diploma_status,
         benefit AS benefit_kind, subject AS subject_code, points AS min_score, line_no
  FROM (
    SELECT p_partkey, p_name, code1, code2, p_type, p_type AS profile, CASE WHEN p_retailprice < 940 THEN 'bvi' WHEN p_retailprice < 970 THEN 'hundred_points' END AS benefit,
           CASE WHEN p_size < 20 THEN ['winner', 'prize_winner'] WHEN p_size < 40 THEN ['prize_winner'] ELSE [] END AS statuses,
           'physics' AS subject, score AS points, 5 AS line_no FROM parts
    UNION ALL SELECT p_partkey, p_name, code1, code2, p_type, p_brand, 'hundred_points', ['winner'], 'chemistry', 75, 6 FROM parts) r,
  unnest(CASE WHEN p_type = 'PROMO' AND code1 <> code2 THEN [code1, code2] ELSE [code1] END) AS c(code), unnest(statuses) AS t(status)
  WHERE benefit IS NOT NULL)
"""


@query("grid_rules", f"WITH {SQL_PARTS}, {HSE_RULES} SELECT * FROM hse")
def grid_rules(s: Source):
    docs = parts(s).select("p_partkey", F.lit("strict-hse-2026-v1").alias("adapter"), hse_text().alias("text"))
    return _rules(docs)


def _rules(docs: DataFrame) -> DataFrame:
    found = strict_rules(docs, "p_partkey", "adapter", "text")
    return found.drop("adapter", "source_locator", "source_excerpt", "payload_kind")


def mephi_text() -> Column:
    bvi = F.when(F.col("p_size") > 30, "-").otherwise(F.col("code1"))
    return text(
        "Победители и призёры имеют права\n| № | Полное наименование олимпиады | Поступление БВИ | 100 баллов по общеобразовательному предмету | Общеобразовательный предмет | Профиль олимпиады |\n"
        "| --- | --- | --- | --- | --- | --- |\n| 1 | Олимпиада {p_name} | ", bvi, " | {code2}, {code1}, {code2} | биология | {p_type} |",
    )


MEPHI_RULES = """
mephi AS (
  SELECT p_partkey, code AS programme_selector, 'Олимпиада ' || p_name AS olympiad_title, p_type AS profile_title, status AS diploma_status,
         benefit AS benefit_kind, 'biology' AS subject_code, NULL::INTEGER AS min_score, 4 AS line_no
  FROM (SELECT *, 'bvi' AS benefit, CASE WHEN p_size > 30 THEN [] ELSE [code1] END AS codes FROM parts
        UNION ALL SELECT *, 'hundred_points', [code2, code1] FROM parts) r, unnest(codes) AS c(code), unnest(['winner', 'prize_winner']) AS t(status))
"""


@query(
    "shared_body_rules",
    f"""
    WITH {SQL_PARTS}, {MEPHI_RULES}
    SELECT p_partkey * 10 + 1 AS target_id, 'strict-mephi-2026-v1' AS adapter_code, programme_selector, olympiad_title, profile_title,
           diploma_status, benefit_kind, subject_code, line_no::BIGINT AS line_no FROM mephi
    """,
)
def shared_body_rules(s: Source):
    """One body bound to targets of three adapters: only the adapter whose format it has gives rules."""
    from ruleweave.streaming.refresh import extract

    codes = F.array(*[F.lit(code) for code in ("strict-mephi-2026-v1", "strict-hse-2026-v1", "strict-bmstu-bvi-2026-v1")])
    bodies = parts(s).select("p_partkey", mephi_text().alias("content"), F.posexplode(codes).alias("at", "adapter_code"))
    batch = bodies.select(
        (F.col("p_partkey") * 10 + F.col("at") + 1).alias("target_id"), "adapter_code", F.lit("v1").alias("adapter_version"), "content",
        F.sha2("content", 256).alias("sha256"),
    )
    return extract(batch).select(
        "target_id", "adapter_code", "programme_selector", "olympiad_title", "profile_title", "diploma_status", "benefit_kind",
        "subject_code", F.col("line_no").cast("long").alias("line_no"),
    )


@query("expand_rules", f"WITH {SQL_PARTS}, {MEPHI_RULES} SELECT * FROM mephi")
def expand_rules(s: Source):
    docs = parts(s).select("p_partkey", F.lit("strict-mephi-2026-v1").alias("adapter"), mephi_text().alias("text"))
    return _rules(docs)


def msu_text() -> Column:
    holder = F.when(F.col("p_size") < 25, "Победитель").otherwise("Победитель, призёр")
    return text(
        "Особые права при приёме в МГУ, 2026 год\n| Направление подготовки | Профиль олимпиады | Перечень олимпиад | Победитель или призёр | Общеобразовательный предмет ЕГЭ | Льгота |\n"
        "| --- | --- | --- | --- | --- | --- |\n| Программа {p_brand} | {p_type} | Городская олимпиада {p_name}, Олимпиада {p_type}; Турнир городов | ", holder,
        " | физика | БВИ |\n|  | география | * | Победитель | | БВИ |\n|  |  | Московская олимпиада {p_name} | Победитель, призёр |  | 100 баллов |",
    )


MSU_RULES = """
msu AS (
  SELECT p_partkey, 'Программа ' || p_brand AS programme_selector, title AS olympiad_title, profile AS profile_title, status AS diploma_status,
         benefit AS benefit_kind, 'physics' AS subject_code, 75 AS min_score, line_no
  FROM (SELECT p_partkey, p_brand, p_type AS profile, ['Городская олимпиада ' || p_name, 'Олимпиада ' || p_type, 'Турнир городов'] AS titles,
               CASE WHEN p_size < 25 THEN ['winner'] ELSE ['winner', 'prize_winner'] END AS statuses, 'bvi' AS benefit, 4 AS line_no FROM parts
        UNION ALL SELECT p_partkey, p_brand, 'география', ['Московская олимпиада ' || p_name], ['winner', 'prize_winner'], 'hundred_points', 6 FROM parts) r,
  unnest(titles) AS c(title), unnest(statuses) AS t(status))
"""


@query("programme_first_rules", f"WITH {SQL_PARTS}, {MSU_RULES} SELECT * FROM msu")
def programme_first_rules(s: Source):
    docs = parts(s).select("p_partkey", F.lit("strict-msu-2026-v2").alias("adapter"), msu_text().alias("text"))
    return _rules(docs)


def scope_text() -> Column:
    prize = F.when(F.col("p_size") < 25, "Предоставляется").otherwise("Не предоставляется")
    return text(
        "Приложение 5.1. Право поступления без вступительных испытаний\n| № | Наименование | Профиль | Область | Уровень | Предмет | Победителям | Призёрам |\n"
        "| --- | --- | --- | --- | --- | --- | --- | --- |\n| 0 | Рано | x | x | I | физика | Предоставляется | Предоставляется |\n"
        "| Для направлений: {code1}, {code2} | | | | | | | |\n| 1 | Турнир {p_name} | {p_type} | x | I | физика | Предоставляется | ", prize,
        " |\n|  |  | {p_brand} | x | I | химия | - | Предоставляется |",
    )


SCOPE_RULES = """
scoped AS (
  SELECT p_partkey, code AS programme_selector, 'Турнир ' || p_name AS olympiad_title, profile AS profile_title, status AS diploma_status,
         'bvi' AS benefit_kind, subject AS subject_code, 75 AS min_score, line_no
  FROM (SELECT p_partkey, p_name, code1, code2, p_type AS profile, 'physics' AS subject,
               CASE WHEN p_size < 25 THEN ['winner', 'prize_winner'] ELSE ['winner'] END AS statuses, 6 AS line_no FROM parts
        UNION ALL SELECT p_partkey, p_name, code1, code2, p_brand, 'chemistry', ['prize_winner'], 7 FROM parts) r,
  unnest([code1, code2]) AS c(code), unnest(statuses) AS t(status))
"""


@query("scope_row_rules", f"WITH {SQL_PARTS}, {SCOPE_RULES} SELECT * FROM scoped")
def scope_row_rules(s: Source):
    docs = parts(s).select("p_partkey", F.lit("strict-bmstu-bvi-2026-v1").alias("adapter"), scope_text().alias("text"))
    return _rules(docs)


@query(
    "adapter_dispatch",
    f"""
    WITH {SQL_PARTS}, {HSE_RULES}, {MEPHI_RULES}, {MSU_RULES}, {SCOPE_RULES},
    emitted AS (
      SELECT 'strict-hse-2026-v1' AS adapter, * FROM hse UNION ALL SELECT 'strict-msu-2026-v2', * FROM msu
      UNION ALL SELECT 'strict-bmstu-bvi-2026-v1', * FROM scoped UNION ALL SELECT 'strict-mephi-2026-v1', * FROM mephi),
    docs AS (
      SELECT p_partkey, p_size, CASE p_type WHEN 'ECONOMY' THEN 'strict-hse-2026-v1' WHEN 'LARGE' THEN 'strict-msu-2026-v2'
             WHEN 'MEDIUM' THEN 'strict-bmstu-bvi-2026-v1' WHEN 'PROMO' THEN 'strict-mephi-2026-v1' WHEN 'SMALL' THEN 'strict-mipt-2026-v2'
             ELSE 'strict-unknown-v1' END AS adapter FROM part)
    SELECT d.p_partkey, d.adapter,
           CASE WHEN d.adapter = 'strict-unknown-v1' THEN 'unsupported_adapter'
                WHEN d.p_size = 1 AND d.adapter <> 'strict-hse-2026-v1' THEN 'foreign_document'
                WHEN d.adapter = 'strict-mipt-2026-v2' THEN 'recognised_not_emitted' ELSE 'read' END AS dispatch_status,
           count(e.p_partkey) FILTER (WHERE d.p_size <> 1) AS n_rules
    FROM docs d LEFT JOIN emitted e ON e.p_partkey = d.p_partkey AND e.adapter = d.adapter
    GROUP BY d.p_partkey, d.adapter, d.p_size
    """,
)
def adapter_dispatch(s: Source):
    formats = {
        "ECONOMY": ("strict-hse-2026-v1", hse_text()), "LARGE": ("strict-msu-2026-v2", msu_text()),
        "MEDIUM": ("strict-bmstu-bvi-2026-v1", scope_text()), "PROMO": ("strict-mephi-2026-v1", mephi_text()),
        "SMALL": ("strict-mipt-2026-v2", F.lit("Конкурсные группы физтех-школ")),
    }
    adapter, body = F.lit("strict-unknown-v1"), F.lit("?")
    for kind, (code, content) in formats.items():
        adapter = F.when(F.col("p_type") == kind, code).otherwise(adapter)
        body = F.when(F.col("p_type") == kind, content).otherwise(body)
    docs = parts(s).select(
        "p_partkey", adapter.alias("adapter"), F.when(F.col("p_size") == 1, "чужой документ").otherwise(body).alias("text")
    )
    judged = dispatch(docs, "adapter", "text").select("p_partkey", "adapter", "dispatch_status")
    counted = strict_rules(docs, "p_partkey", "adapter", "text").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_rules"))
    return judged.join(counted.hint("merge"), "p_partkey", "left").na.fill(0, ["n_rules"])


def catalogue_text() -> Column:
    return text(
        "# РТУ МИРЭА\n| Код | Наименование направления подготовки |\n| --- | --- |\n| {code1} | {p_name} {p_brand} |\n| 00.00.12 | Курс |\n"
        "\n{code2} — {p_type} плюс\n## Раздел {p_brand}\n{code1}\n",
    )


@query(
    "catalogue_rows",
    f"""
    WITH {SQL_PARTS}
    SELECT p_partkey, code1 AS external_code, p_name || ' ' || p_brand AS name, 'bachelor' AS degree_level, 'markdown:table:2:row:4' AS source_locator FROM parts
    UNION ALL SELECT p_partkey, code2, p_type || ' плюс', 'specialist', 'markdown:line:7' FROM parts
    UNION ALL SELECT p_partkey, code1, 'Раздел ' || p_brand, 'bachelor', 'markdown:line:9' FROM parts
    """,
)
def catalogue_rows(s: Source):
    docs = parts(s).select("p_partkey", F.lit("catalogue-mirea-2026-v1").alias("adapter"), catalogue_text().alias("text"))
    return catalogue_programmes(docs, "p_partkey", "adapter", "text").select(
        "p_partkey", "external_code", "name", "degree_level", "source_locator"
    )


@query(
    "union_extractors",
    f"""
    WITH {SQL_PARTS}
    SELECT p_partkey, NULL::VARCHAR AS external_code, p_name AS name, 'card' AS reader, 3::BIGINT AS line_no FROM parts
    UNION ALL SELECT p_partkey, code1, p_name, 'code_line', 4 FROM parts
    UNION ALL SELECT p_partkey, code2, p_type || ' курс', 'table', 8 FROM parts WHERE p_size > 10
    UNION ALL SELECT p_partkey, code2, p_type || ' курс', 'code_line', 10 FROM parts WHERE p_size <= 10
    """,
)
def union_extractors(s: Source):
    repeat = F.when(F.col("p_size") <= 10, text("{code2} {p_type} КУРС")).otherwise("Конец")
    body = text(
        "# МАИ\n## Программы\n### {p_name}\n{code1} {p_name}\n## Таблица\n| Код | Наименование направления |\n| --- | --- |\n"
        "| {code2} | {p_type} курс |\n\n", repeat,
    )
    docs = parts(s).select("p_partkey", F.lit("catalogue-mai-2026-v1").alias("adapter"), body.alias("text"))
    reader = F.get(F.array(F.lit("card"), F.lit("code_line"), F.lit("table")), F.col("reader_rank") - 1)
    found = catalogue_programmes(docs, "p_partkey", "adapter", "text")
    name = F.when(F.col("name").like("% КУРС"), F.replace("name", F.lit("КУРС"), F.lit("курс"))).otherwise(F.col("name"))
    return found.select("p_partkey", "external_code", name.alias("name"), reader.cast("string").alias("reader"), long("line_no").alias("line_no"))


@query(
    "summary_code_rows",
    f"""
    WITH {SQL_PARTS}
    SELECT p_partkey, code1 AS external_code, p_name AS name, 'bachelor' AS degree_level FROM parts
    UNION ALL SELECT p_partkey, code2, p_brand || ' итог', 'specialist' FROM parts
    """,
)
def summary_code_rows(s: Source):
    body = text(
        "| Подразделение | Образовательные программы | Группа |\n| --- | --- | --- |\n| {code1} Направление | 12 | |\n| {p_type} | {p_name} | А |\n"
        "| работодатель | Завод | Б |\n| {code2} Другое | 3 | |\n| ФПМИ | {p_brand} итог | В |\n",
    )
    docs = parts(s).select("p_partkey", F.lit("catalogue-mipt-2026-v1").alias("adapter"), body.alias("text"))
    return catalogue_programmes(docs, "p_partkey", "adapter", "text").select("p_partkey", "external_code", "name", "degree_level")


@query(
    "keyword_classify",
    f"""
    WITH folded AS (
      SELECT doc_id, {sql_fold(''.join('replace(' for _ in WORDS) + 'text' + ''.join(f", '{a}', '{b}')" for a, b in WORDS))} AS f FROM documents)
    SELECT doc_id, CASE WHEN contains(f, 'the the') OR contains(f, ' la ') THEN 'bvi' WHEN contains(f, ' des ') OR contains(f, 'ing') THEN 'hundred_points' END AS benefit,
           CASE WHEN contains(f, 'победител') AND NOT contains(f, 'егэ') THEN 'winner' WHEN contains(f, 'егэ') AND NOT contains(f, 'победител') THEN 'prize_winner' END AS diploma,
           CASE WHEN contains(f, 'schen') THEN 'german' WHEN contains(f, 'eaux') THEN 'french' WHEN contains(f, 'tion') THEN 'any' END AS subject
    FROM folded
    """,
)
def keyword_classify(s: Source):
    body = F.col("text")
    for word, term in WORDS:
        body = F.replace(body, F.lit(word), F.lit(term))
    folded = s.dealt("documents", "doc_id", "text").select("doc_id", fold(body).alias("f"))
    f = F.col("f")
    return folded.select(
        "doc_id", k.first_kind(f, (("bvi", ("the the", " la ")), ("hundred_points", (" des ", "ing")))).alias("benefit"),
        k.single_holder(f, "победител", "егэ").alias("diploma"),
        k.first_fragment(f, (("schen", "german"), ("eaux", "french"), ("tion", "any"))).alias("subject"),
    )


@query(
    "score_extract",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           CASE WHEN l_returnflag <> 'R' AND l_partkey BETWEEN 10 AND 100 THEN l_partkey END::INTEGER AS min_score,
           CASE WHEN l_suppkey BETWEEN 10 AND 100 THEN l_suppkey END::INTEGER AS cell_score
    FROM lineitem
    """,
)
def score_extract(s: Source):
    lead = F.when(F.col("l_returnflag") == "R", "экзамен ").otherwise("При ЕГЭ не ниже ")
    prose = F.concat(lead, "l_partkey", F.lit(" баллов по предмету"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return s.lineitem.select(
        *keys, k.pattern_score(fold(prose)).alias("min_score"),
        k.cell_score(F.concat(F.lit("от "), "l_suppkey", F.lit(" и более"))).alias("cell_score"),
    )


@query(
    "list_split_lookahead",
    f"""
    WITH {SQL_PARTS}
    SELECT p_partkey, 'Городская олимпиада ' || p_name || ', секция ' || p_brand || '¦Олимпиада ' || p_type
             || CASE WHEN p_size > 25 THEN '¦Турнир городов' ELSE '' END AS strict_titles,
           'Городская олимпиада ' || p_name || ', секция ' || p_brand || '¦Олимпиада ' || p_type || CASE WHEN p_size > 25 THEN '; Турнир городов' ELSE '' END AS marked_titles,
           CASE WHEN p_size > 25 THEN 0 ELSE 2 END AS checked
    FROM parts
    """,
)
def list_split_lookahead(s: Source):
    listed = text("Городская олимпиада {p_name}, секция {p_brand},  Олимпиада {p_type}", F.when(F.col("p_size") > 25, "; Турнир городов").otherwise(""))
    odd = text("Олимпиада {p_name}, Открытая ", F.when(F.col("p_size") > 25, "встреча").otherwise("олимпиада"))
    return parts(s).select(
        "p_partkey", F.array_join(k.strict_titles(listed), "¦").alias("strict_titles"),
        F.array_join(k.marked_titles(listed), "¦").alias("marked_titles"), F.size(k.strict_titles(odd)).alias("checked"),
    )


@query(
    "multi_label_tags",
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Информатика,Математика' WHEN '2-HIGH' THEN 'Физика,Право'
           WHEN '3-MEDIUM' THEN 'Английский язык,Немецкий язык,Французский язык,Испанский язык,Итальянский язык,Китайский язык'
           WHEN '4-NOT SPECIFIED' THEN 'Разные предметы' ELSE 'Информатика' END AS tags
    FROM orders
    """,
)
def multi_label_tags(s: Source):
    topics = {
        "1-URGENT": "Математика и программирование", "2-HIGH": "право, физика", "3-MEDIUM": "Иностранные языки: немецкий",
        "4-NOT SPECIFIED": "без темы",
    }
    topic = F.lit("Робототехника и информатика")
    for key, value in topics.items():
        topic = F.when(F.col("o_orderpriority") == key, value).otherwise(topic)
    return s.orders.select("o_orderkey", F.array_join(k.subject_tags(topic), ",").alias("tags"))


@query(
    "html_table_records",
    f"""
    WITH {SQL_PARTS}
    SELECT p_partkey, 1::BIGINT AS record_no, 'rsosh-' || p_size || '-1' AS id, 'Олимпиада «' || p_name || '»' AS title, p_type AS profile,
           'физика' AS subject_detail, 'Физика' AS subject, CASE WHEN p_size > 25 THEN '2' ELSE '—' END AS level FROM parts
    UNION ALL SELECT p_partkey, 2, 'rsosh-' || p_size || '-2', 'Олимпиада «' || p_name || '»', p_brand, 'право & химия', 'Химия', '3' FROM parts
    """,
)
def html_table_records(s: Source):
    level = F.when(F.col("p_size") > 25, "уровень 2").otherwise("без уровня")
    page = text(
        '<p>x</p><TABLE class="mainTableInfo"><tr><th>№</th></tr><tr><td>мало</td></tr><tr class="a"><td> {p_size} </td><td>Олимпиада\n&laquo;{p_name}&raquo;</td>'
        "<td><b>{p_type}</b></td><td>физика</td><td>", level, "</td></tr><tr><td>{p_brand}</td><td>право &amp; химия</td><td>3</td></tr>"
        "<tr><td>{p_brand}</td><td>повтор</td><td>1</td></tr></table><table><tr><td>7</td></tr></table>",
    )
    pages = parts(s).select("p_partkey", page.alias("html"))
    return comp.list_records(pages, "p_partkey", "html").select(
        "p_partkey", "record_no", "id", "title", "profile", "subject_detail", "subject", "level"
    )


@query(
    "html_card_records",
    f"""
    WITH {SQL_PARTS}
    SELECT p_partkey, 1::BIGINT AS record_no, 'Я — профессионал · Физика ' || p_brand AS title, 'Вуз ' || p_type AS organizer, 'Физика' AS subject,
           CASE WHEN p_size > 25 THEN 'Я — профессионал · направления 2024/2025' ELSE 'Я — профессионал · направления текущий сезон' END AS source,
           'https://yandex.ru/d/' || p_partkey || '?a=1&b=2' AS source_url FROM parts
    UNION ALL SELECT p_partkey, 2, 'Я — профессионал · ' || p_name, 'Вуз', 'Разные предметы',
           CASE WHEN p_size > 25 THEN 'Я — профессионал · направления 2024/2025' ELSE 'Я — профессионал · направления текущий сезон' END,
           'https://other.example.org/' FROM parts
    """,
)
def html_card_records(s: Source):
    def card(href: str, title: str, place: str) -> str:
        return (
            f'<a class="DirectionsSpoilerItem_item__x1" href="{href}">\n <span class="DirectionsSpoilerItem_title__q">{title}</span>'
            f'<span class="DirectionsSpoilerItem_place__z">{place}</span></a>'
        )

    season = F.when(F.col("p_size") > 25, "<h1>Направления <b>2024</b>—2025</h1>").otherwise("<h1>Направления</h1>")
    page = text(
        season, card("/d/{p_partkey}?a=1&amp;b=2", "Физика {p_brand}", "Вуз&nbsp;{p_type}"),
        card("/again", "ФИЗИКА {p_brand}", "Вуз"), card("https://other.example.org/", "{p_name}", " Вуз "),
    )
    pages = parts(s).select("p_partkey", page.alias("html"))
    return comp.card_records(pages, "p_partkey", "html").select(
        "p_partkey", "record_no", "title", "organizer", "subject", "source", "source_url"
    )


@query(
    "exact_subjects",
    """
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'physics' WHEN 'LARGE' THEN 'english' WHEN 'MEDIUM' THEN 'informatics' END AS code FROM part
    """,
)
def exact_subjects(s: Source):
    word = (
        F.when(F.col("p_type") == "ECONOMY", "  «Физика» ").when(F.col("p_type") == "LARGE", "Английский  язык")
        .when(F.col("p_type") == "MEDIUM", "программирование").otherwise("физика твёрдого тела")
    )
    return s.part.select("p_partkey", k.exact_subject(word, vocab.SUBJECT_ALIASES).alias("code"))


