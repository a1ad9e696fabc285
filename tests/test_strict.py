"""Strict readers: a rule needs every fact in its own cells, and a document needs its own adapter."""

import pytest

from ruleweave.operators.strict import dispatch, strict_rules

GRID, CODED = "strict-hse-2026-v1", "strict-mephi-2026-v1"
LISTED, SCOPED = "strict-msu-2026-v2", "strict-bmstu-bvi-2026-v1"
SILENT = ("strict-mipt-2026-v2", "strict-bmstu-100-2026-v1")


def table(headers, *rows, rule=True):
    """Pipe table of lists of cells; a string is put in as a line of its own."""
    lines = ["| " + " | ".join(headers) + " |"] + (["|" + " --- |" * len(headers)] if rule else [])
    return "\n".join(lines + [row if isinstance(row, str) else "| " + " | ".join(row) + " |" for row in rows])


def read(spark, *documents):
    rows = [(n, adapter, text) for n, (adapter, text) in enumerate(documents)]
    docs = spark.createDataFrame(rows, "doc_id int, adapter string, text string")
    return strict_rules(docs, "doc_id", "adapter", "text").orderBy("doc_id", "line_no", "programme_selector", "benefit_kind", "diploma_status").collect()


FACTS = {"programme": "Программа", "title": "Олимпиада", "profile": "Профиль олимпиады", "benefit": "Льгота", "holder": "Диплом"}
ROW = {"programme": "Океанология", "title": "Прилив", "profile": "география", "benefit": "БВИ", "holder": "Победитель"}


@pytest.mark.parametrize("missing", ["title", "profile", "benefit"])
def test_a_table_without_a_needed_column_gives_nothing(spark, missing):
    kept = [k for k in FACTS if k != missing]
    assert read(spark, (GRID, table([FACTS[k] for k in kept], [ROW[k] for k in kept]))) == []


@pytest.mark.parametrize("order", [list(FACTS), list(reversed(FACTS))])
@pytest.mark.parametrize("blank,n", [(None, 1), ("programme", 0), ("title", 0), ("profile", 0), ("benefit", 0), ("holder", 0)])
def test_each_fact_must_be_stated_whatever_the_column_order(spark, order, blank, n):
    cells = ["" if k == blank else ROW[k] for k in order]
    assert len(read(spark, (GRID, table([FACTS[k] for k in order], cells)))) == n


@pytest.mark.parametrize("whom", ["Все направления", "все направления подготовки"])
def test_programmes_named_together_are_no_selector(spark, whom):
    assert read(spark, (GRID, table(FACTS.values(), [whom, *list(ROW.values())[1:]]))) == []


def test_two_benefit_columns_are_two_rules(spark):
    heads = ["Программа", "Олимпиада", "Профиль олимпиады", "Диплом", "БВИ", "100 баллов", "Количество баллов"]
    text = table(heads, ["Океанология", "Прилив", "география", "Призёр", "да", "да", "81"], ["Океанология", "Отлив", "география", "Победитель", "да", "нет", ""])
    found = [(r.olympiad_title, r.benefit_kind, r.diploma_status, r.min_score) for r in read(spark, (GRID, text))]
    assert found == [
        ("Прилив", "bvi", "prize_winner", 81), ("Прилив", "hundred_points", "prize_winner", 81), ("Отлив", "bvi", "winner", None),
    ]


def test_merged_cells_short_rows_and_rules_inside(spark):
    text = table(
        FACTS.values(), list(ROW.values()), ["", "", "физика", "БВИ", "Призёр"], "| --- | --- |", ["", "Отлив", "физика"], "", list(ROW.values()), rule=False
    )
    found = [(r.line_no, r.programme_selector, r.olympiad_title, r.profile_title) for r in read(spark, (GRID, text))]
    # The row of three cells lacks a benefit; the table ends at the blank line, and one line alone is no table.
    assert found == [(2, "Океанология", "Прилив", "география"), (3, "Океанология", "Прилив", "физика")]


def test_a_lone_first_cell_names_the_group_until_the_next(spark):
    rows = [["Направление 05.03.04", "", "", "", ""], ["", "Прилив", "география", "БВИ", "Победитель"], ["Специальность 21.05.01", "", "", "", ""], ["", "", "физика", "БВИ", "Призёр"]]
    heads = ["Уровень", "Олимпиада", "Профиль олимпиады", "Льгота", "Диплом"]
    found = read(spark, (GRID, table([FACTS["programme"], *heads[1:]], *rows)))
    assert [(r.programme_selector, r.olympiad_title, r.profile_title) for r in found] == [("05.03.04", "Прилив", "география"), ("21.05.01", "Прилив", "физика")]


def test_codes_in_the_benefit_cell(spark):
    text = table(["Олимпиада", "Профиль олимпиады", "Поступление БВИ"], ["Прилив", "география", "05.03.04; 21.05.01"], ["Отлив", "география", ""])
    found = read(spark, (CODED, "Победители, призеры.\n" + text), (CODED, text))
    assert [(r.doc_id, r.programme_selector, r.diploma_status) for r in found] == [
        (0, code, status) for code in ("05.03.04", "21.05.01") for status in ("prize_winner", "winner")
    ]  # without both words of its marker the second document is foreign


def test_equal_rules_keep_the_first_and_stay_apart_by_document_and_adapter(spark):
    once = table([*FACTS.values(), "Количество баллов"], [*ROW.values(), "77"], [*ROW.values(), "91"])
    found = read(spark, (GRID, once), (GRID, once))
    assert [(r.doc_id, r.line_no, r.min_score) for r in found] == [(0, 3, 77), (1, 3, 77)]
    docs = spark.createDataFrame([(1, GRID, "Победители и призеры\n" + once), (1, CODED, "Победители и призеры\n" + once.replace("БВИ", "БВИ 05.03.04"))], "doc_id int, adapter string, text string")
    assert sorted({r.adapter for r in strict_rules(docs, "doc_id", "adapter", "text").collect()}) in ([GRID], sorted([GRID, CODED]))


HEADS = ["Направление подготовки", "Профиль олимпиады", "Перечень олимпиад", "Победитель или призер", "Общеобразовательный предмет ЕГЭ", "Льгота"]


def test_listed_titles_are_taken_one_by_one(spark):
    rows = [["Гляциология", "география", "Олимпиада «Лёд», Открытая олимпиада полярников", "Победитель, призер", "география", "БВИ"], ["", "", "*", "Победитель", "", "БВИ"], ["", "", "Олимпиада «Пар», Турнир полярников", "призер", "", "БВИ"], ["", "физика", "Олимпиада «Снег»", "призер", "", "100 баллов"]]
    found = read(spark, (LISTED, "МГУ: особые права 2026\n" + table(HEADS, *rows)), (LISTED, table(HEADS, *rows)))
    got = {(r.olympiad_title, r.diploma_status, r.benefit_kind) for r in found}
    assert got == {
        *((title, status, "bvi") for title in ("Олимпиада «Лёд»", "Открытая олимпиада полярников") for status in ("winner", "prize_winner")),
        ("Олимпиада «Снег»", "prize_winner", "hundred_points"),
    }
    assert {(r.doc_id, r.programme_selector, r.subject_code) for r in found} == {(0, "Гляциология", "geography")}


def scope_table(*rows):
    return "Приложение 5.1. Право поступления без вступительных испытаний\n" + "\n".join("| " + " | ".join(row) + " |" for row in rows)


def scope(codes):
    return ["Для направлений подготовки " + codes, *[""] * 7]


def entry(title, profile, first="Предоставляется", second="-"):
    return ["1", title, profile, "", "", "", first, second]


@pytest.mark.parametrize("rows,want", [
    ([entry("Прилив", "физика")], set()),  # no scope is open
    ([scope("05.03.04"), entry("", "физика")], set()),  # no title since the scope
    ([entry("Прилив", "физика"), scope("05.03.04"), entry("", "физика")], set()),  # the scope voids the title
    ([scope("05.03.04"), entry("Прилив", "физика", "-", "-")], set()),
    ([scope("без кодов"), entry("Прилив", "физика")], set()),
    ([scope("05.03.04"), entry("Прилив", "физика")[:7]], set()),  # a short row
    ([scope("05.03.04, 21.05.01"), entry("Прилив", "физика"), entry("", "химия", "-", "Предоставляется")],
     {(code, *rest) for code in ("05.03.04", "21.05.01") for rest in (("Прилив", "физика", "winner"), ("Прилив", "химия", "prize_winner"))}),
    ([scope("05.03.04"), entry("Прилив", "физика"), scope("21.05.01"), entry("Отлив", "физика")],
     {("05.03.04", "Прилив", "физика", "winner"), ("21.05.01", "Отлив", "физика", "winner")}),
])
def test_scope_rows(spark, rows, want):
    found = read(spark, (SCOPED, scope_table(*rows)))
    assert {(r.programme_selector, r.olympiad_title, r.profile_title, r.diploma_status) for r in found} == want


def test_every_document_has_a_status(spark):
    texts = {SILENT[0]: "физтех-школы, конкурсные группы", SILENT[1]: "Приложение 5.3: 100 баллов", LISTED: "чужой документ", "неизвестный": "", GRID: "", None: "x"}
    docs = spark.createDataFrame(list(texts.items()), "adapter string, text string")
    got = {r.adapter: r.dispatch_status for r in dispatch(docs, "adapter", "text").collect()}
    assert got == {
        SILENT[0]: "recognised_not_emitted", SILENT[1]: "recognised_not_emitted", LISTED: "foreign_document",
        "неизвестный": "unsupported_adapter", GRID: "read", None: "unsupported_adapter",
    }


def test_all_readers_share_one_scan_of_the_documents(spark, tmp_path):
    from ruleweave.operators.programmes import catalogue_programmes
    from ruleweave.operators.strict import strict_rules

    spark.createDataFrame([(1, "strict-hse-2026-v1", "x")], "id long, adapter string, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for read in (strict_rules, catalogue_programmes):
        plan = read(docs, "id", "adapter", "text")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1, plan
