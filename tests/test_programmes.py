"""Programme catalogues: every format, foreign documents, course codes."""

from ruleweave.operators.programmes import catalogue_programmes, unsupported
from ruleweave import vocab


def programmes(spark, code, text):
    docs = spark.createDataFrame([(1, f"catalogue-{code}-2026-v1", text)], "doc_id int, adapter string, text string")
    rows = catalogue_programmes(docs, "doc_id", "adapter", "text").orderBy("reader_rank", "line_no").collect()
    return [(r.external_code, r.name, r.degree_level) for r in rows]


def test_name_without_code(spark):
    text = "# НИУ ВШЭ, Пермь\n| Образовательная программа | Места |\n| --- | --- |\n| История искусств | 25 |"
    assert programmes(spark, "hse", text) == [(None, "История искусств", "bachelor")]


def test_alias_order_beats_column_order(spark):
    text = "# НИЯУ МИФИ\n| Код | Название направления | Образовательная программа |\n| --- | --- | --- |\n| 10.05.03 | Безопасность | Защита сетей |"
    assert programmes(spark, "mephi", text) == [("10.05.03", "Защита сетей", "specialist")]


def test_text_before_the_code_is_dropped(spark):
    text = "# МГУ\n| Факультет, направление подготовки, специальность | Места |\n| --- | --- |\n| Химический факультет, 04.03.01 Химия — | 9 |"
    assert programmes(spark, "msu", text) == [("04.03.01", "Химия", "bachelor")]


def test_summary_code_is_carried_to_unit_rows(spark):
    text = (
        "| Подразделение | Образовательные программы | Группа |\n| --- | --- | --- |\n"
        "| 03.03.01 Прикладные физика и математика | 90 | |\n| ЛФИ | Общая физика | А |\n| Работодатель | Завод | Б |\n| 00.00.07 Курс | 1 | |\n| ФБМФ | Биофизика | В |"
    )
    assert programmes(spark, "mipt", text) == [("03.03.01", "Общая физика", "bachelor"), ("03.03.01", "Биофизика", "bachelor")]


def test_combined_header_code_line_and_card(spark):
    assert programmes(
        spark, "bmstu", "# МГТУ им. Баумана\n| Код, наименование направления подготовки | Срок |\n| --- | --- |\n| 15.03.06 Мехатроника | 4 |"
    ) == [("15.03.06", "Мехатроника", "bachelor")]
    assert programmes(spark, "mai", "# МАИ\n## Двигатели летательных аппаратов\n24.05.02\n") == [
        ("24.05.02", "Двигатели летательных аппаратов", "specialist")
    ]
    assert programmes(spark, "mai", "# МАИ\n## Программы\n### Ракетостроение\n### Авионика\n## Контакты\n### Адрес кампуса") == [
        (None, "Ракетостроение", "bachelor"), (None, "Авионика", "bachelor"),
    ]


def test_foreign_document_course_codes_and_duplicates(spark):
    table = "| Код | Наименование направления подготовки |\n| --- | --- |\n| 00.00.03 | Кружок |\n| 09.03.02 | Системы |\n| 09.03.02 | СИСТЕМЫ |"
    assert programmes(spark, "mai", "# НИУ ВШЭ\n" + table) == []
    assert programmes(spark, "mirea", "# РТУ МИРЭА\n" + table) == [("09.03.02", "Системы", "bachelor")]


def test_unknown_adapter_is_an_error_row(spark):
    docs = spark.createDataFrame([(1, "x"), (2, vocab.CATALOGUE_FORMATS[0].code)], "doc_id int, adapter string")
    assert [r.doc_id for r in unsupported(docs, "adapter", [f.code for f in vocab.CATALOGUE_FORMATS]).collect()] == [1]
