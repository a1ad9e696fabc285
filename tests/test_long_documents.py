"""One very long document costs in proportion to its length."""

import time

import pytest
from pyspark.sql import functions as F

from ruleweave.functions.text import split_lines
from ruleweave.operators.generic import table_rows
from ruleweave.operators.resolve import catalogue_match
from ruleweave.operators.strict import scope_rows


def seconds(build):
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def scopes(n):
    row = "| {i} | Олимпиада {i} | химия | 1 | 2 | химия | да | да |"
    return "\n".join("| Для направлений подготовки 04.03.01 |" if i % 50 == 0 else row.format(i=i) for i in range(n))


def tables(n):
    return "\n".join(f"# Льготы {i}\n| Олимпиада | Льгота |\n| --- | --- |\n| Большая химическая колба {i} | БВИ |" for i in range(n // 4))


CASES = {
    "scope_rows": (scopes, lambda docs: docs.select("id", F.explode(scope_rows(split_lines("text")))), 25_000),
    "table_rows": (tables, lambda docs: table_rows(docs, ["id"], "text"), 25_000),
}


@pytest.mark.parametrize("name", CASES)
def test_tables(spark, name):
    text, read, size = CASES[name]

    def run(n):
        docs = spark.createDataFrame([(1, text(n))], "id long, text string").repartition(1)
        return seconds(lambda: read(docs))

    run(500)
    small, large = run(size), run(2 * size)
    assert large <= 2.5 * small + 1, (small, large)


def test_matcher(spark):
    profiles = spark.createDataFrame([(i, "Большая колба естествознания", f"профиль {i} имени", 1) for i in range(3)], "profile_id long, title string, profile_title string, level int")

    def run(n):
        text = "Большая колба естествознания " + " ".join(f"слово{i}" for i in range(n)) + " профиль 1 имени"
        docs = spark.createDataFrame([(1, text)], "id long, text string")
        return seconds(lambda: catalogue_match(docs, "id", "text", profiles))

    run(500)
    small, large = run(20_000), run(40_000)
    assert large <= 2.5 * small + 1, (small, large)


def test_names_are_found_at_any_letter(spark):
    profiles = spark.createDataFrame([(1, "Большая колба естествознания", "химия", 1), (2, "Большая колба естествознания", "а б в г", 2)], "profile_id long, title string, profile_title string, level int")
    texts = ["Большая колба естествознания биохимия", "x Большая колба естествознания а б в г", "Большая колба естествознания а б в"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.matched_profile_id for r in catalogue_match(docs, "id", "text", profiles).collect()}
    assert got == {0: 1, 1: 2, 2: None}
