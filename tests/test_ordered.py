"""Chunked scans equal plain loops whatever the chunk length; windows cross chunk borders."""

import random

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import ordered as o

random.seed(5)
LINES = [
    (doc, n, random.choice(["", "", "v%d" % n, "s%d" % n, "|r"]))
    for doc in ("a", "b", "hot") for n in range(1, 90 if doc == "hot" else 9)
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "doc string, n long, x string").repartition(4).cache()


@pytest.mark.parametrize("chunk", [3, 1000])
def test_carry_forward(lines, chunk):
    value = F.when(F.col("x").startswith("v"), F.col("x"))
    got = {(r.doc, r.n): (r.c.value if r.c else None) for r in o.carry_forward(lines, ["doc"], "n", {"c": value}, chunk).collect()}
    for doc in ("a", "b", "hot"):
        last = None
        for _, n, x in [line for line in LINES if line[0] == doc]:
            last = x if x.startswith("v") else last
            assert got[doc, n] == last


@pytest.mark.parametrize("chunk", [2, 1000])
def test_scoped_carry_resets_and_drops(lines, chunk):
    scope = F.when(F.col("x").startswith("s"), F.col("x"))
    value = F.when(F.col("x").startswith("v"), F.col("x"))
    got = {(r.doc, r.n): (r.scope, r.title) for r in o.scoped_carry(lines, ["doc"], "n", scope, {"title": value}, chunk).collect()}
    want = {}
    for doc in ("a", "b", "hot"):
        opened = title = None
        for _, n, x in [line for line in LINES if line[0] == doc]:
            if x.startswith("s"):
                opened, title = x, None
                continue
            title = x if x.startswith("v") else title
            if opened:
                want[doc, n] = (opened, title)
    assert got == want


@pytest.mark.parametrize("chunk", [4, 1000])
def test_context_window_and_islands(lines, chunk):
    near = {(r.doc, r.n): r.context for r in o.context_window(lines, ["doc"], "n", "x", 2, 2, chunk).collect()}
    runs = {(r.doc, r.n): r.table_no for r in o.table_islands(lines, ["doc"], "n", F.col("x") == "|r", chunk).collect()}
    for doc in ("a", "b", "hot"):
        own = [x for d, _, x in LINES if d == doc]
        for i in range(len(own)):
            assert near[doc, i + 1] == " ".join(own[max(0, i - 2): i + 3])
            if own[i] == "|r":
                first = i
                while first and own[first - 1] == "|r":
                    first -= 1
                assert runs[doc, i + 1] == first + 1
    assert len(near) == len(LINES) and len(runs) == sum(x == "|r" for _, _, x in LINES)


def test_first_last_and_header_ties(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), (None, 3, "c"), (None, 4, "d")], "k string, n int, v string")
    assert {r.v for r in o.keep_first(df, ["k"], ["n"]).collect()} == {"a", "c"}
    assert {r.v for r in o.keep_last(df, ["k"], ["n"]).collect()} == {"b", "d"}
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 3), (2, 1, 0)], "t int, n long, s int")
    first = {r.t: r.header_line for r in o.header_argmax(rows, ["t"], "n", F.col("s")).collect()}
    last = {r.t: r.header_line for r in o.header_argmax(rows, ["t"], "n", F.col("s"), "last", 2).collect()}
    assert first == {1: 2, 2: 1} and last == {1: 3}


def test_group_limit_is_pushed_below_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = o.top_per_key(df, ["k"], [F.asc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
