"""Upsert laws: idempotence, null-safe keys, guards, child replacement, cascades."""

from pyspark.sql import functions as F

from ruleweave.operators import merge as m
from ruleweave.plans.ingest import set_tracking, update_profile_setup


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_is_idempotent_and_null_safe(spark):
    base = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, l string, v int")
    new = spark.createDataFrame([("a", None, 9), (None, "x", 7)], "k string, l string, v int")
    once = m.upsert(base, new, ["k", "l"])
    assert rows(once) == rows(spark.createDataFrame([("a", None, 9), ("b", "x", 2), (None, "x", 7)], base.schema))
    assert rows(m.upsert(once, new, ["k", "l"])) == rows(once)
    assert rows(m.insert_missing(base, new, ["k", "l"])) == rows(
        spark.createDataFrame([("a", None, 1), ("b", "x", 2), (None, "x", 7)], base.schema)
    )


def test_manual_rows_win_and_status_is_not_reset(spark):
    base = spark.createDataFrame(
        [(1, "manual", "verified", 10), (2, "strict_adapter", "rejected", 20)], "k int, method string, status string, score int"
    )
    new = spark.createDataFrame([(1, 11), (2, 21), (3, 31)], "k int, score int")
    new = new.withColumns({"method": F.lit("strict_adapter"), "status": F.lit("verified")})
    got = m.upsert(base, new, ["k"], update=["score"], guard="method = 'strict_adapter'", with_action=True)
    assert rows(got) == [
        (1, "manual", "verified", 10, "guarded"), (2, "strict_adapter", "rejected", 21, "updated"),
        (3, "strict_adapter", "verified", 31, "inserted"),
    ]


def test_children_and_references(spark):
    children = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "p int, c string")
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    new = spark.createDataFrame([(1, "z")], "p int, c string")
    assert rows(m.replace_children(children, new, spark.createDataFrame([(1,), (3,)], "p int"), "p")) == [(1, "z"), (2, "c"), (None, "e")]
    assert rows(m.cascade(children, parents, "p", "id")) == [(1, "a"), (1, "b"), (2, "c"), (None, "e")]
    assert rows(m.set_null(children, parents, "p", "id")) == [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")]


def test_requests_update_users_subjects_and_tracking(spark):
    now = F.lit("2026-01-05").cast("timestamp")
    t = {
        "app_users": spark.createDataFrame([(1, "school", "9", 2024, None), (2, "school", "8", None, None)], "id long, audience string, grade_or_course string, default_diploma_year short, updated_at timestamp"),
        "subjects": spark.createDataFrame([(1, "math"), (2, "law")], "id short, code string"),
        "user_subjects": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "user_id long, subject_id short"),
        "tracked_olympiads": spark.createDataFrame([(5, 1, 7, True, 2023, None, None)], "id long, user_id long, olympiad_profile_id long, is_active boolean, diploma_year short, added_at timestamp, last_notified_at timestamp"),
    }
    setup = spark.createDataFrame(
        [(1, "student", "1", 2025, ["law", "nope"]), (2, "school", "8", None, None), (99, "school", "1", None, ["math"])],
        "user_id long, audience string, grade_or_course string, default_diploma_year short, subject_codes array<string>",
    )
    got = update_profile_setup(t, setup.filter("user_id < 9"), now)
    assert rows(got["app_users"].select("id", "audience", "default_diploma_year")) == [(1, "student", 2025), (2, "school", None)]
    assert rows(got["user_subjects"]) == [(1, 2), (2, 1), (3, 2)]
    wishes = spark.createDataFrame([(1, 7, False, None), (2, 7, True, 2024)], "user_id long, olympiad_profile_id long, is_active boolean, diploma_year short")
    tracked = set_tracking(t, wishes, now)
    assert rows(tracked.select("user_id", "is_active", "diploma_year")) == [(1, False, 2023), (2, True, 2024)]
