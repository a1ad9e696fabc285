from collections import Counter

import duckdb

from ruleweave.llm import mixing
from ruleweave.llm.queries import ORACLES


def test_order_follows_the_weights(spark, make):
    rows = [(i, "t", "abc"[i % 3]) for i in range(600)] + [(1000 + i, "t", None) for i in range(40)]
    weights = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0), (None, 2.0), ("gone", 1.0), ("b", float("nan")), ("c", -1.0)], "source string, weight double")
    out = sorted(mixing.mix(make(rows), weights, frame=24).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(640))
    for source in ("a", "b", "c", None):
        own = [r for r in out if r.source == source]
        assert [r.turn for r in own] == list(range(len(own))) and [r.doc_id for r in own] == sorted(r.doc_id for r in own)
    quota = {"a": 12, "b": 6, "c": 2, None: 4}
    had = Counter()
    for slot, row in enumerate(out[: 24 * 10], 1):  # all sources last for ten frames
        had[row.source] += 1
        assert all(abs(had[s] - slot * q / 24) < 1 for s, q in quota.items()), slot


def test_edges(spark, make):
    assert mixing.mix(make([])).count() == 0
    rows = [(1, "x", "a"), (1, "y", "a"), (None, "z", "a"), (1, "x", "b"), (2, "w", None)]
    out = mixing.mix(make(rows)).collect()
    assert sorted(r.position for r in out) == list(range(5))
    assert [r.doc_id for r in sorted(out, key=lambda r: r.turn) if r.source == "a"] == [None, 1, 1]
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.mix(make(rows), none).count() == 5
    assert sorted(mixing.arranged(make(rows)).select("doc_id", "text").collect(), key=str) == sorted(make(rows).select("doc_id", "text").collect(), key=str)


def test_sql_agrees_on_uneven_sources(make):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 7}" if i % 5 else None) for i in range(900)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, s) for i, _, s in rows])
    got = sorted(tuple(r) for r in mixing.mix(make(rows)).select("doc_id", "turn", "position").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, turn, position FROM ({ORACLES['op1_mix_sources']})").fetchall())


def test_stored_order(spark, make, tmp_path):
    rows = [(i, "t", "ab"[i % 4 == 0]) for i in range(400)]
    mixing.arranged(make(rows)).coalesce(1).write.parquet(str(tmp_path / "mixed"))
    stored = [r.doc_id for r in spark.read.parquet(str(tmp_path / "mixed")).collect()]
    places = {r.doc_id: r.position for r in mixing.mix(make(rows)).collect()}
    assert [places[i] for i in stored] == list(range(400))
