"""Stores that several writers share: bodies by hash, pointers, releases, attached targets, configuration."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from ruleweave import vocab
from ruleweave.plans import discovery, ingest, publish
from ruleweave.schemas import TABLES
from ruleweave.sources import pointers, releases, snapshots, store
from test_jobs import candidate, now, table, world  # noqa: F401  (fixture)


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


def test_a_body_is_stored_once(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.stored_bodies(spark, root) is None
    assert store.read_bodies(spark, root, spark.createDataFrame([("00",)], "content_sha256 string")).count() == 0
    store.store_bodies(bodies(spark, "a", "b", "a", None, "", "ü" * 1000), "body", root, "1")
    store.store_bodies(bodies(spark, "b", "c"), "body", root, "2")
    store.store_bodies(bodies(spark, "a", "b", "c", ""), "body", root, "3")
    held = store.stored_bodies(spark, root).collect()
    assert sorted((r.body.decode(), r.batch) for r in held) == [("", "1"), ("a", "1"), ("b", "1"), ("c", "2"), ("ü" * 1000, "1")]
    assert all(r.content_size_bytes == len(r.body) and r.content_sha256.startswith(r.prefix) for r in held)
    wanted = bodies(spark, "c", "never", "").select(F.sha2("body", 256).alias("content_sha256"))
    assert sorted(r.body.decode() for r in store.read_bodies(spark, root, wanted).collect()) == ["", "c"]
    store.store_bodies(bodies(spark).filter("false"), "body", root, "4")
    assert store.stored_bodies(spark, root).count() == 5


def test_a_batch_reads_its_own_folders_only(spark, tmp_path):
    root = str(tmp_path / "store")
    store.store_bodies(spark.range(3000).select(F.col("id").cast("string").alias("body")), "body", root, "1")
    one = store.stored_bodies(spark, root).filter(F.col("prefix").isin(["00"])).select("content_sha256")
    plan = re.sub(r"#\d+", "", one._jdf.queryExecution().executedPlan().toString())
    assert one.count() > 0 and re.search(r"PartitionFilters: \[[^\]]*prefix = 00", plan) and "ReadSchema: struct<content_sha256:string>" in plan


def test_two_stores_of_the_same_body_read_as_one(spark, tmp_path):
    root = str(tmp_path / "store")
    store.store_bodies(bodies(spark, "a"), "body", root, "1")
    other = str(tmp_path / "other")
    store.store_bodies(bodies(spark, "a"), "body", other, "2")
    spark.read.parquet(f"{other}/bodies").write.mode("append").partitionBy("prefix").parquet(f"{root}/bodies")  # a writer at the same time
    wanted = bodies(spark, "a").select(F.sha2("body", 256).alias("content_sha256"))
    assert store.stored_bodies(spark, root).count() == 2 and store.read_bodies(spark, root, wanted).count() == 1


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    folder, done, lost = str(tmp_path / "p"), [], []

    def write(name):
        try:
            done.append((pointers.commit(spark, folder, {"by": name}, after=0), name))
        except pointers.Conflict:
            lost.append(name)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 1 and len(lost) == 7 and pointers.current(spark, folder) == (1, {"by": done[0][1]})
    threads = [threading.Thread(target=lambda i=i: done.append((pointers.commit(spark, folder, {"by": i}), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(n for n, _ in done) == list(range(1, 10)) and pointers.current(spark, folder)[0] == 9


def test_an_unfinished_pointer_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "p")
    assert pointers.current(spark, folder) is None
    assert pointers.commit(spark, folder, {"path": "a"}, after=0) == 1
    (tmp_path / "p" / "000000000002.json").write_text("")
    assert pointers.current(spark, folder) == (1, {"path": "a"})
    assert pointers.commit(spark, folder, {"path": "b"}, after=1) == 3
    with pytest.raises(pointers.Conflict):
        pointers.commit(spark, folder, {"path": "c"}, after=1)
    assert pointers.current(spark, folder) == (3, {"path": "b"})


def test_interleaved_snapshots(spark, tmp_path):
    root, schema = str(tmp_path), spark.range(1).schema
    assert snapshots.read_current(spark, root, schema).count() == 0 and snapshots.current_number(spark, root) == 0
    one = snapshots.write_versioned(spark.range(1), root, "1", [F.col("id")])
    two = snapshots.write_versioned(spark.range(2), root, "2", [F.col("id")])
    assert snapshots.publish_pointer(spark, root, one, after=0) == 1
    with pytest.raises(pointers.Conflict):
        snapshots.publish_pointer(spark, root, two, after=0)
    assert snapshots.read_current(spark, root, schema).count() == 1
    assert snapshots.publish_pointer(spark, root, two, after=1) == 2 and snapshots.read_current(spark, root, schema).count() == 2


def stored(spark, root, world):
    empty = {name: spark.createDataFrame([], TABLES[name]) for name in publish.PUBLISHED + publish.READ}
    return releases.commit(spark, root, empty | {name: world[name] for name in world if name in empty}, 0)


def test_publication_is_one_commit(spark, world, tmp_path):  # noqa: F811
    root = str(tmp_path)
    assert stored(spark, root, world) == 1
    before = releases.current(spark, root)
    assert publish.publish_release(spark, root, now()) == 2
    after, old = releases.read(spark, root), releases.read(spark, root, release=before[1])
    approved = lambda t: t["admission_rule_candidates"].filter("review_status = 'approved'").count()
    assert after["benefit_rules"].count() > old["benefit_rules"].count()
    assert after["admission_rule_reviews"].count() - old["admission_rule_reviews"].count() == approved(after) - approved(old) > 0
    assert publish.publish_release(spark, root, F.lit("2027-01-01").cast("timestamp")) == 2  # the same queue again
    assert old["benefit_rules"].count() == world["benefit_rules"].count() and old["admission_rule_candidates"].filter("review_status = 'pending'").count() > 0


def test_a_failed_publication_leaves_the_release(spark, world, tmp_path, monkeypatch):  # noqa: F811
    root = str(tmp_path)
    stored(spark, root, world)

    def fail(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(pointers, "commit", fail)
        with pytest.raises(OSError):
            publish.publish_release(spark, root, now())
    assert releases.current(spark, root)[0] == 1 and releases.read(spark, root)["benefit_rules"].count() == world["benefit_rules"].count()
    assert publish.publish_release(spark, root, now()) == 2


def test_a_publication_starts_anew_after_another(spark, world, tmp_path, monkeypatch):  # noqa: F811
    root = str(tmp_path)
    stored(spark, root, world)
    plain, calls = releases.commit, []

    def late(spark_, root_, tables, after):
        if not calls:
            calls.append(after)
            plain(spark_, root_, {"admission_rule_candidates": releases.read(spark_, root_)["admission_rule_candidates"].withColumn("review_status", F.lit("rejected"))}, after)
        return plain(spark_, root_, tables, after)

    monkeypatch.setattr(releases, "commit", late)
    assert publish.publish_release(spark, root, now()) == 2  # what was left to do was nothing
    done = releases.read(spark, root)
    assert done["benefit_rules"].count() == world["benefit_rules"].count() and done["admission_rule_candidates"].filter("review_status <> 'rejected'").count() == 0


def test_a_publication_that_changes_nothing_writes_nothing(spark, world, tmp_path):  # noqa: F811
    root = str(tmp_path)
    stored(spark, root, world)
    folders = lambda: sorted(str(p) for p in tmp_path.glob("*/version=*"))
    assert publish.publish_release(spark, root, now()) == 2
    done = folders()
    assert publish.publish_release(spark, root, now()) == 2 and folders() == done


def test_a_publication_writes_the_tables_that_change(spark, world, tmp_path):  # noqa: F811
    root = str(tmp_path)
    blocked = world["admission_rule_candidates"].filter("id IN (6, 8, 12)")  # no programme, no title, not waiting
    stored(spark, root, world | {"admission_rule_candidates": blocked})
    before = releases.current(spark, root)[1]
    assert publish.publish_release(spark, root, now()) == 2
    after = releases.current(spark, root)[1]
    assert [name for name in after if after[name] != before[name]] == ["admission_rule_candidates"]
    marks = {c.id: (c.automatic_status, c.automatic_note) for c in releases.read(spark, root)["admission_rule_candidates"].collect()}
    assert marks == {
        6: ("blocked", "programme_not_exactly_mapped_for_location"), 8: ("blocked", "rsosh_no_rsosh_title"), 12: ("pending_resolution", None)
    }


def test_checksums_are_kept_with_the_release(spark, tmp_path, monkeypatch):
    root, frame = str(tmp_path), table(spark, "subjects", dict(id=1, code="a", name="A"), dict(id=2, code="b"))
    empty = table(spark, "olympiads")
    assert releases.commit(spark, root, {"subjects": frame, "olympiads": empty}, 0) == 1
    with monkeypatch.context() as m:
        m.setattr(releases, "_digest", None)  # no version is read again
        assert releases.commit(spark, root, {"subjects": frame.repartition(3), "olympiads": empty}, 1) == 1
        assert releases.commit(spark, root, {"subjects": frame.filter("id = 1")}, 1) == 2
    # A manifest from before there were checksums: they are taken from the folder.
    pointers.commit(spark, f"{root}/_releases", {"tables": releases.current(spark, root)[1]}, 2)
    assert releases.commit(spark, root, {"subjects": frame.filter("id = 1"), "olympiads": empty}, 3) == 3
    assert releases.commit(spark, root, {"subjects": frame}, 3) == 4


SITES = "site long, campaign_id long, minimum_score int, max_attachments int, university_location_id long, source_id long, allow_hosts array<string>"


def test_found_documents_become_targets(spark):
    found = spark.createDataFrame([(1, f"u{i}", 50 + i) for i in range(5)] + [(2, "u4", 90), (2, "low", 10)], "site long, url string, score int").withColumns(
        {"document_kind": F.lit("pdf"), "signals": F.expr("map('bvi', 1, 'admission', 1)")}
    )
    sites = spark.createDataFrame([(1, 7, 38, 3, 70, 9, ["h"]), (2, 7, 38, 3, 71, 9, None)], SITES)
    base = table(
        spark, "admission_source_targets", dict(id=1, admission_campaign_id=7, url="u4", is_active=False, adapter_code="old", adapter_config="{}", poll_interval_hours=5),
        dict(id=2, admission_campaign_id=7, url="u3", is_active=True, adapter_code="old", adapter_config="{}"),
        dict(id=3, admission_campaign_id=7, url="gone", is_active=True, adapter_code="old", adapter_config='{"discovered_by": "official-source-discovery-v1"}'),
    )
    targets, judged = discovery.attach_targets(found, sites, base, now())
    rows = {r.url: r for r in targets.collect()}
    assert set(rows) == {"u2", "u3", "u4", "gone"} and targets.count() == 4
    assert (rows["u4"].id, rows["u4"].is_active, rows["u4"].university_location_id, rows["u4"].poll_interval_hours) == (1, True, 70, 5)
    assert rows["u3"].adapter_code == "old" and rows["u2"].adapter_code == vocab.GENERIC_ADAPTER and '"allow_hosts":["h"]' in rows["u2"].adapter_config
    status = {(r.site, r.url): (r.status, r.admission_source_target_id) for r in judged.collect()}
    assert status[1, "u4"] == ("attached", 1) and status[2, "u4"] == ("already_tracked", 1) and status[1, "u3"] == ("already_tracked", 2)
    assert status[1, "u2"] == ("attached", rows["u2"].id) and status[1, "u1"] == ("discovered", None) and status[2, "low"] == ("ignored", None)
    again, second = discovery.attach_targets(found, sites, targets, now())
    assert second.filter("status = 'attached'").count() == 0
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, targets.collect()), key=str)


def test_what_binds_nothing_says_why(spark):
    sources = spark.createDataFrame([(1, "s", "https://a.org/")], "id long, code string, base_url string")
    universities = spark.createDataFrame([(5, "u")], "id long, code string")
    locations = spark.createDataFrame([(50, 5, "l"), (51, 5, "twin"), (52, 5, "twin")], "id long, university_id long, code string")
    good, hosts = "catalogue-hse-2026-v1", '{"allow_hosts": ["b.org"]}'
    config = spark.createDataFrame(
        [
            ("s", "u", "l", "https://a.org/x", "html", good, hosts), ("s", "u", "l", "https://sub.b.org/y", "pdf", good, hosts),
            ("none", "u", "l", "https://a.org/1", "html", good, hosts), ("s", "v", "l", "https://a.org/2", "html", good, hosts),
            ("s", "u", "twin", "https://a.org/3", "html", good, hosts), ("s", "u", "l", "http://a.org/4", "doc", "other", "{}"),
            ("s", "u", "l", "https://c.org/5", "html", good, hosts), ("s", "u", "l", "https://a.org/6", "html", good, hosts),
            ("s", "u", "l", "https://a.org/6", "html", good, hosts), (None, None, None, None, None, None, None),
        ],
        "source_code string, university_code string, location_code string, url string, document_kind string, adapter_code string, adapter_config string",
    )
    targets, rejected = ingest.bind_targets(config, spark.createDataFrame([], TABLES["university_catalogue_targets"]), sources, universities, locations)
    assert sorted(r.url for r in targets.collect()) == ["https://a.org/x", "https://sub.b.org/y"]
    reasons = sorted((r.url or "", ",".join(r.reasons)) for r in rejected.collect())
    assert reasons == [
        ("", "unknown_source,unknown_location,unknown_adapter,unknown_document_kind,not_https,no_approved_host"),
        ("http://a.org/4", "unknown_adapter,unknown_document_kind,not_https,no_approved_host"), ("https://a.org/1", "unknown_source,foreign_host"),
        ("https://a.org/2", "unknown_location"), ("https://a.org/3", "several_locations"), ("https://a.org/6", "repeated_target"),
        ("https://a.org/6", "repeated_target"), ("https://c.org/5", "foreign_host"),
    ]
