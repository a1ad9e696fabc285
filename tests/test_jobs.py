"""Whole jobs on small catalogues: publication, ingest, discovery, snapshots, streaming."""
import json

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import contracts as ct
from ruleweave.operators.documents import html_blocks, html_text
from ruleweave.plans import catalog, discovery, ingest, publish
from ruleweave.schemas import COMPETITION_RECORD, LOCATION_RECORD, TABLES
from ruleweave.sources import snapshots, store
from ruleweave.streaming import refresh
from slow_reader import read_blocks

HSE, MSU = "strict-hse-2026-v1", "strict-msu-2026-v2"
NOW = "2026-03-01 00:00:00"


def table(spark, name, *rows):
    schema = TABLES[name]
    full = [tuple(row.get(field.name) for field in schema) for row in rows]
    return spark.createDataFrame(full, schema)


def now():
    return F.lit(NOW).cast("timestamp")


def candidate(key, **changes):
    row = dict(
        id=key, admission_parse_run_id=1, source_document_id=5, admission_campaign_id=1, candidate_key=f"k{key}", source_locator=f"line:{key}",
        source_excerpt="row", payload_kind="strict_table_row", raw_payload="{}", raw_programme_name="Химия", raw_olympiad_name="Турнир «Большая колба»",
        raw_profile_name="химия", suggested_diploma_status="winner", suggested_benefit_kind="bvi", match_status="unresolved",
        review_status="pending", automatic_status="pending_resolution", confidence=100,
    )
    return row | changes


@pytest.fixture(scope="module")
def world(spark):
    rows = {
        "sources": [dict(id=1, code="rsosh", is_active=True)],
        "subjects": [dict(id=1, code="math", name="Математика"), dict(id=2, code="chemistry", name="Химия")],
        "olympiads": [dict(id=1, title="Олимпиада школьников «Большая колба»", audience="school", kind="o", is_active=True)],
        "olympiad_profiles": [
            dict(id=11, olympiad_id=1, source_id=1, campaign_year=2025, profile_title="химия", level=1, approval_status="approved", is_active=True),
            dict(id=12, olympiad_id=1, source_id=1, campaign_year=2025, profile_title="биология", level=2, approval_status="approved", is_active=True),
            dict(id=13, olympiad_id=1, source_id=1, campaign_year=2024, profile_title="химия", level=1, approval_status="approved", is_active=True),
        ],
        "universities": [dict(id=1, code="u", name="U", is_active=True)],
        "university_locations": [dict(id=4, university_id=1, code="u-main", name="Main", location_type="main", admission_status="benefits_verified", official_url="https://u", is_active=True)],
        "admission_campaigns": [dict(id=1, university_id=1, campaign_year=2026)],
        "admission_source_targets": [dict(id=1, university_location_id=4, adapter_config="{}"), dict(id=2, university_location_id=4, adapter_config='{"rsosh_catalogue_year": 2024}')],
        "admission_parse_runs": [dict(id=1, admission_source_target_id=1, adapter_code=HSE), dict(id=2, admission_source_target_id=1, adapter_code=MSU), dict(id=3, admission_source_target_id=2, adapter_code=HSE), dict(id=4, admission_source_target_id=1, adapter_code=vocab_generic())],
        "source_documents": [dict(id=5, url="https://u/rules.pdf")],
        "university_programs": [
            dict(id=100, university_id=1, university_location_id=4, external_code="04.03.01", name="Химия", catalogue_status="named_verified", degree_level="bachelor", is_active=True),
        ],
        "benefit_rules": [
            dict(id=900, admission_campaign_id=1, university_program_id=100, olympiad_profile_id=12, diploma_status="winner", benefit_kind="bvi", source_url="manual", is_verified=True, verification_status="verified", publication_method="manual", is_active=True),
            dict(id=901, admission_campaign_id=1, university_program_id=100, olympiad_profile_id=11, diploma_status="prize_winner", benefit_kind="bvi", source_url="old", is_verified=False, verification_status="rejected", publication_method="strict_adapter", is_active=False),
        ],
        "admission_rule_candidates": [
            candidate(1, suggested_confirmation_subject_id=2, suggested_confirmation_min_score=75),
            candidate(2, raw_profile_name="биология", source_locator="auto"),
            candidate(3, suggested_diploma_status="prize_winner"),
            candidate(4, raw_programme_name="15.05.01"), candidate(5, raw_programme_name="15.05.01", suggested_diploma_status="prize_winner"),
            candidate(6, raw_programme_name="Неизвестная"), candidate(7, admission_parse_run_id=2, payload_kind="msu_programme_table_row", raw_programme_name="Новая программа"),
            candidate(8, raw_olympiad_name="Другая"), candidate(9, suggested_olympiad_level=3), candidate(10, admission_parse_run_id=4, payload_kind="table_row"),
            candidate(11, admission_parse_run_id=3, raw_profile_name="биология"), candidate(12, review_status="approved"),
            candidate(13, automatic_status="blocked", source_locator="later"),
        ],
        "admission_rule_reviews": [], "benefit_rule_observations": [], "admission_policies": [], "olympiad_profile_subjects": [dict(olympiad_profile_id=11, subject_id=2)],
        "tracked_olympiads": [],
    }
    return {name: table(spark, name, *given) for name, given in rows.items()}


def vocab_generic():
    from ruleweave import vocab

    return vocab.GENERIC_ADAPTER


def test_publication_keeps_every_outcome(spark, world):
    result = publish.publish(world, now())
    reasons = {r.candidate_id: r.reason for r in result["outcomes"].collect()}
    assert reasons == {
        1: None, 2: None, 3: None, 4: None, 5: None, 6: "programme_not_exactly_mapped_for_location", 7: None, 8: "rsosh_no_rsosh_title",
        9: "rsosh_level_mismatch", 10: "generic_source_without_explicit_table_proof", 11: "rsosh_title_without_profile", 13: None,
    }
    rules = {(r.university_program_id, r.olympiad_profile_id, r.diploma_status): r for r in result["benefit_rules"].collect()}
    created = {r.name: r for r in result["university_programs"].collect() if r.id != 100}
    assert set(created) == {"Направление 15.05.01", "Новая программа"}
    assert created["Направление 15.05.01"].degree_level == "specialist" and created["Направление 15.05.01"].catalogue_status == "code_only"
    # Equal selectors resolve to the one scope that was created; two rules hang on it.
    assert len([k for k in rules if k[0] == created["Направление 15.05.01"].id]) == 2
    fresh = rules[100, 11, "winner"]
    assert (fresh.confirmation_subject_id, fresh.verification_status, fresh.verified_by) == (None, "verified", f"strict-adapter:{HSE}")
    # The last writer in queue order states the rule: blocked candidates come after new ones.
    assert fresh.source_locator == "later"
    assert (rules[100, 12, "winner"].source_url, rules[100, 12, "winner"].publication_method) == ("manual", "manual")
    rejected = rules[100, 11, "prize_winner"]
    assert (rejected.id, rejected.verification_status, rejected.is_active, rejected.source_url) == (901, "rejected", True, "https://u/rules.pdf")
    marked = {c.id: c for c in result["admission_rule_candidates"].collect()}
    assert (marked[2].published_benefit_rule_id, marked[2].review_status, marked[2].automatic_status) == (900, "approved", "published")
    assert (marked[6].automatic_status, marked[6].review_status) == ("blocked", "pending")
    assert marked[12].automatic_status == "pending_resolution"
    assert result["admission_rule_reviews"].count() == 7
    observed = {o.benefit_rule_id: o.admission_rule_candidate_id for o in result["benefit_rule_observations"].collect()}
    assert observed[fresh.id] == 13 and len(observed) == 6
    counts = {(r.outcome, r.reason): r.n for r in publish.summary(result["outcomes"]).collect()}
    assert counts["published", ""] == 7
    again = publish.publish({**world, **{k: v for k, v in result.items() if k in world}}, now())
    assert again["benefit_rules"].count() == len(rules) and again["university_programs"].count() == 3


def test_matcher_only_links(spark, world):
    identities = spark.createDataFrame([(1, "Большая колба | химия"), (2, "Большая колба"), (3, None)], "id long, identity string")
    rows = {r.id: r for r in publish.match_pending(world, identities, 2025).collect()}
    assert (rows[1].match_status, rows[1].olympiad_profile_id, rows[1].confidence) == ("resolved", 11, 100)
    assert json.loads(rows[1].raw_payload) == {
        "rsosh_match": {"status": "resolved", "reason": "title_and_profile", "profile_id": 11, "alternatives": [], "alternative_titles": []}
    }
    assert rows[2].match_status == "ambiguous" and rows[3].match_status == "unresolved"
    assert json.loads(rows[2].raw_payload)["rsosh_match"]["profile_id"] is None
    assert json.loads(rows[2].raw_payload)["rsosh_match"]["alternatives"] == [11, 12]


def test_matcher_replaces_its_own_key(spark, world):
    old = world["admission_rule_candidates"].withColumn(
        "raw_payload", F.when(F.col("id") == 1, '{"kind": "row", "rsosh_match": {"status": "old"}, "cells": [1, "a", null]}').otherwise("{ }")
    )
    identities = spark.createDataFrame([(1, "Большая колба | химия"), (2, "Большая колба")], "id long, identity string")
    rows = {r.id: json.loads(r.raw_payload) for r in publish.match_pending({**world, "admission_rule_candidates": old}, identities, 2025).collect()}
    assert rows[1].pop("rsosh_match")["status"] == "resolved" and rows[1] == {"kind": "row", "cells": [1, "a", None]}
    assert list(rows[2]) == ["rsosh_match"] and rows[3] == {}


def test_public_snapshot_is_versioned_and_all_or_nothing(spark, world, tmp_path):
    rules = publish.publish(world, now())["benefit_rules"]
    public = catalog.public_rules({**world, "benefit_rules": rules, "university_programs": publish.publish(world, now())["university_programs"]}, 2026)
    assert set(public.columns) == set(catalog.PUBLIC_RULE)
    checked = ct.enforce(public.filter("checked_at IS NOT NULL"), ct.public_rule_contract(), ["programme_name"])
    order = [F.col(c) for c in catalog.PUBLIC_RULE_ORDER]
    path = snapshots.write_versioned(checked, str(tmp_path), "1", order)
    snapshots.publish_pointer(spark, str(tmp_path), path)
    back = snapshots.read_current(spark, str(tmp_path), checked.schema)
    assert back.count() == checked.count() > 0
    for change in (
        {"university_location_code": F.lit(" ")}, {"point_value": F.lit(5).cast("short")}, {"olympiad_level": F.lit(4)}, {"diploma_status": F.lit("x")},
        {"olympiad_level": F.lit(None).cast("short")},
    ):
        with pytest.raises(ct.ContractViolation):
            ct.enforce(checked.withColumns(change), ct.public_rule_contract(), ["programme_name"])
    points = checked.withColumns({"benefit_kind": F.lit("individual_points"), "point_value": F.lit(6).cast("short")})
    assert ct.enforce(points, ct.public_rule_contract(), ["programme_name"]).count() > 0
    programmes = catalog.programmes(world, 2026).withColumns({"catalogue_status": F.lit("code_only"), "source_url": F.lit("x"), "checked_at": F.lit("y")})
    assert ct.violations(programmes, ct.public_programme_contract(), ["programme_name"]).count() == 0
    short = programmes.withColumn("external_code", F.lit("04.03"))
    assert [v.violation for v in ct.violations(short, ct.public_programme_contract(), ["programme_name"]).collect()] == ["incomplete_code"]


def test_competitions_are_loaded_twice_without_change(spark, world):
    def record(seq, title, profile, subjects, level="1", source="РСОШ · Перечень 2025/26"):
        return dict(id=str(seq), title=title, audience="school", subject=subjects[0], subjects=subjects, profile=profile, level=level, source=source, source_url="https://x", kind="k")

    given = [
        record(1, "Новая  Олимпиада", "физика", ["Физика", "Математика"]), record(2, "НОВАЯ олимпиада", "", ["Нет такого"], "—"),
        record(3, "Новая Олимпиада", "физика", ["Химия"], "2"),
    ]
    rows = [tuple(r.get(f.name) for f in COMPETITION_RECORD) for r in given]
    records = spark.createDataFrame(rows, COMPETITION_RECORD).withColumn("seq", F.col("id").cast("int"))
    empty = {n: table(spark, n) for n in ("olympiads", "olympiad_profiles", "olympiad_profile_subjects")}
    t = {**empty, "sources": world["sources"], "subjects": world["subjects"]}
    once = ingest.load_competitions(t, records, now())
    twice = ingest.load_competitions({**t, **once}, records, now())
    for result in (once, twice):
        assert [r.title for r in result["olympiads"].collect()] == ["Новая Олимпиада"]
        profiles = {r.profile_title: r for r in result["olympiad_profiles"].collect()}
        assert set(profiles) == {"физика", "Общий зачёт"} and profiles["физика"].level == 2 and profiles["Общий зачёт"].level is None
        assert profiles["физика"].campaign_year == 2025
        assert [(r.olympiad_profile_id, r.subject_id) for r in result["olympiad_profile_subjects"].collect()] == [(profiles["физика"].id, 2)]


def test_locations_are_refused_as_a_whole(spark, world):
    good = dict(id="x", university_code="u", name="U", campus_name="Филиал", campus_type="branch", official_url="https://o", location_source_url="https://d", admission_status="rules_discovered")
    make = lambda *rows: spark.createDataFrame([tuple(r.get(f.name) for f in LOCATION_RECORD) for r in rows], LOCATION_RECORD)
    loaded = {r.code: r for r in ingest.load_locations(world, make(good), now()).collect()}
    assert set(loaded) == {"u-main", "x"} and loaded["x"].country == "Россия" and loaded["x"].admission_rules_url == "https://o"
    for bad in ([good, good], [good | {"university_code": "none", "id": "y"}], [good | {"campus_type": "moon"}], [good | {"name": " "}]):
        with pytest.raises(ct.ContractViolation):
            ingest.load_locations(world, make(*bad), now())


PAGE = """<html><head><title>Приёмная комиссия</title><script>var a = "<a href='/no'>no</a>";</script></head><body>
<nav>Олимпиады РСОШ БВИ</nav><h1>Контакты</h1>
<a href="/rules?utm_source=m">Правила приема: олимпиады</a><a href='/files/list-2026.pdf'>Приложение &amp; БВИ</a>
<a href="https://foreign.org/x">Правила приема</a><a href="/contacts">Контакты</a></body></html>"""


def test_discovery_walks_scores_and_attaches(spark):
    seed = "https://adm.example.edu/"
    sites = spark.createDataFrame([(1, seed, seed, ["example.edu"], 7, 38, 1)], "site long, seed_url string, base_url string, hosts array<string>, campaign_id long, minimum_score int, max_attachments int")
    pages = spark.createDataFrame(
        [(1, seed, PAGE), (1, seed + "rules", '<title>Правила приёма</title><a href="deep">приём олимпиад</a>'), (1, seed + "deep", '<a href="/far">поступление</a>'), (1, seed + "far", None)],
        "site long, url string, html string",
    )
    maps = spark.createDataFrame([(1, seed + "sitemap.xml", f"<loc>{seed}map/прием</loc><loc> {seed}m.pdf </loc><loc>https://foreign.org/прием</loc>")], "site long, url string, xml string")
    visited, found = discovery.discover(sites, pages, maps, max_depth=2)
    order = [r.url.removeprefix(seed) for r in visited.orderBy("arrival").collect()]
    # The page title makes every link of the page an admission link, the unreadable one included.
    assert order == ["", "map/прием", "rules", "contacts", "deep"]
    rows = {r.url.removeprefix(seed): r for r in found.collect()}
    assert not any("foreign" in url for url in rows)
    pdf = rows["files/list-2026.pdf"]
    assert (pdf.document_kind, pdf.score) == ("pdf", 22 + 6 + 8 + 12 + 8) and pdf.signals["document"] == 1
    assert rows[""].title == "Приёмная комиссия Контакты" and rows[""].score == 8
    assert rows["m.pdf"].score == 8 and rows["far"].score == 8
    targets = spark.createDataFrame([(7, seed + "rules", True, None)], "campaign_id long, url string, is_active boolean, discovered_by string")
    status = {r.url.removeprefix(seed): r.status for r in discovery.persist(found, sites, targets).collect()}
    assert status["files/list-2026.pdf"] == "attached" and status["rules"] == "already_tracked" and status["m.pdf"] == "ignored"
    full = targets.unionByName(spark.createDataFrame([(7, "x", True, "official-source-discovery-v1")], targets.schema))
    status = {r.url.removeprefix(seed): r.status for r in discovery.persist(found, sites, full).collect()}
    assert status["files/list-2026.pdf"] == "discovered"


def test_one_site_attaches_a_shared_url(spark):
    from ruleweave.operators.links import attach

    rows = [(7, 1, "a", 50), (7, 2, "a", 60), (7, 2, "b", 90), (7, 1, "c", 40), (8, 3, "a", 50)]
    found = spark.createDataFrame(rows, "campaign_id long, site long, url string, score int").withColumns(
        {"document_kind": F.lit("html"), "signals": F.expr("map('bvi', 1, 'admission', 1)"), "cap": F.lit(2), "low": F.lit(38)}
    )
    targets = spark.createDataFrame([], "campaign_id long, url string, is_active boolean, discovered_by string")
    got = {(r.campaign_id, r.site, r.url): r.status for r in attach(found, targets, "campaign_id", "cap", "low", ["site"]).collect()}
    assert got == {
        (7, 1, "a"): "attached", (7, 1, "c"): "attached", (7, 2, "a"): "already_tracked", (7, 2, "b"): "discovered", (8, 3, "a"): "attached",
    }


def test_walk_respects_cap_and_order(spark):
    from ruleweave.operators.links import bounded_walk

    edges = spark.createDataFrame([("s", f"p{i}", i) for i in range(9)] + [("p1", "q", 1), ("p0", "p5", 1), ("p0", "r", 2)], "src string, dst string, pos long")
    seeds = spark.createDataFrame([(1, "s")], "site long, url string")
    walk = lambda **kw: [r.url for r in bounded_walk(seeds, edges, **kw).orderBy("arrival").collect()]
    assert walk(max_pages=4) == ["s", "p0", "p1", "p2"]
    assert walk(max_pages=60) == ["s", *[f"p{i}" for i in range(9)], "r", "q"]
    assert walk(max_pages=60, max_depth=0) == ["s"]


def test_block_reader_handles_tag_soup(spark):
    page = (
        "<p>до</p><body><h2>Права <b>олимп</b>иад</h2><p>раз<p>два &amp; три</p></p><ul><li>пункт<script>x</script></ul>"
        "<table><tr><th>Т</th><th>Л</th></tr><tr><td><p>a</p></td><td> </td></tr><tr><td> </td></tr></table><svg><p>нет</p></svg><br><p>конец"
    )
    assert [line for _, _, line in read_blocks(page)] == [
        "## Права олимп иад", "раз два & три", "два & три", "- пункт", "| Т | Л |", "| --- | --- |", "| a | |".replace("| |", "|  |"), "конец",
    ]
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert html_blocks(df, "id", "html").filter("id = 1").count() == 8
    assert {r[0]: r[1] for r in df.select("id", F.length(html_text("html"))).collect()}[2] == 0


def test_files_are_stored_once_per_hash(spark, tmp_path):
    for name, body in (("a.html", "x"), ("b.html", "x"), ("c.txt", "y")):
        (tmp_path / name).write_text(body)
    files = store.read_files(spark, str(tmp_path), "*.html").withColumn("source", F.lit("s"))
    kept = store.address(files.drop("content_sha256", "content_size_bytes"), "body", "source", ["url"]).collect()
    assert len(kept) == 1 and kept[0].url.endswith("a.html") and kept[0].content_size_bytes == 1


def test_stream_processes_changed_documents_once(spark, tmp_path):
    text = "| Образовательная программа | Олимпиада | Профиль олимпиады | Льгота | Диплом |\n| --- | --- | --- | --- | --- |\n| Химия | Колба | химия | БВИ | Победитель |"
    feed, runs, out = (str(tmp_path / n) for n in ("feed", "runs", "out"))

    def deliver(*rows):
        spark.createDataFrame(rows, "target_id long, adapter_code string, adapter_version string, fetched_at string, content string").withColumn(
            "fetched_at", F.col("fetched_at").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(feed)

    def run(checkpoint):
        query = refresh.start_refresh(refresh.fetched_stream(spark, feed), runs, out, str(tmp_path / checkpoint))
        query.awaitTermination(120)
        assert query.exception() is None

    deliver((1, HSE, "v1", "2026-01-01", text), (1, HSE, "v1", "2026-01-02", text), (2, "requests-bs4-keyword-v1", "v1", "2026-01-01", "Победителям олимпиад этот вуз даёт БВИ"))
    run("c1")
    got = spark.read.parquet(out)
    assert {(r.target_id, r.confidence, r.automatic_status) for r in got.collect()} == {(1, 100, "pending_resolution"), (2, 52, "not_applicable")}
    deliver((1, HSE, "v1", "2026-03-01", text), (1, HSE, "v2", "2026-03-01", text))
    run("c1")
    assert spark.read.parquet(runs).count() == 3
    assert spark.read.parquet(out).filter("target_id = 1").count() == 2


def test_stream_takes_late_documents_and_any_adapter(spark, tmp_path):
    line = "Победителям олимпиад этот вуз даёт БВИ"
    feed, runs, out = (str(tmp_path / n) for n in ("feed", "runs", "out"))

    def deliver(*rows):
        schema = "target_id long, adapter_code string, adapter_version string, fetched_at string, content string"
        frame = spark.createDataFrame(rows, schema).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(feed)
        query = refresh.start_refresh(refresh.fetched_stream(spark, feed), runs, out, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None

    deliver((1, "other", "v1", "2026-01-10", line))
    deliver((2, "other", "v1", "2026-01-05", line), (3, None, "v1", "2026-01-11", line), (3, None, "v1", "2026-01-11", line))
    assert sorted(r.target_id for r in spark.read.parquet(runs).collect()) == [1, 2, 3]
    assert sorted(r.target_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_a_shared_body_gives_rules_to_its_own_adapter_only(spark):
    text = "| Образовательная программа | Олимпиада | Профиль олимпиады | Льгота | Диплом |\n| --- | --- | --- | --- | --- |\n| Химия | Колба | химия | БВИ | Победитель |"
    rows = [(1, HSE, "v1", text), (2, "strict-mephi-2026-v1", "v1", text), (3, HSE, "v2", text)]
    batch = spark.createDataFrame(rows, "target_id long, adapter_code string, adapter_version string, content string").withColumn("sha256", F.sha2("content", 256))
    found = refresh.extract(batch).collect()
    assert sorted((r.target_id, r.adapter_code, r.adapter_version) for r in found) == [(1, HSE, "v1"), (3, HSE, "v2")]
