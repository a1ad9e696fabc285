"""Work that must spread over all cores, and stay out of the driver, however few bytes hold its rows."""

import html
from unittest import mock

from pyspark.sql import functions as F

from ruleweave.functions.text import unescape
from ruleweave.operators import links, resolve
from ruleweave.operators.ordered import top_per_key
from ruleweave.plans import publish
from ruleweave.plans.queries import QUERIES, resolution
from ruleweave.plans.queries.base import Source

FOLDER = "/root/testdata/sf0.001"


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_joins_as_long_as_the_documents_are_not_broadcast(spark):
    for name in ("shared_body_rules", "adapter_dispatch"):
        assert "Broadcast" not in physical(QUERIES[name](spark, FOLDER)), name


def test_small_files_are_dealt_over_all_cores(spark):
    source = Source(spark, FOLDER)
    dealt = source.dealt("part", "p_partkey")
    assert dealt.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(source.part.select("p_partkey").collect())
    for name in ("sitemap_links", "candidate_extract"):
        assert "RoundRobinPartitioning" in physical(QUERIES[name](spark, FOLDER)), name


def test_documents_are_read_above_the_deal(spark):
    for name in ("grid_rules", "programme_first_rules", "catalogue_rows", "adapter_dispatch", "expand_rules", "scope_row_rules"):
        scans = physical(QUERIES[name](spark, FOLDER)).split("RoundRobinPartitioning")[1:]
        assert scans, name
        for scan in scans:
            below = scan.split("FileScan")[0]
            assert "Filter" not in below and "Generate" not in below, name


def test_references_are_decoded_once(spark):
    values = ["&amp;amp x &amp y", "&#38;amp; &amp; z", "&ampcopy; &copy;", "x&amp;copy;&copy;", "&notx &#x41;&#65", "&", ""]
    rows = spark.createDataFrame([(value,) for value in values], "value string").select("value", unescape("value").alias("plain")).collect()
    assert [row.plain for row in rows] == [html.unescape(row.value) for row in rows]


def test_the_walk_expands_no_page_behind_one_that_fills_the_cap(spark):
    cap, hubs = 8, 5
    seeds = spark.range(2).select(F.col("id").alias("site"), F.lit("s").alias("url"))
    links_of = {f"h{i}": ["s", f"t{i}"] if i == 0 else [f"t{i}-{k}" for k in range(cap)] for i in range(hubs)}
    rows = [("s", f"h{i}", i) for i in range(hubs)] + [(src, dst, k) for src, found in links_of.items() for k, dst in enumerate(found)]
    edges, queued = spark.createDataFrame(rows, "src string, dst string, pos int"), []

    def watched(frame, *rest, **named):
        queued.append(frame)
        return top_per_key(frame, *rest, **named)

    with mock.patch.object(links, "top_per_key", watched):
        walk = links.bounded_walk(seeds, edges, max_pages=cap, max_depth=2).collect()
    want = ["s", *[f"h{i}" for i in range(hubs)], "t0", "t1-0"]
    assert sorted((r.site, r.arrival, r.url) for r in walk) == [(site, n + 1, url) for site in range(2) for n, url in enumerate(want)]
    assert {r.url for r in queued[-1].collect()} == {"t0", *links_of["h1"]}  # nothing of h2 and later


def test_a_filter_lets_hardly_any_foreign_hash_through(spark, monkeypatch):
    own = spark.range(200).select(F.xxhash64("id").alias("h"))
    foreign = spark.range(1_000, 101_000).select(F.xxhash64("id").alias("h"))
    may_be = resolve.bit_filter(own.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS h")), "h")
    assert own.filter(may_be(F.col("h"))).count() == 200
    assert foreign.filter(may_be(F.col("h"))).count() < 100
    monkeypatch.setattr(resolve, "BITS", 1 << 12)  # as full as a filter of BITS bits by 100,000 hashes
    tight = resolve.bit_filter(own, "h")
    assert own.filter(tight(F.col("h"))).count() == 200 and foreign.filter(tight(F.col("h"))).count() < 1_000
    none = resolve.bit_filter(own.filter("false"), "h")
    assert foreign.filter(none(F.col("h"))).count() == 0


def test_rows_of_keys_keep_repeated_rows_and_leave_out_null_keys(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (2, 1, "d")], "scope int, id long, text string")
    some = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (3, 1)], "scope int, id long")
    found = resolve.rows_of(rows, ["scope", "id"], some)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a"), (1, 1, "a")]
    assert resolve.rows_of(rows, ["scope", "id"], some.filter("false")).count() == 0


def test_only_texts_with_a_hit_are_dealt_out_for_their_letters(spark):
    profiles = spark.createDataFrame([(1, "alpha beta gamma", "omega"), (2, "alpha beta gamma", "other")], "profile_id long, title string, profile_title string")
    profiles = profiles.withColumn("level", F.lit(1))
    text = F.when(F.col("id") % 100 == 0, "alpha beta gamma omega other").otherwise("omega other alpha beta")
    docs, dealt = spark.range(1_000).select("id", text.alias("text")), []

    def spread(frame):
        dealt.append(frame.count())
        return frame

    found = resolve.catalogue_match(docs, "id", "text", profiles, prefixes=(), generic=(), spread=spread)
    unclear = {row.id for row in found.filter("match_status = 'ambiguous'").collect()}
    assert unclear == set(range(0, 1_000, 100)) and dealt == [1_000, 10]


def test_match_alternatives_deals_the_documents_out_once(spark):
    dealt = []

    def watched(frame):
        dealt.append(frame.count())
        return frame

    with mock.patch.object(resolution, "deal", watched):
        QUERIES["match_alternatives"](spark, FOLDER).count()
    assert dealt[0] == 200 and dealt[1:] and max(dealt[1:]) < 100


def test_matching_reads_identities_that_are_cut_off_from_the_catalogue(spark):
    with mock.patch.object(publish, "catalogue_match", side_effect=InterruptedError) as matching:
        try:
            resolution._judged(Source(spark, FOLDER))
        except InterruptedError:
            pass
    assert "Join" not in physical(matching.call_args.args[0])


def test_stored_tables_are_made_of_lines_read_once(spark):
    with mock.patch.object(resolution.releases, "commit", side_effect=InterruptedError) as commit:
        try:
            resolution._published(Source(spark, FOLDER))
        except InterruptedError:
            pass
    for name, frame in commit.call_args.args[2].items():
        assert "lineitem" not in physical(frame), name


def test_programmes_are_joined_once_by_a_resolution(spark):
    rows = [(1, 0, "04.03.01", "Химия", "code_only")]
    programmes = spark.createDataFrame(rows, "programme_id long, loc long, external_code string, name string, catalogue_status string")
    selectors = spark.range(1).select(F.col("id").alias("loc"), F.lit("04.03.01").alias("selector"))
    found = resolve.unique_programme(selectors, "selector", programmes, ["loc"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [row.programme_id for row in found.collect()] == [1]
