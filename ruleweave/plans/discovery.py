"""Discover official documents: links, scores, bounded walk, best record per URL, attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.operators.merge import upsert
from ruleweave.operators.links import (
    attach, best_per_url, bounded_walk, page_links, scored, sitemap_links, top_candidates,
)
from ruleweave.plans.keys import surrogate
from ruleweave.session import cut_lineage

RECORD = ("site", "url", "document_kind", "title", "source_excerpt", "score", "signals", "arrival", "link_no")


def discover(
    sites: DataFrame, pages: DataFrame, sitemaps: DataFrame | None = None, *, campaign_year: int = 2026,
    max_pages: int = 24, max_depth: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(visited pages, candidates per site) over a table of fetched pages.

    ``sites`` (site, seed_url, base_url, hosts); ``pages`` (site, url, html) with html NULL for a page
    that could not be read; ``sitemaps`` (site, url, xml).
    """
    owned = pages.join(sites.select("site", "base_url", "hosts"), "site")
    links = page_links(owned, ["site"], "url", "html", "base_url", F.col("hosts"))
    judged = cut_lineage(scored(links, "url", "title", "anchor_text", campaign_year))
    walkable = (F.col("document_kind") == "html") & (F.col("score") >= vocab.MIN_WALK_SCORE)
    edges = judged.filter(walkable).select(
        "site", F.col("page_url").alias("src"), F.col("url").alias("dst"), F.col("link_no").alias("pos")
    )
    entries = documents = None
    if sitemaps is not None:
        own = sitemaps.join(sites.select("site", "base_url", "hosts"), "site")
        listed = sitemap_links(own, ["site"], "xml", "url", F.col("hosts"))
        marked = scored(
            listed.withColumns({"title": F.lit(None).cast("string"), "source_excerpt": F.lit(None).cast("string")}),
            "url", "title", "source_excerpt", campaign_year,
        )
        entries = marked.filter(walkable).select("site", "url", F.col("entry_no").alias("pos"))
        documents = marked.filter(F.col("document_kind").isin("pdf", "xlsx")).select(
            "site", "url", "document_kind", "title", "source_excerpt", "score", "signals",
            F.lit(0).cast("long").alias("arrival"), F.col("entry_no").alias("link_no"),
        )
    seeds = sites.select("site", F.col("seed_url").alias("url"))
    visited = bounded_walk(seeds, edges, max_pages, max_depth, entries)

    read = visited.join(pages.filter("html IS NOT NULL").select("site", "url"), ["site", "url"], "left_semi")
    labels = judged.groupBy("site", F.col("page_url").alias("url")).agg(F.first("page_label").alias("title"))
    own_records = scored(
        read.join(labels, ["site", "url"], "left").withColumns(
            {"document_kind": F.lit("html"), "source_excerpt": F.lit(None).cast("string"), "link_no": F.lit(0).cast("long")}
        ),
        "url", "title", "source_excerpt", campaign_year,
    ).select(*RECORD)
    linked = judged.join(
        read.select("site", F.col("url").alias("page_url"), "arrival"), ["site", "page_url"]
    ).withColumnRenamed("anchor_text", "source_excerpt").select(*RECORD)
    found = own_records.unionByName(linked)
    if documents is not None:
        found = found.unionByName(documents.select(*RECORD))
    best = best_per_url(found, ["site"], ["arrival", "link_no"])
    return visited, top_candidates(best, ["site"]).drop("arrival", "link_no")


def persist(candidates: DataFrame, sites: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with the status they get under their campaign's cap.

    ``sites`` adds campaign_id, minimum_score and max_attachments to each site; ``targets`` has
    campaign_id, url, is_active, discovered_by.
    """
    owned = candidates.join(sites.select("site", "campaign_id", "minimum_score", "max_attachments"), "site")
    return attach(owned, targets, "campaign_id", "max_attachments", "minimum_score", ["site"])


def tracked(targets: DataFrame) -> DataFrame:
    """Stored targets as ``persist`` looks at them."""
    discovered_by = F.get_json_object("adapter_config", "$.discovered_by").alias("discovered_by")
    return targets.select(F.col("admission_campaign_id").alias("campaign_id"), "url", "is_active", discovered_by)


def attach_targets(
    candidates: DataFrame, sites: DataFrame, targets: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """(new version of admission_source_targets, candidates with their status and target).

    Candidates that get a place under their campaign's cap become targets: a URL without one is
    inserted, an inactive one is reactivated as a target of the site that found it, and an active one
    stays as it is, whoever made it. ``sites`` adds university_location_id, source_id and allow_hosts
    to what ``persist`` needs. The same candidates again find their targets active and attach nothing.
    """
    keys = ["admission_campaign_id", "url"]
    judged = persist(candidates, sites, tracked(targets)).withColumnRenamed("campaign_id", "admission_campaign_id")
    judged = cut_lineage(judged.withColumn("id", surrogate("site", "url")))
    owners = sites.select("site", "university_location_id", "source_id", "allow_hosts")
    config = F.struct(
        F.coalesce("allow_hosts", F.array().cast("array<string>")).alias("allow_hosts"),
        F.lit(vocab.DISCOVERY_CODE).alias("discovered_by"), F.col("id").alias("discovery_candidate_id"),
    )
    changes = judged.filter("status = 'attached'").join(owners, "site").select(
        surrogate(*keys).alias("id"), *keys, "university_location_id", "source_id", F.lit(vocab.DISCOVERED_ROLE).alias("source_role"),
        "document_kind", F.lit(vocab.GENERIC_ADAPTER).alias("adapter_code"), F.to_json(config).alias("adapter_config"),
        F.lit(vocab.POLL_HOURS).alias("poll_interval_hours"), as_of.alias("next_check_at"), F.lit(True).alias("is_active"),
    )
    merged = upsert(
        targets, changes, keys,
        update=["university_location_id", "source_id", "source_role", "document_kind", "adapter_code", "adapter_config", "next_check_at", "is_active"],
        guard="NOT is_active",
    )
    places = merged.filter("is_active").select(*keys, F.col("id").alias("_target"))
    found = judged.join(places, keys, "left")
    known = F.col("status").isin("attached", "already_tracked")
    return merged, found.withColumn("admission_source_target_id", F.when(known, F.col("_target"))).drop("_target")
