"""Links, signal scores and the bounded site walk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.functions.text import col, compact, contains_any, fold, strip_tags, unescape
from ruleweave.functions.urls import allowed_host, canonical_url, document_kind, linked_kind
from ruleweave.operators.ordered import top_per_key
from ruleweave.operators.stages import settle
from ruleweave.session import cut_lineage

#: An anchor ends at its end tag, at the next anchor, or with the markup if it is cut off.
ANCHOR = r"(?is)<a\b[^>]*?\shref\s*=[^>]*>.*?(?:</a\s*>|(?=<a\b)|\z)"
HREF = r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def visible_markup(html: Column | str) -> Column:
    """Markup without comments and without elements that hold no text."""
    body = F.regexp_replace(col(html), r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "noscript", "svg", "template"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)", "")
    return body


def inner_text(markup: Column, tag: str) -> Column:
    return compact(strip_tags(F.regexp_extract(markup, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)))


def haystack(url: Column | str, title: Column | str, excerpt: Column | str) -> Column:
    words = F.translate(col(url), "/-", "  ")
    return fold(F.concat_ws(" ", words, F.coalesce(col(title), F.lit("")), F.coalesce(col(excerpt), F.lit(""))))


def signal_columns(
    folded: Column | str,
    kind: Column | str,
    campaign_year: Column | int,
    signals: Sequence[tuple[str, tuple[str, ...], int]] = vocab.SIGNALS,
) -> tuple[Column, Column]:
    """(score, signals map): each signal weighs once however often its phrases occur, 100 at most."""
    text = col(folded)
    year = F.contains(text, col(campaign_year).cast("string") if not isinstance(campaign_year, int) else F.lit(str(campaign_year)))
    document = col(kind).isin("pdf", "xlsx")
    score = F.when(year, vocab.YEAR_WEIGHT).otherwise(0) + F.when(document, vocab.DOCUMENT_WEIGHT).otherwise(0)
    entries = []
    for name, phrases, weight in signals:
        hits = F.lit(0)
        for phrase in phrases:
            hits = hits + F.contains(text, F.lit(phrase)).cast("int")
        score = score + F.when(contains_any(text, phrases), weight).otherwise(0)
        entries.append(F.struct(F.lit(name).alias("key"), hits.alias("value")))
    entries.append(F.struct(F.lit("campaign_year").alias("key"), year.cast("int").alias("value")))
    entries.append(F.struct(F.lit("document").alias("key"), document.cast("int").alias("value")))
    present = F.map_from_entries(F.filter(F.array(*entries), lambda entry: entry["value"] > 0))
    return F.least(score, F.lit(100)), present


def scored(
    df: DataFrame, url: str, title: str, excerpt: str, campaign_year: Column | int,
    signals: Sequence[tuple[str, tuple[str, ...], int]] = vocab.SIGNALS,
) -> DataFrame:
    folded = df.withColumn("_hay", haystack(url, title, excerpt)).withColumn("_kind", document_kind(url))
    score, present = signal_columns("_hay", "_kind", campaign_year, signals)
    return folded.withColumns({"score": score, "signals": present}).drop("_hay", "_kind")


def is_attachable(
    kind: Column, score: Column, signals: Column, minimum: Column | int = 38,
    hard: Sequence[str] = vocab.HARD_SIGNALS, admission: Sequence[str] = vocab.ADMISSION_SIGNALS,
) -> Column:
    """Readable kind, enough score, and at least one hard and one admission signal."""
    names = F.map_keys(signals)
    return (
        kind.isin(*vocab.SUPPORTED_KINDS)
        & (score >= minimum)
        & F.arrays_overlap(names, F.array(*[F.lit(n) for n in hard]))
        & F.arrays_overlap(names, F.array(*[F.lit(n) for n in admission]))
    )


def page_links(pages: DataFrame, keep: list[str], url: str, html: str, base_url: str, hosts: Column) -> DataFrame:
    """Approved canonical links of each page in document order, with page title and anchor text.

    ``base_url`` is the approved origin of the site, ``hosts`` an array of further approved hosts.
    """
    own = [*keep, F.col(url).alias("page_url"), F.col(base_url).alias("_base"), hosts.alias("_hosts")]
    clean = settle(pages, own, {"_markup": visible_markup(html)}).select(
        *keep,
        "page_url",
        "_base",
        "_hosts",
        inner_text(F.col("_markup"), "title").alias("title"),
        inner_text(F.col("_markup"), "h1").alias("heading"),
        F.regexp_extract_all("_markup", F.lit(ANCHOR), 0).alias("_anchors"),
    )
    anchors = clean.select("*", F.posexplode("_anchors").alias("link_no", "_anchor")).drop("_anchors")
    href = F.concat(*[F.regexp_extract("_anchor", HREF, group) for group in (1, 2, 3)])
    links = settle(anchors, anchors.columns, {"url": canonical_url(unescape(href), "page_url")}).filter("url IS NOT NULL")
    return links.filter(allowed_host("url", "_base", F.col("_hosts"))).select(
        *keep,
        "page_url",
        F.trim(F.substring(F.concat_ws(" ", "title", "heading"), 1, vocab.LABEL_LENGTH)).alias("page_label"),
        "title",
        (F.col("link_no") + 1).cast("long").alias("link_no"),
        "url",
        linked_kind("url").alias("document_kind"),
        F.substring(strip_tags("_anchor"), 1, vocab.LABEL_LENGTH).alias("anchor_text"),
    )


def sitemap_links(
    sitemaps: DataFrame, keep: list[str], xml: str, base_url: str, hosts: Column, limit: int = vocab.MAX_SITEMAP_URLS
) -> DataFrame:
    """The first approved locations of each sitemap, in order; the limit is per sitemap."""
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    resolved = F.transform(locs, lambda loc: canonical_url(loc, base_url))
    own = sitemaps.withColumn("_hosts", hosts).withColumn("_urls", resolved)
    approved = F.filter("_urls", lambda u: u.isNotNull() & allowed_host(u, base_url, F.col("_hosts")))
    return own.select(*keep, F.posexplode(F.slice(approved, F.lit(1), F.lit(limit))).alias("pos", "url")).select(
        *keep, (F.col("pos") + 1).cast("long").alias("entry_no"), "url", linked_kind("url").alias("document_kind")
    )


def best_per_url(candidates: DataFrame, target: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Best-scored record of each URL; the earlier one wins a tie."""
    return top_per_key(candidates, [*target, "url"], [F.desc("score"), *[F.asc(c) for c in order]])


def top_candidates(best: DataFrame, target: Sequence[str], limit: int = vocab.MAX_SITE_CANDIDATES) -> DataFrame:
    return top_per_key(best, target, [F.desc("score"), F.asc("url")], limit, rank="site_rank")


def bounded_walk(
    seeds: DataFrame, edges: DataFrame, max_pages: int = 24, max_depth: int = 2, entries: DataFrame | None = None
) -> DataFrame:
    """Breadth-first walk from every seed at once: (site, url, depth, arrival).

    ``seeds`` (site, url); ``edges`` (src, dst, pos, optionally site) are the walkable links in order;
    ``entries`` (site, url, pos) are sitemap pages, which queue at depth 1 before the seed's links.
    A page is visited once, in order of arrival, until the page cap of the site is spent. At most
    three levels, each cut off by a reliable checkpoint, as are the pruned links that all of them read. A site holds at most ``max_pages`` rows, and
    the group limit keeps a hub page's links from reaching one task.
    """
    max_pages, max_depth = min(max(max_pages, 1), 60), min(max(max_depth, 0), 3)
    # Order of arrival is (arrival of the page, place of the link), one number since both are small.
    # Visited pages and new arrivals of a site are at most max_pages together, so whatever a page
    # adds is among its first max_pages distinct links: later ones can never be reached from it.
    source = [c for c in ("site", "src") if c in edges.columns]
    links = edges.groupBy(*source, "dst").agg(F.min("pos").alias("pos"))
    edges = cut_lineage(top_per_key(links, source, [F.asc("pos"), F.asc("dst")], max_pages, rank="n"))
    # A page with max_pages links fills what is left of the cap, whatever was visited: no later page adds anything.
    filling = edges.filter(F.col("n") == max_pages).select(*source).withColumnRenamed("src", "url")
    by = ["url", *[c for c in source if c == "site"]]
    if entries is not None:
        listed = entries.groupBy("site", "url").agg(F.min("pos").alias("pos"))
        entries = top_per_key(listed, ["site"], [F.asc("pos"), F.asc("url")], max_pages, rank="n")
    visited = seeds.select("site", "url").distinct().select(
        "site", "url", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("arrival")
    )
    frontier = visited
    for depth in range(1, max_depth + 1):
        # Sites that have spent their cap expand nothing more.
        spent = visited.groupBy("site").agg(F.count(F.lit(1)).alias("spent")).filter(F.col("spent") < max_pages)
        queued = frontier.join(spent.select("site"), "site", "left_semi")
        filled = queued.join(filling, by, "left_semi").groupBy("site").agg(F.min("arrival").alias("filled"))
        last = F.coalesce("filled", F.lit(max_pages))
        open_pages = queued.join(filled, "site", "left").filter(F.col("arrival") <= last).select("site", "url", "arrival")
        reachable = open_pages["url"] == edges["src"]
        if "site" in edges.columns:
            reachable = reachable & (open_pages["site"] == edges["site"])
        found = open_pages.join(edges, reachable).select(
            open_pages["site"], F.col("dst").alias("url"), (F.col("arrival") * 1000 + F.col("n")).alias("rank")
        )
        if depth == 1 and entries is not None:
            found = found.unionByName(entries.select("site", "url", F.col("n").cast("long").alias("rank")))
        first = found.groupBy("site", "url").agg(F.min("rank").alias("rank"))
        fresh = first.join(visited.select("site", "url"), ["site", "url"], "left_anti")
        ranked = top_per_key(fresh, ["site"], [F.asc("rank"), F.asc("url")], max_pages, rank="n")
        frontier = (
            ranked.join(spent, "site")
            .withColumn("arrival", F.col("spent") + F.col("n"))
            .filter(F.col("arrival") <= max_pages)
            .select("site", "url", F.lit(depth).alias("depth"), "arrival")
        )
        frontier = cut_lineage(frontier)
        visited = visited.unionByName(frontier)
    return visited


def attach(
    candidates: DataFrame, targets: DataFrame, campaign: str, cap: str, minimum: str, order: Sequence[str] = (),
    hard: Sequence[str] = vocab.HARD_SIGNALS, admission: Sequence[str] = vocab.ADMISSION_SIGNALS,
) -> DataFrame:
    """Decide the status of each candidate under the cap of active discovered targets.

    ignored (not attachable), already_tracked (active target exists), attached (new or reactivated
    and within the cap), else it stays discovered. ``targets`` has campaign, url, is_active and
    discovered_by; ``cap`` and ``minimum`` are per-campaign columns, clamped to 1..20 and 1..100.
    """
    active = (
        targets.filter(F.col("is_active") & (F.col("discovered_by") == vocab.DISCOVERY_CODE))
        .groupBy(campaign)
        .agg(F.count(F.lit(1)).alias("_active"))
    )
    known = targets.select(campaign, "url", F.col("is_active").alias("_known"))
    clamped_cap = F.least(F.greatest(F.col(cap), F.lit(1)), F.lit(20))
    clamped_min = F.least(F.greatest(F.col(minimum), F.lit(1)), F.lit(100))
    joined = (
        candidates.join(known, [campaign, "url"], "left")
        .join(active, campaign, "left")
        .withColumn("_room", clamped_cap - F.coalesce("_active", F.lit(0)))
        .withColumn(
            "_class",
            F.when(~is_attachable(F.col("document_kind"), F.col("score"), F.col("signals"), clamped_min, hard, admission), "ignored")
            .when(F.col("_known"), "already_tracked")
            .otherwise("eligible"),
        )
    )
    eligible = joined.filter(F.col("_class") == "eligible").select(campaign, "url", "score", "_room", *order)
    queue = [*[F.asc(c) for c in order], F.desc("score"), F.asc("url")]
    # A URL that several sites of a campaign found is attached by the first of them only.
    ranked = top_per_key(top_per_key(eligible, [campaign, "url"], queue), [campaign], queue, 20, rank="_n")
    admitted = ranked.filter(F.col("_n") <= F.col("_room")).select(
        campaign, "url", F.lit(True).alias("_admitted"), *[F.col(c).alias(f"_first_{c}") for c in order]
    )
    is_first = F.lit(True)
    for name in order:
        is_first = is_first & F.col(name).eqNullSafe(F.col(f"_first_{name}"))
    return (
        joined.join(admitted, [campaign, "url"], "left")
        .withColumn(
            "status",
            F.when(F.col("_class") != "eligible", F.col("_class"))
            .when(F.col("_admitted") & is_first, "attached")
            .when(F.col("_admitted"), "already_tracked")
            .otherwise("discovered"),
        )
        .drop(*[f"_first_{c}" for c in order])
        .drop("_known", "_active", "_room", "_class", "_admitted")
    )
