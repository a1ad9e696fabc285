"""Links, scores, the bounded walk and attachment."""

from pyspark.sql import DataFrame, functions as F

from ruleweave import vocab
from ruleweave.operators import links as ln
from ruleweave.plans.queries.base import Source, query
from ruleweave.plans.queries.scalars import sql_collapse, sql_fold

CLEAN = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "noscript", "svg", "template"):
    CLEAN = f"regexp_replace({CLEAN}, '(?is)<{_tag}\\b.*?(?:</{_tag}\\s*>|\\z)', '', 'g')"


def sql_text(markup: str) -> str:
    bare = f"regexp_replace({markup}, '<[^>]+>', ' ', 'g')"
    for name, value in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{value}')"
    return sql_collapse(bare)


LINKS = f"""
clean AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, {CLEAN} AS m FROM pages),
titled AS (
  SELECT *, {sql_text("regexp_extract(m, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")} AS title,
         {sql_text("regexp_extract(m, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")} AS heading,
         regexp_extract_all(regexp_replace(m, '(?i)(<a\\b)', chr(1) || '\\1', 'g'),
                            '(?is)<a\\b[^>]*?\\shref\\s*=[^>]*>.*?(?:</a\\s*>|\\x01|\\z)') AS anchors FROM clean),
anchored AS (SELECT *, replace(unnest(anchors), chr(1), '') AS a, generate_subscripts(anchors, 1) AS link_no FROM titled),
links AS (
  SELECT page_id, host, title, heading, link_no::BIGINT AS link_no,
         'https://' || host || regexp_extract(a, 'href\\s*=\\s*"([^"]*)"', 1) AS url, left({sql_text('a')}, 800) AS anchor_text
  FROM anchored)
"""
SIGNALS = (("admission_rules", ("the ", "les "), 24), ("olympiads", ("ion", "ung"), 22), ("bvi", ("und", "los"), 22), ("admission", ("en ", "de "), 8))
HARD, ADMISSION = ("olympiads", "bvi"), ("admission_rules", "admission")


def sql_score(folded: str) -> str:
    parts = [
        f"CASE WHEN {' OR '.join(f'contains({folded}, {phrase!r})' for phrase in phrases)} THEN {weight} ELSE 0 END"
        for _, phrases, weight in SIGNALS
    ]
    return "least(100, " + " + ".join(parts) + f" + CASE WHEN contains({folded}, '50') THEN 12 ELSE 0 END)"


HAYSTACK = sql_fold("translate(url, '/-', '  ') || ' ' || title || ' ' || anchor_text")


def links_of(s: Source) -> DataFrame:
    secure = F.regexp_replace("url", "^http:", "https:")
    pages = s.dealt("pages", "page_id", "url", "html").withColumn("url", secure)
    none = F.array().cast("array<string>")
    return ln.page_links(pages, ["page_id"], "url", "html", "url", none)


def scored_links(s: Source) -> DataFrame:
    return ln.scored(links_of(s), "url", "title", "anchor_text", 50, SIGNALS)


@query(
    "link_extract",
    f"WITH {LINKS} SELECT page_id, trim(title || ' ' || heading) AS page_label, link_no, url, 'html' AS document_kind, anchor_text FROM links",
)
def link_extract(s: Source):
    return links_of(s).select("page_id", F.col("page_label"), "link_no", "url", "document_kind", "anchor_text")


@query(
    "signal_score",
    f"""
    WITH {LINKS}, scored AS (SELECT page_id, link_no, {HAYSTACK} AS f FROM links)
    SELECT page_id, link_no, {sql_score('f')}::INTEGER AS score,
           (contains(f, 'the ')::INTEGER + contains(f, 'les ')::INTEGER) AS rule_hits,
           {sql_score('f')} >= 38 AND (contains(f, 'ion') OR contains(f, 'ung') OR contains(f, 'und') OR contains(f, 'los'))
             AND (contains(f, 'the ') OR contains(f, 'les ') OR contains(f, 'en ') OR contains(f, 'de ')) AS is_attachable
    FROM scored
    """,
)
def signal_score(s: Source):
    scored = scored_links(s)
    return scored.select(
        "page_id", "link_no", "score", F.coalesce(F.try_element_at("signals", F.lit("admission_rules")), F.lit(0)).alias("rule_hits"),
        ln.is_attachable(F.col("document_kind"), F.col("score"), F.col("signals"), 38, HARD, ADMISSION).alias("is_attachable"),
    )


@query(
    "best_per_key",
    f"""
    WITH {LINKS}, scored AS (SELECT *, {sql_score(HAYSTACK)}::INTEGER AS score FROM links),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY host, url ORDER BY score DESC, page_id, link_no) = 1)
    SELECT host, url, score, page_id, link_no, row_number() OVER (PARTITION BY host ORDER BY score DESC, url)::INTEGER AS site_rank
    FROM best QUALIFY site_rank <= 120
    """,
)
def best_per_key(s: Source):
    from ruleweave.functions.urls import host_of

    found = scored_links(s).withColumn("host", host_of("page_url"))
    best = ln.best_per_url(found, ["host"], ["page_id", "link_no"])
    return ln.top_candidates(best, ["host"]).select("host", "url", "score", "page_id", "link_no", "site_rank")


@query(
    "sitemap_links",
    """
    WITH entries AS (SELECT s_suppkey, unnest(range(1, 201)) AS i FROM supplier),
    kept AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY i) AS entry_no FROM entries WHERE i % 5 <> 0)
    SELECT s_suppkey, entry_no, 'https://s' || s_suppkey || '.example.org/p/' || i || CASE WHEN i % 3 = 0 THEN '.pdf' ELSE '' END AS url,
           CASE WHEN i % 3 = 0 THEN 'pdf' ELSE 'html' END AS document_kind
    FROM kept WHERE entry_no <= 160
    """,
)
def sitemap_links(s: Source):
    site = F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example.org/"))
    locations = F.transform(
        F.sequence(F.lit(1), F.lit(200)),
        lambda i: F.concat(
            F.lit("<url><LOC> "), F.when(i % 5 == 0, "https://foreign.example.com/").otherwise(site), F.lit("p/"), i.cast("string"),
            F.when(i % 3 == 0, ".pdf").otherwise(""), F.lit("?utm_source=map </LOC></url>"),
        ),
    )
    xml = F.concat(F.lit("<urlset>"), F.array_join(locations, "\n"), F.lit("</urlset>"))
    maps = s.dealt("supplier", "s_suppkey").select("s_suppkey", site.alias("base"), xml.alias("xml"))
    return ln.sitemap_links(maps, ["s_suppkey"], "xml", "base", F.array().cast("array<string>"))


@query(
    "bounded_walk",
    """
    WITH pairs AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
    level1 AS (
      SELECT p AS site, s, 1 + row_number() OVER (PARTITION BY p ORDER BY s) AS arrival FROM pairs QUALIFY arrival <= 30),
    spent AS (SELECT site, 1 + count(*) AS n FROM level1 GROUP BY site),
    reached AS (
      SELECT site, pairs.p AS p, min(arrival * 10000000 + pairs.p) AS rank FROM level1 JOIN pairs USING (s) WHERE pairs.p <> site GROUP BY ALL),
    level2 AS (
      SELECT site, p, n + row_number() OVER (PARTITION BY site ORDER BY rank) AS arrival FROM reached JOIN spent USING (site) QUALIFY arrival <= 30)
    SELECT p_partkey AS site, 'p' || p_partkey AS url, 0 AS depth, 1::BIGINT AS arrival FROM part
    UNION ALL SELECT site, 's' || s, 1, arrival FROM level1 UNION ALL SELECT site, 'p' || p, 2, arrival FROM level2
    """,
)
def bounded_walk(s: Source):
    pairs = s.lineitem.select("l_partkey", "l_suppkey").distinct()
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    edges = pairs.select(part.alias("src"), supplier.alias("dst"), F.col("l_suppkey").alias("pos")).unionByName(
        pairs.select(supplier.alias("src"), part.alias("dst"), F.col("l_partkey").alias("pos"))
    )
    seeds = s.part.select(F.col("p_partkey").alias("site"), F.concat(F.lit("p"), "p_partkey").alias("url"))
    return ln.bounded_walk(seeds, edges, max_pages=30, max_depth=2)


# Words of the pages that stand for the phrases that discovery looks for.
PHRASES = (
    (" the ", " правила приёма "), (" and ", " олимпиад "), (" und ", " БВИ "), (" of ", " особые права "), (" la ", " 100 баллов "), (" der ", " поступление "),
    (" los ", " перечень соответствий "),
)
WORDED = "worded AS (SELECT page_id, url, " + "replace(" * len(PHRASES) + "html" + "".join(f", '{a}', '{b}')" for a, b in PHRASES) + " AS html FROM pages)"


def _any(folded: str, names) -> str:
    return "(" + " OR ".join(f"contains({folded}, '{phrase}')" for name, phrases, _ in vocab.SIGNALS for phrase in phrases if name in names) + ")"


def _own_score(folded: str) -> str:
    parts = [f"CASE WHEN {_any(folded, [name])} THEN {weight} ELSE 0 END" for name, _, weight in vocab.SIGNALS]
    return f"least(100, {' + '.join(parts)} + CASE WHEN contains({folded}, '2026') THEN {vocab.YEAR_WEIGHT} ELSE 0 END)"


@query(
    "own_signals",
    f"""
    WITH {WORDED}, {LINKS.replace('FROM pages', 'FROM worded')}, scored AS (SELECT page_id, link_no, {HAYSTACK} AS f FROM links)
    SELECT page_id, link_no, {_own_score('f')}::INTEGER AS score,
           {_own_score('f')} >= 38 AND {_any('f', vocab.HARD_SIGNALS)} AND {_any('f', vocab.ADMISSION_SIGNALS)} AS is_attachable
    FROM scored
    """,
)
def own_signals(s: Source):
    """Links scored and judged by the format's own phrases and weights."""
    html = F.col("html")
    for word, phrase in PHRASES:
        html = F.replace(html, F.lit(word), F.lit(phrase))
    pages = s.dealt("pages", "page_id", "url", "html").withColumns({"html": html, "url": F.regexp_replace("url", "^http:", "https:")})
    links = ln.page_links(pages, ["page_id"], "url", "html", "url", F.array().cast("array<string>"))
    scored = ln.scored(links, "url", "title", "anchor_text", 2026)
    return scored.select(
        "page_id", "link_no", "score", ln.is_attachable(F.col("document_kind"), F.col("score"), F.col("signals")).alias("is_attachable")
    )


CAPPED = """
    WITH candidates AS (
      SELECT p_brand AS campaign, 'https://c/' || p_partkey AS url, CASE p_type WHEN 'SMALL' THEN 'other' WHEN 'LARGE' THEN 'pdf' ELSE 'html' END AS kind,
             p_size * 2 AS score, p_size > 10 AS hard, p_retailprice > 903 AS admission, 3 + length(p_brand) AS cap, p_partkey FROM part),
    targets AS (SELECT p_brand AS campaign, 'https://c/' || p_partkey AS url, p_size > 35 AS is_active, p_size > 49 AS discovered FROM part WHERE p_size BETWEEN 30 AND 50),
    active AS (SELECT campaign, count(*) AS n FROM targets WHERE is_active AND discovered GROUP BY ALL),
    classed AS (
      SELECT c.*, CASE WHEN NOT (c.kind <> 'other' AND c.score >= 38 AND c.hard AND c.admission) THEN 'ignored' WHEN t.is_active THEN 'already_tracked' ELSE 'eligible' END AS class,
             c.cap - coalesce(a.n, 0) AS room
      FROM candidates c LEFT JOIN targets t USING (campaign, url) LEFT JOIN active a USING (campaign)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY campaign, class ORDER BY score DESC, url) AS n FROM classed)
"""


def capped_candidates(s: Source) -> tuple[DataFrame, DataFrame]:
    """Parts as found documents of their brand's campaign, and some of them as targets that are known."""
    url = F.concat(F.lit("https://c/"), "p_partkey")
    entry = F.array_compact(F.array(
        F.when(F.col("p_size") > 10, F.struct(F.lit("bvi").alias("key"), F.lit(1).alias("value"))),
        F.when(F.col("p_retailprice") > 903, F.struct(F.lit("admission").alias("key"), F.lit(1).alias("value"))),
    ))
    candidates = s.part.select(
        F.col("p_brand").alias("campaign"), url.alias("url"),
        F.when(F.col("p_type") == "SMALL", "other").when(F.col("p_type") == "LARGE", "pdf").otherwise("html").alias("document_kind"),
        (F.col("p_size") * 2).alias("score"), F.map_from_entries(entry).alias("signals"), (3 + F.length("p_brand")).alias("cap"),
        F.lit(38).alias("minimum"),
    )
    targets = s.part.filter("p_size BETWEEN 30 AND 50").select(
        F.col("p_brand").alias("campaign"), url.alias("url"), (F.col("p_size") > 35).alias("is_active"),
        F.when(F.col("p_size") > 49, "official-source-discovery-v1").alias("discovered_by"),
    )
    return candidates, targets


@query(
    "capped_attach",
    CAPPED + """
    SELECT campaign, url, score, CASE WHEN class <> 'eligible' THEN class WHEN n <= room THEN 'attached' ELSE 'discovered' END AS status FROM ranked
    """,
)
def capped_attach(s: Source):
    candidates, targets = capped_candidates(s)
    return ln.attach(candidates, targets, "campaign", "cap", "minimum").select("campaign", "url", "score", "status")
