"""Scalar text, key, JSON, date and URL functions over whole columns."""

from pyspark.sql import Column, functions as F, types as T

from ruleweave.functions import text as t, urls as u
from ruleweave.functions.classify import is_direction, selectors, split_code
from ruleweave.operators.ordered import keep_first
from ruleweave.plans.ingest import source_code, subject_codes
from ruleweave.plans.queries.base import Source, at, query
from ruleweave.sources.snapshots import parse_records
from ruleweave.sources.store import address

# White space as the engine's text functions see it, for a regex dialect whose \s is ASCII only.
SQL_SPACE = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_compact(value: str) -> str:
    return f"trim(regexp_replace(replace(replace({value}, chr(173), ''), chr(160), ' '), '{SQL_SPACE}', ' ', 'g'))"


def sql_collapse(value: str) -> str:
    return f"trim(regexp_replace({value}, '{SQL_SPACE}', ' ', 'g'))"


def sql_fold(value: str) -> str:
    return f"replace(replace(lower({sql_compact(value)}), 'ß', 'ss'), 'ё', 'е')"


def sql_unquoted(value: str) -> str:
    quotes = "[«»\"''`]+"
    return sql_collapse(f"regexp_replace({sql_fold(value)}, '{quotes}', '', 'g')")


def sql_tokens(value: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower({value}), 'ß', 'ss'), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"


@query(
    "text_normalise",
    f"""
    SELECT doc_id, md5({sql_compact('text')}) AS compacted, md5({sql_fold('text')}) AS folded,
           md5({sql_unquoted('text')}) AS unquoted, md5({sql_tokens('text')}) AS tokens
    FROM documents
    """,
)
def text_normalise(s: Source):
    return s.dealt("documents", "doc_id", "text").select(
        "doc_id", F.md5(t.compact("text")).alias("compacted"), F.md5(t.fold("text")).alias("folded"),
        F.md5(t.fold_unquoted("text")).alias("unquoted"), F.md5(t.fold_tokens("text")).alias("tokens"),
    )


@query(
    "stable_key",
    f"""
    SELECT doc_id, substr(sha256(source || chr(31) || doc_id || chr(31) || '' || chr(31) || text), 1, 32) AS candidate_key,
           lang || ':' || substr(sha256({sql_collapse("replace(lower(text), 'ß', 'ss')")}), 1, 20) AS title_key
    FROM documents
    """,
)
def stable_key(s: Source):
    return s.documents.select(
        "doc_id", t.stable_key("source", "doc_id", F.lit(None), "text").alias("candidate_key"),
        t.competition_key("lang", "text").alias("title_key"),
    )


@query(
    "html_strip_text",
    f"""
    SELECT page_id, {sql_collapse("replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")} AS body
    FROM pages
    """,
)
def html_strip_text(s: Source):
    return s.dealt("pages", "page_id", "html").select("page_id", t.strip_tags("html").alias("body"))


@query(
    "content_hash_store",
    """
    SELECT source, content_sha256, content_size_bytes, doc_id AS first_doc_id, lang
    FROM (SELECT source, sha256(text) AS content_sha256, octet_length(encode(text)) AS content_size_bytes, doc_id, lang,
                 row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents)
    WHERE n = 1
    """,
)
def content_hash_store(s: Source):
    stored = address(s.documents.select("doc_id", "lang", "source", "text"), "text", "source", ["doc_id"])
    return stored.select("source", "content_sha256", "content_size_bytes", F.col("doc_id").alias("first_doc_id"), "lang")


@query(
    "document_kind",
    """
    WITH links AS (
      SELECT page_id, u, ct, lower(regexp_extract(u, '^(?:[A-Za-z]+:)?(?://[^/?#]*)?([^?#]*)', 1)) AS path,
             lower(trim(split_part(ct, ';', 1))) AS media
      FROM (SELECT page_id, CASE WHEN url LIKE 'https%' THEN replace(url, '.html', '.PDF') ELSE replace(url, '/en/', '/en.xlsx') END AS u,
                   CASE WHEN html LIKE '%lang="fr"%' THEN 'Text/HTML; charset=utf-8' WHEN html LIKE '%lang="de"%' THEN 'application/pdf'
                        WHEN html LIKE '%lang="es"%' THEN 'application/vnd.ms-excel ;v=1' ELSE '' END AS ct FROM pages))
    SELECT page_id,
           CASE WHEN media IN ('text/html', 'application/xhtml+xml') THEN 'html'
                WHEN media = 'application/pdf' OR path LIKE '%.pdf' THEN 'pdf'
                WHEN media LIKE '%excel' OR path LIKE '%.xlsx' OR path LIKE '%.xls' THEN 'xlsx' ELSE 'other' END AS kind,
           CASE WHEN path LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.xlsx' OR path LIKE '%.xls' THEN 'xlsx' ELSE 'html' END AS linked,
           CASE WHEN media = 'text/html' THEN '.html' WHEN media = 'application/pdf' THEN '.pdf' WHEN media LIKE '%excel' THEN '.xls'
                WHEN regexp_matches(path, '[^/]\\.(html|htm|pdf|xlsx|xls)$') THEN regexp_extract(path, '(\\.[a-z]+)$', 1) ELSE '.bin' END AS suffix
    FROM links
    """,
)
def document_kind(s: Source):
    link = F.when(F.col("url").like("https%"), F.replace("url", F.lit(".html"), F.lit(".PDF"))).otherwise(
        F.replace("url", F.lit("/en/"), F.lit("/en.xlsx"))
    )
    media = (
        F.when(F.col("html").like('%lang="fr"%'), "Text/HTML; charset=utf-8").when(F.col("html").like('%lang="de"%'), "application/pdf")
        .when(F.col("html").like('%lang="es"%'), "application/vnd.ms-excel ;v=1").otherwise("")
    )
    links = s.pages.select("page_id", link.alias("u"), media.alias("ct"))
    return links.select(
        "page_id", u.document_kind("u", "ct").alias("kind"), u.linked_kind("u").alias("linked"), u.file_suffix("ct", "u").alias("suffix")
    )


@query(
    "url_canonical",
    """
    WITH parts AS (
      SELECT page_id, url LIKE 'https://%' AS secure, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
             regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages),
    kept AS (
      SELECT *, list_filter(string_split(query, '&'), lambda q: q <> '' AND NOT starts_with(lower(q), 'utm_')) AS q FROM parts)
    SELECT page_id,
           CASE WHEN secure THEN 'https://' || host || CASE path WHEN '' THEN '/' ELSE path END
                || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical,
           CASE WHEN secure THEN 'https://' || host || '/docs/a.pdf' END AS sibling,
           CASE WHEN secure THEN 'https://' || host || regexp_replace(path, '[^/]*$', '') || 'b/c?x=1&y=' END AS child,
           (host = 'example.org' OR host LIKE '%.example.org' OR host LIKE 'm.%.example.com') AS allowed
    FROM kept
    """,
)
def url_canonical(s: Source):
    hosts = F.array(F.lit("example.org"))
    mobile = F.when(u.host_of("url").rlike(r"^m\..*\.example\.com$"), F.col("url")).otherwise("https://example.org/")
    return s.pages.select(
        "page_id", u.canonical_url("url", "url").alias("canonical"),
        u.canonical_url(F.lit("/docs/./x/../a.pdf?utm_medium=mail#top"), "url").alias("sibling"),
        u.canonical_url(F.lit("b/c?x=1&fbclid=2&y="), "url").alias("child"),
        u.allowed_host("url", mobile, hosts).alias("allowed"),
    )


@query(
    "http_date_parse",
    """
    SELECT event_id, date_trunc('second', ts) AS parsed, NULL::TIMESTAMP AS unparsed FROM events
    """,
)
def http_date_parse(s: Source):
    header = F.concat(F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))

    def utc(instant: Column) -> Column:
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))

    return s.events.select(
        "event_id", utc(t.http_date(header)).alias("parsed"), utc(t.http_date(F.col("props"))).alias("unparsed")
    )


@query(
    "json_source",
    """
    SELECT event_id, event_type AS title, r ->> 'k' AS profile, j AS subject
    FROM events, unnest([props::JSON]) AS a(r), unnest(['click', event_type]) AS b(j)
    """,
)
def json_source(s: Source):
    record = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "profile", "subject")])
    item = F.concat(
        F.lit('{"title": "'), "event_type", F.lit('", "profile": "'), F.get_json_object("props", "$.k"), F.lit('", "subject": "')
    )
    body = F.concat(F.lit('{"records": ['), item, F.lit('click"}, '), item, F.col("event_type"), F.lit('"}]}'))
    snapshots = s.events.select("event_id", body.alias("body"))
    return parse_records(snapshots, "body", record, "records", ["event_id"])


@query(
    "json_get_merge",
    """
    SELECT event_id, (props ->> 'k')::INTEGER AS k, coalesce((props ->> 'year')::INTEGER, year(ts)::INTEGER - 1) AS catalogue_year,
           CASE WHEN (props ->> 'k')::INTEGER > 50 THEN 'late' ELSE 'early' END AS k_class,
           (props ->> 'k') || '|' || event_type || '|' || user_id AS merged
    FROM events
    """,
)
def json_get_merge(s: Source):
    k = F.get_json_object("props", "$.k")
    stored = F.from_json("props", "map<string,string>")
    added = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    fresh = F.map_filter(stored, lambda key, _: ~F.array_contains(F.map_keys(added), key))
    merged = F.map_concat(fresh, added)
    return s.events.select(
        "event_id", k.cast("int").alias("k"),
        F.coalesce(F.get_json_object("props", "$.year").cast("int"), F.year("ts") - 1).alias("catalogue_year"),
        F.when(k.cast("int") > 50, "late").otherwise("early").alias("k_class"),
        F.concat_ws("|", merged["k"], merged["type"], merged["user"]).alias("merged"),
    )


@query(
    "dim_lookup_default",
    """
    SELECT p_partkey, coalesce(d.code, 'other') AS code, coalesce(r_regionkey, -1)::INTEGER AS dim_id
    FROM part
    LEFT JOIN (VALUES ('ECONOMY', 'eco'), ('LARGE', 'lrg'), ('MEDIUM', 'med'), ('PROMO', 'pro')) d(name, code) ON d.name = p_type
    LEFT JOIN region ON r_name = CASE p_type WHEN 'ECONOMY' THEN 'ASIA' WHEN 'LARGE' THEN 'EUROPE' END
    """,
)
def dim_lookup_default(s: Source):
    codes = s.spark.createDataFrame(
        [("ECONOMY", "eco", "ASIA"), ("LARGE", "lrg", "EUROPE"), ("MEDIUM", "med", None), ("PROMO", "pro", None)],
        "p_type string, code string, r_name string",
    )
    dim = codes.join(s.region, "r_name", "left").select("p_type", "code", "r_regionkey")
    return s.part.join(F.broadcast(dim), "p_type", "left").select(
        "p_partkey", F.coalesce("code", F.lit("other")).alias("code"), F.coalesce("r_regionkey", F.lit(-1)).alias("dim_id")
    )


@query(
    "case_mapping",
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'strict-hse-2026-v1' WHEN 'click' THEN 'strict-msu-2026-v2'
                     WHEN 'purchase' THEN 'strict-mephi-2026-v1' ELSE 'requests-bs4-keyword-v1' END AS adapter_code
    FROM events
    """,
)
def case_mapping(s: Source):
    codes = {"view": "strict-hse-2026-v1", "click": "strict-msu-2026-v2", "purchase": "strict-mephi-2026-v1"}
    table = F.create_map(*[F.lit(item) for pair in codes.items() for item in pair])
    code = F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("requests-bs4-keyword-v1"))
    return s.events.select("event_id", code.alias("adapter_code"))


@query(
    "record_derive",
    """
    WITH labelled AS (
      SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'РСОШ · Перечень ' || year(o_orderdate) || '/26'
             WHEN 'O' THEN 'РСОШ ' || year(o_orderdate) || ' / ' || (year(o_orderdate) + 1) ELSE 'сезон 2021/2022' END AS source FROM orders)
    SELECT o_orderkey,
           CASE WHEN regexp_matches(source, '20[0-9]{2}\\s*/\\s*20[0-9]{2}') THEN regexp_extract(source, '(20[0-9]{2})\\s*/\\s*20[0-9]{2}', 1)::INTEGER
                ELSE 2025 END AS campaign_year,
           CASE WHEN starts_with(source, 'РСОШ') THEN 'rsosh' ELSE 'ya-professional' END AS source_code,
           CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN left(o_orderpriority, 1)::INTEGER END AS level,
           CASE WHEN starts_with(o_orderpriority, '4') THEN 'other' WHEN starts_with(o_orderpriority, '5') THEN 'law' ELSE 'math' END AS subject
    FROM labelled
    """,
)
def record_derive(s: Source):
    year = F.year("o_orderdate").cast("string")
    label = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("РСОШ · Перечень "), year, F.lit("/26")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("РСОШ "), year, F.lit(" / "), F.year("o_orderdate") + 1))
        .otherwise("сезон 2021/2022")
    )
    name = F.when(F.col("o_orderpriority").like("4%"), "Нет такого").when(F.col("o_orderpriority").like("5%"), "Право").otherwise("Математика")
    labelled = s.orders.select("o_orderkey", label.alias("source"), F.substring("o_orderpriority", 1, 1).alias("level"), name.alias("name"))
    return labelled.select(
        "o_orderkey", t.campaign_year_of("source").alias("campaign_year"), source_code(F.col("source")).alias("source_code"),
        t.level_number("level").alias("level"), F.get(subject_codes(F.array("name")), F.lit(0)).alias("subject"),
    )


CODED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       CASE WHEN l_returnflag = 'A' THEN 'Кафедра ' || strftime(l_shipdate, '%m.%d.%y') || ' — раздел ' || l_linenumber
            WHEN l_returnflag = 'N' THEN strftime(l_shipdate, '%m.%d.%y') || ', ' || strftime(l_shipdate, '%d.%m.%y')
            WHEN l_linestatus = 'F' THEN 'Все направления, см. приказ' ELSE ' Программа  ' || l_partkey || ' ' END AS cell
FROM lineitem
"""


@query(
    "code_classify",
    f"""
    WITH coded AS ({CODED}),
    found AS (SELECT *, list_distinct(regexp_extract_all(cell, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}')) AS d,
                     regexp_extract_all(cell, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}') AS a FROM coded),
    ranked AS (SELECT *, a[1] AS code, CASE WHEN len(a) = 2 AND a[1] <> a[2] THEN a WHEN len(a) > 0 THEN a[1:1] ELSE [] END AS codes FROM found)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, code,
           CASE WHEN len(codes) > 0 THEN array_to_string(codes, '+') WHEN cell LIKE 'Все%' THEN '' ELSE trim(replace(cell, '  ', ' ')) END AS selectors,
           CASE WHEN a IS NULL OR len(a) = 0 THEN trim(replace(cell, '  ', ' ')) WHEN len(a) = 2 THEN a[2]
                ELSE 'раздел ' || l_linenumber END AS title,
           coalesce(substr(code, 4, 2) IN ('03', '05') AND substr(code, 1, 2) <> '00' AND substr(code, 7, 2) <> '00', FALSE) AS is_direction,
           CASE WHEN split_part(code, '.', 2) = '05' THEN 'specialist' ELSE 'bachelor' END AS degree_level
    FROM ranked
    """,
)
def code_classify(s: Source):
    ship = F.date_format("l_shipdate", "MM.dd.yy")
    cell = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Кафедра "), ship, F.lit(" — раздел "), "l_linenumber"))
        .when(F.col("l_returnflag") == "N", F.concat(ship, F.lit(", "), F.date_format("l_shipdate", "dd.MM.yy")))
        .when(F.col("l_linestatus") == "F", "Все направления, см. приказ")
        .otherwise(F.concat(F.lit(" Программа  "), "l_partkey", F.lit(" ")))
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    parted = s.lineitem.select(*keys, selectors(cell).alias("chosen"), split_code(cell).alias("parts"))
    return parted.select(
        *keys, F.col("parts.code").alias("code"), F.array_join("chosen", "+").alias("selectors"), F.col("parts.title").alias("title"),
        is_direction("parts.code").alias("is_direction"),
        F.coalesce(t.level_of_code("parts.code"), F.lit("bachelor")).alias("degree_level"),
    )


@query(
    "dedupe_first",
    """
    SELECT doc_id, source, lang, n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1
    """,
)
def dedupe_first(s: Source):
    hashed = s.documents.select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("sha"))
    return keep_first(hashed, ["sha"], ["doc_id"]).drop("sha")


@query(
    "validity_window",
    """
    SELECT o_orderkey, year(o_orderdate)::INTEGER AS diploma_year,
           year(o_orderdate) + 4 >= 2000 AND year(o_orderdate) <= 2000 AS is_valid
    FROM orders
    """,
)
def validity_window(s: Source):
    from ruleweave.operators.incremental import diploma_is_valid

    return s.orders.select(
        "o_orderkey", F.year("o_orderdate").alias("diploma_year"),
        diploma_is_valid(F.year("o_orderdate"), F.lit(2000)).alias("is_valid"),
    )


@query(
    "deactivate_not_in",
    """
    SELECT s_suppkey, s_name, CASE WHEN n_name IN ('NATION_3', 'NATION_7', 'NATION_15') THEN s_acctbal > 0 ELSE FALSE END AS is_active,
           CASE WHEN n_name IN ('NATION_3', 'NATION_7', 'NATION_15') THEN NULL ELSE TIMESTAMP '2024-01-20' END AS updated_at
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def deactivate_not_in(s: Source):
    keep = F.col("n_name").isin("NATION_3", "NATION_7", "NATION_15")
    joined = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "s_suppkey", "s_name", F.when(~keep, False).otherwise(F.col("s_acctbal") > 0).alias("is_active"),
        F.when(~keep, at("2024-01-20")).alias("updated_at"),
    )
