"""Upserts: customers as base, orders and suppliers as changes."""

from pyspark.sql import DataFrame, functions as F

from ruleweave.operators import merge as m
from ruleweave.operators.incremental import observe, version_diff
from ruleweave.operators.ordered import keep_last
from ruleweave import vocab
from ruleweave.plans.ingest import bind_targets as bind, check_targets
from ruleweave.plans.queries.base import Source, long, query

BASE = "base AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"
CHANGES = """
changes AS (
  SELECT o_custkey AS c_custkey, 'order ' || o_orderkey AS c_name, NULL::INTEGER AS c_nationkey, o_totalprice AS c_acctbal,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS c_mktsegment
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
  WHERE n = 1 AND o_orderstatus = 'F'
  UNION ALL
  SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier)
"""
JOINED = f"WITH {BASE}, {CHANGES} SELECT coalesce(b.c_custkey, c.c_custkey) AS c_custkey, {{columns}} FROM base b FULL OUTER JOIN changes c ON b.c_custkey = c.c_custkey"
HIT = "c.c_custkey IS NOT NULL"


def _base(s: Source) -> DataFrame:
    return s.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _changes(s: Source) -> DataFrame:
    latest = keep_last(s.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).filter("o_orderstatus = 'F'")
    known = latest.select(
        F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), "o_orderkey").alias("c_name"),
        F.lit(None).cast("int").alias("c_nationkey"), F.col("o_totalprice").alias("c_acctbal"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("c_mktsegment"),
    )
    fresh = s.supplier.select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"),
    )
    return known.unionByName(fresh)


def _all(template: str) -> str:
    return ", ".join(f"{template.replace('@', n)} AS {n}" for n in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("merge_overwrite", JOINED.format(columns=_all(f"CASE WHEN {HIT} THEN c.@ ELSE b.@ END")))
def merge_overwrite(s: Source):
    return m.upsert(_base(s), _changes(s), ["c_custkey"])


@query("merge_coalesce", JOINED.format(columns=_all(f"CASE WHEN {HIT} THEN coalesce(c.@, b.@) ELSE b.@ END")))
def merge_coalesce(s: Source):
    return m.upsert(_base(s), _changes(s), ["c_custkey"], keep_old_if_null=["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query(
    "merge_guarded",
    JOINED.format(
        columns="""
        CASE WHEN b.c_custkey IS NULL OR (c.c_custkey IS NOT NULL AND b.c_mktsegment <> 'BUILDING') THEN c.c_name ELSE b.c_name END AS c_name,
        CASE WHEN b.c_custkey IS NULL THEN c.c_nationkey ELSE b.c_nationkey END AS c_nationkey,
        CASE WHEN b.c_custkey IS NULL OR (c.c_custkey IS NOT NULL AND b.c_mktsegment <> 'BUILDING') THEN c.c_acctbal ELSE b.c_acctbal END AS c_acctbal,
        CASE WHEN b.c_custkey IS NULL THEN c.c_mktsegment ELSE b.c_mktsegment END AS c_mktsegment,
        CASE WHEN b.c_custkey IS NULL THEN 'inserted' WHEN c.c_custkey IS NULL THEN 'kept'
             WHEN b.c_mktsegment <> 'BUILDING' THEN 'updated' ELSE 'guarded' END AS merge_action"""
    ),
)
def merge_guarded(s: Source):
    return m.upsert(
        _base(s), _changes(s), ["c_custkey"], update=["c_name", "c_acctbal"], guard="c_mktsegment <> 'BUILDING'", with_action=True
    )


@query("merge_insert_only", JOINED.format(columns=_all("CASE WHEN b.c_custkey IS NULL THEN c.@ ELSE b.@ END")))
def merge_insert_only(s: Source):
    return m.insert_missing(_base(s), _changes(s), ["c_custkey"])


@query(
    "merge_nullsafe_key",
    """
    WITH base AS (SELECT nullif(c_nationkey, 0) AS nation, nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS n, 'old' AS state
                  FROM customer GROUP BY 1, 2),
    changes AS (SELECT nullif(s_nationkey, 0) AS nation, CASE WHEN s_acctbal > 3000 THEN 'MACHINERY' END AS segment, count(*) AS n, 'new' AS state
                FROM supplier GROUP BY 1, 2)
    SELECT CASE WHEN b.state IS NULL THEN c.nation ELSE b.nation END AS nation,
           CASE WHEN b.state IS NULL THEN c.segment ELSE b.segment END AS segment,
           coalesce(c.n, b.n) AS n, coalesce(c.state, b.state) AS state
    FROM base b FULL OUTER JOIN changes c ON b.nation IS NOT DISTINCT FROM c.nation AND b.segment IS NOT DISTINCT FROM c.segment
    """,
)
def merge_nullsafe_key(s: Source):
    base = s.customer.groupBy(
        F.nullif("c_nationkey", F.lit(0)).alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("old"))
    changes = s.supplier.groupBy(
        F.nullif("s_nationkey", F.lit(0)).alias("nation"), F.when(F.col("s_acctbal") > 3000, "MACHINERY").alias("segment")
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("new"))
    return m.upsert(base, changes, ["nation", "segment"])


@query(
    "replace_children",
    """
    WITH touched AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'),
    fresh AS (SELECT DISTINCT o_custkey AS parent, year(o_orderdate)::BIGINT AS child FROM orders
              WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM touched))
    SELECT o_custkey AS parent, o_orderkey AS child FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM touched)
    UNION ALL SELECT parent, child FROM fresh
    """,
)
def replace_children(s: Source):
    touched = s.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("parent"))
    children = s.orders.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    fresh = s.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("parent"), F.year("o_orderdate").cast("long").alias("child")
    ).join(touched, "parent", "left_semi")
    return m.replace_children(children, fresh, touched, "parent")


@query(
    "update_from_join",
    """
    SELECT s_suppkey, s_name, coalesce(u.region, s_name || ' unplaced') AS place, CASE WHEN u.n_nationkey IS NOT NULL THEN 1 ELSE 0 END AS is_bound
    FROM supplier LEFT JOIN (SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
                             WHERE r_name IN ('ASIA', 'EUROPE')) u ON s_nationkey = u.n_nationkey
    """,
)
def update_from_join(s: Source):
    base = s.supplier.select(
        "s_suppkey", "s_name", "s_nationkey", F.concat("s_name", F.lit(" unplaced")).alias("place"), F.lit(0).alias("is_bound")
    )
    updates = s.nation.join(s.region.filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("place"), F.lit(1).alias("is_bound")
    )
    return m.update_from(base, updates, ["s_nationkey"], ["place", "is_bound"]).drop("s_nationkey")


@query(
    "cascade_delete",
    """
    SELECT l_orderkey, l_linenumber, l_suppkey,
           CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40) THEN l_partkey END AS l_partkey
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    """,
)
def cascade_delete(s: Source):
    lines = s.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    left = m.cascade(lines, s.orders.filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")
    return m.set_null(left, s.part.filter("p_size <= 40"), "l_partkey", "p_partkey")


@query(
    "backfill_columns",
    """
    SELECT c_custkey, coalesce(nullif(c_nationkey, 0), 99) AS nation,
           CASE WHEN c_acctbal < 0 THEN 'draft' ELSE coalesce(nullif(c_mktsegment, 'HOUSEHOLD'), 'verified') END AS status
    FROM customer
    """,
)
def backfill_columns(s: Source):
    return s.customer.select(
        "c_custkey", F.coalesce(F.nullif("c_nationkey", F.lit(0)), F.lit(99)).alias("nation"),
        F.when(F.col("c_acctbal") < 0, "draft")
        .otherwise(F.coalesce(F.nullif("c_mktsegment", F.lit("HOUSEHOLD")), F.lit("verified"))).alias("status"),
    )


@query(
    "seed_join_upsert",
    """
    WITH seed(region, kind, weight) AS (VALUES ('ASIA', 'general', 5), ('EUROPE', 'bvi', 7), ('ATLANTIS', 'bvi', 9)),
    fresh AS (SELECT s_suppkey, kind, weight FROM seed JOIN region ON r_name = region JOIN nation ON n_regionkey = r_regionkey
              JOIN supplier ON s_nationkey = n_nationkey),
    base AS (SELECT s_suppkey, 'old' AS kind, 0 AS weight FROM supplier WHERE s_acctbal > 4000)
    SELECT coalesce(f.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(f.kind, b.kind) AS kind, coalesce(f.weight, b.weight)::INTEGER AS weight
    FROM base b FULL OUTER JOIN fresh f ON b.s_suppkey = f.s_suppkey
    """,
)
def seed_join_upsert(s: Source):
    seed = s.spark.createDataFrame(
        [("ASIA", "general", 5), ("EUROPE", "bvi", 7), ("ATLANTIS", "bvi", 9)], "r_name string, kind string, weight int"
    )
    nations = s.nation.join(s.region, F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(seed), "r_name")
    fresh = s.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "kind", "weight")
    base = s.supplier.filter("s_acctbal > 4000").select("s_suppkey", F.lit("old").alias("kind"), F.lit(0).alias("weight"))
    return m.upsert(base, fresh, ["s_suppkey"])


@query(
    "bind_targets",
    """
    WITH bound AS (
      SELECT s_suppkey AS university_location_id, r_regionkey::BIGINT AS source_id, 'https://' || lower(r_name) || '/' || s_suppkey AS url,
             CASE WHEN s_acctbal > 5000 THEN 'catalogue-hse-2026-v1' ELSE 'catalogue-mai-2026-v1' END AS adapter_code
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'),
    base AS (SELECT s_suppkey AS university_location_id, -1::BIGINT AS source_id, 'https://asia/' || s_suppkey AS url, 'old' AS adapter_code FROM supplier)
    SELECT coalesce(n.university_location_id, b.university_location_id) AS university_location_id, coalesce(n.url, b.url) AS url,
           coalesce(n.source_id, b.source_id) AS source_id, coalesce(n.adapter_code, b.adapter_code) AS adapter_code,
           n.url IS NOT NULL AS is_active
    FROM base b FULL OUTER JOIN bound n ON b.university_location_id = n.university_location_id AND b.url = n.url
    """,
)
def bind_targets(s: Source):
    placed = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(s.region, F.col("n_regionkey") == F.col("r_regionkey"))
    config = placed.select(
        F.col("r_name").alias("source_code"), F.col("n_name").alias("university_code"), F.col("s_name").alias("location_code"),
        F.concat(F.lit("https://"), F.lower("r_name"), F.lit("/"), "s_suppkey").alias("url"), F.lit("html").alias("document_kind"),
        F.when(F.col("s_acctbal") > 5000, "catalogue-hse-2026-v1").otherwise("catalogue-mai-2026-v1").alias("adapter_code"),
        F.concat(F.lit('{"allow_hosts": ["'), F.lower("r_name"), F.lit('"]}')).alias("adapter_config"),
    )
    base = F.concat(F.lit("https://"), F.lower("r_name"), F.lit("/")).alias("base_url")
    sources = s.region.filter("r_name <> 'AFRICA'").select(long("r_regionkey").alias("id"), F.col("r_name").alias("code"), base)
    universities = s.nation.select(long("n_nationkey").alias("id"), F.col("n_name").alias("code"))
    locations = s.supplier.select(F.col("s_suppkey").alias("id"), long("s_nationkey").alias("university_id"), F.col("s_name").alias("code"))
    targets = s.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("university_location_id"), F.lit(-1).cast("long").alias("source_id"),
        F.concat(F.lit("https://asia/"), "s_suppkey").alias("url"), F.lit("html").alias("document_kind"),
        F.lit("old").alias("adapter_code"), F.lit("{}").alias("adapter_config"), F.lit(False).alias("is_active"),
    )
    bound, _ = bind(config, targets, sources, universities, locations)
    return bound.select("university_location_id", "url", "source_id", "adapter_code", "is_active")


# Suppliers as configured targets; their numbers and balances decide what is wrong with them.
CONFIG = """
WITH config AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'NOWHERE' WHEN s_suppkey % 11 = 0 THEN 'TWICE' ELSE r_name END AS source_code, s_nationkey,
         CASE WHEN s_suppkey % 5 = 0 THEN 'nobody' ELSE s_name END AS location_code, s_name, s_suppkey % 5 = 0 AS lost, lower(r_name) AS host,
         CASE WHEN s_acctbal < 0 THEN 'http' ELSE 'https' END AS scheme, CASE WHEN s_acctbal > 9000 THEN 'doc' ELSE 'html' END AS document_kind,
         s_acctbal > 5000 AS known_adapter, s_suppkey % 3 AS hosts, copy
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, range(CASE WHEN s_suppkey % 13 = 0 THEN 2 ELSE 1 END) AS t(copy))
"""


@query(
    "config_consistency",
    CONFIG + """
    , places AS (SELECT s_nationkey, s_name AS location_code, count(*) AS n FROM supplier, range(CASE WHEN s_suppkey % 17 = 0 THEN 2 ELSE 1 END) AS t(copy) GROUP BY ALL)
    SELECT s_suppkey, array_to_string(list_filter([
      CASE WHEN source_code = 'NOWHERE' THEN 'unknown_source' END, CASE WHEN source_code = 'TWICE' THEN 'several_sources' END,
      CASE WHEN n IS NULL THEN 'unknown_location' END, CASE WHEN n > 1 THEN 'several_locations' END, CASE WHEN NOT known_adapter THEN 'unknown_adapter' END,
      CASE WHEN document_kind = 'doc' THEN 'unknown_document_kind' END, CASE WHEN scheme = 'http' THEN 'not_https' END,
      CASE WHEN hosts = 0 THEN 'no_approved_host' END, CASE WHEN hosts = 1 AND scheme = 'https' AND source_code IN ('NOWHERE', 'TWICE') THEN 'foreign_host' END,
      CASE WHEN count(*) OVER (PARTITION BY s_suppkey) > 1 THEN 'repeated_target' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM config LEFT JOIN places USING (s_nationkey, location_code)
    """,
)
def config_consistency(s: Source):
    placed = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(s.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key, host = F.col("s_suppkey"), F.lower("r_name")
    allowed = F.when(key % 3 == 0, F.lit("{}")).when(key % 3 == 1, '{"allow_hosts": ["other.example.org"]}').otherwise(F.concat(F.lit('{"allow_hosts": ["'), host, F.lit('"]}')))
    twice = lambda n: F.explode(F.when(key % n == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    config = placed.withColumn("copy", twice(13)).select(
        "s_suppkey", F.when(key % 7 == 0, "NOWHERE").when(key % 11 == 0, "TWICE").otherwise(F.col("r_name")).alias("source_code"),
        F.col("n_name").alias("university_code"), F.when(key % 5 == 0, "nobody").otherwise(F.col("s_name")).alias("location_code"),
        F.concat(F.when(F.col("s_acctbal") < 0, "http").otherwise("https"), F.lit("://"), host, F.lit("/"), key).alias("url"),
        F.when(F.col("s_acctbal") > 9000, "doc").otherwise("html").alias("document_kind"),
        F.when(F.col("s_acctbal") > 5000, "catalogue-hse-2026-v1").otherwise("catalogue-none").alias("adapter_code"), allowed.alias("adapter_config"),
    )
    base = F.concat(F.lit("https://"), host, F.lit("/")).alias("base_url")
    regions = s.region.select(long("r_regionkey").alias("id"), F.col("r_name").alias("code"), base)
    others = s.region.filter("r_regionkey < 2").select((long("r_regionkey") + 100).alias("id"), F.lit("TWICE").alias("code"), F.lit("https://twice.example.org/").alias("base_url"))
    universities = s.nation.select(long("n_nationkey").alias("id"), F.col("n_name").alias("code"))
    locations = s.supplier.select(key.alias("id"), long("s_nationkey").alias("university_id"), F.col("s_name").alias("code"), twice(17).alias("copy"))
    checked = check_targets(config, regions.unionByName(others), universities, locations, vocab.CATALOGUE_CODES)
    return checked.select("s_suppkey", F.array_join("reasons", ",").alias("reasons"))


@query(
    "observation_log",
    """
    WITH seen AS (SELECT l_partkey AS rule_id, l_suppkey AS document_id, max(l_shipdate) AS observed_at, 'present' AS observed_status
                  FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
    log AS (SELECT l_partkey AS rule_id, l_suppkey AS document_id, min(l_shipdate) AS observed_at, 'changed' AS observed_status
            FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)
    SELECT coalesce(s.rule_id, l.rule_id) AS rule_id, coalesce(s.document_id, l.document_id) AS document_id,
           coalesce(s.observed_at, l.observed_at) AS observed_at, coalesce(s.observed_status, l.observed_status) AS observed_status
    FROM log l FULL OUTER JOIN seen s ON s.rule_id = l.rule_id AND s.document_id = l.document_id
    """,
)
def observation_log(s: Source):
    keys = [F.col("l_partkey").alias("rule_id"), F.col("l_suppkey").alias("document_id")]
    seen = s.lineitem.filter("l_returnflag = 'A'").groupBy(*keys).agg(F.max("l_shipdate").alias("observed_at"))
    log = s.lineitem.filter("l_returnflag <> 'A'").groupBy(*keys).agg(F.min("l_shipdate").alias("observed_at"))
    return observe(log.withColumn("observed_status", F.lit("changed")), seen.withColumn("observed_status", F.lit("present")))


@query(
    "version_diff",
    """
    WITH old AS (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_linenumber) AS line FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY ALL),
    new AS (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_linenumber) AS line FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY ALL)
    SELECT coalesce(o.l_partkey, n.l_partkey) AS l_partkey, coalesce(o.l_suppkey, n.l_suppkey) AS l_suppkey,
           CASE WHEN n.n IS NULL THEN 'missing' WHEN o.n IS NULL OR (o.n = n.n AND o.line = n.line) THEN 'present' ELSE 'changed' END AS observed_status,
           o.n IS NULL AS is_new
    FROM old o FULL OUTER JOIN new n ON o.l_partkey = n.l_partkey AND o.l_suppkey = n.l_suppkey
    """,
)
def version_diff_query(s: Source):
    def version(lines: DataFrame) -> DataFrame:
        return lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("line"))

    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    old, new = s.lineitem.filter(F.col("l_shipdate") < cut), s.lineitem.filter(F.col("l_shipdate") >= cut)
    return version_diff(version(old), version(new), ["l_partkey", "l_suppkey"], ["n", "line"])


@query(
    "dedupe_last",
    """
    SELECT title, audience, o_orderkey, o_totalprice FROM (
      SELECT lower(o_orderpriority) AS title, o_orderstatus AS audience, o_orderkey, o_totalprice, o_custkey,
             row_number() OVER (PARTITION BY lower(o_orderpriority), o_orderstatus, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    WHERE n = 1
    """,
)
def dedupe_last(s: Source):
    keyed = s.orders.select(
        F.lower("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("audience"), "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"
    )
    return keep_last(keyed, ["title", "audience", "o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "title", "audience", "o_orderkey", "o_totalprice"
    )
