"""Registration of queries, and the catalogue tables as views of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ruleweave.operators.stages import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TASKS_PER_CORE = 8


class Source:
    """Driver tables by name; a table is read with the columns the plan asks for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table for expensive row-wise work, dealt out."""
        return deal(getattr(self, name).select(*columns))


def deal(frame: DataFrame) -> DataFrame:
    """Rows of a table for expensive row-wise work, dealt into enough partitions for all cores.

    A few megabytes hold millions of rows that each become a document, and a scan splits by bytes, so
    a scan with fewer partitions than that is dealt out. ``spark.ruleweave.readPartitions`` sets
    their number. The columns are settled, since a filter on what is made of them would else move
    below the deal, into the few tasks of the scan.
    """
    spark = frame.sparkSession
    asked = int(spark.conf.get("spark.ruleweave.readPartitions", None) or TASKS_PER_CORE * max(spark.sparkContext.defaultParallelism, 8))
    if frame.rdd.getNumPartitions() >= asked:
        return frame
    return settle(frame.repartition(asked), [], {column: F.col(column) for column in frame.columns})


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Source], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(Source(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def catalogue(s: Source) -> dict[str, DataFrame]:
    """Nations as universities, customers as locations, orders as programmes, lines as rules.

    Campaigns are (nation, year), parts are competition profiles, part types are subjects,
    suppliers state the campaigns' policies.
    """
    universities = s.nation.join(s.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        long("n_nationkey").alias("id"), F.concat(F.lit("u"), "n_nationkey").alias("code"), F.col("n_name").alias("name"),
        F.col("r_name").alias("city"), F.concat(F.lit("https://u"), "n_nationkey", F.lit(".example.org/")).alias("official_url"),
        (F.col("r_name") != "MIDDLE EAST").alias("is_active"),
    )
    kind = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "main").when(F.col("c_mktsegment") == "BUILDING", "branch")
        .when(F.col("c_mktsegment") == "MACHINERY", "online").otherwise("campus")
    )
    address = F.concat(F.lit("https://place.example.org/"), "c_custkey")
    opened = F.lit("2000-01-01").cast("timestamp_ntz")
    locations = s.customer.select(
        F.col("c_custkey").alias("id"), long("c_nationkey").alias("university_id"),
        F.concat(F.lit("l"), "c_custkey").alias("code"), F.col("c_name").alias("name"), kind.alias("location_type"),
        F.lit(None).cast("string").alias("city"), F.col("c_mktsegment").alias("region"), F.lit("Terra").alias("country"),
        address.alias("official_url"), F.concat(address, F.lit("/dir")).alias("directory_url"),
        opened.alias("location_checked_at"),
        F.when(F.col("c_acctbal") > 0, "benefits_verified").otherwise("candidate").alias("admission_status"),
        F.when(F.col("c_acctbal") > 5000, F.concat(address, F.lit("/rules"))).alias("admission_rules_url"),
        F.when(F.col("c_acctbal") > 5000, F.lit("2000-02-02").cast("timestamp_ntz")).alias("admission_checked_at"),
        (F.col("c_acctbal") > -500).alias("is_active"),
    )
    years = F.sequence(F.lit(1995), F.lit(2001))
    campaigns = s.nation.select("n_nationkey", F.explode(years).alias("y")).select(
        (long("n_nationkey") * 10000 + F.col("y")).alias("id"), long("n_nationkey").alias("university_id"),
        F.col("y").alias("campaign_year"), F.concat(F.lit("https://u"), "n_nationkey", F.lit(".example.org/"), "y").alias("rules_url"),
        F.make_timestamp_ntz("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("rules_checked_at"),
    )
    owner = s.customer.select(F.col("c_custkey").alias("o_custkey"), long("c_nationkey").alias("university_id"))
    owned = s.orders.join(owner, "o_custkey")
    programs = owned.select(
        F.col("o_orderkey").alias("id"), "university_id", F.col("o_custkey").alias("university_location_id"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd.MM.yy")).alias("external_code"),
        F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "code_only").otherwise("named_verified").alias("catalogue_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "specialist").otherwise("bachelor").alias("degree_level"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("https://catalogue.example.org/"), "o_orderkey")).alias("catalogue_source_url"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")).alias("catalogue_checked_at"),
        (F.col("o_totalprice") > 1000).alias("is_active"),
    )
    rules = s.lineitem.join(owned.select(F.col("o_orderkey").alias("l_orderkey"), "university_id"), "l_orderkey").select(
        F.col("l_orderkey").alias("university_program_id"),
        (F.col("university_id") * 10000 + F.year("l_shipdate")).alias("admission_campaign_id"),
        F.col("l_partkey").alias("olympiad_profile_id"),
        F.when(F.col("l_returnflag") == "A", "winner").when(F.col("l_returnflag") == "N", "prize_winner").otherwise("finalist").alias("diploma_status"),
        F.when(F.col("l_tax") > 0.04, "hundred_points").otherwise("bvi").alias("benefit_kind"),
        F.lit(None).cast("short").alias("point_value"),
        F.when(F.col("l_discount") > 0.05, F.col("l_linenumber")).cast("short").alias("confirmation_subject_id"),
        F.col("l_quantity").cast("short").alias("confirmation_min_score"),
        F.concat_ws("/", F.lit("https://rules.example.org"), "l_suppkey", "l_partkey").alias("source_url"),
        F.concat(F.lit("row:"), "l_linenumber").alias("source_locator"), F.col("l_shipdate").alias("checked_at"),
        (F.col("l_linestatus") == "F").alias("is_verified"),
        F.when(F.col("l_linestatus") == "F", "verified").otherwise("draft").alias("verification_status"),
        (F.col("l_returnflag") != "R").alias("is_active"),
    )
    policies = s.supplier.select(
        F.col("s_suppkey").alias("id"),
        (long("s_nationkey") * 10000 + 1995 + F.floor(F.abs("s_acctbal") / 2000)).alias("admission_campaign_id"),
        F.when(F.col("s_acctbal") < 1000, F.col("s_suppkey")).alias("university_program_id"),
        F.when(F.col("s_acctbal") > 6000, "general").otherwise("bvi").alias("policy_kind"), F.col("s_name").alias("description"),
        F.concat(F.lit("https://policy.example.org/"), "s_suppkey").alias("source_url"),
        (at("1970-01-01") + F.make_dt_interval(secs=(F.floor("s_acctbal") * 1000).cast("decimal(18,6)"))).alias("checked_at"),
        (F.col("s_acctbal") > 0).alias("is_verified"),
    )
    olympiads = s.part.select("p_brand").distinct().select(
        F.xxhash64("p_brand").alias("id"), F.concat(F.lit("Contest "), "p_brand").alias("title"), F.lit("brand").alias("kind"),
        F.when(F.col("p_brand") < "Brand#2", "student").otherwise("school").alias("audience"), F.lit(True).alias("is_active"),
    )
    profiles = s.part.select(
        F.col("p_partkey").alias("id"), F.xxhash64("p_brand").alias("olympiad_id"), F.lit(1).cast("long").alias("source_id"),
        F.lit(2026).alias("campaign_year"), F.col("p_name").alias("profile_title"),
        F.when(F.col("p_size") <= 30, F.ceil(F.col("p_size") / 10)).cast("short").alias("level"),
        F.when(F.col("p_retailprice") > 905, "approved").otherwise("draft").alias("approval_status"),
        F.concat(F.lit("https://part.example.org/"), "p_partkey").alias("source_url"), (F.col("p_size") < 48).alias("is_active"),
    )
    names = F.array(*[F.lit(n) for n in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "OTHER")])
    subjects = s.region.select(F.posexplode(names)).distinct().select(
        (F.col("pos") + 1).cast("short").alias("id"), F.lower("col").alias("code"), F.col("col").alias("name")
    )
    bridge = s.part.select(F.col("p_partkey").alias("olympiad_profile_id"), F.col("p_type").alias("name"), "p_size").filter("p_size <> 13")
    bridge = bridge.join(subjects.select("name", F.col("id").alias("subject_id")), "name").select("olympiad_profile_id", "subject_id").unionByName(
        s.part.filter("p_size > 40").select(F.col("p_partkey").alias("olympiad_profile_id"), F.lit(7).cast("short").alias("subject_id"))
    )
    tracked = s.events.select(
        "user_id", F.floor(F.col("value")).alias("olympiad_profile_id"), (F.col("event_type") == "signup").alias("is_active")
    )
    sources = s.region.filter("r_regionkey = 0").select(long("r_regionkey").alias("_k")).select(
        (F.col("_k") + 1).alias("id"), F.lit("rsosh").alias("code")
    )
    return {
        "universities": universities, "university_locations": locations, "admission_campaigns": campaigns,
        "university_programs": programs, "benefit_rules": rules, "admission_policies": policies, "olympiads": olympiads,
        "olympiad_profiles": profiles, "subjects": subjects, "olympiad_profile_subjects": bridge,
        "tracked_olympiads": tracked, "sources": sources,
    }


CATALOGUE_SQL = """
WITH universities AS (
  SELECT n_nationkey::BIGINT AS id, 'u' || n_nationkey AS code, n_name AS name, r_name AS city,
         'https://u' || n_nationkey || '.example.org/' AS official_url, r_name <> 'MIDDLE EAST' AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey),
locations AS (
  SELECT c_custkey AS id, c_nationkey::BIGINT AS university_id, 'l' || c_custkey AS code, c_name AS name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'main' WHEN 'BUILDING' THEN 'branch' WHEN 'MACHINERY' THEN 'online'
              ELSE 'campus' END AS location_type,
         NULL::VARCHAR AS city, c_mktsegment AS region, 'Terra' AS country,
         'https://place.example.org/' || c_custkey AS official_url,
         'https://place.example.org/' || c_custkey || '/dir' AS directory_url,
         TIMESTAMP '2000-01-01' AS location_checked_at,
         CASE WHEN c_acctbal > 0 THEN 'benefits_verified' ELSE 'candidate' END AS admission_status,
         CASE WHEN c_acctbal > 5000 THEN 'https://place.example.org/' || c_custkey || '/rules' END AS admission_rules_url,
         CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2000-02-02' END AS admission_checked_at,
         c_acctbal > -500 AS is_active
  FROM customer),
campaigns AS (
  SELECT n_nationkey::BIGINT * 10000 + y AS id, n_nationkey::BIGINT AS university_id, y AS campaign_year,
         'https://u' || n_nationkey || '.example.org/' || y AS rules_url, make_timestamp(y, 1, 1, 0, 0, 0) AS rules_checked_at
  FROM nation, range(1995, 2002) AS r(y)),
programs AS (
  SELECT o_orderkey AS id, c_nationkey::BIGINT AS university_id, o_custkey AS university_location_id,
         CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d.%m.%y') END AS external_code,
         o_orderpriority || ' ' || o_orderkey AS name,
         CASE WHEN o_orderstatus = 'F' THEN 'code_only' ELSE 'named_verified' END AS catalogue_status,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'specialist' ELSE 'bachelor' END AS degree_level,
         CASE WHEN o_orderstatus = 'O' THEN 'https://catalogue.example.org/' || o_orderkey END AS catalogue_source_url,
         CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS catalogue_checked_at, o_totalprice > 1000 AS is_active
  FROM orders JOIN customer ON o_custkey = c_custkey),
rules AS (
  SELECT l_orderkey AS university_program_id, university_id * 10000 + year(l_shipdate) AS admission_campaign_id,
         l_partkey AS olympiad_profile_id,
         CASE l_returnflag WHEN 'A' THEN 'winner' WHEN 'N' THEN 'prize_winner' ELSE 'finalist' END AS diploma_status,
         CASE WHEN l_tax > 0.04 THEN 'hundred_points' ELSE 'bvi' END AS benefit_kind, NULL::SMALLINT AS point_value,
         CASE WHEN l_discount > 0.05 THEN l_linenumber END::SMALLINT AS confirmation_subject_id,
         trunc(l_quantity)::SMALLINT AS confirmation_min_score,
         'https://rules.example.org/' || l_suppkey || '/' || l_partkey AS source_url, 'row:' || l_linenumber AS source_locator,
         l_shipdate AS checked_at, l_linestatus = 'F' AS is_verified,
         CASE WHEN l_linestatus = 'F' THEN 'verified' ELSE 'draft' END AS verification_status, l_returnflag <> 'R' AS is_active
  FROM lineitem JOIN programs ON programs.id = l_orderkey),
policies AS (
  SELECT s_suppkey AS id, s_nationkey::BIGINT * 10000 + 1995 + floor(abs(s_acctbal) / 2000)::BIGINT AS admission_campaign_id,
         CASE WHEN s_acctbal < 1000 THEN s_suppkey END AS university_program_id,
         CASE WHEN s_acctbal > 6000 THEN 'general' ELSE 'bvi' END AS policy_kind, s_name AS description,
         'https://policy.example.org/' || s_suppkey AS source_url,
         make_timestamp(floor(s_acctbal)::BIGINT * 1000 * 1000000) AS checked_at, s_acctbal > 0 AS is_verified
  FROM supplier),
profiles AS (
  SELECT p_partkey AS id, p_brand AS olympiad_id, 'Contest ' || p_brand AS title, 'brand' AS kind,
         CASE WHEN p_brand < 'Brand#2' THEN 'student' ELSE 'school' END AS audience, p_name AS profile_title,
         CASE WHEN p_size <= 30 THEN ceil(p_size / 10.0) END::SMALLINT AS level,
         CASE WHEN p_retailprice > 905 THEN 'approved' ELSE 'draft' END AS approval_status,
         'https://part.example.org/' || p_partkey AS source_url, p_size < 48 AS is_active
  FROM part),
subjects AS (
  SELECT i::SMALLINT AS id, lower(n) AS code, n AS name
  FROM (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD', 'OTHER']) AS n, generate_subscripts([1,2,3,4,5,6,7], 1) AS i)),
bridge AS (
  SELECT p_partkey AS olympiad_profile_id, subjects.id AS subject_id FROM part JOIN subjects ON p_type = name WHERE p_size <> 13
  UNION ALL SELECT p_partkey, 7::SMALLINT FROM part WHERE p_size > 40)
"""
