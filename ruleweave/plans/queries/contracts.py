"""Contracts over orders and lines."""

from pyspark.sql import functions as F

from ruleweave.operators import contracts as ct
from ruleweave.plans.queries.base import Source, query


@query(
    "contract_violations",
    """
    WITH checked AS (
      SELECT o_orderkey, [CASE WHEN trim(coalesce(nullif(o_orderpriority, '5-LOW'), '')) = '' THEN 'missing_priority' END,
        CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unsupported_status' END,
        CASE WHEN o_totalprice NOT BETWEEN 1000 AND 400000 THEN 'out_of_range_price' END,
        CASE WHEN (o_orderstatus = 'F') <> (o_totalprice > 200000) THEN 'cross_column' END] AS v FROM orders)
    SELECT o_orderkey, violation FROM (SELECT o_orderkey, unnest(v) AS violation FROM checked) WHERE violation IS NOT NULL
    """,
)
def contract_violations(s: Source):
    rows = s.orders.select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )
    rules = (
        ct.required("priority") | ct.one_of("status", ("F", "O")) | ct.in_range("price", 1000, 400000)
        | {"cross_column": (F.col("status") == "F") != (F.col("price") > 200000)}
    )
    return ct.violations(rows, rules, ["o_orderkey"])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(s: Source):
    return ct.duplicate_keys(s.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "missing_parents",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def missing_parents(s: Source):
    return ct.missing_parents(s.orders, s.lineitem, "o_orderkey", "l_orderkey")


@query(
    "zero_row_guard",
    """
    WITH parsed AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
    current AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')
    SELECT * FROM current WHERE l_suppkey NOT IN (SELECT l_suppkey FROM parsed) UNION ALL SELECT * FROM parsed
    """,
)
def zero_row_guard(s: Source):
    lines = s.lineitem.select("l_suppkey", "l_partkey", "l_shipdate")
    attempted = s.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    parsed = lines.filter("l_shipdate >= TIMESTAMP_NTZ '2001-10-01'").drop("l_shipdate").join(attempted, "l_suppkey", "left_semi")
    current = lines.filter("l_shipdate < TIMESTAMP_NTZ '1996-01-01'").drop("l_shipdate")
    return ct.zero_row_guard(current, parsed, attempted, "l_suppkey")
