"""The queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruleweave.llm import alignment, html_main, lattice, licenses, mixing, packing, pivots, quality, repeats, secret_scan, simhash, subspaces, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op7_simhash_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_secret_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents")))


OP1_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source),
q AS (SELECT source, n, greatest(1, round(weight * 512 / (SELECT sum(weight) FROM n)))::BIGINT AS q FROM n),
s AS (SELECT list({'source': source, 'n': n, 'q': q} ORDER BY source NULLS FIRST) AS s FROM q),
marks AS (SELECT DISTINCT unnest([0, n // q, n // q + 1]) AS first FROM q),
runs AS (SELECT first, lead(first) OVER (ORDER BY first) AS stop FROM marks),
made AS (SELECT first, stop, list_filter(list_transform(s, lambda x: {'source': x.source, 'c': greatest(0, least(x.q, x.n - first * x.q))}),
                                         lambda p: p.c > 0) AS parts FROM runs, s WHERE stop IS NOT NULL),
sized AS (SELECT *, list_sum(list_transform(parts, lambda p: p.c))::BIGINT AS size FROM made WHERE len(parts) > 0),
segments AS (SELECT *, coalesce(sum((stop - first) * size) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM sized),
fold AS (
  SELECT first, parts, size, -1::BIGINT AS slot, list_transform(parts, lambda p: 0::BIGINT) AS done, 0::BIGINT AS i FROM segments
  UNION ALL
  SELECT first, parts, size, slot + 1, list_transform(done, lambda d, k: CASE WHEN k = best THEN d + 1 ELSE d END), best FROM (
    SELECT *, list_min(list_transform(range(1, len(parts) + 1), lambda k: CASE
      WHEN done[k] < parts[k].c AND done[k] * size // parts[k].c <= slot + 1
      THEN ((done[k] + 1) * size + parts[k].c - 1) // parts[k].c * 1000000 + k END)) % 1000000 AS best
    FROM fold WHERE slot + 1 < size)),
slots AS (SELECT first, parts[i].source AS source, done[i] - 1 AS turn, slot FROM fold WHERE slot >= 0),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn FROM documents)
SELECT p.doc_id, p.source, p.turn, (g.base + (p.turn // q.q - g.first) * g.size + t.slot)::BIGINT AS position
FROM placed p JOIN q ON p.source IS NOT DISTINCT FROM q.source
JOIN segments g ON p.turn // q.q >= g.first AND p.turn // q.q < g.stop
JOIN slots t ON t.first = g.first AND t.source IS NOT DISTINCT FROM p.source AND t.turn = p.turn % q.q
"""


@query("op1_mix_sources", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op8_pack_windows")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, folder, "documents")))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op4_top_k_search", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op2_embedding_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"))


@query("op6_html_main_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return html_main.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op10_license_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
f AS (SELECT doc_id, p, p > coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, -1) AS new
      FROM w JOIN m USING (s) WHERE doc_id > least),
g AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM f),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, a AS stop, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n, n FROM d)),
t AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start, stop) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce((SELECT sum(b - a) FROM r WHERE r.doc_id = d.doc_id), 0)::BIGINT AS n_removed,
       (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN t USING (doc_id)
"""


@query("op5_suffix_dedup", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, folder, "documents")))


#: floor(256 * x), 16 parts, two rounds from the 64 smallest vec_ids; a NULL entry is one that nothing uses.
OP11_SQL = """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, list_slice(x, p * len(x) // 16 + 1, (p + 1) * len(x) // 16) AS x FROM v, unnest(range(16)) AS t(p)),
c0 AS (SELECT p, r AS e, x AS c FROM x WHERE r < 64),
{assign_0}, {mean_1}, {assign_1}, {mean_2}, {assign_2},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), sha
"""
ASSIGN = """a{n} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x FROM (
  SELECT r, x.p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{n} AS c ON c.p = x.p) GROUP BY r, p)"""
MEAN = """c{n} AS MATERIALIZED (SELECT p, e, coalesce(any_value(m.c), any_value(o.c)) AS c FROM c{o} AS o LEFT JOIN (
  SELECT p, e, list((CASE WHEN s < 0 THEN -((n - 1 - s) // n) ELSE s // n END)::BIGINT ORDER BY i) AS c FROM (
    SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{o}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e) AS m USING (p, e) GROUP BY p, e)"""
OP11_SQL = OP11_SQL.format(
    **{f"assign_{n}": ASSIGN.format(n=n) for n in range(3)}, **{f"mean_{n}": MEAN.format(n=n, o=n - 1) for n in (1, 2)}
)


@query("op11_vector_codes", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return subspaces.encode(table(spark, folder, "embeddings"))


@query("op13_pivot_search")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    measures, _ = alignment.align(table(spark, folder, "documents"))
    return measures
