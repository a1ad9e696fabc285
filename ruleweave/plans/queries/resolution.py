"""Title containment, unique resolution, gates and the whole publication run."""

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ruleweave import vocab
from ruleweave.operators import resolve as r
from ruleweave.plans.publish import PUBLISHED, READ, outcomes, publish_queue, publish_release, summary
from ruleweave.plans.queries.base import CATALOGUE_SQL, Source, catalogue, deal, query
from ruleweave.plans.queries.scalars import sql_tokens
from ruleweave.schemas import TABLES
from ruleweave.session import cut_lineage, shared_folder, stored
from ruleweave.sources import releases

# Both sides are folded to single-space tokens, so presence is plain containment in padded text.
HITS = f"""
folded AS (SELECT doc_id, ' ' || {sql_tokens('text')} || ' ' AS f FROM documents),
titles AS (SELECT item_id, ' ' || {sql_tokens('text')} || ' ' AS t FROM benchmark),
hits AS (SELECT doc_id, item_id FROM folded JOIN titles ON contains(f, t))
"""


@query("title_match_join", f"WITH {HITS} SELECT doc_id, item_id FROM hits")
def title_match_join(s: Source):
    aliases = r.alias_table(s.benchmark, "item_id", "text", prefixes=(), generic=())
    hits = r.title_hits(s.dealt("documents", "doc_id", "text"), "doc_id", "text", aliases)
    return hits.select(F.col("text_key").alias("doc_id"), F.col("title_key").alias("item_id"))


# Each passage is the title of three profiles, whose own names occur in the document or not.
PROFILES = f"""
named AS (
  SELECT item_id * 3 + n AS profile_id, item_id, n AS level, {sql_tokens('text')} AS t, string_split({sql_tokens('text')}, ' ') AS w
  FROM benchmark, range(0, 3) AS g(n)),
profiles AS (
  SELECT *, CASE WHEN level = 0 OR (level = 1 AND length(w[1]) > 3) THEN w[1] || ' ' || w[2] || ' ' || w[3] WHEN length(w[2]) > 3 THEN 'absent profile' ELSE w[2] END AS p FROM named),
judged AS (
  SELECT doc_id, profile_id, level, length(p) >= 5 AND contains(f, p) AS has FROM hits JOIN profiles USING (item_id) JOIN folded USING (doc_id)),
counted AS (SELECT doc_id, count(*) AS title_hits, count(*) FILTER (WHERE has) AS profile_hits, min(profile_id) FILTER (WHERE has) AS only_id FROM judged GROUP BY doc_id),
matched AS (
  SELECT doc_id, lang, coalesce(title_hits, 0) AS title_hits, coalesce(profile_hits, 0) AS profile_hits,
         CASE WHEN profile_hits = 1 THEN 'resolved' WHEN profile_hits > 1 OR title_hits > 1 THEN 'ambiguous' ELSE 'unresolved' END AS match_status,
         CASE WHEN title_hits IS NULL THEN 'no_rsosh_title' WHEN profile_hits = 1 THEN 'title_and_profile' WHEN profile_hits > 1 THEN 'multiple_profiles_in_candidate'
              WHEN title_hits = 1 THEN 'title_without_profile' ELSE 'title_has_multiple_profiles' END AS match_reason,
         CASE WHEN profile_hits = 1 THEN only_id END AS matched_profile_id
  FROM documents LEFT JOIN counted USING (doc_id))
"""


def _profiles(s: Source) -> DataFrame:
    from ruleweave.functions.text import fold_tokens

    words = F.split(fold_tokens("text"), " ")
    head = F.array_join(F.slice(words, 1, 3), " ")
    name = F.when((F.col("level") == 0) | ((F.col("level") == 1) & (F.length(words[0]) > 3)), head).when(
        F.length(words[1]) > 3, "absent profile"
    ).otherwise(words[1])
    return s.benchmark.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        (F.col("item_id") * 3 + F.col("level")).alias("profile_id"), F.col("text").alias("title"), name.alias("profile_title"), "level"
    )


def matched(s: Source) -> DataFrame:
    docs = s.documents.select("doc_id", "lang", "text")
    return r.catalogue_match(docs, "doc_id", "text", _profiles(s), prefixes=(), generic=(), spread=deal)


@query("catalog_match", f"WITH {HITS}, {PROFILES} SELECT doc_id, title_hits, profile_hits, match_status, match_reason, matched_profile_id FROM matched")
def catalog_match(s: Source):
    return matched(s).select("doc_id", "title_hits", "profile_hits", "match_status", "match_reason", "matched_profile_id")


@query("match_summary", f"WITH {HITS}, {PROFILES} SELECT lang, match_status, match_reason, count(*) AS n FROM matched GROUP BY ALL")
def match_summary(s: Source):
    return matched(s).groupBy("lang", "match_status", "match_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "match_alternatives",
    f"""
    WITH {HITS}, {PROFILES},
    unclear AS (SELECT doc_id FROM matched WHERE match_status = 'ambiguous'),
    choices AS (
      SELECT DISTINCT j.doc_id, t.t AS title, CASE WHEN m.profile_hits > 0 THEN p END AS name
      FROM judged j JOIN unclear USING (doc_id) JOIN matched m USING (doc_id) JOIN profiles USING (profile_id) JOIN titles t USING (item_id)
      WHERE m.profile_hits = 0 OR has)
    SELECT doc_id, md5(trim(title)) AS title, name, NULL::BIGINT AS profile_id FROM choices
    UNION ALL SELECT NULL, md5(trim(t)), p, profile_id FROM profiles
    """,
)
def match_alternatives(s: Source):
    found, profiles = matched(s), _profiles(s)
    unclear = cut_lineage(found.filter("match_status = 'ambiguous'").select("doc_id"))
    texts = stored(r.rows_of(s.documents.select("doc_id", "text"), ["doc_id"], unclear))
    choices, classes = r.alternatives(texts, "doc_id", "text", profiles, prefixes=(), generic=(), spread=deal)
    both = choices.withColumn("profile_id", F.lit(None).cast("long")).unionByName(classes.withColumn("doc_id", F.lit(None).cast("long")))
    return both.select("doc_id", F.md5("title_key").alias("title"), "name", "profile_id")


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


# Parts as competitions under the official kinds of title, and texts that name them with and without the kind.
OWN = f"""
WITH named AS (SELECT p_name, p_type, min(p_partkey) AS profile_id FROM part GROUP BY ALL),
profs AS (
  SELECT profile_id, {sql_tokens('p_type')} AS p, {sql_tokens("CASE length(p_name) % 4 WHEN 0 THEN 'Всероссийская олимпиада школьников «' || p_name || '»' WHEN 1 THEN 'Олимпиада ' || p_name WHEN 2 THEN 'Открытая олимпиада школьников' ELSE p_name || ' ' || p_type END")} AS t FROM named),
shorts AS (SELECT DISTINCT t, unnest(list_append(list_transform(list_filter({_sql_list(vocab.TITLE_PREFIXES)}, lambda x: starts_with(t, x)), lambda x: trim(substr(t, length(x) + 1))), t)) AS a FROM profs),
aliases AS (
  SELECT t, a FROM shorts WHERE (a = t OR (length(a) >= {vocab.MIN_ALIAS_LENGTH} AND contains(a, ' ')))
    AND coalesce(list_sum(list_transform(list_filter(string_split(a, ' '), lambda w: NOT list_contains({_sql_list(vocab.GENERIC_TITLE_WORDS)}, w)), lambda w: length(w))), 0) >= {vocab.MIN_DISTINCTIVE}),
texts AS (
  SELECT p_partkey, {sql_tokens("CASE p_size % 3 WHEN 0 THEN 'Всесибирская открытая олимпиада школьников | ' || p_name WHEN 1 THEN p_name || ' | ' || p_type || ' | БВИ' ELSE 'Олимпиада «' || p_name || '» даёт 100 баллов: ' || p_type END")} AS f FROM part),
hits AS (SELECT DISTINCT p_partkey, f, t FROM texts JOIN aliases ON contains(' ' || f || ' ', ' ' || a || ' ')),
judged AS (SELECT p_partkey, count(*) AS title_hits, count(*) FILTER (WHERE length(p) >= 5 AND contains(f, p)) AS profile_hits,
                  min(profile_id) FILTER (WHERE length(p) >= 5 AND contains(f, p)) AS only_id FROM hits JOIN profs USING (t) GROUP BY ALL)
"""


@query(
    "own_titles",
    OWN + """
    SELECT p_partkey, coalesce(title_hits, 0) AS title_hits, coalesce(profile_hits, 0) AS profile_hits,
           CASE WHEN profile_hits = 1 THEN 'resolved' WHEN profile_hits > 1 OR title_hits > 1 THEN 'ambiguous' ELSE 'unresolved' END AS match_status,
           CASE WHEN profile_hits = 1 THEN only_id END AS matched_profile_id
    FROM part LEFT JOIN judged USING (p_partkey)
    """,
)
def own_titles(s: Source):
    """Titles matched with the official prefixes and generic words."""
    quoted = lambda head, tail: F.concat(F.lit(head), "p_name", F.lit(tail))
    kind = F.length("p_name") % 4
    title = F.when(kind == 0, quoted("Всероссийская олимпиада школьников «", "»")).when(kind == 1, quoted("Олимпиада ", "")).when(
        kind == 2, "Открытая олимпиада школьников"
    ).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    named = s.part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("profile_id"))
    profiles = named.select("profile_id", title.alias("title"), F.col("p_type").alias("profile_title"), F.lit(1).alias("level"))
    text = F.when(F.col("p_size") % 3 == 0, quoted("Всесибирская открытая олимпиада школьников | ", "")).when(
        F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" | "), "p_type", F.lit(" | БВИ"))
    ).otherwise(F.concat(F.lit("Олимпиада «"), "p_name", F.lit("» даёт 100 баллов: "), "p_type"))
    found = r.catalogue_match(s.part.select("p_partkey", text.alias("text")), "p_partkey", "text", profiles)
    return found.select("p_partkey", "title_hits", "profile_hits", "match_status", "matched_profile_id")


SELECTORS = """
programmes AS (
  SELECT p_brand AS scope, p_partkey AS programme_id, printf('%02d.03.%02d', p_size, p_size) AS external_code, p_name AS name,
         CASE WHEN p_type = 'PROMO' THEN 'code_only' ELSE 'named_verified' END AS catalogue_status FROM part),
candidates AS (
  SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS scope,
         CASE WHEN l_returnflag = 'A' THEN printf('%02d.03.%02d', p_size, p_size) WHEN l_returnflag = 'N' THEN '«' || upper(p_name) || '»'
              WHEN l_linestatus = 'F' THEN 'Программа ' || p_type || ' ' || p_size ELSE printf('%02d.05.%02d', p_size, p_size) END AS selector
  FROM lineitem JOIN part ON l_partkey = p_partkey),
code_scopes AS (SELECT scope, external_code, count(*) AS n, min(programme_id) AS id FROM programmes WHERE catalogue_status = 'code_only' GROUP BY ALL),
names AS (
  SELECT scope, k, count(*) AS n, min(programme_id) AS id FROM (
    SELECT scope, programme_id, name AS k FROM programmes UNION SELECT scope, programme_id, replace(external_code, '.', ' ') FROM programmes) GROUP BY ALL),
resolved AS (
  SELECT c.*, CASE WHEN s.n = 1 THEN s.id WHEN s.n IS NULL AND m.n = 1 THEN m.id END AS programme_id
  FROM candidates c LEFT JOIN code_scopes s ON s.scope = c.scope AND s.external_code = c.selector
  LEFT JOIN names m ON m.scope = c.scope AND m.k = trim(replace(replace(replace(lower(selector), '.', ' '), '«', ''), '»', '')))
"""


def _selectors(s: Source) -> tuple[DataFrame, DataFrame]:
    size = F.format_string("%02d", "p_size")
    programmes = s.part.select(
        F.col("p_brand").alias("scope"), F.col("p_partkey").alias("programme_id"), F.concat(size, F.lit(".03."), size).alias("external_code"),
        F.col("p_name").alias("name"), F.when(F.col("p_type") == "PROMO", "code_only").otherwise("named_verified").alias("catalogue_status"),
    )
    selector = (
        F.when(F.col("l_returnflag") == "A", F.concat(size, F.lit(".03."), size))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("«"), F.upper("p_name"), F.lit("»")))
        .when(F.col("l_linestatus") == "F", F.concat_ws(" ", F.lit("Программа"), "p_type", F.col("p_size").cast("string")))
        .otherwise(F.concat(size, F.lit(".05."), size))
    )
    candidates = s.lineitem.join(s.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("p_brand").alias("scope"), selector.alias("selector")
    )
    return candidates, programmes


@query("unique_resolve", f"WITH {SELECTORS} SELECT l_orderkey, l_linenumber, l_partkey, selector, programme_id FROM resolved")
def unique_resolve(s: Source):
    candidates, programmes = _selectors(s)
    return r.unique_programme(candidates, "selector", programmes, ["scope"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "selector", "programme_id"
    )


@query(
    "create_missing_dim",
    f"""
    WITH {SELECTORS}
    SELECT DISTINCT scope, selector AS external_code, 'Направление ' || selector AS name, 'code_only' AS catalogue_status,
           CASE WHEN split_part(selector, '.', 2) = '05' THEN 'specialist' ELSE 'bachelor' END AS degree_level
    FROM resolved r WHERE programme_id IS NULL AND regexp_full_match(selector, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}')
      AND NOT EXISTS (SELECT 1 FROM code_scopes s WHERE s.scope = r.scope AND s.external_code = r.selector)
    UNION ALL
    SELECT DISTINCT scope, NULL, selector, 'named_verified', 'bachelor' FROM resolved WHERE programme_id IS NULL AND selector LIKE 'Программа%'
    """,
)
def create_missing_dim(s: Source):
    candidates, programmes = _selectors(s)
    found = r.unique_programme(candidates, "selector", programmes, ["scope"]).filter("programme_id IS NULL")
    named = found.withColumn("named", F.when(F.col("selector").like("Программа%"), F.col("selector")))
    return r.missing_scopes(named, "selector", "named", programmes, ["scope"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "gate_reasons",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'generic_source_without_explicit_table_proof'
                WHEN l_quantity > 40 THEN 'strict_confidence_required' WHEN l_tax = 0 THEN 'missing_location_scope'
                WHEN l_discount > 0.08 THEN 'missing_explicit_identity' WHEN l_linenumber > 5 THEN 'missing_explicit_diploma_status'
                WHEN l_linenumber = 1 THEN 'missing_explicit_benefit_kind' END AS reason
    FROM lineitem
    """,
)
def gate_reasons(s: Source):
    reason = r.gate_reason(
        F.when(F.col("l_returnflag") == "A", "requests-bs4-keyword-v1").when(F.col("l_returnflag") == "N", "strict-hse-2026-v1"),
        F.when(F.col("l_linestatus") == "F", "table_row").otherwise("automatic_explicit_table_row"),
        F.when(F.col("l_quantity") <= 40, 100).otherwise(72), F.nullif("l_tax", F.lit(0.0)),
        [F.lit("programme"), F.lit("title"), F.when(F.col("l_discount") <= 0.08, "profile").otherwise("")],
        F.when(F.col("l_linenumber") > 5, "finalist").otherwise("winner"),
        F.when(F.col("l_linenumber") != 1, "bvi").otherwise("individual_points"),
    )
    return s.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", reason.alias("reason"))


# One candidate per order with lines: its own programme, and the profile of its first part.
RUN = CATALOGUE_SQL + f"""
, firsts AS (SELECT l_orderkey, min(l_partkey) AS part_id FROM lineitem GROUP BY 1),
candidates AS (
  SELECT o_orderkey AS candidate_id, o_custkey AS location_id, 'Contest ' || p_brand || ' | ' || p_name AS identity, p_size,
         CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%d.%m.%y') WHEN '5-LOW' THEN 'unknown programme' ELSE o_orderpriority || ' ' || o_orderkey END AS selector,
         o_orderpriority <> '2-HIGH' OR o_orderstatus <> 'P' AS sure, CASE WHEN p_size <= 30 THEN ceil(p_size / 10.0) END AS level, o_totalprice
  FROM orders JOIN firsts ON l_orderkey = o_orderkey JOIN part ON p_partkey = part_id),
active AS (SELECT * FROM programs WHERE is_active),
code_scopes AS (SELECT university_location_id AS l, external_code AS k, count(*) AS n FROM active WHERE catalogue_status = 'code_only' GROUP BY ALL),
names AS (SELECT l, k, count(*) AS n FROM (
    SELECT university_location_id AS l, id, {sql_tokens('name')} AS k FROM active
    UNION SELECT university_location_id, id, {sql_tokens('external_code')} FROM active WHERE external_code IS NOT NULL) GROUP BY ALL),
placed AS (
  SELECT c.*, CASE WHEN s.n > 1 THEN FALSE WHEN s.n = 1 OR m.n = 1 THEN TRUE
              WHEN s.n IS NULL AND regexp_full_match(selector, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}') THEN TRUE ELSE FALSE END AS has_programme
  FROM candidates c LEFT JOIN code_scopes s ON s.l = location_id AND s.k = selector LEFT JOIN names m ON m.l = location_id AND m.k = {sql_tokens('selector')}),
catalog AS (SELECT id, ' ' || {sql_tokens('title')} || ' ' AS t, {sql_tokens('profile_title')} AS p, level FROM profiles WHERE approval_status = 'approved' AND is_active),
identities AS (SELECT DISTINCT identity, ' ' || {sql_tokens('identity')} || ' ' AS f FROM candidates),
hits AS (SELECT identity, count(*) AS titles, count(*) FILTER (WHERE length(p) >= 5 AND contains(f, p)) AS n,
                min(id) FILTER (WHERE length(p) >= 5 AND contains(f, p)) AS profile_id FROM identities JOIN catalog ON contains(f, t) GROUP BY ALL),
judged AS (
  SELECT candidate_id, CASE WHEN NOT sure THEN 'strict_confidence_required' WHEN location_id = 0 THEN 'missing_location_scope' WHEN NOT has_programme THEN 'programme_not_exactly_mapped_for_location'
           WHEN titles IS NULL THEN 'rsosh_no_rsosh_title' WHEN n > 1 THEN 'rsosh_multiple_profiles_in_candidate'
           WHEN n = 0 AND titles = 1 THEN 'rsosh_title_without_profile' WHEN n = 0 THEN 'rsosh_title_has_multiple_profiles'
           WHEN o_totalprice > 250000 AND catalog.level IS DISTINCT FROM 1 THEN 'rsosh_level_mismatch' END AS reason,
         CASE WHEN sure AND location_id <> 0 AND has_programme AND n = 1 THEN hits.profile_id END AS matched_profile_id
  FROM placed LEFT JOIN hits USING (identity) LEFT JOIN catalog ON catalog.id = hits.profile_id)
"""


def _candidates(s: Source, *more: Column) -> DataFrame:
    firsts = s.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    owner = s.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("university_id"))
    orders = s.orders.join(firsts, F.col("o_orderkey") == F.col("l_orderkey")).join(s.part, "p_partkey").join(owner, "o_custkey")
    selector = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "dd.MM.yy"))
        .when(F.col("o_orderpriority") == "5-LOW", "unknown programme")
        .otherwise(F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")))
    )
    sure = (F.col("o_orderpriority") != "2-HIGH") | (F.col("o_orderstatus") != "P")
    return orders.select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("university_location_id"), "university_id",
        F.lit("strict-mephi-2026-v1").alias("adapter_code"), F.lit("strict_table_row").alias("payload_kind"),
        F.when(sure, 100).otherwise(72).alias("confidence"), selector.alias("raw_programme_name"),
        F.concat(F.lit("Contest "), "p_brand").alias("raw_olympiad_name"), F.col("p_name").alias("raw_profile_name"),
        F.lit("winner").alias("suggested_diploma_status"), F.lit("bvi").alias("suggested_benefit_kind"),
        F.when(F.col("o_totalprice") > 250000, 1).cast("short").alias("suggested_olympiad_level"), F.lit(2026).alias("catalogue_year"),
        F.col("o_orderdate").alias("created_at"), F.lit("pending").alias("review_status"), F.lit("pending_resolution").alias("automatic_status"), *more,
    )


def _judged(s: Source) -> DataFrame:
    return outcomes(catalogue(s), publish_queue(_candidates(s)))[0]


@query("publish_run", RUN + "SELECT candidate_id, reason, matched_profile_id FROM judged")
def publish_run(s: Source):
    return _judged(s).select("candidate_id", "reason", "matched_profile_id")


@query("publish_summary", RUN + "SELECT CASE WHEN reason IS NULL THEN 'published' ELSE 'blocked' END AS outcome, coalesce(reason, '') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def publish_summary(s: Source):
    return summary(_judged(s))


def _rejected_by_hand(order: Column) -> Column:
    return order % 7 == 0


def _base_rules(candidates: DataFrame, order: Column) -> DataFrame:
    """What is known already: hand-made rules, rules of an earlier run, and such that a reviewer rejected."""
    base = candidates.filter(order % 5 < 3)
    by_hand, rejected = order % 5 == 0, order % 5 == 2
    own = {
        "id": order, "admission_campaign_id": F.col("admission_campaign_id"), "university_program_id": order,
        "olympiad_profile_id": F.col("first_part"), "diploma_status": F.lit("winner"), "benefit_kind": F.lit("bvi"),
        "source_url": F.lit("https://old.example.org/"), "source_document_id": F.lit(-1), "checked_at": F.lit(EARLIER),
        "is_verified": ~rejected, "verification_status": F.when(rejected, "rejected").otherwise("verified"), "is_active": ~rejected,
        "publication_method": F.when(by_hand, "manual").otherwise("strict_adapter"),
        "verified_by": F.when(by_hand, "editor").otherwise("strict-adapter:earlier"),
    }
    return _as("benefit_rules", base, own)


def _as(name: str, frame: DataFrame, own: dict[str, Column]) -> DataFrame:
    return frame.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])


EARLIER, NOW = "2026-02-01 00:00:00", "2026-03-01 00:00:00"


def _published(s: Source) -> dict[str, DataFrame]:
    """The publication job on stored tables, run twice: the second time must leave the release as it is."""
    t = dict(catalogue(s))
    campaign = F.col("university_id") * 10000 + 1996
    # Candidates, rules, reviews and observations are made of it: without a cut each would read the lines anew.
    judged = stored(_candidates(s, F.col("p_partkey").alias("first_part")).withColumn("admission_campaign_id", campaign))
    customer, key = s.customer.select("c_custkey"), F.col("c_custkey")
    t["admission_source_targets"] = _as("admission_source_targets", customer, {
        "id": key, "university_location_id": key, "adapter_config": F.lit('{"rsosh_catalogue_year": 2026}')})
    t["admission_parse_runs"] = _as("admission_parse_runs", customer, {
        "id": key, "adapter_code": F.lit("strict-mephi-2026-v1"), "admission_source_target_id": key})
    t["source_documents"] = _as("source_documents", customer, {"id": key, "url": F.concat(F.lit("https://rules.example.org/"), key)})
    order = F.col("candidate_id")
    t["admission_rule_candidates"] = _as("admission_rule_candidates", judged, {name: F.col(name) for name in judged.columns} | {
        "id": order, "admission_parse_run_id": F.col("university_location_id"), "source_document_id": F.col("university_location_id"),
        "candidate_key": order.cast("string"), "source_locator": F.lit("markdown:line:1"), "raw_payload": F.lit("{}"),
        "match_status": F.lit("unresolved"), "review_status": F.when(_rejected_by_hand(order), "rejected").otherwise("pending")})
    t["benefit_rules"] = _base_rules(judged, order)
    t["admission_rule_reviews"] = _as("admission_rule_reviews", judged.filter(_rejected_by_hand(order)), {
        "id": order, "admission_rule_candidate_id": order, "action": F.lit("rejected"), "reviewer_id": F.lit("editor")})
    t["benefit_rule_observations"] = _as("benefit_rule_observations", judged.filter(order % 5 < 3), {
        "benefit_rule_id": order, "source_document_id": F.when(order % 2 == 0, F.col("university_location_id")).otherwise(-1),
        "observed_status": F.lit("missing"), "observed_at": F.lit(EARLIER)})
    t["olympiads"] = _as("olympiads", t["olympiads"], {name: F.col(name) for name in t["olympiads"].columns})
    root, names = f"{shared_folder(s.spark)}/published-{uuid.uuid4().hex}", PUBLISHED + READ
    releases.commit(s.spark, root, {name: _whole(name, t[name]) for name in names}, 0)
    now = F.lit(NOW).cast("timestamp")
    first, second = publish_release(s.spark, root, now), publish_release(s.spark, root, now)
    if (first, second) != (2, 2):
        raise RuntimeError(f"one commit expected, got releases {first} and {second}")
    done = releases.read(s.spark, root)
    named = done["university_programs"].join(s.orders.select(F.col("o_orderkey").alias("id")).withColumn("known", F.lit(True)), "id", "left")
    fresh = F.concat_ws(" ", F.lit("new"), "university_location_id", "external_code")
    programme = F.when(F.col("known"), F.concat(F.lit("p"), F.col("id").cast("string"))).otherwise(fresh)
    return done | {"named": named.select(F.col("id").alias("university_program_id"), programme.alias("programme"))}


def _whole(name: str, frame: DataFrame) -> DataFrame:
    return _as(name, frame, {column: F.col(column) for column in frame.columns})


# Programme of each publishable candidate, known or made for its code, and the last candidate of each rule.
DONE = RUN + f"""
, scoped AS (SELECT university_location_id AS l, external_code AS k, count(*) AS n, min(id) AS id FROM active WHERE catalogue_status = 'code_only' GROUP BY ALL),
called AS (SELECT l, k, count(*) AS n, min(id) AS id FROM (
    SELECT university_location_id AS l, id, {sql_tokens('name')} AS k FROM active
    UNION SELECT university_location_id, id, {sql_tokens('external_code')} FROM active WHERE external_code IS NOT NULL) GROUP BY ALL),
judged_rows AS (SELECT * FROM judged WHERE candidate_id % 7 <> 0),
good AS (
  SELECT j.candidate_id, j.matched_profile_id AS profile_id, c.location_id, o_orderdate, university_id * 10000 + 1996 AS campaign_id,
         CASE WHEN s.n = 1 THEN 'p' || s.id WHEN s.n IS NULL AND m.n = 1 THEN 'p' || m.id ELSE 'new ' || c.location_id || ' ' || selector END AS programme
  FROM judged_rows j JOIN candidates c USING (candidate_id) JOIN orders ON o_orderkey = candidate_id JOIN locations ON locations.id = c.location_id
  LEFT JOIN scoped s ON s.l = c.location_id AND s.k = selector LEFT JOIN called m ON m.l = c.location_id AND m.k = {sql_tokens('selector')}
  WHERE j.reason IS NULL),
base AS (
  SELECT o_orderkey AS id, 'p' || o_orderkey AS programme, university_id * 10000 + 1996 AS campaign_id, part_id AS profile_id, o_custkey AS location_id
  FROM orders JOIN firsts ON l_orderkey = o_orderkey JOIN locations ON locations.id = o_custkey WHERE o_orderkey % 5 < 3),
last AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY programme, campaign_id, profile_id ORDER BY o_orderdate DESC, candidate_id DESC) = 1)
"""


@query(
    "publish_rules",
    DONE + f"""
    SELECT coalesce(b.programme, g.programme) AS programme, coalesce(b.campaign_id, g.campaign_id) AS admission_campaign_id,
           coalesce(b.profile_id, g.profile_id) AS olympiad_profile_id,
           CASE WHEN taken THEN g.location_id ELSE -1 END AS source_document_id, CASE WHEN taken THEN 'https://rules.example.org/' || g.location_id ELSE 'https://old.example.org/' END AS source_url,
           CASE WHEN taken THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{EARLIER}' END AS checked_at,
           CASE WHEN b.id % 5 = 2 THEN 'rejected' ELSE 'verified' END AS verification_status, CASE WHEN b.id % 5 = 0 THEN 'manual' ELSE 'strict_adapter' END AS publication_method,
           CASE WHEN taken THEN 'strict-adapter:strict-mephi-2026-v1' WHEN b.id % 5 = 0 THEN 'editor' ELSE 'strict-adapter:earlier' END AS verified_by,
           CASE WHEN taken THEN TRUE ELSE b.id % 5 <> 2 END AS is_active
    FROM (SELECT b, g, g.programme IS NOT NULL AND (b.id IS NULL OR b.id % 5 <> 0) AS taken
          FROM base b FULL OUTER JOIN last g ON b.programme = g.programme AND b.campaign_id = g.campaign_id AND b.profile_id = g.profile_id) AS joined
    """,
)
def publish_rules(s: Source):
    done = _published(s)
    return done["benefit_rules"].join(done["named"], "university_program_id").select(
        "programme", "admission_campaign_id", "olympiad_profile_id", "source_document_id", "source_url",
        F.col("checked_at").cast("timestamp_ntz").alias("checked_at"), "verification_status", "publication_method", "verified_by", "is_active",
    )


@query(
    "publish_observations",
    DONE + f"""
    , seen AS (
      SELECT coalesce(b.id::VARCHAR, programme || '/' || campaign_id || '/' || g.profile_id) AS rule, g.location_id AS document_id, candidate_id
      FROM good g LEFT JOIN base b USING (programme, campaign_id, profile_id)
      QUALIFY row_number() OVER (PARTITION BY rule, document_id ORDER BY o_orderdate DESC, candidate_id DESC) = 1),
    logged AS (SELECT id::VARCHAR AS rule, CASE WHEN id % 2 = 0 THEN location_id ELSE -1 END AS document_id FROM base)
    SELECT CASE WHEN contains(rule, '/') THEN 'new' ELSE rule END AS rule, document_id AS source_document_id, candidate_id AS admission_rule_candidate_id,
           CASE WHEN candidate_id IS NULL THEN 'missing' ELSE 'present' END AS observed_status,
           CASE WHEN candidate_id IS NULL THEN TIMESTAMP '{EARLIER}' ELSE TIMESTAMP '{NOW}' END AS observed_at
    FROM logged FULL OUTER JOIN seen USING (rule, document_id)
    """,
)
def publish_observations(s: Source):
    known = s.orders.select(F.col("o_orderkey").alias("benefit_rule_id"), F.col("o_orderkey").cast("string").alias("rule"))
    log = _published(s)["benefit_rule_observations"].join(known, "benefit_rule_id", "left")
    return log.select(
        F.coalesce("rule", F.lit("new")).alias("rule"), "source_document_id", "admission_rule_candidate_id", "observed_status",
        F.col("observed_at").cast("timestamp_ntz").alias("observed_at"),
    )


@query(
    "publish_reviews",
    DONE + """
    SELECT candidate_id AS admission_rule_candidate_id, 'approved' AS action, 'strict-adapter:strict-mephi-2026-v1' AS reviewer_id FROM good
    UNION ALL SELECT candidate_id, 'rejected', 'editor' FROM candidates WHERE candidate_id % 7 = 0
    """,
)
def publish_reviews(s: Source):
    return _published(s)["admission_rule_reviews"].select("admission_rule_candidate_id", "action", "reviewer_id")


@query(
    "publish_marks",
    RUN + """
    SELECT candidate_id AS id, CASE WHEN candidate_id % 7 = 0 THEN 'rejected' WHEN reason IS NULL THEN 'approved' ELSE 'pending' END AS review_status,
           CASE WHEN candidate_id % 7 = 0 THEN 'pending_resolution' WHEN reason IS NULL THEN 'published' ELSE 'blocked' END AS automatic_status,
           CASE WHEN candidate_id % 7 <> 0 THEN coalesce(reason, 'exact_programme_and_rsosh_profile') END AS automatic_note,
           CASE WHEN reason IS NULL AND candidate_id % 7 <> 0 THEN 'resolved' ELSE 'unresolved' END AS match_status,
           CASE WHEN reason IS NULL AND candidate_id % 7 <> 0 THEN matched_profile_id END AS olympiad_profile_id,
           reason IS NULL AND candidate_id % 7 <> 0 AS has_rule
    FROM judged
    """,
)
def publish_marks(s: Source):
    return _published(s)["admission_rule_candidates"].select(
        "id", "review_status", "automatic_status", "automatic_note", "match_status", "olympiad_profile_id",
        F.col("published_benefit_rule_id").isNotNull().alias("has_rule"),
    )
