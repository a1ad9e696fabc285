"""Reads of the verified catalogue."""

from pyspark.sql import functions as F

from ruleweave.plans import catalog as c
from ruleweave.plans.queries.base import CATALOGUE_SQL, Source, catalogue, query

LISTED = """
, listed AS (
  SELECT u.code AS university_code, u.name AS university_name, l.code AS location_code, l.name AS location_name,
         l.location_type, l.city, l.region, l.country, l.official_url, l.directory_url, l.admission_status,
         l.location_checked_at, l.admission_checked_at, k.rules_url AS campaign_rules_url,
         p.description AS verified_policy_description, p.source_url AS verified_policy_source_url,
         count(r.admission_campaign_id) FILTER (WHERE r.is_active AND r.verification_status = 'verified') AS verified_benefits_count
  FROM locations l
  JOIN universities u ON u.id = l.university_id
  LEFT JOIN campaigns k ON k.university_id = u.id AND k.campaign_year = 1998
  LEFT JOIN LATERAL (
    SELECT description, source_url FROM policies a
    WHERE a.admission_campaign_id = k.id AND a.university_program_id IS NULL AND a.is_verified
    ORDER BY (a.policy_kind = 'general') DESC, a.checked_at DESC, a.description DESC LIMIT 1) p ON TRUE
  LEFT JOIN programs g ON g.university_location_id = l.id AND g.is_active
  LEFT JOIN rules r ON r.university_program_id = g.id AND r.admission_campaign_id = k.id
  WHERE l.is_active AND u.is_active
  GROUP BY ALL)
"""


@query("locations_with_counts", CATALOGUE_SQL + LISTED + "SELECT * FROM listed")
def locations_with_counts(s: Source):
    return c.search_locations(catalogue(s), 1998, limit=None)


@query(
    "faceted_search",
    CATALOGUE_SQL + LISTED + """
    SELECT location_code, location_name, region, location_type, verified_benefits_count FROM listed
    WHERE concat_ws(' ', university_name, location_name, city, region, country) ILIKE '%00%2 mach%' AND region = 'MACHINERY'
      AND location_type = 'online'
    ORDER BY university_name, (location_type = 'main') DESC, location_name, location_code LIMIT 200
    """,
)
def faceted_search(s: Source):
    found = c.search_locations(catalogue(s), 1998, q="  00%2   mach ", region="MACHINERY", location_type="online")
    return found.select("location_code", "location_name", "region", "location_type", "verified_benefits_count")


PROGRAMMES = """
SELECT u.code AS university_code, u.name AS university_name, l.code AS university_location_code, l.name AS location_name,
       g.external_code, g.name AS programme_name, g.catalogue_status, g.degree_level,
       count(r.admission_campaign_id) FILTER (WHERE r.is_active AND r.verification_status = 'verified') AS verified_benefits_count,
       coalesce(g.catalogue_source_url,
                min(r.source_url) FILTER (WHERE r.is_active AND r.verification_status = 'verified'),
                l.admission_rules_url, l.official_url) AS source_url,
       strftime(coalesce(g.catalogue_checked_at,
                max(r.checked_at) FILTER (WHERE r.is_active AND r.verification_status = 'verified'),
                l.admission_checked_at, l.location_checked_at), '%Y-%m-%d') AS checked_at
FROM locations l
JOIN universities u ON u.id = l.university_id
JOIN programs g ON g.university_location_id = l.id AND g.is_active
LEFT JOIN campaigns k ON k.university_id = u.id AND k.campaign_year = 1998
LEFT JOIN rules r ON r.university_program_id = g.id AND r.admission_campaign_id = k.id
WHERE l.is_active AND u.is_active
GROUP BY u.code, u.name, l.code, l.name, g.id, g.external_code, g.name, g.catalogue_status, g.degree_level,
         g.catalogue_source_url, g.catalogue_checked_at, l.admission_rules_url, l.official_url, l.admission_checked_at,
         l.location_checked_at
"""


@query("programme_listing", CATALOGUE_SQL + PROGRAMMES)
def programme_listing(s: Source):
    return c.programmes(catalogue(s), 1998)


@query(
    "profile_discovery",
    CATALOGUE_SQL + """
    SELECT p.id AS profile_id, p.title, p.kind, p.profile_title, p.level, p.source_url,
           coalesce(array_to_string(list_sort(list(DISTINCT j.code) FILTER (WHERE j.code IS NOT NULL)), ','), '') AS subject_codes,
           coalesce(array_to_string(list_sort(list(DISTINCT j.name) FILTER (WHERE j.name IS NOT NULL)), ','), '') AS subject_names,
           EXISTS (SELECT 1 FROM events e WHERE e.user_id = 42 AND floor(e.value) = p.id AND e.event_type = 'signup') AS is_tracked
    FROM profiles p
    LEFT JOIN bridge b ON b.olympiad_profile_id = p.id
    LEFT JOIN subjects j ON j.id = b.subject_id
    WHERE p.approval_status = 'approved' AND p.is_active AND p.audience = 'school'
      AND EXISTS (SELECT 1 FROM bridge w JOIN subjects x ON x.id = w.subject_id
                  WHERE w.olympiad_profile_id = p.id AND x.code IN ('promo', 'other'))
    GROUP BY p.id, p.title, p.kind, p.profile_title, p.level, p.source_url
    """,
)
def profile_discovery(s: Source):
    found = c.discover_profiles(catalogue(s), 2026, "school", ["promo", "other"], user_id=42)
    return found.withColumns({n: F.array_join(n, ",") for n in ("subject_codes", "subject_names")})


STAR = """
FROM rules r
JOIN campaigns k ON k.id = r.admission_campaign_id
JOIN universities u ON u.id = k.university_id
{placed} JOIN programs g ON g.id = r.university_program_id
{placed} JOIN locations l ON l.id = g.university_location_id
JOIN profiles p ON p.id = r.olympiad_profile_id
LEFT JOIN subjects f ON f.id = r.confirmation_subject_id
"""


@query(
    "verified_catalog",
    CATALOGUE_SQL + """
    SELECT k.campaign_year, u.name AS university_name, g.name AS program_name, p.title AS olympiad_title, p.profile_title,
           p.level, j.name AS subject_name, r.diploma_status, r.benefit_kind, r.point_value, f.name AS confirmation_subject_name,
           r.confirmation_min_score, r.is_verified, r.verification_status, r.source_url, r.source_locator, r.checked_at
    """ + STAR.format(placed="LEFT") + """
    LEFT JOIN bridge b ON b.olympiad_profile_id = p.id
    LEFT JOIN subjects j ON j.id = b.subject_id
    WHERE r.is_active AND r.verification_status = 'verified'
    """,
)
def verified_catalog(s: Source):
    return c.verified_catalog(catalogue(s))


@query(
    "benefits_by_university",
    CATALOGUE_SQL + """
    SELECT l.code AS university_location_code, g.name AS programme_name, p.title AS olympiad_title, p.profile_title,
           p.level AS olympiad_level, r.diploma_status, r.benefit_kind, r.point_value, f.name AS confirmation_subject_name,
           r.confirmation_min_score, r.source_url, r.source_locator, r.checked_at
    """ + STAR.format(placed="LEFT") + """
    WHERE u.code = 'u7' AND k.campaign_year = 1998 AND r.is_active AND r.verification_status = 'verified'
    """,
)
def benefits_by_university(s: Source):
    return c.university_benefits(catalogue(s), "u7", 1998)


@query(
    "university_policies",
    CATALOGUE_SQL + """
    SELECT u.name AS university_name, k.rules_url, a.policy_kind, a.description, a.is_verified, a.checked_at
    FROM campaigns k JOIN universities u ON u.id = k.university_id JOIN policies a ON a.admission_campaign_id = k.id
    WHERE u.code = 'u15' AND k.campaign_year = 1999
    """,
)
def university_policies(s: Source):
    return c.university_policies(catalogue(s), "u15", 1999)


@query(
    "university_search",
    CATALOGUE_SQL + """
    SELECT u.code, u.name, u.city, u.official_url, k.rules_url, k.rules_checked_at,
           count(r.admission_campaign_id) FILTER (WHERE r.is_active AND r.verification_status = 'verified') AS verified_benefits_count
    FROM campaigns k JOIN universities u ON u.id = k.university_id
    LEFT JOIN rules r ON r.admission_campaign_id = k.id
    WHERE k.campaign_year = 1999 AND u.is_active AND (u.name ILIKE '%a%' OR coalesce(u.city, '') ILIKE '%a%')
    GROUP BY ALL ORDER BY verified_benefits_count DESC, u.name LIMIT 50
    """,
)
def university_search(s: Source):
    return c.search_universities(catalogue(s), " a ", 1999)


@query(
    "public_rules_snapshot",
    CATALOGUE_SQL + """
    SELECT u.code AS university_code, l.code AS university_location_code, g.name AS programme_name, p.title AS olympiad_title,
           p.profile_title, p.level AS olympiad_level, r.diploma_status, r.benefit_kind, r.point_value,
           f.name AS confirmation_subject_name, r.confirmation_min_score, r.source_url, r.source_locator,
           strftime(r.checked_at, '%Y-%m-%d') AS checked_at
    """ + STAR.format(placed="") + """
    WHERE k.campaign_year = 1997 AND r.is_active AND r.verification_status = 'verified' AND l.is_active
      AND l.admission_status = 'benefits_verified' AND p.level IS NOT NULL
    """,
)
def public_rules_snapshot(s: Source):
    from ruleweave.operators.contracts import public_rule_contract, split_valid

    valid, _ = split_valid(c.public_rules(catalogue(s), 1997), public_rule_contract())
    return valid.orderBy(*c.PUBLIC_RULE_ORDER, "source_url", "source_locator")


@query(
    "public_rules_quarantine",
    CATALOGUE_SQL + """
    SELECT u.code AS university_code, l.code AS university_location_code, g.name AS programme_name, p.profile_title,
           r.source_url, r.source_locator, 'missing_olympiad_level' AS violation
    """ + STAR.format(placed="") + """
    WHERE k.campaign_year = 1997 AND r.is_active AND r.verification_status = 'verified' AND l.is_active
      AND l.admission_status = 'benefits_verified' AND p.level IS NULL
    """,
)
def public_rules_quarantine(s: Source):
    from ruleweave.operators.contracts import public_rule_contract, violations

    keep = ["university_code", "university_location_code", "programme_name", "profile_title", "source_url", "source_locator"]
    return violations(c.public_rules(catalogue(s), 1997), public_rule_contract(), keep)


@query(
    "lateral_top1",
    """
    SELECT c_custkey, t.o_orderkey, t.o_totalprice
    FROM customer LEFT JOIN LATERAL (
      SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey AND o_orderpriority <> '5-LOW'
      ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC LIMIT 1) t ON TRUE
    """,
)
def lateral_top1(s: Source):
    best = c.top1(
        s.orders.filter("o_orderpriority <> '5-LOW'"), "o_custkey",
        [F.col("o_orderstatus") == "F", F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"],
    )
    return s.customer.select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query(
    "exists_flag",
    """
    SELECT c_custkey, c_name,
           EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS has_open_urgent
    FROM customer
    """,
)
def exists_flag(s: Source):
    urgent = s.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select("o_custkey").distinct()
    joined = s.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.col("o_custkey").isNotNull().alias("has_open_urgent"))
