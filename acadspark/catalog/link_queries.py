"""Link, candidate and search queries over observations and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from acadspark.catalog import sqlparts as S
from acadspark.catalog.registry import query
from acadspark.functions import constants as K
from acadspark.operators import candidates as C
from acadspark.operators import links as L
from acadspark.operators import predicates as P
from acadspark.operators import search as R
from acadspark.plans.links import UrlOutcome, all_candidates, checked_candidates, find_better_links, primary_links
from acadspark.sources.fixtures import view

NOW = "2024-01-20 00:00:00"


def obs(spark, sf):
    return view(spark, sf, "observations")


def people(spark, sf):
    return L.attach_links(obs(spark, sf))


def now():
    return F.lit(NOW).cast("timestamp_ntz")


ACC = "http_status IS NOT NULL AND http_status = 200"
# links with the observation's own status, and mean quality per person
PEOPLE = f"""{S.LINKS},
acc AS (SELECT l.*, coalesce(o.http_status = 200, FALSE) AS is_accessible FROM links l JOIN observations o USING (obs_id)),
quality AS (SELECT o.obs_id, coalesce(CAST(sum(l.pct) AS DOUBLE) / (count(l.pct) * 100), 0) AS q FROM observations o LEFT JOIN links l ON o.obs_id = l.obs_id GROUP BY o.obs_id)"""


@query("categorize_url", f"WITH {S.LINKS} SELECT obs_id, field, link_type, CAST(pct AS DOUBLE) / 100 AS confidence FROM links")
def _(spark, sf):
    rows = L.link_table(people(spark, sf))
    return rows.select("obs_id", "field", "link_type", (F.col("pct") / F.lit(100.0)).alias("confidence"))


@query("categorize_url_substring", f"""
SELECT obs_id, {S.link_type('personal_website', 'substring')} AS link_type FROM observations WHERE personal_website IS NOT NULL""")
def _(spark, sf):
    df = obs(spark, sf).filter("personal_website IS NOT NULL")
    return L.categorize_url(df, "personal_website", match="substring").select("obs_id", "link_type")


REC = """
rec AS (SELECT sum(CASE WHEN section = 'total' THEN n ELSE 0 END) AS people, sum(CASE WHEN item = 'valid_links' THEN n ELSE 0 END) AS valid,
  sum(CASE WHEN item = 'broken_links' THEN n ELSE 0 END) AS broken, sum(CASE WHEN section = 'type' AND item = 'social_media' THEN n ELSE 0 END) AS social,
  sum(CASE WHEN section = 'type' AND item = 'unknown' THEN n ELSE 0 END) AS unknown, sum(CASE WHEN section = 'type' AND item = 'invalid' THEN n ELSE 0 END) AS invalid,
  sum(CASE WHEN item = 'low_quality' THEN n ELSE 0 END) AS low FROM counts)
SELECT section, item, CAST(n AS BIGINT) AS n FROM (
  SELECT section, item, n FROM counts
  UNION ALL SELECT 'recommendation', 'high_broken_rate', broken FROM rec WHERE broken * 5 > greatest(valid, 1)
  UNION ALL SELECT 'recommendation', 'social_links', social FROM rec WHERE social > 0
  UNION ALL SELECT 'recommendation', 'unknown_links', unknown FROM rec WHERE unknown > 0
  UNION ALL SELECT 'recommendation', 'low_quality', low FROM rec WHERE low * 10 > people * 3
  UNION ALL SELECT 'recommendation', 'replacement_candidates', social + unknown + invalid FROM rec WHERE social + unknown + invalid > 0) r"""

BAND = "CASE WHEN q >= 0.8 THEN 'high_quality' WHEN q >= 0.5 THEN 'medium_quality' ELSE 'low_quality' END"


@query("link_report", f"""WITH {PEOPLE},
counts AS (
  SELECT 'type' AS section, link_type AS item, count(*) AS n FROM links GROUP BY link_type
  UNION ALL SELECT 'stats', 'valid_links', count(*) FROM links WHERE link_type <> 'invalid'
  UNION ALL SELECT 'stats', CASE WHEN is_accessible THEN 'accessible_links' ELSE 'broken_links' END, count(*) FROM acc GROUP BY is_accessible
  UNION ALL SELECT 'total', 'people', count(*) FROM observations
  UNION ALL SELECT 'quality', {BAND}, count(*) FROM quality GROUP BY {BAND}), {REC}""")
def _(spark, sf):
    return L.link_report(people(spark, sf))


@query("link_quality", f"WITH {PEOPLE} SELECT obs_id, round(q, 6) AS link_quality_score FROM quality")
def _(spark, sf):
    return L.link_quality(people(spark, sf)).select("obs_id", F.round("link_quality_score", 6).alias("link_quality_score"))


WEIGHT = """least(pct + CASE WHEN is_accessible THEN 10 ELSE 0 END + CASE link_type WHEN 'google_scholar' THEN 20 WHEN 'lab_website' THEN 15
  WHEN 'university_profile' THEN 10 WHEN 'academic_profile' THEN 10 WHEN 'personal_website' THEN 5 ELSE 0 END
  - CASE WHEN link_type = 'social_media' THEN 30 ELSE 0 END, 100)"""


@query("link_quality_weighted", f"""WITH {PEOPLE}
SELECT o.obs_id, round(coalesce(CAST(sum(CASE WHEN acc.obs_id IS NOT NULL THEN {WEIGHT} END) AS DOUBLE), 0) / 300, 6) AS weighted_quality
FROM observations o LEFT JOIN acc ON o.obs_id = acc.obs_id GROUP BY o.obs_id""")
def _(spark, sf):
    return L.link_quality_weighted(people(spark, sf)).select("obs_id", F.round("weighted_quality", 6).alias("weighted_quality"))


@query("filter_valid_links", f"WITH {PEOPLE} SELECT obs_id, round(q, 6) AS link_quality_score FROM quality WHERE q >= 0.7")
def _(spark, sf):
    kept = P.filter_valid_links(L.link_quality(people(spark, sf)))
    return kept.select("obs_id", F.round("link_quality_score", 6).alias("link_quality_score"))


SECONDARY = f"""flags AS (
  SELECT o.obs_id, o.name, o.university, o.department, o.research_interests, coalesce(bool_or(link_type = 'social_media'), FALSE) AS needs_replacement,
    coalesce(bool_or(link_type IN ({', '.join(S.q(t) for t in K.GOOD_LINK_TYPES)}) AND pct >= 70), FALSE) AS has_good_links
  FROM observations o LEFT JOIN links l ON o.obs_id = l.obs_id GROUP BY ALL)"""


@query("secondary_candidates", f"""WITH {S.LINKS}, {SECONDARY}
SELECT obs_id, has_good_links, CASE WHEN has_good_links THEN 'medium' ELSE 'high' END AS priority FROM flags WHERE needs_replacement""")
def _(spark, sf):
    bad, _good = L.split_good_bad(people(spark, sf))
    return bad.select("obs_id", "has_good_links", "priority")


@query("split_good_bad", f"""WITH {S.LINKS}, {SECONDARY}
SELECT CASE WHEN needs_replacement THEN 'replace' ELSE 'keep' END AS part, count(*) AS n, min(obs_id) AS first_id, max(obs_id) AS last_id FROM flags GROUP BY 1""")
def _(spark, sf):
    bad, good = L.split_good_bad(people(spark, sf))
    both = bad.select("obs_id", F.lit("replace").alias("part")).unionByName(good.select("obs_id", F.lit("keep").alias("part")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_id"), F.max("obs_id").alias("last_id"))


@query("target_summary", f"""WITH {S.LINKS}, {SECONDARY}
SELECT count(*) AS total_candidates, count(*) FILTER (WHERE NOT has_good_links) AS high_priority, count(*) FILTER (WHERE has_good_links) AS medium_priority,
  count(*) FILTER (WHERE name <> '' AND university <> '') AS name_university_searches,
  count(*) FILTER (WHERE name <> '' AND university <> '' AND department <> '') AS name_department_searches,
  count(*) FILTER (WHERE name <> '' AND research_interests <> '') AS research_interest_searches, CAST(0 AS BIGINT) AS biography_searches
FROM flags WHERE needs_replacement""")
def _(spark, sf):
    from acadspark.operators.reports import target_summary
    return target_summary(L.secondary_candidates(people(spark, sf)))


@query("best_lab_link", f"""WITH {S.LINKS}
SELECT obs_id, arg_max(url, pct * 10 - CASE field WHEN 'profile_url' THEN 0 WHEN 'personal_website' THEN 1 ELSE 2 END) AS lab_url, CAST(max(pct) AS INTEGER) AS pct
FROM links WHERE link_type = 'lab_website' GROUP BY obs_id""")
def _(spark, sf):
    return L.best_lab_link(people(spark, sf))


@query("link_groups", f"""WITH {S.LINKS}
SELECT o.obs_id, count(*) FILTER (WHERE link_type = 'social_media') AS n_social,
  count(*) FILTER (WHERE link_type IN ('google_scholar', 'academic_profile', 'university_profile')) AS n_academic,
  count(*) FILTER (WHERE link_type = 'lab_website') AS n_lab
FROM observations o LEFT JOIN links l ON o.obs_id = l.obs_id GROUP BY o.obs_id""")
def _(spark, sf):
    df = L.link_groups(people(spark, sf))
    return df.select("obs_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_social", "n_academic", "n_lab")])


def _sql_rich(what):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(url), {S.q(p)}) THEN {S.q(c) if what == 'c' else r}" for p, c, r in L.RICHNESS_RULES) + (
        " ELSE 'personal_website' END" if what == "c" else " ELSE 50 END")


@query("link_richness", f"""WITH {S.LINKS} SELECT obs_id, field, {_sql_rich('c')} AS category, CAST({_sql_rich('r')} AS DOUBLE) / 100 AS richness FROM links""")
def _(spark, sf):
    return L.link_richness(L.link_table(people(spark, sf)), "url").select("obs_id", "field", "category", "richness")


@query("enrichable_links", f"""WITH {PEOPLE}
SELECT obs_id, field, url, pct > 70 AS wants_detail FROM acc WHERE is_accessible AND link_type NOT IN ('social_media', 'invalid') AND pct > 20""")
def _(spark, sf):
    return P.enrichable_links(L.link_table(people(spark, sf))).select("obs_id", "field", "url", "wants_detail")


FETCHED = """latest AS (SELECT url, http_status, final_url FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, obs_id DESC, field DESC) AS rn FROM page_fetches) f WHERE rn = 1),
checked AS (
  SELECT l.obs_id, l.field, l.url, l.link_type, l.pct, coalesce(f.http_status = 200, FALSE) AS is_accessible,
    CASE WHEN f.final_url IS NOT NULL AND f.final_url <> l.url THEN l.url END AS original_url, coalesce(f.final_url, l.url) AS resolved_url
  FROM links l LEFT JOIN latest f ON l.url = f.url)"""


def checked(spark, sf):
    return L.link_accessibility(L.link_table(people(spark, sf)), view(spark, sf, "page_fetches"))


@query("link_accessibility", f"WITH {S.LINKS}, {FETCHED} SELECT obs_id, field, is_accessible, original_url, resolved_url FROM checked")
def _(spark, sf):
    return checked(spark, sf).select("obs_id", "field", "is_accessible", "original_url", "resolved_url")


VALIDATED = """v AS (SELECT obs_id, count(*) AS n_links, count(*) FILTER (WHERE is_accessible) AS n_accessible, count(original_url) AS n_redirected,
    CAST(sum(pct) AS DOUBLE) / (count(*) * 100) AS q FROM checked GROUP BY obs_id)"""


@query("validate_links", f"""WITH {S.LINKS}, {FETCHED}, {VALIDATED}
SELECT obs_id, n_links, n_accessible, n_redirected, round(q, 6) AS link_quality_score FROM v""")
def _(spark, sf):
    return L.validated_people(checked(spark, sf))


@query("validate_links_report", f"""WITH {S.LINKS}, {FETCHED}, {VALIDATED},
counts AS (
  SELECT 'type' AS section, link_type AS item, count(*) AS n FROM checked GROUP BY link_type
  UNION ALL SELECT 'stats', 'valid_links', count(*) FROM checked WHERE link_type <> 'invalid'
  UNION ALL SELECT 'stats', CASE WHEN is_accessible THEN 'accessible_links' ELSE 'broken_links' END, count(*) FROM checked GROUP BY is_accessible
  UNION ALL SELECT 'stats', 'redirected_links', count(*) FROM checked WHERE original_url IS NOT NULL
  UNION ALL SELECT 'total', 'people', count(*) FROM observations
  UNION ALL SELECT 'quality', {BAND}, count(*) FROM (SELECT o.obs_id, coalesce(q, 0) AS q FROM observations o LEFT JOIN v USING (obs_id)) z GROUP BY {BAND}), {REC}""")
def _(spark, sf):
    from acadspark.plans.links import validate_links
    _, report = validate_links(obs(spark, sf), view(spark, sf, "page_fetches"))
    return report


# ---- candidates ----

def _sql_domain(u):
    d = f"regexp_replace(lower({u}), '[^a-z\\s]', '', 'g')"
    for w in ("university of ", " university", " college", " institute", " "):
        d = f"replace({d}, '{w}', '')"
    return f"CASE lower({u}) " + " ".join(f"WHEN {S.q(n)} THEN {S.q(x)}" for n, x in C.KNOWN_DOMAINS) + f" ELSE concat({d}, '.edu') END"


@query("institution_domain", f"""
SELECT obs_id, {_sql_domain('university')} AS domain,
  coalesce(nullif(array_to_string(list_transform((list_filter(regexp_split_to_array(trim(university), '\\s+'), lambda w: length(w) > 3 AND lower(w) NOT IN ('of', 'the', 'and')))[1:3],
    lambda w: upper(substr(w, 1, 1))), ''), ''), split_part(university, ' ', 1)) AS short
FROM observations""")
def _(spark, sf):
    u = F.col("university")
    return obs(spark, sf).select("obs_id", C.institution_domain(u).alias("domain"), C.institution_short(u).alias("short"))


NAMED = f"""named AS (SELECT *, {S.display_name('name')} AS dn FROM observations),
parts AS (SELECT *, lower(dn) AS full_name, split_part(lower(dn), ' ', 1) AS f,
  CASE WHEN len(regexp_split_to_array(lower(dn), '\\s+')) > 1 THEN (regexp_split_to_array(lower(dn), '\\s+'))[-1] ELSE '' END AS l FROM named)"""
CANDS = f"""{NAMED},
hosts AS (SELECT *, nullif({S.authority("coalesce(profile_url, '')")}, '') AS dom FROM parts),
forms AS (SELECT *, unnest([replace(full_name, ' ', '-'), replace(full_name, ' ', '_'), replace(full_name, ' ', ''), concat(f, '-', l), concat(f, '_', l),
    concat(substr(f, 1, 1), l), concat(f, '.', l), l, concat(l, '-', f)]) AS nv FROM hosts WHERE dom IS NOT NULL AND l <> ''),
found AS (
  SELECT obs_id, person_key, concat('https://', dom, replace(p, '{{}}', nv)) AS url, 'domain_discovery' AS source, CASE WHEN contains(dom, '.edu') THEN 80 ELSE 60 END AS pct
  FROM forms, (SELECT unnest({S.arr(C.PERSON_PATHS)}) AS p) q
  UNION ALL SELECT obs_id, person_key, concat('https://scholar.google.com/citations?q=', replace(dn, ' ', '+')), 'direct_academic', 70 FROM named
  UNION ALL SELECT obs_id, person_key, concat('https://scholar.google.com/citations?q=', replace(concat(dn, ' ', university), ' ', '+')), 'direct_academic', 70 FROM named
  UNION ALL SELECT obs_id, person_key, concat('https://www.researchgate.net/profile/', replace(lower(dn), ' ', '-')), 'direct_academic', 60 FROM named
  UNION ALL SELECT obs_id, person_key, concat('https://www.researchgate.net/search.Search.html?query=', replace(dn, ' ', '+')), 'direct_academic', 60 FROM named
  UNION ALL SELECT obs_id, person_key, concat('https://orcid.org/search?searchQuery=', replace(dn, ' ', '+')), 'direct_academic', 60 FROM named)"""


@query("url_candidates", f"""WITH {CANDS}
SELECT person_key, source, url, CAST(max(pct) AS INTEGER) AS pct, count(*) AS n FROM found GROUP BY person_key, source, url""")
def _(spark, sf):
    # forms of the same person repeat over observations, so the generator runs on distinct inputs
    ppl = obs(spark, sf).groupBy("person_key", "name", "university", "profile_url").agg(F.count("*").alias("times"))
    return C.candidate_counts(ppl, "person_key").select("person_key", "source", "url", "pct", "n")


@query("url_candidates_top", f"""WITH {CANDS}
SELECT obs_id, url, source, CAST(pct AS INTEGER) AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY pct DESC, url, source) AS rn FROM found) r WHERE rn <= 10""")
def _(spark, sf):
    return C.url_candidates(obs(spark, sf), ("obs_id",), top=10).select("obs_id", "url", "source", F.col("pct").cast("int").alias("pct"))


@query("missing_link_forms", f"""WITH {NAMED}, d AS (SELECT *, {_sql_domain('university')} AS dom FROM parts)
SELECT obs_id, 'scholar' AS kind, unnest([concat(f, l), concat(substr(f, 1, 1), l), concat(l, substr(f, 1, 1))]) AS tail, unnest([1, 2, 3]) AS ord FROM d
UNION ALL SELECT obs_id, 'site', unnest([concat('www.', dom, '/~', f, l), concat('www.', dom, '/~', l), concat('www.', dom, '/people/', f, '-', l),
  concat('www.', dom, '/faculty/', f, '-', l), concat(f, l, '.', dom), concat(l, '.', dom)]), unnest([1, 2, 3, 4, 5, 6]) FROM d""")
def _(spark, sf):
    rows = C.missing_link_forms(obs(spark, sf), ("obs_id",))
    tail = F.when(F.col("kind") == "scholar", F.substring_index("url", "=", -1)).otherwise(F.regexp_replace("url", "^https://", ""))
    return rows.select("obs_id", "kind", tail.alias("tail"), "ord")


def _sql_query(t):
    out = S.q(t)
    for m, c in (("{n}", "n"), ("{u}", "u"), ("{d}", "d")):
        out = f"replace({out}, {S.q(m)}, {c})"
    return f"trim({out})"


@query("search_queries", f"""
WITH base AS (SELECT obs_id, trim(name) AS n, trim(university) AS u, trim(department) AS d, trim(coalesce(research_interests, '')) AS r, coalesce(lab_name, '') AS lab FROM observations)
{' UNION ALL '.join(f"SELECT obs_id, {_sql_query(t)} AS query, '{k}' AS kind, 'search_{k}' AS strategy FROM base WHERE length({_sql_query(t)}) > length(n) + 5" for t, k in C.QUERY_FORMS)}
UNION ALL SELECT obs_id, concat('"', n, '" ', u), 'any', 'name_university_search' FROM base WHERE u <> ''
UNION ALL SELECT obs_id, concat('"', n, '" ', d, ' ', u), 'any', 'name_department_search' FROM base WHERE u <> '' AND d <> ''
UNION ALL SELECT obs_id, concat('"', n, '" ', array_to_string(list_transform(string_split(r, ',')[1:3], lambda x: trim(x)), ' ')), 'any', 'research_interests_search' FROM base WHERE r <> ''
UNION ALL SELECT obs_id, concat('"', replace(replace(n, 'Dr. ', ''), 'Prof. ', ''), '" "', lab, '" "', u, '" (site:.edu OR site:.org)'), 'lab_website', 'lab_search' FROM base WHERE lab <> ''""")
def _(spark, sf):
    return C.search_queries(obs(spark, sf))


@query("candidate_union", """
WITH c AS (SELECT person_key, url, source FROM link_candidates),
n AS (SELECT person_key FROM c WHERE source <> 'search_engine' GROUP BY person_key HAVING count(*) >= 5)
SELECT person_key, url, source FROM c WHERE source <> 'search_engine' OR person_key NOT IN (SELECT person_key FROM n)""")
def _(spark, sf):
    c = view(spark, sf, "link_candidates").select("person_key", "url", "source")
    parts = [c.filter(F.col("source") == s) for s in ("domain_discovery", "direct_academic", "search_engine")]
    return C.candidate_union(*parts, by="person_key")


_PLAT = "CASE platform " + " ".join(f"WHEN '{p}' THEN {S.rx('low', w)}" for p, w in C.PLATFORM_WORDS) + " ELSE FALSE END"
VERIFIED = f"""verified AS (SELECT c.obs_id, c.person_key, c.url, c.platform, c.source,
    len(list_filter(regexp_split_to_array(lower({S.display_name('c.name')}), '\\s+'), lambda p: contains(low, p))) >= 2 AS name_ok,
    {S.rx('low', C.ACADEMIC_WORDS)} AS site_ok, {_PLAT} AS platform_ok, contains(c.url, 'scholar.google.com') AS scholar_ok
  FROM link_candidates c JOIN (SELECT url, lower({S.clean_html('html')}) AS low FROM profile_pages) p ON c.url = p.url)"""


def verified(spark, sf):
    from acadspark.operators.pages import page_text
    pages = page_text(view(spark, sf, "profile_pages")).select("url", "text")
    return C.verify_candidates(view(spark, sf, "link_candidates"), pages)


@query("verify_candidates", f"WITH {VERIFIED} SELECT obs_id, url, name_ok, site_ok, platform_ok, scholar_ok FROM verified")
def _(spark, sf):
    return verified(spark, sf).select("obs_id", "url", "name_ok", "site_ok", "platform_ok", "scholar_ok")


@query("first_verified_profile", f"""WITH {VERIFIED}
SELECT person_key, platform, url FROM (SELECT *, row_number() OVER (PARTITION BY person_key, platform ORDER BY obs_id, url) AS rn
  FROM verified WHERE name_ok AND platform_ok) r WHERE rn = 1""")
def _(spark, sf):
    return C.first_verified_profile(verified(spark, sf))


# candidates of every person: all forms, classed, and joined with the table of fetched pages
RANKED = f"""{CANDS},
prior AS (SELECT obs_id, url, source, pct AS prior_pct FROM found),
scored AS (SELECT *, least(100, prior_pct + pct + 20 + CASE WHEN link_type IN ({', '.join(S.q(t) for t in C.ACADEMIC_TYPES)}) THEN 30 ELSE 0 END) AS total_pct FROM (
  SELECT *, {S.link_type('url')} AS link_type, {S.link_pct('url')} AS pct, url IN (SELECT url FROM candidate_fetches WHERE is_accessible) AS is_accessible FROM prior) t),
best3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY total_pct DESC, url) AS rnk FROM scored
  WHERE is_accessible AND link_type <> 'social_media' AND total_pct > 40) b WHERE rnk <= 3)"""


def scored(spark, sf):
    return checked_candidates(obs(spark, sf), view(spark, sf, "candidate_fetches"))


@query("candidate_confidence", f"WITH {RANKED} SELECT obs_id, url, link_type, CAST(total_pct AS DOUBLE) / 100 AS confidence FROM scored")
def _(spark, sf):
    return all_candidates(obs(spark, sf)).select("obs_id", "url", "link_type", (F.col("total_pct") / F.lit(100.0)).alias("confidence"))


@query("top_candidates", f"WITH {RANKED} SELECT obs_id, url, CAST(rnk AS INTEGER) AS rank, CAST(total_pct AS DOUBLE) / 100 AS confidence FROM best3")
def _(spark, sf):
    return C.top_candidates(scored(spark, sf)).select("obs_id", "url", "rank", (F.col("total_pct") / F.lit(100.0)).alias("confidence"))


BEST = f"""{RANKED}, {S.LINKS},
cur AS (SELECT o.obs_id, o.personal_website, o.lab_website, l.link_type AS cur_type, coalesce(l.pct, 0) AS cur_pct
  FROM observations o LEFT JOIN links l ON o.obs_id = l.obs_id AND l.field = 'personal_website'),
acts AS (SELECT c.obs_id, b.url, b.rnk, CASE
    WHEN b.link_type = 'google_scholar' AND b.total_pct > 80 AND (coalesce(c.personal_website, '') = '' OR c.cur_type = 'social_media' OR c.cur_pct < b.total_pct) THEN 'site'
    WHEN b.link_type = 'personal_website' AND b.total_pct > 70 AND (coalesce(c.personal_website, '') = '' OR c.cur_pct < b.total_pct) THEN 'site'
    WHEN b.link_type = 'lab_website' AND b.total_pct > 70 THEN 'lab' END AS act
  FROM cur c JOIN best3 b USING (obs_id)),
won AS (SELECT obs_id, arg_max(url, rnk) FILTER (WHERE act = 'site') AS site, arg_max(url, rnk) FILTER (WHERE act = 'lab') AS lab FROM acts GROUP BY obs_id)"""


# the same over every candidate: each has a fetch outcome, derived from its URL, whether or not a fetched page is listed for it
_LISTED, _EACH = "url IN (SELECT url FROM candidate_fetches WHERE is_accessible)", "substr(md5(url), 1, 1) < '8'"
BEST_OF_ALL = BEST.replace(_LISTED, _EACH)


fetched_each = UrlOutcome(lambda url: F.substring(F.md5(url), 1, 1) < "8")


@query("best_primary_link", f"""WITH {BEST_OF_ALL}
SELECT c.obs_id, coalesce(w.site, c.personal_website) AS new_personal_website, coalesce(w.lab, c.lab_website) AS new_lab_website,
  w.site IS NOT NULL AS site_replaced, w.lab IS NOT NULL AS lab_replaced FROM cur c LEFT JOIN won w USING (obs_id)""")
def _(spark, sf):
    best = primary_links(obs(spark, sf), fetched_each)
    return best.select("obs_id", "new_personal_website", "new_lab_website", "site_replaced", "lab_replaced")


@query("find_better_links", f"""WITH {BEST_OF_ALL}, {SECONDARY}
SELECT c.obs_id, CASE WHEN f.needs_replacement THEN coalesce(w.site, c.personal_website) ELSE c.personal_website END AS personal_website,
  CASE WHEN f.needs_replacement THEN coalesce(w.lab, c.lab_website) ELSE c.lab_website END AS lab_website, f.needs_replacement AS was_candidate
FROM cur c JOIN flags f USING (obs_id) LEFT JOIN won w USING (obs_id)""")
def _(spark, sf):
    df = find_better_links(obs(spark, sf), fetched_each)
    return df.select("obs_id", "personal_website", "lab_website", "was_candidate")


@query("merge_enhanced", """
SELECT o.obs_id, coalesce(e.email, o.email) AS email, coalesce(e.phone, o.phone) AS phone FROM observations o
LEFT JOIN (SELECT obs_id, concat('found', CAST(obs_id AS STRING), '@x.edu') AS email, CAST(NULL AS STRING) AS phone FROM observations WHERE email IS NULL) e ON o.obs_id = e.obs_id""")
def _(spark, sf):
    df = obs(spark, sf)
    found = df.filter("email IS NULL").select("obs_id", F.concat(F.lit("found"), F.col("obs_id").cast("string"), F.lit("@x.edu")).alias("email"),
                                              F.lit(None).cast("string").alias("phone"))
    return C.merge_enhanced(df, found, ("email", "phone")).select("obs_id", "email", "phone")


@query("best_personal_site", f"""
WITH u AS (SELECT obs_id, name, unnest([profile_url, personal_website, lab_website]) AS url, unnest([0, 1, 2]) AS ord, concat('nation', CAST(person_key % 25 AS STRING)) AS base FROM observations),
s AS (SELECT obs_id, url, ord,
  CASE WHEN contains(lower(url), '/~') THEN 2 ELSE 0 END + CASE WHEN contains(lower(url), '/people/') THEN 2 ELSE 0 END + CASE WHEN contains(lower(url), '/faculty/') THEN 2 ELSE 0 END
  + CASE WHEN contains(lower(url), '/profile/') THEN 2 ELSE 0 END + CASE WHEN contains(lower(url), 'personal') THEN 2 ELSE 0 END + CASE WHEN contains(lower(url), 'homepage') THEN 2 ELSE 0 END
  + 3 * len(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda p: length(p) > 2 AND contains(lower(url), p))) + CASE WHEN contains(url, base) THEN 1 ELSE 0 END AS score
  FROM u WHERE url IS NOT NULL AND {S.rx(f"lower({S.authority('url')})", K.ACADEMIC_HOST_PARTS)}
    AND NOT regexp_matches(lower(url), '^(mailto|tel):|twitter|facebook|linkedin|instagram'))
SELECT o.obs_id, b.url AS best_site, CAST(b.score AS BIGINT) AS score FROM observations o LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, ord) AS rn FROM s WHERE score > 0) r WHERE rn = 1) b ON o.obs_id = b.obs_id""")
def _(spark, sf):
    base = F.concat(F.lit("nation"), (F.col("person_key") % 25).cast("string"))
    return C.best_personal_site(obs(spark, sf), L.FIELDS, base)


# ---- search requests ----

@query("search_hit_score", """
WITH h AS (SELECT obs_id, lower(coalesce(profile_url, '')) AS url, lower(coalesce(title, '')) AS title, lower(coalesce(lab_name, '')) AS snip, lower(coalesce(lab_name, '')) AS lab,
  replace(replace(lower(name), 'dr. ', ''), 'prof. ', '') AS person FROM observations)
SELECT obs_id, CAST(CASE WHEN contains(url, '.edu') THEN 400 WHEN contains(url, '.org') THEN 200 ELSE 0 END
  + CASE WHEN len(list_filter(regexp_split_to_array(person, '\\s+'), lambda p: length(p) > 2 AND (contains(url, p) OR contains(title, p)))) > 0 THEN 300 ELSE 0 END
  + least(300, 100 * len(list_filter(regexp_split_to_array(lab, '\\s+'), lambda p: length(p) > 3 AND (contains(url, p) OR contains(title, p) OR contains(snip, p)))))
  + CASE WHEN regexp_matches(url, 'lab|laboratory|research|center|group') THEN 200 ELSE 0 END AS DOUBLE) / 1000 AS confidence FROM h""")
def _(spark, sf):
    hits = obs(spark, sf).select("obs_id", "name", "lab_name", F.coalesce("profile_url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"),
                                 F.coalesce("lab_name", F.lit("")).alias("snippet"))
    return R.search_hit_score(hits).select("obs_id", (F.col("score") / F.lit(1000.0)).alias("confidence"))


CACHE = f"""cache AS (SELECT md5(url) AS cache_key, ts AS cached_at, CAST(fetch_id AS STRING) AS result FROM fetch_log WHERE status_code = 200 AND channel <> 'page'),
requests AS (SELECT fetch_id, md5(url) AS cache_key FROM fetch_log WHERE channel = 'page'),
newest AS (SELECT cache_key, arg_max(result, (cached_at, result)) AS result FROM cache
  WHERE cached_at <= TIMESTAMP '{NOW}' AND cached_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR GROUP BY cache_key)"""


@query("cache_split", f"""WITH {CACHE}
SELECT r.fetch_id, n.result, n.result IS NOT NULL AS hit FROM requests r LEFT JOIN newest n ON r.cache_key = n.cache_key""")
def _(spark, sf):
    log = view(spark, sf, "fetch_log").withColumn("cache_key", F.md5("url"))
    cache = log.filter("status_code = 200 AND channel <> 'page'").select("cache_key", F.col("ts").alias("cached_at"), F.col("fetch_id").cast("string").alias("result"))
    hits, misses = R.cache_split(log.filter("channel = 'page'").select("fetch_id", "cache_key"), cache, now())
    return hits.select("fetch_id", "result", F.lit(True).alias("hit")).unionByName(
        misses.select("fetch_id", F.lit(None).cast("string").alias("result"), F.lit(False).alias("hit")))


@query("purge_expired", f"""SELECT fetch_id, url FROM fetch_log WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) <= 24 * CAST(3600000000 AS BIGINT) OR channel = 'serpapi'""")
def _(spark, sf):
    return R.purge_expired(view(spark, sf, "fetch_log"), "ts", 24, now(), F.col("channel") == "serpapi").select("fetch_id", "url")


@query("cache_summary", f"""
SELECT count(*) AS entries, round(sum(CASE channel WHEN 'bing' THEN 3 WHEN 'serpapi' THEN 5 ELSE 0 END) / CAST(1000 AS DOUBLE), 6) AS total_cost,
  count(*) FILTER (WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) < 24 * CAST(3600000000 AS BIGINT)) AS fresh,
  count(*) FILTER (WHERE NOT epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) < 24 * CAST(3600000000 AS BIGINT)) AS old FROM fetch_log""")
def _(spark, sf):
    cost = F.when(F.col("channel") == "bing", 0.003).when(F.col("channel") == "serpapi", 0.005).otherwise(0.0)
    return R.cache_summary(view(spark, sf, "fetch_log"), "ts", cost, now())


@query("query_cost", """
SELECT channel, count(*) AS queries, count(*) FILTER (WHERE status_code = 200) AS answered, count(*) FILTER (WHERE status_code <> 200) AS failed,
  round(count(*) * CASE channel WHEN 'bing' THEN CAST(0.003 AS DOUBLE) WHEN 'serpapi' THEN CAST(0.005 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS cost, channel = 'bing' AS cheapest
FROM fetch_log GROUP BY channel""")
def _(spark, sf):
    return R.query_cost(view(spark, sf, "fetch_log"))


@query("throttle_audit", """
SELECT fetch_id, host, ts, count(*) OVER a AS n_3600s, count(*) OVER a > 2 AS over_3600s, count(*) OVER b AS n_21600s, count(*) OVER b > 4 AS over_21600s
FROM fetch_log WINDOW a AS (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECONDS PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    # the test hosts are quiet, so the audit runs with lower limits than the defaults
    return R.throttle_audit(view(spark, sf, "fetch_log"), limits=((3600, 2), (21600, 4)))


@query("host_policy", """
SELECT fetch_id, CASE WHEN contains(host, 'host1') THEN CAST(2 AS DOUBLE) WHEN contains(host, 'host2') THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS delay,
  regexp_matches(host, '\\.edu$|\\.ac\\.uk$|\\.ac\\.|^scholar\\.google\\.com$') AS allowed, regexp_matches(host, '(^|\\.)(facebook|twitter|instagram)\\.com$') AS blocked FROM fetch_log""")
def _(spark, sf):
    return R.host_policy(view(spark, sf, "fetch_log"), (("host1", 2.0), ("host2", 1.5))).select("fetch_id", "delay", "allowed", "blocked")
