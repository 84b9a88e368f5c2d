"""Deduplication, entity, view and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from acadspark.catalog import sqlparts as S
from acadspark.catalog.link_queries import BAND, CANDS, FETCHED, PEOPLE, SECONDARY, checked, people  # noqa: F401
from acadspark.catalog.registry import query
from acadspark.catalog.text_queries import _EQUIP, INSTITUTIONS, _kw, institutions, sql_interests
from acadspark.functions import constants as K
from acadspark.functions import names as N
from acadspark.functions import scores as Z
from acadspark.functions import text as X
from acadspark.operators import dedup as D
from acadspark.operators import entities as E
from acadspark.operators import links as L
from acadspark.operators import ranking as T
from acadspark.operators import reports as R
from acadspark.operators import views as V
from acadspark.sources.fixtures import table, view

NOW = "1999-01-15 06:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def obs(spark, sf):
    return view(spark, sf, "observations")


def enr(spark, sf):
    return view(spark, sf, "enrichments")


# ---- duplicates ----

KEYED = f"keyed AS (SELECT *, {S.dedup_key('name', 'university')} AS dedup_key FROM observations)"
VALUES = f"""vals AS (SELECT DISTINCT dedup_key, kind, value FROM (
  SELECT dedup_key, 'department' AS kind, department AS value FROM keyed UNION ALL SELECT dedup_key, 'link', profile_url FROM keyed
  UNION ALL SELECT dedup_key, 'link', personal_website FROM keyed UNION ALL SELECT dedup_key, 'link', lab_website FROM keyed
  UNION ALL SELECT dedup_key, 'lab', lab_name FROM keyed UNION ALL SELECT dedup_key, 'interest', unnest({sql_interests('research_interests')}) FROM keyed) u WHERE value IS NOT NULL AND value <> '')"""


@query("dedup_people", f"""WITH {KEYED}, {VALUES},
p AS (SELECT dedup_key, count(*) AS n_obs, arg_min(name, (scraped_at, obs_id)) AS name, arg_min(department, (scraped_at, obs_id)) AS department,
  arg_min(title, (scraped_at, obs_id)) FILTER (WHERE title <> '') AS title, arg_min(email, (scraped_at, obs_id)) FILTER (WHERE email <> '') AS email FROM keyed GROUP BY dedup_key),
n AS (SELECT dedup_key, count(*) FILTER (WHERE kind = 'department') AS n_departments, count(*) FILTER (WHERE kind = 'link') AS n_links,
  count(*) FILTER (WHERE kind = 'interest') AS n_interests, count(*) FILTER (WHERE kind = 'lab') AS n_labs FROM vals GROUP BY dedup_key)
SELECT p.*, n.n_departments, n.n_links, n.n_interests, n.n_labs FROM p LEFT JOIN n USING (dedup_key)""")
def _(spark, sf):
    return D.dedup_people(obs(spark, sf))[0]


@query("dedup_people_values", f"WITH {KEYED}, {VALUES} SELECT dedup_key, kind, value FROM vals")
def _(spark, sf):
    return D.dedup_people(obs(spark, sf))[1]


RESOLVED = f"""k AS (SELECT *, {S.person_key('name')} AS name_key, {S.institution_key('university')} AS uni_key, lower(nullif(email, '')) AS mail FROM observations),
nodes AS (SELECT name_key, uni_key, mail, min(obs_id) AS node FROM k GROUP BY name_key, uni_key, mail),
reach AS (SELECT node AS a, node AS b FROM nodes
  UNION SELECT r.a, n2.node FROM reach r JOIN nodes n1 ON r.b = n1.node JOIN nodes n2 ON n1.name_key = n2.name_key AND (n1.uni_key = n2.uni_key OR n1.mail = n2.mail)),
roots AS (SELECT a AS node, min(b) AS entity FROM reach GROUP BY a),
resolved AS (SELECT k.*, r.entity FROM k JOIN nodes n ON k.name_key = n.name_key AND k.uni_key = n.uni_key AND k.mail IS NOT DISTINCT FROM n.mail JOIN roots r ON n.node = r.node)"""


@query("resolve_person", f"WITH RECURSIVE {RESOLVED} SELECT obs_id, name_key, entity FROM resolved")
def _(spark, sf):
    return D.resolve_person(obs(spark, sf)).select("obs_id", "name_key", "entity")


FOLD = """seq AS (SELECT entity, confidence_score, row_number() OVER (PARTITION BY entity ORDER BY scraped_at, obs_id) AS i FROM resolved),
fold AS (SELECT entity, i, coalesce(confidence_score, CAST(0.8 AS DOUBLE)) AS c FROM seq WHERE i = 1
  UNION ALL SELECT f.entity, s.i, (f.c + coalesce(s.confidence_score, CAST(0.5 AS DOUBLE))) / 2 FROM fold f JOIN seq s ON f.entity = s.entity AND s.i = f.i + 1)"""


@query("merge_people", f"""WITH RECURSIVE {RESOLVED}, {FOLD},
last AS (SELECT entity, max(i) AS n_merged, arg_max(c, i) AS c FROM fold GROUP BY entity)
SELECT r.entity, arg_min(name, (scraped_at, obs_id)) AS name, arg_min(email, (scraped_at, obs_id)) FILTER (WHERE email <> '') AS email,
  arg_min(phone, (scraped_at, obs_id)) FILTER (WHERE phone <> '') AS phone, arg_min(title, (-length(title), scraped_at, obs_id)) FILTER (WHERE title <> '') AS title,
  any_value(l.n_merged) AS n_merged, floor(any_value(l.c) * 1000000 + CAST(0.001 AS DOUBLE)) / 1000000 AS confidence
FROM resolved r JOIN last l ON r.entity = l.entity GROUP BY r.entity""")
def _(spark, sf):
    return D.merge_people(D.resolve_person(obs(spark, sf))).withColumn("confidence", D.six_places(F.col("confidence")))


@query("resolve_lab", f"""WITH RECURSIVE k AS (SELECT CASE WHEN coalesce(lab_name, '') <> '' THEN {S.institution_key('lab_name')} END AS lab_key, nullif(lab_website, '') AS site, obs_id FROM observations),
nodes AS (SELECT lab_key, site, min(obs_id) AS node FROM k WHERE lab_key IS NOT NULL OR site IS NOT NULL GROUP BY lab_key, site),
hub AS (SELECT node, concat('n:', lab_key) AS hub FROM nodes WHERE lab_key IS NOT NULL UNION ALL SELECT node, concat('s:', site) FROM nodes WHERE site IS NOT NULL),
first_of AS (SELECT h.node, m.lo FROM hub h JOIN (SELECT hub, min(node) AS lo FROM hub GROUP BY hub) m USING (hub)),
edge AS (SELECT node AS a, lo AS b FROM first_of UNION SELECT lo, node FROM first_of),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT n.lab_key, n.site, r.lab_entity FROM nodes n JOIN (SELECT a, min(b) AS lab_entity FROM reach GROUP BY a) r ON n.node = r.a""")
def _(spark, sf):
    return D.resolve_lab(obs(spark, sf))


LABV = f"""lk AS (SELECT *, lower(trim(lab_name)) AS lab_key FROM observations WHERE coalesce(lab_name, '') <> ''),
lv AS (SELECT DISTINCT lab_key, kind, value FROM (SELECT lab_key, 'department' AS kind, department AS value FROM lk UNION ALL SELECT lab_key, 'website', lab_website FROM lk
  UNION ALL SELECT lab_key, 'member', {S.display_name('name')} FROM lk UNION ALL SELECT lab_key, 'area', unnest({sql_interests('research_interests')}) FROM lk) u WHERE value <> '')"""


@query("lab_rollup", f"""WITH {LABV}, l AS (SELECT lab_key, count(*) AS n_records, arg_min(lab_name, (scraped_at, obs_id)) AS lab_name FROM lk GROUP BY lab_key),
n AS (SELECT lab_key, count(*) FILTER (WHERE kind = 'member') AS n_members, count(*) FILTER (WHERE kind = 'department') AS n_departments, count(*) FILTER (WHERE kind = 'website') AS n_websites,
  count(*) FILTER (WHERE kind = 'area') AS n_areas FROM lv GROUP BY lab_key)
SELECT l.*, n.n_members, n.n_departments, n.n_websites, n.n_areas, n.n_departments > 1 AS interdisciplinary FROM l JOIN n USING (lab_key)""")
def _(spark, sf):
    return D.lab_rollup(obs(spark, sf))[0]


@query("lab_rollup_values", f"WITH {LABV} SELECT lab_key, kind, value FROM lv")
def _(spark, sf):
    return D.lab_rollup(obs(spark, sf))[1]


@query("interest_union", f"SELECT DISTINCT person_key, unnest({sql_interests('research_interests')}) AS interest FROM observations")
def _(spark, sf):
    return D.interest_union(obs(spark, sf), "person_key")


@query("merge_profiles", f"""WITH {S.LINKS}
SELECT DISTINCT person_key, link_type AS category, url FROM links UNION SELECT person_key, platform, url FROM link_candidates""")
def _(spark, sf):
    a = L.link_table(people(spark, sf), "person_key").select("person_key", F.col("link_type").alias("category"), "url")
    b = view(spark, sf, "link_candidates").select("person_key", F.col("platform").alias("category"), "url")
    return D.merge_profiles(a, b)


FOUND = f"""found AS (SELECT replace(lower(university), ' ', '_') AS slug, university, department, {S.path("coalesce(profile_url, '')")} AS p, obs_id AS seq, scraped_at AS seen_at,
    CASE obs_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'navigation' WHEN 2 THEN 'common_paths' ELSE 'stored' END AS method, CAST(50 + obs_id % 45 AS INTEGER) AS pct FROM observations),
paths AS (SELECT DISTINCT slug, kind, path FROM (SELECT slug, 'general' AS kind, nullif(p, '') AS path FROM found UNION ALL SELECT slug, concat('department:', lower(department)), nullif(p, '') FROM found) u WHERE path IS NOT NULL),
store AS (SELECT f.slug, count(*) AS discovery_count, max(pct) AS pct, arg_max(method, (seen_at, seq)) AS method, max(seen_at) AS last_updated FROM found f GROUP BY f.slug),
merged AS (SELECT s.*, n.n_paths, n.n_department_paths FROM store s LEFT JOIN (SELECT slug, count(*) FILTER (WHERE kind = 'general') AS n_paths, count(*) FILTER (WHERE kind <> 'general') AS n_department_paths FROM paths GROUP BY slug) n USING (slug))"""


def found(spark, sf):
    from acadspark.functions import urls as U
    o = obs(spark, sf)
    method = F.element_at(F.array(*[F.lit(m) for m in ("sitemap", "navigation", "common_paths", "stored")]), (F.col("obs_id") % 4 + 1).cast("int"))
    return o.select(N.institution_slug(F.col("university")).alias("slug"), "university", "department", F.nullif(U.path(F.col("profile_url")), F.lit("")).alias("path"),
                    F.col("obs_id").alias("seq"), F.col("scraped_at").alias("seen_at"), method.alias("method"), (F.col("obs_id") % 45 + 50).cast("int").alias("pct"),
                    (F.col("obs_id") % 4).alias("ord"))


@query("merge_structures", f"WITH {FOUND} SELECT * FROM merged")
def _(spark, sf):
    return D.merge_structures(found(spark, sf))[0]


@query("structure_stats", f"WITH {FOUND} SELECT method, count(*) AS structures, CAST(sum(n_paths) AS BIGINT) AS paths, CAST(sum(n_department_paths) AS BIGINT) AS department_paths, max(last_updated) AS last_update FROM merged GROUP BY method")
def _(spark, sf):
    return R.structure_stats(D.merge_structures(found(spark, sf))[0])


@query("department_paths", f"WITH {FOUND} SELECT DISTINCT slug, path FROM paths WHERE kind = 'general' OR contains(substr(kind, 12), 'computer') OR contains('computer', substr(kind, 12))")
def _(spark, sf):
    return D.department_paths(D.merge_structures(found(spark, sf))[1], "Computer")


@query("best_discovery", f"""WITH {FOUND}, r AS (SELECT slug, method, pct, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN method = 'stored' AND pct > 80 THEN 1 ELSE 0 END DESC, pct DESC, seq % 4) AS rn FROM found)
SELECT slug, method, pct FROM r WHERE rn = 1""")
def _(spark, sf):
    return D.best_discovery(found(spark, sf))


@query("combine_departments", """WITH u AS (SELECT lab_website AS url, 0 AS source, obs_id AS seq, department FROM observations WHERE lab_website IS NOT NULL
  UNION ALL SELECT profile_url, 1, obs_id, department FROM observations WHERE profile_url <> '' UNION ALL SELECT personal_website, 2, obs_id, department FROM observations WHERE personal_website IS NOT NULL)
SELECT url, CAST(source AS BIGINT) AS source, seq, department FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, seq) AS rn FROM u) r WHERE rn = 1""")
def _(spark, sf):
    o = obs(spark, sf)
    parts = [o.filter(F.coalesce(F.col(c), F.lit("")) != "").select(F.col(c).alias("url"), F.col("obs_id").alias("seq"), "department") for c in ("lab_website", "profile_url", "personal_website")]
    return D.combine_departments(*parts)


# ---- ranking ----

SQL_DIR_N = "lower(department)"


def _cnt(col, words, w):
    return f"{w} * (" + " + ".join(f"CASE WHEN contains({col}, {S.q(x)}) THEN 1 ELSE 0 END" for x in words) + ")"


def sql_directory_points(n, u, raw_name, target=None):
    extra = f" + CASE WHEN contains({n}, '{target}') OR contains({u}, '{target}') THEN 50 ELSE 0 END" if target else ""
    if target and len(target.split()) > 1:
        extra += "".join(f" + CASE WHEN contains({n}, '{w}') THEN 20 ELSE 0 END" for w in target.split() if len(w) > 3)
    return f"""greatest(0, least(200, {_cnt(n, K.DIRECTORY_TERMS, 30)} + {_cnt(u, K.DIRECTORY_TERMS, 20)} + {_cnt(n, K.UNIT_TERMS, 20)} + {_cnt(u, K.UNIT_TERMS, 10)}
      + CASE WHEN regexp_matches({u}, {S.q(K.DIRECTORY_PATHS)}) THEN 30 ELSE 0 END - {_cnt(n, K.NON_ACADEMIC_TERMS, 20)} - {_cnt(u, K.NON_ACADEMIC_TERMS, 10)}
      + CASE WHEN contains({u}, '.edu') THEN 10 ELSE 0 END - CASE WHEN length({raw_name}) > 100 THEN 20 ELSE 0 END + CASE WHEN {S.rx(n, K.DISCIPLINES)} THEN 10 ELSE 0 END{extra}))"""


@query("directory_link_score", f"""SELECT obs_id, CASE WHEN coalesce(profile_url, '') <> '' THEN CAST({sql_directory_points('lower(department)', 'lower(profile_url)', 'department', 'computer science')} AS DOUBLE) / 100 ELSE 0 END AS score FROM observations""")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", (Z.directory_link_points(F.col("department"), F.col("profile_url"), "Computer Science") / F.lit(100.0)).alias("score"))


@query("rank_departments", f"""WITH d AS (SELECT DISTINCT department, CASE WHEN obs_id % 3 = 0 THEN concat('https://x.edu/staff/', lower(department)) WHEN obs_id % 3 = 1 THEN concat('https://x.edu/faculty/', lower(department))
    ELSE coalesce(profile_url, '') END AS url FROM observations),
s AS (SELECT department, url, CASE WHEN url <> '' THEN {sql_directory_points('lower(department)', 'lower(url)', 'department')} ELSE 0 END
  * CASE WHEN contains(url, 'staff') AND NOT contains(url, 'faculty') THEN CAST(0.1 AS DOUBLE) WHEN contains(url, 'faculty') AND NOT contains(url, 'staff') THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS points FROM d)
SELECT department, url, round(points / 100, 6) AS score FROM s""")
def _(spark, sf):
    url = F.when(F.col("obs_id") % 3 == 0, F.concat(F.lit("https://x.edu/staff/"), F.lower("department"))).when(
        F.col("obs_id") % 3 == 1, F.concat(F.lit("https://x.edu/faculty/"), F.lower("department"))).otherwise(F.coalesce("profile_url", F.lit("")))
    d = obs(spark, sf).select("department", url.alias("url")).distinct()
    return T.rank_departments(d, "department", "url").select("department", "url", F.round(F.col("points") / 100, 6).alias("score"))


@query("max_people", "SELECT obs_id, department, name FROM observations ORDER BY department, obs_id LIMIT 100")
def _(spark, sf):
    return T.max_people(obs(spark, sf), 100, ("department", "obs_id")).select("obs_id", "department", "name")


# ---- entities ----

IDS = f"""ids AS (SELECT *, {S.person_id(S.dedup_key('name', 'university'))} AS person_id, {S.university_id('university')} AS university_id, {S.department_id('university', 'department')} AS department_id,
  {S.lab_id('university', 'lab_name', 'lab_website')} AS lab_id FROM observations)"""
PFOLD = """pseq AS (SELECT person_id, confidence_score, row_number() OVER (PARTITION BY person_id ORDER BY scraped_at, obs_id) AS i FROM ids),
pfold AS (SELECT person_id, i, coalesce(confidence_score, CAST(0.8 AS DOUBLE)) AS c FROM pseq WHERE i = 1
  UNION ALL SELECT f.person_id, s.i, (f.c + coalesce(s.confidence_score, CAST(0.5 AS DOUBLE))) / 2 FROM pfold f JOIN pseq s ON f.person_id = s.person_id AND s.i = f.i + 1),
plast AS (SELECT person_id, max(i) AS n_merged, floor(arg_max(c, i) * 1000000 + CAST(0.001 AS DOUBLE)) / 1000000 AS confidence FROM pfold GROUP BY person_id)"""
OF = "arg_min({0}, (scraped_at, obs_id)) FILTER (WHERE {0} <> '') AS {0}"
PERSON = f"""person AS (SELECT p.*, l.n_merged, l.confidence FROM (SELECT person_id, arg_min(name, (scraped_at, obs_id)) AS name, arg_min(university_id, (scraped_at, obs_id)) AS university_id,
  arg_min(department_id, (scraped_at, obs_id)) AS department_id, {', '.join(OF.format(c) for c in ('title', 'email', 'phone', 'office', 'profile_url', 'personal_website'))} FROM ids GROUP BY person_id) p JOIN plast l USING (person_id))"""
OTHERS = f"""university AS (SELECT university_id, arg_min(university, (scraped_at, obs_id)) AS name,
    coalesce(nullif(arg_min(host, (scraped_at, obs_id)), ''), 'unknown.edu') AS domain FROM (SELECT *, {S.authority("coalesce(profile_url, '')")} AS host FROM ids) h GROUP BY university_id),
department AS (SELECT department_id, arg_min(department, (scraped_at, obs_id)) AS name, arg_min(university_id, (scraped_at, obs_id)) AS university_id FROM ids GROUP BY department_id),
lab AS (SELECT lab_id, arg_min(coalesce(nullif(lab_name, ''), 'Unknown Lab'), (scraped_at, obs_id)) AS name, arg_min(university_id, (scraped_at, obs_id)) AS university_id,
  arg_min(department_id, (scraped_at, obs_id)) AS department_id, nullif(arg_min(coalesce(lab_website, ''), (scraped_at, obs_id)), '') AS website FROM ids WHERE lab_id IS NOT NULL GROUP BY lab_id)"""


def entities(spark, sf, staged=False):
    return E.build_entities(obs(spark, sf), staged)


@query("person_entities", f"WITH RECURSIVE {IDS}, {PFOLD}, {PERSON} SELECT * FROM person")
def _(spark, sf):
    return entities(spark, sf)["person"].withColumn("confidence", D.six_places(F.col("confidence")))


@query("university_entities", f"WITH {IDS}, {OTHERS} SELECT * FROM university")
def _(spark, sf):
    return entities(spark, sf)["university"]


@query("department_entities", f"WITH {IDS}, {OTHERS} SELECT * FROM department")
def _(spark, sf):
    return entities(spark, sf)["department"]


@query("lab_entities", f"WITH {IDS}, {OTHERS} SELECT * FROM lab")
def _(spark, sf):
    return entities(spark, sf)["lab"]


@query("person_lab_edges", f"WITH {IDS} SELECT obs_id, person_id, lab_id, {S.lab_role('name', 'lab_name')} AS role, CAST(70 AS INTEGER) AS pct, 'pending_verification' AS status FROM ids WHERE lab_id IS NOT NULL")
def _(spark, sf):
    return entities(spark, sf)["person_lab"]


@query("person_institution", f"""WITH RECURSIVE {IDS}, {PFOLD}, {PERSON}, {OTHERS}
SELECT p.person_id, p.name, u.name AS university_name, u.domain, d.name AS department_name FROM person p LEFT JOIN university u USING (university_id) LEFT JOIN department d ON p.department_id = d.department_id""")
def _(spark, sf):
    e = entities(spark, sf)
    return V.person_institution(e["person"], e["university"], e["department"]).select("person_id", "name", "university_name", "domain", "department_name")


@query("person_departments", f"""WITH {IDS}, p AS (SELECT person_id, arg_min(name, (scraped_at, obs_id)) AS name FROM ids GROUP BY person_id), {OTHERS}
SELECT p.person_id, p.name, i.department_id, i.obs_id, 'primary' AS appointment, CAST(90 AS INTEGER) AS pct, d.name AS department_name FROM p LEFT JOIN ids i USING (person_id) LEFT JOIN department d ON i.department_id = d.department_id""")
def _(spark, sf):
    e = entities(spark, sf)
    return V.person_departments(E.person_names(E.with_ids(obs(spark, sf))), e["person_department"], e["department"])


# lab edges of people from enrichment facts
EDGES = f"""edges AS (SELECT enrichment_id AS edge_id, person_key, lab_key, extracted_at AS created_at, total_citations % 3 <> 0 AS is_current,
  CASE WHEN enrichment_type = 'google_scholar' AND total_citations % 2 = 0 THEN 'Principal Investigator' WHEN enrichment_type = 'links' THEN NULL ELSE 'member' END AS role FROM enrichments)"""


def edges(spark, sf):
    role = F.when((F.col("enrichment_type") == "google_scholar") & (F.col("total_citations") % 2 == 0), "Principal Investigator").when(F.col("enrichment_type") != "links", "member")
    return enr(spark, sf).select(F.col("enrichment_id").alias("edge_id"), "person_key", "lab_key", F.col("extracted_at").alias("created_at"),
                                 (F.col("total_citations") % 3 != 0).alias("is_current"), role.alias("role"))


def customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("person_key"), F.col("c_name").alias("person_name"))


def labs(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lab_key"), F.col("s_name").alias("lab_name"))


@query("person_labs", f"""WITH {EDGES} SELECT c_custkey AS person_key, c_name AS person_name, e.lab_key, s_name AS lab_name, e.role, e.edge_id
FROM customer LEFT JOIN edges e ON c_custkey = e.person_key LEFT JOIN supplier ON e.lab_key = s_suppkey""")
def _(spark, sf):
    return V.person_labs(customers(spark, sf), edges(spark, sf).select("person_key", "lab_key", "role", "edge_id"), labs(spark, sf))


@query("person_enrichments", """SELECT a.person_key, a.enrichment_id, a.enrichment_type, b.total_citations, b.h_index, b.lab_key FROM (SELECT DISTINCT person_key, enrichment_id, enrichment_type FROM enrichments) a
JOIN enrichments b ON a.enrichment_id = b.enrichment_id AND a.enrichment_type = b.enrichment_type""")
def _(spark, sf):
    e = enr(spark, sf)
    links = e.select("person_key", "enrichment_id", "enrichment_type").distinct()
    facts = e.select("enrichment_id", "enrichment_type", "total_citations", "h_index", "lab_key")
    return V.person_enrichments(links, facts)


@query("lab_people", f"""WITH {EDGES}, t AS (SELECT person_key, count(DISTINCT enrichment_type) AS n_types FROM enrichments GROUP BY person_key)
SELECT s_suppkey AS lab_key, s_name AS lab_name, e.person_key, c_name AS person_name, e.edge_id, e.role, t.n_types FROM supplier JOIN edges e ON s_suppkey = e.lab_key JOIN customer ON e.person_key = c_custkey LEFT JOIN t ON e.person_key = t.person_key""")
def _(spark, sf):
    return V.lab_people(labs(spark, sf), edges(spark, sf).select("lab_key", "person_key", "edge_id", "role"), customers(spark, sf), enr(spark, sf))


@query("orphans", "SELECT c_custkey AS person_key, c_name AS person_name FROM customer WHERE c_custkey NOT IN (SELECT person_key FROM observations) AND c_custkey NOT IN (SELECT person_key FROM enrichments)")
def _(spark, sf):
    return V.orphans(customers(spark, sf), "person_key", obs(spark, sf), enr(spark, sf))


@query("orphan_people_without_lab", f"WITH {IDS} SELECT DISTINCT person_id FROM ids WHERE person_id NOT IN (SELECT person_id FROM ids WHERE lab_id IS NOT NULL)")
def _(spark, sf):
    e = entities(spark, sf)
    return V.orphans(e["person_department"].select("person_id").distinct(), "person_id", e["person_lab"])


@query("attach_lab_data", f"""WITH {LABV}, l AS (SELECT lab_key, count(*) AS n_records FROM lk GROUP BY lab_key)
SELECT obs_id, lower(trim(lab_name)) AS lab_key, n_records FROM observations o LEFT JOIN l ON lower(trim(o.lab_name)) = l.lab_key""")
def _(spark, sf):
    o = obs(spark, sf).select("obs_id", F.lower(F.trim("lab_name")).alias("lab_key"))
    return V.attach_lab_data(o, D.lab_rollup(obs(spark, sf))[0].select("lab_key", "n_records"), "lab_key")


@query("primary_lab", f"""WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY person_key ORDER BY CASE WHEN role = 'Principal Investigator' THEN 0 ELSE 1 END, created_at, edge_id, lab_key) AS rn
  FROM edges WHERE coalesce(role = 'Principal Investigator', FALSE) OR is_current) SELECT person_key, lab_key, role FROM r WHERE rn = 1""")
def _(spark, sf):
    return V.primary_lab(edges(spark, sf))


@query("current_members", f"WITH {EDGES} SELECT lab_key, person_key, coalesce(role, 'member') AS role FROM edges WHERE is_current")
def _(spark, sf):
    return V.current_members(edges(spark, sf))


@query("lab_metrics", f"""WITH {EDGES} SELECT lab_key, count(*) AS member_count, count(*) FILTER (WHERE role = 'Principal Investigator') AS pi_count, count(*) FILTER (WHERE role = 'Principal Investigator') > 1 AS is_multi_pi,
  CASE WHEN lab_key % 2 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS completeness FROM edges GROUP BY lab_key""")
def _(spark, sf):
    return V.lab_metrics(edges(spark, sf), F.when(F.col("lab_key") % 2 == 0, "https://lab.edu"))


AGE = f"CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(extracted_at)) / CAST(86400000000 AS DOUBLE)) AS BIGINT)"


@query("age_freshness", f"""SELECT enrichment_id, extracted_at, lab_key, age_days, round(greatest(CAST(0 AS DOUBLE), 1 - age_days / CAST(30 AS DOUBLE)), 6) AS freshness,
  CASE WHEN age_days < 1 THEN 'fresh' WHEN age_days < 30 THEN 'aging' ELSE 'stale' END AS band FROM (SELECT *, {AGE} AS age_days FROM enrichments) a""")
def _(spark, sf):
    got = V.age_freshness(enr(spark, sf), "extracted_at", now())
    return got.select("enrichment_id", "extracted_at", "lab_key", "age_days", F.round("freshness", 6).alias("freshness"), "band")


@query("person_metrics", f"""SELECT person_key, count(*) AS total_enrichments, round(least(CAST(1 AS DOUBLE), count(*) / CAST(5 AS DOUBLE)), 6) AS completeness,
  round(CAST(sum(greatest(0, 30 - {AGE})) AS DOUBLE) / (count(*) * 30), 6) AS freshness, count(DISTINCT lab_key) AS n_sources FROM enrichments GROUP BY person_key""")
def _(spark, sf):
    return V.person_metrics(enr(spark, sf), now(), "lab_key")


@query("distinct_sources", """SELECT person_key, count(DISTINCT url) AS n_sources FROM (SELECT person_key, profile_url AS url FROM observations WHERE profile_url <> ''
  UNION ALL SELECT person_key, concat('https://lab', CAST(lab_key AS STRING), '.edu') FROM enrichments) u GROUP BY person_key""")
def _(spark, sf):
    from acadspark.operators.views import distinct_sources
    a = obs(spark, sf).filter("profile_url <> ''").select("person_key", F.col("profile_url").alias("url"))
    b = enr(spark, sf).select("person_key", F.concat(F.lit("https://lab"), F.col("lab_key").cast("string"), F.lit(".edu")).alias("url"))
    return distinct_sources(a, b).groupBy("person_key").agg(F.count("*").alias("n_sources"))


@query("citation_latest", """SELECT person_key, arg_max(total_citations, (extracted_at, enrichment_id, lab_key)) FILTER (WHERE enrichment_type = 'google_scholar') AS total_citations,
  arg_max(h_index, (extracted_at, enrichment_id, lab_key)) FILTER (WHERE enrichment_type = 'google_scholar') AS h_index FROM enrichments GROUP BY person_key""")
def _(spark, sf):
    return V.citation_latest(enr(spark, sf))


@query("top_cited", """SELECT person_key, enrichment_id, extracted_at, lab_key, total_citations, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY person_key ORDER BY total_citations DESC, enrichment_id, extracted_at, lab_key) AS rank FROM enrichments) r WHERE rank <= 10""")
def _(spark, sf):
    return V.top_cited(enr(spark, sf)).select("person_key", "enrichment_id", "extracted_at", "lab_key", "total_citations", "rank")


@query("cap_lists", """SELECT person_key, enrichment_type, enrichment_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY person_key, enrichment_type ORDER BY enrichment_id, extracted_at, lab_key) AS rank FROM enrichments) r
WHERE rank <= CASE enrichment_type WHEN 'google_scholar' THEN 10 WHEN 'profile' THEN 15 WHEN 'links' THEN 5 ELSE 20 END""")
def _(spark, sf):
    caps = {"google_scholar": 10, "profile": 15, "links": 5, "research": 20}
    order = [F.col("enrichment_id"), F.col("extracted_at"), F.col("lab_key")]
    return V.cap_lists(enr(spark, sf), caps, "enrichment_type", ("person_key",), order).select("person_key", "enrichment_type", "enrichment_id", "rank")


@query("contact_summary", """WITH x AS (SELECT obs_id, concat('new', CAST(obs_id AS STRING), '@x.edu') AS email, CAST(NULL AS STRING) AS phone FROM observations WHERE obs_id % 9 = 0),
j AS (SELECT o.obs_id, coalesce(x.email, o.email) AS email, coalesce(x.phone, o.phone) AS phone, office, profile_url, personal_website FROM observations o LEFT JOIN x ON o.obs_id = x.obs_id)
SELECT obs_id, field, value FROM (SELECT obs_id, 'email' AS field, email AS value FROM j UNION ALL SELECT obs_id, 'phone', phone FROM j UNION ALL SELECT obs_id, 'office', office FROM j
  UNION ALL SELECT obs_id, 'profile_url', profile_url FROM j UNION ALL SELECT obs_id, 'personal_website', personal_website FROM j) u WHERE value <> ''""")
def _(spark, sf):
    o = obs(spark, sf)
    extra = o.filter("obs_id % 9 = 0").select("obs_id", F.concat(F.lit("new"), F.col("obs_id").cast("string"), F.lit("@x.edu")).alias("email"), F.lit(None).cast("string").alias("phone"))
    return V.contact_summary(o, extra, "obs_id")


@query("relationship_map", f"""WITH RECURSIVE {IDS}, {PFOLD}, {PERSON}, {OTHERS},
c AS (SELECT (SELECT count(*) FROM person) AS n_people, (SELECT count(*) FROM lab) AS n_labs, (SELECT count(*) FROM university) AS n_universities, (SELECT count(*) FROM department) AS n_departments,
  (SELECT count(*) FROM ids WHERE lab_id IS NOT NULL) AS n_person_lab, (SELECT count(*) FROM ids) AS n_person_department, (SELECT count(*) FROM lab) AS n_lab_department,
  (SELECT count(*) FROM enrichments) AS n_enrichments, (SELECT count(*) FROM enrichments WHERE enrichment_type = 'google_scholar') AS n_google_scholar, (SELECT count(*) FROM enrichments WHERE enrichment_type = 'profile') AS n_profile,
  (SELECT count(*) FROM enrichments WHERE enrichment_type = 'links') AS n_links, (SELECT count(*) FROM enrichments WHERE enrichment_type = 'research') AS n_research,
  CAST(0 AS BIGINT) AS orphan_people, CAST(0 AS BIGINT) AS orphan_labs, (SELECT CAST(sum(CAST(round(confidence * 1000000) AS BIGINT)) AS BIGINT) FROM person) AS micro)
SELECT * EXCLUDE (micro), round((micro + n_labs * 700000) / ((n_people + n_labs) * CAST(1000000 AS DOUBLE)), 6) AS average_confidence, round(least(CAST(1 AS DOUBLE), n_enrichments / (n_people * CAST(3 AS DOUBLE))), 6) AS data_completeness FROM c""")
def _(spark, sf):
    return V.relationship_map(entities(spark, sf, staged=True), enr(spark, sf))


@query("confidence_band", "SELECT obs_id, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' WHEN c >= 0.2 THEN 'low' ELSE 'uncertain' END AS band FROM (SELECT obs_id, confidence_score * (obs_id % 5) / CAST(4 AS DOUBLE) AS c FROM observations) o")
def _(spark, sf):
    c = F.col("confidence_score") * (F.col("obs_id") % 5) / F.lit(4.0)
    return obs(spark, sf).select("obs_id", Z.confidence_band(c).alias("band"))


@query("impact_profile", """SELECT enrichment_id, extracted_at, lab_key, CASE WHEN c > 10000 THEN 'exceptional' WHEN c > 5000 THEN 'high' WHEN c > 1000 THEN 'moderate' ELSE 'emerging' END AS impact_level,
  CASE WHEN h > 50 THEN 'very_high' WHEN h > 25 THEN 'high' WHEN h > 10 THEN 'moderate' END AS h_index_note,
  CASE WHEN n > 50 THEN 'extensive' WHEN n > 20 THEN 'active' WHEN n > 5 THEN 'moderate' ELSE 'limited' END AS collaboration_level,
  CASE WHEN h > 30 THEN 'senior_researcher' WHEN h > 15 THEN 'established_researcher' WHEN c > 100 THEN 'active_researcher' ELSE 'emerging_researcher' END AS standing,
  CASE WHEN n > 5 THEN CAST(1 AS DOUBLE) * 40 / 100 + CASE WHEN n > 5 THEN CAST(0.2 AS DOUBLE) ELSE 0 END ELSE CAST(0.4 AS DOUBLE) END AS completeness
FROM (SELECT *, total_citations * 3 AS c, h_index AS h, lab_key % 60 AS n FROM enrichments) e""")
def _(spark, sf):
    n = F.col("lab_key") % 60
    prof = Z.impact_profile(F.col("total_citations") * 3, F.col("h_index"), F.array().cast("array<string>"), n, n, F.lit(False), F.lit(None).cast("string"))
    return enr(spark, sf).withColumn("p", prof).select("enrichment_id", "extracted_at", "lab_key", "p.impact_level", "p.h_index_note", "p.collaboration_level", "p.standing", "p.completeness")


# ---- reports ----

@query("batch_report", f"""WITH {S.LINKS}, g AS (SELECT o.obs_id, count(*) FILTER (WHERE link_type = 'social_media') AS s, count(*) FILTER (WHERE link_type = 'lab_website') AS l, any_value(o.http_status) AS st, any_value(o.name) AS name
  FROM observations o LEFT JOIN links k ON o.obs_id = k.obs_id GROUP BY o.obs_id),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE name <> '') AS processed, count(*) FILTER (WHERE s > 0) AS social_found, count(*) FILTER (WHERE s > 0 AND st = 200) AS social_replaced,
  count(*) FILTER (WHERE l > 0) AS labs_found, count(*) FILTER (WHERE l > 0 AND st = 200) AS labs_enriched FROM g)
SELECT *, round(CAST(processed AS DOUBLE) / greatest(total, 1), 6) AS success_rate, round(CAST(social_replaced AS DOUBLE) / greatest(social_found, 1), 6) AS replacement_rate,
  round(CAST(labs_enriched AS DOUBLE) / greatest(labs_found, 1), 6) AS enrichment_rate FROM c""")
def _(spark, sf):
    g = L.link_groups(people(spark, sf))
    ok = F.coalesce(F.col("http_status") == 200, F.lit(False))
    return R.batch_report(g.withColumns({"ok": F.col("name") != "", "replaced": (F.col("n_social") > 0) & ok, "enriched": (F.col("n_lab") > 0) & ok}))


@query("enrichment_report", """SELECT count(*) AS processed, count(*) FILTER (WHERE h_index * 2 > 20) AS successful, count(*) FILTER (WHERE h_index * 2 <= 20) AS failed,
  count(*) FILTER (WHERE h_index * 2 > 20 AND enrichment_type = 'google_scholar') AS scholar_profiles, count(*) FILTER (WHERE h_index * 2 > 20 AND enrichment_type = 'links') AS lab_sites,
  count(*) FILTER (WHERE h_index * 2 > 20 AND enrichment_type = 'profile') AS university_profiles, round(CAST(sum(total_citations) AS DOUBLE) / greatest(count(*), 1), 6) AS mean_seconds FROM enrichments""")
def _(spark, sf):
    return R.enrichment_report(enr(spark, sf).withColumns({"confidence_pct": F.col("h_index") * 2, "seconds": F.col("total_citations")}))


@query("stage_report", f"""WITH {S.LINKS}, {FETCHED}
SELECT (SELECT count(DISTINCT obs_id) FROM checked) AS people, (SELECT count(*) FROM checked WHERE is_accessible) AS accessible, (SELECT count(*) FROM checked WHERE NOT is_accessible) AS broken,
  (SELECT count(*) FROM observations WHERE obs_id % 3 > 0) AS enhanced, (SELECT CAST(sum(obs_id % 3) AS BIGINT) FROM observations) AS links_added,
  (SELECT count(*) FROM enrichments WHERE enrichment_type = 'google_scholar') AS scholars, (SELECT count(*) FROM enrichments WHERE enrichment_type = 'profile') AS websites,
  (SELECT count(*) FROM enrichments WHERE enrichment_type = 'links') AS labs, (SELECT CAST(sum(h_index) AS BIGINT) FROM enrichments) AS data_points""")
def _(spark, sf):
    kind = F.when(F.col("enrichment_type") == "google_scholar", "scholar").when(F.col("enrichment_type") == "profile", "website").when(F.col("enrichment_type") == "links", "lab")
    return R.stage_report(checked(spark, sf), obs(spark, sf).select((F.col("obs_id") % 3).alias("added")), enr(spark, sf).select(kind.alias("kind"), F.col("h_index").alias("points")))


@query("data_points", f"""SELECT obs_id, CAST(CASE WHEN coalesce(name, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(title, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(email, '') <> '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(phone, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(office, '') <> '' THEN 1 ELSE 0 END + len({sql_interests('research_interests')}) AS BIGINT) AS points FROM observations""")
def _(spark, sf):
    o = obs(spark, sf).withColumn("interest_list", X.interests(F.col("research_interests")))
    return R.data_points(o, ("name", "title", "email", "phone", "office"), ("interest_list",)).select("obs_id", "points")


@query("university_stats", """SELECT university, count(DISTINCT department) AS programs, count(*) AS people, count(email) AS with_email, count(nullif(personal_website, '')) AS with_site, count(lab_name) AS with_lab,
  count(DISTINCT nullif(lab_website, '')) AS lab_sites, round(count(email) * CAST(100 AS DOUBLE) / count(*), 6) AS email_rate, round(count(nullif(personal_website, '')) * CAST(100 AS DOUBLE) / count(*), 6) AS site_rate,
  round(count(lab_name) * CAST(100 AS DOUBLE) / count(*), 6) AS lab_rate FROM observations GROUP BY university""")
def _(spark, sf):
    return R.university_stats(obs(spark, sf))


@query("university_stats_join", """WITH p AS (SELECT DISTINCT university, department, concat(university, '/', department) AS program_id FROM observations),
l AS (SELECT DISTINCT concat(university, '/', department) AS program_id, lab_website FROM observations WHERE lab_website IS NOT NULL)
SELECT a.university, a.programs, coalesce(f.people, 0) AS people, coalesce(f.with_email, 0) AS with_email, coalesce(s.lab_sites, 0) AS lab_sites FROM (SELECT university, count(*) AS programs FROM p GROUP BY university) a
LEFT JOIN (SELECT university, count(*) AS people, count(email) AS with_email FROM observations GROUP BY university) f ON a.university = f.university
LEFT JOIN (SELECT p.university, count(*) AS lab_sites FROM l JOIN p USING (program_id) GROUP BY p.university) s ON a.university = s.university""")
def _(spark, sf):
    o = obs(spark, sf).withColumn("program_id", F.concat("university", F.lit("/"), "department"))
    programs = o.select("program_id", "university", "department").distinct()
    sites = o.filter("lab_website IS NOT NULL").select("program_id", "lab_website").distinct()
    return R.university_stats_join(programs, o.select("program_id", "email"), sites)


@query("directory_stats", f"WITH {INSTITUTIONS} SELECT state_code, max(state) AS state, count(*) AS institutions FROM institutions GROUP BY state_code")
def _(spark, sf):
    return R.directory_stats(institutions(spark, sf))


@query("profile_stats", """WITH s AS (SELECT *, CASE WHEN coalesce(research_interests, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(personal_website, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(phone, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(office, '') <> '' THEN 1 ELSE 0 END < 2 AND coalesce(profile_url, '') <> '' AS tried FROM observations)
SELECT count(*) AS processed, count(*) FILTER (WHERE tried) AS enriched, count(*) FILTER (WHERE tried AND research_interests IS NOT NULL) AS interests_found, CAST(0 AS BIGINT) AS biographies,
  count(*) FILTER (WHERE tried AND (phone IS NOT NULL OR office IS NOT NULL)) AS contacts, CAST(coalesce(sum(CASE WHEN tried THEN obs_id % 4 END), 0) AS BIGINT) AS extra_links FROM s""")
def _(spark, sf):
    from acadspark.operators.predicates import sparse_records
    s = sparse_records(obs(spark, sf)).withColumns({
        "found_interests": F.col("research_interests").isNotNull(), "found_bio": F.lit(False), "found_contact": F.col("phone").isNotNull() | F.col("office").isNotNull(), "n_links": F.col("obs_id") % 4})
    return R.profile_stats(s)


@query("flow_stats", f"""WITH {S.LINKS}, n AS (SELECT o.obs_id, o.university, o.department, o.name, o.scraped_at, count(l.url) AS n_links FROM observations o LEFT JOIN links l ON o.obs_id = l.obs_id GROUP BY ALL)
SELECT university, department, CAST(grouping_id(university, department) AS INTEGER) AS level, count(*) AS scraped, count(*) FILTER (WHERE name <> '') AS processed, count(*) FILTER (WHERE n_links > 0) AS enriched,
  CAST(sum(n_links) AS BIGINT) AS links, round(count(*) / CAST(greatest((epoch_us(max(scraped_at)) - epoch_us(min(scraped_at))) // 86400000000, 1) AS DOUBLE), 6) AS people_per_day
FROM n GROUP BY GROUPING SETS ((university, department), ())""")
def _(spark, sf):
    return R.flow_stats(people(spark, sf).withColumn("n_links", F.size("links").cast("bigint")))


@query("department_counts", """SELECT university, o.department, people, structure_type, confidence FROM (SELECT university, department, count(*) AS people FROM observations GROUP BY university, department) o
LEFT JOIN (SELECT department, CASE WHEN length(department) % 2 = 0 THEN 'table' ELSE 'list' END AS structure_type, CASE WHEN length(department) % 2 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS confidence
  FROM (SELECT DISTINCT department FROM observations) d) s ON o.department = s.department""")
def _(spark, sf):
    o = obs(spark, sf)
    even = F.length("department") % 2 == 0
    s = o.select("department").distinct().select("department", F.when(even, "table").otherwise("list").alias("structure_type"), F.when(even, 0.9).otherwise(0.8).alias("confidence"))
    return R.department_counts(o, s)


@query("ingest_report", f"""WITH RECURSIVE {RESOLVED}, {IDS}
SELECT (SELECT count(*) FROM observations WHERE name <> '') AS processed, CAST(0 AS BIGINT) AS missing_name, (SELECT count(DISTINCT entity) FROM resolved) AS created,
  (SELECT count(DISTINCT university_id) FROM ids) AS universities, (SELECT count(DISTINCT department_id) FROM ids) AS departments, (SELECT count(DISTINCT lab_id) FROM ids) AS labs,
  (SELECT count(*) FROM ids WHERE research_interests <> '') AS enrichments, (SELECT count(*) FROM observations) - (SELECT count(DISTINCT entity) FROM resolved) AS merged,
  (SELECT count(*) FROM ids) + (SELECT count(*) FROM ids WHERE lab_id IS NOT NULL) AS associations""")
def _(spark, sf):
    o = obs(spark, sf)
    return R.ingest_report(o, D.resolve_person(o), entities(spark, sf, staged=True))


@query("job_rollup", """SELECT host, count(*) AS items, count(*) FILTER (WHERE status_code >= 500) AS failed, round((count(*) - count(*) FILTER (WHERE status_code >= 500)) * CAST(100 AS DOUBLE) / count(*), 6) AS progress,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE), 3) AS seconds,
  CASE WHEN count(*) FILTER (WHERE status_code >= 500) = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE status_code >= 500) > 0 THEN 'partial' ELSE 'completed' END AS status FROM fetch_log GROUP BY host""")
def _(spark, sf):
    return R.job_rollup(view(spark, sf, "fetch_log"), "host")


@query("session_counters", f"""WITH {S.LINKS} SELECT (SELECT count(DISTINCT university) FROM observations) AS universities, (SELECT count(*) FROM (SELECT DISTINCT university, department FROM observations) d) AS departments,
  (SELECT count(*) FROM observations) AS people, (SELECT count(*) FROM links WHERE link_type = 'lab_website') AS lab_links, (SELECT count(*) FROM observations WHERE http_status = 200) AS successes,
  (SELECT count(*) FROM observations WHERE http_status <> 200) AS failures""")
def _(spark, sf):
    return R.session_counters(people(spark, sf), F.size(F.filter("links", lambda x: x["link_type"] == "lab_website")).cast("bigint"))


WORDS = f"words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM documents), kept AS (SELECT * FROM words WHERE regexp_matches(word, '^[a-z]{{4,}}$') AND word NOT IN ({', '.join(S.q(w) for w in K.KEYWORD_STOPWORDS)}))"


@query("keyword_freq", f"WITH {WORDS} SELECT word, count(*) AS n FROM kept GROUP BY word ORDER BY n DESC, word LIMIT 20")
def _(spark, sf):
    return R.keyword_freq(table(spark, sf, "documents").select("doc_id", "text"))


@query("document_keywords", f"""WITH {WORDS} SELECT doc_id, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS rank FROM kept GROUP BY doc_id, word) r WHERE rank <= 20""")
def _(spark, sf):
    return R.document_keywords(table(spark, sf, "documents").select("doc_id", "text"))


def _groups(text, groups):
    return "list_filter([" + ", ".join(f"CASE WHEN {S.rx(text, w)} THEN '{g}' END" for g, w in groups) + "], lambda x: x IS NOT NULL)"


_AGENCY = ("coalesce(nullif(regexp_extract(text, '(?i)(nsf|nih|doe|darpa|nasa|onr|afosr)\\s*([^,.]+)', 2), ''), "
           "nullif(regexp_extract(text, '(?i)(funded by|supported by|sponsored by)\\s+([^,.]+)', 2), ''), '')")


@query("lab_profile", f"""WITH f AS (SELECT doc_id, text, list_distinct({S.all_fields('text', X.MEMBER_PATTERNS)}) AS members, {S.all_fields('text', X.PROJECT_PATTERNS, 10)} AS projects, {_kw(K.RESEARCH_AREAS)} AS interests,
    {_EQUIP} AS equipment, {_AGENCY} AS agency, {S.first_field('text', X.RESEARCH_TEXT_PATTERNS, 50, group=0)} AS descr FROM documents),
g AS (SELECT *, lower(array_to_string(list_concat(projects, interests), ' ')) AS topics, lower(array_to_string(equipment, ' ')) AS tools, lower(array_to_string(members, ' ')) AS who, CASE WHEN agency <> '' THEN 1 ELSE 0 END AS nf FROM f)
SELECT doc_id, CASE WHEN len(members) > 20 THEN 'large' WHEN len(members) > 10 THEN 'medium' WHEN len(members) > 3 THEN 'small' ELSE 'minimal' END AS size_class, coalesce({S.rx('who', Z.HIERARCHY_WORDS)}, FALSE) AS has_hierarchy,
  coalesce(array_to_string({_groups('topics', Z.THEME_WORDS)}, '|'), '') AS themes, least(len({_groups('topics', Z.THEME_WORDS)}) / CAST(5 AS DOUBLE), CAST(1 AS DOUBLE)) AS interdisciplinary, nf / CAST(4 AS DOUBLE) AS funding_diversity,
  coalesce(array_to_string({_groups('tools', Z.CAPABILITY_WORDS)}, '|'), '') AS capabilities, 'low' AS productivity,
  CAST(25 * (CASE WHEN len(projects) > 0 THEN 1 ELSE 0 END + CASE WHEN len(members) > 0 THEN 1 ELSE 0 END + CASE WHEN len(equipment) > 0 THEN 1 ELSE 0 END + nf) AS DOUBLE) / 100 AS richness,
  CAST(60 + CASE WHEN length(descr) > 20 THEN 20 ELSE 0 END AS DOUBLE) / 100 AS presentation FROM g""")
def _(spark, sf):
    from acadspark.plans.enrichment import lab_profiles
    return lab_profiles(table(spark, sf, "documents").select("doc_id", "text"))
