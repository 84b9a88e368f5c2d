"""Registries over batches, crawl order, nested elements and rules per site."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from acadspark.catalog import sqlparts as S
from acadspark.catalog.entity_queries import IDS, OTHERS, PERSON, PFOLD, RESOLVED, enr, obs
from acadspark.catalog.registry import query
from acadspark.operators import dedup as D
from acadspark.operators import entities as E
from acadspark.operators import nested as H
from acadspark.operators import registry as R
from acadspark.operators import site_rules as Y
from acadspark.plans import crawl as C
from acadspark.sources.fixtures import view

# ---- registries: records up to a day, then the later ones ----

DAY = "1995-01-01"
FIRST = f"(SELECT * FROM observations WHERE scraped_at < DATE '{DAY}') f"
LABS = f"""{{0}}k AS (SELECT CASE WHEN coalesce(lab_name, '') <> '' THEN {S.institution_key('lab_name')} END AS lab_key, nullif(lab_website, '') AS site, obs_id FROM {{1}}),
{{0}}nodes AS (SELECT lab_key, site, min(obs_id) AS node FROM {{0}}k WHERE lab_key IS NOT NULL OR site IS NOT NULL GROUP BY lab_key, site),
{{0}}hub AS (SELECT node, concat('n:', lab_key) AS hub FROM {{0}}nodes WHERE lab_key IS NOT NULL UNION ALL SELECT node, concat('s:', site) FROM {{0}}nodes WHERE site IS NOT NULL),
{{0}}edge AS (SELECT h.node AS a, m.lo AS b FROM {{0}}hub h JOIN (SELECT hub, min(node) AS lo FROM {{0}}hub GROUP BY hub) m USING (hub)),
{{0}}both AS (SELECT a, b FROM {{0}}edge UNION SELECT b, a FROM {{0}}edge),
{{0}}reach AS (SELECT node AS a, node AS b FROM {{0}}nodes UNION SELECT r.a, e.b FROM {{0}}reach r JOIN {{0}}both e ON r.b = e.a),
{{0}}resolved AS (SELECT k.obs_id, t.entity FROM {{0}}k k JOIN {{0}}nodes n ON k.lab_key IS NOT DISTINCT FROM n.lab_key AND k.site IS NOT DISTINCT FROM n.site
  JOIN (SELECT a, min(b) AS entity FROM {{0}}reach GROUP BY a) t ON n.node = t.a)"""
_NAMES = r"\b(k|nodes|reach|roots|resolved)\b"
PEOPLE_ALL = re.sub(_NAMES, r"pa_\1", RESOLVED)
PEOPLE_FIRST = re.sub(_NAMES, r"pf_\1", RESOLVED.replace("FROM observations", f"FROM {FIRST}"))


def kept(both: str, first: str, out: str) -> str:
    """Ids after the second batch: the oldest entity of a group, else the smallest record of the group; and the log."""
    return f"""{out}_was AS (SELECT b.entity AS grp, f.entity AS old FROM {both} b JOIN {first} f USING (obs_id) GROUP BY ALL),
{out}_id AS (SELECT b.entity AS grp, coalesce(min(w.old), b.entity) AS entity, count(w.old) = 0 AS born FROM (SELECT DISTINCT entity FROM {both}) b LEFT JOIN {out}_was w ON w.grp = b.entity GROUP BY b.entity),
{out} AS (SELECT b.obs_id, i.entity FROM {both} b JOIN {out}_id i ON b.entity = i.grp),
{out}_log AS (SELECT 1 AS batch, 'new' AS kind, entity, CAST(NULL AS BIGINT) AS other FROM {first} GROUP BY entity
  UNION ALL SELECT 2, 'new', entity, NULL FROM {out}_id WHERE born
  UNION ALL SELECT 2, 'merge', w.old, i.entity FROM {out}_was w JOIN {out}_id i USING (grp) WHERE w.old <> i.entity)"""


PEOPLE = f"{PEOPLE_ALL}, {PEOPLE_FIRST}, {kept('pa_resolved', 'pf_resolved', 'preg')}"
LABREG = f"{LABS.format('la_', 'observations')}, {LABS.format('lf_', FIRST)}, {kept('la_resolved', 'lf_resolved', 'lreg')}"
REG_IDS = IDS.replace(S.person_id(S.dedup_key("name", "university")), "CAST(preg.entity AS STRING)").replace(S.lab_id("university", "lab_name", "lab_website"), "CAST(lreg.entity AS STRING)").replace(
    "SELECT *,", "SELECT observations.*,").replace("FROM observations)", "FROM observations JOIN preg USING (obs_id) LEFT JOIN lreg USING (obs_id))")


def two_batches(spark, sf, nodes):
    """Registry of all observations after two batches, and the log of both."""
    o = obs(spark, sf)
    early = F.col("scraped_at") < F.lit(DAY).cast("date")
    first, log = R.update(R.empty_registry(spark), nodes(o.filter(early)), 1)
    second, more = R.update(first, nodes(o.filter(~early)), 2)
    return second, log.unionByName(more)


@query("person_registry", f"WITH RECURSIVE {PEOPLE} SELECT obs_id, entity FROM preg")
def _(spark, sf):
    return R.with_entities(obs(spark, sf), R.person_nodes, two_batches(spark, sf, R.person_nodes)[0], "entity").select("obs_id", "entity").filter("entity IS NOT NULL")


@query("lab_registry", f"WITH RECURSIVE {LABREG} SELECT obs_id, entity FROM lreg")
def _(spark, sf):
    return R.with_entities(obs(spark, sf), R.lab_nodes, two_batches(spark, sf, R.lab_nodes)[0], "entity").select("obs_id", "entity").filter("entity IS NOT NULL")


@query("registry_log", f"WITH RECURSIVE {PEOPLE}, {LABREG} SELECT 'person' AS registry, * FROM preg_log UNION ALL SELECT 'lab', * FROM lreg_log")
def _(spark, sf):
    logs = [two_batches(spark, sf, n)[1].select(F.lit(name).alias("registry"), "batch", "kind", "entity", "other") for name, n in (("person", R.person_nodes), ("lab", R.lab_nodes))]
    return logs[0].unionByName(logs[1])


def registry_entities(spark, sf):
    return E.build_entities(obs(spark, sf), True, (two_batches(spark, sf, R.person_nodes)[0], two_batches(spark, sf, R.lab_nodes)[0]))


@query("registry_person_entities", f"WITH RECURSIVE {PEOPLE}, {LABREG}, {REG_IDS}, {PFOLD}, {PERSON} SELECT * FROM person")
def _(spark, sf):
    return registry_entities(spark, sf)["person"].withColumn("confidence", D.six_places(F.col("confidence")))


@query("registry_lab_entities", f"WITH RECURSIVE {PEOPLE}, {LABREG}, {REG_IDS}, {OTHERS} SELECT * FROM lab")
def _(spark, sf):
    return registry_entities(spark, sf)["lab"]


@query("registry_enrichment_edges", f"""WITH RECURSIVE {PEOPLE}
SELECT enrichment_id, CAST(entity AS STRING) AS person_id, enrichment_type, CAST(80 AS INTEGER) AS pct FROM enrichments JOIN preg USING (obs_id) WHERE enrichment_type IN ('google_scholar', 'links', 'profile')""")
def _(spark, sf):
    registry = two_batches(spark, sf, R.person_nodes)[0]
    named = R.with_entities(obs(spark, sf), R.person_nodes, registry, "entity").filter("entity IS NOT NULL").withColumn("person_id", F.col("entity").cast("string"))
    return E.enrichment_edges(named, enr(spark, sf))


# ---- crawl order ----

@query("crawl_chain", """WITH RECURSIVE seeds AS (SELECT DISTINCT concat('https://u', CAST(person_key % 25 AS STRING), '.edu/') AS url FROM observations),
reach AS (SELECT url, 0 AS depth FROM seeds UNION SELECT l.dst, r.depth + 1 FROM reach r JOIN crawl_links l ON l.src = r.url WHERE r.depth < 12),
best AS (SELECT url, min(depth) AS depth FROM reach GROUP BY url),
par AS (SELECT b.url, min(l.src) AS parent FROM best b JOIN crawl_links l ON l.dst = b.url JOIN best p ON p.url = l.src AND p.depth = b.depth - 1 GROUP BY b.url)
SELECT b.url, b.depth, par.parent, CASE WHEN contains(b.url, '/research/') THEN 'lab' WHEN contains(b.url, '/directory') THEN 'directory' WHEN contains(b.url, '/programs/') THEN 'program'
  WHEN contains(b.url, '/people/') THEN 'profile' ELSE 'other' END AS kind, b.url IN (SELECT src FROM crawl_links) AS fetched FROM best b LEFT JOIN par USING (url)""")
def _(spark, sf):
    seeds = obs(spark, sf).select(F.concat(F.lit("https://u"), (F.col("person_key") % 25).cast("string"), F.lit(".edu/")).alias("url"))
    return C.crawl_chain(seeds, view(spark, sf, "crawl_pages"))


# ---- nested elements ----

_LIST = "SELECT obs_id AS page_id, {} AS list_open, {} AS list_close, {} AS parent_open, {} AS parent_item_open, {} AS depth, '{}' AS list_type, {} AS item_no, {} AS item_open, {} AS text FROM observations"
_NO = "CAST(NULL AS BIGINT)"
_LISTS = [(4, 21, _NO, _NO, 1, "ul", 1, 5, "department"), (6, 17, 4, 5, 2, "ol", 1, 7, "name"), (8, 13, 6, 7, 3, "ul", 1, 9, "coalesce(title, '')"), (8, 13, 6, 7, 3, "ul", 2, 11, "coalesce(lab_name, '')"),
          (6, 17, 4, 5, 2, "ol", 2, 15, "'second'"), (4, 21, _NO, _NO, 1, "ul", 2, 19, "concat('tail ', CAST(obs_id AS STRING))")]
_CELL = "SELECT obs_id AS page_id, {} AS table_open, {} AS table_close, {} AS parent_open, {} AS parent_row, {} AS parent_col, {} AS depth, {} AS row_no, {} AS col_no, {} AS row_span, {} AS col_span, {} AS header, {} AS text FROM observations"
_CELLS = [(22, 51, _NO, _NO, _NO, 1, 0, 0, 1, 2, "TRUE", "university"), (22, 51, _NO, _NO, _NO, 1, 1, 0, 2, 1, "FALSE", "department"), (22, 51, _NO, _NO, _NO, 1, 1, 1, 1, 1, "FALSE", "''"),
          (31, 44, 22, 1, 1, 2, 0, 0, 1, 1, "FALSE", "name"), (31, 44, 22, 1, 1, 2, 0, 1, 1, 1, "FALSE", "'x'"), (36, 41, 31, 0, 1, 3, 0, 0, 1, 1, "FALSE", "coalesce(title, '')"),
          (22, 51, _NO, _NO, _NO, 1, 2, 1, 1, 1, "FALSE", "'last'")]


def _long(rows: str, text: str) -> str:
    return f"SELECT page_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in text.split())}, * EXCLUDE (page_id, {', '.join(text.split())}) FROM ({rows}) t"


@query("nested_lists", _long(" UNION ALL ".join(_LIST.format(*r) for r in _LISTS), "list_open list_close parent_open parent_item_open depth item_no item_open"))
def _(spark, sf):
    return H.nested_lists(view(spark, sf, "nested_pages"))


@query("nested_tables", _long(" UNION ALL ".join(_CELL.format(*r) for r in _CELLS), "table_open table_close parent_open parent_row parent_col depth row_no col_no row_span col_span"))
def _(spark, sf):
    return H.nested_tables(view(spark, sf, "nested_pages"))


@query("table_grid", """SELECT obs_id AS page_id, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, text FROM (
  SELECT obs_id, unnest([0, 0, 1, 1, 2, 2]) AS row_no, unnest([0, 1, 0, 1, 0, 1]) AS col_no, unnest([university, university, department, '', department, 'last']) AS text FROM observations) t""")
def _(spark, sf):
    return H.grid(H.nested_tables(view(spark, sf, "nested_pages")).filter("depth = 1")).select("page_id", "row_no", "col_no", "text")


# ---- rules per site ----

SITE_RULES = [("site0.edu", "article.card", "h4.nm", "span.role", "h4 a"), ("site1.edu", "tr.row", "td.who", "td.pos i", "a.page")]


@query("people_by_rules", """
SELECT obs_id AS page_id, 'site0.edu' AS site, CAST(0 AS BIGINT) AS pos, name, nullif(title, '') AS title, nullif(email, '') AS email, concat('https://site0.edu/p/', CAST(obs_id AS STRING)) AS profile_url
FROM observations WHERE obs_id % 3 = 0
UNION ALL SELECT obs_id, 'site1.edu', 0, name, nullif(title, ''), NULL, concat('https://own.edu/', CAST(obs_id AS STRING)) FROM observations WHERE obs_id % 3 = 1
UNION ALL SELECT obs_id, 'site1.edu', 1, concat('Second ', department), NULL, NULL, NULL FROM observations WHERE obs_id % 3 = 1""")
def _(spark, sf):
    rules = spark.createDataFrame(SITE_RULES, "site string, item string, name string, title string, link string")
    return Y.people_by_rules(view(spark, sf, "rule_pages"), rules)
