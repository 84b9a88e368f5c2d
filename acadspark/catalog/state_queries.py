"""Keyed streams, result files of any shape, sitemap indexes, documents, exact splits and the job of all stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from acadspark.catalog import sqlparts as S
from acadspark.catalog.chain_queries import LABREG, PEOPLE, REG_IDS, registry_entities
from acadspark.catalog.entity_queries import OTHERS, PERSON, PFOLD, enr, obs
from acadspark.catalog.link_queries import NAMED
from acadspark.catalog.page_queries import profiles
from acadspark.catalog.registry import ORACLES, query
from acadspark.catalog.store_queries import examples, typed_pages
from acadspark.functions import names as N
from acadspark.operators import candidates as C
from acadspark.operators import learning as Y
from acadspark.operators import views as V
from acadspark.plans import crawl, pipeline
from acadspark.plans import links as PL
from acadspark.session import stage_dir
from acadspark.sources import tables
from acadspark.sources.fixtures import directory_pages, table, view
from acadspark.streaming import jobs, state

# ---- keyed streams ----

DAY = "1995-01-01"
TTL = 730 * 86400 + 43200


def two_runs(spark, sf, early, run):
    """Rows up to a border, then the later ones, through ``run(stream)``, which is called once for each part."""
    path = stage_dir(spark, "source")
    rows = obs(spark, sf).select("person_key", "obs_id", "department", "scraped_at")
    for part in (early, ~early):
        rows.filter(part).write.mode("append").parquet(path)
        jobs.run_to_end(run(jobs.read_dir(spark, path, rows.schema)))


@query("compact_table", "SELECT person_key, arg_max(department, obs_id) AS department, max(obs_id) AS obs_id, min(scraped_at) AS created_at, max(scraped_at) AS updated_at FROM observations GROUP BY person_key")
def _(spark, sf):
    out, ck, kept = (stage_dir(spark, n) for n in ("deltas", "deltas-ck", "compacted"))
    half = obs(spark, sf).agg(F.max("obs_id")).first()[0] // 2
    two_runs(spark, sf, F.col("obs_id") <= half, lambda s: jobs.stream_upsert(s, out, ck))
    by = (("person_key",), ("obs_id",), "scraped_at")
    small = jobs.compact_table(spark, out, kept, *by, upto=0)
    return jobs.with_deltas(small, spark.read.parquet(out), 0, *by).select("person_key", "department", "obs_id", "created_at", "updated_at")


@query("stream_latest", f"""WITH a AS (SELECT person_key, min(scraped_at) AS first, max(scraped_at) AS last FROM observations WHERE scraped_at < DATE '{DAY}' GROUP BY person_key),
m AS (SELECT (SELECT max(scraped_at) FROM observations WHERE scraped_at < DATE '{DAY}') AS one, (SELECT max(scraped_at) FROM observations) AS two),
z AS (SELECT a.person_key FROM a, m WHERE a.last + INTERVAL {TTL} SECOND < m.one),
k AS (SELECT o.* FROM observations o WHERE o.scraped_at >= DATE '{DAY}' OR o.person_key NOT IN (SELECT person_key FROM z)),
r AS (SELECT person_key, arg_max(department, (scraped_at, obs_id)) AS department, arg_max(obs_id, (scraped_at, obs_id)) AS obs_id, min(scraped_at) AS created_at, max(scraped_at) AS updated_at FROM k GROUP BY person_key)
SELECT r.* FROM r, m WHERE r.updated_at + INTERVAL {TTL} SECOND >= m.two""")
def _(spark, sf):
    out, ck = stage_dir(spark, "latest"), stage_dir(spark, "latest-ck")
    two_runs(spark, sf, F.col("scraped_at") < F.lit(DAY).cast("date"), lambda s: state.stream_latest(s, out, ck, "person_key", "scraped_at", "obs_id", TTL))
    got = state.read_latest(spark, out)
    return got.select("person_key", "department", "obs_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")])


@query("stream_first_rows", "SELECT DISTINCT CASE WHEN fetch_id % 3 = 0 THEN 'https://hot.edu/' ELSE url END AS url FROM fetch_log")
def _(spark, sf):
    log = view(spark, sf, "fetch_log").withColumn("url", F.when(F.col("fetch_id") % 3 == 0, "https://hot.edu/").otherwise(F.col("url")))
    path, out, ck = (stage_dir(spark, n) for n in ("hot", "hot-out", "hot-ck"))
    log.write.parquet(path)
    jobs.run_to_end(state.stream_first_rows(jobs.read_dir(spark, path, log.schema), out, ck))
    return spark.read.parquet(out).select("url")


# ---- result files, sitemaps ----

@query("scan_result_variant", """
SELECT CASE WHEN obs_id % 17 <> 0 THEN name END AS name, title, email, CAST(obs_id AS STRING) AS obs_id, CASE WHEN obs_id % 17 = 0 THEN 'missing name' END AS issue FROM observations
UNION ALL SELECT NULL, NULL, NULL, NULL, 'not JSON' FROM observations WHERE obs_id % 97 = 0
UNION ALL SELECT NULL, NULL, NULL, NULL, 'not a record' FROM observations WHERE obs_id % 89 = 0""")
def _(spark, sf):
    path = stage_dir(spark, "results")
    cols = [c for c in tables.PERSON if c != "name"]
    person = F.struct(F.when(F.col("obs_id") % 17 != 0, F.col("name")).alias("name"), *cols, "obs_id")
    rows = obs(spark, sf).select(F.floor(F.col("obs_id") / 64).alias("chunk"), "obs_id", person.alias("p"))
    kind = F.col("chunk") % 6
    packed = rows.filter(kind < 5).groupBy("chunk").agg(F.collect_list("p").alias("people"))  # 64 records at most
    doc = F.to_json("people")
    for i, e in enumerate(tables.ENVELOPES):
        doc = F.when(kind == i, F.to_json(F.struct(F.lit("x").alias("source"), F.col("people").alias(e)))).otherwise(doc)
    lines = packed.select(doc.alias("value")).unionByName(rows.filter(kind == 5).select(F.to_json("p").alias("value")))
    broken = rows.filter("obs_id % 97 = 0").select(F.lit('{"faculty": [{"name"').alias("value"))
    other = rows.filter("obs_id % 89 = 0").select(F.lit("[17]").alias("value"))
    lines.unionByName(broken).unionByName(other).write.text(path)
    got = tables.scan_result_variant(spark, path)
    return got.select("name", "title", "email", F.when(F.col("record").startswith("{") & (F.coalesce("issue", F.lit("")) != "not JSON"), F.get_json_object("record", "$.obs_id")).alias("obs_id"), "issue")


ROOT = "https://www.profiles.edu/sitemap.xml"
_UNI, _MAP = "concat('https://www.profiles.edu/sitemap-', CAST(person_key % 25 AS STRING), '.xml')", "concat('https://www.profiles.edu/map-', CAST(person_key % 25 AS STRING), '-', CAST(obs_id % 4 AS STRING), '.xml')"


@query("sitemap_files", f"""SELECT '{ROOT}' AS url, 0 AS depth, CAST(NULL AS STRING) AS parent, 'index' AS kind
UNION ALL SELECT 'https://www.profiles.edu/gone.xml', 1, '{ROOT}', 'missing'
UNION ALL SELECT DISTINCT {_UNI}, 1, '{ROOT}', 'index' FROM observations UNION ALL SELECT DISTINCT {_MAP}, 2, {_UNI}, 'urlset' FROM observations""")
def _(spark, sf):
    return crawl.sitemap_files(view(spark, sf, "sitemap_index_files"), spark.createDataFrame([(ROOT,)], "url string"))


@query("sitemap_index", f"SELECT {_MAP} AS file, 2 AS depth, concat('https://www.profiles.edu/people/', CAST(obs_id AS STRING)) AS url, concat('people/', CAST(obs_id AS STRING)) AS relative_path FROM observations")
def _(spark, sf):
    found = crawl.sitemap_locations(view(spark, sf, "sitemap_index_files"), spark.createDataFrame([(ROOT,)], "url string"))
    return tables.scan_sitemap(found, "https://www.profiles.edu").select("file", "depth", "url", "relative_path")


# ---- documents ----

def _doc(head: str, key: str, source: str, part: str, name: str, item: str, order: str = "obs_id") -> str:
    return f"""SELECT {key}, CAST({part} AS BIGINT) AS part, '{name}' AS list, count(*) AS n,
  CAST(to_json({{'{key}': {key}, 'list': '{name}', 'items': list({item} ORDER BY {order})}}) AS VARCHAR) AS json FROM {source} GROUP BY {key}, {part}"""


_P = "CAST(floor(obs_id / CAST(1000 AS DOUBLE)) AS BIGINT)"
_ROLE = S.lab_role("name", "lab_name")


@query("person_documents", f"""WITH RECURSIVE {PEOPLE}, {LABREG}, {REG_IDS}, {PFOLD}, {PERSON},
n AS (SELECT person_id, count(*) AS n_departments, count(lab_id) AS n_labs FROM ids GROUP BY person_id)
SELECT person_id, CAST(-1 AS BIGINT) AS part, 'entity' AS list, CAST(1 AS BIGINT) AS n, CAST(to_json({{'person_id': person_id, 'name': name, 'title': title, 'email': email, 'n_departments': n_departments, 'n_labs': n_labs}}) AS VARCHAR) AS json
FROM person JOIN n USING (person_id)
UNION ALL {_doc('', 'person_id', 'ids', _P, 'departments', "{'id': obs_id, 'department_id': department_id, 'title': title}")}
UNION ALL {_doc('', 'person_id', '(SELECT * FROM ids WHERE lab_id IS NOT NULL) x', _P, 'labs', "{'id': obs_id, 'lab_id': lab_id, 'role': " + _ROLE + "}")}""")
def _(spark, sf):
    e = registry_entities(spark, sf)
    lists = {"departments": (e["person_department"], "obs_id", ["department_id", "title"]), "labs": (e["person_lab"], "obs_id", ["lab_id", "role"])}
    return V.documents(e["person"].select("person_id", "name", "title", "email"), "person_id", lists)


@query("lab_documents", f"""WITH RECURSIVE {PEOPLE}, {LABREG}, {REG_IDS}, {OTHERS},
n AS (SELECT lab_id, count(*) AS n_members FROM ids GROUP BY lab_id)
SELECT lab_id, CAST(-1 AS BIGINT) AS part, 'entity' AS list, CAST(1 AS BIGINT) AS n, CAST(to_json({{'lab_id': lab_id, 'name': name, 'website': website, 'n_members': n_members}}) AS VARCHAR) AS json FROM lab JOIN n USING (lab_id)
UNION ALL {_doc('', 'lab_id', '(SELECT * FROM ids WHERE lab_id IS NOT NULL) x', _P, 'members', "{'id': obs_id, 'person_id': person_id, 'role': " + _ROLE + "}")}""")
def _(spark, sf):
    e = registry_entities(spark, sf)
    return V.documents(e["lab"].select("lab_id", "name", "website"), "lab_id", {"members": (e["person_lab"], "obs_id", ["person_id", "role"])})


@query("export_documents", f"""WITH RECURSIVE {LABREG}
SELECT format AS format, lab_id, n FROM (SELECT CAST(entity AS STRING) AS lab_id, count(*) AS n FROM lreg GROUP BY entity) t, (SELECT unnest(['json', 'parquet']) AS format) f""")
def _(spark, sf):
    from acadspark.operators import registry as R
    from acadspark.catalog.chain_queries import two_batches

    labs = R.with_entities(obs(spark, sf), R.lab_nodes, two_batches(spark, sf, R.lab_nodes)[0], "entity").filter("entity IS NOT NULL").withColumn("lab_id", F.col("entity").cast("string"))
    docs = V.documents(labs.select("lab_id").distinct(), "lab_id", {"members": (labs, "obs_id", ["name"])}).filter("part >= 0")
    path = stage_dir(spark, "documents")
    docs.select("json").write.text(f"{path}/json")
    docs.write.parquet(f"{path}/parquet")
    schema = "lab_id string, list string, items array<struct<id:bigint,name:string>>"
    lines = spark.read.schema(schema).json(f"{path}/json").select(F.lit("json").alias("format"), "lab_id", F.size("items").cast("bigint").alias("n"))
    both = lines.unionByName(spark.read.parquet(f"{path}/parquet").select(F.lit("parquet").alias("format"), "lab_id", "n"))
    return both.groupBy("format", "lab_id").agg(F.sum("n").alias("n"))


# ---- exact split ----

@query("stratified_split", """WITH e AS (SELECT doc_id, CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id))
SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS STRING)), doc_id) <= floor(count(*) OVER (PARTITION BY label) / CAST(5 AS DOUBLE)) AS is_test FROM e""")
def _(spark, sf):
    return Y.stratified_split(examples(spark, sf), "doc_id").select("doc_id", "label", "is_test")


# ---- missing links, the job of all stages ----

_DOM = "concat(replace(lower(replace(university, 'University of ', '')), ' ', ''), '.edu')"
FOUND = f"""{NAMED},
forms AS (SELECT obs_id, dn, unnest([concat('https://scholar.google.com/citations?user=', f, l), concat('https://scholar.google.com/citations?user=', substr(f, 1, 1), l),
    concat('https://scholar.google.com/citations?user=', l, substr(f, 1, 1)), concat('https://www.', {_DOM}, '/~', f, l), concat('https://www.', {_DOM}, '/~', l), concat('https://www.', {_DOM}, '/people/', f, '-', l),
    concat('https://www.', {_DOM}, '/faculty/', f, '-', l), concat('https://', f, l, '.', {_DOM}), concat('https://', l, '.', {_DOM})]) AS url FROM parts),
shown AS (SELECT url, lower({S.clean_html('html')}) AS low FROM form_pages),
ok AS (SELECT obs_id, url, {S.rx('low', C.ACADEMIC_WORDS)} AS site_ok, contains(url, 'scholar.google.com') AS scholar_ok FROM forms JOIN shown USING (url)
  WHERE len(list_filter(regexp_split_to_array(lower(dn), '\\s+'), lambda p: contains(low, p))) >= 2),
hit AS (SELECT obs_id, min(url) FILTER (WHERE site_ok AND NOT scholar_ok) AS own, min(url) FILTER (WHERE site_ok) AS site, min(url) FILTER (WHERE scholar_ok) AS scholar FROM ok GROUP BY obs_id)"""


@query("find_missing_links", f"""WITH {FOUND}
SELECT o.obs_id, CASE WHEN coalesce(o.personal_website, '') = '' THEN h.site ELSE o.personal_website END AS personal_website, h.scholar AS google_scholar,
  coalesce(o.personal_website, '') = '' AND h.site IS NOT NULL AS site_filled FROM observations o LEFT JOIN hit h USING (obs_id)""")
def _(spark, sf):
    return PL.find_missing_links(obs(spark, sf), view(spark, sf, "form_pages")).select("obs_id", "personal_website", "google_scholar", "site_filled")


def whole_job(spark, sf):
    path = stage_dir(spark, "job")
    return pipeline.full_pipeline(spark, obs(spark, sf), directory_pages(spark, sf), profiles(spark, sf), view(spark, sf, "form_pages"), typed_pages(spark, sf), enr(spark, sf), path), path


@query("full_pipeline", f"""WITH {FOUND}
SELECT e.obs_id, e.phone, CASE WHEN coalesce(e.personal_website, '') = '' THEN h.site ELSE e.personal_website END AS personal_website, e.lab_website, h.scholar AS google_scholar, p.link_type, p.content_quality, p.confidence
FROM ({ORACLES['enhance_sparse']}) e LEFT JOIN hit h USING (obs_id) LEFT JOIN ({ORACLES['enrich_pages']}) p ON p.page_id = e.obs_id""")
def _(spark, sf):
    return whole_job(spark, sf)[0]["people"].select("obs_id", "phone", "personal_website", "lab_website", "google_scholar", "link_type", "content_quality", "confidence")


@query("pipeline_stages", f"""SELECT 'university' AS stage, CAST(1 AS INTEGER) AS run, (SELECT count(*) FROM ({ORACLES['extract_university']}) a) AS n_rows UNION ALL SELECT 'sparse', 1, count(*) FROM observations
UNION ALL SELECT 'links', 1, count(*) FROM observations UNION ALL SELECT 'pages', 1, (SELECT count(*) FROM ({ORACLES['enrich_pages']}) b)
UNION ALL SELECT 'export', 1, 11 UNION ALL SELECT 'people', 1, count(*) FROM observations""")
def _(spark, sf):
    return pipeline.stage_marks(spark, whole_job(spark, sf)[1]).select("stage", "run", "n_rows")
