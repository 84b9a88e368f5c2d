"""Text, name and predicate queries over documents and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from acadspark.catalog import sqlparts as S
from acadspark.catalog.registry import query
from acadspark.functions import constants as K
from acadspark.functions import names as N
from acadspark.functions import text as X
from acadspark.functions import urls as U
from acadspark.operators import predicates as P
from acadspark.sources.fixtures import table, view


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def obs(spark, sf):
    return view(spark, sf, "observations")


def joined(col, sep=" | "):
    return F.array_join(col, sep)


# ---- X: text ----

@query("clean_text", f"SELECT doc_id, {S.clean('text')} AS clean FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("clean_html", f"SELECT page_id, {S.clean_html('html')} AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_html(F.col("html")).alias("text"))


@query("extract_emails", f"SELECT doc_id, {S.joined(S.emails('text'), ' ')} AS emails FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", joined(X.emails(F.col("text")), " ").alias("emails"))


@query("extract_phones", f"SELECT doc_id, {S.joined(S.phones('text'))} AS phones FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", joined(X.phones(F.col("text"))).alias("phones"))


@query("extract_urls", f"""
SELECT doc_id, {S.joined(f"list_sort(list_distinct(regexp_extract_all(text, {S.q(K.URL)})))", ' ')} AS urls FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", joined(X.urls(F.col("text")), " ").alias("urls"))


@query("phone_context", f"""
WITH found AS (
  SELECT doc_id, text, regexp_extract_all(text, {S.q(K.DASHED_PHONE)}) AS nums,
         regexp_split_to_array(text, {S.q(K.DASHED_PHONE)}) AS gaps FROM documents),
placed AS (
  SELECT doc_id, text, unnest(nums) AS phone, unnest(range(len(nums))) AS i, gaps FROM found),
around AS (
  SELECT doc_id, phone, i, lower(substr(text, CAST(greatest(pos - 50, 0) + 1 AS BIGINT), CAST(pos + 62 - greatest(pos - 50, 0) AS BIGINT))) AS ctx
  FROM (SELECT doc_id, text, phone, i, CAST(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + 12 * i AS BIGINT) AS pos FROM placed) p),
kinds AS (
  SELECT doc_id, phone, i, CASE WHEN contains(ctx, 'office') THEN 'office' WHEN contains(ctx, 'lab') THEN 'lab' ELSE 'main' END AS kind FROM around)
SELECT d.doc_id, min_by(phone, i) FILTER (WHERE kind = 'main') AS main, max_by(phone, i) FILTER (WHERE kind = 'office') AS office,
       max_by(phone, i) FILTER (WHERE kind = 'lab') AS lab
FROM documents d LEFT JOIN kinds k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def _(spark, sf):
    got = docs(spark, sf).select("doc_id", X.phone_context(F.col("text")).alias("p"))
    return got.select("doc_id", "p.main", "p.office", "p.lab")


@query("normalize_person", f"""
SELECT obs_id, {S.display_name('name')} AS display_name, {S.person_key('name')} AS name_key FROM observations""")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", N.display_name(F.col("name")).alias("display_name"), N.person_key(F.col("name")).alias("name_key"))


@query("normalize_institution", f"""
SELECT obs_id, {S.institution_key('university')} AS uni_key,
  replace(trim(regexp_replace(lower(university), '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), ' ', '_') AS slug FROM observations""")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", N.institution_key(F.col("university")).alias("uni_key"), N.institution_slug(F.col("university")).alias("slug"))


SQL_TITLE = ("trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\bProf\\b', 'Professor', 'g'), '\\bAsst\\b', 'Assistant', 'g'), "
             "'\\bAssoc\\b', 'Associate', 'g'))")


@query("normalize_title", f"SELECT obs_id, {SQL_TITLE.format(S.clean('title'))} AS title FROM observations")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", X.normalize_title(F.col("title")).alias("title"))


def _sql_title_from(ctx, name):
    pats = (r"(?i)((?:Professor|Associate Professor|Assistant Professor|Lecturer|Instructor)[^,\n]*)",
            r"(?i)((?:Prof\.|Dr\.)[^,\n]*)", r"(?i)([^,\n]*(?:Professor|Chair|Director)[^,\n]*)")
    one = [f"(list_filter(list_transform(regexp_extract_all({ctx}, {S.q(p)}, 1), lambda m: {SQL_TITLE.format(S.clean('m'))}), "
           f"lambda t: t <> '' AND lower(t) <> lower({name})))[1]" for p in pats]
    return f"coalesce({', '.join(one)})"


@query("extract_title", f"""
SELECT obs_id, {_sql_title_from('ctx', 'name')} AS rank_title
FROM (SELECT obs_id, name, concat_ws(', ', name, title, department) AS ctx FROM observations) o""")
def _(spark, sf):
    ctx = F.concat_ws(", ", "name", "title", "department")
    return obs(spark, sf).select("obs_id", X.title_from(ctx, F.col("name")).alias("rank_title"))


@query("extract_lab_name", f"""
SELECT obs_id, {S.first_field('ctx', X.LAB_NAME_PATTERNS, 5)} AS lab
FROM (SELECT obs_id, concat_ws(', ', title, department, lab_name) AS ctx FROM observations) o""")
def _(spark, sf):
    ctx = F.concat_ws(", ", "title", "department", "lab_name")
    return obs(spark, sf).select("obs_id", X.first_field(ctx, X.LAB_NAME_PATTERNS, 5).alias("lab"))


@query("extract_pronouns", f"SELECT doc_id, {S.first_field('text', X.PRONOUN_PATTERNS)} AS pronouns FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.first_field(F.col("text"), X.PRONOUN_PATTERNS).alias("pronouns"))


@query("extract_office", f"""
SELECT obs_id, {S.first_field('ctx', X.OFFICE_PATTERNS, 3, 100)} AS office, {S.first_field('ctx', X.LOCATION_PATTERNS, 3)} AS location,
  nullif(trim(regexp_extract(ctx, {S.q(X.OFFICE_HOURS)}, 1)), '') AS hours
FROM (SELECT obs_id, concat('Name: ', name, '\n', coalesce(office, ''), '\nOffice hours: ', department) AS ctx FROM observations) o""".replace("\\n", "\\n"))
def _(spark, sf):
    ctx = F.concat(F.lit("Name: "), "name", F.lit("\n"), F.coalesce("office", F.lit("")), F.lit("\nOffice hours: "), "department")
    return obs(spark, sf).select(
        "obs_id", X.first_field(ctx, X.OFFICE_PATTERNS, 3, 100).alias("office"),
        X.first_field(ctx, X.LOCATION_PATTERNS, 3).alias("location"),
        F.nullif(F.trim(F.regexp_extract(ctx, X.OFFICE_HOURS, 1)), F.lit("")).alias("hours"))


SQL_INTERESTS_TEXT = ("regexp_replace(regexp_replace(coalesce({0}, ''), '(?i)research interests?:?\\s*', '', 'g'), "
                      "'(?i)areas? of expertise:?\\s*', '', 'g')")


def sql_interests(col):
    t = SQL_INTERESTS_TEXT.format(col)
    cases = " ".join(f"WHEN contains({t}, {d}) THEN string_split({t}, {d})" for d in ("';'", "','", "'•'", "'·'", "chr(10)"))
    parts = f"list_filter(list_transform(CASE {cases} ELSE CAST([] AS VARCHAR[]) END, lambda x: trim(x)), lambda x: length(x) > 3 AND length(x) < 80)"
    single = f"CASE WHEN length(trim({t})) > 3 AND length(trim({t})) < 200 THEN [trim({t})] ELSE CAST([] AS VARCHAR[]) END"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE {single} END"


@query("parse_interests", f"SELECT obs_id, {S.joined(sql_interests('research_interests'))} AS interests FROM observations")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", joined(X.interests(F.col("research_interests"))).alias("interests"))


def _sql_degree(col):
    return "list_filter([" + ", ".join(
        f"CASE WHEN {S.rx(f'lower({col})', w)} THEN '{d}' END" for d, w in K.DEGREE_WORDS) + "], lambda x: x IS NOT NULL)"


_SPECS = "flatten([" + ", ".join(f"regexp_extract_all(text, {S.q(p)}, 1)" for p in X.SPECIALIZATION_PATTERNS) + "])"
_PARAS = (f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {S.clean('p')}), "
          "lambda p: length(p) > 50 AND NOT regexp_matches(lower(p), 'menu|navigation|cookie|copyright'))")


def _sql_program_department(col):
    out = col
    for w in K.PROGRAM_WORDS:
        out = f"replace({out}, '{w}', ' ')"
    return S.clean(out)


@query("program_fields", f"""
SELECT doc_id, coalesce({S.first_field('text', X.DESCRIPTION_PATTERNS, 20, group=0)}, ({_PARAS})[1], '') AS description,
  {S.joined(_sql_degree('text'))} AS degrees,
  len(list_distinct(list_filter(list_transform(flatten(list_transform({_SPECS}, lambda s: regexp_split_to_array({S.clean('s')}, '[,;]|\\sand\\s'))), lambda x: trim(x)), lambda x: length(x) > 3))) AS n_specializations,
  {_sql_program_department('text')} AS department
FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", X.program_description(t).alias("description"), joined(X.degree_types(t)).alias("degrees"),
        F.size(X.specializations(t)).cast("bigint").alias("n_specializations"),
        X.program_department(t).alias("department"))


@query("preferred_contact", f"""
SELECT doc_id,
  coalesce((list_filter({S.emails('text')}, lambda e: {S.rx('e', K.PROGRAM_CONTACT_WORDS)}))[1], ({S.emails('text')})[1]) AS program_email,
  coalesce((list_filter({S.emails('text')}, lambda e: {S.rx('e', K.LAB_CONTACT_WORDS)}))[1], ({S.emails('text')})[1]) AS lab_email,
  ({S.phones('text')})[1] AS phone FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", X.preferred(X.emails(t), K.PROGRAM_CONTACT_WORDS).alias("program_email"),
        X.preferred(X.emails(t), K.LAB_CONTACT_WORDS).alias("lab_email"), F.get(X.phones(t), F.lit(0)).alias("phone"))


@query("classify_lab_type", "SELECT doc_id, CASE " + " ".join(
    f"WHEN {S.rx('lower(text)', w)} THEN '{t}'" for t, w in K.LAB_TYPE_WORDS) + " ELSE 'research' END AS lab_type FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.lab_type(F.col("text")).alias("lab_type"))


def _kw(words, col="text"):
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower({col}), {S.q(w.lower())}) THEN {S.q(w)} END" for w in words) + "], lambda x: x IS NOT NULL)"


_EQUIP = f"list_sort(list_distinct(flatten([{_kw(K.EQUIPMENT_WORDS)}, {S.all_fields('text', X.EQUIPMENT_PATTERNS, 3)}, {S.named_before('text', 'system|equipment|device|instrument', 3)}])))"


@query("lab_text_fields", f"""
SELECT doc_id, {S.joined(f"list_sort(list_distinct({S.all_fields('text', X.MEMBER_PATTERNS)}))")} AS members,
  {S.first_field('text', X.RESEARCH_TEXT_PATTERNS, 50, group=0)} AS description,
  {S.joined(S.all_fields('text', X.PROJECT_PATTERNS, 10))} AS projects, {S.joined(_EQUIP)} AS equipment,
  {S.joined(S.all_fields('text', X.FACILITY_PATTERNS, 3))} AS facilities,
  {S.joined(f"flatten([{S.all_fields('text', X.DATASET_PATTERNS, 5)}, {S.named_before('text', 'dataset|database|corpus', 5)}])")} AS datasets,
  {S.joined(f"list_sort({_kw(K.SOFTWARE_WORDS)})")} AS software,
  {S.joined(S.all_fields('text', X.OPPORTUNITY_PATTERNS, 10))} AS opportunities,
  {S.first_field('text', X.COLLABORATION_PATTERNS, 20, group=0)} AS collaboration
FROM documents""")
def _(spark, sf):
    got = docs(spark, sf).select("doc_id", X.lab_fields(F.col("text")).alias("f"))
    return got.select(
        "doc_id", joined(F.array_sort("f.members")).alias("members"), "f.description",
        *[joined(f"f.{c}").alias(c) for c in ("projects", "equipment", "facilities", "datasets", "software", "opportunities")],
        "f.collaboration")


_AREA = "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(lower(s), {S.q(p)}, 1)" for p in K.AREA_PATTERNS) + "])))"
_ROLE = "coalesce(" + ", ".join(f"nullif(regexp_extract(lower(text), {S.q(p)}, 1), '')" for p in K.ROLE_PATTERNS) + ", '')"
_ROOM, _BLDG = r"(?i)(room|office|lab)\s+(\w+\s*\d+)", r"(?i)(building|bldg)\s+(\w+)"


@query("member_fields", f"""
SELECT doc_id, {_ROLE} AS role, regexp_extract(text, {S.q(K.EMAIL)}) AS email,
  CASE WHEN regexp_extract(text, {S.q(K.MEMBER_PHONE)}) = '' THEN '' ELSE concat_ws('-', regexp_extract(text, {S.q(K.MEMBER_PHONE)}, 1),
    regexp_extract(text, {S.q(K.MEMBER_PHONE)}, 2), regexp_extract(text, {S.q(K.MEMBER_PHONE)}, 3)) END AS phone,
  CASE WHEN regexp_extract(text, '{_ROOM}') <> '' THEN concat_ws(' ', regexp_extract(text, '{_ROOM}', 1), regexp_extract(text, '{_ROOM}', 2))
       WHEN regexp_extract(text, '{_BLDG}') <> '' THEN concat_ws(' ', regexp_extract(text, '{_BLDG}', 1), regexp_extract(text, '{_BLDG}', 2))
       ELSE regexp_extract(text, '(?i)(\\d+\\s+\\w+\\s+(?:hall|building|center))', 1) END AS office,
  {S.joined(f"list_sort(list_distinct(flatten(list_transform(list_filter(string_split(text, '.'), lambda s: regexp_matches(lower(s), 'research|interests|focus|specialization|expertise')), lambda s: {_AREA}))))")} AS interests
FROM documents""")
def _(spark, sf):
    got = docs(spark, sf).select("doc_id", X.member_fields(F.col("text")).alias("m"))
    return got.select("doc_id", "m.role", "m.email", "m.phone", "m.office", joined("m.interests").alias("interests"))


def _pf(p, g):
    return f"nullif(regexp_extract(text, {S.q(p)}, {g}), '')"


@query("project_fields", f"""
SELECT doc_id, coalesce({_pf(r'(?i)(nsf|nih|doe|darpa|nasa|onr|afosr)\s*([^,.]+)', 2)}, {_pf(r'(?i)(funded by|supported by|sponsored by)\s+([^,.]+)', 2)}, '') AS funding_agency,
  regexp_extract(text, {S.q(r'(?i)(\$[\d,]+(?:\.\d+)?(?:\s*(?:million|thousand|k|m))?)')}, 1) AS funding_amount,
  coalesce({_pf(r'(?i)(started|began|commenced)\s+(?:in\s+)?(\d{4})', 2)}, {_pf(r'(\d{4})\s*[-\x{2013}]\s*(\d{4})', 1)}, '') AS start_date,
  coalesce({_pf(r'(?i)(ends|concludes|completed)\s+(?:in\s+)?(\d{4})', 2)}, {_pf(r'(\d{4})\s*[-\x{2013}]\s*(\d{4})', 2)}, '') AS end_date,
  CASE {' '.join(f"WHEN {S.rx('lower(text)', w)} THEN '{s}'" for s, w in K.STATUS_WORDS)} ELSE 'unknown' END AS status,
  {S.joined("list_transform(list_filter(string_split(regexp_extract(text, '(?i)(keywords?|tags?|topics?):\\s*([^.]+)', 2), ','), lambda x: trim(x) <> ''), lambda x: trim(x))")} AS keywords,
  regexp_extract(text, '(?i)(methodology|methods?|approach):\\s*([^.]+)', 2) AS methodology,
  regexp_extract(text, '(?i)(objectives?|goals?):\\s*([^.]+)', 2) AS objectives FROM documents""")
def _(spark, sf):
    got = docs(spark, sf).select("doc_id", X.project_fields(F.col("text")).alias("p"))
    return got.select("doc_id", "p.funding_agency", "p.funding_amount", "p.start_date", "p.end_date", "p.status",
                      joined("p.keywords").alias("keywords"), "p.methodology", "p.objectives")


@query("dictionary_match", f"SELECT doc_id, {S.joined(_kw(K.RESEARCH_AREAS))} AS areas FROM documents")
def _(spark, sf):
    from acadspark.operators.joins import dictionary_match
    return dictionary_match(docs(spark, sf), "text", K.RESEARCH_AREAS).select("doc_id", joined("matches").alias("areas"))


@query("dedup_key", f"SELECT obs_id, {S.dedup_key('name', 'university')} AS dedup_key FROM observations")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", N.dedup_key(F.col("name"), F.col("university")).alias("dedup_key"))


@query("infer_role", f"SELECT obs_id, {S.lab_role('name', 'lab_name')} AS role FROM observations")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", N.lab_role(F.col("name"), F.col("lab_name")).alias("role"))


@query("entity_ids", f"""
SELECT obs_id, {S.person_id(S.dedup_key('name', 'university'))} AS person_id, {S.university_id('university')} AS university_id,
  {S.department_id('university', 'department')} AS department_id, {S.lab_id('university', 'lab_name', 'lab_website')} AS lab_id FROM observations""")
def _(spark, sf):
    from acadspark.operators.entities import with_ids
    return with_ids(obs(spark, sf)).select("obs_id", "person_id", "university_id", "department_id", "lab_id")


@query("cache_key", """
SELECT obs_id, md5(lower(concat_ws('|', name, coalesce(lab_name, ''), university))) AS cache_key FROM observations""")
def _(spark, sf):
    from acadspark.operators.search import cache_key
    return cache_key(obs(spark, sf)).select("obs_id", "cache_key")


# ---- P: predicates ----

@query("sparse_records", """
SELECT obs_id, CAST(s AS BIGINT) AS signals, s < 2 AS needs_enrichment FROM (
  SELECT obs_id, CASE WHEN coalesce(research_interests, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(personal_website, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(phone, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(office, '') <> '' THEN 1 ELSE 0 END AS s FROM observations) o""")
def _(spark, sf):
    return P.sparse_records(obs(spark, sf)).select("obs_id", F.col("signals").cast("bigint"), "needs_enrichment")


@query("academic_site", f"""
SELECT obs_id, coalesce({S.rx(f"lower({S.authority('personal_website')})", K.ACADEMIC_HOST_PARTS)}, FALSE) AS is_academic FROM observations""")
def _(spark, sf):
    return P.academic_site(obs(spark, sf), "personal_website").select("obs_id", "is_academic")


@query("personal_site", f"""
SELECT obs_id, regexp_matches({S.authority('u')}, '(\\.edu|\\.ac\\.|\\.org)$') AND ({S.rx(S.path('u'), K.PERSONAL_PATH_MARKS)}
  OR len(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda p: length(p) > 2 AND contains(u, p))) > 0) AS is_personal
FROM (SELECT obs_id, name, lower(coalesce(profile_url, '')) AS u FROM observations) o""")
def _(spark, sf):
    return P.personal_site(obs(spark, sf), "profile_url").select("obs_id", "is_personal")


@query("person_name_like", f"""
SELECT obs_id, t <> '' AND length(t) <= 60 AND len(w) BETWEEN 2 AND 5
  AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Nd}}') AND length(x) >= 2))) = 0
  AND lower(t) NOT IN ({', '.join(S.q(p) for p in K.PERSON_STOP_PHRASES)}) AS is_name
FROM (SELECT obs_id, coalesce(lab_name, name) AS t, regexp_split_to_array(trim(coalesce(lab_name, name)), '\\s+') AS w FROM observations) o""")
def _(spark, sf):
    df = obs(spark, sf).withColumn("t", F.coalesce("lab_name", "name"))
    return P.person_name_like(df, "t").select("obs_id", "is_name")


@query("title_like", f"""
SELECT obs_id, coalesce(title, '') <> '' AND length(coalesce(title, '')) <= 100 AND {S.rx("lower(coalesce(title, ''))", K.TITLE_WORDS)} AS is_title FROM observations""")
def _(spark, sf):
    return P.title_like(obs(spark, sf), "title").select("obs_id", "is_title")


@query("bio_like", "SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in K.BIO_WORDS)
       + " >= 2 AS is_bio FROM documents")
def _(spark, sf):
    return P.bio_like(docs(spark, sf), "text").select("doc_id", "is_bio")


def sql_department_ok(c):
    return (f"length({c}) BETWEEN 3 AND 150 AND NOT {S.rx(f'lower({c})', K.DEPARTMENT_SKIP)} "
            f"AND (length({c}) >= 20 OR {S.rx(f'lower({c})', K.DEPARTMENT_WORDS)})")


@query("valid_department", f"SELECT obs_id, {sql_department_ok('department')} AS is_department FROM observations")
def _(spark, sf):
    return P.valid_department(obs(spark, sf), "department").select("obs_id", "is_department")


@query("not_lab_text", f"""
SELECT doc_id, {S.rx('lower(text)', K.NOT_LAB_WORDS)} OR 2 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) < length(text) AS not_lab FROM documents""")
def _(spark, sf):
    return P.not_lab_text(docs(spark, sf), "text").select("doc_id", "not_lab")


@query("listing_name_valid", f"""
SELECT obs_id, len(w) BETWEEN 2 AND 6 AND len(list_filter(w, lambda x: lower(x) IN ({', '.join(S.q(p) for p in K.LISTING_BLOCK_WORDS)}))) = 0
  AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{L}}{{3,}}$'))) > 0 AS is_listed_name
FROM (SELECT obs_id, regexp_split_to_array(trim({S.display_name('name')}), '\\s+') AS w FROM observations) o""")
def _(spark, sf):
    df = obs(spark, sf).withColumn("n", N.display_name(F.col("name")))
    return P.listing_name_valid(df, "n").select("obs_id", "is_listed_name")


@query("search_people", """
SELECT obs_id, name, research_interests FROM observations
WHERE contains(lower(concat_ws(' ', name, research_interests)), 'memory') AND lower(department) = 'physics' ORDER BY name, obs_id LIMIT 10""")
def _(spark, sf):
    return P.search_people(obs(spark, sf), "memory", department="Physics").select("obs_id", "name", "research_interests")


@query("people_preview", "SELECT obs_id, name, title, email, personal_website FROM observations ORDER BY obs_id LIMIT 10")
def _(spark, sf):
    return P.people_preview(obs(spark, sf))


# institutions derived from nations and regions
INSTITUTIONS = """institutions AS (SELECT n_nationkey AS id, concat('University of ', n_name) AS name, upper(substr(r_name, 1, 1)) || CAST(r_regionkey AS STRING) AS state_code,
  r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def institutions(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("id"), F.concat(F.lit("University of "), "n_name").alias("name"),
        F.concat(F.upper(F.substring("r_name", 1, 1)), F.col("r_regionkey").cast("string")).alias("state_code"), F.col("r_name").alias("state"))


@query("search_institutions", f"""WITH {INSTITUTIONS}
SELECT id, name, state_code FROM institutions WHERE contains(lower(name), 'nation_1') ORDER BY name, id LIMIT 20""")
def _(spark, sf):
    return P.search_institutions(institutions(spark, sf), "Nation_1").select("id", "name", "state_code")


@query("search_departments", """
SELECT p_partkey AS id, p_name AS name, p_type AS category FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring') ORDER BY name, id LIMIT 10""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
                                            F.array("p_brand", "p_type").alias("variations"))
    return P.search_departments(parts, "ring").select("id", "name", "category")
