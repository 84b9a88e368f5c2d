"""Derived input views over the TPC-H-style tables.

Every text below is valid both in Spark SQL and in DuckDB, so operator inputs and oracle inputs are identical.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acadspark.functions.steps import dealt_tasks, spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SMALL_TABLES = ("region", "nation", "benchmark", "labels", "supplier", "part", "customer")

#: Tables whose rows become pages, forms or texts, with their keys: dealt out over all tasks before that work.
SPREAD_BY = {"orders": "o_orderkey", "documents": "doc_id", "pages": "page_id"}

VIEWS: dict[str, str] = {}

VIEWS["observations"] = r"""
SELECT o.o_orderkey AS obs_id, c.c_custkey AS person_key,
  concat('Dr. G', translate(CAST(c.c_custkey % 40 AS STRING), '0123456789', 'abcdefghij'),
         CASE WHEN o.o_orderkey % 3 = 0 THEN ' Q.' ELSE '' END,
         ' F', translate(CAST(c.c_custkey % 700 AS STRING), '0123456789', 'abcdefghij')) AS name,
  concat('University of Nation ', translate(CAST(c.c_nationkey AS STRING), '0123456789', 'abcdefghij')) AS university,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Psychology' WHEN '2' THEN 'Computer Science'
       WHEN '3' THEN 'Physics' WHEN '4' THEN 'Statistics' ELSE 'History' END AS department,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Asst Prof' WHEN 1 THEN 'Assoc Professor of Memory'
       WHEN 2 THEN 'Professor, Director of the Attention Lab' END AS title,
  CASE WHEN o.o_orderkey % 3 <> 1 THEN concat('F', CAST(c.c_custkey AS STRING), '@Nation',
       CAST(c.c_nationkey AS STRING), '.edu') END AS email,
  CASE WHEN o.o_orderkey % 2 = 0 THEN concat('520.621.', CAST(1000 + c.c_custkey % 9000 AS STRING)) END AS phone,
  CASE WHEN o.o_orderkey % 7 = 0 THEN concat('Room ', CAST(c.c_custkey % 400 AS STRING)) END AS office,
  CASE c.c_custkey % 8 WHEN 0 THEN concat('https://linkedin.com/in/f', CAST(c.c_custkey AS STRING))
       WHEN 1 THEN concat('https://www.nation', CAST(c.c_nationkey AS STRING), '.edu/~f', CAST(c.c_custkey AS STRING))
       WHEN 2 THEN concat('https://psych.nation', CAST(c.c_nationkey AS STRING), '.edu/people/f', CAST(c.c_custkey AS STRING))
       WHEN 3 THEN concat('https://nation', CAST(c.c_nationkey AS STRING), '.ac.uk/cognitive/group/f', CAST(c.c_custkey AS STRING))
       WHEN 4 THEN 'https://doi.org/10.1000/182' WHEN 5 THEN '' WHEN 6 THEN NULL
       ELSE concat('https://f', CAST(c.c_custkey AS STRING), '.io/home') END AS profile_url,
  CASE o.o_orderkey % 6 WHEN 0 THEN concat('https://scholar.google.com/citations?user=F', CAST(c.c_custkey AS STRING))
       WHEN 1 THEN concat('https://twitter.com/f', CAST(c.c_custkey AS STRING))
       WHEN 2 THEN concat('https://www.researchgate.net/profile/F-', CAST(c.c_custkey AS STRING))
       WHEN 3 THEN concat('https://www.f', CAST(c.c_custkey AS STRING), '.org/') END AS personal_website,
  CASE WHEN o.o_orderkey % 5 = 0 THEN concat('https://nation', CAST(c.c_nationkey AS STRING), '.edu/research/lab',
       CAST(c.c_custkey % 50 AS STRING)) END AS lab_website,
  CASE o.o_orderkey % 5 WHEN 0 THEN concat('F', translate(CAST(c.c_custkey % 700 AS STRING), '0123456789', 'abcdefghij'), ' Lab')
       WHEN 1 THEN 'Cognitive Neuroscience Laboratory' WHEN 2 THEN 'Center for Data Science' END AS lab_name,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Memory; Attention' WHEN 1 THEN 'machine learning, robotics, vision'
       WHEN 2 THEN 'Clinical Psychology' WHEN 3 THEN 'Stress, PTSD, Aging' END AS research_interests,
  CAST(50 + o.o_orderkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence_score,
  CASE o.o_orderkey % 11 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS http_status,
  o.o_orderdate AS scraped_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

VIEWS["enrichments"] = r"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS enrichment_id, l.l_orderkey AS obs_id, o.o_custkey AS person_key,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'google_scholar' WHEN 1 THEN 'profile' WHEN 2 THEN 'links' ELSE 'research' END AS enrichment_type,
  CAST(l.l_quantity * 100 AS BIGINT) AS total_citations, CAST(l.l_quantity AS BIGINT) AS h_index,
  CAST(l.l_suppkey AS BIGINT) AS lab_key, l.l_shipdate AS extracted_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

VIEWS["fetch_log"] = r"""
SELECT event_id AS fetch_id, ts, concat('host', CAST(user_id % 50 AS STRING), '.edu') AS host,
  concat('https://host', CAST(user_id % 50 AS STRING), '.edu/people/', CAST(user_id AS STRING)) AS url,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 301 ELSE 200 END AS status_code,
  CASE event_type WHEN 'click' THEN 'bing' WHEN 'view' THEN 'serpapi' ELSE 'page' END AS channel,
  value AS load_ms
FROM events
"""

VIEWS["profile_pages"] = r"""
SELECT obs_id AS page_id, person_key,
  concat('https://www.profiles.edu/people/', CAST(obs_id AS STRING)) AS url,
  concat('<!DOCTYPE html><html><head><title>', name, ' - ', university, '</title>',
    '<meta name="description" content="', department, ' at ', university, '"><script>var t="</p>";</script></head><body>',
    '<nav><a href="/faculty">Faculty</a><a href="/news">News</a></nav>',
    '<div class="person"><h1>', name, '</h1><p>', coalesce(title, ''), '</p>',
    '<p>Email: <a href="mailto:', coalesce(email, ''), '">', coalesce(email, ''), '</a> Phone: ', coalesce(phone, ''), ' Office: ', coalesce(office, ''), '</p>',
    '<img src="/photo/', CAST(person_key AS STRING), '.jpg" alt="', name, '">',
    '<h3>Research Interests</h3><ul><li>', coalesce(research_interests, ''), '</li><li>', department, '</li></ul>',
    '<p>Visit our <a href="', coalesce(lab_website, '/lab'), '">', coalesce(lab_name, 'research group'), '</a> &amp; partners.</p>',
    '<p><a href="', coalesce(personal_website, '/home'), '">Homepage</a></p>',
    '<table class="gsc_rsb_st"><tr><td>Citations</td><td>', CAST(obs_id % 12000 AS STRING), '</td></tr><tr><td>h-index</td><td>', CAST(obs_id % 60 AS STRING),
    '</td></tr><tr><td>i10-index</td><td>', CAST(obs_id % 90 AS STRING), '</td></tr></table>',
    '<p>Cited by ', CAST(obs_id % 12000 AS STRING), '</p><p>Last updated ', CAST(2000 + obs_id % 25 AS STRING), '</p></div></body></html>') AS html
FROM observations
"""

VIEWS["page_fetches"] = r"""
SELECT obs_id, field, url, http_status, scraped_at AS fetched_at,
  CASE WHEN obs_id % 13 = 0 THEN concat(url, '/new') ELSE url END AS final_url
FROM (
  SELECT obs_id, 'profile_url' AS field, profile_url AS url, http_status, scraped_at FROM observations
  UNION ALL SELECT obs_id, 'personal_website', personal_website, http_status, scraped_at FROM observations
  UNION ALL SELECT obs_id, 'lab_website', lab_website, http_status, scraped_at FROM observations) u
WHERE url IS NOT NULL AND url <> '' AND http_status IS NOT NULL
"""

VIEWS["link_candidates"] = r"""
SELECT obs_id, person_key, name, concat('https://www.profiles.edu/people/', CAST(obs_id + obs_id % 3 AS STRING)) AS url,
  CASE obs_id % 3 WHEN 0 THEN 'domain_discovery' WHEN 1 THEN 'direct_academic' ELSE 'search_engine' END AS source,
  CASE obs_id % 5 WHEN 0 THEN 'twitter' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'researchgate' WHEN 3 THEN 'academia' ELSE 'orcid' END AS platform,
  CASE obs_id % 3 WHEN 0 THEN CAST(80 AS DOUBLE) WHEN 1 THEN CAST(70 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END / CAST(100 AS DOUBLE) AS confidence
FROM observations
"""

# pages that exist on the people's own sites and on profile platforms, some of them gone; most of them lead to one of a person's forms
VIEWS["candidate_fetches"] = r"""
SELECT url, max(ok) = 1 AS is_accessible FROM (
  SELECT concat('https://', site, CASE obs_id % 11 WHEN 0 THEN concat('/faculty/', f, '-', l) WHEN 1 THEN concat('/~', l) WHEN 2 THEN concat('/people/', l, '.html')
      WHEN 3 THEN concat('/', f, '.', l) WHEN 4 THEN concat('/psychology/people/', f, '_', l) WHEN 5 THEN concat('/directory/', l, '-', f) WHEN 6 THEN concat('/faculty/directory/', substr(f, 1, 1), l)
      WHEN 7 THEN concat('/', f, '-', l, '.html') WHEN 8 THEN concat('/labs/', l) WHEN 9 THEN concat('/research/lab/', f, '/', l) ELSE concat('/people/', f, '-', l) END) AS url,
    CASE WHEN obs_id % 4 = 0 THEN 0 ELSE 1 END AS ok
  FROM (SELECT obs_id, split_part(profile_url, '/', 3) AS site, concat('g', translate(CAST(person_key % 40 AS STRING), '0123456789', 'abcdefghij')) AS f,
    concat('f', translate(CAST(person_key % 700 AS STRING), '0123456789', 'abcdefghij')) AS l FROM observations WHERE profile_url <> '') s
  UNION ALL
  SELECT CASE obs_id % 4 WHEN 0 THEN concat('https://scholar.google.com/citations?q=', replace(replace(name, 'Dr. ', ''), ' ', '+'))
      WHEN 1 THEN concat('https://www.researchgate.net/profile/', replace(lower(replace(name, 'Dr. ', '')), ' ', '-'))
      WHEN 2 THEN concat('https://scholar.google.com/citations?q=', replace(concat(replace(name, 'Dr. ', ''), ' ', university), ' ', '+'))
      ELSE concat('https://orcid.org/search?searchQuery=', replace(replace(name, 'Dr. ', ''), ' ', '+')) END, CASE WHEN obs_id % 3 = 0 THEN 0 ELSE 1 END
  FROM observations WHERE obs_id % 5 < 3) u GROUP BY url
"""

VIEWS["listing_pages"] = r"""
SELECT obs_id AS page_id, concat('https://www.directory.edu/list?page=', CAST(obs_id AS STRING)) AS url,
  concat('<html><body><h2>Department of ', department, '</h2><ul><li><a href="/department/', lower(department), '">Department of ', department, '</a></li>',
    '<li><a href="/school-of-arts">School of Arts</a></li><li><a href="https://other.com/dept">Department of Other</a></li>',
    '<li><a href="/programs/', CAST(obs_id % 7 AS STRING), '">Master program in ', department, '</a></li></ul>',
    '<p>Research Interests: ', coalesce(research_interests, ''), '</p>',
    '<div class="pagination"><a href="?page=', CAST(obs_id + 1 AS STRING), '">2</a><a href="?page=', CAST(obs_id + 2 AS STRING), '">3</a>',
    '<a href="?page=', CAST(obs_id AS STRING), '">here</a><a href="/list?page=', CAST(obs_id + 3 AS STRING), '">4</a><a href="?page=', CAST(obs_id + 4 AS STRING), '">5</a>',
    '<a href="?page=', CAST(obs_id + 5 AS STRING), '">6</a></div></body></html>') AS html
FROM observations
"""

# three levels of lists and of tables, with spans
VIEWS["nested_pages"] = r"""
SELECT obs_id AS page_id, concat('https://www.nested.edu/', CAST(obs_id AS STRING)) AS url,
  concat('<html><body><ul class="a"><li>', department, '<ol><li>', name, '<ul><li>', coalesce(title, ''), '</li><li>', coalesce(lab_name, ''), '</li></ul></li><li>second</li></ol></li><li>tail ',
    CAST(obs_id AS STRING), '</li></ul><table><tr><th colspan="2">', university, '</th></tr><tr><td rowspan="2">', department, '</td><td><table><tr><td>', name,
    '</td><td>x<table><tr><td>', coalesce(title, ''), '</td></tr></table></td></tr></table></td></tr><tr><td>last</td></tr></table></body></html>') AS html
FROM observations
"""

# a site per university: program, numbered directory, profile and lab pages; profiles lead back to programs, some labs to the start
VIEWS["crawl_links"] = r"""
SELECT DISTINCT src, dst FROM (
  SELECT concat('https://u', uni, '.edu/') AS src, concat('https://u', uni, '.edu/programs/', dep) AS dst FROM (
    SELECT CAST(person_key % 25 AS STRING) AS uni, lower(replace(department, ' ', '-')) AS dep FROM observations) a
  UNION ALL SELECT concat('https://u', uni, '.edu/programs/', dep), concat('https://u', uni, '.edu/directory/', dep, '?page=0') FROM (
    SELECT CAST(person_key % 25 AS STRING) AS uni, lower(replace(department, ' ', '-')) AS dep FROM observations) b
  UNION ALL SELECT concat('https://u', uni, '.edu/directory/', dep, '?page=', CAST(k AS STRING)), concat('https://u', uni, '.edu/directory/', dep, '?page=', CAST(k + 1 AS STRING)) FROM (
    SELECT CAST(person_key % 25 AS STRING) AS uni, lower(replace(department, ' ', '-')) AS dep, obs_id % 5 AS k FROM observations) c
  UNION ALL SELECT concat('https://u', uni, '.edu/directory/', dep, '?page=', CAST(k AS STRING)), concat('https://u', uni, '.edu/people/', CAST(obs_id AS STRING)) FROM (
    SELECT CAST(person_key % 25 AS STRING) AS uni, lower(replace(department, ' ', '-')) AS dep, obs_id % 5 AS k, obs_id FROM observations) d
  UNION ALL SELECT concat('https://u', uni, '.edu/people/', CAST(obs_id AS STRING)), concat('https://u', uni, '.edu/', CASE WHEN lab_website IS NULL THEN concat('programs/', dep)
      ELSE concat('research/lab', CAST(person_key % 50 AS STRING)) END) FROM (
    SELECT CAST(person_key % 25 AS STRING) AS uni, lower(replace(department, ' ', '-')) AS dep, obs_id, lab_website, person_key FROM observations) e
  UNION ALL SELECT concat('https://u', CAST(person_key % 25 AS STRING), '.edu/research/lab', CAST(person_key % 50 AS STRING)), concat('https://u', CAST(person_key % 25 AS STRING), '.edu/') FROM observations
    WHERE person_key % 50 % 2 = 0) u
"""

VIEWS["crawl_pages"] = r"""
SELECT 0 AS page_id, src AS url, concat('<html><body><a href="#top">top</a><a href="mailto:a@b.edu">mail</a>', string_agg(concat('<p><a href="', dst, '">there</a> <a href="', dst, '">again</a></p>'), ''),
  '</body></html>') AS html FROM crawl_links GROUP BY src
"""

# listing pages of two sites that name people in different ways, and of one without rules
VIEWS["rule_pages"] = r"""
SELECT obs_id AS page_id, concat('https://site', CAST(obs_id % 3 AS STRING), '.edu/people?id=', CAST(obs_id AS STRING)) AS url,
  CASE obs_id % 3 WHEN 0 THEN concat('<html><body><article class="Card big"><h4 class="nm"><a href="/p/', CAST(obs_id AS STRING), '">', name, '</a></h4><span class="role">', coalesce(title, ''),
      '</span><a href="mailto:', coalesce(email, ''), '">mail</a></article><article class="card"><h4>No name</h4></article></body></html>')
    WHEN 1 THEN concat('<html><body><table><tr class="row"><td class="who">', name, '</td><td class="pos"><i>', coalesce(title, ''), '</i></td><td><a class="page" href="https://own.edu/', CAST(obs_id AS STRING),
      '">page</a></td></tr><tr class="row"><td class="who">Second ', department, '</td></tr></table></body></html>')
    ELSE concat('<html><body><div class="card"><h4 class="nm">', name, '</h4></div></body></html>') END AS html
FROM observations
"""

# two levels of sitemap index, which list each other and a file that is gone, over url sets
VIEWS["sitemap_index_files"] = r"""
SELECT 'https://www.profiles.edu/sitemap.xml' AS url, concat('<?xml version="1.0"?><sitemapindex><sitemap><loc>https://www.profiles.edu/sitemap.xml</loc></sitemap><sitemap><loc> https://www.profiles.edu/gone.xml </loc></sitemap>',
  string_agg(concat('<sitemap><loc>https://www.profiles.edu/sitemap-', uni, '.xml</loc><lastmod>2024</lastmod></sitemap>'), ''), '</sitemapindex>') AS xml
FROM (SELECT DISTINCT CAST(person_key % 25 AS STRING) AS uni FROM observations) a
UNION ALL
SELECT concat('https://www.profiles.edu/sitemap-', uni, '.xml'), concat('<sitemapindex><!-- <sitemap><loc>https://www.profiles.edu/old.xml</loc></sitemap> --><sitemap><loc>https://www.profiles.edu/sitemap.xml</loc></sitemap>',
  string_agg(concat('<sitemap><loc>https://www.profiles.edu/map-', uni, '-', CAST(k AS STRING), '.xml</loc></sitemap>'), ''), '</sitemapindex>')
FROM (SELECT DISTINCT CAST(person_key % 25 AS STRING) AS uni, obs_id % 4 AS k FROM observations) b GROUP BY uni
UNION ALL
SELECT concat('https://www.profiles.edu/map-', uni, '-', CAST(k AS STRING), '.xml'), concat('<urlset>', string_agg(concat('<url><loc>https://www.profiles.edu/people/', CAST(obs_id AS STRING), '</loc></url>'), ''), '</urlset>')
FROM (SELECT CAST(person_key % 25 AS STRING) AS uni, obs_id % 4 AS k, obs_id FROM observations) c GROUP BY uni, k
"""

# pages that some of the direct forms of people lead to
VIEWS["form_pages"] = r"""
SELECT url, concat('<html><body><h1>', max(shown), '</h1><p>', max(words), '</p></body></html>') AS html FROM (
  SELECT CASE obs_id % 4 WHEN 0 THEN concat('https://www.', dom, '/people/', f, '-', l) WHEN 1 THEN concat('https://www.', dom, '/~', l) WHEN 2 THEN concat('https://', l, '.', dom)
      ELSE concat('https://scholar.google.com/citations?user=', f, l) END AS url,
    CASE WHEN person_key % 3 = 0 THEN 'Someone Else' ELSE name END AS shown, CASE WHEN person_key % 2 = 0 THEN 'Publications and research' ELSE 'Welcome' END AS words
  FROM (SELECT obs_id, person_key, name, concat(replace(lower(replace(university, 'University of ', '')), ' ', ''), '.edu') AS dom, concat('g', translate(CAST(person_key % 40 AS STRING), '0123456789', 'abcdefghij')) AS f,
    concat('f', translate(CAST(person_key % 700 AS STRING), '0123456789', 'abcdefghij')) AS l FROM observations WHERE person_key % 5 < 3) s) u GROUP BY url
"""

# profile, scholar, listing and lab pages on which every branch of the extractors is taken
VIEWS["rich_profiles"] = r"""
SELECT obs_id AS page_id, concat('https://www.rich.edu/people/', CAST(obs_id AS STRING)) AS url,
  concat('<html><body><h1>', name, '</h1><div class="bio">Studies of ', department, ' with many students and a long record of teaching.</div><p>Department of ', department, '</p>',
    '<h3>Research Interests</h3><ul><li>alpha topics</li><li>beta ', department, '</li></ul><h3>Education</h3><p>PhD at ', university, '</p><p>(', CASE obs_id % 2 WHEN 0 THEN 'she/her' ELSE 'prefers they/theirs' END, ')</p>',
    '<p>Office: Hall ', CAST(obs_id % 90 + 10 AS STRING), ', first floor</p><ul><li>A long enough publication title number ', CAST(obs_id AS STRING), '</li><li>short one</li></ul>',
    '<p>Our research on ', department, ' asks how people learn and remember over many years.</p><p>The project uses a method of analysis that ', name, ' has made over time.</p><p>research</p></body></html>') AS html
FROM observations
"""

VIEWS["scholar_pages"] = r"""
SELECT obs_id AS page_id, concat('https://scholar.google.com/citations?user=', CAST(obs_id AS STRING)) AS url,
  concat('<html><body><div class="gsc_prf_il">', university, '</div><div id="gsc_prf_int"><a href="/i1">Memory</a><a href="/i2">', department, '</a><a href="/i3"> </a></div>',
    '<div class="gsc_rsb_co"><a href="/c1">Co ', name, '</a></div><table><tr class="gsc_a_tr"><td><a class="gsc_a_at" href="/p">Paper ', CAST(obs_id AS STRING), '</a><div class="gs_gray">A One, B Two</div></td>',
    '<td><a class="gsc_a_ac" href="/c">', CAST(obs_id % 50 AS STRING), '</a></td><td><span class="gsc_a_y">', CAST(2000 + obs_id % 20 AS STRING), '</span></td></tr>',
    '<tr class="gsc_a_tr"><td><a class="gsc_a_at" href="/q">Draft</a></td></tr><tr class="gsc_a_tr"><td>no title</td></tr></table></body></html>') AS html
FROM observations
"""

VIEWS["layout_pages"] = r"""
SELECT obs_id AS page_id, concat('https://www.layout.edu/', CAST(obs_id AS STRING)) AS url,
  concat('<html><body>', CASE obs_id % 4 WHEN 0 THEN concat('<table>', repeat('<tr class="person"><td>x</td></tr>', 6), '</table>')
    WHEN 1 THEN '<div class="card faculty">x</div><img src="/faculty/a.jpg"><div class="pager">2</div>' WHEN 2 THEN '<div class="grid"><ul><li>x</li></ul></div>' ELSE '<p>nothing</p>' END,
    '<p>See <a href="/a', CAST(obs_id AS STRING), '">one <b>link</b></a> now</p><a href="/b">two</a></body></html>') AS html
FROM observations
"""

VIEWS["lab_texts"] = r"""
SELECT obs_id, lab_name, research_interests, concat('Equipment: EEG amplifier ', CAST(obs_id % 3 AS STRING), '. We also use an eye tracker and a recording system.') AS text FROM observations WHERE lab_name <> ''
"""

VIEWS["project_pages"] = r"""
SELECT obs_id AS page_id, concat('https://www.labs.edu/', CAST(obs_id AS STRING)) AS url,
  concat('<html><body><h2>Current Projects</h2><ul><li>Study of ', department, ' funded by the Nation Fund, started in ', CAST(2000 + obs_id % 20 AS STRING),
    '. Methods: surveys and models. Objectives: better data.</li><li>Completed work, $', CAST(obs_id % 900 + 100 AS STRING), ' thousand</li></ul><h3>Lab Members</h3><ul><li>', name,
    ', graduate student, ', coalesce(email, ''), '</li></ul></body></html>') AS html
FROM observations
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; those of ``SPREAD_BY`` are dealt out if they come in few splits, others where the session asks for it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SPREAD_BY:
        return spread(df, SPREAD_BY[name])
    asked = spark.conf.get("spark.acadspark.scan.tasks", None)
    return spread(df) if asked and name not in SMALL_TABLES else df


def _needs(text: str) -> list[str]:
    """Names of views and tables used by a SQL text."""
    words = set(re.findall(r"[a-z_]+", text))
    return [n for n in (*BASE_TABLES, *VIEWS) if n in words]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    text = VIEWS[name]
    for dep in _needs(text):
        df = view(spark, sf_dir, dep) if dep in VIEWS else table(spark, sf_dir, dep)
        df.createOrReplaceTempView(dep)
    return spark.sql(text)


def with_views(sql: str) -> str:
    """Prefix an oracle query with the derived views it uses."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for dep in _needs(text):
            if dep in VIEWS and dep not in wanted:
                visit(VIEWS[dep])
                wanted.append(dep)

    visit(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest[10:] if recursive else rest}"
    return f"WITH {ctes}\n{body}"


def directory_pages(spark: SparkSession, sf_dir: str, cards_per_page: int = 50) -> DataFrame:
    """Directory listings: person cards of one university department, in numbered pages of bounded size.

    Splitting a department over numbered pages keeps every page small however many people it has.
    """
    obs = view(spark, sf_dir, "observations")
    card = F.concat(
        F.lit('<div class="person"><h3><a href="https://www.profiles.edu/people/'), F.col("obs_id").cast("string"), F.lit('">'), F.col("name"),
        F.lit("</a></h3><p>"), F.coalesce("title", F.lit("")),
        F.lit('</p><p><a href="mailto:'), F.coalesce("email", F.lit("")), F.lit('">'), F.coalesce("email", F.lit("")),
        F.lit('</a> '), F.coalesce("phone", F.lit("")), F.lit('</p><a href="'), F.coalesce("lab_website", F.lit("/lab")), F.lit('">Lab</a></div>'),
    )
    cards = obs.select(
        "university", "department", card.alias("card"),
        F.pmod(F.xxhash64("obs_id"), F.lit(1 << 20)).alias("h"),
    )
    n_pages = cards.groupBy("university", "department").agg(F.ceil(F.count("*") / F.lit(cards_per_page)).alias("n_pages"))
    # a row per department, joined where the cards lie: else all cards of a department would meet in one task and stay there
    paged = cards.join(F.broadcast(n_pages), ["university", "department"]).withColumn("page_no", F.pmod("h", "n_pages"))
    # a number of tasks that stays: pages are small beside the work of reading them
    dealt = paged.repartition(dealt_tasks(spark), "university", "department", "page_no")
    return dealt.groupBy("university", "department", "page_no").agg(
        F.concat(F.lit("<html><body><h1>"), F.first("department"), F.lit(" faculty</h1>"),
                 F.array_join(F.array_sort(F.collect_list("card")), ""), F.lit("</body></html>")).alias("html"),
    ).select(
        F.xxhash64("university", "department", "page_no").alias("page_id"), "university", "department",
        F.concat(F.lit("https://www.directory.edu/"), F.regexp_replace(F.lower("university"), " ", "-"), F.lit("/"),
                 F.regexp_replace(F.lower("department"), " ", "-"), F.lit("?page="), F.col("page_no").cast("string")).alias("url"),
        "html",
    )


def sitemaps(spark: SparkSession, sf_dir: str, urls_per_file: int = 500) -> DataFrame:
    """Sitemap files: profile URLs of one university, in numbered files of bounded size."""
    obs = view(spark, sf_dir, "observations").select("university", "obs_id")
    loc = F.concat(F.lit("<url><loc>https://www.profiles.edu/people/"), F.col("obs_id").cast("string"), F.lit("</loc></url>"))
    n_files = obs.groupBy("university").agg(F.ceil(F.count("*") / F.lit(urls_per_file)).alias("n_files"))
    filed = obs.join(n_files, "university").withColumn("file_no", F.pmod(F.xxhash64("obs_id"), F.col("n_files")))
    return filed.withColumn("loc", loc).groupBy("university", "file_no").agg(
        F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                 F.array_join(F.array_sort(F.collect_list("loc")), ""), F.lit("</urlset>")).alias("xml"),
    )
