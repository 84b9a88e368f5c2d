"""Queries over raw pages and generated profile pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from acadspark.catalog import sqlparts as S
from acadspark.catalog.registry import query
from acadspark.functions import constants as K
from acadspark.functions import scores as Z
from acadspark.functions import text as X
from acadspark.functions import urls as U
from acadspark.operators import pages as G
from acadspark.operators import predicates as P
from acadspark.sources.fixtures import table, view

q = S.q
BODY = f"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"


def inner(x):
    return S.clean(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")


def bodies(tab="pages"):
    return f"b AS (SELECT page_id, url, {BODY} AS body FROM {tab})"


def anchors(tab="profile_pages"):
    return f"""{bodies(tab)}, anchors AS (
  SELECT page_id, page_url, pos, trim(regexp_extract(tag, {q(G.ANCHOR)}, 1)) AS href, {inner(f"regexp_extract(tag, {q(G.ANCHOR)}, 2)")} AS text
  FROM (SELECT page_id, url AS page_url, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM (SELECT page_id, url, regexp_extract_all(body, {q(G.ANCHOR)}) AS tags FROM b) t) u)"""


DESCRIPTION = q(r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']""")


def numbered(table_, list_sql, names="x", where="TRUE"):
    """Rows of a list per page with their ordinal after filtering."""
    return f"(SELECT page_id, unnest(l) AS {names}, unnest(range(len(l))) AS pos FROM (SELECT page_id, url, {list_sql} AS l FROM {table_} WHERE {where}) z)"


def pages(spark, sf):
    return table(spark, sf, "pages")


def profiles(spark, sf):
    return view(spark, sf, "profile_pages")


def resolved(href="href", page="page_url"):
    origin = f"regexp_extract({page}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    folder = f"CASE WHEN regexp_extract({page}, '^[^:]*://[^/]+(/)', 1) = '' THEN concat({origin}, '/') ELSE regexp_replace(regexp_extract({page}, '^([^?#]*)', 1), '([^/])/[^/]*$', '\\1/') END"
    return f"""CASE WHEN {href} IS NULL OR {href} = '' THEN NULL WHEN regexp_matches({href}, '^https?://') THEN {href}
      WHEN contains({href}, ':') AND NOT starts_with({href}, '/') THEN NULL WHEN starts_with({href}, '//') THEN concat(regexp_extract({page}, '^([^:]*:)', 1), {href})
      WHEN starts_with({href}, '/') THEN concat({origin}, {href}) WHEN starts_with({href}, '?') THEN concat(regexp_extract({page}, '^([^?#]*)', 1), {href})
      WHEN starts_with({href}, '#') THEN concat(regexp_extract({page}, '^([^#]*)', 1), {href}) ELSE concat({folder}, {href}) END"""


@query("scan_pages", r"""SELECT page_id, url, CAST(200 AS INTEGER) AS status, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1)), '') AS title, CAST(length(html) AS BIGINT) AS html_chars FROM pages""")
def _(spark, sf):
    from acadspark.sources.tables import scan_pages
    df = scan_pages(spark, f"{sf}/pages.parquet")
    return df.select("page_id", "url", "status", "title", F.length("html").cast("bigint").alias("html_chars"))


@query("page_meta", f"""WITH {bodies('profile_pages')}
SELECT page_id, nullif(trim(regexp_extract(body, '(?is)<title[^>]*>([^<]+)</title>', 1)), '') AS title,
  nullif(trim(regexp_extract(body, {q('''(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']''')}, 1)), '') AS description,
  coalesce(nullif(trim(regexp_extract(body, '(?i)>([^<>]*last updated[^<>]*)<', 1)), ''), nullif(trim(regexp_extract(body, '(?i)>([^<>]*updated on[^<>]*)<', 1)), ''),
    nullif(trim(regexp_extract(body, '(?i)>([^<>]*last modified[^<>]*)<', 1)), '')) AS last_updated FROM b""")
def _(spark, sf):
    return G.page_meta(profiles(spark, sf)).drop("url")


@query("page_links", f"""WITH {anchors('pages')},
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n FROM anchors
  WHERE href <> '' AND length(text) > 2 AND NOT regexp_matches(lower(href), {q(G.SOCIAL_HOSTS)}))
SELECT page_id, CAST(n AS BIGINT) AS pos, href, text FROM f WHERE n < 100""")
def _(spark, sf):
    return G.academic_links(pages(spark, sf))


@query("first_by_key", f"""WITH {anchors('pages')}
SELECT href, page_id, CAST(pos AS BIGINT) AS pos, text FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS rn FROM anchors) r WHERE rn = 1""")
def _(spark, sf):
    from acadspark.operators.ranking import first_by_key
    return first_by_key(G.page_links(pages(spark, sf)), ("href",), ("page_id", "pos"), ("page_id", "pos", "text"))


_HEAD = f"""list_filter(list_transform(regexp_extract_all(body, {q(G.HEADING)}), lambda t: {{'level': lower(regexp_extract(t, {q(G.HEADING)}, 1)), 'text': {inner(f"regexp_extract(t, {q(G.HEADING)}, 2)")}}}), lambda h: h.text <> '')"""


@query("page_headings", f"WITH {bodies()} SELECT page_id, CAST(pos AS BIGINT) AS pos, x.level AS level, x.text AS text FROM {numbered('b', _HEAD)} r")
def _(spark, sf):
    return G.page_headings(pages(spark, sf))


_PARAS = f"list_transform(regexp_split_to_array(body, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda p: {inner('''regexp_replace(p, '(?is)</p>.*$', '')''')})"


@query("page_paragraphs", f"WITH {bodies()} SELECT page_id, x AS text, CAST(pos AS BIGINT) AS pos FROM {numbered('b', f'list_filter({_PARAS}, lambda p: length(p) > 20)')} r")
def _(spark, sf):
    return G.page_paragraphs(pages(spark, sf))


def _sql_items(frag):
    return f"list_filter(list_transform(regexp_extract_all({frag}, {q(G.ITEM)}, 1), lambda i: {inner('i')}), lambda i: i <> '')"


_LISTS = f"list_filter(list_transform(regexp_extract_all(body, {q(G.LIST)}), lambda t: {{'kind': lower(regexp_extract(t, {q(G.LIST)}, 1)), 'items': {_sql_items('t')}}}), lambda z: len(z.items) > 0)"


@query("page_lists", f"""WITH {bodies()} SELECT page_id, CAST(pos AS BIGINT) AS pos, x.kind AS list_type, array_to_string(x.items, ' | ') AS items FROM {numbered('b', _LISTS)} r""")
def _(spark, sf):
    return G.page_lists(pages(spark, sf)).withColumn("items", F.array_join("items", " | "))


@query("page_tables", f"""WITH {bodies('profile_pages')},
t AS (SELECT page_id, unnest(l) AS t, unnest(range(len(l))) AS table_no FROM (SELECT page_id, regexp_extract_all(body, {q(G.TABLE)}, 1) AS l FROM b) z),
r AS (SELECT page_id, table_no, unnest(l) AS r, unnest(range(len(l))) AS row_no FROM (SELECT page_id, table_no, regexp_extract_all(t, {q(G.ROW)}, 1) AS l FROM t) z)
SELECT page_id, CAST(table_no AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no, array_to_string(list_transform(regexp_extract_all(r, {q(G.CELL)}, 1), lambda c: {inner('c')}), ' | ') AS cells
FROM r WHERE len(regexp_extract_all(r, {q(G.CELL)}, 1)) > 0""")
def _(spark, sf):
    return G.page_tables(profiles(spark, sf)).withColumn("cells", F.array_join("cells", " | "))


_SRC, _ALT = r"""(?i)\ssrc=["']([^"']*)["']""", r"""(?i)\salt=["']([^"']*)["']"""


@query("page_images", f"""WITH {bodies('profile_pages')}
SELECT page_id, CAST(pos AS BIGINT) AS pos, src, alt, CASE WHEN starts_with(src, '/') THEN {resolved('src', 'url')} WHEN starts_with(src, 'http') THEN src END AS image_url FROM (
  SELECT page_id, url, unnest(l).src AS src, unnest(l).alt AS alt, unnest(range(len(l))) AS pos FROM (SELECT page_id, url,
    list_filter(list_transform(regexp_extract_all(body, {q(G.IMAGE)}), lambda t: {{'src': regexp_extract(t, {q(_SRC)}, 1), 'alt': regexp_extract(t, {q(_ALT)}, 1)}}), lambda i: i.src <> '') AS l FROM b) z) y""")
def _(spark, sf):
    return G.page_images(profiles(spark, sf))


def _fulltext(tab):
    return f"""{bodies(tab)}, k AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(body, '(?is)^.*?<body[^>]*>', ''), '(?is)</body>.*$', ''), {q(G.SOCIAL_ANCHOR)}, ' ', 'g') AS kept FROM b),
full_text AS (SELECT page_id, {inner('kept')} AS text, CAST(length(kept) AS BIGINT) AS html_length FROM k)"""


@query("page_text", f"WITH {_fulltext('pages')} SELECT page_id, text, html_length, CAST(length(text) AS BIGINT) AS text_length FROM full_text")
def _(spark, sf):
    return G.page_full_text(pages(spark, sf)).drop("url")


@query("page_contacts", f"WITH {_fulltext('profile_pages')} SELECT page_id, {S.joined(S.emails('text'))} AS emails, {S.joined(S.phones('text'))} AS phones FROM full_text")
def _(spark, sf):
    got = G.page_contacts(profiles(spark, sf))
    return got.select("page_id", F.array_join("emails", " | ").alias("emails"), F.array_join("phones", " | ").alias("phones"))


_SECT = " UNION ALL ".join(
    f"SELECT page_id, '{w}' AS keyword, unnest(l) AS content, unnest(range(len(l))) AS n FROM (SELECT page_id, list_filter(ps, lambda p: contains(lower(p), '{w}')) AS l FROM ps) z"
    for w in G.RESEARCH_WORDS)


@query("research_sections", f"""WITH {bodies('profile_pages')}, ps AS (SELECT page_id, {_PARAS} AS ps FROM b)
SELECT page_id, keyword, CAST(n AS BIGINT) AS n, content FROM ({_SECT}) s WHERE length(content) > 50""")
def _(spark, sf):
    return G.research_sections(profiles(spark, sf))


def _cl(words):
    return f"regexp_matches(body, {q(G._classed(words))})"


@query("page_structure", f"""WITH {bodies()}, f AS (SELECT page_id, body, regexp_matches(body, '(?i)<table[\\s>]') AS has_table, {_cl('grid|row|col')} AS has_grid, {_cl('card')} AS has_cards,
  regexp_matches(body, '(?i)<[uo]l[\\s>]') AS has_list, regexp_matches(body, {q('''(?is)<img\\s[^>]*src=["'][^"']*(?:faculty|person|photo)''')}) AS has_images, {_cl('pagination|pager|page')} AS has_pagination,
  len(regexp_extract_all(body, {q(G._classed('faculty|person|profile'))})) AS faculty_count FROM b),
g AS (SELECT *, CASE WHEN has_table AND faculty_count > 5 THEN 'table' WHEN has_cards THEN 'grid' WHEN has_list THEN 'list' ELSE 'fallback' END AS strategy FROM f)
SELECT page_id, has_table, has_grid, has_cards, has_list, has_images, has_pagination, CAST(faculty_count AS BIGINT) AS faculty_count,
  CASE WHEN has_table THEN 'table' WHEN has_cards THEN 'cards' WHEN {_cl('grid|row')} THEN 'grid' WHEN has_list THEN 'list' ELSE 'unknown' END AS structure_type, strategy,
  CAST(CASE strategy WHEN 'table' THEN 90 WHEN 'fallback' THEN 30 ELSE 80 END AS DOUBLE) / 100 AS confidence FROM g""")
def _(spark, sf):
    return G.page_structure(pages(spark, sf))


@query("count_estimate", f"""WITH {bodies('profile_pages')}, t AS (SELECT page_id, len(regexp_extract_all(body, {q('''(?i)\\sclass=["'](?:[^"']*\\s)?(?:faculty|person|profile|member)(?:\\s[^"']*)?["']''')}))
   + len(regexp_extract_all(body, {q(G._classed('faculty|person|profile'))})) AS marks, {inner('body')} AS text FROM b)
SELECT page_id, CAST(greatest(marks, len(regexp_extract_all(text, {q(K.EMAIL)})), len(regexp_extract_all(text, '\\b(Dr\\.|Prof\\.|Professor)\\s+\\w+'))) AS BIGINT) AS estimate FROM t""")
def _(spark, sf):
    return G.count_estimate(profiles(spark, sf))


@query("faculty_like_page", f"SELECT page_id, {S.rx(f'lower({S.clean_html('html')})', K.FACULTY_PAGE_WORDS)} AS faculty_like FROM profile_pages")
def _(spark, sf):
    return P.faculty_like_page(G.page_text(profiles(spark, sf))).select("page_id", "faculty_like")


@query("profile_patterns", f"""WITH {anchors()}
SELECT page_id, CAST(n AS BIGINT) AS n, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n FROM anchors
  WHERE href <> '' AND (regexp_matches(lower(text), 'profile|bio|cv|faculty') OR regexp_matches(lower(href), 'profile|faculty|people'))) f WHERE n < 20""")
def _(spark, sf):
    return G.profile_patterns(profiles(spark, sf))


# ---- link scores ----

def _count(col, words):
    return "(" + " + ".join(f"CASE WHEN contains({col}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def sql_lab_points(url, text):
    u, t = f"lower({url})", f"lower({text})"

    def first(col, rules):
        return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q(p)}) THEN {n}" for p, n in rules) + " ELSE 0 END"

    fields = " + ".join(f"CASE WHEN contains({t}, '{w}') OR contains({u}, '{w}') THEN 1 ELSE 0 END" for w in K.LAB_FIELD_WORDS)
    return f"""greatest(0, CASE WHEN contains({u}, '.edu') THEN 50 WHEN contains({u}, '.org') THEN 30 WHEN contains({u}, '.gov') THEN 20
      WHEN regexp_matches({u}, '\\.ac\\.(uk|jp|kr|au)') THEN 45 ELSE 0 END + least(30 * len(regexp_extract_all({t}, {q(K.LAB_WORD)})), 60) + {first(u, K.LAB_URL_SCORES)}
      + least(10 * ({fields}), 20) - CASE WHEN length({text}) > 100 THEN 15 ELSE 0 END + {first(t, K.LAB_PHRASE_SCORES)} - 10 * {_count(t, K.LAB_NEGATIVE_WORDS)})"""


@query("excluded_link", f"WITH {anchors()} SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_matches(lower(href), {q(K.EXCLUDED_LINK)}) AS excluded FROM anchors")
def _(spark, sf):
    return P.excluded_link(G.page_links(profiles(spark, sf))).select("page_id", "pos", "excluded")


@query("program_link", f"""WITH {anchors()} SELECT page_id, CAST(pos AS BIGINT) AS pos, href <> '' AND text <> '' AND NOT {S.rx('lower(href)', K.PROGRAM_LINK_SKIP)} AND {S.rx('lower(text)', K.PROGRAM_LINK_WORDS)} AS is_program FROM anchors""")
def _(spark, sf):
    return P.program_link(G.page_links(profiles(spark, sf))).select("page_id", "pos", "is_program")


@query("lab_link_score", f"""WITH {anchors()} SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST({sql_lab_points('href', 'text')} AS DOUBLE) / 100 AS score FROM anchors""")
def _(spark, sf):
    links = G.page_links(profiles(spark, sf))
    return links.select("page_id", "pos", (Z.lab_link_points(F.col("href"), F.col("text")) / F.lit(100.0)).alias("score"))


@query("context_link_score", f"""WITH {anchors()}, s AS (SELECT page_id, pos, {sql_lab_points('href', 'text')}
  + CASE WHEN regexp_matches(ctx, '(directs?|leads?|heads?).+(lab|laboratory|center)') THEN 30 WHEN regexp_matches(ctx, '(lab|laboratory|center).+(website|site|page)') THEN 20 ELSE 0 END AS pts
  FROM (SELECT *, lower(concat('Visit our ', text, ' page')) AS ctx FROM anchors) c)
SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(pts AS DOUBLE) / 100 AS score FROM s WHERE pts > 30""")
def _(spark, sf):
    links = G.page_links(profiles(spark, sf)).withColumn("ctx", F.concat(F.lit("Visit our "), "text", F.lit(" page")))
    scored = links.withColumn("pts", Z.context_link_points(F.col("href"), F.col("text"), F.col("ctx"))).filter("pts > 30")
    return scored.select("page_id", "pos", (F.col("pts") / F.lit(100.0)).alias("score"))


LAB = f"""{anchors()}, full_links AS (SELECT *, {resolved()} AS full_url FROM anchors WHERE href <> '' AND text <> '' AND NOT regexp_matches(lower(href), {q(K.EXCLUDED_LINK)}) AND regexp_matches(lower(text), {q(K.LAB_WORD)})),
scored AS (SELECT *, {sql_lab_points('full_url', 'text')} AS points FROM full_links WHERE full_url IS NOT NULL),
lab_links AS (SELECT page_id, pos, full_url, text, points FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS rn FROM scored WHERE points > 0) r WHERE rn = 1)"""


@query("find_lab_links", f"WITH {LAB} SELECT page_id, full_url AS url, text, CAST(points AS DOUBLE) / 100 AS score FROM lab_links")
def _(spark, sf):
    got = G.lab_links(G.page_links(profiles(spark, sf)))
    return got.select("page_id", F.col("full_url").alias("url"), "text", (F.col("points") / F.lit(100.0)).alias("score"))


@query("lab_links_top3", f"""WITH {LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY points DESC, full_url) AS rank, max(points) OVER (PARTITION BY page_id) AS best FROM lab_links)
SELECT page_id, CAST(rank AS INTEGER) AS rank, full_url AS url, CAST(points AS DOUBLE) / 100 AS score, CAST(best AS DOUBLE) / 100 AS confidence FROM r WHERE rank <= 3""")
def _(spark, sf):
    from acadspark.operators.ranking import lab_links_top3
    got = lab_links_top3(G.lab_links(G.page_links(profiles(spark, sf))))
    return got.select("page_id", "rank", F.col("full_url").alias("url"), (F.col("points") / F.lit(100.0)).alias("score"), (F.col("best") / F.lit(100.0)).alias("confidence"))


_METRIC = r"(?is)<td[^>]*>[^<]*{0}[^<]*</td>\s*<td[^>]*>\s*(\d+)\s*</td>"


@query("scholar_metrics", f"""WITH {bodies('profile_pages')}
SELECT page_id, CAST(coalesce(nullif(regexp_extract(body, 'Cited by (\\d+)', 1), ''), nullif(regexp_extract(body, {q(_METRIC.format('citations'))}, 1), '')) AS BIGINT) AS citation_count,
  CAST(nullif(regexp_extract(body, {q(_METRIC.format('h-index'))}, 1), '') AS BIGINT) AS h_index, CAST(nullif(regexp_extract(body, {q(_METRIC.format('i10-index'))}, 1), '') AS BIGINT) AS i10_index FROM b""")
def _(spark, sf):
    return G.scholar_metrics(profiles(spark, sf)).select("page_id", "citation_count", "h_index", "i10_index")


@query("page_social", f"""WITH {anchors()}, p AS (SELECT page_id, pos, href, CASE {' '.join(f"WHEN regexp_matches(lower(href), {q(f'^https?://(?:[^/]*\\.)?(?:{X.alternation(h)})(?:[/:?#]|$)')}) THEN '{n}'" for n, h in G.SOCIAL_PLATFORMS)} END AS platform FROM anchors)
SELECT page_id, platform, arg_max(href, pos) AS href FROM p WHERE platform IS NOT NULL GROUP BY page_id, platform""")
def _(spark, sf):
    return G.page_social(G.page_links(profiles(spark, sf)))


@query("page_external", f"""WITH {anchors()}, d AS (SELECT DISTINCT page_id, href FROM anchors WHERE starts_with(href, 'http') AND {S.authority('href')} <> {S.authority('page_url')})
SELECT page_id, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY href) AS rn FROM d) r""")
def _(spark, sf):
    return G.page_external(profiles(spark, sf))


@query("listing_labs", f"""WITH {anchors()}, m AS (
  SELECT page_id, unnest({_PARAS}) AS mention FROM b UNION SELECT page_id, unnest({_sql_items('body')}) FROM b UNION SELECT page_id, text FROM anchors)
SELECT page_id, mention, CASE WHEN contains(lower(mention), 'lab') THEN 'lab' WHEN regexp_matches(lower(mention), 'center|institute') THEN 'center' ELSE 'initiative' END AS kind
FROM m WHERE length(mention) > 0 AND length(mention) < 150 AND regexp_matches(lower(mention), 'lab|center|institute|initiative|program')""")
def _(spark, sf):
    return G.listing_labs(profiles(spark, sf))


@query("page_departments", f"""WITH {anchors('listing_pages')},
links AS (SELECT page_id, text AS name, {resolved()} AS url, 'link' AS kind, 50 AS pct, pos FROM anchors
  WHERE (regexp_matches(lower(href), 'department|dept') OR (regexp_matches(lower(href), 'school|college') AND contains(lower(href), 'of')))
    AND NOT regexp_matches(lower(href), '^(mailto:|tel:|javascript:|#)') AND (NOT starts_with(href, 'http') OR regexp_matches(lower(href), '\\.edu|\\.ac\\.'))
    AND text <> '' AND len(regexp_extract_all(text, '\\.')) <= 3 AND NOT regexp_matches(text, '[?!@]') AND NOT regexp_matches(text, '^(https?://|www\\.)')),
heads AS (SELECT page_id, x.text AS name, CAST(NULL AS STRING) AS url, 'heading' AS kind, 60 AS pct, pos + 1000000 AS pos FROM {numbered('b', _HEAD)} r
  WHERE x.level IN ('h1', 'h2', 'h3', 'h4') AND regexp_matches(lower(x.text), 'department|school|college')),
a AS (SELECT * FROM (SELECT * FROM links UNION ALL SELECT * FROM heads) u WHERE length(name) BETWEEN 3 AND 150 AND NOT {S.rx('lower(name)', K.DEPARTMENT_SKIP)} AND (length(name) >= 20 OR {S.rx('lower(name)', K.DEPARTMENT_WORDS)}))
SELECT page_id, name, url, kind, CAST(pct AS INTEGER) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY pos) AS rn FROM a) r WHERE rn = 1""")
def _(spark, sf):
    return G.page_departments(view(spark, sf, "listing_pages"))


def _sql_prog_dept(col):
    out = col
    for w in K.PROGRAM_WORDS:
        out = f"replace({out}, '{w}', ' ')"
    return S.clean(out)


@query("page_programs", f"""WITH {anchors('listing_pages')}
SELECT page_id, CAST(pos AS BIGINT) AS pos, text AS program_name, {resolved()} AS program_url, {_sql_prog_dept('text')} AS department FROM anchors
WHERE href <> '' AND text <> '' AND NOT {S.rx('lower(href)', K.PROGRAM_LINK_SKIP)} AND {S.rx('lower(text)', K.PROGRAM_LINK_WORDS)}""")
def _(spark, sf):
    return G.page_programs(view(spark, sf, "listing_pages"))


@query("nav_directories", f"""WITH {bodies('profile_pages')}, n AS (SELECT page_id, url, array_to_string(regexp_extract_all(body, '(?is)<(?:nav|header)(?:\\s[^>]*)?>(.*?)</(?:nav|header)>', 1), ' ') AS nav FROM b),
a AS (SELECT page_id, url, trim(regexp_extract(t, {q(G.ANCHOR)}, 1)) AS href, {inner(f"regexp_extract(t, {q(G.ANCHOR)}, 2)")} AS text FROM (SELECT page_id, url, unnest(regexp_extract_all(nav, {q(G.ANCHOR)})) AS t FROM n) z),
d AS (SELECT DISTINCT page_id, regexp_replace(href, '^/+|/+$', '', 'g') AS directory FROM a WHERE href <> '' AND regexp_matches(lower(text), 'faculty|people|staff|directory|academics')
  AND (starts_with(href, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) OR NOT starts_with(href, 'http')))
SELECT page_id, directory FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY directory) AS rn FROM d WHERE directory <> '') r""")
def _(spark, sf):
    return G.nav_directories(profiles(spark, sf))


@query("search_result_links", f"""WITH {anchors()}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM anchors WHERE starts_with(href, 'http') AND NOT contains(href, 'duckduckgo.com') AND length(text) > 7)
SELECT page_id, rank, href AS url, text AS title, text AS snippet FROM f""")
def _(spark, sf):
    # anchor texts of the test pages are short
    return G.search_result_links(profiles(spark, sf), min_text=7)


_FIELD = (r"(?is)<h3[^>]*>Position</h3>\s*<p[^>]*>(.*?)</p>", r"(?is)<h1[^>]*>.*?</h1>\s*<p[^>]*>(.*?)</p>", r"""(?is)<a\s[^>]*href=["'](mailto:[^"']+)["']""", r"(?is)<h1[^>]*>(.*?)</h1>")


@query("select_field", f"WITH {bodies('profile_pages')} SELECT page_id, coalesce(" + ", ".join(
    f"nullif({inner(f'''regexp_replace(regexp_extract(body, {q(p)}, 1), '(?i)^mailto:', '')''')}, '')" for p in _FIELD) + ") AS value FROM b")
def _(spark, sf):
    return G.select_field(profiles(spark, sf), _FIELD).select("page_id", "value")


@query("longest_link_name", f"""WITH {anchors()}, ok AS (SELECT * FROM anchors WHERE NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)') AND length(text) >= 2
    AND lower(text) NOT IN ('more', 'details', 'info', 'read more', 'cv', 'website') AND (NOT starts_with(href, 'http') OR regexp_matches(href, '\\.edu|\\.ac\\.|scholar\\.google|researchgate|orcid'))),
best AS (SELECT page_id, {S.display_name('text')} AS name, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, pos) AS rn FROM ok) r WHERE rn = 1),
w AS (SELECT *, regexp_split_to_array(trim(name), '\\s+') AS w FROM best)
SELECT page_id, name, href, len(w) BETWEEN 2 AND 6 AND len(list_filter(w, lambda x: lower(x) IN ({', '.join(q(x) for x in K.LISTING_BLOCK_WORDS)}))) = 0
  AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{L}}{{3,}}$'))) > 0 AS valid FROM w""")
def _(spark, sf):
    return G.longest_link_name(G.page_links(profiles(spark, sf)))


@query("contact_fallback", f"""WITH {bodies('profile_pages')}
SELECT page_id, coalesce(nullif(trim(regexp_extract(body, {q('''(?i)href=["']mailto:([^"']+)["']''')}, 1)), ''), ({S.emails(inner('body'))})[1]) AS email,
  coalesce((list_filter(list_transform(regexp_extract_all(body, {q(G.ANCHOR)}, 2), lambda a: {inner('a')}), lambda t: length(t) > 3))[1],
    nullif(regexp_extract(body, {q('''(?is)<img\\s[^>]*\\salt=["']([^"']{4,})["']''')}, 1), '')) AS name FROM b""")
def _(spark, sf):
    return G.contact_fallback(profiles(spark, sf))


@query("department_subdomain", """SELECT page_id, CASE WHEN h <> 'www.example.com' THEN base END AS subdomain_base,
  CASE WHEN h <> 'www.example.com' AND len(string_split(h, '.')) > 2 THEN array_to_string(list_transform(string_split(lab, ' '), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ') END AS department FROM (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS base,
    replace(split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '.', 1), '-', ' ') AS lab FROM pages) p""")
def _(spark, sf):
    return G.department_subdomain(pages(spark, sf), "www.example.com").select("page_id", "subdomain_base", "department")


@query("paginate_sources", f"""WITH {anchors('listing_pages')}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n FROM anchors WHERE contains(href, 'page')),
t AS (SELECT page_id, n, {resolved()} AS target_url, page_url FROM f)
SELECT t.page_id, CAST(t.n AS BIGINT) AS n, t.target_url, p.page_id AS target_page FROM t JOIN listing_pages p ON t.target_url = p.url WHERE t.target_url <> t.page_url""")
def _(spark, sf):
    return G.paginate_sources(view(spark, sf, "listing_pages"))


@query("block_position", f"""WITH {bodies()} SELECT page_id, CAST(pos AS BIGINT) AS block, x AS text
FROM {numbered('b', f"list_filter(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda t: {S.clean('t')}), lambda t: length(t) BETWEEN 10 AND 500)")} r""")
def _(spark, sf):
    return G.block_position(pages(spark, sf))


@query("resolve_url", f"WITH {anchors('pages')} SELECT page_id, CAST(pos AS BIGINT) AS pos, {resolved()} AS full_url FROM anchors")
def _(spark, sf):
    links = G.page_links(pages(spark, sf))
    return links.select("page_id", "pos", U.resolve(F.col("href"), F.col("page_url")).alias("full_url"))


@query("categorize_listing_link", f"""WITH {anchors()}, l AS (SELECT *, lower(href) AS u, lower(text) AS t, contains(lower(href), 'nation1.edu') AS own FROM anchors)
SELECT page_id, CAST(pos AS BIGINT) AS pos, CASE WHEN own AND regexp_matches(u, 'faculty|profile|people|staff') THEN 'university_profile' WHEN own AND regexp_matches(u, 'lab|research|group|center|institute') THEN 'lab_website'
  WHEN contains(u, 'scholar.google') THEN 'google_scholar' WHEN regexp_matches(t, 'homepage|website|personal|cv|resume') OR (own AND regexp_matches(u, '~|personal|home')) THEN 'personal_website'
  WHEN regexp_matches(u, 'researchgate|orcid|academia\\.edu|arxiv') THEN 'research_platform' WHEN regexp_matches(u, 'facebook|twitter|linkedin|instagram') THEN 'social_media'
  WHEN regexp_matches(u, '\\.edu|\\.ac\\.') AND NOT own THEN 'external_academic' WHEN regexp_matches(t, 'cv|curriculum|publications|papers') THEN 'cv_publications' ELSE 'irrelevant' END AS category FROM l""")
def _(spark, sf):
    links = G.page_links(profiles(spark, sf))
    return links.select("page_id", "pos", U.listing_class(F.col("href"), F.col("text"), "https://nation1.edu").alias("category"))


PROFILE_CLASS = """CASE WHEN contains(lower(href), 'scholar.google') THEN 'google_scholar' WHEN regexp_matches(lower(href), 'researchgate\\.net|academia\\.edu|orcid\\.org') THEN 'research_platform'
  WHEN regexp_matches(lower(text), 'homepage|personal|website|home') AND regexp_matches(lower(href), '\\.edu|\\.ac\\.|\\.org|~') THEN 'personal_website'
  WHEN regexp_matches(lower(text), 'lab|laboratory|research group|center') THEN 'lab_website' WHEN regexp_matches(lower(href), 'twitter\\.com|linkedin\\.com|facebook\\.com') THEN 'social_media' END"""


@query("categorize_profile_link", f"WITH {anchors()} SELECT page_id, CAST(pos AS BIGINT) AS pos, {PROFILE_CLASS} AS category FROM anchors")
def _(spark, sf):
    links = G.page_links(profiles(spark, sf))
    return links.select("page_id", "pos", U.profile_link_class(F.col("href"), F.col("text")).alias("category"))


@query("first_link_by_type", f"""WITH {anchors()}, c AS (SELECT page_id, pos, {resolved()} AS url, {PROFILE_CLASS} AS kind FROM anchors)
SELECT page_id, arg_min(url, pos) FILTER (WHERE kind = 'personal_website') AS personal_website, arg_min(url, pos) FILTER (WHERE kind = 'google_scholar') AS google_scholar,
  arg_min(url, pos) FILTER (WHERE kind = 'lab_website') AS lab_website FROM c WHERE url IS NOT NULL GROUP BY page_id""")
def _(spark, sf):
    from acadspark.operators.ranking import first_link_by_type
    return first_link_by_type(G.page_links(profiles(spark, sf)))


@query("content_quality", f"""WITH {bodies('profile_pages')}
SELECT page_id, CAST(least(100, CASE WHEN title <> '' THEN 10 ELSE 0 END + CASE WHEN descr <> '' THEN 10 ELSE 0 END + CASE WHEN cit <> '' THEN 20 ELSE 0 END + CASE WHEN h <> '' THEN 10 ELSE 0 END
  + CASE WHEN length(text) > 1000 THEN 10 ELSE 0 END + CASE WHEN length(text) > 5000 THEN 10 ELSE 0 END + least(5 * n, 30)) AS DOUBLE) / 100 AS quality FROM (
  SELECT page_id, trim(regexp_extract(body, '(?is)<title[^>]*>([^<]+)</title>', 1)) AS title, trim(regexp_extract(body, {q('''(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']''')}, 1)) AS descr,
    regexp_extract(body, 'Cited by (\\d+)', 1) AS cit, regexp_extract(body, {q(_METRIC.format('h-index'))}, 1) AS h, {inner('body')} AS text,
    {' + '.join(f"CASE WHEN contains(lower({inner('body')}), {q(a.lower())}) THEN 1 ELSE 0 END" for a in K.RESEARCH_AREAS)} AS n FROM b) z""")
def _(spark, sf):
    from acadspark.plans.enrichment import page_records
    rec = page_records(profiles(spark, sf))
    return rec.select("page_id", (Z.content_points({"title": F.col("title"), "description": F.col("description"), "text_len": F.length("text"),
                                                    "citation_count": F.col("citation_count"), "h_index": F.col("h_index"), "interests": F.size("areas")}) / F.lit(100.0)).alias("quality"))
