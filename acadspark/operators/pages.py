"""Extraction from crawled pages.

Flat elements are found with regular expressions inside the JVM. Every operator keeps the page key and drops ``html``,
so that no later stage carries page bodies through a shuffle. Elements are numbered within the page by ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions import names as N
from acadspark.functions import scores as Z
from acadspark.functions import text as X
from acadspark.functions import urls as U
from acadspark.functions.steps import head
from acadspark.operators.predicates import department_ok, listing_name_ok, program_link

# --- fixed values: tag patterns ---
ANCHOR = r"""(?is)<a\s[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""
SOCIAL_ANCHOR = r"""(?is)<a\s[^>]*href=["'][^"']*(?:facebook|twitter|linkedin|instagram|youtube|tiktok)[^"']*["'][^>]*>.*?</a>"""
HEADING = r"(?is)<(h[1-6])(?:\s[^>]*)?>(.*?)</h[1-6]>"
LIST = r"(?is)<(ul|ol)(?:\s[^>]*)?>(.*?)</(?:ul|ol)>"
ITEM = r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"
TABLE = r"(?is)<table(?:\s[^>]*)?>(.*?)</table>"
ROW = r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"
CELL = r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"
IMAGE = r"(?is)<img\s[^>]*>"
SOCIAL_HOSTS = r"facebook\.com|twitter\.com|linkedin\.com|instagram\.com|youtube\.com|tiktok\.com|snapchat\.com"
# --- fixed values: key words of research sections and navigation, platforms and their hosts ---
RESEARCH_WORDS = (
    "research", "publication", "project", "study", "investigation", "analysis", "equipment", "method", "technique",
)
NAV_WORDS = ("faculty", "people", "staff", "directory", "academics")
SOCIAL_PLATFORMS = (
    ("twitter", ("twitter.com", "t.co")), ("facebook", ("facebook.com",)), ("linkedin", ("linkedin.com",)),
    ("youtube", ("youtube.com",)), ("instagram", ("instagram.com",)),
)


def body(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    raw = F.coalesce(html, F.lit(""))
    out = F.when(raw.contains("<!--"), F.regexp_replace(raw, r"(?s)<!--.*?-->", " ")).otherwise(raw)
    return F.regexp_replace(out, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")


def inner_text(fragment: Column) -> Column:
    return X.clean_text(F.regexp_replace(fragment, r"<[^>]*>", " "))


def with_body(pages: DataFrame) -> DataFrame:
    return pages.withColumn("body", body(F.col("html"))).drop("html")


def page_text(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by its readable ``text``."""
    return pages.withColumn("text", X.clean_html(F.col("html"))).drop("html")


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, description and the line that tells the last update."""
    b = with_body(pages)
    node = lambda p: F.nullif(F.trim(F.regexp_extract("body", rf"(?i)>([^<>]*{p}[^<>]*)<", 1)), F.lit(""))
    return b.select(
        "page_id", "url",
        F.nullif(F.trim(F.regexp_extract("body", r"(?is)<title[^>]*>([^<]+)</title>", 1)), F.lit("")).alias("title"),
        F.nullif(F.trim(F.regexp_extract("body", r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']""", 1)), F.lit("")).alias("description"),
        F.coalesce(node("last updated"), node("updated on"), node("last modified")).alias("last_updated"),
    )


def anchors(body_col: Column) -> Column:
    """Array of (href, text) of the anchors in order."""
    return F.transform(
        F.regexp_extract_all(body_col, F.lit(ANCHOR), F.lit(0)),
        lambda t: F.struct(F.trim(F.regexp_extract(t, ANCHOR, 1)).alias("href"), inner_text(F.regexp_extract(t, ANCHOR, 2)).alias("text")))


def interest_items(body_col: Column) -> Column:
    """Entries of the list below a heading of research interests or expertise, each of 4 to 99 characters."""
    part = F.regexp_extract(body_col, r"(?is)(?:research\s*interests?|expertise|specialization)[^<]*</[^>]*>\s*<(ul|ol)[^>]*>(.*?)</\1>", 2)
    return F.filter(_items(part, ITEM), lambda x: F.length(x).between(4, 99))


def biography(body_col: Column) -> Column:
    """Text of more than 50 characters of an element classed as a biography, else the first paragraph of more than 100 that speaks
    of work; null without either."""
    marked = inner_text(F.regexp_extract(body_col, r"""(?is)<(div|section|p)\s[^>]*class=["'](?:[^"']*\s)?(?:bio|biography|about|description|profile-text|faculty-bio)(?:\s[^"']*)?["'][^>]*>(.*?)</\1>""", 2))
    told = F.get(F.filter(paragraphs(body_col), lambda p: (F.length(p) > 100) & F.lower(p).rlike("research|professor|study|work")), F.lit(0))
    return F.when(F.length(marked) > 50, marked).otherwise(told)


def page_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All anchors: page_id, page_url, pos, href, text."""
    b = with_body(pages)
    return b.select("page_id", F.col("url").alias("page_url"), *keep, F.posexplode(anchors(F.col("body"))).alias("pos", "a")).select(
        "page_id", "page_url", *keep, F.col("pos").cast("bigint").alias("pos"), "a.href", "a.text")


def academic_links(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Non-social anchors with more than two characters of text, all of each page or the first ``cap``."""
    found = F.filter(anchors(F.col("body")), lambda a: (a["href"] != "") & (F.length(a["text"]) > 2) & ~F.lower(a["href"]).rlike(SOCIAL_HOSTS))
    b = with_body(pages)
    return b.select("page_id", F.posexplode(head(found, cap)).alias("pos", "a")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "a.href", "a.text")


def page_headings(pages: DataFrame) -> DataFrame:
    """Headings with text: page_id, pos, level, text."""
    b = with_body(pages)
    found = F.transform(F.regexp_extract_all("body", F.lit(HEADING), F.lit(0)), lambda t: F.struct(
        F.lower(F.regexp_extract(t, HEADING, 1)).alias("level"), inner_text(F.regexp_extract(t, HEADING, 2)).alias("text")))
    return b.select("page_id", F.posexplode(F.filter(found, lambda h: h["text"] != "")).alias("pos", "h")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "h.level", "h.text")


def paragraphs(body_col: Column) -> Column:
    """Paragraph texts in order; a paragraph ends at its end tag or where the next one starts."""
    parts = F.split(body_col, r"(?i)<p(?:\s[^>]*)?>")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: inner_text(F.regexp_replace(p, r"(?is)</p>.*$", "")))


def page_paragraphs(pages: DataFrame, min_len: int = 20) -> DataFrame:
    b = with_body(pages)
    found = F.filter(paragraphs(F.col("body")), lambda p: F.length(p) > min_len)
    return b.select("page_id", F.posexplode(found).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))


def _items(fragment: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(fragment, F.lit(pattern), F.lit(1)), inner_text), lambda x: x != "")


def page_lists(pages: DataFrame) -> DataFrame:
    """Flat lists with items: page_id, pos, list_type, items."""
    b = with_body(pages)
    found = F.transform(F.regexp_extract_all("body", F.lit(LIST), F.lit(0)), lambda t: F.struct(
        F.lower(F.regexp_extract(t, LIST, 1)).alias("list_type"), _items(t, ITEM).alias("items")))
    return b.select("page_id", F.posexplode(F.filter(found, lambda x: F.size(x["items"]) > 0)).alias("pos", "l")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "l.list_type", "l.items")


def page_tables(pages: DataFrame) -> DataFrame:
    """Cells of flat tables: page_id, table_no, row_no, cells."""
    b = with_body(pages)
    t = b.select("page_id", F.posexplode(F.regexp_extract_all("body", F.lit(TABLE), F.lit(1))).alias("table_no", "t"))
    r = t.select("page_id", "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(ROW), F.lit(1))).alias("row_no", "r"))
    return r.select("page_id", F.col("table_no").cast("bigint").alias("table_no"), F.col("row_no").cast("bigint").alias("row_no"),
                    F.transform(F.regexp_extract_all("r", F.lit(CELL), F.lit(1)), inner_text).alias("cells")).filter(F.size("cells") > 0)


def page_images(pages: DataFrame, base: str | None = None) -> DataFrame:
    """Images with a source: page_id, pos, src, alt and the absolute headshot URL."""
    b = with_body(pages)
    found = F.filter(F.transform(F.regexp_extract_all("body", F.lit(IMAGE), F.lit(0)), lambda t: F.struct(
        F.regexp_extract(t, r"""(?i)\ssrc=["']([^"']*)["']""", 1).alias("src"),
        F.regexp_extract(t, r"""(?i)\salt=["']([^"']*)["']""", 1).alias("alt"))), lambda i: i["src"] != "")
    rows = b.select("page_id", "url", F.posexplode(found).alias("pos", "i")).select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), "i.src", "i.alt")
    shot = F.when(F.col("src").startswith("/"), U.resolve(F.col("src"), F.col("url"))).when(F.col("src").startswith("http"), F.col("src"))
    return rows.withColumn("image_url", shot).drop("url")


def without_social(body_col: Column) -> Column:
    """Inside of the body element without social links."""
    inner = F.regexp_replace(F.regexp_replace(body_col, r"(?is)^.*?<body[^>]*>", ""), r"(?is)</body>.*$", "")
    return F.regexp_replace(inner, SOCIAL_ANCHOR, " ")


def page_full_text(pages: DataFrame) -> DataFrame:
    """Body text without social links, with the lengths of markup and text."""
    b = with_body(pages)
    kept = b.withColumn("kept", without_social(F.col("body"))).drop("body")
    out = kept.withColumn("text", inner_text(F.col("kept"))).withColumn("html_length", F.length("kept").cast("bigint")).drop("kept")
    return out.withColumn("text_length", F.length("text").cast("bigint"))


def page_contacts(pages: DataFrame) -> DataFrame:
    """Distinct e-mail addresses and phone numbers per page."""
    t = page_full_text(pages)
    return t.select("page_id", X.emails(F.col("text")).alias("emails"), X.phones(F.col("text")).alias("phones"))


def research_sections(pages: DataFrame, per_word: int | None = None) -> DataFrame:
    """For each key word the paragraphs that hold it, all or the first ``per_word``, if longer than 50 characters: page_id, keyword, n, content."""
    b = with_body(pages).withColumn("paras", paragraphs(F.col("body"))).drop("body")

    def of(word):
        hits = head(F.filter("paras", lambda p: F.lower(p).contains(word)), per_word)
        return F.filter(F.transform(hits, lambda p, i: F.struct(F.lit(word).alias("keyword"), i.cast("bigint").alias("n"), p.alias("content"))),
                        lambda s: F.length(s["content"]) > 50)

    return b.select("page_id", F.inline(F.concat(*[of(w) for w in RESEARCH_WORDS])))


def _classed(words: str) -> str:
    return rf"""(?is)\sclass=["'][^"']*(?:{words})[^"']*["']"""


def page_structure(pages: DataFrame) -> DataFrame:
    """Layout flags of a listing page, its type and the extraction strategy with confidence."""
    b = with_body(pages)
    c = F.col("body")
    flags = {
        "has_table": c.rlike(r"(?i)<table[\s>]"), "has_grid": c.rlike(_classed("grid|row|col")), "has_cards": c.rlike(_classed("card")),
        "has_list": c.rlike(r"(?i)<[uo]l[\s>]"), "has_images": c.rlike(r"""(?is)<img\s[^>]*src=["'][^"']*(?:faculty|person|photo)"""),
        "has_pagination": c.rlike(_classed("pagination|pager|page")),
        "faculty_count": F.regexp_count(c, F.lit(_classed("faculty|person|profile"))).cast("bigint"),
    }
    out = b.withColumns(flags).withColumns({
        "structure_type": F.when(F.col("has_table"), "table").when(F.col("has_cards"), "cards")
        .when(c.rlike(_classed("grid|row")), "grid").when(F.col("has_list"), "list").otherwise("unknown"),
        "strategy": F.when(F.col("has_table") & (F.col("faculty_count") > 5), "table").when(F.col("has_cards"), "grid")
        .when(F.col("has_list"), "list").otherwise("fallback"),
    })
    pct = F.when(F.col("strategy") == "table", 90).when(F.col("strategy") == "fallback", 30).otherwise(80)
    return out.withColumn("confidence", pct / F.lit(100.0)).drop("body", "url")


def count_estimate(pages: DataFrame) -> DataFrame:
    """People on a page: the greatest of marked elements, e-mail addresses and titled names."""
    b = with_body(pages)
    exact = F.regexp_count("body", F.lit(r"""(?i)\sclass=["'](?:[^"']*\s)?(?:faculty|person|profile|member)(?:\s[^"']*)?["']"""))
    loose = F.regexp_count("body", F.lit(_classed("faculty|person|profile")))
    t = b.withColumns({"marks": (exact + loose).cast("bigint"), "text": inner_text(F.col("body"))})
    mails = F.regexp_count("text", F.lit(K.EMAIL)).cast("bigint")
    titled = F.regexp_count("text", F.lit(r"\b(Dr\.|Prof\.|Professor)\s+\w+")).cast("bigint")
    return t.select("page_id", F.greatest("marks", mails, titled).alias("estimate"))


def profile_patterns(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Profile-like links of each page in order, all or the first ``cap``: page_id, n, href."""
    b = with_body(pages)
    hits = F.filter(anchors(F.col("body")), lambda a: (a["href"] != "") & (
        F.lower(a["text"]).rlike("profile|bio|cv|faculty") | F.lower(a["href"]).rlike("profile|faculty|people")))
    return b.select("page_id", F.posexplode(head(F.transform(hits, lambda a: a["href"]), cap)).alias("n", "href")).withColumn("n", F.col("n").cast("bigint"))


def lab_links(links: DataFrame) -> DataFrame:
    """Lab anchors with a positive score, the first mention of each target per page: adds ``full_url`` and ``points``.

    The first mention is an aggregate over (page, href), combined on the map side.
    """
    ok = links.filter((F.col("href") != "") & (F.col("text") != "") & ~F.lower("href").rlike(K.EXCLUDED_LINK) & F.lower("text").rlike(K.LAB_WORD))
    full = ok.withColumn("full_url", U.resolve(F.col("href"), F.col("page_url"))).filter("full_url IS NOT NULL")
    scored = full.withColumn("points", Z.lab_link_points(F.col("full_url"), F.col("text"))).filter("points > 0")
    return scored.groupBy("page_id", "href").agg(
        F.min("pos").alias("pos"), F.min_by(F.struct("full_url", "text", "points"), "pos").alias("b")
    ).select("page_id", "pos", "href", "b.full_url", "b.text", "b.points")


def scholar_metrics(pages: DataFrame) -> DataFrame:
    """Citations, h-index, i10-index, interests, affiliation, co-authors and publication rows of scholar pages."""
    return with_body(pages).select("page_id", *scholar_columns("body"))


def scholar_columns(body: str) -> list[Column]:
    """The columns of ``scholar_metrics`` from a column of bodies."""

    def metric(name):
        got = F.regexp_extract(body, rf"(?is)<td[^>]*>[^<]*{name}[^<]*</td>\s*<td[^>]*>\s*(\d+)\s*</td>", 1)
        return F.nullif(got, F.lit("")).cast("bigint")

    low = F.lower(body)

    def marked(word, found):
        """What is found in elements that a word marks; nothing is sought on pages without the word."""
        return F.when(low.contains(word), found)

    def names_in(pattern):
        return F.filter(F.transform(F.regexp_extract_all(F.regexp_extract(body, pattern, 1), F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), inner_text), lambda x: x != "")

    row = r"""(?is)<tr[^>]*class=["']gsc_a_tr["'][^>]*>(.*?)</tr>"""
    pubs = F.transform(F.regexp_extract_all(body, F.lit(row), F.lit(1)), lambda r: F.struct(
        inner_text(F.regexp_extract(r, r"""(?is)<a[^>]*class=["']gsc_a_at["'][^>]*>(.*?)</a>""", 1)).alias("title"),
        inner_text(F.regexp_extract(r, r"""(?is)<div[^>]*class=["']gs_gray["'][^>]*>(.*?)</div>""", 1)).alias("authors"),
        inner_text(F.regexp_extract(r, r"""(?is)<span[^>]*class=["']gsc_a_y["'][^>]*>(.*?)</span>""", 1)).alias("year"),
        F.coalesce(F.nullif(F.regexp_extract(r, r"""(?is)<a[^>]*class=["']gsc_a_ac["'][^>]*>\s*(\d+)\s*</a>""", 1), F.lit("")).cast("bigint"), F.lit(0)).alias("citations")))
    none = F.array().cast("array<string>")
    return [
        F.coalesce(F.nullif(F.regexp_extract(body, r"Cited by (\d+)", 1), F.lit("")).cast("bigint"), metric("citations")).alias("citation_count"),
        metric("h-index").alias("h_index"), metric("i10-index").alias("i10_index"),
        marked("gsc_prf_int", names_in(r"""(?is)<div[^>]*id=["']gsc_prf_int["'][^>]*>(.*?)</div>""")).otherwise(none).alias("interests"),
        marked("gsc_prf_il", F.nullif(inner_text(F.regexp_extract(body, r"""(?is)<div[^>]*class=["']gsc_prf_il["'][^>]*>(.*?)</div>""", 1)), F.lit(""))).alias("affiliation"),
        marked("gsc_rsb_co", names_in(r"""(?is)<div[^>]*class=["']gsc_rsb_co["'][^>]*>(.*?)</div>""")).otherwise(none).alias("co_authors"),
        marked("gsc_a_tr", F.filter(pubs, lambda p: p["title"] != "")).otherwise(F.array()).alias("publications"),
    ]


def page_social(links: DataFrame) -> DataFrame:
    """Social link per page and platform; the last one on the page counts."""
    low = F.lower("href")
    platform = F.lit(None).cast("string")
    for p, hosts in reversed(SOCIAL_PLATFORMS):
        # whole host labels, so that t.co does not match pinterest.com
        platform = F.when(low.rlike(rf"^https?://(?:[^/]*\.)?(?:{X.alternation(hosts)})(?:[/:?#]|$)"), p).otherwise(platform)
    return links.withColumn("platform", platform).filter("platform IS NOT NULL").groupBy("page_id", "platform").agg(F.max_by("href", "pos").alias("href"))


def page_external(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct links to other hosts of each page, all or the first ``cap`` by URL."""
    b = with_body(pages)
    own = U.authority(F.col("url"))
    hrefs = F.array_sort(F.array_distinct(F.transform(F.filter(anchors(F.col("body")), lambda a: a["href"].startswith("http") & (U.authority(a["href"]) != own)), lambda a: a["href"])))
    return b.select("page_id", F.explode(head(hrefs, cap)).alias("href"))


def listing_labs(pages: DataFrame) -> DataFrame:
    """Lab, center and initiative mentions in paragraphs, list items and anchors under 150 characters."""
    b = with_body(pages)
    texts = F.concat(paragraphs(F.col("body")), _items(F.col("body"), ITEM), F.transform(anchors(F.col("body")), lambda a: a["text"]))
    rows = b.select("page_id", F.explode(F.array_distinct(texts)).alias("mention")).filter((F.length("mention") > 0) & (F.length("mention") < 150))
    low = F.lower("mention")
    kind = F.when(low.contains("lab"), "lab").when(low.rlike("center|institute"), "center").when(low.rlike("initiative|program"), "initiative")
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL")


def listing_interests(pages: DataFrame) -> DataFrame:
    """Interests named in labelled paragraphs or list items: page_id, interest."""
    b = with_body(pages)
    texts = F.concat(paragraphs(F.col("body")), _items(F.col("body"), ITEM))
    # fixed values: labels of research lines
    labels = "research interests|research areas|areas of expertise|expertise|specialization|focus areas|keywords"
    rows = b.select("page_id", F.explode(F.array_distinct(texts)).alias("t")).filter(F.lower("t").rlike(labels))
    return rows.select("page_id", F.explode(X.interests(F.col("t"))).alias("interest")).distinct()


def page_departments(pages: DataFrame) -> DataFrame:
    """Department links and headings of a directory page, one row per (page, name): url, kind, pct."""
    links = page_links(pages)
    h = F.lower("href")
    is_dept = h.rlike("department|dept") | (h.rlike("school|college") & h.contains("of"))
    usable = ~h.rlike("^(mailto:|tel:|javascript:|#)") & (~F.col("href").startswith("http") | h.rlike(r"\.edu|\.ac\."))
    named = (F.col("text") != "") & (F.regexp_count("text", F.lit(r"\.")) <= 3) & ~F.col("text").rlike(r"[?!@]") & ~F.col("text").rlike(r"^(https?://|www\.)")
    by_link = links.filter(is_dept & usable & named & department_ok(F.col("text"))).select(
        "page_id", F.col("text").alias("name"), U.resolve(F.col("href"), F.col("page_url")).alias("url"), F.lit("link").alias("kind"), F.lit(50).alias("pct"), "pos")
    heads = page_headings(pages).filter(F.col("level").isin("h1", "h2", "h3", "h4") & F.lower("text").rlike("department|school|college") & department_ok(F.col("text")))
    by_head = heads.select("page_id", F.col("text").alias("name"), F.lit(None).cast("string").alias("url"), F.lit("heading").alias("kind"), F.lit(60).alias("pct"),
                           (F.col("pos") + 1_000_000).alias("pos"))
    both = by_link.unionByName(by_head)
    return both.groupBy("page_id", "name").agg(F.min_by(F.struct("url", "kind", "pct"), "pos").alias("d")).select("page_id", "name", "d.url", "d.kind", "d.pct")


def page_programs(pages: DataFrame) -> DataFrame:
    """Program links with the department left in their text."""
    links = program_link(page_links(pages)).filter("is_program")
    return links.select("page_id", "pos", F.col("text").alias("program_name"), U.resolve(F.col("href"), F.col("page_url")).alias("program_url"),
                        X.program_department(F.col("text")).alias("department"))


def nav_directories(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Directory paths named in the navigation, distinct, all or the first ``cap`` by path."""
    b = with_body(pages)
    nav = F.array_join(F.regexp_extract_all("body", F.lit(r"(?is)<(?:nav|header)(?:\s[^>]*)?>(.*?)</(?:nav|header)>"), F.lit(1)), " ")
    own = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    hits = F.filter(anchors(nav), lambda a: (a["href"] != "") & F.lower(a["text"]).rlike("|".join(NAV_WORDS)) & (a["href"].startswith(own) | ~a["href"].startswith("http")))
    dirs = F.array_sort(F.array_distinct(F.filter(F.transform(hits, lambda a: F.regexp_replace(a["href"], r"^/+|/+$", "")), lambda d: d != "")))
    return b.select("page_id", F.explode(head(dirs, cap)).alias("directory"))


def search_result_links(pages: DataFrame, engine_host: str = "duckduckgo.com", n: int | None = None, min_text: int = 10) -> DataFrame:
    """Ranked absolute hits of a result page, without the engine's own links: page_id, rank, url, title."""
    b = with_body(pages)
    hits = F.filter(anchors(F.col("body")), lambda a: a["href"].startswith("http") & ~a["href"].contains(engine_host) & (F.length(a["text"]) > min_text))
    return b.select("page_id", F.posexplode(head(hits, n)).alias("i", "a")).select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("rank"), F.col("a.href").alias("url"), F.col("a.text").alias("title"), F.col("a.text").alias("snippet"))


def api_result_links(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Hits of stored search API responses of either shape: url, title, snippet, source."""
    schema = ("webPages struct<value: array<struct<url:string, name:string, snippet:string>>>, "
              "organic_results array<struct<link:string, title:string, snippet:string>>")
    p = raw.withColumn("_p", F.from_json(col, schema))

    def hits(arr, url, title, source):
        return F.transform(F.coalesce(arr, F.array()), lambda h: F.struct(
            F.coalesce(h[url], F.lit("")).alias("url"), F.coalesce(h[title], F.lit("")).alias("title"),
            F.coalesce(h["snippet"], F.lit("")).alias("snippet"), F.lit(source).alias("source")))

    both = F.concat(hits(F.col("_p.webPages.value"), "url", "name", "bing"), hits(F.col("_p.organic_results"), "link", "title", "serpapi"))
    return p.select(*[c for c in raw.columns if c != col], F.inline(both))


def select_field(pages: DataFrame, patterns, out: str = "value") -> DataFrame:
    """First non-empty alternative of a field; a mailto link yields its address."""
    b = with_body(pages)
    alts = [F.nullif(inner_text(F.regexp_replace(F.regexp_extract("body", p, 1), r"(?i)^mailto:", "")), F.lit("")) for p in patterns]
    return b.withColumn(out, F.coalesce(*alts)).drop("body")


def longest_link_name(links: DataFrame, own_hosts: str = r"\.edu|\.ac\.|scholar\.google|researchgate|orcid") -> DataFrame:
    """Longest eligible anchor text per page as the person's name, the earlier anchor on ties."""
    h = F.col("href")
    # fixed values: link texts that are no names
    skip = F.lower("text").isin("more", "details", "info", "read more", "cv", "website")
    ok = links.filter(~h.rlike("^(mailto:|tel:|javascript:|#)") & (F.length("text") >= 2) & ~skip & (~h.startswith("http") | h.rlike(own_hosts)))
    best = ok.groupBy("page_id").agg(F.max_by(F.struct("text", "href"), F.struct(F.length("text"), -F.col("pos"))).alias("b"))
    named = best.select("page_id", N.display_name(F.col("b.text")).alias("name"), F.col("b.href").alias("href"))
    return named.withColumn("valid", listing_name_ok(F.col("name")))


def contact_fallback(pages: DataFrame) -> DataFrame:
    """E-mail of the first mailto link, else of the text; name of the longest anchor, image alternative or title."""
    b = with_body(pages)
    mail = F.nullif(F.trim(F.regexp_extract("body", r"""(?i)href=["']mailto:([^"']+)["']""", 1)), F.lit(""))
    texts = F.filter(F.transform(anchors(F.col("body")), lambda a: a["text"]), lambda t: F.length(t) > 3)
    alt = F.nullif(F.regexp_extract("body", r"""(?is)<img\s[^>]*\salt=["']([^"']{4,})["']""", 1), F.lit(""))
    tip = F.nullif(F.regexp_extract("body", r"""(?is)<a\s[^>]*\stitle=["']([^"']{4,})["']""", 1), F.lit(""))
    return b.select("page_id", F.coalesce(mail, F.get(X.emails(inner_text(F.col("body"))), F.lit(0))).alias("email"),
                    F.coalesce(F.get(texts, F.lit(0)), alt, tip).alias("name"))


def department_subdomain(pages: DataFrame, base_host: str) -> DataFrame:
    """Department name and base of pages on another host than ``base_host`` with at least three labels."""
    host = U.authority(F.col("url"))
    base = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    labels = F.split(host, r"\.")
    other = host != base_host
    return pages.select("page_id", "url", F.when(other, base).alias("subdomain_base"),
                        F.when(other & (F.size(labels) > 2), F.initcap(F.replace(F.get(labels, F.lit(0)), F.lit("-"), F.lit(" ")))).alias("department"))


def paginate_sources(pages: DataFrame, n: int | None = None) -> DataFrame:
    """Follow the pagination links of each page, all or the first ``n``, to pages that were crawled."""
    b = with_body(pages)
    hits = head(F.filter(anchors(F.col("body")), lambda a: a["href"].contains("page")), n)
    rows = b.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.transform(hits, lambda a: a["href"])).alias("n", "href"))
    target = rows.withColumn("target_url", U.resolve(F.col("href"), F.col("page_url"))).filter("target_url <> page_url")
    known = pages.select(F.col("url").alias("target_url"), F.col("page_id").alias("target_page"))
    return target.join(known, "target_url").select("page_id", F.col("n").cast("bigint").alias("n"), "target_url", "target_page")


def block_position(pages: DataFrame, low: int = 10, high: int = 500) -> DataFrame:
    """Text blocks of bounded length with their ordinal on the page."""
    b = with_body(pages)
    blocks = F.filter(F.transform(F.split("body", r"<[^>]*>"), X.clean_text), lambda t: F.length(t).between(low, high))
    return b.select("page_id", F.posexplode(blocks).alias("block", "text")).withColumn("block", F.col("block").cast("bigint"))
