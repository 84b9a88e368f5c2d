"""People, members and projects from nested page sections.

Pages are independent, so each Arrow batch of pages is parsed in its task; nothing is grouped or collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.functions import names as N
from acadspark.functions import text as X
from acadspark.functions.constants import LAB_WORD
from acadspark.functions.dom import Node, parse
from acadspark.functions.steps import let, once
from acadspark.operators.predicates import listing_name_ok, person_name_like

# --- fixed values: item selectors in order of specificity, excluded words, title words, caps ---
ITEM_SELECTORS = (
    ("div", "person"), ("div", "views-field-field-directory-profile-1"), ("", "faculty-member"), ("", "person-profile"),
    ("", "profile-card"), ("", "directory-entry"), ("article", "node--type-person"), ("div", "profile"), ("li", "person"), ("tr", "faculty-row"),
)
NAV_TEXT = re.compile("home|about|contact|menu|navigation|sidebar|undergraduate program|graduate program|admissions")
SKIP_TEXTS = {"more", "details", "info", "read more", "cv", "website"}
TITLE_TEXT = re.compile("professor|chair|lecturer|dean|director|fellow|associate|assistant")
LAB_WORDS = LAB_WORD.strip("()").split("|")
OWN_LINK = re.compile(r"\.edu|\.ac\.|scholar\.google|researchgate|orcid")
OTHER_LINK = re.compile("mailto:|tel:|javascript:|#")
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6", "strong", "b"}
TEXTS = {"p", "div", "span", "em", "i"}
PAGES = 100
SECTION_TEXT = {
    "members": re.compile("faculty|staff|investigators|researchers|postdocs|students|alumni|team|members|people|personnel", re.I),
    "projects": re.compile("current projects|ongoing research|research areas|active grants", re.I),
}


def _matches(n: Node, tag: str, cls: str) -> bool:
    return (not tag or n.tag == tag) and cls in n.classes()


def _items(root: Node) -> list[Node]:
    """Items of the first selector that finds more than two, else small linked blocks."""
    nodes = root.nodes()
    for tag, cls in ITEM_SELECTORS:
        hit = [n for n in nodes if _matches(n, tag, cls)]
        if len(hit) > 2:
            return hit
    out = []
    for n in nodes:
        if n.tag in ("div", "li", "tr"):
            links = [a for a in n.find("a") if a.attrs.get("href")]
            t = n.text()
            if links and len(links) < 5 and 20 < len(t) < 1000 and not NAV_TEXT.search(t.lower()):
                out.append(n)
    return out


def _person(item: Node) -> dict | None:
    nodes = item.nodes()
    links = [(a.attrs["href"].strip(), a.text()) for a in nodes if a.tag == "a" and a.attrs.get("href")]
    good = [(h, t) for h, t in links if not OTHER_LINK.match(h) and len(t) >= 2 and t.lower() not in SKIP_TEXTS
            and (not h.startswith("http") or OWN_LINK.search(h))]
    if not good:
        return None
    url, shown = max(good, key=lambda x: len(x[1]))
    heads = (n.text() for n in nodes if n.tag in HEADS)
    texts = (n.text() for n in nodes if n.tag in TEXTS)
    return {
        "link_text": shown, "head_text": next((h for h in heads if 2 <= len(h.split()) <= 6), ""), "profile_url": url,
        "email": next((h[7:].strip() for h, _ in links if h.startswith("mailto:") and len(h) > 7), None), "item_text": item.text(),
        "title_text": next((t for t in texts if len(t) < 200 and TITLE_TEXT.search(t.lower())), None),
    }


ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def extract_with(pages: DataFrame, extract: Callable[[str, str], Iterator[dict]], schema: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Run a per-page extractor ``(html, url) -> rows`` over Arrow batches; page columns in ``keep`` are carried."""
    kept = pages.select(*dict.fromkeys((*keep, "url", "html")))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    fields = [tuple(part.split()) for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):  # rows of few pages are held at a time, whatever the size of the batch
                part = batch.slice(at, PAGES)
                place, rows = [], []
                for i, (html, url) in enumerate(zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True)):
                    for row in extract(html, url):
                        place.append(i)
                        rows.append(row)
                if rows:
                    own = part.take(pa.array(place, pa.int32()))
                    columns = [own.column(k) for k in keep] + [pa.array([r[name] for r in rows], ARROW[kind]) for name, kind in fields]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(name for name, _ in fields)])

    return kept.mapInArrow(run, f"{types}, {schema}")


def _listing_rows(html: str, url: str) -> Iterator[dict]:
    for pos, item in enumerate(_items(parse(html))):
        got = _person(item)
        if got:
            yield {"pos": pos, **got}


def directory_people(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), extractor: Callable = _listing_rows) -> DataFrame:
    """People of listing pages. Nesting is read in Arrow batches; names, titles and e-mails are judged by expressions.

    ``extractor`` may be a site's own function with the same columns.
    """
    schema = "pos bigint, link_text string, head_text string, profile_url string, email string, item_text string, title_text string"
    raw = extract_with(pages, extractor, schema, keep)
    # a name is made once per entry, and that of the heading only where the link has none; what a caller leaves out is not computed
    shown = once(raw.withColumn("_link", N.display_name(F.col("link_text"))), "_link")
    bad_head = lambda h: F.exists(F.split(F.lower(h), r"\s+"), lambda w: w.isin("faculty", "directory", "staff"))
    head = let(N.display_name(F.col("head_text")), lambda h: F.when((h != "") & ~bad_head(h), h))
    named = once(shown.withColumn("name", F.when(listing_name_ok(F.col("_link")), F.col("_link")).otherwise(head)).drop("_link", "link_text", "head_text"), "name")
    mail = F.coalesce("email", F.get(X.emails(F.col("item_text")), F.lit(0)))
    out = named.filter("name IS NOT NULL AND profile_url <> ''").withColumns({"email": mail, "title": X.normalize_title(F.col("title_text"))})
    return out.select(*keep, "pos", "name", "title", "email", "profile_url", "item_text")


def _section_rows(html: str, url: str) -> Iterator[dict]:
    root = parse(html)
    nodes = root.nodes()
    for kind, pattern in SECTION_TEXT.items():
        for i, n in enumerate(nodes):
            if n.tag in ("h1", "h2", "h3", "h4") and pattern.search(n.text()):
                nxt = next((m for m in nodes[i + 1:] if m.tag in ("div", "ul", "ol", "table", "p")), None)
                if nxt is None:
                    continue
                parts = nxt.find("li") if nxt.tag in ("ul", "ol") else nxt.find("tr") if nxt.tag == "table" else [nxt]
                for p in parts:
                    t = p.text()
                    if t:
                        yield {"kind": kind, "section": n.text(), "text": t}
    for a in root.find("a"):
        if a.attrs.get("href") and a.text():
            yield {"kind": "anchor", "section": "", "text": a.text()}


def page_sections(pages: DataFrame) -> DataFrame:
    """Entries of member and project sections and anchor texts."""
    return extract_with(pages, _section_rows, "kind string, section string, text string")


def lab_members(pages: DataFrame) -> DataFrame:
    """Members of lab pages: section entries with their fields, and anchors that look like names."""
    s = person_name_like(page_sections(pages), "text", "named")
    rows = s.filter((F.col("kind") == "members") | ((F.col("kind") == "anchor") & F.col("named")))
    f = rows.withColumn("m", X.member_fields(F.col("text")))
    return f.select("page_id", "text", F.when(F.col("kind") == "anchor", "unknown").otherwise(F.lower("section")).alias("role_section"), "m.role", "m.email", "m.phone", "m.office")


def lab_projects(pages: DataFrame) -> DataFrame:
    """Projects of lab pages with funding, dates, status and methods."""
    rows = page_sections(pages).filter(F.col("kind") == "projects").withColumn("p", X.project_fields(F.col("text")))
    return rows.select("page_id", "section", "text", "p.funding_agency", "p.funding_amount", "p.start_date", "p.end_date", "p.status", "p.methodology", "p.objectives")


# fixed values: words and classes of the parts of a profile
INTERESTS, EDUCATION = ("research.?interest", "expertise", "specialization"), ("education", "degree")
BIO_CLASSES = {"bio", "biography", "about", "description", "profile-text", "faculty-bio"}
BIO_TEXT, UNIT_WORDS = re.compile("research|professor|study|work"), ("department", "school", "college", "institute", "center")
PARTS, UNITS = {"ul", "ol", "p", "div"}, {"p", "li", "h2", "h3"}


def word_test(words: tuple[str, ...]) -> Callable[[str], bool]:
    """Whether a text holds one of the words or short patterns in any case. The pattern is tried on texts with the last word of one
    of them, and on all that are not plain ASCII, where more characters are equal but for case."""
    pattern, parts = re.compile("|".join(words), re.I), [w.rpartition("?")[2] for w in words]
    plain = parts == list(words)

    def test(text: str) -> bool:
        if text.isascii():
            low = text.lower()
            likely = any([w in low for w in parts])
            if plain or not likely:
                return likely
        return pattern.search(text) is not None

    return test


NAMES_INTERESTS, NAMES_EDUCATION, NAMES_UNIT = word_test(INTERESTS), word_test(EDUCATION), word_test(UNIT_WORDS)


def _detail_rows(html: str, url: str) -> Iterator[dict]:
    root = parse(html)
    nodes = root.nodes()
    own = [(i, " ".join([k for k in n.kids if type(k) is str])) for i, n in enumerate(nodes) if n.kids]

    def after(named: Callable[[str], bool]) -> str:
        for i, t in own:
            if t and named(t):
                for k in range(i + 1, len(nodes)):
                    if nodes[k].tag in PARTS:
                        return nodes[k].text(" | ")
        return ""

    bio = next((n.text() for n in nodes if "class" in n.attrs and not BIO_CLASSES.isdisjoint(n.classes()) and len(n.text()) > 50), None)
    bio = bio or next((p for p in (n.text() for n in nodes if n.tag == "p") if len(p) > 100 and BIO_TEXT.search(p.lower())), "")
    yield {
        "bio": bio, "interests_text": after(NAMES_INTERESTS), "education": after(NAMES_EDUCATION),
        "publications_text": " | ".join([t for t in (n.text() for n in nodes if n.tag == "li") if len(t) > 20]), "page_text": root.text(),
        "affiliations_text": " | ".join([t for t in (n.text() for n in nodes if n.tag in UNITS) if NAMES_UNIT(t)]),
    }


def profile_details(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Biography, interests, affiliations, publications, education, office, phone, e-mail and pronouns of profile pages."""
    schema = "bio string, interests_text string, education string, publications_text string, page_text string, affiliations_text string"
    d = extract_with(pages, _detail_rows, schema, keep)
    t = F.col("page_text")
    split = F.filter(F.transform(F.split("interests_text", r"[,;|\n]"), lambda x: F.trim(x)), lambda x: F.length(x).between(4, 99))
    return d.select(
        *keep, "bio", split.alias("interests"), "education", F.filter(F.split("publications_text", r" \| "), lambda x: x != "").alias("publications"),
        F.filter(F.split("affiliations_text", r" \| "), lambda x: x != "").alias("affiliations"),
        X.first_field(t, X.OFFICE_PATTERNS, 3, 100).alias("office"), F.get(X.phones(t), F.lit(0)).alias("phone"), F.get(X.emails(t), F.lit(0)).alias("email"),
        X.first_field(t, X.PRONOUN_PATTERNS).alias("pronouns"), X.first_field(t, X.LAB_NAME_PATTERNS, 5).alias("lab_name"))


def _context_rows(html: str, url: str) -> Iterator[dict]:
    for pos, a in enumerate(n for n in parse(html).find("a") if n.attrs.get("href")):
        yield {"pos": pos, "href": a.attrs["href"].strip(), "text": a.text(), "context": a.up.text() if a.up else ""}


def link_context(pages: DataFrame) -> DataFrame:
    """Anchors with their parent's text."""
    return extract_with(pages, _context_rows, "pos bigint, href string, text string, context string")


def _nearby_rows(html: str, url: str) -> Iterator[dict]:
    """Links of the containers around a text that names a lab: the text's own element and the two above it."""
    root = parse(html)
    place = {id(a): pos for pos, a in enumerate(root.find("a"))}
    links: dict[int, list[Node]] = {}
    for around, text in [(n, k) for n in (root, *root.nodes()) for k in n.kids if type(k) is str and len(k) >= 10]:
        context = " ".join(text.split())
        low = context.lower()
        if len(context) < 10 or not any([w in low for w in LAB_WORDS]):
            continue
        seen: set[int] = set()
        for _ in range(3):
            if around is None:
                break
            if id(around) not in links:
                own = [around] if around.tag == "a" else []
                links[id(around)] = [a for a in (*own, *around.find("a")) if a.attrs.get("href")]
            for a in links[id(around)]:
                if id(a) not in seen:
                    seen.add(id(a))
                    yield {"pos": place[id(a)], "href": a.attrs["href"].strip(), "text": a.text(), "context": context}
            around = around.up


def nearby_lab_links(pages: DataFrame, min_points: int = 30) -> DataFrame:
    """Links near text that names a lab, scored with their context: best one per page and target."""
    from acadspark.functions import constants as K
    from acadspark.functions import scores as Z
    from acadspark.functions import urls as U

    rows = extract_with(pages, _nearby_rows, "pos bigint, href string, text string, context string", ("page_id", "url")).withColumnRenamed("url", "page_url")
    ok = rows.filter((F.col("href") != "") & ~F.lower("href").rlike(K.EXCLUDED_LINK))
    full = ok.withColumn("full_url", U.resolve(F.col("href"), F.col("page_url"))).filter("full_url IS NOT NULL")
    scored = full.withColumn("points", Z.context_link_points(F.col("full_url"), F.col("text"), F.col("context"))).filter(F.col("points") > min_points)
    best = scored.groupBy("page_id", "full_url").agg(F.max_by(F.struct("points", "text", "context"), F.struct("points", -F.col("pos"))).alias("b"))
    return best.select("page_id", "full_url", "b.points", "b.text", F.col("b.context").alias("context"))
