"""Replacement link candidates: generation, verification and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from acadspark.functions import names as N
from acadspark.functions import urls as U
from acadspark.functions.steps import dealt_tasks, maybe_in, once
from acadspark.functions.text import contains_any

# --- fixed values: institution domains, short names and URL forms ---
KNOWN_DOMAINS = (
    ("stanford university", "stanford.edu"), ("harvard university", "harvard.edu"), ("mit", "mit.edu"),
    ("massachusetts institute of technology", "mit.edu"), ("university of california, berkeley", "berkeley.edu"),
    ("uc berkeley", "berkeley.edu"), ("carnegie mellon university", "cmu.edu"), ("cmu", "cmu.edu"),
    ("university of vermont", "uvm.edu"),
)
LINK_DOMAINS = (
    ("Carnegie Mellon University", ("cmu.edu",)), ("Stanford University", ("stanford.edu",)), ("MIT", ("mit.edu",)),
    ("Harvard University", ("harvard.edu",)), ("University of California", ("berkeley.edu", "ucla.edu", "ucsd.edu")),
    ("University of Arizona", ("arizona.edu",)), ("Arizona State University", ("asu.edu",)),
)
PERSON_PATHS = (
    "/faculty/{}", "/people/{}", "/~{}", "/faculty/{}.html", "/people/{}.html", "/directory/{}", "/profiles/{}",
    "/staff/{}", "/{}", "/{}.html", "/faculty/directory/{}", "/psychology/faculty/{}", "/psychology/people/{}",
)
DIRECT_HOSTS = ("scholar.google.com", "www.researchgate.net", "orcid.org")
# query text and link type; {i} stands for the first interests
QUERY_FORMS = (
    ('"{n}" site:scholar.google.com', "google_scholar"), ('"{n}" {u} site:scholar.google.com', "google_scholar"),
    ('"{n}" {u} faculty homepage', "personal_website"),
    ('"{n}" {d} {u} -site:twitter.com -site:linkedin.com', "personal_website"), ('"{n}" {u} profile page', "personal_website"),
    ('"{n}" site:researchgate.net', "academic_profile"), ('"{n}" site:orcid.org', "academic_profile"),
    ('"{n}" site:academia.edu', "academic_profile"),
)
ACADEMIC_WORDS = ("research", "publication", "cv", "vita", "faculty", "professor")
PLATFORM_WORDS = (
    ("twitter", ("tweet", "following", "followers")), ("linkedin", ("experience", "education", "connections")),
    ("researchgate", ("research", "publication", "citation")), ("academia", ("academic", "research", "university")),
    ("orcid", ("orcid id", "researcher", "publications")),
)
ACADEMIC_TYPES = ("google_scholar", "university_profile", "academic_profile", "personal_website")


def institution_domain(university: Column) -> Column:
    """Known domain of an institution, else one derived from its name."""
    low = F.lower(university)
    derived = F.regexp_replace(low, r"[^a-z\s]", "")
    for w in ("university of ", " university", " college", " institute", " "):
        derived = F.replace(derived, F.lit(w), F.lit(""))
    out = F.concat(derived, F.lit(".edu"))
    for name, domain in reversed(KNOWN_DOMAINS):
        out = F.when(low == name, domain).otherwise(out)
    return out


def institution_short(university: Column) -> Column:
    """Short name: known abbreviation, else initials of up to three long words, else the first word."""
    low = F.lower(university)
    words = F.split(F.trim(university), r"\s+")
    major = F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~F.lower(w).isin("of", "the", "and")), 1, 3)
    initials = F.array_join(F.transform(major, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return (
        F.when(low.contains("massachusetts institute of technology") | (low == "mit"), "MIT")
        .when(low.contains("carnegie mellon"), "CMU")
        .when(low.contains("university of california") & low.contains("berkeley"), "UC Berkeley")
        .when(low.contains("stanford"), "Stanford").when(low.contains("harvard"), "Harvard")
        .when(low.contains("university of vermont"), "UVM")
        .when(initials != "", initials).otherwise(F.get(words, F.lit(0)))
    )


def with_name_parts(people: DataFrame) -> DataFrame:
    """Add ``full`` (title-free lower-case name), ``first_name`` and ``last_name``."""
    df = people.withColumn("full", F.lower(N.display_name(F.col("name"))))
    parts = F.split("full", r"\s+")
    return df.withColumns({
        "first_name": F.get(parts, F.lit(0)),
        "last_name": F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(""),
    })


def _candidate(url: Column, source: str, pct, ord_: int) -> Column:
    return F.struct(url.alias("url"), F.lit(source).alias("source"), (F.lit(pct) if isinstance(pct, int) else pct).alias("pct"),
                    F.lit(ord_).alias("ord"))


def name_forms() -> Column:
    """The nine forms of a name in a URL (none without a last name); needs ``full``, ``first_name`` and ``last_name``."""
    full, first, last = F.col("full"), F.col("first_name"), F.col("last_name")
    return F.when(last != "", F.array(
        F.replace(full, F.lit(" "), F.lit("-")), F.replace(full, F.lit(" "), F.lit("_")), F.replace(full, F.lit(" "), F.lit("")),
        F.concat(first, F.lit("-"), last), F.concat(first, F.lit("_"), last), F.concat(F.substring(first, 1, 1), last),
        F.concat(first, F.lit("."), last), last, F.concat(last, F.lit("-"), first))).otherwise(F.array())


def domain_candidates() -> Column:
    """Array of candidates on the person's domains; needs ``full``, ``first_name``, ``last_name`` and ``domains``."""
    forms = name_forms()
    paths = F.array(*[F.lit(p) for p in PERSON_PATHS])
    return F.flatten(F.transform(F.col("domains"), lambda d: F.flatten(F.transform(forms, lambda n: F.transform(
        paths, lambda p: F.struct(
            F.concat(F.lit("https://"), d, F.replace(p, F.lit("{}"), n)).alias("url"), F.lit("domain_discovery").alias("source"),
            F.when(d.contains(".edu"), 80).otherwise(60).alias("pct")))))))


def _query(c: Column) -> Column:
    return F.url_encode(c)


def direct_candidates() -> Column:
    """Array of five direct academic profile candidates."""
    name, uni = F.col("display_name"), F.col("university")
    dash = F.lower(F.replace(name, F.lit(" "), F.lit("-")))

    def one(url, pct):
        return F.struct(url.alias("url"), F.lit("direct_academic").alias("source"), F.lit(pct).alias("pct"))

    scholar, gate = "https://scholar.google.com/citations?q=", "https://www.researchgate.net/"
    return F.array(
        one(F.concat(F.lit(scholar), _query(name)), 70),
        one(F.concat(F.lit(scholar), _query(F.concat_ws(" ", name, uni))), 70),
        one(F.concat(F.lit(gate + "profile/"), dash), 60),
        one(F.concat(F.lit(gate + "search.Search.html?query="), _query(name)), 60),
        one(F.concat(F.lit("https://orcid.org/search?searchQuery="), _query(name)), 60),
    )


def with_domains(people: DataFrame) -> DataFrame:
    """Add ``domains``: configured for the university, else the host of the profile URL."""
    host = U.authority(F.col("profile_url"))
    out = F.when(host != "", F.array(host)).otherwise(F.array().cast("array<string>"))
    for name, domains in reversed(LINK_DOMAINS):
        out = F.when(F.col("university") == name, F.array(*[F.lit(d) for d in domains])).otherwise(out)
    return people.withColumn("domains", out)


def candidate_array(people: DataFrame, gate: int = 5) -> DataFrame:
    """Add ``found``: domain candidates, direct candidates and, below the gate, search hits (column ``hits`` if present)."""
    df = with_domains(with_name_parts(people)).withColumn("display_name", N.display_name(F.col("name")))
    found = F.concat(domain_candidates(), direct_candidates())
    if "hits" in people.columns:
        found = F.when(F.size(found) < gate, F.concat(found, F.col("hits"))).otherwise(found)
    return df.withColumn("found", F.when(F.col("display_name") != "", found).otherwise(F.array()))


def url_candidates(people: DataFrame, keep: tuple[str, ...], top: int | None = None) -> DataFrame:
    """Candidate rows per person.

    With ``top``, candidates are ranked by prior confidence (then URL) and cut while still in the array, so the
    full fan-out of more than a hundred URLs per person never becomes rows.
    """
    df = candidate_array(people)
    found = F.col("found")
    if top:
        ranked = F.array_sort(F.transform(found, lambda c: F.struct((-c["pct"]).alias("neg"), c["url"].alias("url"), c["source"].alias("source"))))
        found = F.transform(F.slice(ranked, 1, top), lambda c: F.struct(c["url"].alias("url"), c["source"].alias("source"), (-c["neg"]).alias("pct")))
    return df.select(*keep, F.inline(found))


def candidate_keys() -> Column:
    """Array of what candidates derive from: (site, form, source, pct), a row per domain and name form and one per direct form,
    whose form is its whole URL and whose site is empty. Needs the columns of ``with_domains`` and ``display_name``."""
    on_domain = F.flatten(F.transform("domains", lambda d: F.transform(name_forms(), lambda n: F.struct(
        d.alias("site"), n.alias("form"), F.lit("domain_discovery").alias("source"), F.when(d.contains(".edu"), 80).otherwise(60).alias("pct")))))
    direct = F.transform(direct_candidates(), lambda c: F.struct(F.lit("").alias("site"), c["url"].alias("form"), c["source"].alias("source"), c["pct"].alias("pct")))
    return F.concat(on_domain, direct)


def candidate_counts(people: DataFrame, key: str, times: str = "times") -> DataFrame:
    """(key, source, url, pct, n): how often ``url_candidates`` finds a URL for a key, rows of ``people`` counting ``times``.

    Equal (site, form) pairs are summed before they are multiplied by the paths, in the task that holds all rows of their key.
    Two forms may lead to one URL only if one holds a slash, begins with "~" or ends with ".html"; the URLs of keys with such a
    form are summed as they are.
    """
    df = with_domains(with_name_parts(people)).withColumn("display_name", N.display_name(F.col("name"))).filter("display_name <> ''")
    tasks = dealt_tasks(people.sparkSession)  # few bytes become a hundred times as many rows
    keys = df.select(key, times, "full", "first_name", "last_name", "domains", "display_name", "university").repartition(tasks, key)
    sums = keys.select(key, times, F.inline(candidate_keys())).groupBy(key, "source", "site", "form").agg(F.max("pct").alias("pct"), F.sum(times).alias("n"))
    odd = (F.col("site") != "") & F.col("form").rlike(r"/|^~|\.html$")
    marked = sums.withColumn("_odd", F.max(odd).over(W.partitionBy(key)))
    paths = F.when(F.col("site") == "", F.array("form")).otherwise(F.transform(
        F.array(*[F.lit(p) for p in PERSON_PATHS]), lambda p: F.concat(F.lit("https://"), F.col("site"), F.replace(p, F.lit("{}"), F.col("form")))))
    urls = lambda rows: rows.select(key, "source", F.explode(paths).alias("url"), "pct", "n")
    again = urls(marked.filter("_odd")).groupBy(key, "source", "url").agg(F.max("pct").alias("pct"), F.sum("n").alias("n"))
    return urls(marked.filter("NOT _odd")).unionByName(again)


def classed_candidates(people: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """All rows of ``url_candidates`` with their class: (*keep, url, source, prior_pct, link_type, pct).

    As ``categorize_url`` on every URL, but a host is judged once for all that a person may have on it, and the words of a form
    once for all paths. No word but those with a slash crosses from a path into a form, so forms that hold a slash, or end the path
    by a query or fragment, are judged with each path.
    """
    df = with_domains(with_name_parts(people)).withColumn("display_name", N.display_name(F.col("name"))).filter("display_name <> ''")
    df = once(df, "full", "first_name", "last_name", "display_name")
    parts = df.select(*keep, "full", "first_name", "last_name", F.explode("domains").alias("site"))
    host = F.replace(F.lower("site"), F.lit("www."), F.lit(""))
    known = F.coalesce(U.host_class(host), F.when(~U.academic_host(host), U.other_class(host)))  # null on academic hosts
    hosts = once(parts.withColumn("_known", known), "_known")
    forms = hosts.select(*keep, "site", "_known", F.explode(name_forms()).alias("form"))
    plain = ~F.col("form").rlike("[/?#]")
    forms = once(forms.withColumns({"_plain": plain} | {f"_{t}": F.when(F.col("_known").isNull() & plain, contains_any(F.col("form"), w)) for t, w in U.PATH_TESTS.items()}),
                 "_plain", *[f"_{t}" for t in U.PATH_TESTS])

    def one(p: str) -> Column:
        before, after = p.split("{}")
        rest = F.concat(F.lit(before), "form", F.lit(after))
        part = lambda t: any(w in piece for w in U.PATH_TESTS[t] for piece in (before, after))
        quick = U.academic_class(lambda t: F.lit(True) if part(t) else F.col(f"_{t}"))
        read = U.academic_class(lambda t: contains_any(U.path(F.lower(rest)), U.PATH_TESTS[t]))
        got = F.coalesce("_known", F.when(F.col("_plain"), quick).otherwise(read))
        return F.struct(F.concat(F.lit("https://"), "site", F.lit(before), "form", F.lit(after)).alias("url"), got.alias("class"))

    rows = forms.select(*keep, "site", F.inline(F.array(*[one(p) for p in PERSON_PATHS])))
    edu = F.when(F.col("site").contains(".edu"), 80).otherwise(60)
    on_domain = rows.select(*keep, "url", F.lit("domain_discovery").alias("source"), edu.alias("prior_pct"), "class.link_type", "class.pct")
    at = U.authority(F.col("url"))
    classes = F.coalesce(*[F.when(at == h, U.host_class(F.lit(h.replace("www.", "")))) for h in DIRECT_HOSTS])
    direct = df.select(*keep, F.inline(direct_candidates())).withColumn("class", classes)
    return on_domain.unionByName(direct.select(*keep, "url", "source", F.col("pct").alias("prior_pct"), "class.link_type", "class.pct"))


def candidate_index(fetches: DataFrame) -> DataFrame:
    """Inverted index of fetched pages: (site, form, url) for every way in which a candidate could have led there.

    ``fetches`` has url and is_accessible. An accessible page on a domain has one row for each person path that its URL
    fits, keyed by the domain and what stands in the place of the name; a page that a direct form may lead to has a row
    keyed by its whole URL, with an empty site. A page of several rows is found once for each that a person's forms give,
    as the candidates themselves repeat.
    """
    pages = fetches.filter("is_accessible").select("url").distinct()
    rest = F.regexp_replace("url", r"^https://[^/]*", "")
    site = F.regexp_extract("url", r"^https://([^/]*)/", 1)
    fits = []
    for p in PERSON_PATHS:
        before, after = p.split("{}")
        form = F.substring(rest, F.lit(len(before) + 1), F.length(rest) - len(before) - len(after))
        fits.append(F.when(rest.startswith(before) & rest.endswith(after) & (F.length(rest) > len(before) + len(after)), form))
    on_domain = pages.filter(site != "").select(site.alias("site"), F.explode(F.array_compact(F.array(*fits))).alias("form"), "url")
    direct = pages.filter(F.col("url").rlike("^https://(" + "|".join(h.replace(".", "\\.") for h in DIRECT_HOSTS) + ")/")).select(F.lit("").alias("site"), F.col("url").alias("form"), "url")
    return on_domain.unionByName(direct)


def indexed_candidates(people: DataFrame, fetches: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The accessible rows of ``url_candidates``, found by the index of the pages: (*keep, url, source, pct).

    A person carries its name forms per domain and its direct forms, not the product of forms and paths. A Bloom filter of
    the index, whose size does not grow, takes out forms that lead nowhere before the join; the URL comes from the page.
    """
    index = candidate_index(fetches)
    df = with_domains(with_name_parts(people)).withColumn("display_name", N.display_name(F.col("name"))).filter("display_name <> ''")
    keys = df.select(*keep, F.inline(candidate_keys()))
    return maybe_in(keys, index, "site", "form").join(index, ["site", "form"]).select(*keep, "url", "source", "pct")


def missing_link_forms(people: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Direct forms for a missing scholar profile (three) or personal site (six): kind, url, ord."""
    df = with_name_parts(people).withColumn("dom", institution_domain(F.col("university")))
    f, l, d = F.col("first_name"), F.col("last_name"), F.col("dom")
    i = F.substring(f, 1, 1)
    scholar = "https://scholar.google.com/citations?user="

    def one(kind, n, *parts):
        return F.struct(F.lit(kind).alias("kind"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("url"), F.lit(n).alias("ord"))

    forms = F.array(
        one("scholar", 1, scholar, f, l), one("scholar", 2, scholar, i, l), one("scholar", 3, scholar, l, i),
        one("site", 1, "https://www.", d, "/~", f, l), one("site", 2, "https://www.", d, "/~", l),
        one("site", 3, "https://www.", d, "/people/", f, "-", l), one("site", 4, "https://www.", d, "/faculty/", f, "-", l),
        one("site", 5, "https://", f, l, ".", d), one("site", 6, "https://", l, ".", d),
    )
    return df.select(*keep, F.inline(forms))


def search_queries(people: DataFrame, keep: tuple[str, ...] = ("obs_id",)) -> DataFrame:
    """Search texts per person: generic forms, lab search and report strategies, with type and strategy."""
    name = F.trim(F.coalesce("name", F.lit("")))
    uni = F.trim(F.coalesce("university", F.lit("")))
    dep = F.trim(F.coalesce("department", F.lit("")))
    raw = F.trim(F.coalesce("research_interests", F.lit("")))
    terms = F.array_join(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""), " ")
    first3 = F.array_join(F.transform(F.slice(F.split(raw, ","), 1, 3), lambda x: F.trim(x)), " ")
    clean = F.replace(F.replace(name, F.lit("Dr. "), F.lit("")), F.lit("Prof. "), F.lit(""))

    def one(text, kind, strategy, ok=None):
        s = F.struct(text.alias("query"), F.lit(kind).alias("kind"), F.lit(strategy).alias("strategy"))
        return F.when(ok, s) if ok is not None else s

    def form(text):
        out = F.lit(text)
        for mark, col in (("{n}", name), ("{u}", uni), ("{d}", dep), ("{i}", terms)):
            out = F.replace(out, F.lit(mark), col)
        return F.trim(out)

    items = [one(form(t), k, f"search_{k}", F.length(form(t)) > F.length(name) + 5) for t, k in QUERY_FORMS]
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    items += [
        one(F.concat_ws(" ", quoted, uni), "any", "name_university_search", uni != ""),
        one(F.concat_ws(" ", quoted, dep, uni), "any", "name_department_search", (dep != "") & (uni != "")),
        one(F.concat_ws(" ", quoted, first3), "any", "research_interests_search", raw != ""),
        one(F.concat(F.lit('"'), clean, F.lit('" "'), F.coalesce("lab_name", F.lit("")), F.lit('" "'), uni, F.lit('" (site:.edu OR site:.org)')),
            "lab_website", "lab_search", F.coalesce("lab_name", F.lit("")) != ""),
    ]
    return people.filter(name != "").select(*keep, F.inline(F.array_compact(F.array(*items))))


def verify_candidates(cands: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates whose fetched page shows the person.

    Two name parts must occur in the page; a site also needs an academic word, a profile one of its platform's
    words, a scholar page its host. ``pages`` is (url, text).
    """
    c = cands.withColumn("parts", F.split(F.lower(N.display_name(F.col("name"))), r"\s+"))
    seen = pages.select("url", F.lower("text").alias("low"))
    joined = c.join(seen, "url")
    platform = F.lit(False)
    for p, words in PLATFORM_WORDS:
        platform = F.when(F.col("platform") == p, contains_any(F.col("low"), words)).otherwise(platform)
    return joined.select(
        *cands.columns,
        (F.size(F.filter("parts", lambda p: F.col("low").contains(p))) >= 2).alias("name_ok"),
        contains_any(F.col("low"), ACADEMIC_WORDS).alias("site_ok"), platform.alias("platform_ok"),
        F.col("url").contains("scholar.google.com").alias("scholar_ok"))


def first_verified_profile(verified: DataFrame) -> DataFrame:
    """First verified URL per person and platform, by (obs_id, url)."""
    ok = verified.filter("name_ok AND platform_ok")
    return ok.groupBy("person_key", "platform").agg(F.min_by("url", F.struct("obs_id", "url")).alias("url"))


def candidate_confidence(cands: DataFrame) -> DataFrame:
    """Add ``total_pct``: prior + class confidence + 20 for accessible + 30 for academic types, at most 100."""
    bonus = F.when(F.col("link_type").isin(*ACADEMIC_TYPES), 30).otherwise(0)
    return cands.withColumn("total_pct", F.least(F.lit(100), F.col("prior_pct") + F.col("pct") + 20 + bonus))


def top_candidates(cands: DataFrame, n: int = 3, min_conf: float = 0.4, by: str = "obs_id") -> DataFrame:
    """Accessible, non-social candidates above the cut, best ``n`` per person; ties go to the smaller URL.

    The rank filter is pushed below the shuffle by Spark (WindowGroupLimit), so at most ``n`` rows per person and
    task travel however many candidates one person has.
    """
    w = W.partitionBy(by).orderBy(F.desc("total_pct"), "url")
    kept = cands.filter(F.col("is_accessible") & (F.col("link_type") != "social_media") & (F.col("total_pct") > round(min_conf * 100)))
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_primary_link(people: DataFrame, top: DataFrame) -> DataFrame:
    """Upgrade the personal and lab links of people from their ranked candidates.

    Candidates act in rank order: a scholar profile above 80 replaces a missing, social or weaker site; a personal
    site above 70 a missing or weaker one; a lab site above 70 always replaces the lab link. The last one to act wins,
    as each is compared with the original link.
    """
    return upgraded_links(people.join(ranked_lists(top), "obs_id", "left"))


def ranked_lists(top: DataFrame) -> DataFrame:
    """(obs_id, cands): the few ranked candidates of a person in order."""
    return top.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "link_type", "total_pct"))).alias("cands"))


def upgraded_links(df: DataFrame) -> DataFrame:
    """``best_primary_link`` on rows that hold their links and ranked candidates (``cands``, null for none)."""
    site = F.filter("links", lambda x: x["field"] == "personal_website")
    cur_type, cur_pct = F.get(site, F.lit(0))["link_type"], F.coalesce(F.get(site, F.lit(0))["pct"], F.lit(0))
    missing = F.coalesce("personal_website", F.lit("")) == ""
    scholar = lambda c: (c["link_type"] == "google_scholar") & (c["total_pct"] > 80) & (
        missing | F.coalesce(cur_type == "social_media", F.lit(False)) | (cur_pct < c["total_pct"]))
    own = lambda c: (c["link_type"] == "personal_website") & (c["total_pct"] > 70) & (missing | (cur_pct < c["total_pct"]))
    sites = F.filter("cands", lambda c: scholar(c) | own(c))
    labs = F.filter("cands", lambda c: (c["link_type"] == "lab_website") & (c["total_pct"] > 70))
    new_site, new_lab = F.try_element_at(sites, F.lit(-1))["url"], F.try_element_at(labs, F.lit(-1))["url"]
    return df.withColumns({
        "new_personal_website": F.coalesce(new_site, F.col("personal_website")),
        "new_lab_website": F.coalesce(new_lab, F.col("lab_website")),
        "site_replaced": new_site.isNotNull(), "lab_replaced": new_lab.isNotNull(),
    }).drop("cands")


def merge_enhanced(people: DataFrame, enhanced: DataFrame, cols: tuple[str, ...], on: str = "obs_id") -> DataFrame:
    """Overlay enhanced values on all records; records without one keep theirs."""
    new = enhanced.select(on, *[F.col(c).alias(f"_{c}") for c in cols])
    return people.join(new, on, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in cols}).drop(*[f"_{c}" for c in cols])


def best_personal_site(people: DataFrame, links: tuple[str, ...], base: Column) -> DataFrame:
    """Best personal site among the link columns.

    Academic links only, no social sites: two points per path mark, three per name part, one for the base host;
    the earlier link wins ties.
    """
    parts = F.filter(F.split(F.lower(F.col("name")), r"\s+"), lambda p: F.length(p) > 2)
    arr = F.array(*[F.col(c) for c in links])

    def score(u):
        low = F.lower(u)
        pts = F.lit(0)
        # fixed values: personal path marks
        for mark in ("/~", "/people/", "/faculty/", "/profile/", "personal", "homepage"):
            pts = pts + F.when(low.contains(mark), 2).otherwise(0)
        return pts + 3 * F.size(F.filter(parts, lambda p: low.contains(p))) + F.when(u.contains(base), 1).otherwise(0)

    usable = F.filter(arr, lambda u: u.isNotNull() & U.is_academic(u) & ~F.lower(u).rlike(r"^(mailto|tel):|twitter|facebook|linkedin|instagram"))
    scored = F.transform(usable, lambda u, i: F.struct(score(u).alias("score"), (-i).alias("ord"), u.alias("url")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    return people.select("obs_id", best["url"].alias("best_site"), best["score"].cast("bigint").alias("score"))


def candidate_union(*cands: DataFrame, gate: int = 5, by: str = "obs_id") -> DataFrame:
    """Union of candidate sources; the last source only counts for people with fewer than ``gate`` others."""
    *first, last = cands
    base = first[0]
    for df in first[1:]:
        base = base.unionByName(df)
    full = base.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= gate).select(by)
    return base.unionByName(last.join(full, by, "left_anti"))
