"""Column expressions over URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions.text import alternation, contains_any

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def authority(url: Column) -> Column:
    """Network location including port and user; '' for relative URLs."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def on_hosts(host: Column, hosts, match: str) -> Column:
    """Host test: whole domain labels from the right (``suffix``) or anywhere in the name (``substring``)."""
    if match == "substring":
        return contains_any(host, hosts)
    return host.rlike(rf"(^|\.)({alternation(hosts)})(:\d+)?$")


def bare_host(url: Column) -> Column:
    """Lower-case network location without 'www.'."""
    return F.replace(authority(F.lower(url)), F.lit("www."), F.lit(""))


def _class(kind: str, pct: int) -> Column:
    return F.struct(F.lit(kind).alias("link_type"), F.lit(pct).alias("pct"))


def host_class(host: Column, match: str = "suffix") -> Column:
    """Struct(link_type, pct) of hosts whose class does not depend on the path; null for others."""
    return (
        F.when(on_hosts(host, K.SOCIAL_HOSTS, match), _class("social_media", 90))
        .when(on_hosts(host, (K.SCHOLAR_HOST,), match), _class("google_scholar", 95))
        .when(on_hosts(host, K.PROFILE_HOSTS, match), _class("academic_profile", 90))
        .when(on_hosts(host, K.PUBLICATION_HOSTS, match), _class("publication", 80))
    )


def academic_host(host: Column) -> Column:
    return host.rlike(rf"\.({alternation(K.ACADEMIC_SUFFIXES)})$")


#: Words of a lower-case path that tell the class of a page on an academic host.
PATH_TESTS = {"lab": K.LAB_PATH_WORDS, "field": K.FIELD_PATH_WORDS, "study": ("research", "study"), "people": K.PEOPLE_PATH_WORDS, "personal": K.PERSONAL_PATH_WORDS}


def academic_class(has) -> Column:
    """Struct(link_type, pct) on an academic host; ``has(name)`` tells whether the path has a word of ``PATH_TESTS``."""
    return (
        F.when(has("lab") & has("field"), _class("lab_website", 90))
        .when(has("lab"), _class("lab_website", 85))
        .when(has("field") & has("study"), _class("lab_website", 80))
        .when(has("people"), _class("university_profile", 85))
        .when(has("personal"), _class("personal_website", 90))
        .otherwise(_class("university_profile", 60))
    )


def other_class(host: Column) -> Column:
    """Struct(link_type, pct) on hosts that are neither known nor academic."""
    return F.when(host.rlike(r"\.(com|org|net)$") & (F.length(F.substring_index(host, ".", 1)) <= 15), _class("personal_website", 70)).otherwise(_class("unknown", 30))


def link_class(url: Column, host: Column, p: Column, match: str = "suffix") -> Column:
    """Struct(link_type, pct): class of a URL and its confidence in hundredths, from its host and lower-case path."""
    on_academic = F.when(academic_host(host), academic_class(lambda name: contains_any(p, PATH_TESTS[name])))
    return F.when(url.isNull() | (url == ""), _class("invalid", 0)).otherwise(F.coalesce(host_class(host, match), on_academic, other_class(host)))


def listing_class(url: Column, text: Column, base_url: str) -> Column:
    """Nine-way class of a link in a directory listing."""
    base = base_url.replace("https://", "").replace("http://", "")
    u, t = F.lower(url), F.lower(text)
    own = u.contains(base)
    # fixed values: listing link words
    return (
        F.when(own & u.rlike("faculty|profile|people|staff"), "university_profile")
        .when(u.rlike("lab|research|group|center|institute") & own, "lab_website")
        .when(u.contains("scholar.google"), "google_scholar")
        .when(t.rlike("homepage|website|personal|cv|resume") | (own & u.rlike("~|personal|home")), "personal_website")
        .when(u.rlike(r"researchgate|orcid|academia\.edu|arxiv"), "research_platform")
        .when(u.rlike("facebook|twitter|linkedin|instagram"), "social_media")
        .when(u.rlike(r"\.edu|\.ac\.") & ~own, "external_academic")
        .when(t.rlike("cv|curriculum|publications|papers"), "cv_publications")
        .otherwise("irrelevant")
    )


def profile_link_class(url: Column, text: Column) -> Column:
    """Five-way class of a link on a profile page, or null."""
    u, t = F.lower(url), F.lower(text)
    # fixed values: profile link words
    return (
        F.when(u.contains("scholar.google"), "google_scholar")
        .when(u.rlike(r"researchgate\.net|academia\.edu|orcid\.org"), "research_platform")
        .when(t.rlike("homepage|personal|website|home") & u.rlike(r"\.edu|\.ac\.|\.org|~"), "personal_website")
        .when(t.rlike("lab|laboratory|research group|center"), "lab_website")
        .when(u.rlike(r"twitter\.com|linkedin\.com|facebook\.com"), "social_media")
    )


def resolve(url: Column, base: Column | None = None) -> Column:
    """Absolute URL: http(s) kept, other schemes dropped, relative ones joined to the page URL."""
    u = F.trim(url)
    if base is None:
        relative = F.when(u.startswith("/"), u)
    else:
        origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"([^/])/[^/]*$", "$1/")
        folder = F.when(F.regexp_extract(base, r"^[^:]*://[^/]+(/)", 1) == "", F.concat(origin, F.lit("/"))).otherwise(folder)
        relative = (
            F.when(u.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), u))
            .when(u.startswith("/"), F.concat(origin, u))
            .when(u.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), u))
            .when(u.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), u))
            .otherwise(F.concat(folder, u))
        )
    return (
        F.when(u.isNull() | (u == ""), F.lit(None))
        .when(u.rlike(r"^https?://"), u)
        .when(u.contains(":") & ~u.startswith("/"), F.lit(None))
        .otherwise(relative)
    )


def is_academic(url: Column) -> Column:
    return F.coalesce(contains_any(F.lower(authority(url)), K.ACADEMIC_HOST_PARTS), F.lit(False))


def is_personal(url: Column, name: Column) -> Column:
    """Academic-suffix host with a personal path mark or a name part of more than two letters in the URL."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = authority(low)
    # suffix test as given: '.ac.' can never end a host name
    academic = host.rlike(r"(\.edu|\.ac\.|\.org)$")
    named = F.exists(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda p: (F.length(p) > 2) & low.contains(p))
    return academic & (contains_any(path(low), K.PERSONAL_PATH_MARKS) | named)


def plus_score(tests) -> Column:
    """Sum of points whose test holds."""
    return reduce(lambda a, b: a + b, [F.when(t, pts).otherwise(0) for t, pts in tests])
