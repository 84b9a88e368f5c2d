"""Integer scores (hundredths) as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions.text import contains_any, count_containing


def _first_rule(col: Column, rules) -> Column:
    out = F.lit(0)
    for pattern, points in reversed(rules):
        out = F.when(col.rlike(pattern), points).otherwise(out)
    return out


def lab_link_points(url: Column, text: Column) -> Column:
    """Score of a link as a lab link: domain, key words, path, fields, phrases, less length and contact words."""
    u, t = F.lower(url), F.lower(text)
    domain = (
        F.when(u.contains(".edu"), 50).when(u.contains(".org"), 30).when(u.contains(".gov"), 20)
        .when(u.rlike(r"\.ac\.(uk|jp|kr|au)"), 45).otherwise(0)
    )
    words = F.least(F.regexp_count(t, F.lit(K.LAB_WORD)) * 30, F.lit(60))
    fields = reduce(lambda a, b: a + b, [(t.contains(w) | u.contains(w)).cast("int") for w in K.LAB_FIELD_WORDS])
    score = (
        domain + words + _first_rule(u, K.LAB_URL_SCORES) + F.least(fields * 10, F.lit(20))
        - F.when(F.length(text) > 100, 15).otherwise(0) + _first_rule(t, K.LAB_PHRASE_SCORES)
        - 10 * count_containing(t, K.LAB_NEGATIVE_WORDS)
    )
    return F.greatest(score, F.lit(0))


def context_link_points(url: Column, text: Column, context: Column) -> Column:
    """Lab link score with the boost of the text around the link."""
    c = F.lower(context)
    boost = (
        F.when(c.rlike(r"(directs?|leads?|heads?).+(lab|laboratory|center)"), 30)
        .when(c.rlike(r"(lab|laboratory|center).+(website|site|page)"), 20).otherwise(0)
    )
    return lab_link_points(url, text) + boost


def directory_link_points(name: Column, url: Column, target: str | None = None) -> Column:
    """Score of a department link as a way to its people, between 0 and 200."""
    n, u = F.lower(name), F.lower(url)
    score = (
        30 * count_containing(n, K.DIRECTORY_TERMS) + 20 * count_containing(u, K.DIRECTORY_TERMS)
        + 20 * count_containing(n, K.UNIT_TERMS) + 10 * count_containing(u, K.UNIT_TERMS)
        + F.when(u.rlike(K.DIRECTORY_PATHS), 30).otherwise(0)
        - 20 * count_containing(n, K.NON_ACADEMIC_TERMS) - 10 * count_containing(u, K.NON_ACADEMIC_TERMS)
        + F.when(u.contains(".edu"), 10).otherwise(0) - F.when(F.length(name) > 100, 20).otherwise(0)
        + F.when(contains_any(n, K.DISCIPLINES), 10).otherwise(0)
    )
    if target:
        low = target.lower()
        score = score + F.when(n.contains(low) | u.contains(low), 50).otherwise(0)
        words = low.split()
        if len(words) > 1:
            for w in words:
                if len(w) > 3:
                    score = score + F.when(n.contains(w), 20).otherwise(0)
    usable = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")
    return F.when(usable, F.greatest(F.lit(0), F.least(score, F.lit(200)))).otherwise(0)


def confidence_band(col: Column) -> Column:
    return F.when(col >= 0.8, "high").when(col >= 0.5, "medium").when(col >= 0.2, "low").otherwise("uncertain")


def content_points(f: dict[str, Column]) -> Column:
    """Richness of extracted content. ``f`` names columns: title, description, text_len, citation_count, h_index and
    the list sizes interests, publications, co_authors, members, projects; absent entries count nothing."""
    def size(key, each, cap):
        return F.least(F.coalesce(f[key], F.lit(0)) * each, F.lit(cap)) if key in f else F.lit(0)

    def present(key, pts):
        return F.when(f[key].isNotNull(), pts).otherwise(0) if key in f else F.lit(0)

    def filled(key):
        return F.when(F.coalesce(f[key], F.lit("")) != "", 10).otherwise(0) if key in f else F.lit(0)

    score = (
        filled("title") + filled("description") + size("interests", 5, 30) + size("publications", 3, 20)
        + size("co_authors", 2, 10) + size("members", 2, 10) + size("projects", 3, 15)
        + present("citation_count", 20) + present("h_index", 10)
        + F.when(f["text_len"] > 1000, 10).otherwise(0) + F.when(f["text_len"] > 5000, 10).otherwise(0)
    )
    return F.least(score, F.lit(100))


def relevance_points(name: Column, title: Column, person_interests: Column, interests: Column, university: Column,
                     affiliations: Column, link_type: Column) -> Column:
    """Agreement of extracted content with the person: name 30, interests up to 40, affiliation 20, link type bonus."""
    low = F.lower(F.coalesce(person_interests, F.lit("")))
    shared = F.size(F.filter(interests, lambda i: F.exists(F.split(F.lower(F.trim(i)), r"\s+"), lambda w: low.contains(w))))
    uni = F.lower(F.coalesce(university, F.lit("")))
    score = (
        F.when((F.coalesce(name, F.lit("")) != "") & F.lower(F.coalesce(title, F.lit(""))).contains(F.lower(name)), 30).otherwise(0)
        + F.when(low != "", F.least(shared * 10, F.lit(40))).otherwise(0)
        + F.when((uni != "") & F.exists(affiliations, lambda a: F.lower(a).contains(uni)), 20).otherwise(0)
        + F.when(link_type.isin("google_scholar", "lab_website", "university_profile"), 10)
        .when(link_type == "academic_profile", 5).otherwise(0)
    )
    return F.least(score, F.lit(100))


# fixed values: key words of emerging areas
TREND_WORDS = ("ai", "machine learning", "deep learning", "neural networks", "computational", "data science", "digital", "virtual reality")


def impact_profile(citations: Column, h_index: Column, interests: Column, n_publications: Column, n_coauthors: Column,
                   has_affiliation: Column, last_updated: Column) -> Column:
    """Struct of impact, collaboration, trend and standing notes of a scholar profile."""
    n = F.size(interests)
    points = [(citations.isNotNull()), (h_index.isNotNull()), (n > 0), has_affiliation, (n_publications > 5)]
    return F.struct(
        F.when(citations.isNull(), "unknown").when(citations > 10000, "exceptional").when(citations > 5000, "high")
        .when(citations > 1000, "moderate").otherwise("emerging").alias("impact_level"),
        F.when(h_index > 50, "very_high").when(h_index > 25, "high").when(h_index > 10, "moderate").alias("h_index_note"),
        F.when(n_coauthors > 50, "extensive").when(n_coauthors > 20, "active").when(n_coauthors > 5, "moderate")
        .otherwise("limited").alias("collaboration_level"),
        F.when(n > 5, F.least(n / F.lit(10.0), F.lit(1.0))).otherwise(F.lit(0.0)).alias("interdisciplinary"),
        F.filter(interests, lambda i: contains_any(F.lower(i), TREND_WORDS)).alias("emerging_areas"),
        (reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(False)).cast("int") for p in points]) * 20 / F.lit(100.0)).alias("completeness"),
        F.when(F.coalesce(last_updated, F.lit("")) != "", "recently_updated").when(n_publications > 0, "active_publishing")
        .otherwise("unknown").alias("recency"),
        F.when(h_index > 30, "senior_researcher").when(h_index > 15, "established_researcher")
        .when(citations > 100, "active_researcher").otherwise("emerging_researcher").alias("standing"),
    )


# --- fixed values: lab profile words ---
HIERARCHY_WORDS = ("pi", "principal investigator", "director", "postdoc", "graduate student")
THEME_WORDS = (
    ("cognitive", ("cognitive", "cognition", "memory", "attention")),
    ("neuroscience", ("neural", "brain", "neuroscience", "neuroimaging")),
    ("computational", ("computational", "algorithm", "modeling", "simulation")),
    ("behavioral", ("behavior", "behavioral", "psychology", "social")),
    ("clinical", ("clinical", "therapy", "treatment", "patient")),
    ("developmental", ("development", "developmental", "children", "aging")),
)
FUNDING_WORDS = (
    ("federal", ("nsf", "nih", "doe", "darpa")), ("private", ("foundation", "company", "industry")),
    ("academic", ("university", "internal", "seed")),
)
CAPABILITY_WORDS = (
    ("neuroimaging", ("mri", "fmri", "pet", "meg", "eeg")), ("computational", ("cluster", "gpu", "supercomputer", "server")),
    ("behavioral", ("eye-tracker", "motion capture", "behavioral")), ("molecular", ("microscope", "sequencer", "spectroscopy")),
    ("engineering", ("3d printer", "fabrication", "electronics")),
)


def named_groups(text: Column, groups) -> Column:
    """Names of the groups with a word in the text."""
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(g)) for g, words in groups]))


def lab_profile(members: Column, projects: Column, interests: Column, equipment: Column, funding: Column,
                n_publications: Column, title: Column, description: Column) -> Column:
    """Struct of size, hierarchy, themes, funding, capabilities, output and presentation of a lab."""
    n = F.size(members)
    themes = named_groups(F.lower(F.array_join(F.concat(projects, interests), " ")), THEME_WORDS)

    def kind(f):
        out = F.lit("unknown")
        for k, words in reversed(FUNDING_WORDS):
            out = F.when(contains_any(F.lower(f), words), k).otherwise(out)
        return out

    kinds = F.transform(funding, kind)
    filled = [F.size(projects) > 0, n > 0, F.size(equipment) > 0, F.size(funding) > 0]
    return F.struct(
        F.when(n > 20, "large").when(n > 10, "medium").when(n > 3, "small").otherwise("minimal").alias("size_class"),
        contains_any(F.lower(F.array_join(members, " ")), HIERARCHY_WORDS).alias("has_hierarchy"),
        themes.alias("themes"), F.least(F.size(themes) / F.lit(5.0), F.lit(1.0)).alias("interdisciplinary"),
        (F.size(F.array_distinct(kinds)) / F.lit(4.0)).alias("funding_diversity"),
        named_groups(F.lower(F.array_join(equipment, " ")), CAPABILITY_WORDS).alias("capabilities"),
        F.when(n_publications > 10, "high").when(n_publications > 3, "moderate").otherwise("low").alias("productivity"),
        (reduce(lambda a, b: a + b, [p.cast("int") for p in filled]) * 25 / F.lit(100.0)).alias("richness"),
        ((F.lit(60) + F.when(F.length(title) > 5, 20).otherwise(0) + F.when(F.length(description) > 20, 20).otherwise(0)) / F.lit(100.0)).alias("presentation"),
    )
