"""Link tables: classes, accessibility, quality and replacement candidates among people.

The three link fields of a person live in one row, so classes, scores and splits are computed on an array of three
structs without any shuffle. ``link_table`` turns the array into long rows keyed by (obs_id, field) where needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions import urls as U
from acadspark.functions.steps import once

FIELDS = ("profile_url", "personal_website", "lab_website")
# fixed values: bonus per link type (hundredths) of the weighted quality score
TYPE_BONUS = (("google_scholar", 20), ("lab_website", 15), ("university_profile", 10), ("academic_profile", 10), ("personal_website", 5))


def categorize_url(df: DataFrame, col: str, type_out: str = "link_type", pct_out: str = "pct", match: str = "suffix") -> DataFrame:
    """Add the class of a URL and its confidence in hundredths."""
    url = F.col(col)
    staged = df.withColumns({"_host": U.bare_host(url), "_path": U.path(F.lower(url))})
    classed = staged.withColumn("_class", U.link_class(url, F.col("_host"), F.col("_path"), match))
    return once(classed.withColumns({type_out: F.col("_class.link_type"), pct_out: F.col("_class.pct")}).drop("_host", "_path", "_class"), type_out, pct_out)


def attach_links(people: DataFrame, accessible: Column | None = None, match: str = "suffix") -> DataFrame:
    """Add ``links``: one struct (field, url, link_type, pct, is_accessible) per non-empty link field."""
    if accessible is None:
        accessible = F.coalesce(F.col("http_status") == 200, F.lit(False)) if "http_status" in people.columns else F.lit(False)
    parts, classes = {}, {}
    for f in FIELDS:
        parts[f"_h_{f}"] = U.bare_host(F.col(f))
        parts[f"_p_{f}"] = U.path(F.lower(f))
        classes[f"_c_{f}"] = U.link_class(F.col(f), F.col(f"_h_{f}"), F.col(f"_p_{f}"), match)
    df = people.withColumns(parts).withColumns(classes)
    structs = [
        F.when(F.coalesce(F.col(f), F.lit("")) != "",
               F.struct(F.lit(f).alias("field"), F.col(f).alias("url"), F.col(f"_c_{f}.link_type").alias("link_type"),
                        F.col(f"_c_{f}.pct").alias("pct"), accessible.alias("is_accessible")))
        for f in FIELDS
    ]
    return once(df.withColumn("links", F.array_compact(F.array(*structs))).drop(*parts, *classes), "links")


def link_table(people: DataFrame, *keep: str) -> DataFrame:
    """Long link rows; ``keep`` names the person columns carried along."""
    return people.select("obs_id", *keep, F.inline("links"))


def link_quality(people: DataFrame) -> DataFrame:
    """Add ``link_quality_score``: mean confidence of the present links, else 0."""
    total = F.aggregate("links", F.lit(0), lambda a, x: a + x["pct"])
    return people.withColumn(
        "link_quality_score",
        F.when(F.size("links") > 0, total.cast("double") / (F.size("links") * 100).cast("double")).otherwise(F.lit(0.0)))


def _points(x: Column, with_type_bonus: bool = True) -> Column:
    score = x["pct"] + F.when(x["is_accessible"], 10).otherwise(0)
    bonus = F.lit(0)
    for t, b in TYPE_BONUS:
        bonus = F.when(x["link_type"] == t, b).otherwise(bonus)
    return F.least(score + bonus - F.when(x["link_type"] == "social_media", 30).otherwise(0), F.lit(100))


def link_quality_weighted(people: DataFrame) -> DataFrame:
    """Add ``weighted_quality``: capped points per link, averaged over the three link fields."""
    total = F.aggregate("links", F.lit(0), lambda a, x: a + _points(x))
    return people.withColumn("weighted_quality", total.cast("double") / F.lit(100.0 * len(FIELDS)))


def quality_band(col: Column) -> Column:
    return F.when(col >= 0.8, "high_quality").when(col >= 0.5, "medium_quality").otherwise("low_quality")


def secondary_candidates(people: DataFrame, good_conf: float = 0.7) -> DataFrame:
    """Add the replacement flags: social links make a candidate, of high priority without any good link."""
    social = F.exists("links", lambda x: x["link_type"] == "social_media")
    good = F.exists("links", lambda x: x["link_type"].isin(*K.GOOD_LINK_TYPES) & (x["pct"] >= round(good_conf * 100)))
    reasons = F.transform(F.filter("links", lambda x: x["link_type"] == "social_media"),
                          lambda x: F.concat(x["field"], F.lit(": social_media")))
    return people.withColumns({"needs_replacement": social, "has_good_links": good}).withColumns({
        "replacement_reasons": reasons,
        "priority": F.when(~F.col("needs_replacement"), F.lit(None)).when(F.col("has_good_links"), "medium").otherwise("high"),
    })


def split_good_bad(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complementary split: (replacement candidates, the rest)."""
    flagged = secondary_candidates(people)
    return flagged.filter("needs_replacement"), flagged.filter("NOT needs_replacement")


def latest_fetch(fetches: DataFrame) -> DataFrame:
    """Latest outcome per URL; an aggregate, so that a URL fetched very often is reduced before the shuffle."""
    return fetches.groupBy("url").agg(
        F.max_by(F.struct("http_status", "final_url"), F.struct("fetched_at", "obs_id", "field")).alias("f")
    ).select("url", "f.http_status", "f.final_url")


def link_accessibility(links: DataFrame, fetches: DataFrame) -> DataFrame:
    """Attach the latest fetch of each link: status 200 means accessible, a redirect replaces the URL."""
    latest = latest_fetch(fetches)
    got = links.drop("is_accessible").join(latest, "url", "left")
    moved = F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url"))
    return got.withColumns({
        "is_accessible": F.coalesce(F.col("http_status") == 200, F.lit(False)),
        "original_url": F.when(moved, F.col("url")),
        "resolved_url": F.when(moved, F.col("final_url")).otherwise(F.col("url")),
    }).drop("final_url")


def _report(counts: DataFrame) -> DataFrame:
    """Add the derived recommendations to (section, item, n) counts.

    The counts are a few dozen rows, one per known item. They are folded into one row, from which counts and
    recommendations are emitted together, so the scan below runs once. A ``linked`` count tells how many people have
    links; the others are of low quality.
    """
    def n(section, item):
        return F.coalesce(F.sum(F.when((F.col("section") == section) & (F.col("item") == item), F.col("n"))), F.lit(0))

    one = counts.agg(
        F.collect_list(F.struct("section", "item", "n")).alias("rows"),
        n("total", "people").alias("people"), n("stats", "valid_links").alias("valid"), n("stats", "broken_links").alias("broken"),
        n("type", "social_media").alias("social"), n("type", "unknown").alias("unknown"), n("type", "invalid").alias("invalid"),
        n("quality", "low_quality").alias("low_seen"), F.sum(F.when(F.col("section") == "linked", F.col("n"))).alias("linked"))
    one = one.withColumn("low", F.col("low_seen") + F.col("people") - F.coalesce("linked", "people"))

    def row(test, section, item, value):
        return F.when(test, F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.alias("n")))

    poor = F.col("social") + F.col("unknown") + F.col("invalid")
    # fixed values: thresholds of the recommendations
    notes = F.array_compact(F.array(
        row(F.col("low") > 0, "quality", "low_quality", F.col("low")),
        row(F.col("broken") * 5 > F.greatest("valid", F.lit(1)), "recommendation", "high_broken_rate", F.col("broken")),
        row(F.col("social") > 0, "recommendation", "social_links", F.col("social")),
        row(F.col("unknown") > 0, "recommendation", "unknown_links", F.col("unknown")),
        row(F.col("low") * 10 > F.col("people") * 3, "recommendation", "low_quality", F.col("low")),
        row(poor > 0, "recommendation", "replacement_candidates", poor),
    ))
    plain = F.filter("rows", lambda r: (r["section"] != "linked") & (r["item"] != "low_quality"))
    return one.select(F.inline(F.concat(plain, notes)))


def _count_items(df: DataFrame, items: Column) -> DataFrame:
    return df.select(F.inline(items)).groupBy("section", "item").agg(F.count("*").alias("n"))


def _item(section, item) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit(item) if isinstance(item, str) else item).alias("item"))


def link_report(people: DataFrame) -> DataFrame:
    """Counts by link type, state and quality band, with recommendations, as (section, item, n).

    One pass: every person emits its count items, which are combined before the only (tiny) shuffle.
    """
    scored = link_quality(people)
    per_link = F.flatten(F.transform("links", lambda x: F.array_compact(F.array(
        _item("type", x["link_type"]),
        F.when(x["link_type"] != "invalid", _item("stats", "valid_links")),
        F.when(x["is_accessible"], _item("stats", "accessible_links")).otherwise(_item("stats", "broken_links")),
    ))))
    own = F.array(_item("total", "people"), _item("quality", quality_band(F.col("link_quality_score"))))
    return _report(_count_items(scored, F.concat(own, per_link)))


def validated_people(links: DataFrame) -> DataFrame:
    """Per person: number of links, of accessible and of redirected ones, mean confidence."""
    return links.groupBy("obs_id").agg(
        F.count("*").alias("n_links"), F.count_if("is_accessible").alias("n_accessible"),
        F.count_if(F.col("original_url").isNotNull()).alias("n_redirected"),
        F.round(F.sum("pct").cast("double") / (F.count("*") * 100).cast("double"), 6).alias("link_quality_score"))


def validated_report(links: DataFrame, n_people: DataFrame) -> DataFrame:
    """Link report of the validated long table; ``n_people`` is a one-row table with ``people``.

    A person has at most one link per field, so the links of a person fit one short array.
    """
    per = links.groupBy("obs_id").agg(F.collect_list(F.struct("link_type", "pct", "is_accessible", F.col("original_url").isNotNull().alias("moved"))).alias("links"))
    total = F.aggregate("links", F.lit(0), lambda a, x: a + x["pct"])
    score = total.cast("double") / (F.size("links") * 100).cast("double")
    per_link = F.flatten(F.transform("links", lambda x: F.array_compact(F.array(
        _item("type", x["link_type"]), F.when(x["link_type"] != "invalid", _item("stats", "valid_links")),
        F.when(x["is_accessible"], _item("stats", "accessible_links")).otherwise(_item("stats", "broken_links")),
        F.when(x["moved"], _item("stats", "redirected_links"))))))
    counts = _count_items(per.withColumn("score", score), F.concat(F.array(_item("linked", "people"), _item("quality", quality_band(F.col("score")))), per_link))
    return _report(counts.unionByName(n_people.select(F.lit("total").alias("section"), F.lit("people").alias("item"), F.col("people").alias("n"))))


def lab_link(links: Column) -> Column:
    """Lab link of the highest confidence, the earlier field on ties."""
    labs = F.filter(links, lambda x: x["link_type"] == "lab_website")
    return F.aggregate(labs, F.get(labs, F.lit(0)), lambda a, x: F.when(x["pct"] > a["pct"], x).otherwise(a))


def best_lab_link(people: DataFrame) -> DataFrame:
    """Lab link of the highest confidence per person, the earlier field on ties."""
    return people.select("obs_id", lab_link(F.col("links")).alias("b")).filter("b IS NOT NULL").select("obs_id", F.col("b.url").alias("lab_url"), F.col("b.pct").alias("pct"))


def link_groups(people: DataFrame) -> DataFrame:
    """Per person: number of social, academic and lab links."""
    def n(*types):
        return F.size(F.filter("links", lambda x: x["link_type"].isin(*types)))

    return people.withColumns({
        "n_social": n("social_media"), "n_academic": n("google_scholar", "academic_profile", "university_profile"), "n_lab": n("lab_website"),
    })


# fixed values: page category and expected richness (hundredths) by URL text, first rule wins
RICHNESS_RULES = (
    (r"scholar\.google", "google_scholar", 90), (r"\.edu/|/~|faculty|people", "university_profile", 70),
    (r"lab|research|group|center", "lab_website", 80), (r"researchgate|academia\.edu|orcid", "academic_platform", 60),
)


def link_richness(df: DataFrame, col: str) -> DataFrame:
    """Five-way category of a URL and the richness to expect from its page."""
    u = F.lower(F.col(col))
    cat, rich = F.lit("personal_website"), F.lit(50)
    for pat, c, r in reversed(RICHNESS_RULES):
        cat, rich = F.when(u.rlike(pat), c).otherwise(cat), F.when(u.rlike(pat), r).otherwise(rich)
    return df.withColumns({"category": cat, "richness": rich / F.lit(100.0)})
