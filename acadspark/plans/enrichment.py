"""Page enrichment, profile analysis and gap filling."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions import scores as Z
from acadspark.functions import text as X
from acadspark.functions import urls as U
from acadspark.functions.steps import once
from acadspark.operators import listings as H
from acadspark.operators import pages as G
from acadspark.operators import predicates as P
from acadspark.operators import ranking as R


def page_records(pages: DataFrame) -> DataFrame:
    """One record per page: title, description, last update, text, areas and scholar metrics, in one pass."""
    b = G.with_body(pages)
    c = F.col("body")
    cited = F.nullif(F.regexp_extract(c, r"Cited by (\d+)", 1), F.lit("")).cast("bigint")
    h = F.nullif(F.regexp_extract(c, r"(?is)<td[^>]*>[^<]*h-index[^<]*</td>\s*<td[^>]*>\s*(\d+)\s*</td>", 1), F.lit("")).cast("bigint")
    rec = once(b.select(
        *[x for x in b.columns if x != "body"],
        F.nullif(F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>([^<]+)</title>", 1)), F.lit("")).alias("title"),
        F.nullif(F.trim(F.regexp_extract(c, r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']""", 1)), F.lit("")).alias("description"),
        cited.alias("citation_count"), h.alias("h_index"), G.inner_text(c).alias("text"),
    ), "title", "description", "citation_count", "h_index", "text")
    return rec.withColumn("areas", X.list_containing(F.col("text"), K.RESEARCH_AREAS))


def lab_page_record(pages: DataFrame) -> DataFrame:
    """Lab record of a page: name, type, areas, labelled fields, contact and location."""
    return lab_record(page_records(pages))


def lab_record(rec: DataFrame, *keep: str) -> DataFrame:
    """``lab_page_record`` from title, text and areas that are read already."""
    t = F.col("text")
    lab_word = "lab|laboratory|center|institute"
    name = F.when(F.lower(F.coalesce("title", F.lit(""))).rlike(lab_word), F.col("title"))
    return rec.select(
        "page_id", *keep, F.coalesce(name, X.first_field(t, X.LAB_NAME_PATTERNS, 5)).alias("lab_name"), X.lab_type(t).alias("lab_type"), "areas",
        X.lab_fields(t).alias("fields"), X.preferred(X.emails(t), K.LAB_CONTACT_WORDS).alias("contact_email"),
        X.first_field(t, X.LOCATION_PATTERNS, 3).alias("location"), F.length("text").cast("bigint").alias("page_size"))


def lab_profiles(docs: DataFrame) -> DataFrame:
    """Lab profile of each document text: size, themes, capabilities, output level and richness as flat columns."""
    t = F.col("text")
    fields = X.lab_fields(t)
    names = ("members", "projects", "equipment", "description")
    f = docs.select("doc_id", *[fields[c].alias(c) for c in names], X.list_containing(t, K.RESEARCH_AREAS).alias("interests"), X.project_fields(t)["funding_agency"].alias("agency"))
    f = once(f, *names, "interests", "agency")  # the profile uses most of them several times
    funding = F.filter(F.array("agency"), lambda x: x != "")
    p = Z.lab_profile(F.col("members"), F.col("projects"), F.col("interests"), F.col("equipment"), funding, F.lit(0), F.lit(""), F.coalesce("description", F.lit("")))
    g = f.select("doc_id", p.alias("p"))
    return g.select("doc_id", "p.size_class", "p.has_hierarchy", F.array_join("p.themes", "|").alias("themes"), "p.interdisciplinary", "p.funding_diversity",
                    F.array_join("p.capabilities", "|").alias("capabilities"), "p.productivity", "p.richness", "p.presentation")


def enrich_pages(pages: DataFrame, people: DataFrame, keep_conf: float = 0.2, detail_conf: float = 0.7) -> DataFrame:
    """Extract, score and gate fetched pages.

    ``pages`` has page_id, url, html and link_type; ``people`` has page_id, name, university and research_interests and is
    joined after the extraction, so that only extracted fields are shuffled. Scholar
    metrics count for scholar pages only, labelled lab fields for lab pages only. Confidence is the mean of content
    quality and academic relevance.
    """
    rec = page_records(pages.filter(~F.col("link_type").isin("social_media", "invalid")))
    scholar, lab = F.col("link_type") == "google_scholar", F.col("link_type") == "lab_website"
    f = rec.withColumns({
        "citation_count": F.when(scholar, F.col("citation_count")), "h_index": F.when(scholar, F.col("h_index")),
        "projects": F.when(lab, X.all_fields(F.col("text"), X.PROJECT_PATTERNS, 10)).otherwise(F.array().cast("array<string>")),
        "members": F.when(lab, X.all_fields(F.col("text"), X.MEMBER_PATTERNS, 0)).otherwise(F.array().cast("array<string>")),
        "affiliations": F.array(F.coalesce("description", F.lit(""))),
    })
    quality = Z.content_points({"title": F.col("title"), "description": F.col("description"), "text_len": F.length("text"), "interests": F.size("areas"),
                                "citation_count": F.col("citation_count"), "h_index": F.col("h_index"), "members": F.size("members"), "projects": F.size("projects")})
    relevance = Z.relevance_points(F.col("name"), F.col("title"), F.col("research_interests"), F.col("areas"), F.col("university"), F.col("affiliations"), F.col("link_type"))
    f = f.withColumn("quality_points", quality).drop("text", "members")
    f = once(f, "citation_count", "h_index", "projects", "affiliations", "areas", "quality_points").join(people, "page_id")
    s = once(f.withColumn("relevance_points", relevance), "relevance_points")
    s = s.withColumn("confidence", (F.col("quality_points") + F.col("relevance_points")) / F.lit(200.0))
    out = s.filter(F.col("confidence") > keep_conf).withColumn("detailed", F.col("confidence") > detail_conf)
    return out.select("page_id", "link_type", "title", "citation_count", "h_index", F.size("areas").cast("bigint").alias("n_interests"), F.size("projects").cast("bigint").alias("n_projects"),
                      (F.col("quality_points") / F.lit(100.0)).alias("content_quality"), (F.col("relevance_points") / F.lit(100.0)).alias("academic_relevance"), "confidence", "detailed")


def _scholar_analysis(m: DataFrame, *keep: str) -> DataFrame:
    p = Z.impact_profile(F.col("citation_count"), F.col("h_index"), F.col("interests"), F.size("publications"), F.size("co_authors"), F.col("affiliation").isNotNull(), F.lit(None).cast("string"))
    return m.select("page_id", "citation_count", "h_index", "i10_index", p.alias("p"), *keep).select(
        "page_id", "citation_count", "h_index", "i10_index", "p.impact_level", "p.h_index_note", "p.collaboration_level", "p.completeness", "p.recency", "p.standing", *keep)


def _lab_analysis(r: DataFrame, *keep: str) -> DataFrame:
    p = Z.lab_profile(F.col("fields.members"), F.col("fields.projects"), F.col("areas"), F.col("fields.equipment"), F.array().cast("array<string>"), F.lit(0),
                      F.coalesce("lab_name", F.lit("")), F.coalesce("fields.description", F.lit("")))
    return r.select("page_id", *keep, "lab_name", "lab_type", p.alias("p")).select(
        "page_id", *keep, "lab_name", "lab_type", "p.size_class", "p.has_hierarchy", F.array_join("p.themes", "|").alias("themes"), "p.interdisciplinary", "p.richness", "p.presentation")


def analyze_profiles(pages: DataFrame, kind: str) -> DataFrame:
    """Analysis of profile pages: ``scholar`` (impact and standing), ``lab`` (size, themes, output) or ``comprehensive``, both
    from one reading of a page."""
    if kind == "scholar":
        return _scholar_analysis(G.scholar_metrics(pages))
    if kind == "lab":
        return _lab_analysis(lab_page_record(pages))
    if kind == "comprehensive":
        b = G.with_body(pages)
        title = F.nullif(F.trim(F.regexp_extract("body", r"(?is)<title[^>]*>([^<]+)</title>", 1)), F.lit(""))
        read = once(b.select("page_id", F.struct(*G.scholar_columns("body")).alias("m"), title.alias("title"), G.inner_text(F.col("body")).alias("text")), "m", "title", "text")
        scholar = _scholar_analysis(read.select("page_id", "m.*", "title", "text"), "title", "text")
        found = [c for c in scholar.columns if c not in ("page_id", "title", "text")]
        return _lab_analysis(lab_record(scholar.withColumn("areas", X.list_containing(F.col("text"), K.RESEARCH_AREAS)), *found), *found)
    raise ValueError(f"unknown kind {kind!r}")


def profile_fields(pages: DataFrame) -> DataFrame:
    """Phone, first links by type, interests and biography of profile pages (page_id, url, html), in one pass over the page."""
    b = G.with_body(pages)
    links = F.filter(F.transform(G.anchors(F.col("body")), lambda a: F.struct(U.resolve(a["href"], F.col("url")).alias("full"), U.profile_link_class(a["href"], a["text"]).alias("kind"))), lambda x: x["full"].isNotNull())
    read = once(b.select("page_id", F.get(X.phones(G.inner_text(G.without_social(F.col("body")))), F.lit(0)).alias("phone"), links.alias("links"),
                         G.interest_items(F.col("body")).alias("interests"), G.biography(F.col("body")).alias("biography")), "phone", "links", "interests", "biography")
    first = lambda kind: F.get(F.filter("links", lambda x: x["kind"] == kind), F.lit(0))["full"].alias(kind)
    return read.select("page_id", "phone", *[first(k) for k in ("personal_website", "google_scholar", "lab_website")], "interests", "biography")


def enhance_sparse(people: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill empty phone, interests and links of sparse people from their profile page, and add google_scholar and biography.

    ``pages`` is keyed by the person's ``obs_id``. Pages of others are left out before they are parsed, by a semi join: a key filter
    of bounded size lets all of them pass once there are some millions of sparse people. Spark joins below the columns of ``pages``
    that are made from others; stored bodies are shuffled, once, and the later join needs no further shuffle of what is found.
    """
    flagged = P.sparse_records(people)
    wanted = flagged.filter("needs_enrichment").select(F.col("obs_id").cast(pages.schema["page_id"].dataType).alias("page_id"))
    found = profile_fields(pages.join(wanted, "page_id", "left_semi"))
    got = found.select(F.col("page_id").alias("obs_id"), F.col("phone").alias("_phone"), F.col("personal_website").alias("_site"), F.col("google_scholar").alias("_scholar"),
                       F.col("lab_website").alias("_lab"), F.when(F.size("interests") > 0, F.array_join("interests", "; ")).alias("_interests"), F.col("biography").alias("_bio"))
    j = flagged.join(got, "obs_id", "left")
    sparse = F.col("needs_enrichment")

    def fill(have, new):
        return F.coalesce(F.nullif(have, F.lit("")), F.when(sparse, F.col(new)))

    out = j.withColumns({
        "phone": fill("phone", "_phone"), "personal_website": fill("personal_website", "_site"), "lab_website": fill("lab_website", "_lab"), "research_interests": fill("research_interests", "_interests"),
        "google_scholar": F.when(sparse, F.col("_scholar")), "biography": F.when(sparse, F.col("_bio")),
        "enriched": sparse & F.coalesce("_phone", "_site", "_scholar", "_lab").isNotNull(),
    })
    return out.drop("_phone", "_site", "_scholar", "_lab", "_interests", "_bio")


def discover_labs(pages: DataFrame, model: PipelineModel | None = None, hits: DataFrame | None = None, min_conf: float = 0.7) -> DataFrame:
    """Lab of each page by the first step that finds one: link heuristics, text classifier, search hits (page_id, url, confidence)."""
    best = R.lab_links_top3(G.lab_links(G.page_links(pages)), 1).select("page_id", F.col("full_url").alias("_u1"), (F.col("points") / F.lit(100.0)).alias("_c1"))
    out = pages.select("page_id").join(best, "page_id", "left")
    if model is not None:
        from acadspark.operators.learning import scan_blocks

        # only pages that the first step left without a lab are classified
        rest = pages.join(best, "page_id", "left_anti")
        named = scan_blocks(model, G.block_position(rest), min_conf).groupBy("page_id").agg(F.max_by(F.struct("text", "confidence"), F.struct("confidence", -F.col("block"))).alias("b"))
        out = out.join(named.select("page_id", F.col("b.text").alias("_n2"), F.col("b.confidence").alias("_c2")), "page_id", "left")
    else:
        out = out.withColumns({"_n2": F.lit(None).cast("string"), "_c2": F.lit(None).cast("double")})
    if hits is not None:
        top = hits.groupBy("page_id").agg(F.max_by(F.struct("url", "confidence"), F.struct("confidence", "url")).alias("h"))
        out = out.join(top.select("page_id", F.col("h.url").alias("_u3"), F.col("h.confidence").alias("_c3")), "page_id", "left")
    else:
        out = out.withColumns({"_u3": F.lit(None).cast("string"), "_c3": F.lit(None).cast("double")})
    method = F.when(F.col("_u1").isNotNull(), "link_heuristics").when(F.col("_n2").isNotNull(), "classification").when(F.col("_u3").isNotNull(), "external_search")
    return out.select("page_id", method.alias("method"), F.when(F.col("_n2").isNull() | F.col("_u1").isNotNull(), F.coalesce("_u1", "_u3")).alias("lab_url"), "_n2", F.coalesce("_c1", "_c2", "_c3").alias("confidence")).withColumnRenamed("_n2", "lab_name")


def extract_directory_chain(directories: DataFrame, profiles: DataFrame) -> DataFrame:
    """Directory pages to people, joined by URL to their profile pages and the details found there."""
    # profiles are parsed where they are read; only the extracted fields are shuffled for the join, never the pages
    people = H.directory_people(directories, ("page_id", "university", "department"))
    details = H.profile_details(profiles, ("url",)).withColumnRenamed("url", "profile_url")
    d = details.select("profile_url", "bio", F.array_join("interests", "|").alias("interests"), "office", "phone", F.col("email").alias("profile_email"), "lab_name")
    return people.select("university", "department", "name", "title", "email", "profile_url").join(d, "profile_url", "left")
