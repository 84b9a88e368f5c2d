"""One-row and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acadspark.functions.steps import side_by_side


def _has(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def target_summary(flagged: DataFrame) -> DataFrame:
    """Replacement candidates by priority and by the searches that apply to them."""
    named = _has("name")
    bio = (F.length(F.coalesce(F.col("biography"), F.lit(""))) > 100) if "biography" in flagged.columns else F.lit(False)
    return flagged.filter("needs_replacement").agg(
        F.count("*").alias("total_candidates"), F.count_if(F.col("priority") == "high").alias("high_priority"),
        F.count_if(F.col("priority") == "medium").alias("medium_priority"),
        F.count_if(named & _has("university")).alias("name_university_searches"),
        F.count_if(named & _has("university") & _has("department")).alias("name_department_searches"),
        F.count_if(named & _has("research_interests")).alias("research_interest_searches"),
        F.count_if(named & bio).alias("biography_searches"))


def _rate(a: Column, b: Column) -> Column:
    """a / max(b, 1), rounded."""
    return F.round(a / F.greatest(b, F.lit(1)).cast("double"), 6)


def batch_report(people: DataFrame) -> DataFrame:
    """One row of a processed batch: social links found and replaced, labs found and enriched, with rates.

    ``people`` has n_social, n_lab, replaced, enriched and ok.
    """
    return people.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("processed"), F.count_if(F.col("n_social") > 0).alias("social_found"),
        F.count_if("replaced").alias("social_replaced"), F.count_if(F.col("n_lab") > 0).alias("labs_found"), F.count_if("enriched").alias("labs_enriched"),
    ).withColumns({
        "success_rate": _rate(F.col("processed"), F.col("total")), "replacement_rate": _rate(F.col("social_replaced"), F.col("social_found")),
        "enrichment_rate": _rate(F.col("labs_enriched"), F.col("labs_found")),
    })


def enrichment_report(rows: DataFrame) -> DataFrame:
    """One row: processed, successful and failed extractions, per type, mean time. ``rows`` has enrichment_type,
    confidence_pct and seconds."""
    ok = F.col("confidence_pct") > 20

    def of(t):
        return F.count_if(ok & (F.col("enrichment_type") == t))

    return rows.agg(
        F.count("*").alias("processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        of("google_scholar").alias("scholar_profiles"), of("links").alias("lab_sites"), of("profile").alias("university_profiles"),
        F.round(F.sum("seconds") / F.greatest(F.count("*"), F.lit(1)).cast("double"), 6).alias("mean_seconds"))


def stage_report(links: DataFrame, replaced: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row over three stages: checked links, replaced links, extracted sites and data points."""
    one = links.agg(F.count_distinct("obs_id").alias("people"), F.count_if("is_accessible").alias("accessible"), F.count_if(~F.col("is_accessible")).alias("broken"))
    two = replaced.agg(F.count_if(F.col("added") > 0).alias("enhanced"), F.coalesce(F.sum("added"), F.lit(0)).alias("links_added"))
    three = extracted.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("scholar", "website", "lab")],
                          F.coalesce(F.sum("points"), F.lit(0)).alias("data_points"))
    return side_by_side(one, two, three)


def data_points(df: DataFrame, cols: tuple[str, ...], lists: tuple[str, ...] = (), out: str = "points") -> DataFrame:
    """Add the number of non-empty leaves: filled columns plus filled entries of list columns."""
    total = F.lit(0)
    for c in cols:
        total = total + F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    for c in lists:
        total = total + F.size(F.filter(F.coalesce(F.col(c), F.array()), lambda x: F.coalesce(x, F.lit("")) != ""))
    return df.withColumn(out, total.cast("bigint"))


def university_stats(people: DataFrame) -> DataFrame:
    """Per university: programs, people, those with e-mail, site and lab, distinct lab sites, three rates in percent."""
    n = F.count("*")

    def pct(c):
        return F.round(F.count_if(c) * 100.0 / n, 6)

    return people.groupBy("university").agg(
        F.count_distinct("department").alias("programs"), n.alias("people"), F.count_if(_has("email")).alias("with_email"),
        F.count_if(_has("personal_website")).alias("with_site"), F.count_if(_has("lab_name")).alias("with_lab"),
        F.count_distinct(F.nullif("lab_website", F.lit(""))).alias("lab_sites"), pct(_has("email")).alias("email_rate"), pct(_has("personal_website")).alias("site_rate"),
        pct(_has("lab_name")).alias("lab_rate"))


def university_stats_join(programs: DataFrame, people: DataFrame, labs: DataFrame) -> DataFrame:
    """The same counts from stored tables: programs own people and lab sites by program id."""
    owner = programs.select("program_id", "university")
    # counted per program first: a large program is one row before the join
    per_people = people.groupBy("program_id").agg(F.count("*").alias("people"), F.count_if(_has("email")).alias("with_email"))
    f = per_people.join(owner, "program_id").groupBy("university").agg(F.sum("people").alias("people"), F.sum("with_email").alias("with_email"))
    s = labs.groupBy("program_id").agg(F.count("*").alias("n")).join(owner, "program_id").groupBy("university").agg(F.sum("n").alias("lab_sites"))
    p = programs.groupBy("university").agg(F.count("*").alias("programs"))
    return p.join(f, "university", "left").join(s, "university", "left").fillna(0, ["people", "with_email", "lab_sites"])


def structure_stats(structures: DataFrame) -> DataFrame:
    """Per discovery method: structures, paths, department paths, last update."""
    return structures.groupBy("method").agg(
        F.count("*").alias("structures"), F.sum("n_paths").alias("paths"), F.sum("n_department_paths").alias("department_paths"), F.max("last_updated").alias("last_update"))


def directory_stats(institutions: DataFrame) -> DataFrame:
    """Per state: name and number of institutions."""
    return institutions.filter(_has("state_code") & _has("state")).groupBy("state_code").agg(F.max("state").alias("state"), F.count("*").alias("institutions"))


def profile_stats(people: DataFrame) -> DataFrame:
    """One row over sparse people with a profile: what their enrichment found."""
    tried = F.col("needs_enrichment") & _has("profile_url")
    return people.agg(
        F.count("*").alias("processed"), F.count_if(tried).alias("enriched"), F.count_if(tried & F.col("found_interests")).alias("interests_found"),
        F.count_if(tried & F.col("found_bio")).alias("biographies"), F.count_if(tried & F.col("found_contact")).alias("contacts"),
        F.coalesce(F.sum(F.when(tried, F.col("n_links"))), F.lit(0)).alias("extra_links"))


def flow_stats(people: DataFrame) -> DataFrame:
    """Per university and department and in total: scraped, processed and enriched people, links, throughput.

    One pass with grouping sets; ``level`` tells the total from the groups.
    """
    u, d = F.col("university"), F.col("department")
    days = F.greatest(F.timestamp_diff("DAY", F.min("scraped_at"), F.max("scraped_at")), F.lit(1))
    return people.groupingSets([[u, d], []], u, d).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("scraped"), F.count_if(F.col("name") != "").alias("processed"),
        F.count_if(F.col("n_links") > 0).alias("enriched"), F.sum("n_links").alias("links"), F.round(F.count("*") / days, 6).alias("people_per_day"))


def department_counts(people: DataFrame, structures: DataFrame) -> DataFrame:
    """People per university and department with the structure type and confidence of its listing."""
    return people.groupBy("university", "department").agg(F.count("*").alias("people")).join(structures, "department", "left")


def ingest_report(obs: DataFrame, resolved: DataFrame, e: dict[str, DataFrame]) -> DataFrame:
    """One row: processed, created and merged records, entities, associations, issues."""
    def n(df, name):
        return df.agg(F.count("*").alias(name))

    seen = obs.agg(F.count_if(_has("name")).alias("processed"), F.count_if(~_has("name")).alias("missing_name"))
    made = resolved.agg(F.count_distinct("entity").alias("created"))
    out = side_by_side(seen, made, n(e["university"], "universities"), n(e["department"], "departments"), n(e["lab"], "labs"),
                       n(e["person_department"], "_a"), n(e["person_lab"], "_b"), n(e["person_enrichment"], "enrichments"))
    return out.withColumns({"merged": F.col("processed") - F.col("created"), "associations": F.col("_a") + F.col("_b")}).drop("_a", "_b")


def job_rollup(log: DataFrame, job: str, ts: str = "ts") -> DataFrame:
    """Per job: items, failures, progress in percent, duration in seconds, status."""
    failed = F.count_if(F.col("status_code") >= 500)
    start, end = F.min(ts), F.max(ts)
    return log.groupBy(job).agg(
        F.count("*").alias("items"), failed.alias("failed"), F.round((F.count("*") - failed) * 100.0 / F.count("*"), 6).alias("progress"),
        F.round(F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6), 3).alias("seconds"),
        F.when(failed == F.count("*"), "failed").when(failed > 0, "partial").otherwise("completed").alias("status"))


def session_counters(people: DataFrame, n_lab_links: Column) -> DataFrame:
    """One row of crawl counters."""
    return people.agg(
        F.count_distinct("university").alias("universities"), F.count_distinct("university", "department").alias("departments"),
        F.count("*").alias("people"), F.sum(n_lab_links).alias("lab_links"), F.count_if(F.col("http_status") == 200).alias("successes"),
        F.count_if(F.coalesce(F.col("http_status") != 200, F.lit(False))).alias("failures"))


def keyword_freq(docs: DataFrame, n: int = 20, min_len: int = 4) -> DataFrame:
    """Most frequent words over all documents: word, n, rank."""
    from acadspark.functions import constants as K

    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(rf"^[a-z]{{{min_len},}}$") & ~w.isin(*K.KEYWORD_STOPWORDS))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(n)


def document_keywords(docs: DataFrame, n: int = 20, min_len: int = 4) -> DataFrame:
    """Most frequent words of every document: doc_id, word, n, rank."""
    from acadspark.functions import constants as K
    from acadspark.operators.ranking import top_per_key

    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(rf"^[a-z]{{{min_len},}}$") & ~w.isin(*K.KEYWORD_STOPWORDS))
    counts = docs.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return top_per_key(counts, ("doc_id",), [F.desc("n"), F.col("word")], n)
