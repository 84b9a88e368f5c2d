"""Row filters and boolean columns over people, links and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions import urls as U
from acadspark.functions.text import contains_any, count_containing


def filter_valid_links(df: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Records whose mean link score reaches the minimum."""
    return df.filter(F.coalesce(F.col("link_quality_score"), F.lit(0.0)) >= min_confidence)


def sparse_records(df: DataFrame, min_signals: int = 2) -> DataFrame:
    """Add ``signals`` and ``needs_enrichment``: fewer than ``min_signals`` filled-in fields."""
    def filled(name: str, more_than: int = 0) -> Column:
        if name not in df.columns:
            return F.lit(0)
        return (F.length(F.coalesce(F.col(name), F.lit(""))) > more_than).cast("int")

    signals = (filled("research_interests") + filled("biography", 50) + filled("personal_website") + filled("phone")
               + filled("office"))
    return df.withColumn("signals", signals).withColumn("needs_enrichment", F.col("signals") < min_signals)


def academic_site(df: DataFrame, col: str, out: str = "is_academic") -> DataFrame:
    return df.withColumn(out, U.is_academic(F.col(col)))


def personal_site(df: DataFrame, col: str, name_col: str = "name", out: str = "is_personal") -> DataFrame:
    return df.withColumn(out, U.is_personal(F.col(col), F.col(name_col)))


def person_name_like(df: DataFrame, col: str, out: str = "is_name") -> DataFrame:
    """Two to five capitalised words of at least two characters, no digits, at most 60 characters."""
    text = F.coalesce(F.col(col), F.lit(""))
    words = F.split(F.trim(text), r"\s+")
    shaped = F.forall(words, lambda w: w.rlike(r"^\p{Lu}") & ~w.rlike(r"\p{Nd}") & (F.length(w) >= 2))
    ok = (text != "") & (F.length(text) <= 60) & F.size(words).between(2, 5) & shaped
    return df.withColumn(out, ok & ~F.lower(text).isin(*K.PERSON_STOP_PHRASES))


def title_like(df: DataFrame, col: str, out: str = "is_title") -> DataFrame:
    text = F.coalesce(F.col(col), F.lit(""))
    return df.withColumn(out, (text != "") & (F.length(text) <= 100) & contains_any(F.lower(text), K.TITLE_WORDS))


def bio_like(df: DataFrame, col: str, out: str = "is_bio") -> DataFrame:
    """At least two biography words."""
    return df.withColumn(out, count_containing(F.lower(F.coalesce(F.col(col), F.lit(""))), K.BIO_WORDS) >= 2)


def department_ok(col: Column) -> Column:
    text = F.coalesce(col, F.lit(""))
    low = F.lower(text)
    return (F.length(text).between(3, 150) & ~contains_any(low, K.DEPARTMENT_SKIP)
            & ((F.length(text) >= 20) | contains_any(low, K.DEPARTMENT_WORDS)))


def valid_department(df: DataFrame, col: str, out: str = "is_department") -> DataFrame:
    return df.withColumn(out, department_ok(F.col(col)))


def program_link(df: DataFrame, href: str = "href", text: str = "text", out: str = "is_program") -> DataFrame:
    h, t = F.lower(F.col(href)), F.lower(F.col(text))
    return df.withColumn(out, (h != "") & (t != "") & ~contains_any(h, K.PROGRAM_LINK_SKIP) & contains_any(t, K.PROGRAM_LINK_WORDS))


def not_lab_text(df: DataFrame, col: str, out: str = "not_lab") -> DataFrame:
    """Navigation or contact text, or less than half letters."""
    text = F.col(col)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return df.withColumn(out, contains_any(F.lower(text), K.NOT_LAB_WORDS) | (2 * letters < F.length(text)))


def excluded_link(df: DataFrame, col: str = "href", out: str = "excluded") -> DataFrame:
    return df.withColumn(out, F.lower(F.col(col)).rlike(K.EXCLUDED_LINK))


def listing_name_ok(col: Column) -> Column:
    words = F.split(F.trim(col), r"\s+")
    return (F.size(words).between(2, 6) & ~F.exists(words, lambda w: F.lower(w).isin(*K.LISTING_BLOCK_WORDS))
            & F.exists(words, lambda w: w.rlike(r"^\p{L}{3,}$")))


def listing_name_valid(df: DataFrame, col: str, out: str = "is_listed_name") -> DataFrame:
    return df.withColumn(out, listing_name_ok(F.col(col)))


def enrichable_links(links: DataFrame, min_conf: float = 0.2, detail_conf: float = 0.7) -> DataFrame:
    """Accessible links that are neither social nor invalid, with a flag for detailed extraction."""
    kept = F.col("is_accessible") & ~F.col("link_type").isin("social_media", "invalid") & (F.col("pct") > round(min_conf * 100))
    return links.filter(kept).withColumn("wants_detail", F.col("pct") > round(detail_conf * 100))


def search_institutions(df: DataFrame, query: str, state: str | None = None, limit: int = 20) -> DataFrame:
    """Institutions whose name contains the query, by name, optionally of one state."""
    if query.strip():
        df = df.filter(F.lower("name").contains(query.lower()))
    if state:
        df = df.filter(F.lower("state_code") == state.lower())
    return df.orderBy("name", "id").limit(limit)


def search_departments(df: DataFrame, query: str, category: str | None = None, limit: int = 10) -> DataFrame:
    """Departments whose name or one of its variations contains the query."""
    needle = query.lower()
    df = df.filter(F.lower("name").contains(needle) | F.exists("variations", lambda v: F.lower(v).contains(needle)))
    if category:
        df = df.filter(F.col("category") == category)
    return df.orderBy("name", "id").limit(limit)


def search_people(df: DataFrame, q: str, university: str | None = None, department: str | None = None, limit: int = 10) -> DataFrame:
    """People whose name or interests contain the text."""
    hit = F.lower(F.concat_ws(" ", "name", "research_interests")).contains(q.lower())
    if university:
        hit = hit & (F.lower("university") == university.lower())
    if department:
        hit = hit & (F.lower("department") == department.lower())
    return df.filter(hit).orderBy("name", "obs_id").limit(limit)


def people_preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.select("obs_id", "name", "title", "email", "personal_website").orderBy("obs_id").limit(n)


def faculty_like_page(df: DataFrame, text_col: str = "text", out: str = "faculty_like") -> DataFrame:
    return df.withColumn(out, contains_any(F.lower(F.col(text_col)), K.FACULTY_PAGE_WORDS))
