"""First, best and top-k rows per key, caps and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from acadspark.functions import scores as Z
from acadspark.functions import urls as U


def first_by_key(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """First row per key in the given order.

    An aggregate instead of a window: rows of a busy key shrink to one per task before they are shuffled.
    """
    best = F.min_by(F.struct(*keep), F.struct(*order)).alias("b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"b.{c}").alias(c) for c in keep])


def lab_links_top3(links: DataFrame, n: int = 3) -> DataFrame:
    """Best ``n`` lab links per page with the page's best score."""
    w = W.partitionBy("page_id").orderBy(F.desc("points"), "full_url")
    ranked = links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    # the best score is that of rank one, found in the few rows left
    return ranked.withColumn("best", F.max("points").over(W.partitionBy("page_id")))


def first_link_by_type(links: DataFrame) -> DataFrame:
    """First personal, scholar and lab link of each page."""
    c = links.withColumns({"full": U.resolve(F.col("href"), F.col("page_url")), "kind": U.profile_link_class(F.col("href"), F.col("text"))})
    c = c.filter("full IS NOT NULL")

    def first(kind):
        return F.min_by(F.col("full"), F.when(F.col("kind") == kind, F.col("pos"))).alias(kind)

    return c.groupBy("page_id").agg(*[first(k) for k in ("personal_website", "google_scholar", "lab_website")])


def rank_departments(df: DataFrame, name: str, url: str, target: str | None = None) -> DataFrame:
    """Add ``points``: directory score, a tenth for staff pages, half more for faculty pages."""
    u = F.lower(F.col(url))
    staff, faculty = u.contains("staff"), u.contains("faculty")
    factor = F.when(staff & ~faculty, 0.1).when(faculty & ~staff, 1.5).otherwise(1.0)
    return df.withColumn("points", Z.directory_link_points(F.col(name), F.col(url), target) * factor)


def max_people(df: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """Overall cap, filled in the given order (one top-k per task, merged once)."""
    return df.orderBy(*order).limit(n)


def top_per_key(df: DataFrame, key: tuple[str, ...], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """Best ``n`` rows per key. Spark applies the rank limit per task before the shuffle, so busy keys stay small."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
