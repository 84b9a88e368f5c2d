"""Crawl order as joins: from seed pages over their links, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acadspark.functions import urls as U
from acadspark.operators import pages as G
from acadspark.session import cut_lineage

#: URL parts that tell what a page is, first hit first.
PAGE_KINDS = (("lab", r"/labs?(/|$)|/research/|/group/"), ("directory", r"/directory|/faculty(\?|/?$)|/people(\?|/?$)|/list\?"),
              ("program", r"/programs?(/|$)|/department"), ("profile", r"/people/|/faculty/|/profile|/~"))


def page_kind(url: Column) -> Column:
    low, out = F.lower(url), F.lit("other")
    for kind, pattern in reversed(PAGE_KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def without_dots(url: Column) -> Column:
    """URL whose path has its ``.`` and ``..`` steps carried out; else one page has many addresses, and links up never end."""
    site, path, rest = (F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)?([^?#]*)(.*)$", i) for i in (1, 2, 3))
    steps = F.split(path, "/")
    last = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    return F.when(path.contains("/."), F.concat(site, F.array_join(F.concat(kept, last), "/"), rest)).otherwise(url)


def page_edges(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) of pages (page_id, url, html), resolved and without fragments, mail and script links."""
    found = G.page_links(pages).filter((F.col("href") != "") & ~F.lower("href").rlike("^(#|mailto:|tel:|javascript:)"))
    dst = without_dots(F.regexp_replace(U.resolve(F.col("href"), F.col("page_url")), "#.*$", ""))
    return found.select(F.col("page_url").alias("src"), dst.alias("dst")).filter("dst IS NOT NULL AND dst <> '' AND dst <> src").distinct()


def crawl(seeds: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(url, depth, parent): every page that links reach from ``seeds`` (url), at its first level, with the smallest page of
    the level before that links to it (null for seeds).

    Each level joins the frontier with ``edges`` (src, dst), takes one parent per page by partial minima, so a page that
    everyone links to is no hot key, and drops what was visited before by an anti join. A page enters the frontier once,
    so cycles end. Every level is a checkpoint in the shared folder, written while the plan is built; without ``depth`` the
    crawl ends when a level is empty.
    """
    level = cut_lineage(seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    visited, step = level, 0
    while depth is None or step < depth:
        step += 1
        ahead = level.select(F.col("url").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent"))
        level = cut_lineage(ahead.join(visited.select("url"), "url", "left_anti").select("url", F.lit(step).alias("depth"), "parent"))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def crawl_chain(targets: DataFrame, pages: DataFrame, depth: int | None = None) -> DataFrame:
    """Pages reached from the targets (url) over the links of the fetched pages, with depth, parent and kind; ``fetched`` tells
    whether the page itself is among ``pages``. Pages are read once, for their links; no page body is shuffled."""
    edges = cut_lineage(page_edges(pages))
    found = crawl(targets, edges, depth)
    known = pages.select("url", F.lit(True).alias("fetched")).distinct()
    return found.join(known, "url", "left").select("url", "depth", "parent", page_kind(F.col("url")).alias("kind"), F.coalesce("fetched", F.lit(False)).alias("fetched"))


def sitemap_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(url, depth, parent, kind): sitemap files reached from ``roots`` (url) over index files, level by level; ``files`` has url
    and xml. ``kind`` is index, urlset, or missing for a file that was listed but not fetched. Files that list each other
    are read once."""
    child = F.explode(F.regexp_extract_all(F.regexp_replace("xml", "(?is)<!--.*?-->", ""), F.lit(r"(?is)<sitemap>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1)))
    edges = cut_lineage(files.filter(F.col("xml").contains("<sitemapindex")).select(F.col("url").alias("src"), child.alias("dst")).withColumn("dst", F.replace("dst", F.lit("&amp;"), F.lit("&"))).distinct())
    kinds = files.select("url", F.when(F.col("xml").contains("<sitemapindex"), "index").otherwise("urlset").alias("kind"))
    return crawl(roots, edges).join(kinds, "url", "left").fillna("missing", ["kind"])


def sitemap_locations(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, depth, xml) of the url sets that ``roots`` lead to, for ``scan_sitemap``."""
    found = sitemap_files(files, roots).filter("kind = 'urlset'").select(F.col("url").alias("file"), "depth")
    return found.join(files.select(F.col("url").alias("file"), "xml"), "file")
