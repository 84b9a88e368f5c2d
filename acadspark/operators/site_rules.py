"""People of listing pages by rules per site: a table function called once per page with the rules of its site."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from acadspark.functions import urls as U
from acadspark.functions.dom import Node, parse

RULES = ("item", "name", "title", "link")


def select(node: Node, selector: str) -> list[Node]:
    """Elements below ``node`` by a selector of steps ``tag``, ``.class``, ``tag.class`` or ``tag[attribute]``, parted by spaces;
    each step is looked for at any depth below the one before."""
    found = [node]
    for step in (selector or "").split():
        name, _, attr = step.partition("[")
        tag, _, cls = name.partition(".")
        inner = {id(k): k for n in found for k in n.walk() if isinstance(k, Node) and (not tag or k.tag == tag) and (not cls or cls.lower() in k.classes())
                 and (not attr or attr.rstrip("]") in k.attrs)}
        found = list(inner.values())
    return [] if found == [node] else found


@udtf(returnType="pos bigint, name string, title string, email string, profile_url string")
class ExtractPeople:
    """One row per item of a page that has a name. Selectors of name, title and link are looked for within the item; an empty
    page or item selector gives no rows."""

    def eval(self, html: str, item: str, name: str, title: str, link: str) -> Iterator[tuple]:
        for pos, node in enumerate(select(parse(html), item)):
            named = next((n.text() for n in select(node, name) if n.text()), None)
            if not named:
                continue
            kind = next((n.text() for n in select(node, title) if n.text()), None)
            refs = [n.attrs["href"].strip() for n in node.find("a") if n.attrs.get("href")]
            mail = next((h[7:].strip() for h in refs if h.lower().startswith("mailto:") and len(h) > 7), None)
            page = next((n.attrs["href"].strip() for n in select(node, link) if n.attrs.get("href") and not n.attrs["href"].lower().startswith("mailto:")), None)
            yield pos, named, kind, mail, page


def register(spark: SparkSession) -> None:
    """Makes ``extract_people(html, item, name, title, link)`` known to SQL, for LATERAL joins."""
    spark.udtf.register("extract_people", ExtractPeople)


def people_by_rules(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """People of ``pages`` (*keep, url, html) by ``rules`` (site, item, name, title, link), one row of selectors per site.

    Pages of a site without rules give no rows. Spark broadcasts the rules by their measured size; a page body then stays in
    the task that reads it.
    """
    sited = pages.select(*keep, "url", "html", U.authority(F.col("url")).alias("site")).join(rules.select("site", *[F.col(r).alias(f"rule_{r}") for r in RULES]), "site")
    rows = sited.lateralJoin(ExtractPeople(F.col("html").outer(), *[F.col(f"rule_{r}").outer() for r in RULES]))
    return rows.select(*keep, "site", "pos", "name", "title", "email", U.resolve(F.col("profile_url"), F.col("url")).alias("profile_url"))
