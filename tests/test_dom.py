"""Page trees: the pattern for plain pages against the standard parser; row groups against tasks."""

import itertools
import random

from acadspark.functions.dom import Node, _plain, parse, parse_any
from acadspark.functions.steps import spread


def shape(node):
    return (node.tag, node.attrs, [k if isinstance(k, str) else shape(k) for k in node.kids])


PIECES = ("<p>", "</p>", "<P class=\"A b\">", "<div id=\"x\">", "</div>", "<br>", "<br/>", "<a href=\"/x?a=1\">", "<a href=\"/x?a=1&amp;b\">", "<a href='q'>", "</a>", "text", " ", "a &amp; b", "&nbsp;", "&lt",
          "1 < 2", "<", ">", "</", "<!-- c -->", "<!DOCTYPE html>", "<!doctype html>", "<script>", "</script>", "<script>var t=\"</p>\";</script>", "<style>a<b</style>", "</style >", "<title>T</title>",
          "<title>A &amp; <b></title>", "<title>", "</title>", "<textarea><b></textarea>", "<li >", "</li >", "<td colspan=\"2\" rowspan=\"3\">", "<input disabled>", "<svg><p></svg>", "</x y>", "<![CDATA[a]]>",
          "<?pi?>", "<a\xa0href=\"b\">", "\x0b", "<SCRIPT>a</SCRIPT>", "<script>a</style>", "<script>a<!-- </script>", "<img src=\"a\"alt=\"b\">", "<p class=\"a\" class=\"b\">", "é", "<1>", "&#65;", "</p\n>")


def test_plain_pages_have_the_tree_of_the_standard_parser():
    read = 0
    rnd = random.Random(1)
    pages = ["".join(p) for n in (1, 2, 3) for p in itertools.islice(itertools.product(PIECES, repeat=n), 30000)]
    pages += ["".join(rnd.choices(PIECES, k=rnd.randint(4, 30))) for _ in range(20000)] + ["".join(rnd.choices(PIECES[:14], k=20)) for _ in range(5000)]
    for page in pages:
        got = _plain(page)
        if got is not None:
            read += 1
            assert shape(got) == shape(parse_any(page)), page
    assert read > 1000


def test_pages_of_the_views_are_plain():
    page = ('<!DOCTYPE html><html><head><title>A - B</title><meta name="description" content="C"><script>var t="</p>";</script></head><body><div class="person"><h1>N</h1><p>x</p>'
            '<a href="mailto:">m</a> &amp; partners<table><tr><td>1</td></tr></table></div></body></html>')
    assert _plain(page) is not None and shape(parse(page)) == shape(parse_any(page))
    assert isinstance(parse(None), Node)


def test_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    asked = spark.conf.get("spark.acadspark.scan.tasks")
    spark.conf.unset("spark.acadspark.scan.tasks")
    try:
        got = spread(one, "id")
        assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert max(len(p) for p in got.rdd.glom().collect()) < 200 and got.count() == 1000
    finally:
        spark.conf.set("spark.acadspark.scan.tasks", asked)
