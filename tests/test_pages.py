"""Page extraction on hand-written pages."""

from acadspark.operators import listings as H
from acadspark.operators import pages as G
from acadspark.plans.enrichment import discover_labs
from acadspark.sources.tables import scan_sitemap

PAGE = """<html><head><title>Lee Lab - U</title><meta name="description" content="Memory research"><script>var a="<a href='/no'>no</a>";</script></head>
<body><nav><a href="/faculty">Faculty</a></nav><!-- <a href="/gone">gone</a> --><h1>Dr. Ann Lee</h1><p>First paragraph that is long enough.<p>Second one, also long enough here.</p>
<ul><li>one</li><li>two</li></ul><table><tr><th>k</th><td>v</td></tr></table><a href="https://x.edu/research/lab">Visit our Memory Lab</a> <a href="/lab2">Cognitive Laboratory</a>
<a href="https://twitter.com/lee">tw</a><a href="mailto:lee@x.edu">mail lab</a><p>Last updated 2020</p></body></html>"""


def pages(spark, html=PAGE):
    return spark.createDataFrame([(1, "https://x.edu/people/lee", html)], "page_id long, url string, html string")


def test_meta_and_elements(spark):
    m = G.page_meta(pages(spark)).first()
    assert (m["title"], m["description"], m["last_updated"]) == ("Lee Lab - U", "Memory research", "Last updated 2020")
    assert [r["text"] for r in G.page_paragraphs(pages(spark)).collect()] == ["First paragraph that is long enough.", "Second one, also long enough here."]
    assert G.page_lists(pages(spark)).first()["items"] == ["one", "two"]
    assert G.page_tables(pages(spark)).first()["cells"] == ["k", "v"]
    assert [r["href"] for r in G.page_links(pages(spark)).collect()] == ["/faculty", "https://x.edu/research/lab", "/lab2", "https://twitter.com/lee", "mailto:lee@x.edu"]


def test_lab_links_skip_excluded(spark):
    got = {r["full_url"]: r["points"] for r in G.lab_links(G.page_links(pages(spark))).collect()}
    assert set(got) == {"https://x.edu/research/lab", "https://x.edu/lab2"}
    r = discover_labs(pages(spark)).first()
    assert r["method"] == "link_heuristics" and r["lab_url"] == max(got, key=lambda u: got[u])


def test_nearby_links_use_context(spark):
    html = '<div><p>Dr. Lee directs the Memory Lab at the center</p><a href="https://x.edu/memory">site</a></div>'
    got = H.nearby_lab_links(pages(spark, html)).collect()
    assert [r["full_url"] for r in got] == ["https://x.edu/memory"]


def test_nearby_links_climb_to_the_common_container(spark):
    head = "<h4>Soil Chemistry Laboratory, led by R. Okafor</h4>"
    html = f"""<section>{head}<ul><li><a href="https://soilchem-lab.tundra.edu/">Members and samples</a></li><li><a href="tel:+1">Call</a></li></ul></section>"""
    assert [r["full_url"] for r in H.nearby_lab_links(pages(spark, html)).collect()] == ["https://soilchem-lab.tundra.edu/"]
    far = html.replace(head, f"<header><div><span>{head}</span></div></header>")
    assert H.nearby_lab_links(pages(spark, far)).collect() == []


def test_nothing_is_cut(spark):
    cards = "".join(f'<div class="person"><h3><a href="/people/{i}">Ann Lee{chr(97 + i % 26)}{chr(97 + i // 26)}</a></h3></div>' for i in range(200))
    assert H.directory_people(pages(spark, f"<body>{cards}</body>")).count() == 200
    links = "".join(f'<a href="https://h{i}.org/profile?page={i}">profile {i}</a><p>research {"x" * 1200} {i}</p>' for i in range(130))
    many = pages(spark, f"<body><nav>{''.join(f'<a href="/faculty{i}">faculty</a>' for i in range(30))}</nav>{links}</body>")
    assert G.academic_links(many).count() == 160 and G.page_external(many).count() == 130 and G.profile_patterns(many).count() == 160
    assert G.nav_directories(many).count() == 30 and G.search_result_links(many, min_text=3).count() == 130
    found = G.research_sections(many).filter("keyword = 'research'").collect()
    assert len(found) == 130 and min(len(r["content"]) for r in found) > 1200


def test_listing_cards(spark):
    card = '<div class="person"><h3><a href="/people/{0}">{1}</a></h3><p>{2}</p><a href="mailto:{0}@x.edu">mail</a></div>'
    html = "<body>" + "".join(card.format(i, n, t) for i, n, t in ((1, "Dr. Ann Lee", "Associate Professor"), (2, "Bob Stone", "Lecturer"), (3, "Faculty Directory", ""))) + "</body>"
    got = {r["name"]: (r["title"], r["email"], r["profile_url"]) for r in H.directory_people(pages(spark, html)).collect()}
    assert got == {"Ann Lee": ("Associate Professor", "1@x.edu", "/people/1"), "Bob Stone": ("Lecturer", "2@x.edu", "/people/2")}


def test_nested_lists_and_members(spark):
    html = "<h2>Lab Members</h2><ul><li>Ann Lee, graduate student, ann@x.edu, 520-621-1234</li><li>Bob</li></ul>"
    got = H.lab_members(pages(spark, html)).collect()
    assert got[0]["role"] == "graduate student" and got[0]["email"] == "ann@x.edu" and got[0]["phone"] == "520-621-1234" and len(got) == 2


def test_broken_sitemaps_are_read(spark):
    xml = "<urlset><url><loc>https://x.edu/faculty/a</loc></url><url><loc>https://bio-chem.x.edu/people/</loc></url><url><loc>https://x.edu/about</loc>"
    df = spark.createDataFrame([(xml,)], "xml string")
    got = {r["url"]: (r["relative_path"], r["department"]) for r in scan_sitemap(df, "https://x.edu").collect()}
    assert got == {"https://x.edu/faculty/a": ("faculty/a", None), "https://bio-chem.x.edu/people/": (None, "Bio Chem")}
