import pytest
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.sources import tables, web

JUNK = ["", "javascript:void(0)", "mailto:a@b.c", "TEL:123", "https://x.y/a#top", "https://x.y/site-search?q=1", "https://x.y/search", "https://x.y/Newsletter", "https://x.y/terms-of-use", None]
FINE = ["https://x.y/buying-a-flat/grants", "https://x.y/a?page=2", "https://x.y/a#", "/renting-a-flat/rules.pdf"]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")


def test_junk(frame):
    assert all(r.j for r in frame(JUNK).select(U.is_junk(F.col("url")).alias("j")).collect())
    assert not any(r.j for r in frame(FINE).select(U.is_junk(F.col("url")).alias("j")).collect())


def test_titles(frame):
    cases = {
        "https://x.y/a/shortlease-2room-flexi-flat": "Shortlease 2Room Flexi Flat", "https://x.y/a/my_file.v2.pdf": "My File.V2", "https://x.y/": "https://x.y/", "https://x.y/a/---/": "---",
        "https://x.y/über-uns.html?x=1": "Über Uns", "https://x.y/don't-stop": "Don'T Stop",
    }
    assert {r.url: r.t for r in frame(cases).select("url", U.title(F.col("url")).alias("t")).collect()} == cases


def test_category_type_scope(frame):
    cases = {"https://x/buying-a-flat/selling-a-flat/": ("buying", "html"), "https://x/selling-a-flat/f.PDF": ("selling", "pdf"), "https://x/renting-a-flat/a?f=.pdf": ("living", "pdf"), "https://x/managing-my-home/": ("living", "html"), "https://x/?p=/buying-a-flat/": ("uncategorized", "html")}
    got = frame(cases).select("url", U.category(F.col("url")).alias("c"), U.doc_type(F.col("url")).alias("d")).collect()
    assert {r.url: (r.c, r.d) for r in got} == cases
    scoped = frame(["https://x/a/b", "https://x/A/b", "https://x/c/a/"]).select(U.in_scope(F.col("url"), ("/a/",)).alias("s")).collect()
    assert [r.s for r in scoped] == [True, False, False]


def test_sitemap(spark, tmp_path):
    xml = '<sitemapindex xmlns="urn:x"><sitemap><loc> https://x/buying-a-flat/b </loc></sitemap><url><loc>https://x/news</loc><loc> </loc></url><deep><url><loc>https://x/buying-a-flat/a?x=1&amp;y=2</loc></url></deep></sitemapindex>'
    urls = web.sitemap_urls(spark.createDataFrame([(xml,)], "xml string"))
    assert [r.url for r in urls.orderBy("ordinal").collect()] == ["https://x/buying-a-flat/b", "https://x/news", "https://x/buying-a-flat/a?x=1&y=2"]
    pages = web.classified(urls, ("/buying-a-flat/",))
    assert {r.url for r in pages.collect()} == {"https://x/buying-a-flat/b", "https://x/buying-a-flat/a?x=1&y=2"}
    assert [(r.category, r.n) for r in web.category_counts(pages).collect()] == [("buying", 2)]
    tables.write_sources(pages, f"{tmp_path}/s.yaml")
    back = tables.read_sources(spark, f"{tmp_path}/s.yaml").collect()
    assert [r.url for r in back] == ["https://x/buying-a-flat/a?x=1&y=2", "https://x/buying-a-flat/b"] and back[0].type == "html"
    with pytest.raises(Exception):
        web.sitemap_urls(spark.createDataFrame([("<urlset><loc>",)], "xml string")).collect()


def test_politeness():
    now, slept = [0.0], []
    robots = {"https://a/robots.txt": (200, "User-agent: *\nDisallow: /private"), "https://b/robots.txt": (404, "")}

    def fetch(url):
        if url not in robots:
            raise OSError
        return robots[url]

    gate = web.Politeness(fetch, "bot", 1.0, clock=lambda: now[0], sleep=slept.append)
    assert gate.allowed("https://a/x") and not gate.allowed("https://a/private/y")
    assert gate.allowed("https://b/private") and gate.allowed("https://c/private")
    gate.wait()
    now[0] = 0.25
    gate.wait()
    assert slept == [0.75]
