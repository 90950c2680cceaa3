"""What Markdown shows, names of headings, addresses and places, worked by hand."""

import pytest

from pagewright.operators import inline, links


def test_segments_are_what_is_shown():
    text = "\r\n".join([
        "# The *big* `idea` ![alt](x.png)", "", "Read [the guide](http://a.b/guide) **now** or", "later.", '<a id="page-2"></a>', "- one", "* two [three](four)", "3) five", "> quoted", "> *words*",
        "---", "| Head `c` | B |", "|---|:---:|", "| x \\| y | **z** |", "| only |", "", "```python", "# not *a* heading", "```", "```Mermaid", "graph", "```", "```", "never closed",
    ])
    assert inline.rendered(text) == [
        ("heading", "The "), ("heading", "big"), ("heading", " "), ("heading", "idea"), ("heading", " "), ("paragraph", "Read "), ("paragraph", "the guide"), ("paragraph", " "), ("paragraph", "now"), ("paragraph", " or later."),
        ("list", "one"), ("list", "two "), ("list", "three"), ("list", "five"), ("quote", "quoted "), ("quote", "words"), ("table", "Head "), ("table", "c"), ("table", "B"), ("table", "x | y"), ("table", "z"), ("table", "only"),
        ("code", "# not *a* heading"), ("code", "never closed"),
    ]
    assert inline.rendered(None) == inline.rendered(" \n\n") == [] and inline.rendered("**") == [("paragraph", "**")]
    assert inline.rendered("a | b\nno divider") == [("paragraph", "a | b no divider")]


def test_matches_lie_in_what_is_shown_and_are_numbered_over_the_document(spark):
    d = spark.createDataFrame([(1, "An owl in [the owl book](/owl/owls) ![owl](owl.png)\n\n| Owl | b |\n|---|---|\n| no **ow**l | owlowl |"), (2, None)], "doc long, markdown string")
    t = spark.createDataFrame([(" OWL ",), ("png",), ("",), ("ow l",)], "term string")
    got = sorted(tuple(r) for r in inline.markdown_scan(d, t, 3).collect())
    assert got == [
        (1, " OWL ", 0, 0, 3, "An owl in..."), (1, " OWL ", 1, 1, 4, "...he owl bo..."), (1, " OWL ", 2, 3, 0, "Owl"), (1, " OWL ", 3, 8, 0, "owlowl"), (1, " OWL ", 4, 8, 3, "owlowl"),
    ]
    # A long list of terms is one automaton, and only those that are shown are found.
    many = t.unionByName(spark.range(5_000).selectExpr("concat('owl', id) as term"))
    assert sorted(tuple(r) for r in inline.markdown_scan(d, many, 3).collect()) == got


def test_heading_names(spark):
    assert inline.slug("The **big** _idea_, part `2`!") == "the-big-idea-part-2" and inline.slug("![x](y) ...") == "" and inline.slug("Über  ²  日本 - x") == "über-²-日本---x"
    assert inline.fragment_name(" <#Two words> ") == "two-words" and inline.fragment_name("#a%20b") == "a-b" and inline.fragment_name("#100%") == "100" and inline.fragment_name("#%ff") == "ff"
    assert inline.fragment_name("a.md#b") is None and inline.fragment_name("#") is None and inline.fragment_name(None) is None


@pytest.mark.parametrize(
    ("given", "normal"),
    [
        ("http://A.Example/Path?Q=1#F", "http://a.example/Path?Q=1#F"), ("  HTTPS://x.org\t\n", "https://x.org/"), ("http://x.org:80/", "http://x.org/"), ("https://x.org:80", "https://x.org:80/"), ("https://x.org:0443/", "https://x.org/"),
        ("http:x.org/a", "http://x.org/a"), ("http:\\\\x.org\\a", "http://x.org/a"), ("http://x.org/a/./b/../c/%2E%2e/", "http://x.org/a/"), ("http://x.org/..", "http://x.org/"), ("http://x.org/a b<c>", "http://x.org/a%20b%3Cc%3E"),
        ("http://x.org/?a b'c", "http://x.org/?a%20b%27c"), ("http://x.org/#a b`", "http://x.org/#a%20b%60"), ("http://x.org/é", "http://x.org/%C3%A9"), ("http://bücher.example", "http://xn--bcher-kva.example/"), ("http://%41.org", "http://a.org/"),
        ("http://user:pass@x.org/", "http://user:pass@x.org/"), ("http://@x.org", "http://x.org/"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://256", "http://0.0.1.0/"), ("http://1.2.3.256", None), ("http://[::0001]:8080/", "http://[::1]:8080/"),
        ("mailto:A@b.org?subject=x y", "mailto:A@b.org?subject=x%20y"), ("mailto:", "mailto:"), ("MAILTO:a@b", "mailto:a@b"), ("http://", None), ("http://a b.org", None), ("http://x.org:99999", None), ("http://x.org:a", None), ("ht\ntp://x.org", "http://x.org/"),
        ("javascript:alert(1)", None), ("file:///x", None), ("//x.org", None), ("/a", None), ("x.org", None), ("", None), (None, None), ("http://x.org/" + "a" * 4083, "http://x.org/" + "a" * 4083), ("http://x.org/" + "a" * 4084, None),
    ],
)
def test_normal_forms(given, normal):
    assert links.normal_url(given) == normal


def test_links_of_pages(spark):
    html = "<A class=x HREF = 'http://A.org/?a=1&amp;b=2'>x</a><a href=\"/rel\" title='href=\"no\"'>y</a><abbr href=\"no\"><a data-href=no id=1 href=mailto:a@b>z</a><a name=n>w</a><a href=''>v</a>"
    p = spark.createDataFrame([(1, html), (2, None), (3, "none")], "page_id long, html string")
    got = [tuple(r) for r in links.safe_links(links.page_links(p)).orderBy("link_no").collect()]
    assert got == [(1, 0, "http://A.org/?a=1&b=2", "http://a.org/?a=1&b=2"), (1, 1, "/rel", None), (1, 2, "mailto:a@b", "mailto:a@b"), (1, 3, "", None)]


def test_places_within_documents(spark):
    given = [("name", "ch1"), ("name", "ch2"), ("name", "alias"), ("name", "nowhere"), ("name", "far"), ("index", "0"), ("index", "3"), ("index", "-1"), ("index", "1.5"), ("ref", "7 0"), ("ref", "9 0"), ("url", "#The-Start"), ("url", "<#the start>"), ("url", "#start-1"), ("url", "#none"), ("url", "b.md#start"), ("url", "#"), ("url", "http://x"), (None, "x")]
    rows = [(1, i, k, v) for i, (k, v) in enumerate(given)]
    made = links.internal_links(
        spark.createDataFrame([*rows, (2, 99, "name", "ch1")], "doc long, link_no int, kind string, value string"),
        spark.createDataFrame([(1, "ch1", "index", "1"), (1, "ch2", "ref", "7 0"), (1, "alias", "name", "ch1"), (1, "far", "index", "5")], "doc long, name string, kind string, value string"),
        spark.createDataFrame([(1, "7 0", 2)], "doc long, ref string, index int"), spark.createDataFrame([(1, 3), (2, 3)], "doc long, pages int"),
        spark.createDataFrame([(1, 0, "The *start*"), (1, 1, "Start"), (1, 2, "Start")], "doc long, pos int, title string"),
    )
    got = {r["link_no"]: (r["outcome"], r["page"], r["anchor"]) for r in made.collect()}
    page, broken = lambda n: ("page", n, None), ("broken", None, None)
    assert [got[i] for i in range(11)] == [page(2), page(3), broken, broken, broken, page(1), broken, broken, broken, page(3), broken]
    assert [got[i] for i in range(11, 18)] == [("heading", None, "the-start"), ("heading", None, "the-start"), ("heading", None, "start-1"), broken, ("elsewhere", None, None), broken, ("elsewhere", None, None)]
    assert got[18] == broken == got[99]
