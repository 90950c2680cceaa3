"""Rules of page sources, budgets, annotations, searches and outlines against answers worked by hand."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import annotations, catalog, coverage, layout, output
from pagewright.sources import files

LONG, MIDDLE = "x" * 100, "y" * 99


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sparse_pages_take_recognised_text(spark):
    p = table(spark, [(1, 1, LONG), (1, 2, MIDDLE), (1, 3, MIDDLE), (1, 4, ""), (1, 5, None), (1, 6, " \n")], "doc long, page int, markdown string")
    o = table(spark, [(1, 1, "o"), (1, 2, "short"), (1, 4, "o"), (1, 6, "  ")], "doc long, page int, markdown string")
    got = {r["page"]: (r["native_chars"], r["source"], r["warning"]) for r in coverage.sparse_pages(p, o).collect()}
    assert got == {1: (100, "pdf", None), 2: (99, "ocr", None), 3: (99, "pdf", "low-confidence"), 4: (0, "ocr", None), 5: (0, "pdf", "no-text"), 6: (0, "pdf", "no-text")}


def test_flagged_pages_take_recognised_text_or_none(spark):
    p = table(spark, [(1, 1, " own ", False, False), (1, 2, "own", True, True), (1, 3, "own", True, True), (1, 4, "", False, True), (1, 5, "", False, False), (1, 6, "own", True, False)], "doc long, page int, markdown string, needs_ocr boolean, asked boolean")
    o = table(spark, [(1, 1, "read"), (1, 2, " read "), (1, 3, " ")], "doc long, page int, markdown string")
    got = {r["page"]: (r["markdown"], r["source"], r["status"]) for r in coverage.merge_sources(p, o).collect()}
    assert got == {1: ("own", "pdf", "read"), 2: ("read", "ocr", "read"), 3: ("", "none", "empty"), 4: ("", "none", "empty"), 5: ("", "none", "unresolved"), 6: ("", "none", "unresolved")}


def test_lines_of_regions_are_appended_trimmed(spark):
    p = table(spark, [(1, 1, "A **bold** plan"), (1, 2, "all here"), (1, 3, "")], "doc long, page int, markdown string")
    r = table(spark, [(1, 1, "bold plan\n  Fig. 1 \n\n ** \nnew"), (1, 2, "all\nhere"), (1, 3, " only ")], "doc long, page int, text string")
    got = {x["page"]: (x["markdown"], x["source"]) for x in coverage.merge_region_text(p, r).collect()}
    assert got == {1: ("A **bold** plan\n\nFig. 1\nnew", "mixed"), 2: ("all here", "pdf"), 3: ("\n\nonly", "mixed")}


def test_engine_is_visual_for_weak_text_with_images_or_recognition(spark):
    def doc(i, chars, images):
        return [(i, k + 1, "z" * c, k in images) for k, c in enumerate(chars)]

    rows = doc(1, [200] * 3, ()) + doc(2, [100] * 3, ()) + doc(3, [100] * 3, (0,)) + doc(4, [9000, 1, 1], (1,)) + doc(5, [9000, 9000, 1], (0, 1, 2)) + doc(6, [1, 1, 1], ()) + doc(7, [300, 300, 300, 0, 0, 0, 0, 0, 0], (3,))
    p = table(spark, rows, "doc long, page int, markdown string, has_image boolean")
    got = {r["doc"]: (r["chars"], r["sparse"], r["images"], r["engine"]) for r in coverage.extraction_profile(p, table(spark, [(6,), (6,), (1,)], "doc long")).collect()}
    assert got == {1: (600, 0, 0, "standard"), 2: (300, 0, 0, "standard"), 3: (300, 0, 1, "visual"), 4: (9002, 2, 1, "visual"), 5: (18001, 1, 3, "standard"), 6: (3, 3, 0, "visual"), 7: (900, 2, 0, "standard")}


def test_page_selections(spark):
    said = {"1": [1], " 1 , 2 - 3 ": [1, 2, 3], "2,2-3": [2, 3], "1 2": "malformed", "0": "malformed", "1-": "malformed", "1,,2": "malformed", "3-1": "reversed", "3-1,x": "reversed", "x,3-1": "malformed", "1-10001": "too-long", "1-10000": "beyond-end", "1-6000,6001-10001": "too-long", "4": "beyond-end", "01": [1]}
    s = table(spark, [(i, k) for i, k in enumerate(said)], "doc long, selection string")
    p = s.select("doc", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    got = {}
    for r in output.select_pages(p, s).orderBy("page").collect():
        got.setdefault(r["doc"], []).append(r["page"] if r["refusal"] is None else r["refusal"])
    assert {k: got[i] if isinstance(v, list) else got[i][0] for i, (k, v) in enumerate(said.items())} == said


@pytest.mark.parametrize(
    ("text", "room", "kept"),
    [("abc", 3, "abc"), ("abcd", 3, "abc"), ("aé", 2, "a"), ("aé", 3, "aé"), ("a€b", 3, "a"), ("a\U0001f600b", 4, "a"), ("a\U0001f600b", 5, "a\U0001f600"), ("ab\ncd", 4, "ab"), ("ab\n", 3, "ab\n"), ("\nabc", 3, "\nab"), ("é\né\né", 4, "é"), ("é", 1, ""), ("", 0, ""), ("a\n\nb c", 4, "a\n")],
)
def test_what_fits_bytes(spark, text, room, kept):
    d = table(spark, [(text, room)], "t string, n int")
    assert d.select(output.fitting(F.col("t"), F.col("n"))).first()[0] == kept
    r = d.select(output.text_page(F.col("t"), F.lit(0), F.col("n")).alias("x")).first()["x"]
    rest = text[len(kept) :]
    assert tuple(r) == (kept, len(kept) if rest else None, len(rest.encode()))


def test_text_pages_beyond_the_end_are_empty(spark):
    d = table(spark, [("abc", 2), ("abc", 3), ("abc", 9)], "t string, o int")
    got = [tuple(r["x"]) for r in d.select(output.text_page(F.col("t"), F.col("o"), F.lit(10)).alias("x")).collect()]
    assert got == [("c", None, 0), ("", None, 0), ("", None, 0)]


def test_page_budget_counts_bytes(spark):
    p = table(spark, [(1, 1, "éé"), (1, 2, "ab\ncd"), (1, 3, "z"), (2, 1, "é"), (3, 1, "abcd"), (3, 2, "e")], "doc long, page int, markdown string")
    got = lambda n: sorted(map(tuple, output.page_budget(p, n).collect()))
    assert got(8) == [(1, 1, "éé", False), (1, 2, "ab", True), (2, 1, "é", False), (3, 1, "abcd", False), (3, 2, "e", False)]
    assert got(4) == [(1, 1, "éé", False), (2, 1, "é", False), (3, 1, "abcd", False)]
    assert got(1) == [(1, 1, "", True), (2, 1, "", True), (3, 1, "a", True)]


def test_comment_pages_hold_the_budget_even_for_the_first(spark):
    rows = [(1, i, "n" * 4, "é" if i == 2 else None, "au", 4) for i in range(1, 5)] + [(2, 1, "n" * 50, None, None, 2), (2, 2, "x", None, None, 2)] + [(3, 1, "m" * 5000, "q" * 5000, "a", 1)]
    c = table(spark, rows, "doc long, seq int, note string, quote string, author string, total int")
    got = lambda o, n: sorted((tuple(r) for r in output.comment_pages(c, o, n).collect()), key=str)
    assert got(0, 14) == sorted([(1, 1, 2), (1, 2, 2), (2, None, 0), (3, None, 0)], key=str)
    assert got(0, 13) == sorted([(1, 1, 1), (2, None, 0), (3, None, 0)], key=str)
    assert got(2, 100) == sorted([(1, 3, None), (1, 4, None)], key=str)
    assert (3, 1, None) in got(0, 8001) and (3, None, 0) in got(0, 8000)


def test_comments_reply_fits_both_budgets(spark):
    import json

    rows = [(1, "a \"b\"", "h", i, 3, i, 1, "text", "au", "n" * 4000 + "m" if i == 3 else 'é"', None) for i in (1, 2, 3)] + [(2, "c", "h", 1, 1, 9, 1, "text", None, "x", "q")]
    c = table(spark, rows, "doc long, name string, document_hash string, seq int, total int, id long, page int, type string, author string, note string, quote string")
    got = lambda *budgets: {r["doc"]: r for r in output.comments_reply(c, *budgets).collect()}
    full = got(0, 9000, 9000)
    reply = json.loads(full[1]["reply"])
    assert [x["id"] for x in reply["comments"]] == [1, 2, 3] and reply["comments"][2]["noteTruncated"] and reply["comments"][2]["note"] == "n" * 4000
    assert reply["name"] == 'a "b"' and reply["nextOffset"] is None and not reply["truncated"] and reply["omittedComments"] == 0
    assert full[1]["reply"] == json.dumps(reply, indent=2, ensure_ascii=False) and full[1]["reply_bytes"] == len(full[1]["reply"].encode())
    two = got(0, 10, 9000)[1]  # notes and authors of two comments are 10 bytes
    assert (two["n_comments"], two["next_offset"], two["omitted"]) == (2, 2, 1) and got(0, 9, 9000)[1]["n_comments"] == 1
    assert got(0, 9000, two["reply_bytes"])[1]["n_comments"] == 2 and got(0, 9000, two["reply_bytes"] - 1)[1]["n_comments"] == 1
    none = got(0, 9000, 5)
    assert none[2]["n_comments"] == 0 and json.loads(none[2]["reply"])["comments"] == [] and none[2]["next_offset"] == 0
    assert got(7, 90, 900)[2]["next_offset"] is None and json.loads(got(7, 90, 900)[2]["reply"])["offset"] == 1


def test_annotation_export(spark):
    rows = [(1, 1, 5, "comment", " a`b\\c ", 2.0, 1.0), (1, 1, 6, "highlight", "first", 1.0, 9.0), (1, 1, 7, "ink", "same height", 2.0, 0.5), (1, 1, 8, "text", "  ", 0.0, 0.0), (1, 1, 9, "signature", None, 9.0, 0.0), (1, 2, 10, "bookmark", None, 0.0, 0.0)]
    a = table(spark, rows, "doc long, page int, annotation_id long, type string, note string, top double, left double")
    got = {r["page"]: r["block"] for r in annotations.export_blocks(table(spark, [(1, 1), (1, 2)], "doc long, page int"), a).collect()}
    assert got == {1: "### Annotations\n\n- **Highlight:** first\n- **Annotation:** same height\n- **Comment:** a\\`b\\\\c\n- **Signature:** Signature", 2: None}


def test_keyword_scan_collapses_trims_and_falls_back(spark):
    p = table(spark, [(1, 1, "New\n\n  york, new York" + "." * 100), (1, 2, "new york")], "doc long, page int, markdown string")
    o = table(spark, [(1, 2, "NEW YORK new york"), (1, 1, "new york")], "doc long, page int, markdown string")
    t = table(spark, [("  new york ",), (" ",)], "term string")
    got = sorted((r["page"], r["ordinal"], r["start"], r["source"]) for r in annotations.keyword_scan(p, t, ocr=o).collect())
    assert got == [(1, 0, 0, "pdf"), (1, 1, 10, "pdf"), (2, 0, 0, "ocr"), (2, 1, 9, "ocr")]
    s = {r["ordinal"]: r["snippet"] for r in annotations.keyword_scan(p, t, 3, o).where("page = 1").collect()}
    assert s == {0: "New york, n...", 1: "...k, new York......"}
    many = table(spark, [(f"zz{i}",) for i in range(1500)] + [("york",)], "term string")
    assert annotations.keyword_scan(p, many).count() == 3


def test_loops_in_descriptions(spark):
    d = table(spark, [("a", "red, red; red, blue, green, grey"), ("b", "red, red; blue, blue, green, grey"), ("c", "one, two, three, four, five, ab, cd"), ("d", "one. one. one. one. one. one"), ("e", None), ("f", "aaa,aaa,bbb,bbb,ccc,ccc,ddd")], "id string, text string")
    got = {r["id"]: (r["segments"], r["distinct_segments"], r["repetitive"]) for r in annotations.repetitive(d).collect()}
    assert got == {"a": (6, 4, True), "b": (6, 4, False), "c": (5, 5, False), "d": (1, 1, False), "e": (0, 0, False), "f": (7, 4, False)}


def test_image_descriptions(spark):
    long_ = "a wide river under an old bridge"
    md = f"intro\n\n{long_[:12]}\n{long_[13:]}\n\n![one](1.png)\ntext ![two](2.png) text\n\n![three](3.png)\n\n{long_}\n![four](4.png)"
    given = [(1, 1, long_), (1, 2, f"**Image description:** {long_}"), (1, 3, "too few"), (1, 4, long_), (1, 5, long_)]
    got = sorted(map(tuple, annotations.image_descriptions(table(spark, [(1, md)], "doc long, markdown string"), table(spark, given, "doc long, image_no int, description string")).collect()))
    assert got == [(1, 1, long_, True), (1, 2, long_, False), (1, 3, None, False), (1, 4, long_, True)]


def test_reuse_asks_for_every_version(spark):
    ok = ("h", 2, 1, 1, "e", 1)
    docs = [(i, *row) for i, row in enumerate([ok, ("h1", 2, 0, 1, "e", 1), ("h2", 2, 1, 0, "e", 1), ("h3", 2, 1, 1, "x", 1), ("h4", 2, 1, 1, "e", 0), ("h5", 3, 1, 1, "e", 1), ("h6", 2, 1, 1, "e", 1), ("h7", 2, 1, 1, "e", 1), ("h8", 2, 1, 1, "e", 1)])]
    d = table(spark, docs, "doc long, content_hash string, page_count int, t int, o int, e string, m int")
    p = table(spark, [(i, k, "" if i == 8 else "text", "unresolved" if i == 6 and k == 2 else "read") for i in range(9) for k in (1, 2)], "doc long, page int, markdown string, status string")
    c = table(spark, [(i, f"{i}:1") for i in range(7)], "doc long, chunk_id string")
    got = catalog.reusable(d.select("content_hash"), d, p, d.select("doc"), c, {"t": 1, "o": 1, "e": "e", "m": 1})
    assert {r["doc"] for r in got.where("reusable").collect()} == {0, 8}  # 5: pages missing, 6: one unresolved, 7: no chunks
    assert catalog.reusable(d.select("content_hash"), d, p, d.select("doc").limit(0), c, {"t": 1}).where("reusable").count() == 0


def test_outline_without_headings(spark):
    lines = [(1, p, k, f"body text {p} {k}", 10.0, False, 500.0 - k) for p in range(1, 5) for k in range(6)]
    extra = [
        ("Big Title", 20.0, False, 700.0), ("Smaller Part", 15.0, False, 650.0), ("2.1 Numbered part", 11.0, False, 640.0), ("2.1 Numbered but plain", 10.0, False, 630.0), ("3) Bold point", 10.0, True, 40.0),
        ("4 no mark", 10.0, False, 600.0), ("Footer big", 20.0, False, 40.0), ("12", 20.0, False, 600.0), ("Page 3 of 9", 20.0, False, 600.0), ("2024. Year", 20.0, False, 600.0), ("see www.example.org", 20.0, False, 600.0),
        ("Bold little", 10.5, True, 600.0), ("A line that goes on for more than ten words and ends as sentence.", 12.0, False, 600.0), ("ab", 20.0, False, 600.0), ("Fourth size", 12.0, False, 600.0),
    ]
    lines += [(1, 1, 100 + i, t, f, b, y) for i, (t, f, b, y) in enumerate(extra)] + [(1, p, 200, "Running  Head", 20.0, False, 750.0) for p in (1, 2, 3)]
    d = table(spark, [(a, p, k, t, 50.0, y, f, b) for a, p, k, t, f, b, y in lines], "doc long, page int, line int, text string, x double, y double, font_size double, bold boolean")
    got = [(r["seq"], r["level"], r["title"]) for r in layout.synthetic_outline(d).orderBy("seq").collect()]
    assert got == [(1, 1, "Big Title"), (2, 2, "Smaller Part"), (3, 2, "2.1 Numbered part"), (4, 1, "3) Bold point"), (5, 3, "Bold little"), (6, 3, "Fourth size")]


def test_lines_of_atoms_by_running_medians(spark):
    rows = [(1, 1, 700.0, 10.0, "a", 10.0, False), (1, 1, 697.0, 30.0, "b", 10.0, True), (1, 1, 694.0, 20.0, "c", 10.0, False), (1, 1, 690.0, 5.0, "d", 30.0, False), (1, 1, 600.0, 5.0, " ", 10.0, False)]
    d = table(spark, rows, "doc long, page int, y double, x double, text string, font_size double, bold boolean")
    got = [(r["line"], r["text"], r["x"], r["y"], r["font_size"], r["bold"]) for r in layout.text_lines(d).orderBy("line").collect()]
    assert got == [(0, "a b", 10.0, 698.5, 10.0, True), (1, "d c", 5.0, 692.0, 20.0, False)]


def test_written_rows_are_those_of_the_call(spark, tmp_path):
    t = table(spark, [(i, f"c{i}") for i in range(50)], "doc long, chunk_id string")
    for part, n in ((t, 50), (t.where("doc < 5"), 5)):
        assert [tuple(r) for r in files.write_passages({"chunks": part}, str(tmp_path), 4).collect()] == [("chunks", n)]
