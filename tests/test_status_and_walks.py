"""Status badges, progress, places of matches, folder walks, table rows, headings: answers worked by hand."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import plain
from pagewright.operators import annotations, chunking, search
from pagewright.sources import files
from pagewright.streaming import jobs, views

EVENT = "doc long, source string, status string, current double, total double, within double, dismissed boolean, ts long, seq long"


def badges(spark, **docs):
    """The badge of each named case; a case is a list of (source, status, current, total, within, dismissed) in time order."""
    names = list(docs)
    rows = [(i, *e, t, t) for i, n in enumerate(names) for t, e in enumerate(docs[n])]
    e = spark.createDataFrame(rows, EVENT).withColumn("current", F.col("current").cast("int")).withColumn("total", F.col("total").cast("int"))
    return {names[r["doc"]]: (r["stage"], r["label"], r["percent"], r["source"]) for r in views.stage_rollup(e).collect()}


def test_the_most_pressing_state_is_shown(spark):
    w = lambda status, c=None, n=None, x=None, gone=False: ("document", status, c, n, x, gone)
    i = lambda status, c=None, n=None: ("index", status, c, n, None, False)
    got = badges(
        spark, both_failed=[i("error"), w("error")], index_failed=[w("running", 1.0, 2.0), i("error")], reading=[i("ocr", 1.0, 4.0), w("running", 3.0, 8.0, 0.5)], reading_unknown=[w("running", 1.0, 0.0)],
        reading_first=[w("running", 1.0, 200.0, -3.0)], index_reads=[w("checking"), i("ocr", 7.0, 8.0)], index_reads_unknown=[i("ocr", 7.0, None)], checks_text=[i("downloading", 1.0, 3.0), w("checking")],
        downloads=[w("skipped"), i("downloading", 1.0, 3.0)], indexes=[w("skipped"), i("indexing", 1.0, 1000.0)], checks_index=[w("idle"), i("checking")], native=[i("done"), w("skipped")], dismissed=[w("skipped", gone=True)],
        nothing=[w("done"), i("done")], later_wins=[w("error"), w("done"), i("error"), i("indexing", 9.0, 8.0)],
    )
    assert got == {
        "both_failed": ("failed", "OCR failed", None, "document"), "index_failed": ("failed", "Index failed", None, "index"), "reading": ("ocr", "OCR 3/8", 31, "document"), "reading_unknown": ("ocr", "OCR running", None, "document"),
        "reading_first": ("ocr", "OCR 1/200", 4, "document"), "index_reads": ("ocr", "OCR 7/8", 88, "index"), "index_reads_unknown": ("ocr", "OCR running", None, "index"), "checks_text": ("checking-text", "Checking text", None, "document"),
        "downloads": ("downloading", "Downloading model", 33, "index"), "indexes": ("indexing", "Index 1/1000", 4, "index"), "checks_index": ("checking-index", "Checking index", None, "index"), "native": ("native-text", "Native text detected", None, "document"),
        "dismissed": (None, None, None, None), "nothing": (None, None, None, None), "later_wins": ("indexing", "Index 9/8", 100, "index"),
    }


def test_updates_without_a_number_count_one_up():
    nan = float("nan")
    sent, last, best, waits = jobs.throttled([(0, None), (500, 4.0), (1000, nan), (1500, 2.0), (2000, float("inf")), (2100, None)], 500, None, 0.0)
    assert sent == [(0, 1.0), (500, 4.0), (1000, 5.0), (1500, 5.0), (2000, 6.0)] and (last, best, waits) == (2000, 7.0, (2100, 7.0))


def test_a_preferred_place_is_kept_while_it_spells_the_term(spark):
    pages = spark.createDataFrame([(1, 1, "An owl, an Owl and an OWL")], "doc long, page int, markdown string")
    asked = [("there", "owl", 0, 11), ("moved", "owl", 2, 12), ("beyond", "owl", 7, 99), ("before", "OWL", -1, -5), ("none", "hawk", 0, 3), ("end", "owl", 1, 23)]
    r = spark.createDataFrame([(n, 1, 1, t, o, p) for n, t, o, p in asked], "request_id string, doc long, page int, term string, ordinal int, preferred int")
    got = {x["request_id"]: x["start"] for x in annotations.nth_occurrence(r, pages).collect()}
    assert got == {"there": 11, "moved": 22, "beyond": 3, "before": 3, "none": None, "end": 11}


def test_walk_skips_hidden_names_and_links_and_names_what_it_cannot_list(spark, tmp_path):
    root = tmp_path / ".library"  # the root's own name doesn't count
    for name in ("a.pdf", "b.PDF", "c.txt", ".hidden.pdf", "deep/er/d.Pdf", ".git/e.pdf", "deep/.x/f.pdf", "odd name é/g.pdf"):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * len(name))
    os.symlink(root / "a.pdf", root / "link.pdf")
    os.symlink(root / "deep", root / "loop")
    (root / "empty").mkdir()
    got = {os.path.relpath(r["path"].removeprefix("file://"), root): (r["size"], r["readable"]) for r in files.corpus_walk(spark, str(root)).collect()}
    assert got == {"a.pdf": (5, True), "b.PDF": (5, True), "deep/er/d.Pdf": (13, True), "odd name é/g.pdf": (len("odd name é/g.pdf"), True)}
    lost = files.corpus_walk(spark, str(root / "not there")).collect()
    assert [(r["size"], r["readable"]) for r in lost] == [(None, False)]
    if os.geteuid():
        os.chmod(root / "deep", 0)
        got = {r["path"].rsplit("/", 1)[1]: r["readable"] for r in files.corpus_walk(spark, str(root)).collect()}
        os.chmod(root / "deep", 0o755)
        assert got == {"a.pdf": True, "b.PDF": True, "g.pdf": True, "deep": False}


def test_rows_reach_whole_or_not(spark):
    text = "| A | B |\n| --- | --- |\n| one | two |\n| a longer **first** cell | and a second one |\n| x \\| y | z |"
    b = spark.createDataFrame([(1, 0, 1, "table", text, 40)], "doc long, pos int, page int, kind string, text string, room int")
    rows = lambda room, count=chunking.count_quarters: [r["intact"] for r in chunking.rows_reaching(b, chunking.cut_blocks(b.withColumn("room", F.lit(room)), count)).orderBy("row").collect()]
    assert rows(40)[0] and rows(12) == [True, False, rows(12)[2]]
    c = spark.createDataFrame([(1, 0, "h\n", "| one | two |", [(0, 0, 1, "| one | two |")])], "doc long, pos int, embed_prefix string, text string, fragments array<struct<row:int,part:int,parts:int,piece:string>>")
    assert [r["intact"] for r in chunking.rows_reaching(b, c).orderBy("row").collect()] == [True, False, False]
    assert b.select(plain(F.lit("| one | two |")).alias("p")).first()["p"] == "one two"


@pytest.mark.parametrize(("headings", "page", "inherited"), [([], 3, False), ([("A", 1), ("B", 3)], 3, False), ([("A", 3), ("B", 2)], 3, True), ([("A", 1), ("B", None)], 3, False)])
def test_the_nearest_heading_decides(spark, headings, page, inherited):
    d = spark.createDataFrame([(headings, page)], "h array<struct<title:string,page:int>>, page int")
    assert d.select(search.heading_inherited(F.col("h"), F.col("page")).alias("x")).first()["x"] is inherited


def test_all_terms_are_found_in_one_scan(spark, monkeypatch):
    pages = spark.createDataFrame([(1, 1, "Aaaa bAb  abab ABAB"), (1, 2, None), (2, 1, "term77 and term77777 Straße")], "doc long, page int, markdown string")
    few = spark.createDataFrame([("aa",), (" AB ",), ("bab",), ("abab",), ("ab",), ("",), (" ",), ("none",), (None,)], "term string")
    want = {}
    for doc, text in ((1, "aaaa bab abab abab"), (2, "term77 and term77777 straße")):
        for term in ("aa", " AB ", "bab", "abab", "ab"):
            at, n, low = 0, 0, term.strip().lower()
            while (at := text.find(low, at)) >= 0:
                want[doc, term, n] = at
                at, n = at + len(low), n + 1
    for most in (annotations.MOST_TERMS, 2):
        monkeypatch.setattr(annotations, "MOST_TERMS", most)
        got = {(r["doc"], r["term"], r["ordinal"]): r["start"] for r in annotations.keyword_scan(pages, few).collect()}
        assert got == want
    monkeypatch.undo()
    many = spark.range(100_000).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"))
    scan = annotations.keyword_scan(pages, many)
    found = sorted((r["term"], r["start"]) for r in scan.collect())
    assert found == sorted([("term7", 0), ("term77", 0), ("term7", 11), ("term77", 11), ("term777", 11), ("term7777", 11), ("term77777", 11)])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan and "Join" not in plan
