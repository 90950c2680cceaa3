"""Pages in converted documents and quotes on pages, worked by hand."""

import pytest

from pagewright.operators import placing


def words(k, n):
    return [f"p{k}w{i}" for i in range(n)]


def marked(spark, pages, text, notes=None, headings=True):
    p = spark.createDataFrame([(1, n, t) for n, t in pages], "doc long, page int, markdown string")
    b = None if notes is None else spark.createDataFrame([(1, n, t) for n, t in notes], "doc long, page int, block string")
    r = placing.with_page_markers(p, spark.createDataFrame([(1, text)], "doc long, markdown string"), b, headings).first()
    return r["markdown"], {x["page"]: (x["position"], x["moved_after_table"]) for x in r["places"]}


def test_a_marker_stands_at_the_line_of_the_longest_window(spark):
    one, two = " ".join(words(1, 30)), " ".join(words(2, 20))
    text = f"front words here {one}\n{two.upper()}\n\nend"
    got, places = marked(spark, [(1, one), (2, two)], text)
    assert places == {1: (0, False), 2: (len(f"front words here {one}\n"), False)}
    assert got == f'<a id="page-1"></a>\n\n## Page 1\n\nfront words here {one}\n\n<a id="page-2"></a>\n\n## Page 2\n\n{two.upper()}\n\nend\n'
    bare, _ = marked(spark, [(2, two)], text, headings=False)
    assert '<a id="page-2"></a>\n\nP2W0' in bare and "## Page" not in bare


def test_accents_and_case_are_folded(spark):
    text = "élan vital à Orléans où naîtra l'été prochain"
    got, places = marked(spark, [(4, "ÉLAN ... VITAL a orleans ou naitra l ete prochain")], f"x\n{text}")
    assert places[4] == (2, False)


def test_a_marker_never_cuts_a_table(spark):
    rows = [" | ".join(words(9, 3)), " | ".join(words(8, 8)), " | ".join(words(7, 2))]
    table = "| a | b |\n|:---|---:|\n" + "\n".join(f"| {r} |" for r in rows)
    text = f"before\n\n{table}\n\nafter it"
    got, places = marked(spark, [(3, " ".join(words(8, 8)))], text)
    assert places == {3: (len("before\n\n") + len(table), True)}
    assert got == f'before\n\n{table}\n\n<a id="page-3"></a>\n\n## Page 3\n\nafter it\n'
    assert placing.table_ranges("a|b\n--|--\nx") == [] and placing.table_ranges("a|b\n---|---\nx") == [(0, 11)]
    assert placing.table_ranges("a|b\n---|---\nc|d\n---|---\ne|f") == [(0, 15)]  # a second divider ends a table
    assert placing.table_ranges("\\|\n|---|") == [(0, 8)] and placing.table_ranges("|\n|") == []


def test_equal_pages_take_places_one_behind_the_other(spark):
    text = "\n\n".join([" ".join(words(5, 9))] * 2)
    _, places = marked(spark, [(1, " ".join(words(5, 9))), (2, " ".join(words(5, 9))), (3, " ".join(words(5, 9)))], text)
    second = len(" ".join(words(5, 9))) + 2
    # The second page may begin one word behind the first one's place: the window there still fits, in the same line.
    assert places[1] == (0, False) and places[2][0] in (0, second) and places[3][0] in (0, second, None)
    _, places = marked(spark, [(1, " ".join(words(5, 6))), (2, " ".join(words(5, 6)))], "\n\n".join([" ".join(words(5, 6))] * 2))
    assert places == {1: (0, False), 2: (len(" ".join(words(5, 6))) + 2, False)}


def test_pages_that_are_not_found_are_appended(spark):
    text = " ".join(words(1, 12))
    got, places = marked(spark, [(1, text), (2, "only five words stand here"), (3, "these words are nowhere in the text")], text)
    assert places == {1: (0, False), 2: (None, False), 3: (None, False)}
    assert got == f'<a id="page-1"></a>\n\n## Page 1\n\n{text}\n\n---\n\n## Unmatched Page Markers\n\n<a id="page-2"></a>\n\n## Page 2\n\n<a id="page-3"></a>\n\n## Page 3\n'


def test_marked_pages_are_left_alone_and_notes_follow(spark):
    one, two = " ".join(words(1, 12)), " ".join(words(2, 12))
    text = f"<a id='page-1'></a>\n{one}\n### page 12 begins\n{two}"
    got, places = marked(spark, [(1, one), (2, two), (12, two)], text, [(1, "- a note"), (12, " ")])
    assert set(places) == {1, 2}
    assert got == f"<a id='page-1'></a>\n\n- a note\n\n{one}\n### page 12 begins\n\n<a id=\"page-2\"></a>\n\n## Page 2\n\n{two}\n"
    assert marked(spark, [], "  text \n")[0] == "text\n"


def test_words_that_repeat_make_no_window(spark):
    text = "na " * 13 + "na"
    assert marked(spark, [(1, text)], text)[1] == {1: (None, False)}


@pytest.fixture
def anchored(spark):
    def run(lines, *quotes):
        rows = [(1, 1, n, t, float(x), float(y), float(w), 10.0) for n, (t, x, y, w) in enumerate(lines)]
        runs = spark.createDataFrame(rows, "doc long, page int, run_no int, text string, x double, y double, width double, height double")
        q = spark.createDataFrame([(1, 1, str(i), t) for i, t in enumerate(quotes)], "doc long, page int, quote_id string, quote string")
        got = {r["quote_id"]: (r["occurrences"], r["rects"]) for r in placing.anchor_quotes(runs, q).collect()}
        return [got[str(i)] for i in range(len(quotes))]

    return run


def test_words_are_not_joined_over_blanks(anchored):
    got = anchored([("the rapist", 0, 100, 100), ("was caught", 110, 100, 100)], "therapist", "THE  Rapist was", " ", None, "rapistwas")
    assert [n for n, _ in got] == [0, 1, 0, 0, 0]
    assert got[1][1] == [[0.0, 100.0, 140.0, 110.0]]


def test_a_hyphen_goes_only_before_a_letter_on_the_next_line(anchored):
    lines = [("a well-", 0, 100, 70), ("known thing of 12-", 0, 80, 180), ("13 kinds, self-", 0, 60, 150), ("made", 160, 61, 40)]
    got = anchored(lines, "wellknown", "well-known", "12- 13", "1213", "self- made")
    assert [n for n, _ in got] == [1, 0, 1, 0, 1]
    assert got[0][1] == [[20.0, 100.0, 60.0, 110.0], [0.0, 80.0, 50.0, 90.0]]


def test_ligatures_and_soft_hyphens(anchored):
    got = anchored([("e\ufb03cient sy\xads\u00a0 tem", 0, 50, 170)], "efficient", "ffi", "sys tem", "f", "EFFICIENT SYS\xad TEM")
    assert [n for n, _ in got] == [1, 1, 1, 2, 1]
    assert got[1][1] == [[10.0, 50.0, 20.0, 60.0]] == got[3][1]  # the ligature is one character, of all it is written out as


def test_occurrences_overlap_and_lines_are_within_half_a_height(anchored):
    got = anchored([("aaaa", 0, 100, 40), ("bb", 50, 104, 20), ("cc", 80, 94, 20)], "aa", "aaaa bb cc")
    assert got[0][0] == 3 and got[0][1] == [[0.0, 100.0, 20.0, 110.0]]
    assert got[1] == (1, [[0.0, 100.0, 70.0, 114.0], [80.0, 94.0, 100.0, 104.0]])
