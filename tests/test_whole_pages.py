"""Queries over positioned text see every word of every page."""

import pytest

from pagewright.plans import layouts, reading


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("library"))
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(100))
    rows = [(1, "\n".join(line(k) for k in range(18))), (2, "\n" + line(50)), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_lines_have_all_words(spark, library):
    got = layouts.win_text_lines(spark, library).collect()
    assert sum(len(r["text"].split()) for r in got) == 1900
    first = " ".join(r["text"] for r in got if r["doc"] == 1 and r["page"] == 1 and r["line"] == 0)
    assert first == " ".join(f"w0x{i}" for i in range(100))


def test_each_page_has_its_quote(spark, library):
    got = {r["quote_id"]: r for r in layouts.txt_quote_anchor(spark, library).collect()}
    assert set(got) == {"1:1", "1:2", "1:3", "1:4", "2:1"} and all(r["occurrences"] == 1 and r["lines"] == 1 for r in got.values())


def test_marks_lie_on_all_pages_and_words(spark, library):
    got = {r["annotation_id"]: r["quote"] for r in reading.join_marks_text(spark, library).collect()}
    assert len(got) == 380 and all(got.values())
    assert "1:4:295" in got and "1:1:495" in got
