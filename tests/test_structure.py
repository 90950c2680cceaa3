"""Blocks, chunks, tables, layout, budgets, logs: fixtures and invariants."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators import annotations, blocks, catalog, chunking, layout, output
from pagewright.sources import passages
from pagewright.streaming import jobs


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc long, page int, markdown string")


def test_blocks_and_paths(spark):
    p = pages(spark, "# Title\n## Section\nBody.\nmore\n\nnext\n- a\n- b", "text\n### Deep\n| a |\n|---|\n| 1 |", "# Other\nend", None)
    got = blocks.heading_paths(blocks.blocks(p)).orderBy("pos").collect()
    assert [(r["kind"], r["page"]) for r in got] == [("heading", 1), ("heading", 1), ("paragraph", 1), ("paragraph", 1), ("list", 1), ("paragraph", 2), ("heading", 2), ("table", 2), ("heading", 3), ("paragraph", 3)]
    assert [h["title"] for h in got[7]["headings"]] == ["Title", "Section", "Deep"] and [h["page"] for h in got[7]["headings"]] == [1, 1, 2]
    assert [h["title"] for h in got[9]["headings"]] == ["Other"] and got[2]["text"] == "Body.\nmore"


def test_labels_and_running_text(spark):
    texts = [f"**L A B E L {i}**\n\nContent {i} stands here.\n\nSame footer" for i in range(4)] + ["ALONE"]
    p = pages(spark, *texts)
    b = blocks.blocks(p)
    got = blocks.fold_labels(b, blocks.running_text(b, p)).orderBy("pos").collect()
    assert [r["role"] for r in got] == ["folded", "chunk", "running"] * 4 + ["chunk"]
    assert list(got[1]["local_headings"]) == ["L A B E L 0"]


@pytest.mark.parametrize("room", [3, 7, 20, 400])
def test_prose_is_cut_without_loss(room):
    text = "Some words, some longerwordswithoutanyspace " * 9 + "🦜" * 30
    cut = chunking.cut_prose(text, room)
    assert "".join(cut) == text and all(chunking.count_quarters(c) <= room for c in cut)


def test_tables_are_cut_without_loss():
    rng = random.Random(1)
    for _ in range(60):
        rows = ["| " + " | ".join("".join(rng.choice(r"ab \|é") for _ in range(rng.randrange(1, 30))) for _ in range(3)) + " |" for _ in range(rng.randrange(1, 9))]
        text = "\n".join(["| h1 | h2 | h3 |", "|---|---|---|", *rows])
        budget = rng.randrange(40, 120)
        found = chunking.cut_table(text, budget, len)
        header, windows = found
        back = {(r, p): piece for w in windows for r, p, _, piece in w}
        assert [x for x in ("".join(back[k] for k in sorted(back) if k[0] == r) for r in range(len(rows)))] == rows
        assert all(len(header + "\n".join(chunking.shown(p[3]) for p in w)) <= budget for w in windows)
        for a, b in zip(windows, windows[1:], strict=False):
            assert a[-1] == b[0] or a[-1][:2] != b[0][:2]
    assert chunking.cut_table("| a |\n| b |\n| c |", 100) is None and chunking.cut_table("x\n\ny", 100) is None


def test_chunks_fit_and_are_distinct(spark):
    p = pages(spark, "# A long heading that takes room\n## Sub\n" + "words in a paragraph " * 40, "| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | value {i} |" for i in range(30)))
    c = chunking.chunk_corpus(p, budget=50)
    rows = c.collect()
    assert len({r["chunk_id"] for r in rows}) == len(rows) > 5
    assert all(chunking.count_quarters(r["embed_text"]) <= 51 for r in rows)  # prefix and text are each rounded up
    b = blocks.blocks(p).withColumn("room", F.lit(40))
    assert {r["lossless"] for r in chunking.lossless(b, chunking.cut_blocks(b)).collect()} == {True}


def test_page_table():
    words = lambda *cells: [(t, x, x + 6 * len(t)) for t, x in cells]
    rows = [(("Net", 72), ("sales", 96), ("all", 132), ("2024", 200), ("10", 300)), (("Cost", 72), ("of", 102), ("it", 120), ("2024", 200), ("7", 300)), (("Rest", 72), ("of", 102), ("all", 120), ("2023", 200), ("3", 300))]
    lines = [words(("Report", 72)), words(("Item", 72), ("Year", 200), ("Sum", 300)), *[words(*r) for r in rows]]
    assert layout.page_table(lines).split("\n") == ["Report", "| Item | Year | Sum |", "| --- | --- | --- |", "| Net sales all | 2024 | 10 |", "| Cost of it | 2024 | 7 |", "| Rest of all | 2023 | 3 |"]
    assert layout.page_table(lines[:2]) is None


def test_marks_take_the_covered_characters(spark):
    runs = spark.createDataFrame([(1, 1, "abcdefghij", 0.0, 100.0, 100.0, 112.0)], "doc long, page int, text string, left double, right double, bottom double, top double")
    marks = spark.createDataFrame([("m", 1, 1, 0, 20.0, 60.0, 100.0, 112.0), ("low", 1, 1, 0, 0.0, 100.0, 90.0, 104.0)], "annotation_id string, doc long, page int, mark_no int, left double, right double, bottom double, top double")
    assert {r["annotation_id"]: r["quote"] for r in annotations.words_under_marks(marks, runs).collect()} == {"m": "cdef", "low": None}


def test_siblings_are_not_inside(spark):
    d = spark.createDataFrame([(1, "/lib/src1/a"), (2, "/lib/src10/a"), (3, "/lib/src1"), (4, "/lib/src1/../x"), (5, None)], "doc long, path string").withColumn("path_provenance", F.lit("resolved"))
    few = spark.createDataFrame([("/lib/src1",)], "root string")
    many = few.unionByName(spark.range(1100).select(F.concat(F.lit("/r"), F.col("id").cast("string")).alias("root")))
    for roots in (few, many):
        assert {r["doc"] for r in catalog.discoverable(d, roots).collect()} == {1, 3}


def test_ranges_and_selections(spark):
    p = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 10, 11, 12)], "doc long, page int")
    assert output.page_ranges(p).first()["ranges"] == "1-3,7,10-12"
    full = spark.createDataFrame([(1, n) for n in range(1, 6)], "doc long, page int")
    want = {"3": [3], "3-4": [3, 4], "1,4-5": [1, 4, 5], "": "malformed", "4-2": "reversed", "9": "beyond-end", "1-99999": "too-long", "1,,2": "malformed"}
    for s, answer in want.items():
        got = output.select_pages(full, spark.createDataFrame([(1, s)], "doc long, selection string")).orderBy("page").collect()
        assert (got[0]["refusal"] if isinstance(answer, str) else [r["page"] for r in got]) == answer


def test_throttle():
    sent, last, best, pending = jobs.throttled([(0, 1.0), (100, 5.0), (500, 3.0), (900, 6.0)], 500, None, 0.0)
    assert sent == [(0, 1.0), (500, 5.0)] and pending == (900, 6.0) and (last, best) == (500, 6.0)


def test_ingest_of_a_stream(spark, tmp_path):
    store = passages.passages(spark, f"{tmp_path}/store", 2)
    scope = passages.Scope("balanced", 4, "words", 1, 64)
    for n, rows in enumerate([[(1, "one\n\nmore"), (2, "two")], [(3, "two"), (4, "three")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.ingest(jobs.page_stream(spark, f"{tmp_path}/in"), store, scope, jobs.chunked(), f"{tmp_path}/state").awaitTermination()
        assert store.snapshot().meta[passages.EPOCH] == str(n)
    assert sorted(r["doc"] for r in store.read("documents").collect()) == [1, 2, 4]
    assert {r["token"] for r in store.read("postings").collect()} == {"one", "more", "two", "three"}
    version = store.snapshot().version
    jobs.ingest(jobs.page_stream(spark, f"{tmp_path}/in"), store, scope, jobs.chunked(), f"{tmp_path}/state-lost").awaitTermination()  # its batch 0 is known
    assert store.snapshot().version == version


def test_throttle_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, t, i, float(i)) for i, t in enumerate((0, 100, 600, 650))], "key long, ms long, seq long, progress double").coalesce(1).write.parquet(f"{tmp_path}/e")
    e = spark.readStream.schema("key long, ms long, seq long, progress double").parquet(f"{tmp_path}/e")
    q = jobs.throttle_stream(e).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(120):  # the query goes on for ever: its timeouts need no data
            got = [(r["ms"], r["progress"]) for r in spark.sql("select * from throttled order by ms").collect()]
            if len(got) >= 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got[:2] == [(0, 0.0), (600, 2.0)]


def test_outline_of_pages_is_that_of_their_blocks(spark):
    odd = [
        "# One\n## Two\n\n\ntext\n- a\n- b\n###### Six  \n####### seven", "#  ", "", None, "\n\n", "| a |\n# In a table\n| b |", "  # set in\n#\ttab\n# ", "#no\n1. x\n## Last",
    ]
    pages = spark.createDataFrame([(i % 2, i + 1, t) for i, t in enumerate(odd)] + [(None, 1, "# Null\n\n## Doc")], "doc long, page int, markdown string")
    for depth in (2, 6):
        want, got = blocks.outline(blocks.blocks(pages), depth), blocks.page_outline(pages, depth)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= 6
