"""Operators without SQL, by hand-worked answers and plain loops."""

import json
import math
import re

from pyspark.sql import functions as F

from pagewright.functions.text import bow_vector
from pagewright.operators import annotations, chunking, inline, layout, output
from pagewright.sources import files


def test_repeated_titles_are_numbered(spark):
    titles = ["Scope", "Scope", "Scope-1", "Scope", "!!", "A  b_c", "Scope 1"]
    rows = [(1, i, t) for i, t in enumerate(titles)] + [(2, 0, "Scope")]
    got = {(r["doc"], r["pos"]): r["anchor"] for r in inline.anchor_ids(spark.createDataFrame(rows, "doc long, pos int, title string")).collect()}
    assert [got[1, i] for i in range(7)] == ["scope", "scope-1", "scope-1-1", "scope-2", "section", "a-bc", "scope-1-2"]
    assert got[2, 0] == "scope"


def test_a_title_on_every_page(spark):
    rows = [(7, i, "Notes") for i in range(5000)]
    got = inline.anchor_ids(spark.createDataFrame(rows, "doc long, pos int, title string")).orderBy("pos").collect()
    assert [r["anchor"] for r in got] == ["notes", *(f"notes-{i}" for i in range(1, 5000))]


def test_replies_keep_the_longest_prefix_that_fits(spark):
    hits = [(q, i, "é" * ((7 * i) % 40)) for q in (1, 2) for i in range(1, 30)] + [(3, 1, "x" * 900)]
    size = lambda r, t: len(json.dumps({"rank": r, "text": t}, ensure_ascii=False, separators=(",", ":")).encode()) + 1
    want = {}
    for q in (1, 2, 3):
        used, own = 14, [(r, t) for k, r, t in hits if k == q]
        n = 0
        while n < len(own) and used + size(*own[n]) <= 800:
            used += size(*own[n])
            n += 1
        want[q] = (n, len(own) - n, used)
    got = output.reply_pack(spark.createDataFrame(hits, "query_id long, rank int, text string"), 800)
    assert {r["query_id"]: (r["kept"], r["omitted"], r["reply_bytes"]) for r in got.collect()} == want
    assert want[3] == (0, 1, 14) and 0 < want[1][0] < 29


def test_walks_find_files_by_ending_but_nothing_hidden(spark, tmp_path):
    for name, size in {"a.pdf": 3, "deep/er/b.pdf": 5, "deep/c.txt": 7, ".hid/d.pdf": 9, "deep/.e.pdf": 11}.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * size)
    got = {r["path"].rsplit("/", 1)[1]: r["size"] for r in files.corpus_walk(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": 3, "b.pdf": 5}
    assert [(r["copies"], r["size"]) for r in files.content_hashes(spark, str(tmp_path), ".txt").collect()] == [(1, 7)]


def test_generated_chunks_can_be_made_again_alone(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc long")
    make = lambda d: {r["chunk_id"]: r for r in files.synthetic_library(spark, d, 6, words=20, vocabulary=50, dims=8).collect()}
    all_, alone = make(docs), make(docs.where("doc = 3"))
    assert len(all_) == 30 and len(alone) == 6 and all(all_[k] == r for k, r in alone.items())
    words = [int(w[1:]) for r in all_.values() for w in r["text"].split()[:-1]]
    assert all(r["text"].endswith(f" ref{r['doc']}") and len(r["text"].split()) == 21 and r["page"] == r["idx"] // 4 + 1 for r in all_.values())
    assert 0 <= min(words) and max(words) < 50 and sum(w < 10 for w in words) > sum(w >= 30 for w in words)
    assert all(abs(math.sqrt(sum(x * x for x in r["vector"])) - 1) < 1e-5 for r in all_.values())


def test_literal_scan_against_a_loop(spark):
    texts = ["Order of an ORDER, urgent", "", "a+b a+b a+b", None, "disorder reorder", "URGENT: urgenturgent"]
    terms = ["order", "URGENT", "a+b", "absent"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, page int, markdown string")
    found = annotations.keyword_scan(pages, spark.createDataFrame([(t,) for t in terms], "term string"), 10)
    want = {(i, t, n, m.start()) for i, x in enumerate(texts) for t in terms for n, m in enumerate(re.finditer(re.escape(t.lower()), (x or "").lower()), 1)}
    first = min(r["ordinal"] for r in found.collect())
    assert {(r["page"], r["term"], r["ordinal"] - first + 1, r["start"]) for r in found.collect()} == want


def test_word_vectors_count_slots(spark):
    def slot(w, dims=64):
        h = 2166136261
        for c in w.encode():
            h = ((h ^ c) * 16777619) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h) % dims

    texts = ["The cat, the hat; the 9 bats", "", "!!", "x " * 500, "one two one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bow_vector(F.col("t")).alias("v")).collect()
    for r in rows:
        want = [0.0] * 64
        for w in re.findall(r"[a-z0-9]+", texts[r["i"]].lower()):
            want[slot(w)] += 1
        size = math.sqrt(sum(x * x for x in want)) or 1.0
        assert all(abs(a - b / size) < 1e-12 for a, b in zip(r["v"], want, strict=True))
