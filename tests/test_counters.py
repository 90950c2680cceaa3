"""Token counters and what is sized by them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import wordpieces
from pagewright.operators import chunking

PIECES = ["un", "##aff", "##able", "##ably", "aff", "run", "##ning", "##n", "r", "##u", ",", ".", "é", "e", "##e", "中", "hello", None, "hello"]


@pytest.fixture(scope="module")
def count(spark):
    return wordpieces.counter(spark.createDataFrame([(p,) for p in PIECES], "piece string"))


def test_longest_pieces_first(count):
    model = count._broadcast.value
    assert model.pieces("unaffable") == ["un", "aff", "able"] and model.pieces("running") == ["run", "ning"] and model.pieces("runn") == ["run", "n"]
    assert model.pieces("unrun") is None and model.pieces("") == []
    assert list(wordpieces.words("Hé, WORLD 中文x​!")) == ["he", ",", "world", "中", "文", "x", "!"]
    assert count("Unaffable, running.") == 7 and count("unknownword hello") == 2 and count("r" * 101) == 1 and count(" \n") == 0
    assert wordpieces.worst_case(count, len)("hello") == 5


def test_a_vocabulary_is_measured_before_it_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wordpieces, "MOST_PIECES", 3)
    with pytest.raises(ValueError):
        wordpieces.counter(spark.createDataFrame([(p,) for p in "abcd"], "piece string"))


def test_pieces_are_those_of_a_plain_search():
    rng = random.Random(3)
    vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | set("abc")
    inside = {"##" + w for w in rng.sample(sorted(vocabulary), 15)} | {"##a", "##b", "##c"}
    model = wordpieces.WordPieces(sorted(vocabulary | inside))
    for _ in range(300):
        word, at, want = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 15))), 0, []
        while at < len(word):
            end = max(e for e in range(at + 1, len(word) + 1) if (("##" if at else "") + word[at:e]) in (inside if at else vocabulary))
            want.append(word[at:end])
            at = end
        assert model.pieces(word) == want


@pytest.mark.parametrize("kind", ["pieces", "characters", "quarters", "odd"])
def test_no_embedded_text_is_over_its_budget(spark, count, kind):
    by = {"pieces": count, "characters": len, "quarters": chunking.count_quarters, "odd": lambda t: len(t) + t.count(" > ") * 3 if len(t) > 9 else len(t)}[kind]
    rng = random.Random(5)
    word = lambda: rng.choice(["hello", "unaffable", "running", "x", "longerunknownword"])
    text = lambda n: " ".join(word() for _ in range(n))
    table = "\n".join(["| A | B |", "|---|---|", *[f"| {text(3)} | {text(rng.randrange(1, 30))} |" for _ in range(6)]])
    pages = [(1, i, f"# {text(4)}\n\n## {text(9)}\n\nHELLO LABEL\n\n{text(150)}\n\n{table}\n\n{'y' * 300}") for i in (1, 2, 3)]
    p = spark.createDataFrame(pages, "doc long, page int, markdown string")
    for budget in (40, 90):
        rows = chunking.chunk_corpus(p, budget=budget, count=by).collect()
        assert len(rows) > 6 and all(by(r["embed_text"]) <= budget for r in rows)
        assert len({r["chunk_id"] for r in rows}) == len(rows)
        body = "".join(r["text"] for r in sorted((r for r in rows if r["page"] == 2 and not r["fragments"]), key=lambda r: r["idx"]))
        assert body.replace(" ", "").endswith("y" * 300)


def test_the_encoder_caps_the_budget(spark):
    assert chunking.encoder_budget(640, 512) == 510 and chunking.encoder_budget(260, 512) == 260
    p = spark.createDataFrame([(1, 1, "word " * 2000)], "doc long, page int, markdown string")
    sizes = [chunking.count_quarters(r["embed_text"]) for r in chunking.chunk_corpus(p, "contextual").collect()]
    assert max(sizes) == 510
    assert max(len(r["embed_text"]) for r in chunking.chunk_corpus(p, "contextual", count=len, encoder_limit=100).collect()) <= 98


def test_breadcrumbs_take_a_share():
    titles = ["One long title of the whole", "Chapter", "Part"]
    assert chunking.breadcrumb(titles, 1000) == "One long title of the whole > Chapter > Part > "
    assert chunking.breadcrumb(titles, 34) == "Chapter > Part > " and chunking.breadcrumb(titles, 10) == "" == chunking.breadcrumb([], 99)
    assert chunking.breadcrumb(titles, 100, len) == "Part > "


def test_long_texts_and_rows_are_cut_in_linear_time():
    began = time.time()
    text = "word " * 400_000
    cut = chunking.cut_prose(text, 420)
    assert "".join(cut) == text and all(chunking.count_quarters(c) <= 420 for c in cut)
    row = "| " + "cell text \\| more | " * 20_000
    pieces = chunking.cut_row(row, 60, chunking.count_quarters)
    assert "".join(pieces) == row and all(chunking.count_quarters(chunking.shown(p)) <= 60 for p in pieces) and sum(p.endswith("|") for p in pieces) > 0.9 * len(pieces)
    assert time.time() - began < 20


def test_what_an_encoder_keeps(spark, count):
    d = spark.createDataFrame([(1, "hello " * 9), (2, "hello"), (3, None), (4, "unaffable unaffable")], "id int, text string")
    got = {r["id"]: (r["given"], r["embedded"]) for r in chunking.truncation(d, 5, count).collect()}
    assert got == {1: (9, 5), 2: (1, 1), 3: (0, 0), 4: (6, 5)} or got[4][1] <= 5
    assert chunking.truncation(d.select(F.lit("x" * 41).alias("text")), 10).first()[1:] == (11, 10)
