"""What is moved and held must not grow faster than the input: shapes of plans, and results on inputs that were too large."""

from pyspark.sql import functions as F

from pagewright.functions import wordpieces
from pagewright.functions.text import bow_vector, fnv1a
from pagewright.operators import blocks, chunking, layout, lexical, placing, search
from pagewright.plans import layouts
from pagewright.sources import passages


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_cut_in_their_page(spark):
    p = spark.range(3).select((F.col("id") % 2).alias("doc"), F.col("id").cast("int").alias("page"), F.lit("# A\n\nb\nc\n- d").alias("markdown"))
    shape = plan(blocks.blocks(p))
    assert shape.count("Window [") == 1 and "Aggregate" not in shape  # no sort or group of lines
    got = [(r["doc"], r["pos"], r["page"], r["kind"], r["text"]) for r in blocks.blocks(p).orderBy("doc", "pos").collect()]
    own = [("heading", "# A"), ("paragraph", "b\nc"), ("list", "- d")]
    assert got == [(d, 3 * k + i, page, *own[i]) for d, page, k in ((0, 0, 0), (0, 2, 1), (1, 1, 0)) for i in range(3)]


def test_pages_are_placed_beside_their_text(spark):
    p = spark.createDataFrame([(1, i, f"w{i} a b c d e f g h i j k l m n{i} o p q r{i}") for i in range(1, 4)] + [(2, 1, "no such words here at all")], "doc long, page int, markdown string")
    c = spark.createDataFrame([(1, "\n\n".join(f"W{i} a b c d e f g h i j k l m n{i} o p q r{i}" for i in range(1, 4))), (2, "other"), (3, " alone ")], "doc long, markdown string")
    done = placing.with_page_markers(p, c, headings=False)
    assert plan(done).count("Join ") == 1 and "Generate" not in plan(done)  # no row for each word
    rows = {r["doc"]: r for r in done.collect()}
    assert [(x["page"], x["position"]) for x in rows[1]["places"]] == [(i, c.first()["markdown"].index(f"W{i}")) for i in (1, 2, 3)]
    assert [x["position"] for x in rows[2]["places"]] == [None] and rows[3]["markdown"] == "alone\n"


def test_windows_are_met_behind_the_page_before():
    words = "a b c d e f g h".split()
    assert placing.page_places([(1, words), (2, words), (3, words), (4, ["x"] * 20), (5, [])], words * 2) == {1: 0, 2: 8, 3: None, 4: None, 5: None}
    assert placing.page_places([(1, ["x"] * 20)], ["x"] * 20) == {1: None}  # too few distinct words


def test_all_scores_by_products(spark):
    v = spark.range(3000).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.xxhash64("id", i) % 1000 / 1000).cast("float")).alias("vector"))
    v = v.withColumn("vector", F.when(F.col("id") == 5, F.array_repeat(F.lit(0.0).cast("float"), 8)).otherwise(F.col("vector")))
    v = v.select(F.col("id").alias("chunk_id"), (F.col("id") % 7).cast("int").alias("doc"), "vector")
    q = v.where("chunk_id % 100 = 5").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("qv"))
    by_products = search.semantic_pairs(q, v)
    assert "aggregate(" not in plan(by_products)  # no loop over components for each pair
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "doc", "score").collect()))
    assert key(by_products) == key(search.semantic_scores(q, v)) and by_products.count() == 30 * 3000
    few = q.withColumn("min_score", F.lit(0.5))
    assert key(search.semantic_pairs(few, v)) == key(search.semantic_scores(few, v)) != []


def test_labels_fold_within_their_page(spark):
    texts = [f"**A {i}**\n\n**B {i}**\n\nContent {i} stands here.\n\nSame footer\n\n- x\n\n**C {i}**" for i in range(4)] + ["ALONE", "", None]
    p = spark.createDataFrame([(d, i + 1, t) for d in (1, 2) for i, t in enumerate(texts)], "doc long, page int, markdown string")
    b = blocks.blocks(p)
    key = lambda df: sorted((r["doc"], r["pos"], r["page"], r["kind"], r["text"], r["plain"], r["role"], r["local_headings"] or []) for r in df.collect())
    one = blocks.fold_pages(p)
    assert key(one) == key(blocks.fold_labels(b, blocks.running_text(b, p)))
    assert plan(one).count("Join ") == 1 and plan(one).count("Window [") <= 2
    assert sorted(map(tuple, blocks.running_in(p).collect())) == sorted(map(tuple, blocks.running_text(b, p).collect())) == [(1, "Same footer", 4), (2, "Same footer", 4)]


def test_the_index_of_a_bucket_is_written_once(spark, tmp_path):
    store = passages.passages(spark, f"{tmp_path}/large", 1)
    c = spark.range(210_000).select(F.col("id").alias("doc"), F.lit("balanced").alias("profile"), F.lit(4).alias("version"), F.col("id").cast("string").alias("chunk_id"), F.lit(1).alias("page"), F.lit(0).alias("idx"), F.lit("a word").alias("text"), F.lit("[]").alias("heading_path"))
    passages.fill(store, {"chunks": c}, c.select("doc"))
    filled = store.snapshot().version
    assert passages.complete_index(store) == 210_000 and passages.missing_chunks(store).count() == 0
    assert store.snapshot().version == filled + 2  # one batch, and the mark that all is there
    assert store.read("postings").count() == 420_000


def test_words_are_hashed_in_batches(spark):
    texts = ["The cat, THE hat", "", None, "x " * 3 + "ÄÖ 9k"]
    v = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bow_vector(F.col("t")).alias("v"))
    assert "fnv" not in plan(v) and "aggregate(" not in plan(v) and "transform(" not in plan(v)  # no loop over characters for each word
    got = {r["i"]: r["v"] for r in v.collect()}
    slot = lambda w: abs(fnv1a(w)) % 64
    assert got[1] == [0.0] * 64 and got[2] is None
    assert got[0][slot("the")] == 2 / 6**0.5 and got[0][slot("cat")] == got[0][slot("hat")] == 1 / 6**0.5
    assert got[3][slot("x")] == 3 / 10**0.5 and got[3][slot("9k")] == 1 / 10**0.5


def test_phrases_are_counted_in_their_chunk(spark):
    texts = ["a b a b a", "b a", "a a a b", "", None, "c", "b c a b c"]
    c = spark.createDataFrame([(f"c{i}", i % 3, t) for i, t in enumerate(texts)] + [(None, 1, "a b")], "chunk_id string, doc long, text string")
    q = spark.createDataFrame([(1, '"a b"'), (2, "a c"), (3, '"b a b" b'), (4, "zz"), (5, '"a a"'), (6, '"c a b c"')], "query_id long, text string")
    p = lexical.plan_queries(q.withColumn("mode", F.lit("hybrid")).withColumn("min_score", F.lit(0.0)).withColumn("explicit_min_score", F.lit(False)))
    hits = lexical.asked_hits(c, p)
    key = lambda df: sorted((r["phrase"], r["chunk_id"], r["doc"], r["len"], r["tf"]) for r in df.collect())
    assert key(hits) == key(lexical.phrase_hits(lexical.asked_words(c, p), p)) != []
    assert "Generate" not in plan(hits) and "Join " not in plan(hits)  # no row for each word


def test_lines_and_tables_are_made_in_their_page(spark):
    sf = "/root/testdata/sf0.001"
    lines, tables = layouts.win_text_lines(spark, sf), layouts.win_table_from_lines(spark, sf)
    assert "Generate explode(t" not in plan(lines) and "Sort" not in plan(lines)  # no row for each word
    assert "Generate" not in plan(tables) and "Join" not in plan(tables)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lines) == rows(layout.text_lines(layouts._atoms(spark, sf)))
    outline = layout.synthetic_outline(layout.page_lines(layouts._atom_pages(spark, sf)))
    assert "Join" not in plan(outline) and plan(outline).count("MapInArrow") == 1  # lines are made once
    w = tables.limit(0).sparkSession.createDataFrame([(1, 1, i, j, t, x, x + 5.0 * len(t)) for i in range(4) for j, (t, x) in enumerate((("a", 10.0), (f"b{i}", 90.0), ("pieces", 150.0), ("9", 185.0)))], "doc long, page int, line int, word_no int, text string, x0 double, x1 double")
    p = w.groupBy("doc", "page").agg(F.collect_list(F.struct("line", "word_no", "text", "x0", "x1")).alias("words"))
    assert rows(layout.tables_from_pages(p)) == rows(layout.tables_from_words(w)) != []


def test_blocks_are_cut_and_judged_in_place(spark):
    table = "| A | B |\n| --- | --- |\n" + "\n".join(f"| row {i} | {'long words ' * (i % 4)}and {'x' if i % 3 else 'x | y'} |" for i in range(9))
    rows = [(1, 0, 1, "table", table, 20), (1, 1, 1, "table", table, 40), (1, 2, 1, "table", table, 3), (1, 3, 2, "paragraph", "some words " * 30, 7), (2, 0, 1, "table", "| a |\n| - |", 9), (2, 1, 1, "table", table, 0)]
    b = spark.createDataFrame(rows, "doc long, pos int, page int, kind string, text string, room int")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole, seen = chunking.cut_losslessly(b), chunking.cut_rows_reaching(b)
    assert key(whole) == key(chunking.lossless(b, chunking.cut_blocks(b))) != []
    assert key(seen) == key(chunking.rows_reaching(b, chunking.cut_blocks(b))) and {r["intact"] for r in seen.collect()} == {True, False}
    assert not any(x in plan(df) for df in (whole, seen) for x in ("Join ", "Aggregate"))
    assert chunking.reassembled([("| b |", "h\n", [{"row": 1, "part": 0, "parts": 1, "piece": "| b |"}]), ("| a |", "h\n", [{"row": 0, "part": 0, "parts": 1, "piece": "| a |"}])]) == "h\n| a |\n| b |"


def test_chunks_are_made_in_their_page(spark):
    table = "| A | B |\n| --- | --- |\n" + "\n".join(f"| row {i} | {'words ' * (i % 4)}and x |" for i in range(40))
    texts = [f"# Top\n\n## Part {i}\n**A {i}**\n\n**B {i}**\n\nContent {i} stands here.\n\nSame footer\n\n{table}\n\n**C {i}**" for i in range(2)] + ["text\n### Deep\n- x", "Same footer", None, "ALONE", "# \n##\tnext\nSame footer", "text behind"]
    p = spark.createDataFrame([(d, i + 1, t) for d in (1, 2, None) for i, t in enumerate(texts)] + [(3, 1, "a\n\nb"), (3, 2, "c"), (3, 2, "c")], "doc long, page int, markdown string")
    pieces = wordpieces.counter(spark.createDataFrame([(x,) for x in "row words and x a b content stands here same footer text".split()], "piece string"))
    for count in (chunking.count_quarters, pieces):
        c = chunking.chunk_corpus(p, budget=60, count=count)
        after = plan(c).split("MapInArrow")[0]
        assert "Window" not in after and "Join" not in after  # no block or chunk is sorted
        want = blocks.heading_paths(blocks.with_headings(blocks.fold_pages(p))).where("role = 'chunk'")
        key = lambda df: sorted(str((r["doc"], r["pos"], r["page"], [tuple(h) for h in r["headings"]], r["local_headings"] or [])) for r in df.collect())
        assert key(c.where("part = 0")) == key(want) != []
        rows = c.collect()
        assert all(count(r["embed_text"]) <= 60 for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)
        assert [r["idx"] for r in sorted(rows, key=lambda r: (r["doc"] or 0, r["pos"])) if r["doc"] == 3] == [0, 1, 0, 1]  # a page in two rows is numbered on
    sized, w = [], wordpieces.WordPieces(["row", "words", "and", "x"])
    w._sizes._size = lambda word, real=w.word: sized.append(word) or real(word)
    w._lines._size = lambda text, real=w.line: sized.append(text) or real(text)
    assert len(chunking.cut_table(table, 50, w)[1]) > 3 and len(sized) < 100  # rows are sized once, not with each window that they may end
