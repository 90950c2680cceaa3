"""Word index, fusion, depth and caps against hand-computed answers."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import bow_vector, cosine, fingerprint, plain, snippet, tokens
from pagewright.operators import lexical, search

NOTES = [(1, "red blue red green"), (2, "blue red"), (3, "green. Blue? red!"), (4, "x1-y2/z3 and x1 y2"), (5, "Ångström, angstrom; ÅNGSTRÖM"), (6, "re-d blu e"), (7, "")]


def ask(spark, *texts):
    """{doc: rank} of each text, by asked and by stored words."""
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in NOTES], "chunk_id string, doc long, text string")
    q = spark.createDataFrame([(i, t, "exact", 0.24, False) for i, t in enumerate(texts)], "query_id long, text string, mode string, min_score double, explicit_min_score boolean")
    plan = lexical.plan_queries(q)
    lengths = lexical.chunk_lengths(chunks)
    found = []
    for words in (lexical.asked_words(chunks, plan), lexical.stored_words(lexical.postings(chunks), lengths, plan)):
        got = [{} for _ in texts]
        for r in lexical.bm25(words, plan, lengths).collect():
            got[r["query_id"]][r["doc"]] = r["rank"]
        found.append(got)
    assert {(r["query_id"], r["doc"]) for r in lexical.phrase_matches(words, plan).collect()} == {(i, d) for i, g in enumerate(got) for d in g}
    assert found[0] == found[1]
    return found[0]


def test_exact_queries(spark):
    cases = {
        "red": {1, 2, 3}, '"blue red"': {1, 2, 3}, '"red blue"': {1}, "green blue": {1, 3}, "x1-y2": {4}, "y2-x1": set(), '"y2 z3 and"': {4}, "ANGSTROM": {5}, '"angstrom angstrom angstrom"': {5},
        '"d blu"': {6}, '"red blu"': set(), "?? red": {1, 2, 3}, 'red "green"': {1, 3}, "grey red": set(), '"" green': {1, 3}, 'green green "green"': {1, 3},
    }
    assert [set(g) for g in ask(spark, *cases)] == list(cases.values())


def test_bm25_by_hand(spark):
    from math import log

    n, lengths = 7, [4, 2, 3, 6, 3, 4, 0]
    idf = lambda df: max(1e-6, log((n - df + 0.5) / (df + 0.5)))
    score = lambda tf, df, size: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (sum(lengths) / n)))
    both, phrase, lone = ask(spark, "red green", '"x1 y2"', "re z3")
    assert set(both) == {1, 3} and abs(both[1] + score(2, 3, 4) + score(1, 2, 4)) < 2e-6 and abs(both[3] + score(1, 3, 3) + score(1, 2, 3)) < 2e-6
    assert set(phrase) == {4} and abs(phrase[4] + score(2, 1, 6)) < 2e-6
    assert lone == {}  # each word is there, but in no chunk both


def library(spark, rows, queries, searched):
    """(query_id, chunk) of library_search over (chunk, doc, text)."""
    c = spark.createDataFrame(rows, "chunk_id string, doc long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string, mode string, min_score double, explicit_min_score boolean")
    plan = lexical.plan_queries(q)
    asked = q.select("query_id", bow_vector(F.col("text")).alias("qv"), "min_score")
    v = c.select("chunk_id", "doc", bow_vector(F.col("text")).alias("vector"))
    s = spark.createDataFrame([(d,) for d in searched], "doc long")
    return search.library_search(plan, asked, lexical.asked_words(c, plan), lexical.chunk_lengths(c), v, s).orderBy("query_id", "place").collect()


def test_library_search_modes_scope_and_index_wide_statistics(spark):
    rows = [(f"c{i}", i, "common rare" if i == 0 else f"common filler{i}") for i in range(8)]
    queries = [(1, "rare", "exact", 0.24, False), (2, "common rare", "semantic", 0.9, False), (3, "common rare", "hybrid", 0.9, False), (4, "rare", "exact", 0.3, True), (5, "--", "exact", 0.2, False), (6, "--", "hybrid", 0.2, False), (7, "common", "exact", 0.2, False)]
    got = {}
    for r in library(spark, rows, queries, [0, 1]):
        got.setdefault(r["query_id"], []).append(r)
    assert [(r["chunk_id"], r["matched_by"]) for r in got[1]] == [("c0", "exact")]
    assert [(r["chunk_id"], r["matched_by"]) for r in got[2]] == [("c0", "semantic")]
    assert [(r["chunk_id"], r["matched_by"]) for r in got[3]] == [("c0", "semantic,exact")] and abs(got[3][0]["score"] - 2 / 61) < 1e-8
    assert [(r["status"], r["chunk_id"]) for q in (4, 5) for r in got[q]] == [("refused", None), ("no-words", None)]
    assert got[6][0]["mode"] == "semantic" and got[6][0]["status"] == "ok" and got[6][0]["chunk_id"] is None
    assert {r["chunk_id"] for r in got[7]} == {"c0", "c1"}  # others have the word too, but aren't searched


def test_least_scores_are_inclusive_and_concern_the_cosine_only(spark):
    rows = [("a", 1, "x y"), ("b", 2, "x")]
    at = round(0.5**0.5, 6)
    for least, found in ((at, {"a", "b"}), (at + 1e-6, {"b"})):
        got = library(spark, rows, [(1, "x", "semantic", least, False)], [1, 2])
        assert {r["chunk_id"] for r in got} == found
    got = library(spark, rows, [(1, "x", "hybrid", 0.99, False)], [1, 2])
    assert {r["chunk_id"]: r["matched_by"] for r in got} == {"a": "exact", "b": "semantic,exact"}


def test_the_latest_version_is_chosen_before_the_grant(spark):
    from pagewright.operators import catalog

    d = spark.createDataFrame([(1, "/in/a", "resolved", 5), (2, "/in/a", "guessed", 9), (3, "/out/b", "resolved", 1), (4, "/in/c", "resolved", 2), (5, "/inner/d", "resolved", 2)], "doc long, path string, path_provenance string, last_opened long")
    latest = catalog.latest_versions(d)
    seen = catalog.discoverable(latest, spark.createDataFrame([("/in",)], "root string"))
    assert [r["doc"] for r in seen.collect()] == [4]  # the older version of /in/a doesn't stand in for the newest
    searched, counts = search.library_documents(latest, seen, spark.createDataFrame([(3,), (4,)], "doc long"))
    assert [r["doc"] for r in searched.collect()] == [4] and tuple(counts.first()) == (1, 3, 0)


def test_query_parts(spark):
    rows = spark.createDataFrame([('a "b c" d',), ('one"two',), ('"x" "y z"',), ("   ",), ('"open end',)], "t string")
    got = [list(r[0]) for r in rows.select(lexical.query_parts(F.col("t"))).collect()]
    assert got[0] == ["a", "b c", "d"] and got[2] == ["x", "y z"] and got[3] == []


def test_reciprocal_ranks(spark):
    s = spark.createDataFrame([(1, "A", 1, 0.9, 1), (1, "B", 1, 0.8, 2), (1, "C", 2, 0.7, 3)], "query_id long, chunk_id string, doc long, score double, place int")
    e = spark.createDataFrame([(1, "C", 2, 1), (1, "D", 3, 2)], "query_id long, chunk_id string, doc long, place int")
    got = search.top_fused(search.fuse(s, e)).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ["C", "A", "B", "D"]
    assert abs(got[0]["score"] - (1 / 63 + 1 / 61)) < 1e-8 and got[0]["matched_by"] == "semantic,exact"
    assert got[2]["score"] == got[3]["score"] and got[3]["semantic_score"] is None


def test_at_most_three_of_a_document(spark):
    s = spark.createDataFrame([(1, f"c{i:02}", i % 2, 1.0 - i / 100, i + 1) for i in range(12)], "query_id long, chunk_id string, doc long, score double, place int")
    e = s.select("query_id", "chunk_id", "doc", "place").limit(0)
    got = search.cap_per_document(search.fuse(s, e)).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ["c00", "c01", "c02", "c03", "c04", "c05"]


def test_depth_doubles_only_while_short_and_full(spark):
    """A plain loop over depths gives the same answer as the levels as rows."""
    import random

    rng = random.Random(3)
    sem, exa = [], []
    for q in range(6):
        docs = [rng.randrange(1 if q < 2 else 40) for _ in range(300)]
        order = rng.sample(range(300), 300)
        sem += [(q, f"c{i:03}", docs[i], 1 - k / 1000, k + 1) for k, i in enumerate(order[: 60 * (q + 1) if q != 1 else 30])]
        exa += [(q, f"c{i:03}", docs[i], k + 1) for k, i in enumerate(rng.sample(range(300), 40))]
    s = spark.createDataFrame(sem, "query_id long, chunk_id string, doc long, score double, place int")
    e = spark.createDataFrame(exa, "query_id long, chunk_id string, doc long, place int")
    got = {}
    for r in search.depth_ladder(s, e, deepest=200).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["depth"], r["chunk_id"], r["candidates_truncated"]))
    for q in range(6):
        depth, k = 50, 12
        while True:
            a = {c: (p, v, d) for x, c, d, v, p in sem if x == q and p <= depth}
            b = {c: (p, d) for x, c, d, p in exa if x == q and p <= depth}
            rows = []
            for c in a.keys() | b.keys():
                score = round((1 / (60 + a[c][0]) if c in a else 0) + (1 / (60 + b[c][0]) if c in b else 0), 9)
                rows.append((-score, -(c in a and c in b), -(a[c][1]) if c in a else 9, c, a[c][2] if c in a else b[c][1]))
            n, kept = {}, []
            for row in sorted(rows):
                n[row[4]] = n.get(row[4], 0) + 1
                if n[row[4]] <= 3:
                    kept.append(row[3])
            kept, full = kept[:k], len(a) >= depth or len(b) >= depth
            if len(kept) >= k or not full or depth >= 200:
                cut = len(kept) < k and full and depth >= 200
                break
            depth = min(200, depth * 2)
        assert got[q] == [(depth, c, cut) for c in kept]


def test_semantic_by_blocks_is_semantic_by_expressions(spark):
    rows = spark.createDataFrame([(f"c{i}", i, f"word{i % 7} word{i % 3} other words here {i}") for i in range(50)], "chunk_id string, doc long, text string")
    v = rows.select("chunk_id", "doc", bow_vector(F.col("text")).alias("vector"))
    q = rows.limit(5).select(F.col("doc").alias("query_id"), bow_vector(F.col("text")).alias("qv"), F.lit(0.5).alias("min_score"))
    a = search.top(search.semantic_scores(q, v), "score", 7).select("query_id", "chunk_id", "score", "place").collect()
    b = search.top(search.semantic_top(q, v, 7, block=2), "score", 7).select("query_id", "chunk_id", "score", "place").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_semantic_top_keeps_ties_and_bounds_what_it_holds(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = [(f"c{i:03d}", i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(300)]
    v += [("null", 900, None), ("narrow", 901, [1.0]), ("hole", 902, [1.0, None, 0.0, 1.0]), ("zero", 903, [0.0] * 4)]
    q = [(i, [float(x) for x in rng.integers(0, 3, 4)], 0.3) for i in range(9)] + [(50, None, 0.1), (51, [0.0] * 4, 0.1)]
    vectors = spark.createDataFrame(v, "chunk_id string, doc long, vector array<double>").repartition(3)
    queries = spark.createDataFrame(q, "query_id long, qv array<double>, min_score double")
    want = []
    for i, x, least in q[:9]:
        scored = []
        for c, d, y in v[:300]:
            size = np.linalg.norm(x) * np.linalg.norm(y)
            s = round(float(np.dot(x, y) / size), 6) if size else 0.0
            if s >= least:
                scored.append((-s, c, d))
        want += [(i, c, d, -s, n + 1) for n, (s, c, d) in enumerate(sorted(scored)[:6])]
    for how in ({}, {"block": 2}, {"most_held": 40}, {"block": 3, "most_held": 1}):
        got = search.top(search.semantic_top(queries, vectors, 6, **how), "score", 6).select("query_id", "chunk_id", "doc", "score", "place").collect()
        assert sorted((r[0], r[4], r[1], r[2], round(r[3], 5)) for r in got) == sorted((i, n, c, d, round(s, 5)) for i, c, d, s, n in want), how
    assert search.semantic_top(queries.where("query_id < 0"), vectors).count() == 0
    assert search.semantic_top(queries, vectors.where("doc < 0")).count() == 0


def test_best_rows_of_each_number_with_ties_by_id():
    import numpy as np

    rng = np.random.default_rng(4)
    for depth in (1, 2, 5):
        number, score = rng.integers(0, 6, 200), rng.integers(0, 5, 200) / 4
        ids = np.array([f"i{x}" for x in rng.permutation(200)], object)
        rows, full, last = search.kept_best(number, score, ids, depth)
        want, ends = set(), {}
        for n in set(number.tolist()):
            own = sorted((-score[i], ids[i]) for i in range(200) if number[i] == n)
            want |= {(n, *x) for x in own[:depth]}
            if len(own) >= depth:
                ends[n] = -own[depth - 1][0]
        assert {(number[i], -score[i], ids[i]) for i in rows} == want and dict(zip(full.tolist(), last.tolist(), strict=True)) == ends


def test_text_expressions(spark):
    d = spark.createDataFrame([("# Title\n\n| a | b |\n|---|:-:|\n| **x** | y |\n- item  `code`\n1. two",)], "t string")
    r = d.select(plain(F.col("t")), snippet(F.lit("a " * 200)), fingerprint(F.lit(" a\n b ")) == fingerprint(F.lit("a b")), tokens(F.lit("Été naïve_x ²")), cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))).first()
    assert r[0] == "Title a b x y item code two"
    assert len(r[1]) == 260 and r[1].endswith("...") and r[2]
    assert list(r[3]) == ["ete", "naive", "x", "²"] and abs(r[4] - 2**-0.5) < 1e-12


def test_stored_index_replaces_and_forgets(spark, tmp_path):
    from pagewright.sources import word_index

    def rows(*found):
        return spark.createDataFrame(found, "chunk_id string, doc long, text string")

    at = str(tmp_path / "index")
    word_index.write_index(rows(("a:old", 1, "alpha shared"), ("b:1", 2, "invoice shared shared"), ("n:1", None, "lost"), ("e:1", 3, None)), at, 4)
    word_index.replace_documents(at, rows(("", 1, "")), rows(("a:new", 1, "beta shared"), ("a:2", 1, "gamma")), 4)
    word_index.replace_documents(at, rows(("", 2, ""), ("", None, "")), None, 4)
    word_index.replace_documents(at, rows(("", 9, "")).where("doc > 9"), None, 4)
    index, lengths = word_index.read_index(spark, at)
    assert sorted((r["token"], r["chunk_id"], r["tf"], r["positions"]) for r in index.collect()) == [("beta", "a:new", 1, [0]), ("gamma", "a:2", 1, [0]), ("shared", "a:new", 1, [1])]
    assert sorted((r["chunk_id"], r["doc"], r["len"]) for r in lengths.collect()) == [("a:2", 1, 1), ("a:new", 1, 2), ("e:1", 3, 0)]
    word_index.replace_documents(at, rows(("", 1, ""), ("", 3, "")), None, 4)
    assert [t.count() for t in word_index.read_index(spark, at)] == [0, 0]  # a bucket that is left empty is emptied


def test_replacing_in_a_stored_index_shuffles_no_kept_row(spark, tmp_path, monkeypatch):
    from pagewright.sources import word_index

    plans, real = [], word_index._write

    def write(new, kept, path, numbers):
        plans.extend(t._jdf.queryExecution().sparkPlan().toString() for t in kept.values())
        real(new, kept, path, numbers)

    monkeypatch.setattr(word_index, "_write", write)
    at, chunk = str(tmp_path / "index"), "chunk_id string, doc long, text string"
    word_index.write_index(spark.createDataFrame([(f"{i}:1", i, f"word{i} all") for i in range(40)], chunk), at, 4)
    word_index.replace_documents(at, spark.createDataFrame([(f"{i}:2", i, "new") for i in range(5)], chunk), None, 4)
    assert len(plans) == 2 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    index, lengths = word_index.read_index(spark, at)
    assert index.count() == 70 and sorted(r["doc"] for r in lengths.collect()) == list(range(5, 40))


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_a_change_of_the_index_leaves_what_stays(spark, tmp_path, monkeypatch, small):
    from pagewright.sources import word_index

    monkeypatch.setattr(word_index, "SMALL", small)
    monkeypatch.setattr(word_index, "MOST_GENERATIONS", 3)
    at = str(tmp_path / "index")
    rows = lambda *found: spark.createDataFrame(found, "chunk_id string, doc long, text string")
    files = lambda: {p for p in (tmp_path / "index").rglob("part-*.parquet") if "/index/gen=" in str(p)}
    c = {f"{i}:{k}": (i if i else None, f"b a b word{i} all {'b a ' * k}b") for i in range(9) for k in range(3)}
    word_index.write_index(rows(*[(n, *v) for n, v in c.items()]), at, 4)
    q = spark.createDataFrame([(1, '"b a b" word3'), (2, "all new"), (3, '"b b"'), (4, '"a b a" all'), (5, "none")], "query_id long, text string")
    p = lexical.plan_queries(q.withColumn("mode", F.lit("hybrid")).withColumn("min_score", F.lit(0.0)).withColumn("explicit_min_score", F.lit(False)))
    for step, (out, new) in enumerate([([None, 3, 5], {"3:0": (3, "new all b a b"), "0:9": (None, "b b")}), ([3, 8], {"3:0": (3, "word3 b a b")}), ([1, 77], {"77:1": (77, None)})]):
        had = files()
        word_index.replace_documents(at, spark.createDataFrame([(d,) for d in out], "doc long"), rows(*[(n, *v) for n, v in new.items()]) if new else None, 4)
        assert (had <= files()) == (not small and step != 2)  # what stays is not written again
        (tmp_path / "index" / "index" / f"gen={90 + 10 * step}").mkdir()  # a run that failed before its commit
        c = {n: v for n, v in c.items() if v[0] not in out} | (new or {})
        whole = rows(*[(n, *v) for n, v in c.items()])
        index, lengths = word_index.read_index(spark, at, p)
        key = lambda df: sorted(map(str, df.collect()))
        assert key(lengths) == key(lexical.chunk_lengths(whole))
        assert key(word_index.read_index(spark, at)[0].drop("len")) == key(lexical.postings(whole).select("token", "chunk_id", "doc", "tf", "positions"))
        hits = lexical.stored_hits(index, p)
        assert key(hits) == key(lexical.asked_hits(whole, p).select(*hits.columns)) != []
        assert key(lexical.bm25(hits, p, lengths)) == key(lexical.bm25(lexical.asked_hits(whole, p), p, lexical.chunk_lengths(whole)))
