"""Registered queries of indexing and search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import bow_vector, chunk_id, fingerprint, plain, snippet, tokens
from pagewright.operators import catalog, lexical, search
from pagewright.plans import inputs
from pagewright.plans.inputs import with_ctes
from pagewright.sources import files, word_index

LEAST = 0.24


def _index(spark, sf):
    return lexical.postings(inputs.chunks(spark, sf))


def _plan(spark, sf):
    q = inputs.queries(spark, sf).withColumn("mode", F.lit("hybrid")).withColumn("min_score", F.lit(LEAST)).withColumn("explicit_min_score", F.lit(False))
    return lexical.plan_queries(q)


def _matches(spark, sf):
    plan = _plan(spark, sf)
    return lexical.phrase_matches(lexical.asked_hits(inputs.chunks(spark, sf), plan), plan)


def _exact(spark, sf):
    c = inputs.chunks(spark, sf)
    plan = _plan(spark, sf)
    return lexical.bm25(lexical.asked_hits(c, plan), plan, lexical.chunk_lengths(c))


def _vectors(spark, sf):
    return inputs.chunks(spark, sf).select("chunk_id", "doc", bow_vector(F.col("text")).alias("vector"))


def _asked(spark, sf):
    return inputs.queries(spark, sf).select("query_id", bow_vector(F.col("text")).alias("qv"), F.lit(LEAST).alias("min_score"))


def _semantic(spark, sf):
    return search.semantic_pairs(_asked(spark, sf), _vectors(spark, sf))


def _ranked(spark, sf, depth=search.DEEPEST):
    found = search.semantic_top(_asked(spark, sf), _vectors(spark, sf), depth)
    return search.top(found, "score", depth), search.top(_exact(spark, sf), "rank", depth, descending=False)


def txt_tokenize_index(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).select("token", "chunk_id", "tf", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


def txt_query_plan(spark, sf):
    q = inputs.queries(spark, sf).withColumn("mode", F.when(F.col("query_id") % 2 == 0, "hybrid").otherwise("exact")).withColumn("min_score", F.lit(LEAST)).withColumn("explicit_min_score", F.lit(False))
    extra = spark.createDataFrame([(-1, "--", "hybrid", LEAST, False), (-2, "()", "exact", LEAST, False), (-3, "a\u0001b", "exact", LEAST, False), (-4, "word", "exact", 0.3, True), (-5, "w " * 40, "exact", LEAST, False)], "query_id long, text string, mode string, min_score double, explicit_min_score boolean")
    return lexical.plan_queries(q.drop("item_id").unionByName(extra)).select("query_id", "status", "mode", "min_score", "part", "token_no", "token")


def join_phrase(spark, sf):
    return _matches(spark, sf).select("query_id", "part", "chunk_id", "tf")


def agg_doc_stats(spark, sf):
    lengths = lexical.chunk_lengths(inputs.chunks(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("len"), 6).alias("avgdl"))
    return lexical.document_frequencies(_index(spark, sf)).crossJoin(F.broadcast(lengths))


def agg_bm25(spark, sf):
    return _exact(spark, sf)


def top_exact(spark, sf):
    return search.top(_exact(spark, sf), "rank", 10, descending=False).withColumnRenamed("rank", "score").withColumnRenamed("place", "rank")


def agg_embed_bow(spark, sf):
    v = _vectors(spark, sf).select("chunk_id", F.posexplode("vector").alias("slot", "x")).where("x > 0")
    return v.select("chunk_id", "slot", F.round("x", 6).alias("x"))


def join_semantic(spark, sf):
    """The given vectors against every hundredth of them."""
    e = inputs.table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return search.semantic_pairs(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc"), F.col("embedding").alias("vector"))).withColumn("doc", F.col("doc").cast("int"))


def flt_min_score(spark, sf):
    return _semantic(spark, sf).select("query_id", "chunk_id", "score")


def top_semantic(spark, sf):
    return search.top(search.semantic_top(_asked(spark, sf), _vectors(spark, sf), 10), "score", 10).withColumnRenamed("place", "rank")


def _fused(spark, sf, depth=50):
    s, e = _ranked(spark, sf, depth)
    return search.fuse(s, e)


def join_fuse_rrf(spark, sf):
    return _fused(spark, sf)


def win_doc_cap(spark, sf):
    return search.cap_per_document(_fused(spark, sf)).select("query_id", "chunk_id", F.col("place").alias("rank"))


def top_fused(spark, sf):
    return search.top_fused(_fused(spark, sf)).select("query_id", F.col("place").alias("rank"), "chunk_id")


def top_reading_order(spark, sf):
    hits = search.late_text(search.top_fused(_fused(spark, sf), 40), inputs.chunks(spark, sf))
    return search.reading_order(hits).select("query_id", "doc", "seq", "page", "chunk_id")


def join_late_text(spark, sf):
    hits = search.late_text(search.top_fused(_fused(spark, sf)), inputs.chunks(spark, sf))
    return hits.select("query_id", F.col("place").alias("rank"), "chunk_id", "page", F.length("text").alias("chars"))


def txt_snippets(spark, sf):
    hits = search.late_text(search.top_fused(_fused(spark, sf)), inputs.chunks(spark, sf))
    # A chunk's headings: its document's title, and the heading that every third page begins with; of some the page is unknown.
    title = F.struct(F.lit("Title").alias("title"), F.when(F.col("doc") % 7 != 0, 1).alias("page"))
    last = (F.floor(F.col("page") / 3) * 3).cast("int")
    headings = F.when(last > 0, F.array(title, F.struct(F.concat(F.lit("Part "), last.cast("string")).alias("title"), last.alias("page")))).otherwise(F.array(title))
    hits = hits.withColumn("headings", F.when(F.col("doc") % 5 != 0, headings).otherwise(F.array().cast("array<struct<title:string,page:int>>")))
    path = F.array_join(F.transform("headings", lambda h: h["title"]), " > ")
    return hits.select("query_id", "chunk_id", snippet(plain(F.col("text"))).alias("snippet"), path.alias("heading_path"), search.heading_inherited(F.col("headings"), F.col("page")).alias("heading_inherited"))


def top_depth_ladder(spark, sf):
    s, e = _ranked(spark, sf)
    return search.depth_ladder(s, e).select("query_id", "depth", "chunk_id", F.col("place").alias("rank"), "candidates_truncated")


def library_search(spark, sf):
    """The whole search, the flagship: latest versions, grants and scope decide what is searched; queries of all modes,
    some refused; then text, snippet, and what the catalogue says of each hit."""
    c, d = inputs.chunks(spark, sf), inputs.catalogue(spark, sf)
    latest = catalog.latest_versions(d).where("path is not null")
    held = c.withColumn("profile", F.when(F.col("doc") % 23 == 5, "precise").otherwise("balanced")).withColumn("version", F.when(F.col("doc") % 40 == 1, 3).otherwise(4))
    stored = _vectors(spark, sf).withColumn("model", F.when(F.col("doc") % 17 == 3, "older").otherwise("words")).withColumn("model_version", F.lit(1)).withColumn("dims", F.lit(64))
    vectors = search.in_scope(held, stored, "balanced", 4, "words", 1, 64)
    searched, counts = search.library_documents(latest, catalog.discoverable(latest, inputs.roots(spark)), vectors)
    i = F.col("query_id") % 5
    q = inputs.queries(spark, sf).withColumn("mode", F.when(i == 3, "semantic").when(i >= 2, "exact").otherwise("hybrid"))
    q = q.withColumn("min_score", F.lit(LEAST)).withColumn("explicit_min_score", (i == 4) & (F.col("query_id") % 2 == 0))
    plan = lexical.plan_queries(q)
    hits = search.library_search(plan, _asked(spark, sf), lexical.asked_hits(c, plan), lexical.chunk_lengths(c), vectors, searched)
    hits = hits.join(c.select("chunk_id", "page", "text"), "chunk_id", "left")
    hits = hits.join(d.select("doc", "content_hash", "path", F.col("last_opened").alias("snapshot_recorded_at")), "doc", "left").crossJoin(F.broadcast(counts))  # one row
    return hits.select(
        "query_id", "status", "mode", F.col("place").alias("rank"), "chunk_id", "doc", "page", "score", "semantic_score", "matched_by", snippet(plain(F.col("text"))).alias("snippet"), "candidates_truncated",
        "content_hash", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", "snapshot_recorded_at", "documents_searched", "documents_not_discoverable", "documents_outside_scope",
    )


def top_in_document(spark, sf):
    """Each query in one document, that with its number: no cap, in reading order."""
    c, asked = inputs.chunks(spark, sf), _asked(spark, sf).withColumn("doc", F.col("query_id"))
    plan = _plan(spark, sf)
    exact = lexical.bm25(lexical.asked_hits(c, plan), plan, lexical.chunk_lengths(c))
    hits = search.late_text(search.document_search(asked, exact, _vectors(spark, sf)), c)
    return search.reading_order(hits).select("query_id", "doc", "seq", "page", "chunk_id", "matched_by")


def inc_word_index(spark, sf):
    """The stored index: written without every fifth document; these come in, of every seventh only the first page stays,
    every eleventh is forgotten; then all queries are ranked from what is stored."""
    c, at = inputs.chunks(spark, sf), f"{files.shared_folder(spark)}/words-{uuid.uuid4().hex}"
    word_index.write_index(c.where("doc % 5 <> 0"), at, 8)
    word_index.replace_documents(at, c.where("doc % 5 = 0 or doc % 7 = 0"), c.where("(doc % 5 = 0 and doc % 7 <> 0) or (doc % 7 = 0 and page = 1)"), 8)
    word_index.replace_documents(at, c.where("doc % 11 = 0"), None, 8)
    plan = _plan(spark, sf)
    index, lengths = word_index.read_index(spark, at, plan)
    return lexical.bm25(lexical.stored_hits(index, plan), plan, lengths)


def join_eligible(spark, sf):
    """Chunks that also have a vector under the scope: here, those of documents with an even id."""
    vectors = _vectors(spark, sf).where("doc % 2 = 0").select("chunk_id", F.lit("small").alias("model_id"))
    return inputs.chunks(spark, sf).join(vectors.where("model_id = 'small'"), "chunk_id", "left_semi").select("chunk_id")


def txt_plain(spark, sf):
    return inputs.structured(spark, sf).select("doc", "page", plain(F.col("markdown")).alias("plain"))


def txt_fingerprint_ids(spark, sf):
    t = F.col("text")
    c = inputs.chunks(spark, sf)
    c = c.select(chunk_id(F.col("doc"), "balanced", 4, F.col("page"), F.lit(0), F.lit(0), t).alias("chunk_id"), fingerprint(t).alias("fingerprint"))
    counts = c.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    return c.join(counts, "fingerprint").select("chunk_id", "fingerprint", "copies")


def agg_retrieval_metrics(spark, sf):
    """Do the queries find a passage with the text that they were taken from? Best place of a chunk of such a document."""
    truth = inputs.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("whole"))
    ranked = search.top_fused(_fused(spark, sf)).join(docs, "doc").join(inputs.queries(spark, sf).select("query_id", "item_id"), "query_id").join(truth, "item_id")
    best = ranked.where(F.col("whole").contains(F.col("passage"))).groupBy("query_id").agg(F.min("place").alias("p"))
    asked = inputs.queries(spark, sf).where("query_id % 3 < 2").select("query_id").join(best, "query_id", "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return asked.agg(share(F.col("p") == 1).alias("accuracy_at_1"), share(F.col("p") <= 5).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("p"), F.lit(0.0))), 6).alias("mrr"))


QUERIES = {
    f.__name__: f
    for f in (
        txt_tokenize_index, txt_query_plan, join_phrase, agg_doc_stats, agg_bm25, top_exact, agg_embed_bow, join_semantic, flt_min_score, top_semantic,
        join_fuse_rrf, win_doc_cap, top_fused, top_reading_order, join_late_text, txt_snippets, top_depth_ladder, library_search, join_eligible,
        top_in_document, inc_word_index, txt_plain, txt_fingerprint_ids, agg_retrieval_metrics,
    )
}

_LEX = "prose chunks postings queries parts phrase_tf matches bm25"
_ALL = _LEX + " bow semantic"
_FUSED = """,
placed_s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM semantic) WHERE place <= 50),
placed_e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM exact) WHERE place <= 50),
fused AS (SELECT query_id, chunk_id, doc, round(coalesce(1.0 / (60 + s.place), 0) + coalesce(1.0 / (60 + e.place), 0), 9) AS score, s.score AS semantic_score,
  concat_ws(',', CASE WHEN s.place IS NOT NULL THEN 'semantic' END, CASE WHEN e.place IS NOT NULL THEN 'exact' END) AS matched_by
  FROM placed_s s FULL JOIN placed_e e USING (query_id, chunk_id, doc)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN matched_by LIKE '%,%' THEN 1 ELSE 0 END DESC, semantic_score DESC NULLS LAST, chunk_id) AS place FROM fused)
"""
_PLAIN = """trim(regexp_replace(array_to_string(list_transform(list_filter(string_split({0}, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*\\|[\\s:|-]+\\|\\s*$')),
  lambda x: regexp_replace(replace(regexp_replace(regexp_replace(x, '^\\s*#{{1,6}}\\s+', ''), '^\\s*([-*+]|\\d+\\.)\\s+', ''), '|', ' '), '\\*\\*|__|\\*|_|`', '', 'g')), ' '), '\\s+', ' ', 'g'))"""


def plain_sql(column: str) -> str:
    return _PLAIN.format(column)


def snippet_sql(column: str) -> str:
    p = plain_sql(column)
    return f"CASE WHEN length({p}) > 260 THEN concat({p}[1:257], '...') ELSE {p} END"


def _fused_sql(body: str) -> str:
    return with_ctes(_ALL, _FUSED + body)


def _ladder_sql(body: str, before: str = "", s: str = "semantic", e: str = "exact", ctes: str = _ALL) -> str:
    return with_ctes(
        ctes,
        before + f""",
ladder AS (SELECT unnest([50, 100, 200, 400, 800, 1600]) AS depth),
all_s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM {s}),
all_e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM {e}),
ls AS (SELECT * FROM all_s, ladder WHERE place <= depth), le AS (SELECT * FROM all_e, ladder WHERE place <= depth),
filled AS (SELECT query_id, depth, bool_or(n >= depth) AS is_full FROM (SELECT query_id, depth, count(*) AS n FROM ls GROUP BY ALL UNION ALL SELECT query_id, depth, count(*) FROM le GROUP BY ALL) GROUP BY ALL),
fused AS (SELECT query_id, depth, chunk_id, doc, round(coalesce(1.0 / (60 + s.place), 0) + coalesce(1.0 / (60 + e.place), 0), 9) AS score, s.score AS semantic_score,
  concat_ws(',', CASE WHEN s.place IS NOT NULL THEN 'semantic' END, CASE WHEN e.place IS NOT NULL THEN 'exact' END) AS matched_by FROM ls s FULL JOIN le e USING (query_id, depth, chunk_id, doc)),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, depth, doc ORDER BY score DESC, CASE WHEN matched_by LIKE '%,%' THEN 1 ELSE 0 END DESC, semantic_score DESC NULLS LAST, chunk_id) AS n FROM fused) WHERE n <= 3),
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, depth ORDER BY score DESC, CASE WHEN matched_by LIKE '%,%' THEN 1 ELSE 0 END DESC, semantic_score DESC NULLS LAST, chunk_id) AS place FROM capped) WHERE place <= 12),
chosen AS (SELECT query_id, min(depth) AS depth FROM (SELECT query_id, depth, count(*) AS n FROM short GROUP BY ALL) JOIN filled USING (query_id, depth) WHERE n >= 12 OR NOT is_full OR depth = 1600 GROUP BY ALL),
answer AS (SELECT short.*, (depth = 1600 AND is_full AND (count(*) OVER (PARTITION BY query_id)) < 12) AS candidates_truncated FROM short JOIN chosen USING (query_id, depth) JOIN filled USING (query_id, depth))
{body}""",
    )


SQL = {
    "txt_tokenize_index": with_ctes("prose chunks postings", "SELECT token, chunk_id, CAST(count(*) AS INT) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM occurrences GROUP BY token, chunk_id"),
    "txt_query_plan": with_ctes(
        "queries",
        """, asked AS (SELECT query_id, text, CASE WHEN query_id % 2 = 0 THEN 'hybrid' ELSE 'exact' END AS mode, 0.24::DOUBLE AS min_score, false AS explicit FROM queries
  UNION ALL SELECT * FROM (VALUES (-1, '--', 'hybrid', 0.24, false), (-2, '()', 'exact', 0.24, false), (-3, 'a' || chr(1) || 'b', 'exact', 0.24, false), (-4, 'word', 'exact', 0.3, true), (-5, repeat('w ', 40), 'exact', 0.24, false))),
split AS (SELECT *, list_transform(regexp_extract_all(text, '"[^"]*"|[^\\s"]+'), lambda p: regexp_extract_all(strip_accents(lower(p)), '[\\p{L}\\p{N}\\p{Co}]+')) AS p FROM asked),
planned AS (SELECT *, list_filter(p, lambda t: len(t) > 0) AS w, regexp_matches(text, '[\\x00-\\x08]') OR len(p) > 32 OR (mode = 'exact' AND explicit) AS refused FROM split),
status AS (SELECT query_id, min_score, CASE WHEN refused THEN 'refused' WHEN len(w) = 0 AND mode = 'exact' THEN 'no-words' ELSE 'ok' END AS status, CASE WHEN mode = 'hybrid' AND len(w) = 0 THEN 'semantic' ELSE mode END AS mode, w FROM planned),
parts AS (SELECT query_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS part FROM status WHERE status = 'ok' AND mode <> 'semantic'),
tokens AS (SELECT query_id, part, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS token_no FROM parts)
SELECT query_id, status, mode, min_score, part, token_no, token FROM status LEFT JOIN tokens USING (query_id)""",
    ),
    "join_phrase": with_ctes("prose chunks postings queries parts phrase_tf matches", "SELECT query_id, part - 1 AS part, chunk_id, tf FROM phrase_tf JOIN matches USING (query_id, chunk_id)"),
    "agg_doc_stats": with_ctes("prose chunks postings", "SELECT token, count(DISTINCT (chunk_id)) AS df, (SELECT count(*) FROM words) AS n, (SELECT round(avg(len(t)), 6) FROM words) AS avgdl FROM occurrences GROUP BY token"),
    "agg_bm25": with_ctes(_LEX, "SELECT query_id, chunk_id, doc, rank FROM exact"),
    "top_exact": with_ctes(_LEX, "SELECT query_id, chunk_id, doc, score, rank FROM (SELECT query_id, chunk_id, doc, rank AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM exact) WHERE rank <= 10"),
    "agg_embed_bow": with_ctes("prose chunks queries bow", "SELECT chunk_id, slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)), 6) AS x FROM chunk_counts"),
    "join_semantic": "SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0",
    "flt_min_score": with_ctes("prose chunks queries bow semantic", "SELECT query_id, chunk_id, score FROM semantic"),
    "top_semantic": with_ctes("prose chunks queries bow semantic", "SELECT query_id, chunk_id, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM semantic) WHERE rank <= 10"),
    "join_fuse_rrf": _fused_sql("SELECT * FROM fused"),
    "win_doc_cap": _fused_sql(
        "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY place) AS n FROM ordered) WHERE n <= 3"
    ),
    "top_fused": _fused_sql("SELECT query_id, place AS rank, chunk_id FROM ordered WHERE place <= 12"),
    "top_reading_order": _fused_sql("SELECT query_id, o.doc, row_number() OVER (PARTITION BY query_id, o.doc ORDER BY page, score DESC, chunk_id) AS seq, page, chunk_id FROM ordered o JOIN chunks USING (chunk_id) WHERE place <= 40"),
    "join_late_text": _fused_sql("SELECT query_id, place AS rank, chunk_id, page, length(text) AS chars FROM ordered JOIN chunks USING (chunk_id) WHERE place <= 12"),
    "txt_snippets": _fused_sql(f"""SELECT query_id, chunk_id, {snippet_sql('text')} AS snippet,
  CASE WHEN o.doc % 5 = 0 THEN '' WHEN page < 3 THEN 'Title' ELSE concat('Title > Part ', page // 3 * 3) END AS heading_path, o.doc % 5 <> 0 AND CASE WHEN page < 3 THEN o.doc % 7 <> 0 AND page <> 1 ELSE page % 3 <> 0 END AS heading_inherited
FROM ordered o JOIN chunks USING (chunk_id) WHERE place <= 12"""),
    "top_depth_ladder": _ladder_sql("SELECT query_id, depth, chunk_id, place AS rank, candidates_truncated FROM answer"),
    "library_search": _ladder_sql(
        f"""SELECT query_id, status, mode, place AS rank, chunk_id, a.doc, page, score, semantic_score, matched_by, CASE WHEN text IS NOT NULL THEN {snippet_sql('text')} END AS snippet, coalesce(candidates_truncated, false) AS candidates_truncated,
  content_hash, regexp_extract(path, '([^/]*)$', 1) AS name, path, last_opened AS snapshot_recorded_at, documents_searched, documents_not_discoverable, documents_outside_scope
FROM modes LEFT JOIN answer a USING (query_id) LEFT JOIN chunks USING (chunk_id) LEFT JOIN catalogue ON catalogue.doc = a.doc, counts""",
        """, latest AS (SELECT doc, path, path_provenance FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_opened DESC, doc DESC) AS n FROM catalogue WHERE path IS NOT NULL) WHERE n = 1),
seen AS (SELECT DISTINCT doc FROM latest JOIN roots ON path = root OR (starts_with(path, root || '/') AND path[length(root) + 2 : length(root) + 3] <> '..') WHERE path_provenance = 'resolved'),
inside AS (SELECT DISTINCT doc FROM chunks WHERE doc % 23 <> 5 AND doc % 40 <> 1 AND doc % 17 <> 3), searched AS (SELECT doc FROM seen JOIN inside USING (doc)),
counts AS (SELECT (SELECT count(*) FROM searched) AS documents_searched, (SELECT count(*) FROM latest) - (SELECT count(*) FROM seen) AS documents_not_discoverable, (SELECT count(*) FROM seen) - (SELECT count(*) FROM searched) AS documents_outside_scope),
said AS (SELECT query_id, CASE WHEN query_id % 5 = 3 THEN 'semantic' WHEN query_id % 5 >= 2 THEN 'exact' ELSE 'hybrid' END AS m, query_id % 5 = 4 AND query_id % 2 = 0 AS refused, (SELECT count(*) FROM part_tokens p WHERE p.query_id = q.query_id) AS w FROM queries q),
modes AS (SELECT query_id, CASE WHEN refused THEN 'refused' WHEN w = 0 AND m = 'exact' THEN 'no-words' ELSE 'ok' END AS status, CASE WHEN w = 0 AND m = 'hybrid' THEN 'semantic' ELSE m END AS mode FROM said),
sem AS (SELECT semantic.* FROM semantic JOIN searched USING (doc) JOIN modes USING (query_id) WHERE status = 'ok' AND mode <> 'exact'),
exa AS (SELECT exact.* FROM exact JOIN searched USING (doc) JOIN modes USING (query_id) WHERE status = 'ok' AND mode <> 'semantic')""",
        "sem", "exa", _ALL + " catalogue roots",
    ),
    "top_in_document": with_ctes(
        _ALL,
        ", sem AS (SELECT * FROM semantic WHERE doc = query_id), exa AS (SELECT * FROM exact WHERE doc = query_id)"
        + _FUSED.replace("FROM semantic", "FROM sem").replace("FROM exact", "FROM exa")
        + "SELECT query_id, o.doc, row_number() OVER (PARTITION BY query_id, o.doc ORDER BY page, score DESC, chunk_id) AS seq, page, chunk_id, matched_by FROM ordered o JOIN chunks USING (chunk_id) WHERE place <= 12",
    ),
    "inc_word_index": with_ctes(_LEX.replace("chunks", "indexed"), "SELECT query_id, chunk_id, doc, rank FROM exact"),
    "join_eligible": with_ctes("prose chunks", "SELECT chunk_id FROM chunks WHERE doc % 2 = 0"),
    "txt_plain": with_ctes("structured", f"SELECT doc, page, {plain_sql('markdown')} AS plain FROM structured"),
    "txt_fingerprint_ids": with_ctes(
        "prose chunks",
        ", f AS (SELECT *, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')))[1:16] AS fingerprint FROM chunks) SELECT concat_ws(':', doc, 'balanced', 4, page, 0, 0, fingerprint) AS chunk_id, fingerprint, count(*) OVER (PARTITION BY fingerprint) AS copies FROM f",
    ),
    "agg_retrieval_metrics": _fused_sql(
        """, best AS (SELECT query_id, min(place) AS p FROM ordered JOIN documents ON doc = doc_id JOIN queries q USING (query_id) JOIN benchmark b ON b.item_id = q.item_id
  WHERE place <= 12 AND contains(documents.text, b.text) GROUP BY ALL)
SELECT round(avg(CASE WHEN p = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy_at_1, round(avg(CASE WHEN p <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / p, 0)), 6) AS mrr
FROM queries LEFT JOIN best USING (query_id) WHERE query_id % 3 < 2"""
    ),
}
