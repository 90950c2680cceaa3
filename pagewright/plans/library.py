"""Registered queries of the catalogue and of incremental work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import bow_vector
from pagewright.operators import catalog, lexical
from pagewright.plans import inputs
from pagewright.plans.inputs import with_ctes
from pagewright.sources import files, passages

CURRENT = {"text_version": 2, "ocr_version": 1, "engine": "standard", "markdown_version": 3}


def win_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_versions(inputs.catalogue(spark, sf)).select("doc", "path")


def set_library_union(spark, sf):
    """The same rows, as the union that it is: versioned paths and rows without a path."""
    return catalog.latest_versions(inputs.catalogue(spark, sf)).select("doc")


def flt_discoverable(spark, sf):
    return catalog.discoverable(catalog.latest_versions(inputs.catalogue(spark, sf)), inputs.roots(spark)).select("doc", "path")


def agg_library_counts(spark, sf):
    return catalog.library_counts(inputs.catalogue(spark, sf), inputs.roots(spark), inputs.chunks(spark, sf).where("doc % 4 <> 1"))


def join_library_target(spark, sf):
    """A document that is open (one in five here) is switched to; one with a path is opened; others are unavailable."""
    d = inputs.catalogue(spark, sf)
    tabs = d.where("doc % 5 = 0").groupBy("content_hash").agg(F.min("doc").alias("tab"))
    d = d.join(tabs, "content_hash", "left")
    action = F.when(F.col("tab").isNotNull(), "switch").when(F.col("path").isNotNull(), "open").otherwise("unavailable")
    target = F.when(F.col("tab").isNotNull(), F.concat(F.lit("tab-"), F.col("tab").cast("string"))).otherwise(F.col("path"))
    return d.select("doc", action.alias("action"), target.alias("target"))


def src_content_hash(spark, sf):
    d = inputs.catalogue(spark, sf).groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"), F.max("bytes").alias("bytes"))
    return d.withColumnRenamed("content_hash", "hash")


def top_recent_documents(spark, sf):
    return inputs.catalogue(spark, sf).orderBy(F.col("last_opened").desc(), F.col("doc").desc()).limit(100).select("doc")


def agg_store_info(spark, sf):
    d, c = inputs.catalogue(spark, sf), inputs.chunks(spark, sf)
    n = d.agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))
    m = c.agg(F.count(F.lit(1)).alias("chunks"))
    return n.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(inputs.table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("embeddings"))))  # one row each


def _records(spark, sf):
    """The catalogue with all columns of a stored document."""
    k = F.col("doc")
    d = inputs.catalogue(spark, sf).withColumn("created", F.col("last_opened") % 1000).withColumnRenamed("bytes", "size")
    return d.select(
        "doc", "content_hash", F.concat(F.lit("name "), k % 7).alias("name"), "path", "path_provenance", "size", "page_count", F.when(k % 4 == 0, "ocr").otherwise("pdf").alias("text_source"),
        "text_version", (k % 3).cast("int").alias("ocr_version"), F.when(k % 5 != 1, F.concat(F.lit("engine "), k % 2)).alias("engine"), F.when(k % 6 != 1, (k % 9).cast("int")).alias("markdown_version"), "created", "last_opened",
    )


def inc_upsert_documents(spark, sf):
    d = _records(spark, sf)
    return catalog.upsert(d.where("doc % 2 = 0"), d.where("doc % 2 = 1"))


def _chunk_table(spark, sf):
    return inputs.chunks(spark, sf).withColumn("chunk_version", (3 + F.col("doc") % 2).cast("int")).withColumn("profile", F.when(F.col("page") % 2 == 0, "precise").otherwise("balanced"))


def _claims(spark, sf):
    return inputs.catalogue(spark, sf).where("doc % 3 <> 1").select("doc")


def _reusable(spark, sf):
    k = F.col("doc")
    d = inputs.catalogue(spark, sf).withColumn("ocr_version", F.when(k % 13 == 0, 2).otherwise(1)).withColumn("engine", F.when(k % 17 == 0, "visual").otherwise("standard")).withColumn("markdown_version", F.when(k % 19 == 0, 2).otherwise(3))
    return catalog.reusable(d.select("content_hash"), d, inputs.extracted(spark, sf), _claims(spark, sf), inputs.chunks(spark, sf), CURRENT)


def join_reuse(spark, sf):
    return _reusable(spark, sf)


def inc_index_new(spark, sf):
    """Chunks of the documents whose index can't be reused."""
    keep = _reusable(spark, sf).where("reusable").select("doc")
    return inputs.chunks(spark, sf).join(keep, "doc", "left_anti").select("doc", "chunk_id")


def inc_rechunk_on_version(spark, sf):
    return catalog.stale(_chunk_table(spark, sf), 4)


def _store(spark, tables, docs, buckets=8):
    store = passages.passages(spark, f"{files.shared_folder(spark)}/passages-{uuid.uuid4().hex}", buckets)
    passages.fill(store, tables, docs)
    return store


def _scoped(spark, sf):
    """Chunks in scopes: two profiles by page, three versions by document, vectors of one model."""
    c = inputs.chunks(spark, sf).withColumn("profile", F.when(F.col("page") % 2 == 0, "precise").otherwise("balanced")).withColumn("version", (3 + F.col("doc") % 3).cast("int"))
    return c.withColumn("idx", F.lit(0)).withColumn("heading_path", F.lit("[]")).withColumn("vector", bow_vector(F.col("text")))


SCOPE = passages.Scope("precise", 4, "small", 1, 64)


def _tables(c):
    vectors = c.withColumn("model", F.lit(SCOPE.model)).withColumn("model_version", F.lit(1)).withColumn("dims", F.lit(64))
    claims = vectors.select("doc", "profile", "version", "model", "model_version", "dims").distinct().withColumn("written", F.lit(1).cast("long"))
    return {"chunks": c, "vectors": vectors, "claims": claims}


def inc_replace_scope(spark, sf):
    """Every tenth document is read again: its scope is replaced, its new chunks come in, and it claims to be complete. Of
    some a chunk is missing, of some there is no text. What the store then holds: chunks and claims, and what was said."""
    c = _scoped(spark, sf)
    store = _store(spark, _tables(c), c.select("doc"))
    docs = c.where("doc % 10 = 0").select("doc").distinct()
    new = c.where("doc % 10 = 0 and page % 2 = 0").withColumn("chunk_id", F.concat("chunk_id", F.lit(":new")))
    passages.begin_replace(store, docs, SCOPE)
    passages.insert(store, new, SCOPE)
    expected = new.select("doc", "chunk_id").unionByName(docs.where("doc % 20 = 10").select("doc", F.concat("doc", F.lit(":lost")).alias("chunk_id")))
    pages = inputs.extracted(spark, sf).where("doc % 10 = 0 and doc % 30 <> 0")
    told = passages.complete(store, docs, SCOPE, expected, pages, 2)
    kinds = {"chunk": (store.read("chunks"), "chunk_id"), "claim": (store.read("claims"), "model"), "outcome": (told.withColumn("profile", F.lit(SCOPE.profile)).withColumn("version", F.lit(SCOPE.version)), "outcome")}
    out = None
    for kind, (t, said) in kinds.items():
        rows = t.select(F.lit(kind).alias("kind"), "doc", "profile", "version", F.col(said).alias("said"))
        out = rows if out is None else out.unionByName(rows)
    return out


def inc_forget(spark, sf):
    """Every ninth document is taken out of all tables of a stored library; what each table keeps and has lost."""
    c = _scoped(spark, sf)
    store = _store(spark, {**_tables(c), "documents": _records(spark, sf), "pages": inputs.extracted(spark, sf), "postings": lexical.postings(c), "lengths": lexical.chunk_lengths(c)}, inputs.catalogue(spark, sf).select("doc"))
    return passages.forget(store, inputs.catalogue(spark, sf).where("doc % 9 = 4"))


def join_exact_chunks(spark, sf):
    c = inputs.chunks(spark, sf)
    return catalog.exact_chunks(c, c, c.where("(doc * 31 + page) % 40 <> 0"), _claims(spark, sf))


def join_missing_postings(spark, sf):
    """A stored library of which every fifth document has no word index: batches fill it in until none is missing. The
    length of each chunk and the number of its words, as stored."""
    c = _scoped(spark, sf)
    known = c.where("doc % 5 <> 0")
    store = _store(spark, {"chunks": c, "postings": lexical.postings(known), "lengths": lexical.chunk_lengths(known)}, c.select("doc"), 4)
    passages.complete_index(store)
    words = store.read("postings").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("words"))
    return store.read("lengths").join(words, "chunk_id", "left").select("chunk_id", "len", F.coalesce("words", F.lit(0)).alias("words"))


def set_chunk_difference(spark, sf):
    c = inputs.chunks(spark, sf)
    return catalog.chunk_difference(c.where("(doc + page) % 6 <> 0"), c.where("(doc + page) % 7 <> 0"))


def join_orphans(spark, sf):
    c = inputs.chunks(spark, sf)
    return catalog.orphans(inputs.catalogue(spark, sf).where("doc % 8 <> 3"), c.where("page % 5 <> 0"), c.where("doc % 2 = 0"))


def flt_scope(spark, sf):
    """Chunks of one profile and version that have a vector of the model."""
    c = _chunk_table(spark, sf).where("profile = 'balanced' and chunk_version = 4")
    vectors = inputs.chunks(spark, sf).where("doc % 3 <> 2").select("chunk_id", F.lit("small").alias("model_id"), F.lit(384).alias("dims"))
    return c.join(vectors.where("model_id = 'small' and dims = 384"), "chunk_id", "left_semi").select("chunk_id", "doc")


QUERIES = {
    f.__name__: f
    for f in (
        win_latest_version, set_library_union, flt_discoverable, agg_library_counts, join_library_target, src_content_hash, top_recent_documents, agg_store_info,
        inc_upsert_documents, join_reuse, inc_index_new, inc_rechunk_on_version, inc_replace_scope, inc_forget, join_exact_chunks, join_missing_postings, set_chunk_difference, join_orphans, flt_scope,
    )
}

_LATEST = ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_opened DESC, doc DESC) AS n FROM catalogue) WHERE n = 1 OR path IS NULL)"
_SEEN = _LATEST + ", seen AS (SELECT DISTINCT doc, path FROM latest JOIN roots ON path = root OR (starts_with(path, root || '/') AND path[length(root) + 2 : length(root) + 3] <> '..') WHERE path_provenance = 'resolved')"
_REUSE = """, state AS (SELECT doc, count(*) FILTER (status = 'unresolved') AS o, bool_and(regexp_replace(markdown, '\\s', '', 'g') = '') AS blank, count(DISTINCT page) AS cached FROM extracted GROUP BY doc),
n AS (SELECT doc, count(*) AS chunk_count FROM chunks GROUP BY doc),
reuse AS (SELECT DISTINCT doc, (text_version = 2 AND doc % 13 <> 0 AND doc % 17 <> 0 AND doc % 19 <> 0 AND doc % 3 <> 1 AND coalesce(o, 1) = 0 AND coalesce(cached = page_count, false) AND (coalesce(chunk_count, 0) > 0 OR coalesce(blank, true))) AS reusable, coalesce(chunk_count, 0) AS chunk_count
  FROM catalogue LEFT JOIN state USING (doc) LEFT JOIN n USING (doc))"""

SQL = {
    "win_latest_version": with_ctes("catalogue", _LATEST + "SELECT doc, path FROM latest"),
    "set_library_union": with_ctes("catalogue", _LATEST + "SELECT doc FROM latest"),
    "flt_discoverable": with_ctes("catalogue roots", _SEEN + "SELECT doc, path FROM seen"),
    "agg_library_counts": with_ctes(
        "catalogue roots prose chunks",
        _SEEN + ", has AS (SELECT DISTINCT doc FROM chunks WHERE doc % 4 <> 1) SELECT count(*) FILTER (s.doc IS NOT NULL AND h.doc IS NOT NULL) AS searched, count(*) FILTER (s.doc IS NULL) AS not_discoverable, count(*) FILTER (s.doc IS NOT NULL AND h.doc IS NULL) AS outside_scope FROM latest l LEFT JOIN seen s ON l.doc = s.doc LEFT JOIN has h ON l.doc = h.doc WHERE l.path IS NOT NULL",
    ),
    "join_library_target": with_ctes(
        "catalogue",
        ", tabs AS (SELECT content_hash, min(doc) AS tab FROM catalogue WHERE doc % 5 = 0 GROUP BY 1) SELECT doc, CASE WHEN tab IS NOT NULL THEN 'switch' WHEN path IS NOT NULL THEN 'open' ELSE 'unavailable' END AS action, CASE WHEN tab IS NOT NULL THEN 'tab-' || tab ELSE path END AS target FROM catalogue LEFT JOIN tabs USING (content_hash)",
    ),
    "src_content_hash": with_ctes("catalogue", "SELECT content_hash AS hash, count(*) AS copies, min(path) AS first_path, max(bytes) AS bytes FROM catalogue GROUP BY 1"),
    "top_recent_documents": with_ctes("catalogue", "SELECT doc FROM catalogue ORDER BY last_opened DESC, doc DESC LIMIT 100"),
    "agg_store_info": with_ctes("catalogue prose chunks", "SELECT (SELECT count(*) FROM catalogue) AS documents, (SELECT CAST(sum(bytes) AS BIGINT) FROM catalogue) AS bytes, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS embeddings"),
    "inc_upsert_documents": with_ctes(
        "catalogue",
        """, r AS (SELECT doc, content_hash, 'name ' || doc % 7 AS name, path, path_provenance, bytes AS size, page_count, CASE WHEN doc % 4 = 0 THEN 'ocr' ELSE 'pdf' END AS text_source, text_version, CAST(doc % 3 AS INT) AS ocr_version,
  CASE WHEN doc % 5 <> 1 THEN 'engine ' || doc % 2 END AS engine, CASE WHEN doc % 6 <> 1 THEN CAST(doc % 9 AS INT) END AS markdown_version, last_opened % 1000 AS created, last_opened,
  row_number() OVER (PARTITION BY content_hash ORDER BY doc % 2, last_opened, doc) AS place FROM catalogue)
SELECT content_hash, arg_min(doc, place) AS doc, arg_max({'x': name}, place).x AS name, arg_max({'x': path}, place).x AS path, arg_max({'x': path_provenance}, place).x AS path_provenance, arg_max(size, place) AS size, arg_max({'x': page_count}, place).x AS page_count, arg_max(text_source, place) AS text_source,
  coalesce(arg_max(text_version, place) FILTER (text_version <> 0), 0) AS text_version, coalesce(arg_max(ocr_version, place) FILTER (ocr_version <> 0), 0) AS ocr_version, arg_max(engine, place) FILTER (engine IS NOT NULL) AS engine, arg_max(markdown_version, place) FILTER (markdown_version IS NOT NULL) AS markdown_version,
  arg_min(created, place) AS created, arg_max(last_opened, place) AS last_opened FROM r GROUP BY 1""",
    ),
    "join_reuse": with_ctes("catalogue prose extracted chunks", _REUSE + "SELECT * FROM reuse"),
    "inc_index_new": with_ctes("catalogue prose extracted chunks", _REUSE + "SELECT doc, chunk_id FROM chunks WHERE doc NOT IN (SELECT doc FROM reuse WHERE reusable)"),
    "inc_rechunk_on_version": with_ctes("prose chunks", "SELECT DISTINCT doc FROM chunks WHERE 3 + doc % 2 <> 4"),
    "inc_replace_scope": with_ctes(
        "prose chunks",
        """, t AS (SELECT doc, CASE WHEN page % 2 = 0 THEN 'precise' ELSE 'balanced' END AS profile, CAST(3 + doc % 3 AS INT) AS version, chunk_id, page FROM chunks),
gone AS (SELECT *, doc % 10 = 0 AND (version < 4 OR (version = 4 AND profile = 'precise')) AS gone FROM t),
told AS (SELECT DISTINCT doc, CASE WHEN doc % 20 = 10 THEN 'conflicted' WHEN doc % 30 = 0 THEN 'unclaimed' ELSE 'claimed' END AS said FROM t WHERE doc % 10 = 0)
SELECT 'chunk' AS kind, doc, profile, version, chunk_id AS said FROM gone WHERE NOT gone
UNION ALL SELECT 'chunk', doc, 'precise', 4, chunk_id || ':new' FROM t WHERE doc % 10 = 0 AND page % 2 = 0
UNION ALL SELECT DISTINCT 'claim', doc, profile, version, 'small' FROM gone WHERE NOT gone AND doc NOT IN (SELECT doc FROM told WHERE said = 'claimed')
UNION ALL SELECT 'claim', doc, 'precise', 4, 'small' FROM told WHERE said = 'claimed'
UNION ALL SELECT 'outcome', doc, 'precise', 4, said FROM told""",
    ),
    "inc_forget": with_ctes(
        "catalogue prose chunks postings",
        """, t AS (SELECT 'documents' AS "table", doc FROM catalogue UNION ALL SELECT k, doc FROM chunks, (VALUES ('chunks'), ('vectors'), ('lengths')) v(k) UNION ALL SELECT 'pages', doc FROM prose
  UNION ALL SELECT 'postings', doc FROM (SELECT DISTINCT chunk_id, doc, token FROM occurrences) UNION ALL SELECT 'claims', doc FROM (SELECT DISTINCT doc, page % 2 FROM chunks))
SELECT "table", count(*) FILTER (doc % 9 <> 4) AS kept, count(*) FILTER (doc % 9 = 4) AS removed FROM t GROUP BY 1""",
    ),
    "join_exact_chunks": with_ctes("prose chunks", "SELECT doc, CASE WHEN bool_or((doc * 31 + page) % 40 = 0) THEN 'conflicted' WHEN doc % 3 <> 1 THEN 'claimed' ELSE 'unclaimed' END AS outcome FROM chunks GROUP BY doc"),
    "join_missing_postings": with_ctes("prose chunks postings", "SELECT chunk_id, CAST(len(t) AS INT) AS len, len(list_distinct(t)) AS words FROM words"),
    "set_chunk_difference": with_ctes("prose chunks", "SELECT chunk_id, 'add' AS change FROM chunks WHERE (doc + page) % 7 <> 0 AND (doc + page) % 6 = 0 UNION ALL SELECT chunk_id, 'delete' FROM chunks WHERE (doc + page) % 6 <> 0 AND (doc + page) % 7 = 0"),
    "join_orphans": with_ctes("prose chunks", "SELECT 'vector' AS kind, chunk_id AS id FROM chunks WHERE doc % 2 = 0 AND page % 5 = 0 UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE page % 5 <> 0 AND doc % 8 = 3"),
    "flt_scope": with_ctes("prose chunks", "SELECT chunk_id, doc FROM chunks WHERE page % 2 = 1 AND doc % 2 = 1 AND doc % 3 <> 2"),
}
