"""Registered queries of Markdown structure and chunking, over customers' orders as documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import wordpieces
from pagewright.operators import blocks, chunking, inline
from pagewright.plans import inputs
from pagewright.plans.inputs import with_ctes
from pagewright.plans.retrieval import plain_sql
from pagewright.sources import files


def _blocks(spark, sf):
    return blocks.blocks(inputs.structured(spark, sf))


def win_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf)


def win_heading_path(spark, sf):
    h = blocks.heading_paths(_blocks(spark, sf))
    return h.select("doc", "pos", F.array_join(F.transform("headings", lambda x: F.concat(x["title"], F.lit("@"), x["page"].cast("string"))), " / ").alias("headings"))


def win_outline(spark, sf):
    return blocks.page_outline(inputs.structured(spark, sf), 2)


def win_outline_parents(spark, sf):
    return blocks.outline_parents(blocks.page_outline(inputs.structured(spark, sf)))


def agg_running_text(spark, sf):
    return blocks.running_in(inputs.structured(spark, sf))


def win_label_fold(spark, sf):
    f = blocks.fold_pages(inputs.structured(spark, sf))
    return f.select("doc", "pos", "role", F.array_join("local_headings", "|").alias("local_headings"))


def win_chunk_index(spark, sf):
    """Blocks that make chunks, numbered within their page from 0."""
    from pyspark.sql import Window

    f = blocks.fold_pages(inputs.structured(spark, sf)).where("role = 'chunk'")
    return f.select("doc", "page", "pos", (F.row_number().over(Window.partitionBy("doc", "page").orderBy("pos")) - 1).alias("idx"))


def txt_chunk_corpus(spark, sf):
    c = chunking.chunk_corpus(inputs.structured(spark, sf), budget=60, count=wordpieces.counter(_vocabulary(spark, sf)))
    return c.select("chunk_id", "doc", "page", "idx", "part", "text", "embed_text", F.array_join("local_headings", "|").alias("local_headings"))


def _roomy(spark, sf, kind):
    b = _blocks(spark, sf).where(F.col("kind") == "table") if kind == "table" else blocks.blocks(inputs.prose(spark, sf)).where("kind = 'paragraph'")
    return b.withColumn("room", (F.lit(30) + F.col("pos") % 20).cast("int"))


def _cut(spark, sf, kind):
    return chunking.cut_blocks(_roomy(spark, sf, kind))


def txt_chunk_prose(spark, sf):
    return _cut(spark, sf, "paragraph").select("doc", "pos", "part", "part_count", "text")


def txt_chunk_tables(spark, sf):
    return _cut(spark, sf, "table").select("doc", "pos", "part", "part_count", "text", "embed_prefix")


def txt_reassemble(spark, sf):
    t, p = (chunking.cut_losslessly(_roomy(spark, sf, kind)).withColumn("kind", F.lit(kind)) for kind in ("table", "paragraph"))
    return t.unionByName(p)


def win_word_chunks(spark, sf):
    return chunking.word_windows(inputs.prose(spark, sf), 60, 10)


def agg_truncation_audit(spark, sf):
    """Word windows against an encoder's limit of tokens: what each document gives it, and what it keeps."""
    c = chunking.truncation(chunking.word_windows(inputs.prose(spark, sf)), 510)
    over = F.col("given") > F.col("embedded")
    return c.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(over).alias("over_limit"), F.max("given").alias("largest"), F.sum("given").alias("given"), F.sum("embedded").alias("embedded"))


def _vocabulary(spark, sf):
    """Pieces: every character, within a word too, and the frequent words of conversations."""
    words = inputs.table(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("piece")).where("piece <> ''")
    chars = words.select(F.explode(F.split("piece", "")).alias("piece")).where("piece <> ''").distinct()
    often = words.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("piece")
    return often.unionByName(chars).unionByName(chars.select(F.concat(F.lit("##"), "piece").alias("piece"))).distinct()


def txt_piece_counts(spark, sf):
    """Tokens of pages by word pieces, by quarters of characters, and the larger."""
    pieces = wordpieces.counter(_vocabulary(spark, sf))
    worst = wordpieces.worst_case(pieces, chunking.count_quarters)

    @F.pandas_udf("pieces int, quarters int, worst int")
    def sizes(texts):
        import pandas as pd

        return pd.DataFrame([(pieces(t), chunking.count_quarters(t), worst(t)) for t in texts], columns=["pieces", "quarters", "worst"])

    p = inputs.prose(spark, sf)
    return p.select("doc", "page", sizes("markdown").alias("n")).select("doc", "page", "n.pieces", "n.quarters", "n.worst")


def agg_worst_case_tokens(spark, sf):
    """The larger of two counts: words with their marks, and a quarter of the characters."""
    t = F.col("markdown")
    return inputs.prose(spark, sf).select(F.concat_ws(":", "doc", "page").alias("id"), F.greatest(F.regexp_count(t, F.lit(r"\w+|[^\w\s]")), chunking.size_of(t)).alias("tokens"))


def agg_intact_table_rate(spark, sf):
    """Tables cut to little room, so that some rows are cut as well."""
    b = _blocks(spark, sf).where("kind = 'table'").withColumn("room", (F.lit(14) + F.col("pos") % 8).cast("int"))
    rows = chunking.cut_rows_reaching(b)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("intact").alias("intact"), F.round(F.count_if("intact") / F.count(F.lit(1)), 6).alias("rate"))


def txt_heading_json(spark, sf):
    """Heading lists stored as JSON in two shapes, or broken: titles and pages, never an error."""
    h = blocks.page_outline(inputs.structured(spark, sf))
    entry = F.to_json(F.struct("title", "page"))
    j = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("["), entry, F.lit(']'))).when(F.col("pos") % 3 == 1, F.concat(F.lit('["'), F.col("title"), F.lit('"]'))).otherwise("{broken")
    h = h.withColumn("j", j)
    objects = F.from_json("j", "array<struct<title:string,page:int>>")
    titles = F.transform(F.from_json("j", "array<string>"), lambda t: F.struct(t.alias("title"), F.lit(None).cast("int").alias("page")))
    bare = F.col("j").rlike(r'^\s*\["')
    got = F.coalesce(F.when(bare, titles).otherwise(objects), F.array().cast("array<struct<title:string,page:int>>"))
    got = F.filter(got, lambda x: x["title"].isNotNull())
    return h.select("doc", "pos", F.array_join(F.transform(got, lambda x: F.concat(x["title"], F.lit("@"), F.coalesce(x["page"].cast("string"), F.lit("-")))), "/").alias("headings"))


def txt_embed_inputs(spark, sf):
    """What each model is asked to embed for each query: some models want a prefix."""
    models = spark.createDataFrame([("small", "Represent this sentence for searching relevant passages: "), ("multi", "query: "), ("base", "")], "model_id string, prefix string")
    q = inputs.queries(spark, sf).crossJoin(F.broadcast(models))  # three models
    return q.select(F.col("query_id").alias("id"), "model_id", F.concat("prefix", "text").alias("input"))


def win_anchor_ids(spark, sf):
    return inline.anchor_ids(blocks.page_outline(inputs.structured(spark, sf)))


def src_synthetic_library(spark, sf):
    d = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"))
    return files.synthetic_library(spark, d, 2).select("doc", "chunk_id", "page", "idx", "text")


def sink_passages(spark, sf):
    """Written to the shared folder, in buckets of documents."""
    at = f"{files.shared_folder(spark)}/passages-{uuid.uuid4().hex}"
    c = inputs.chunks(spark, sf)
    return files.write_passages({"chunks": c, "pages": inputs.prose(spark, sf)}, at, 8)


QUERIES = {
    f.__name__: f
    for f in (
        win_blocks, win_heading_path, win_outline, win_outline_parents, agg_running_text, win_label_fold, win_chunk_index, txt_chunk_corpus, txt_chunk_prose, txt_chunk_tables,
        txt_reassemble, win_word_chunks, agg_truncation_audit, txt_piece_counts, agg_worst_case_tokens, agg_intact_table_rate, txt_heading_json, txt_embed_inputs, win_anchor_ids, src_synthetic_library, sink_passages,
    )
}

_BLOCKS = """, lines AS (SELECT doc, page, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc, page, string_split(markdown, chr(10)) AS l FROM {source})),
kinds AS (SELECT *, CASE WHEN trim(line) = '' THEN NULL WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+\\.)\\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM lines),
marked AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS s FROM kinds WINDOW w AS (PARTITION BY doc, page ORDER BY n)),
islands AS (SELECT *, sum(s) OVER (PARTITION BY doc, page ORDER BY n) AS b FROM marked WHERE kind IS NOT NULL),
raw_blocks AS (SELECT doc, page, b, kind, trim(string_agg(line, chr(10) ORDER BY n)) AS text FROM islands GROUP BY doc, page, b, kind),
blocks AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, b) - 1 AS INT) AS pos, page, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^(#+)', 1)) END AS level,
  CASE WHEN kind = 'heading' THEN trim(regexp_extract(text, '^#+\\s+(.*)$', 1)) END AS title, text FROM raw_blocks)
"""
_RUN = (
    """, plains AS (SELECT *, """ + plain_sql("text") + """ AS plain FROM blocks), totals AS (SELECT doc, count(*) AS total FROM structured GROUP BY doc),
running AS (SELECT doc, plain, count(DISTINCT page) AS pages FROM plains JOIN totals USING (doc) WHERE kind = 'paragraph' AND length(plain) BETWEEN 1 AND 80 GROUP BY doc, plain, total HAVING count(DISTINCT page) >= greatest(3, ceil(0.4 * total)))
"""
)
_FOLD = """, roles AS (SELECT p.*, kind = 'paragraph' AND r.doc IS NOT NULL AS run FROM plains p LEFT JOIN running r ON p.doc = r.doc AND p.plain = r.plain),
labs AS (SELECT *, NOT run AND kind = 'paragraph' AND length(plain) BETWEEN 1 AND 48 AND NOT regexp_matches(plain, '[.!?…]') AND NOT contains(text, chr(10)) AND
  ((length(text) > 4 AND ((starts_with(text, '**') AND ends_with(text, '**')) OR (starts_with(text, '__') AND ends_with(text, '__')))) OR (regexp_matches(plain, '[A-Za-z]') AND length(regexp_replace(plain, '[^A-Z ]', '', 'g')) / length(plain) >= 0.8)) AS lab FROM roles),
targets AS (SELECT *, CASE WHEN lab THEN (min(CASE WHEN NOT run AND NOT lab THEN pos END) OVER (PARTITION BY doc, page ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) END AS t FROM labs),
folded AS (SELECT doc, t AS pos, string_agg(plain, '|' ORDER BY pos) AS local_headings FROM targets WHERE t IS NOT NULL GROUP BY doc, t),
final AS (SELECT a.doc, a.pos, a.page, CASE WHEN run THEN 'running' WHEN a.t IS NOT NULL THEN 'folded' ELSE 'chunk' END AS role, f.local_headings FROM targets a LEFT JOIN folded f ON a.doc = f.doc AND a.pos = f.pos)
"""
_B = _BLOCKS.format(source="structured")


def _path_sql() -> str:
    levels = ", ".join(f"last_value(CASE WHEN level = {k} THEN pos END IGNORE NULLS) OVER w AS p{k}, last_value(CASE WHEN level = {k} THEN title || '@' || page END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))
    kept = ", ".join(f"CASE WHEN p{k} > greatest(-1{''.join(f', coalesce(p{j}, -1)' for j in range(1, k))}) THEN t{k} END" for k in range(1, 7))
    return _B + f", h AS (SELECT doc, pos, {levels} FROM blocks WINDOW w AS (PARTITION BY doc ORDER BY pos)) SELECT doc, pos, array_to_string([{kept}], ' / ') AS headings FROM h"


SQL = {
    "win_blocks": with_ctes("structured", _B + "SELECT * FROM blocks"),
    "win_heading_path": with_ctes("structured", _path_sql()),
    "win_outline": with_ctes("structured", _B + "SELECT doc, pos, level, title, page FROM blocks WHERE kind = 'heading' AND level <= 2"),
    "win_outline_parents": with_ctes("structured", _B + "SELECT a.doc, a.pos, max(b.pos) AS parent_pos FROM blocks a LEFT JOIN blocks b ON a.doc = b.doc AND b.pos < a.pos AND b.level < a.level WHERE a.kind = 'heading' GROUP BY a.doc, a.pos"),
    "agg_running_text": with_ctes("structured", _B + _RUN + "SELECT * FROM running"),
    "win_label_fold": with_ctes("structured", _B + _RUN + _FOLD + "SELECT doc, pos, role, local_headings FROM final"),
    "win_chunk_index": with_ctes("structured", _B + _RUN + _FOLD + "SELECT doc, page, pos, row_number() OVER (PARTITION BY doc, page ORDER BY pos) - 1 AS idx FROM final WHERE role = 'chunk'"),
    "txt_reassemble": with_ctes(
        "prose structured",
        _B + "SELECT doc, pos, true AS lossless, 'table' AS kind FROM blocks WHERE kind = 'table' UNION ALL SELECT doc, pos, true, 'paragraph' FROM (WITH none AS (SELECT 1)" + _BLOCKS.format(source="prose") + "SELECT * FROM blocks WHERE kind = 'paragraph')",
    ),
    "win_word_chunks": with_ctes(
        "prose",
        """, w AS (SELECT doc, page, list_filter(regexp_split_to_array(markdown, '\\s+'), lambda x: x <> '') AS w FROM prose), s AS (SELECT doc, page, w, unnest(range(0, len(w), 50)) AS s FROM w)
SELECT doc, page, CAST(s AS INT) AS start_word, array_to_string(w[s + 1 : s + 60], ' ') AS text FROM s WHERE s = 0 OR s + 10 < len(w)""",
    ),
    "agg_truncation_audit": with_ctes(
        "prose",
        """, w AS (SELECT doc, page, list_filter(regexp_split_to_array(markdown, '\\s+'), lambda x: x <> '') AS w FROM prose), s AS (SELECT doc, page, w, unnest(range(0, len(w), 350)) AS s FROM w),
c AS (SELECT doc, CAST(ceil(length(array_to_string(w[s + 1 : s + 420], ' ')) / 4.0) AS INT) AS n FROM s WHERE s = 0 OR s + 70 < len(w))
SELECT doc, count(*) AS chunks, count(*) FILTER (n > 510) AS over_limit, max(n) AS largest, CAST(sum(n) AS BIGINT) AS given, CAST(sum(least(n, 510)) AS BIGINT) AS embedded FROM c GROUP BY doc""",
    ),
    "agg_worst_case_tokens": with_ctes("prose", "SELECT doc || ':' || page AS id, greatest(len(regexp_extract_all(markdown, '\\w+|[^\\w\\s]')), CAST(ceil(length(markdown) / 4.0) AS INT)) AS tokens FROM prose"),
    "agg_intact_table_rate": with_ctes(
        "structured",
        _B + """, t AS (SELECT pos, string_split(text, chr(10)) AS l FROM blocks WHERE kind = 'table'),
r AS (SELECT 14 + pos % 8 - ceil((length(l[1]) + length(l[2]) + 2) / 4) AS room, unnest(l[3:]) AS line FROM t)
SELECT count(*) AS rows, count(*) FILTER (ceil(length(line) / 4) <= room) AS intact, round(count(*) FILTER (ceil(length(line) / 4) <= room) / count(*), 6) AS rate FROM r""",
    ),
    "txt_heading_json": with_ctes("structured", _B + "SELECT doc, pos, CASE pos % 3 WHEN 0 THEN title || '@' || page WHEN 1 THEN title || '@-' ELSE '' END AS headings FROM blocks WHERE kind = 'heading'"),
    "txt_embed_inputs": with_ctes("queries", "SELECT query_id AS id, m.model_id, m.prefix || text AS input FROM queries, (VALUES ('small', 'Represent this sentence for searching relevant passages: '), ('multi', 'query: '), ('base', '')) m(model_id, prefix)"),
}
