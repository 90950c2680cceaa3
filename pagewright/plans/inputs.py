"""Inputs of the registered queries, derived from the given tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prose(spark: SparkSession, sf: str, lines: int = 5) -> DataFrame:
    """Documents cut into pages of five lines: doc, page, markdown."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    if d.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):  # a few small files: spread them
        d = d.repartition(cores)
    d = d.select(F.col("doc_id").alias("doc"), F.split("text", "\n", -1).alias("l"))
    d = d.select("doc", "l", F.posexplode(F.sequence(F.lit(0), F.ceil(F.size("l") / lines).cast("int") - 1)).alias("p", "i"))
    return d.select("doc", (F.col("i") + 1).alias("page"), F.array_join(F.slice("l", F.col("i") * lines + 1, lines), "\n").alias("markdown"))


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Prose pages with a source and an outcome; what was not read has no text: doc, page, markdown, source, status."""
    p = prose(spark, sf)
    k, s = (F.col("doc") + F.col("page")) % 7, (F.col("doc") + F.col("page")) % 5
    p = p.withColumn("status", F.when(k == 0, "unresolved").when(k == 1, "empty").otherwise("read"))
    p = p.withColumn("source", F.when(s == 0, "ocr").when(s == 1, "mixed").otherwise("pdf"))
    return p.withColumn("markdown", F.when(F.col("status") == "read", F.col("markdown")).otherwise("")).select("doc", "page", "markdown", "source", "status")


def structured(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents, their orders as pages with headings, a label, a table and a footer: doc, page, markdown."""
    li = table(spark, sf, "lineitem")
    row = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" |"))
    rows = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    o = table(spark, sf, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    title = F.when(F.col("page") == 1, F.concat(F.lit("# "), F.initcap(F.lower("c_mktsegment")), F.lit("\n\n"))).otherwise("")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.upper("c_mktsegment"), F.lit("\n\n"))).otherwise("")
    text = F.concat(
        title, F.lit("## Order "), F.col("o_orderkey").cast("string"), F.lit("\n\n"), label,
        F.lit("| Line | Part | Qty |\n| --- | --- | --- |\n"), F.col("rows"), F.lit("\n\nPriority **"), F.col("o_orderpriority"), F.lit("** for this order.\n"),
        F.lit("- status "), F.col("o_orderstatus"), F.lit("\n- checked\n\nPage footer "), F.col("c_nationkey").cast("string"),
    )
    return o.select(F.col("c_custkey").alias("doc"), "page", text.alias("markdown"))


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a catalogue: five shelves of a hundred folders, every eighth document an earlier or later version of
    the next one."""
    i = F.col("doc_id")
    k = F.when(i % 8 == 0, i + 1).otherwise(i)
    shelf = F.concat(F.lit("shelf"), (k % 5).cast("string"))
    return table(spark, sf, "documents").select(
        i.alias("doc"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
        F.when(i % 11 != 0, F.concat(F.lit("/lib/"), shelf, F.lit("/"), (F.floor(k / 5) % 100).cast("string"), F.lit("/"), k.cast("string"))).alias("path"),
        F.when(i % 13 != 0, "resolved").otherwise("guessed").alias("path_provenance"),
        (i * 7919 % 100003).alias("last_opened"), F.ceil(F.size(F.split("text", "\n", -1)) / 5).cast("int").alias("page_count"),
        (i % 4).cast("int").alias("text_version"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"),
    )


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("/lib/shelf0",), ("/lib/shelf1",), ("/lib/shelf2",), ("/lib/shelf3",), ("/lib/shelf4/3",)], "root string")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Three queries from each benchmark text: words, a quoted phrase with a word, and one that finds nothing."""
    b = table(spark, sf, "benchmark").select("item_id", F.split(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "), " ").alias("w"))
    w = lambda i: F.get("w", F.lit(i))
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.concat_ws(" ", w(0), w(1)).alias("text")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit('"'), w(2), F.lit(" "), w(3), F.lit('" '), w(4)).alias("text")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("zzqx"), F.col("item_id").cast("string"), F.lit(" --")).alias("text")),
    )
    return b.select("item_id", F.explode(kinds).alias("x")).select((F.col("item_id") * 3 + F.col("x.k")).alias("query_id"), "item_id", F.col("x.text").alias("text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One passage for each prose page: chunk_id, doc, page, text."""
    return prose(spark, sf).select(F.concat_ws(":", "doc", "page").alias("chunk_id"), "doc", "page", F.col("markdown").alias("text"))


CTE = {
    "prose": """prose AS (
      SELECT doc, CAST(i + 1 AS INT) AS page, array_to_string(l[i * 5 + 1 : i * 5 + 5], chr(10)) AS markdown
      FROM (SELECT doc_id AS doc, l, unnest(range(CAST(ceil(len(l) / 5.0) AS BIGINT))) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""",
    "extracted": """extracted AS (
      SELECT doc, page, CASE WHEN (doc + page) % 7 IN (0, 1) THEN '' ELSE markdown END AS markdown,
        CASE (doc + page) % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'mixed' ELSE 'pdf' END AS source,
        CASE (doc + page) % 7 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'empty' ELSE 'read' END AS status FROM prose)""",
    "structured": """structured AS (
      SELECT c_custkey AS doc, page, concat(
        CASE WHEN page = 1 THEN concat('# ', upper(c_mktsegment[1]), lower(c_mktsegment[2:]), chr(10), chr(10)) ELSE '' END,
        '## Order ', o_orderkey, chr(10), chr(10), CASE WHEN o_orderkey % 3 = 0 THEN concat(upper(c_mktsegment), chr(10), chr(10)) ELSE '' END,
        '| Line | Part | Qty |', chr(10), '| --- | --- | --- |', chr(10), rows, chr(10), chr(10), 'Priority **', o_orderpriority, '** for this order.', chr(10),
        '- status ', o_orderstatus, chr(10), '- checked', chr(10), chr(10), 'Page footer ', c_nationkey) AS markdown
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page FROM orders
            JOIN (SELECT l_orderkey, string_agg(r, chr(10) ORDER BY l_linenumber, l_partkey, r) AS rows FROM (SELECT *, concat('| ', l_linenumber, ' | ', l_partkey, ' | ', CAST(trunc(l_quantity) AS INT), ' |') AS r FROM lineitem) GROUP BY 1) ON o_orderkey = l_orderkey) JOIN customer ON o_custkey = c_custkey)""",
    "catalogue": """catalogue AS (
      SELECT doc_id AS doc, sha256(text) AS content_hash, CASE WHEN doc_id % 11 <> 0 THEN concat('/lib/shelf', k % 5, '/', k // 5 % 100, '/', k) END AS path,
        CASE WHEN doc_id % 13 <> 0 THEN 'resolved' ELSE 'guessed' END AS path_provenance, doc_id * 7919 % 100003 AS last_opened,
        CAST(ceil(len(string_split(text, chr(10))) / 5.0) AS INT) AS page_count, CAST(doc_id % 4 AS INT) AS text_version, strlen(text) AS bytes FROM (SELECT *, CASE WHEN doc_id % 8 = 0 THEN doc_id + 1 ELSE doc_id END AS k FROM documents))""",
    "roots": "roots AS (SELECT unnest(['/lib/shelf0', '/lib/shelf1', '/lib/shelf2', '/lib/shelf3', '/lib/shelf4/3']) AS root)",
    "queries": """queries AS (
      SELECT item_id * 3 + k AS query_id, item_id, CASE k WHEN 0 THEN concat_ws(' ', w[1], w[2]) WHEN 1 THEN '"' || w[3] || ' ' || w[4] || '" ' || w[5] ELSE concat('zzqx', item_id, ' --') END AS text
      FROM (SELECT item_id, string_split(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS w, unnest([0, 1, 2]) AS k FROM benchmark))""",
    "chunks": "chunks AS (SELECT concat_ws(':', doc, page) AS chunk_id, doc, page, markdown AS text FROM prose)",
    "indexed": "chunks AS (SELECT concat_ws(':', doc, page) AS chunk_id, doc, page, markdown AS text FROM prose WHERE doc % 11 <> 0 AND (doc % 7 <> 0 OR page = 1))",
    "postings": """words AS (SELECT chunk_id, doc, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+') AS t FROM chunks),
      occurrences AS (SELECT chunk_id, doc, unnest(t) AS token, unnest(range(len(t))) AS pos FROM words)""",
    "parts": """raw_parts AS (SELECT query_id, unnest(regexp_extract_all(text, '"[^"]*"|[^\\s"]+')) AS p, generate_subscripts(regexp_extract_all(text, '"[^"]*"|[^\\s"]+'), 1) AS part FROM queries),
      part_tokens AS (SELECT query_id, part, unnest(t) AS token, unnest(range(len(t))) AS token_no, len(t) AS n_tokens
        FROM (SELECT query_id, part, regexp_extract_all(strip_accents(lower(p)), '[\\p{L}\\p{N}\\p{Co}]+') AS t FROM raw_parts))""",
    "phrase_tf": """phrase_tf AS (SELECT query_id, part, chunk_id, doc, count(*) AS tf FROM (
        SELECT query_id, part, chunk_id, doc, pos - token_no AS start, n_tokens FROM part_tokens JOIN occurrences USING (token)
        GROUP BY ALL HAVING count(DISTINCT token_no) = n_tokens) GROUP BY ALL)""",
    "matches": """n_parts AS (SELECT query_id, count(DISTINCT part) AS n_parts FROM part_tokens GROUP BY query_id),
      matches AS (SELECT query_id, chunk_id, doc FROM phrase_tf JOIN n_parts USING (query_id) GROUP BY query_id, chunk_id, doc, n_parts HAVING count(DISTINCT part) = n_parts)""",
    "bm25": """stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM words), phrase_df AS (SELECT query_id, part, count(*) AS df FROM phrase_tf GROUP BY ALL),
      exact AS (SELECT query_id, chunk_id, doc, round(-sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS rank
        FROM matches JOIN phrase_tf USING (query_id, chunk_id, doc) JOIN phrase_df USING (query_id, part) JOIN words USING (chunk_id, doc), stats GROUP BY ALL)""",
    "bow": """bow_words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM (SELECT text FROM chunks UNION ALL SELECT text FROM queries)),
      bow_slots AS (SELECT w, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 64 AS slot
        FROM (SELECT w, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(w, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM bow_words)),
      chunk_counts AS (SELECT chunk_id, doc, slot, count(*)::DOUBLE AS c FROM (SELECT chunk_id, doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM chunks) JOIN bow_slots USING (w) GROUP BY ALL),
      query_counts AS (SELECT query_id, slot, count(*)::DOUBLE AS c FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM queries) JOIN bow_slots USING (w) GROUP BY ALL)""",
    "semantic": """chunk_norm AS (SELECT chunk_id, sqrt(sum(c * c)) AS cn FROM chunk_counts GROUP BY ALL), query_norm AS (SELECT query_id, sqrt(sum(c * c)) AS qn FROM query_counts GROUP BY ALL),
      semantic AS (SELECT query_id, chunk_id, doc, round(s / cn / qn, 6) AS score FROM (SELECT query_id, chunk_id, doc, sum(a.c * b.c) AS s FROM query_counts a JOIN chunk_counts b USING (slot) GROUP BY ALL)
        JOIN chunk_norm USING (chunk_id) JOIN query_norm USING (query_id) WHERE round(s / cn / qn, 6) >= 0.24)""",
}


def with_ctes(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
