"""Registered queries of page sources, audits, exports and bounded replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import coverage, output
from pagewright.plans import inputs
from pagewright.plans.inputs import with_ctes
from pagewright.plans.retrieval import plain_sql


def src_pages(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.extracted(spark, sf)


def _flagged(spark, sf):
    """Extracted pages: some flagged, some asked for."""
    return inputs.extracted(spark, sf).withColumn("needs_ocr", (F.col("doc") + F.col("page")) % 13 == 0).withColumn("asked", (F.col("doc") + F.col("page")) % 7 == 0)


def _ocr(spark, sf):
    """Recognised text for unresolved pages with an even number: the first word of the page's text in the file."""
    p = inputs.prose(spark, sf).where("(doc + page) % 7 = 0 and page % 2 = 0")
    return p.select("doc", "page", F.regexp_extract("markdown", r"^(\S*)", 1).alias("markdown"))


def flt_needs_recognition(spark, sf):
    return coverage.needs_recognition(_flagged(spark, sf))


def flt_sparse_pages(spark, sf):
    return coverage.sparse_pages(inputs.extracted(spark, sf), _ocr(spark, sf))


def join_page_sources(spark, sf):
    return coverage.merge_sources(_flagged(spark, sf), _ocr(spark, sf))


def join_region_text(spark, sf):
    """Regions of every third page: its own first line, and a line that the page doesn't have."""
    p = inputs.extracted(spark, sf)
    r = p.where("page % 3 = 1").select("doc", "page", F.concat(F.regexp_extract("markdown", r"^([^\n]*)", 1), F.lit("\n  Figure "), F.col("page").cast("string"), F.lit(" shows it \n**")).alias("text"))
    return coverage.merge_region_text(p.select("doc", "page", "markdown"), r)


def agg_text_source(spark, sf):
    return coverage.text_source(inputs.extracted(spark, sf))


def agg_coverage(spark, sf):
    return coverage.coverage(inputs.extracted(spark, sf))


def src_validate_extraction(spark, sf):
    p = _flagged(spark, sf).where("doc % 17 <> 3 or page <> 2")
    ocr = p.where("needs_ocr and doc % 5 <> 0").select("doc", "page")
    ocr = ocr.unionByName(ocr.where("doc % 5 = 1")).unionByName(p.where("doc % 19 = 2 and page = 1").select("doc", "page"))
    return coverage.validate_extraction(p, ocr)


def src_validate_cache(spark, sf):
    return coverage.validate_cache(inputs.catalogue(spark, sf), inputs.prose(spark, sf).where("(doc + page) % 29 <> 0"))


def src_validate_vectors(spark, sf):
    e = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"), F.when(F.col("vec_id") % 10 == 3, 63).otherwise(64).alias("dims"))
    v = F.when(F.col("id") % 10 == 7, F.transform("embedding", lambda x, i: F.when(i == 1, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(F.col("embedding"))
    return coverage.validate_vectors(e.withColumn("vector", v))


def set_recognition_targets(spark, sf):
    p = _flagged(spark, sf)
    return coverage.recognition_targets(coverage.needs_recognition(p), p.where("page % 4 = 0"))


def agg_extraction_profile(spark, sf):
    return coverage.extraction_profile(inputs.extracted(spark, sf).withColumn("has_image", (F.col("doc") * 3 + F.col("page")) % 5 == 0), _ocr(spark, sf).where("doc % 3 = 0"))


def agg_ocr_arbitration(spark, sf):
    """Pages on which two rules for choosing recognition differ: the flag, and too little text."""
    p = _flagged(spark, sf)
    a, b = F.col("needs_ocr"), coverage.visible_chars(F.col("markdown")) < coverage.SPARSE
    return p.agg(F.count(F.lit(1)).alias("pages"), F.count_if(a != b).alias("disagreements"))


def flt_image_regions(spark, sf):
    """Two or three boxes on each page, sizes by arithmetic on ids."""
    p = inputs.prose(spark, sf)
    n = F.explode(F.sequence(F.lit(1), (F.lit(2) + F.col("page") % 2).cast("int")))
    r = p.select("doc", "page", n.alias("i")).withColumn("area", ((F.col("doc") * 37 + F.col("page") * 11 + F.col("i") * 101) % 160 * 100).cast("double"))
    boxes = p.select("doc", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), (F.when(F.col("page") % 5 == 0, 90).otherwise(0)).alias("rotation"))
    return coverage.image_pages(r, boxes)


def sink_markdown(spark, sf):
    p = inputs.extracted(spark, sf)
    return output.export_markdown(p).withColumn("mode", F.lit("pages")).unionByName(output.export_markdown(p, "clean").withColumn("mode", F.lit("clean")))


SELECTIONS = ("1", "1-2", "1, 3 - 4", "2,2-3", "3-1", "", "x", "1-20000", "0", "1,500", "1 2", "1-9000,9001-12000", "x,3-1", "3-1,x")


def _selections(spark, sf):
    d = inputs.catalogue(spark, sf).select("doc")
    return d.withColumn("selection", F.element_at(F.array(*[F.lit(s) for s in SELECTIONS]), (F.col("doc") % len(SELECTIONS) + 1).cast("int")))


def flt_page_selection(spark, sf):
    p = inputs.prose(spark, sf)
    chosen = output.select_pages(p, _selections(spark, sf))
    return chosen.join(p.select("doc", "page", F.length("markdown").alias("chars")), ["doc", "page"], "left").select("doc", "page", "refusal", "chars")


def set_pages_beyond(spark, sf):
    s = inputs.catalogue(spark, sf).select("doc", F.explode(F.sequence(F.lit(1), (F.col("doc") % 5 + 1).cast("int"))).alias("page"))
    return output.pages_beyond(s, inputs.catalogue(spark, sf))


def win_page_ranges(spark, sf):
    return output.page_ranges(inputs.extracted(spark, sf).where("status <> 'read'"))


def win_content_budget(spark, sf):
    p = inputs.extracted(spark, sf)
    return output.content_budget(p, ["doc"], ["page"], "markdown", 1500).select("doc", "page", "kept", "omitted_bytes", "total_bytes")


def win_page_budget(spark, sf):
    return output.page_budget(inputs.prose(spark, sf), 1200)


def txt_text_pages(spark, sf):
    t = inputs.prose(spark, sf).withColumn("offset", (F.col("page") * 10).cast("int"))
    x = t.withColumn("x", output.text_page(F.col("markdown"), F.col("offset"), F.lit(200)))
    return x.select(F.concat_ws(":", "doc", "page").alias("request_id"), "x.text", "x.next_offset", "x.omitted_bytes")


def win_reply_pack(spark, sf):
    h = inputs.prose(spark, sf).select(F.col("doc").alias("query_id"), F.col("page").alias("rank"), F.col("markdown").alias("text"))
    return output.reply_pack(h, 4_000)


QUERIES = {
    f.__name__: f
    for f in (
        src_pages, flt_needs_recognition, flt_sparse_pages, join_page_sources, join_region_text, agg_text_source, agg_coverage, src_validate_extraction, src_validate_cache,
        src_validate_vectors, set_recognition_targets, agg_extraction_profile, agg_ocr_arbitration, flt_image_regions, sink_markdown, flt_page_selection, set_pages_beyond,
        win_page_ranges, win_content_budget, win_page_budget, txt_text_pages, win_reply_pack,
    )
}

_EX = "prose extracted"
_OCR = """, ocr AS (SELECT doc, page, regexp_extract(markdown, '^(\\S*)', 1) AS markdown FROM prose WHERE (doc + page) % 7 = 0 AND page % 2 = 0)"""
_CHARS = "length(regexp_replace(coalesce({0}, ''), '\\s', '', 'g'))"
_HEAD = "{t}[1 : list_max(list_filter(range(greatest(0, {n} - (strlen({t}) - length({t}))), {n} + 1), lambda i: strlen({t}[1:i]) <= {n}))]"
_CUT = "CASE WHEN strlen({t}) <= {n} THEN {t} WHEN regexp_matches(head, '(?s)^.+\\n') THEN regexp_extract(head, '(?s)^(.+)\\n', 1) ELSE head END"


def _chars(c: str) -> str:
    return _CHARS.format(c)


SQL = {
    "src_pages": with_ctes(_EX, "SELECT * FROM extracted"),
    "flt_needs_recognition": with_ctes(_EX, "SELECT doc, page FROM extracted WHERE (doc + page) % 13 = 0 OR trim(regexp_replace(markdown, '\\s+', ' ', 'g')) = ''"),
    "flt_sparse_pages": with_ctes(
        _EX,
        _OCR + f""", j AS (SELECT doc, page, {_chars('e.markdown')} AS n, {_chars('ocr.markdown')} AS o FROM extracted e LEFT JOIN ocr USING (doc, page))
SELECT doc, page, n AS native_chars, CASE WHEN n < 100 AND o > 0 THEN 'ocr' ELSE 'pdf' END AS source, CASE WHEN n = 0 AND o = 0 THEN 'no-text' WHEN n < 100 AND o = 0 THEN 'low-confidence' END AS warning FROM j""",
    ),
    "join_page_sources": with_ctes(
        _EX,
        _OCR + """, j AS (SELECT doc, page, regexp_replace(e.markdown, '^\\s+|\\s+$', '', 'g') AS m, coalesce(regexp_replace(ocr.markdown, '^\\s+|\\s+$', '', 'g'), '') AS o, (doc + page) % 13 = 0 AS flagged, (doc + page) % 7 = 0 AS asked FROM extracted e LEFT JOIN ocr USING (doc, page))
SELECT doc, page, CASE WHEN flagged OR m = '' THEN o ELSE m END AS markdown, CASE WHEN NOT flagged AND m <> '' THEN 'pdf' WHEN o <> '' THEN 'ocr' ELSE 'none' END AS source,
  CASE WHEN NOT flagged AND m <> '' OR o <> '' THEN 'read' WHEN asked THEN 'empty' ELSE 'unresolved' END AS status FROM j""",
    ),
    "join_region_text": with_ctes(
        _EX,
        """, r AS (SELECT doc, page, string_split(regexp_extract(markdown, '^([^\\n]*)', 1) || chr(10) || '  Figure ' || page || ' shows it ' || chr(10) || '**', chr(10)) AS l FROM extracted WHERE page % 3 = 1),
own AS (SELECT doc, page, markdown, """
        + plain_sql("markdown")
        + """ AS p FROM extracted), lines AS (SELECT doc, page, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM r),
new AS (SELECT doc, page, string_agg(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY n) AS more FROM lines JOIN own USING (doc, page) WHERE """
        + plain_sql("line")
        + """ <> '' AND NOT contains(p, """
        + plain_sql("line")
        + """) GROUP BY doc, page)
SELECT doc, page, CASE WHEN more IS NULL THEN markdown ELSE markdown || chr(10) || chr(10) || more END AS markdown, CASE WHEN more IS NULL THEN 'pdf' ELSE 'mixed' END AS source FROM own LEFT JOIN new USING (doc, page)""",
    ),
    "agg_text_source": with_ctes(
        _EX,
        """, s AS (SELECT doc, bool_or(source IN ('pdf', 'mixed')) AS a, bool_or(source IN ('ocr', 'mixed')) AS b FROM extracted WHERE trim(regexp_replace(markdown, '\\s+', ' ', 'g')) <> '' GROUP BY doc)
SELECT DISTINCT doc, CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'pdf' WHEN b THEN 'ocr' ELSE 'none' END AS text_source FROM extracted LEFT JOIN s USING (doc)""",
    ),
    "agg_coverage": with_ctes(
        _EX,
        "SELECT doc, CASE WHEN bool_or(status = 'unresolved') THEN 'incomplete' ELSE 'complete' END AS index_status, count(*) FILTER (status = 'unresolved') AS unresolved_count, coalesce(string_agg(page, ',' ORDER BY page) FILTER (status = 'unresolved'), '') AS unresolved_pages FROM extracted GROUP BY doc",
    ),
    "src_validate_extraction": with_ctes(
        _EX,
        """, p AS (SELECT doc, page, (doc + page) % 13 = 0 AS f FROM extracted WHERE doc % 17 <> 3 OR page <> 2),
l0 AS (SELECT doc, page FROM p WHERE f AND doc % 5 <> 0), l AS (SELECT * FROM l0 UNION ALL SELECT * FROM l0 WHERE doc % 5 = 1 UNION ALL SELECT doc, page FROM p WHERE doc % 19 = 2 AND page = 1)
SELECT doc, 'order' AS rule, min(page) AS page FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM p) WHERE n <> page GROUP BY doc
UNION ALL SELECT doc, 'repeated', page FROM l GROUP BY doc, page HAVING count(*) > 1
UNION ALL SELECT doc, 'listed-not-flagged', page FROM (SELECT DISTINCT * FROM l) WHERE (doc, page) NOT IN (SELECT (doc, page) FROM p WHERE f)
UNION ALL SELECT doc, 'flagged-not-listed', page FROM p WHERE f AND (doc, page) NOT IN (SELECT (doc, page) FROM l)""",
    ),
    "src_validate_cache": with_ctes(
        "prose catalogue",
        """, n AS (SELECT doc, count(DISTINCT page) AS found, max(page) AS last FROM prose WHERE (doc + page) % 29 <> 0 GROUP BY doc)
SELECT doc, 'coverage' AS rule, page_count AS expected, coalesce(found, 0) AS found FROM catalogue LEFT JOIN n USING (doc) WHERE coalesce(found, 0) <> page_count OR coalesce(last, 0) <> page_count
UNION ALL SELECT doc, 'version', 1, text_version FROM catalogue WHERE text_version < 1""",
    ),
    "src_validate_vectors": "SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN 'dimensions' ELSE 'not-finite' END AS reason FROM embeddings WHERE vec_id % 10 IN (3, 7)",
    "set_recognition_targets": with_ctes(_EX, "SELECT doc, page FROM extracted WHERE (doc + page) % 13 = 0 OR trim(regexp_replace(markdown, '\\s+', ' ', 'g')) = '' OR page % 4 = 0"),
    "agg_extraction_profile": with_ctes(
        _EX,
        _OCR + f""", n AS (SELECT doc, max(page) AS n FROM extracted GROUP BY doc), s AS (SELECT doc, sum({_chars('markdown')}) AS chars, count(*) FILTER ({_chars('markdown')} < 100) AS sparse, count(*) FILTER ((doc * 3 + page) % 5 = 0) AS images, count(*) AS k
  FROM extracted JOIN n USING (doc) WHERE page <= 3 OR page = ceil(n / 2.0) OR page = n GROUP BY doc)
SELECT doc, CAST(chars AS BIGINT) AS chars, sparse, images, CASE WHEN (chars < 600 OR sparse / k >= 0.6) AND (images > 0 OR doc IN (SELECT doc FROM ocr WHERE doc % 3 = 0)) THEN 'visual' ELSE 'standard' END AS engine FROM s""",
    ),
    "agg_ocr_arbitration": with_ctes(_EX, f"SELECT count(*) AS pages, count(*) FILTER (((doc + page) % 13 = 0) <> ({_chars('markdown')} < 100)) AS disagreements FROM extracted"),
    "flt_image_regions": with_ctes(
        "prose",
        """, r AS (SELECT doc, page, (doc * 37 + page * 11 + i * 101) % 160 * 100 AS area FROM (SELECT doc, page, unnest(range(1, 3 + page % 2)) AS i FROM prose)),
g AS (SELECT doc, page, sum(area)::DOUBLE AS a, max(area) AS m FROM r GROUP BY ALL)
SELECT doc, page, round(least(1.0, a / (612.0 * 792.0)), 6)::DOUBLE AS coverage, (round(least(1.0, a / (612.0 * 792.0)), 6) >= 0.05 AND m >= 10000 AND page % 5 <> 0) AS qualifies FROM g""",
    ),
    "sink_markdown": with_ctes(
        _EX,
        """SELECT doc, 'pages' AS mode, string_agg('<a id="page-' || page || '"></a>' || chr(10) || chr(10) || '## Page ' || page || chr(10) || chr(10) || trim(markdown), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS markdown FROM extracted GROUP BY doc
UNION ALL SELECT doc, 'clean', string_agg(trim(markdown), chr(10) || chr(10) ORDER BY page) FROM extracted WHERE trim(regexp_replace(markdown, '\\s+', ' ', 'g')) <> '' GROUP BY doc""",
    ),
    "flt_page_selection": with_ctes(
        "prose",
        """, n AS (SELECT doc, max(page) AS n FROM prose GROUP BY doc),
s AS (SELECT doc, n, CASE doc % 14 WHEN 0 THEN [1] WHEN 1 THEN [1, 2] WHEN 2 THEN [1, 3, 4] WHEN 3 THEN [2, 3] WHEN 9 THEN [1, 500] ELSE [1] END AS l, doc % 14 AS k FROM n),
r AS (SELECT *, CASE WHEN k IN (5, 6, 8, 10, 12) THEN 'malformed' WHEN k IN (4, 13) THEN 'reversed' WHEN k IN (7, 11) THEN 'too-long' WHEN list_max(l) > n THEN 'beyond-end' END AS refusal FROM s),
e AS (SELECT doc, refusal, CASE WHEN refusal IS NULL THEN unnest(CASE WHEN refusal IS NULL THEN l ELSE [0] END) END AS page FROM (SELECT * FROM r))
SELECT e.doc, e.page, refusal, length(markdown) AS chars FROM e LEFT JOIN prose p ON e.doc = p.doc AND e.page = p.page""",
    ),
    "set_pages_beyond": with_ctes("catalogue", "SELECT doc, page FROM (SELECT doc, page_count, unnest(range(1, doc % 5 + 2)) AS page FROM catalogue) WHERE page > page_count"),
    "win_page_ranges": with_ctes(
        _EX,
        """, g AS (SELECT doc, min(page) AS a, max(page) AS b FROM (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM extracted WHERE status <> 'read') GROUP BY doc, g)
SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM g GROUP BY doc""",
    ),
    "win_content_budget": with_ctes(
        _EX,
        """, k AS (SELECT doc, page, strlen(markdown) AS n, sum(strlen(markdown)) OVER (PARTITION BY doc ORDER BY page) <= 1500 AS kept FROM extracted)
SELECT doc, page, kept, CAST(sum(CASE WHEN kept THEN 0 ELSE n END) OVER (PARTITION BY doc) AS BIGINT) AS omitted_bytes, CAST(sum(n) OVER (PARTITION BY doc) AS BIGINT) AS total_bytes FROM k""",
    ),
    "win_page_budget": with_ctes(
        "prose",
        """, b AS (SELECT doc, page, markdown AS m, CAST(1200 - coalesce(sum(strlen(markdown)) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS room, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM prose),
h AS (SELECT *, CASE WHEN strlen(m) > room THEN """ + _HEAD.format(t="m", n="room") + """ END AS head FROM b WHERE room > 0 OR n = 1), c AS (SELECT *, """ + _CUT.format(t="m", n="room") + """ AS t FROM h)
SELECT doc, page, t AS markdown, strlen(t) < strlen(m) AS shortened FROM c WHERE t <> '' OR m = '' OR n = 1""",
    ),
    "txt_text_pages": with_ctes(
        "prose",
        """, r AS (SELECT doc, page, markdown AS m, least(page * 10, length(markdown)) AS o, markdown[least(page * 10, length(markdown)) + 1 :] AS rest FROM prose), h AS (SELECT *, CASE WHEN strlen(rest) > 200 THEN """ + _HEAD.format(t="rest", n="200") + """ END AS head FROM r),
c AS (SELECT *, """ + _CUT.format(t="rest", n="200") + """ AS t FROM h)
SELECT doc || ':' || page AS request_id, t AS text, CASE WHEN o + length(t) < length(m) THEN o + length(t) END AS next_offset, strlen(m[o + length(t) + 1 :]) AS omitted_bytes FROM c""",
    ),
}
