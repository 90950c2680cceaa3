"""Registered queries of annotations, links and literal searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import annotations as ops
from pagewright.operators import links
from pagewright.plans import inputs
from pagewright.plans.inputs import with_ctes


def _annotations(spark, sf):
    """Orders as annotations of their customers' documents: places, kinds and replies by arithmetic on keys."""
    o = inputs.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("annotation_id"), F.col("o_custkey").alias("doc"), (k % 7 + 1).cast("int").alias("page"), F.when(k % 3 == 0, "highlight").when(k % 3 == 1, "underline").otherwise("text").alias("type"),
        F.concat(F.lit("author-"), (k % 5).cast("string")).alias("author"), F.concat(F.col("o_orderpriority"), F.lit(" "), k.cast("string")).alias("note"), (k * 13 % 700).cast("double").alias("top"),
        (k * 7 % 500).cast("double").alias("left"), k.alias("object_ref"), F.when(k % 4 == 0, k - 1).alias("in_reply_to"),
    )


def _runs(spark, sf):
    """Words of prose lines as positioned runs; every fifth is marked over its middle half."""
    w = inputs.prose(spark, sf).select("doc", "page", F.posexplode(F.filter(F.split("markdown", r"\s+", -1), lambda x: x != "")).alias("n", "text"))
    left = (F.col("n") % 10 * 60).cast("double")
    bottom = (F.lit(700) - F.floor(F.col("n") / 10) * 20).cast("double")
    return w.select("doc", "page", "n", "text", left.alias("left"), (left + 6.0 * F.length("text")).alias("right"), bottom.alias("bottom"), (bottom + 12).alias("top"))


def join_marks_text(spark: SparkSession, sf: str) -> DataFrame:
    r = _runs(spark, sf)
    wide = F.col("right") - F.col("left")
    m = r.where("n % 5 = 0").select(F.concat_ws(":", "doc", "page", "n").alias("annotation_id"), "doc", "page", F.lit(0).alias("mark_no"), (F.col("left") + wide / 4).alias("left"), (F.col("right") - wide / 4).alias("right"), F.col("bottom").alias("bottom"), "top")
    return ops.words_under_marks(m, r)


def txt_quads_to_boxes(spark, sf):
    a = _annotations(spark, sf)
    x, y = F.col("left"), F.col("top")
    box = lambda dx: [x + dx, y, x + dx + 40, y, x + dx, y - F.when(F.col("annotation_id") % 6 == 5, 0).otherwise(12), x + dx + 40, y - F.when(F.col("annotation_id") % 6 == 5, 0).otherwise(12)]
    quads = F.when(F.col("annotation_id") % 6 == 0, F.array(*box(0), *box(50))).when(F.col("annotation_id") % 6 == 1, F.array(*box(0)[:6])).otherwise(F.array(*box(0)))
    b = ops.quads_to_boxes(a.select("annotation_id", quads.alias("quads"), "left", "top"))
    return b.select("annotation_id", F.size("marks").alias("marks"), "bounds.left", "bounds.bottom", "bounds.right", "bounds.top")


def txt_annotation_dates(spark, sf):
    o = inputs.table(spark, sf, "orders")
    full = F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("D:"), F.left(full, F.lit(4)))).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("D:"), full, F.lit("1530"))).when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("D:"), full, F.lit("233015+02'00'")))
    raw = raw.when(F.col("o_orderkey") % 5 == 3, full).otherwise(F.concat(F.lit("D:"), full, F.lit("Z")))
    return o.select(F.col("o_orderkey").alias("annotation_id"), F.date_format(ops.annotation_date(raw), "yyyy-MM-dd HH:mm:ss").alias("modified"))


def join_replies(spark, sf):
    return ops.resolve_replies(_annotations(spark, sf))


def join_annotation_dedupe(spark, sf):
    a = _annotations(spark, sf).withColumn("annotation_id", F.col("annotation_id").cast("string"))
    own = a.where("page <= 2")
    copies = own.withColumn("annotation_id", F.concat(F.lit("own:"), "annotation_id"))
    return ops.merge_annotations(own, copies.unionByName(a.where("page > 2")), "own:", ("highlight", "text"))


def top_comments_order(spark, sf):
    return ops.reading_order(_annotations(spark, sf))


KINDS = ("comment", "highlight", "bookmark", "text", "signature", "underline")


def _noted(spark, sf):
    """Annotations of six kinds: every eleventh without a note, every fourth with characters to escape, every second with a quote."""
    k = F.col("annotation_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 6 + 1).cast("int"))
    note = F.when(k % 11 == 0, "  ").when(k % 4 == 0, F.concat("note", F.lit(" `a\\b` "))).otherwise(F.col("note"))
    return _annotations(spark, sf).withColumn("type", kind).withColumn("note", note).withColumn("quote", F.when(k % 2 == 0, F.concat(F.lit("the quoted é "), k.cast("string"))))


def join_annotation_export(spark, sf):
    p = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    return ops.export_blocks(p, _noted(spark, sf))


def win_comment_pages(spark, sf):
    from pyspark.sql import Window

    from pagewright.operators.output import comment_pages

    a = _noted(spark, sf)
    total = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    c = ops.reading_order(a).join(a.select("annotation_id", "note", "quote", "author"), "annotation_id").withColumn("total", total)
    return comment_pages(c, 2, 110)


def win_comments_reply(spark, sf):
    """The same comments as one JSON reply for each document, within a budget of content and one of the whole reply."""
    from pyspark.sql import Window

    from pagewright.operators.output import comments_reply

    a = _noted(spark, sf)
    c = ops.reading_order(a).drop("page").join(a.select("annotation_id", "page", "type", "note", "quote", "author"), "annotation_id")
    c = c.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc")).cast("int")).withColumn("name", F.concat(F.lit("customer "), F.col("doc").cast("string")))
    return comments_reply(c.withColumn("document_hash", F.sha2(F.col("doc").cast("string"), 256)).withColumnRenamed("annotation_id", "id"), 2, 110, 800)


def flt_safe_links(spark, sf):
    """All targets in the pages' HTML, all page addresses, and other forms and schemes made from these."""
    p = inputs.table(spark, sf, "pages")
    k, url = F.col("page_id"), F.col("url")
    start = F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0)
    loud = F.concat(F.lit(" \t"), F.upper(start), F.substr("url", F.length(start) + 1), F.lit(" "))
    odd = F.when(k % 5 == 0, F.concat(F.lit("mailto:a"), k.cast("string"), F.lit("@example.org"))).when(k % 5 == 1, F.lit("javascript:alert(1)")).when(k % 5 == 2, F.lit("//relative/path")).when(k % 5 == 3, F.concat(F.lit("file:///x/"), k.cast("string"))).otherwise(loud)
    steps = F.concat(start, F.lit("/x/./y/../"), k.cast("string"), F.lit(" b"))
    given = p.select(k, F.array(url, odd, steps).alias("u")).select("page_id", F.posexplode("u").alias("link_no", "url"))
    return links.safe_links(given.select("page_id", (-F.col("link_no") - 1).alias("link_no"), "url").unionByName(links.page_links(p)))


def join_internal_links(spark, sf):
    """The words that the pages' HTML links to as names, page numbers, objects and targets in Markdown; some of the words are
    names in a catalogue, some are headings."""
    p = inputs.table(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("n", "w"))
    size, k = F.length("w").cast("string"), F.col("n") % 4
    kind = F.when(k == 0, "name").when(k == 1, "index").when(k == 2, "ref").otherwise("url")
    target = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("other.md#"), "w")).otherwise(F.concat(F.lit("<#"), "w", F.lit(">")))
    given = p.select("doc", F.col("n").alias("link_no"), kind.alias("kind"), F.when(k == 0, F.col("w")).when(k == 1, size).when(k == 2, F.concat(F.lit("r"), size)).otherwise(target).alias("value"))
    m = F.length("w") % 3
    names = p.where("n % 8 = 0").select("doc", F.col("w").alias("name"), F.when(m == 0, "index").when(m == 1, "ref").otherwise("name").alias("kind"), F.when(m == 0, size).when(m == 1, F.concat(F.lit("r"), size)).otherwise(F.col("w")).alias("value")).distinct()
    refs = p.select("doc", F.concat(F.lit("r"), size).alias("ref"), F.length("w").alias("index")).where("index % 2 = 0").distinct()
    counts = p.groupBy("doc").agg((F.first("doc") % 4 + 5).alias("pages"))
    return links.internal_links(given, names, refs, counts, p.where("n % 2 = 1").select("doc", F.col("n").alias("pos"), F.concat(F.lit("**"), "w", F.lit("**")).alias("title")))


TERMS = (" the ", "tion", "License", "de la", "zz-none", " ")


def _terms(spark):
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


def _recognised(spark, sf):
    """Recognised text of every third page; it counts on the sparse ones."""
    return inputs.prose(spark, sf).where("page % 3 = 1").select("doc", "page", F.concat(F.lit("The licensed  Tion of the page "), F.col("page").cast("string")).alias("markdown"))


def txt_keyword_scan(spark, sf):
    return ops.keyword_scan(inputs.prose(spark, sf), _terms(spark), ocr=_recognised(spark, sf))


def agg_find_matches(spark, sf):
    p = ops.searched_text(inputs.prose(spark, sf), _recognised(spark, sf)).crossJoin(F.broadcast(_terms(spark)))  # six terms
    n = F.when(F.trim("term") == "", 0).otherwise(F.regexp_count(F.lower("text"), F.concat(F.lit("\\Q"), F.lower(F.trim("term")), F.lit("\\E"))))
    return p.groupBy("doc", "term").agg(F.sum(n).alias("matches"))


def win_nth_occurrence(spark, sf):
    p = inputs.prose(spark, sf)
    r = p.select(F.concat_ws(":", "doc", "page").alias("request_id"), "doc", "page", F.lit("On").alias("term"), (F.col("doc") % 6 - 1).cast("int").alias("ordinal"), (F.instr(F.lower("markdown"), "on") - 1 + (F.col("doc") % 3 - 1) * 40).alias("preferred"))
    return ops.nth_occurrence(r, p)


def agg_repetitive_descriptions(spark, sf):
    """Turns of conversations, and the start of each said seven times."""
    d = inputs.table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return ops.repetitive(d.unionByName(d.select(F.concat(F.lit("loop:"), "id").alias("id"), F.repeat(F.concat(F.left("text", F.lit(20)), F.lit("; ")), F.lit(7)).alias("text"))))


def txt_image_descriptions(spark, sf):
    """Documents of three images with a description each: some too short, some looping; every third stands above its
    image already, on two lines."""
    d = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), "c_mktsegment")
    cap = lambda i, end: F.concat(F.lit(f"a drawing of the{end}"), F.lower("c_mktsegment"), F.lit(f" picture {i}"))
    above = lambda i: F.when((F.col("doc") + i) % 3 == 0, F.concat(F.lit("\n"), cap(i, "\n"), F.lit("\n\n"))).otherwise("")
    md = F.concat(*[x for i in (1, 2, 3) for x in (F.lit(f"text {i}\n"), above(i), F.lit(f"see ![image {i}](img{i}.png) here\n\n"))])
    given = lambda i: F.when((F.col("doc") + i) % 7 == 0, "too short").when((F.col("doc") + i) % 7 == 1, "red, red, red, red, red, red, red").when((F.col("doc") + i) % 7 == 2, F.concat(F.lit("**Image description:** "), cap(i, " "))).otherwise(cap(i, " "))
    desc = d.select("doc", F.explode(F.array(*[F.struct(F.lit(i).alias("image_no"), given(i).alias("description")) for i in (1, 2, 3)])).alias("x")).select("doc", "x.image_no", "x.description")
    return ops.image_descriptions(d.select("doc", md.alias("markdown")), desc)


QUERIES = {
    f.__name__: f
    for f in (
        join_marks_text, txt_quads_to_boxes, txt_annotation_dates, join_replies, join_annotation_dedupe, top_comments_order, join_annotation_export, win_comment_pages, win_comments_reply,
        flt_safe_links, join_internal_links, txt_keyword_scan, agg_find_matches, win_nth_occurrence, agg_repetitive_descriptions, txt_image_descriptions,
    )
}

_ANN = """WITH ann AS (SELECT o_orderkey AS annotation_id, o_custkey AS doc, CAST(o_orderkey % 7 + 1 AS INT) AS page, CASE o_orderkey % 3 WHEN 0 THEN 'highlight' WHEN 1 THEN 'underline' ELSE 'text' END AS type,
  'author-' || o_orderkey % 5 AS author, o_orderpriority || ' ' || o_orderkey AS note, (o_orderkey * 13 % 700)::DOUBLE AS top, (o_orderkey * 7 % 500)::DOUBLE AS "left", CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey - 1 END AS in_reply_to FROM orders)
"""
_NOTED = _ANN.rstrip() + """, noted AS (SELECT annotation_id, doc, page, top, "left", author, ['comment', 'highlight', 'bookmark', 'text', 'signature', 'underline'][annotation_id % 6 + 1] AS type,
  CASE WHEN annotation_id % 11 = 0 THEN '  ' WHEN annotation_id % 4 = 0 THEN note || ' `a\\b` ' ELSE note END AS note, CASE WHEN annotation_id % 2 = 0 THEN 'the quoted é ' || annotation_id END AS quote FROM ann)
"""
_TEXT = """, terms AS (SELECT unnest([' the ', 'tion', 'License', 'de la', 'zz-none', ' ']) AS term), own AS (SELECT doc, page, trim(regexp_replace(markdown, '\\s+', ' ', 'g')) AS t FROM prose),
searched AS (SELECT doc, page, CASE WHEN page % 3 = 1 AND length(regexp_replace(t, '\\s', '', 'g')) < 100 THEN 'The licensed  Tion of the page ' || page ELSE t END AS text, CASE WHEN page % 3 = 1 AND length(regexp_replace(t, '\\s', '', 'g')) < 100 THEN 'ocr' ELSE 'pdf' END AS source FROM own)
"""
_POS = """, hits AS (SELECT doc, page, markdown, term, list_transform(string_split(lower(markdown), lower(term)), lambda x: length(x)) AS n FROM prose, terms),
starts AS (SELECT doc, page, markdown, term, i - 1 AS ordinal, CAST(list_sum(n[1:i]) + (i - 1) * length(term) AS INT) AS start FROM (SELECT *, unnest(range(1, len(n))) AS i FROM hits))
"""

SQL = {
    "txt_quads_to_boxes": _ANN + """, b AS (SELECT *, annotation_id % 6 AS k FROM ann)
SELECT annotation_id, CASE k WHEN 0 THEN 2 WHEN 1 THEN NULL WHEN 5 THEN NULL ELSE 1 END AS marks, CASE WHEN k NOT IN (1, 5) THEN "left" END AS "left", CASE WHEN k NOT IN (1, 5) THEN top - 12 END AS bottom,
  CASE WHEN k NOT IN (1, 5) THEN "left" + CASE WHEN k = 0 THEN 90 ELSE 40 END END AS "right", CASE WHEN k NOT IN (1, 5) THEN top END AS top FROM b""",
    "txt_annotation_dates": """SELECT o_orderkey AS annotation_id, strftime(CASE o_orderkey % 5 WHEN 0 THEN date_trunc('year', o_orderdate)::TIMESTAMP WHEN 1 THEN date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 930 MINUTE
  WHEN 2 THEN date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 77415 SECOND WHEN 3 THEN NULL ELSE date_trunc('day', o_orderdate)::TIMESTAMP END, '%Y-%m-%d %H:%M:%S') AS modified FROM orders""",
    "join_replies": _ANN + "SELECT a.annotation_id, b.annotation_id AS reply_to FROM ann a LEFT JOIN ann b ON a.doc = b.doc AND a.in_reply_to = b.annotation_id",
    "join_annotation_dedupe": _ANN + "SELECT annotation_id::VARCHAR AS annotation_id, page, type, author, note, CASE WHEN page <= 2 THEN 'own' ELSE 'foreign' END AS origin FROM ann WHERE page <= 2 OR type IN ('highlight', 'text')",
    "top_comments_order": _ANN + 'SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, top DESC, "left", annotation_id) AS seq, annotation_id FROM ann',
    "join_annotation_export": _NOTED + """, b AS (SELECT doc, page, '### Annotations' || chr(10) || chr(10) || string_agg('- **' || CASE type WHEN 'comment' THEN 'Comment' WHEN 'highlight' THEN 'Highlight' WHEN 'bookmark' THEN 'Bookmark' WHEN 'text' THEN 'Text' WHEN 'signature' THEN 'Signature' ELSE 'Annotation' END
  || ':** ' || CASE WHEN trim(note) = '' THEN 'Signature' ELSE replace(replace(trim(note), '\\', '\\\\'), '`', '\\`') END, chr(10) ORDER BY top, "left", annotation_id) AS block FROM noted WHERE trim(note) <> '' OR type = 'signature' GROUP BY doc, page)
SELECT c_custkey AS doc, p.page, block FROM customer JOIN (SELECT unnest(range(1, 8))::INT AS page) p ON true LEFT JOIN b ON b.doc = c_custkey AND b.page = p.page""",
    "win_comment_pages": _NOTED + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, top DESC, "left", annotation_id) AS seq, count(*) OVER (PARTITION BY doc) AS total FROM noted),
k AS (SELECT *, sum(strlen(note) + coalesce(strlen(quote), 0) + strlen(author)) OVER (PARTITION BY doc ORDER BY seq) <= 110 AS ok FROM o WHERE seq > 2), n AS (SELECT *, 2 + count(*) FILTER (ok) OVER (PARTITION BY doc) AS e FROM k)
SELECT doc, CASE WHEN ok THEN seq END AS comment_no, CASE WHEN e < total THEN e::INT END AS next_offset FROM n WHERE ok OR seq = 3""",
    "win_comments_reply": _NOTED + """, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, top DESC, "left", annotation_id) AS INT) AS seq, CAST(count(*) OVER (PARTITION BY doc) AS INT) AS total FROM noted),
k AS (SELECT *, '{' || chr(10) || '      "id": ' || coalesce(to_json(annotation_id)::VARCHAR, 'null') || ',' || chr(10) || '      "page": ' || coalesce(to_json(page)::VARCHAR, 'null') || ',' || chr(10) || '      "type": ' || coalesce(to_json(type)::VARCHAR, 'null') || ',' || chr(10) || '      "author": ' || coalesce(to_json(author)::VARCHAR, 'null') || ',' || chr(10) || '      "note": ' || coalesce(to_json(note)::VARCHAR, 'null') || ',' || chr(10) || '      "noteTruncated": ' || coalesce('false', 'null') || ',' || chr(10) || '      "quote": ' || coalesce(to_json(quote)::VARCHAR, 'null') || ',' || chr(10) || '      "quoteTruncated": ' || coalesce('false', 'null') || chr(10) || '    }' AS item,
  sum(strlen(note) + coalesce(strlen(quote), 0) + strlen(author)) OVER (PARTITION BY doc ORDER BY seq) AS content FROM o WHERE seq > 2),
fit AS (SELECT doc, seq, item FROM k WHERE content <= 110),
sized AS (SELECT doc, max(total) AS total, unnest(range((SELECT count(*) FROM fit WHERE fit.doc = o.doc) + 1))::INT AS n FROM o GROUP BY doc),
replies AS (SELECT s.doc, n, total, '{' || chr(10) || '  "name": ' || coalesce(to_json('customer ' || s.doc)::VARCHAR, 'null') || ',' || chr(10) || '  "documentHash": ' || coalesce(to_json(sha256(s.doc::VARCHAR))::VARCHAR, 'null') || ',' || chr(10) || '  "totalComments": ' || coalesce(to_json(total)::VARCHAR, 'null') || ',' || chr(10) || '  "offset": ' || coalesce(to_json(least(2, total))::VARCHAR, 'null') || ',' || chr(10) || '  "comments": ' || coalesce(CASE WHEN n = 0 THEN '[]' ELSE '[' || chr(10) || '    ' || string_agg(item, ',' || chr(10) || '    ' ORDER BY seq) || chr(10) || '  ]' END, 'null') || ',' || chr(10) || '  "truncated": ' || coalesce(to_json(least(2, total) + n < total)::VARCHAR, 'null') || ',' || chr(10) || '  "nextOffset": ' || coalesce(CASE WHEN least(2, total) + n < total THEN to_json(least(2, total) + n)::VARCHAR END, 'null') || ',' || chr(10) || '  "omittedComments": ' || coalesce(to_json(total - least(2, total) - n)::VARCHAR, 'null') || chr(10) || '}' AS reply FROM sized s LEFT JOIN fit ON fit.doc = s.doc AND fit.seq <= 2 + n GROUP BY s.doc, n, total),
best AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN strlen(reply) <= 800 THEN n ELSE 0 END DESC, n) AS b FROM replies)
SELECT doc, n AS n_comments, CASE WHEN least(2, total) + n < total THEN least(2, total) + n END AS next_offset, total - least(2, total) - n AS omitted, strlen(reply) AS reply_bytes, reply FROM best WHERE b = 1""",
    "flt_safe_links": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS s FROM pages),
h AS (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS link_no FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))
SELECT page_id, -1 AS link_no, url, url AS href FROM p
UNION ALL SELECT page_id, -2, CASE page_id % 5 WHEN 0 THEN 'mailto:a' || page_id || '@example.org' WHEN 1 THEN 'javascript:alert(1)' WHEN 2 THEN '//relative/path' WHEN 3 THEN 'file:///x/' || page_id ELSE ' ' || chr(9) || upper(s) || url[length(s) + 1 :] || ' ' END,
  CASE page_id % 5 WHEN 0 THEN 'mailto:a' || page_id || '@example.org' WHEN 4 THEN url END FROM p
UNION ALL SELECT page_id, -3, s || '/x/./y/../' || page_id || ' b', s || '/x/' || page_id || '%20b' FROM p
UNION ALL SELECT page_id, link_no, url, CASE WHEN url LIKE 'http%' THEN url END FROM h""",
    "join_internal_links": """WITH p AS (SELECT page_id AS doc, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS n FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS l FROM pages)),
s AS (SELECT *, lower(regexp_replace(w, '[^\\p{L}\\p{N}\\s-]', '', 'g')) AS slug, length(w) AS z, doc % 4 + 5 AS pages FROM p),
names AS (SELECT DISTINCT doc, w, z AS nz FROM s WHERE n % 8 = 0), refs AS (SELECT DISTINCT doc, z AS rz FROM s WHERE z % 2 = 0), heads AS (SELECT DISTINCT doc, slug FROM s WHERE n % 2 = 1 AND slug <> ''),
x AS (SELECT s.doc, n, pages, s.slug, h.slug AS found, CASE WHEN n % 4 = 1 OR (n % 4 = 0 AND nz % 3 = 0) THEN z + 1 WHEN n % 4 = 2 OR (n % 4 = 0 AND nz % 3 = 1) THEN rz + 1 END AS page
  FROM s LEFT JOIN names USING (doc, w) LEFT JOIN refs ON refs.doc = s.doc AND rz = z LEFT JOIN heads h ON h.doc = s.doc AND h.slug = s.slug)
SELECT doc, n AS link_no, CASE WHEN n % 4 = 3 THEN CASE WHEN doc % 3 = 0 THEN 'elsewhere' WHEN found IS NOT NULL THEN 'heading' ELSE 'broken' END WHEN page <= pages THEN 'page' ELSE 'broken' END AS outcome,
  CASE WHEN n % 4 <> 3 AND page <= pages THEN CAST(page AS INT) END AS page, CASE WHEN n % 4 = 3 AND doc % 3 <> 0 THEN found END AS anchor FROM x""",
    "txt_keyword_scan": with_ctes("prose", _TEXT + """, hits AS (SELECT doc, page, text, source, term, trim(term) AS w, list_transform(string_split(lower(text), lower(trim(term))), lambda x: length(x)) AS n FROM searched, terms WHERE trim(term) <> ''),
starts AS (SELECT *, i - 1 AS ordinal, CAST(list_sum(n[1:i]) + (i - 1) * length(w) AS INT) AS start FROM (SELECT *, unnest(range(1, len(n))) AS i FROM hits))
SELECT doc, page, term, ordinal, start, CASE WHEN start > 42 THEN '...' ELSE '' END || text[greatest(0, start - 42) + 1 : least(length(text), start + length(w) + 42)] || CASE WHEN start + length(w) + 42 < length(text) THEN '...' ELSE '' END AS snippet, source FROM starts"""),
    "agg_find_matches": with_ctes("prose", _TEXT + "SELECT doc, term, CAST(sum(CASE WHEN trim(term) = '' THEN 0 ELSE len(string_split(lower(text), lower(trim(term)))) - 1 END) AS BIGINT) AS matches FROM searched, terms GROUP BY doc, term"),
    "win_nth_occurrence": with_ctes(
        "prose",
        ", terms AS (SELECT 'on' AS term)" + _POS + """, l AS (SELECT doc, page, list(start ORDER BY start) AS s FROM starts GROUP BY doc, page)
SELECT p.doc || ':' || p.page AS request_id, CAST(CASE WHEN preferred >= 0 AND lower(markdown[preferred + 1 : preferred + 2]) = 'on' THEN preferred ELSE coalesce(CASE WHEN p.doc % 6 > 0 THEN s[p.doc % 6] END, s[1]) END AS INT) AS start
FROM (SELECT *, instr(lower(markdown), 'on') - 1 + (doc % 3 - 1) * 40 AS preferred FROM prose) p LEFT JOIN l ON p.doc = l.doc AND p.page = l.page""",
    ),
    "agg_repetitive_descriptions": """WITH d0 AS (SELECT conv_id || ':' || turn AS id, text FROM conversations), d AS (SELECT * FROM d0 UNION ALL SELECT 'loop:' || id, repeat(text[1:20] || '; ', 7) FROM d0),
l AS (SELECT id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[;,]+'), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))), lambda x: length(x) > 2) AS s FROM d),
c AS (SELECT id, len(s) AS n, len(list_distinct(s)) AS k, list_max(list_transform(list_distinct(s), lambda x: len(list_filter(s, lambda y: y = x)))) AS m FROM l)
SELECT id, n AS segments, k AS distinct_segments, coalesce(n >= 6 AND (m >= 3 OR k / n < 0.55), false) AS repetitive FROM c""",
    "txt_image_descriptions": """SELECT c_custkey AS doc, i::INT AS image_no, CASE WHEN (c_custkey + i) % 7 > 1 THEN 'a drawing of the ' || lower(c_mktsegment) || ' picture ' || i END AS description, (c_custkey + i) % 3 = 0 AND (c_custkey + i) % 7 > 2 AS replaces_block
FROM customer, (SELECT unnest([1, 2, 3]) AS i)""",
}
