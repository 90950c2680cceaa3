"""What was read and what was not: page sources, outcomes, audits of extractions and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, plain, strip

# Below so many visible characters a page is sparse, a sample of pages weak; shares of sampled pages.
SPARSE, WEAK, TEXTLESS = 100, 600, 0.6


def needs_recognition(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce("needs_ocr", F.lit(False)) | is_blank(F.col("markdown"))).select("doc", "page")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))


def sparse_pages(pages: DataFrame, ocr: DataFrame, least: int = SPARSE) -> DataFrame:
    """doc, page, native_chars, source, warning: a sparse page takes the recognised text if there is any. Warned of are
    pages without any text, and sparse ones that nothing was recognised on."""
    p = pages.join(ocr.select("doc", "page", F.col("markdown").alias("ocr")), ["doc", "page"], "left")
    native, other = visible_chars(F.col("markdown")), visible_chars(F.col("ocr"))
    thin = native < least
    warning = F.when((native == 0) & (other == 0), "no-text").when(thin & (other == 0), "low-confidence")
    return p.select("doc", "page", native.alias("native_chars"), F.when(thin & (other > 0), "ocr").otherwise("pdf").alias("source"), warning.alias("warning"))


def merge_sources(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc, page, markdown, source, status. A page that is flagged, or has no text, takes what was recognised or nothing:
    it is `empty` if recognition was asked and gave nothing, `unresolved` if nobody asked. Others keep their own text."""
    p = pages.join(ocr.select("doc", "page", F.col("markdown").alias("ocr")), ["doc", "page"], "left")
    unread, got = F.coalesce("needs_ocr", F.lit(False)) | is_blank(F.col("markdown")), ~is_blank(F.col("ocr"))
    text = F.when(~unread, strip(F.col("markdown"))).when(got, strip(F.col("ocr"))).otherwise("")
    status = F.when(~unread | got, "read").when(F.coalesce("asked", F.lit(False)), "empty").otherwise("unresolved")
    return p.select("doc", "page", text.alias("markdown"), F.when(~unread, "pdf").when(got, "ocr").otherwise("none").alias("source"), status.alias("status"))


def merge_region_text(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """doc, page, markdown, source: after the page's own text and a blank line, the trimmed lines recognised in images
    that its visible words don't hold."""
    lines = regions.select("doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    p = pages.withColumn("_own", plain(F.col("markdown")))
    said = plain(F.col("line"))
    new = lines.join(p.select("doc", "page", "_own"), ["doc", "page"]).where((said != "") & ~F.contains("_own", said)).withColumn("line", strip(F.col("line")))
    new = new.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("more"))
    p = p.join(new, ["doc", "page"], "left")
    text = F.when(F.col("more").isNull(), F.col("markdown")).otherwise(F.concat("markdown", F.lit("\n\n"), "more"))
    return p.select("doc", "page", text.alias("markdown"), F.when(F.col("more").isNull(), "pdf").otherwise("mixed").alias("source"))


def text_source(pages: DataFrame) -> DataFrame:
    """doc, text_source: pdf, ocr, mixed, or none if no page has text."""
    p = pages.where(~is_blank(F.col("markdown"))).groupBy("doc").agg(F.bool_or(F.col("source").isin("pdf", "mixed")).alias("a"), F.bool_or(F.col("source").isin("ocr", "mixed")).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "mixed").when(F.col("a"), "pdf").when(F.col("b"), "ocr").otherwise("none")
    return pages.select("doc").distinct().join(p, "doc", "left").select("doc", kind.alias("text_source"))


def coverage(pages: DataFrame) -> DataFrame:
    """doc, index_status, unresolved_count, unresolved_pages (as text, ascending)."""
    open_ = F.col("status") == "unresolved"
    p = pages.groupBy("doc").agg(F.count_if(open_).alias("unresolved_count"), F.array_sort(F.collect_list(F.when(open_, F.col("page")))).alias("l"), F.count_if(F.col("status").isNull()).alias("unknown"))
    status = F.when(F.col("unknown") > 0, "unknown").when(F.col("unresolved_count") > 0, "incomplete").otherwise("complete")
    return p.select("doc", status.alias("index_status"), "unresolved_count", F.concat_ws(",", F.col("l").cast("array<string>")).alias("unresolved_pages"))


def validate_extraction(pages: DataFrame, ocr_list: DataFrame) -> DataFrame:
    """doc, rule, page: pages that are not 1..n in order, repeated list entries, flags that the list contradicts."""
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    order = pages.withColumn("_n", seq).where("_n <> page").groupBy("doc").agg(F.min("page").alias("page")).select("doc", F.lit("order").alias("rule"), "page")
    twice = ocr_list.groupBy("doc", "page").count().where("count > 1").select("doc", F.lit("repeated").alias("rule"), "page")
    flagged = pages.where("needs_ocr").select("doc", "page", F.lit(1).alias("f"))
    listed = ocr_list.select("doc", "page").distinct().withColumn("l", F.lit(1))
    odd = flagged.join(listed, ["doc", "page"], "full_outer").where("f is null or l is null")
    odd = odd.select("doc", F.when(F.col("f").isNull(), "listed-not-flagged").otherwise("flagged-not-listed").alias("rule"), "page")
    return order.unionByName(twice).unionByName(odd)


def validate_cache(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, rule, expected, found: cached pages that don't cover 1..page_count, versions below 1."""
    n = pages.groupBy("doc").agg(F.countDistinct("page").alias("found"), F.max("page").alias("last"))
    d = documents.select("doc", "page_count", "text_version").join(n, "doc", "left")
    cover = d.where((F.coalesce("found", F.lit(0)) != F.col("page_count")) | (F.coalesce("last", F.lit(0)) != F.col("page_count")))
    cover = cover.select("doc", F.lit("coverage").alias("rule"), F.col("page_count").cast("long").alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    version = d.where("text_version < 1").select("doc", F.lit("version").alias("rule"), F.lit(1).cast("long").alias("expected"), F.col("text_version").cast("long").alias("found"))
    return cover.unionByName(version)


def validate_vectors(vectors: DataFrame) -> DataFrame:
    """id, reason: a length that isn't the recorded one, or a number that isn't finite."""
    bad = F.exists("vector", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    reason = F.when(F.col("vector").isNull(), "missing").when(F.size("vector") != F.col("dims"), "dimensions").when(bad, "not-finite")
    return vectors.select("id", reason.alias("reason")).where("reason is not null")


def recognition_targets(unread: DataFrame, regions: DataFrame) -> DataFrame:
    return unread.select("doc", "page").unionByName(regions.select("doc", "page")).distinct()


def extraction_profile(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """doc, chars, sparse, images, engine: from pages 1, 2, 3, the middle and the last; `images` counts those with images.

    The engine is `visual` for a weak text layer (few characters, or mostly sparse pages) with images in the sample or
    anything recognised in the document before, else `standard`. `recognised` has a row for each recognised page.
    """
    total = pages.groupBy("doc").agg(F.max("page").alias("n"))
    p = pages.join(total, "doc").where((F.col("page") <= 3) | (F.col("page") == F.ceil(F.col("n") / 2)) | (F.col("page") == F.col("n")))
    c = visible_chars(F.col("markdown"))
    p = p.groupBy("doc").agg(F.sum(c).alias("chars"), F.count_if(c < SPARSE).alias("sparse"), F.count_if("has_image").alias("images"), F.count(F.lit(1)).alias("sampled"))
    p = p.join(recognised.select("doc", F.lit(True).alias("ocr")).distinct(), "doc", "left")
    weak = (F.col("chars") < WEAK) | (F.col("sparse") / F.col("sampled") >= TEXTLESS)
    engine = F.when(weak & ((F.col("images") > 0) | F.col("ocr").isNotNull()), "visual").otherwise("standard")
    return p.select("doc", "chars", "sparse", "images", engine.alias("engine"))


def image_pages(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc, page, coverage, qualifies: images over a twentieth of the page, one of 10,000 square points, not rotated."""
    r = regions.groupBy("doc", "page").agg(F.sum("area").alias("a"), F.max("area").alias("m")).join(boxes, ["doc", "page"])
    cover = F.round(F.least(F.lit(1.0), F.col("a") / (F.col("width") * F.col("height"))), 6)
    return r.select("doc", "page", cover.alias("coverage"), ((cover >= 0.05) & (F.col("m") >= 10_000) & (F.col("rotation") == 0)).alias("qualifies"))
