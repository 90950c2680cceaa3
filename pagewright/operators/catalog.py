"""The catalogue: versions of a path, read grants, reuse of finished work, updates and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank


def latest_versions(documents: DataFrame) -> DataFrame:
    """The newest row of each path (last_opened, then doc), and every row without a path."""
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.col("last_opened").desc(), F.col("doc").desc()))
    named = documents.where("path is not null").withColumn("_n", newest).where("_n = 1").drop("_n")
    return named.unionByName(documents.where("path is null"))


def inside(path: Column, root: Column) -> Column:
    """Lexically inside: the root itself or below it; a sibling with the same beginning is outside."""
    below = path.startswith(F.concat(root, F.lit("/")))
    return (path == root) | (below & ~F.substr(path, F.length(root) + 2, F.lit(2)).eqNullSafe(F.lit("..")))


def discoverable(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents whose path is known for certain and lies in a granted root. The roots are a short list: below 1,000 they
    are broadcast, beyond that every path is looked up by its own ancestors."""
    known = documents.where("path is not null and path_provenance = 'resolved'")
    if roots.limit(1_001).count() <= 1_000:
        return known.join(F.broadcast(roots), inside(F.col("path"), F.col("root")), "left_semi")
    parts = F.split("path", "/", -1)
    ancestors = known.withColumn("_root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    return ancestors.join(roots, F.col("_root") == F.col("root")).where(inside(F.col("path"), F.col("root"))).drop("_root", "root").dropDuplicates(["doc"])


def library_counts(documents: DataFrame, roots: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: documents searched, not discoverable, outside the scope (no chunk in it)."""
    latest = latest_versions(documents).where("path is not null").select("doc", "path", "path_provenance")
    seen = discoverable(latest, roots).select(F.col("doc").alias("_seen"))
    has = indexed.select(F.col("doc").alias("_has")).distinct()
    x = latest.join(seen, F.col("doc") == F.col("_seen"), "left").join(has, F.col("doc") == F.col("_has"), "left")
    n = lambda c: F.count_if(c)
    ok = F.col("_seen").isNotNull()
    return x.agg(n(ok & F.col("_has").isNotNull()).alias("searched"), n(~ok).alias("not_discoverable"), n(ok & F.col("_has").isNull()).alias("outside_scope"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each content hash. Name, path and its provenance, size, page count and text source are those of the
    newest row, nulls included; engine and Markdown version keep what was known where the newest is null, text and
    recognition versions where it is 0; doc and created stay the first, last_opened is the last."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(incoming.withColumn("_seq", F.lit(1)))
    when = F.struct("_seq", "last_opened", "doc")
    newest = F.max_by(F.struct("name", "path", "path_provenance", "size", "page_count", "text_source"), when)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c)
    said = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != 0, when)), F.lit(0)).alias(c)
    merged = both.groupBy("content_hash").agg(
        F.min_by("doc", when).alias("doc"), newest.alias("_new"), said("text_version"), said("ocr_version"), known("engine"), known("markdown_version"),
        F.min_by("created", when).alias("created"), F.max_by("last_opened", when).alias("last_opened"),
    )
    return merged.select("*", "_new.*").drop("_new")


def reusable(incoming: DataFrame, documents: DataFrame, pages: DataFrame, finished: DataFrame, chunks: DataFrame, current: dict[str, object]) -> DataFrame:
    """doc, reusable, chunk_count for each incoming content hash: text, recognition, engine and Markdown of the versions
    in `current` (column: value), a page for each page, none unresolved, the scope marked as finished, and chunks unless
    all pages are blank."""
    state = pages.groupBy("doc").agg(F.count_if(F.col("status") == "unresolved").alias("open"), F.bool_and(is_blank(F.col("markdown"))).alias("blank"), F.countDistinct("page").alias("cached"))
    n = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("chunk_count"))
    d = documents.select("doc", "content_hash", "page_count", *current).join(state, "doc", "left").join(n, "doc", "left").join(finished.select("doc", F.lit(True).alias("finished")), "doc", "left")
    n = F.coalesce("chunk_count", F.lit(0))
    ok = F.coalesce("finished", F.lit(False)) & (F.coalesce("open", F.lit(1)) == 0) & (F.col("cached") == F.col("page_count")) & ((n > 0) | F.coalesce("blank", F.lit(True)))
    for column, value in current.items():
        ok = ok & F.col(column).eqNullSafe(F.lit(value))
    d = d.select("doc", "content_hash", F.coalesce(ok, F.lit(False)).alias("reusable"), n.alias("chunk_count"))
    return incoming.select("content_hash").distinct().join(d, "content_hash").select("doc", "reusable", "chunk_count")


def exact_chunks(docs: DataFrame, expected: DataFrame, stored: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, outcome for each of `docs`: `conflicted` unless exactly the expected chunks are stored (none at all may be
    both), else `claimed` if there is a text of the document, else `unclaimed`."""
    both = expected.select("doc", "chunk_id", F.lit(1).alias("e")).join(stored.select("doc", "chunk_id", F.lit(1).alias("s")), ["doc", "chunk_id"], "full_outer")
    same = both.groupBy("doc").agg(F.bool_and(F.col("e").isNotNull() & F.col("s").isNotNull()).alias("same"))
    asked = docs.select("doc").distinct().join(same, "doc", "left").join(texts.select("doc").distinct().withColumn("t", F.lit(True)), "doc", "left")
    return asked.select("doc", F.when(~F.coalesce("same", F.lit(True)), "conflicted").when(F.col("t"), "claimed").otherwise("unclaimed").alias("outcome"))


def chunk_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id, change: what to add and what to delete between two readings."""
    a, b = old.select("chunk_id"), new.select("chunk_id")
    return b.exceptAll(a).withColumn("change", F.lit("add")).unionByName(a.exceptAll(b).withColumn("change", F.lit("delete")))


def orphans(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """kind, id: vectors without a chunk, chunks without a document."""
    lone = vectors.join(chunks, "chunk_id", "left_anti").select(F.lit("vector").alias("kind"), F.col("chunk_id").alias("id"))
    return lone.unionByName(chunks.join(documents, "doc", "left_anti").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")))


def stale(chunks: DataFrame, current: int) -> DataFrame:
    return chunks.where(F.col("chunk_version") != current).select("doc").distinct()
