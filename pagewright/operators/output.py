"""Replies of bounded size: Markdown export, page selection, byte budgets, ranges, pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, once

MOST_RANGE = 10_000


def export_markdown(pages: DataFrame, mode: str = "pages") -> DataFrame:
    """doc, markdown: `pages` keeps an anchor and a heading for each page, `clean` joins the pages that have text."""
    if mode == "clean":
        text, between, kept = F.trim("markdown"), "\n\n", pages.where(~is_blank(F.col("markdown")))
    else:
        n = F.col("page").cast("string")
        text, between, kept = F.concat(F.lit('<a id="page-'), n, F.lit('"></a>\n\n## Page '), n, F.lit("\n\n"), F.trim("markdown")), "\n\n---\n\n", pages
    parts = kept.select("doc", "page", text.alias("t")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("l"))
    return parts.select("doc", F.array_join(F.transform("l", lambda x: x["t"]), between).alias("markdown"))


def select_pages(pages: DataFrame, selections: DataFrame) -> DataFrame:
    """doc, page, refusal: the pages of selections like `1,4-6`; a refused selection has one row without page.

    Parts, and the ends of a range, may have blanks around them. Refused are empty or malformed parts and page 0, reversed
    ranges, ranges or whole selections of over MOST_RANGE pages, and pages beyond the end; of several reasons the first
    part's counts.
    """
    total = pages.groupBy("doc").agg(F.max("page").alias("n"))
    s = selections.join(total, "doc").withColumn("parts", F.transform(F.split("selection", ",", -1), lambda p: F.regexp_replace(F.trim(p), r"\s*-\s*", "-")))
    number = r"0*[1-9]\d{0,14}"
    lo = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("long")
    hi = lambda p: F.regexp_extract(p, r"(\d+)$", 1).try_cast("long")
    reason = lambda p: F.when(~p.rlike(f"^{number}(-{number})?$"), "malformed").when(lo(p) > hi(p), "reversed").when(hi(p) - lo(p) >= MOST_RANGE, "too-long")
    s = s.withColumn("refusal", F.get(F.filter(F.transform("parts", reason), lambda r: r.isNotNull()), F.lit(0)))
    ranges = F.when(F.col("refusal").isNull(), F.array_distinct(F.flatten(F.transform("parts", lambda p: F.sequence(lo(p), hi(p))))))
    s = s.withColumn("pages", ranges)
    late = F.when(F.size("pages") > MOST_RANGE, "too-long").when(F.array_max("pages") > F.col("n"), "beyond-end")
    s = s.withColumn("refusal", F.coalesce("refusal", late))
    s = s.select("doc", "refusal", F.explode_outer(F.when(F.col("refusal").isNull(), F.col("pages"))).alias("page"))
    return s.select("doc", F.col("page").cast("int").alias("page"), "refusal")


def pages_beyond(selection: DataFrame, documents: DataFrame) -> DataFrame:
    """Selected pages that the documents don't have."""
    return selection.select("doc", "page").distinct().join(documents.select("doc", "page_count"), "doc").where("page > page_count or page < 1").select("doc", "page")


def content_budget(items: DataFrame, keys: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Adds kept, omitted_bytes, total_bytes: whole items while the running sum of UTF-8 bytes stays in the budget."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = F.sum(F.octet_length(text)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy(*keys)
    x = items.withColumn("kept", upto <= budget)
    size = F.octet_length(text)
    return x.withColumn("total_bytes", F.sum(size).over(whole)).withColumn("omitted_bytes", F.sum(F.when(F.col("kept"), 0).otherwise(size)).over(whole))


def fitting(text: Column, room: Column) -> Column:
    """The start of `text` that fits `room` bytes of UTF-8: all of it, else up to its last line end (without that) if
    there is one after the first character, else as many whole characters as fit."""
    b = F.encode(text, "UTF-8")
    inside = lambda i: F.hex(F.substring(b, i, F.lit(1))).between("80", "BF")  # noqa: E731  a byte that continues a character
    n = F.when(~inside(room + 1), room).when(~inside(room), room - 1).when(~inside(room - 1), room - 2).otherwise(room - 3)
    head = F.decode(F.substring(b, F.lit(1), F.greatest(n, F.lit(0))), "UTF-8")

    def ended(h: Column) -> Column:
        last = F.length(h) - F.locate("\n", F.reverse(h))
        return F.when(F.contains(h, F.lit("\n")) & (last > 0), F.left(h, last)).otherwise(h)

    return F.when(F.octet_length(text) <= room, text).otherwise(once(head, ended))


def page_budget(pages: DataFrame, budget: int) -> DataFrame:
    """doc, page, markdown, shortened: whole pages while their bytes fit; the one across the budget is shortened, at a
    line end if there is one; the first always stays."""
    w = Window.partitionBy("doc").orderBy("page")
    size = F.octet_length("markdown")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = pages.withColumn("_before", before).withColumn("_n", F.row_number().over(w)).where((F.col("_before") < budget) | (F.col("_n") == 1))
    p = p.withColumn("_cut", fitting(F.col("markdown"), (F.lit(budget) - F.col("_before")).cast("int")))
    return p.where((F.length("_cut") > 0) | (size == 0) | (F.col("_n") == 1)).select("doc", "page", F.col("_cut").alias("markdown"), (F.octet_length("_cut") < size).alias("shortened"))


def reply_pack(hits: DataFrame, budget: int = 48_000) -> DataFrame:
    """query_id, kept, omitted, reply_bytes: the longest prefix of hits whose compact JSON fits."""
    j = hits.withColumn("_b", F.octet_length(F.to_json(F.struct(*[c for c in hits.columns if c != "query_id"]))) + 1)
    upto = F.sum("_b").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 14
    j = j.withColumn("_k", upto <= budget)
    return j.groupBy("query_id").agg(F.count_if("_k").alias("kept"), F.count_if(~F.col("_k")).alias("omitted"), (F.coalesce(F.sum(F.when(F.col("_k"), F.col("_b"))), F.lit(0)) + 14).alias("reply_bytes"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """doc, ranges: like `1-3,7,10-12`."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    r = pages.select("doc", "page").distinct().withColumn("g", island).groupBy("doc", "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return r.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))), lambda x: x["s"]), ",").alias("ranges"))


def text_page(text: Column, offset: Column, budget: Column) -> Column:
    """struct(text, next_offset, omitted_bytes): what fits `budget` bytes from character `offset` on (at most the end);
    next_offset is null at the end, omitted_bytes are those that follow."""
    start = F.least(offset, F.length(text))

    def cut(piece: Column) -> Column:
        end = start + F.length(piece)
        return F.struct(piece.alias("text"), F.when(end < F.length(text), end).alias("next_offset"), F.octet_length(F.substr(text, end + 1)).alias("omitted_bytes"))

    return once(fitting(F.substr(text, start + 1), budget), cut)


def comment_pages(comments: DataFrame, offset: int, budget: int, field: int = 4_000) -> DataFrame:
    """doc, comment_no, next_offset: comments in reading order after the first `offset`, while the bytes of their notes,
    quotes (both cut to `field` bytes) and authors fit the budget.

    The budget holds for the first comment too: if that doesn't fit, the document has one row without comment_no, and the
    next offset is the one asked for. next_offset is null where no comment is left.
    """
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    fields = size(fitting(F.col("note"), F.lit(field))) + size(fitting(F.col("quote"), F.lit(field))) + size(F.col("author"))
    w = Window.partitionBy("doc").orderBy("seq")
    c = comments.where(F.col("seq") > offset).withColumn("_upto", F.sum(fields).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    c = c.withColumn("_ok", F.col("_upto") <= budget).where((F.col("seq") == offset + 1) | F.col("_ok"))
    end = offset + F.count_if("_ok").over(Window.partitionBy("doc"))
    return c.select("doc", F.when(F.col("_ok"), F.col("seq")).alias("comment_no"), F.when(end < F.col("total"), end).cast("int").alias("next_offset"))


def json_object(fields: dict[str, Column], indent: str) -> Column:
    """JSON of several lines, two more blanks a level; the values are JSON already."""
    lines = [F.concat(F.lit(f'{indent}  "{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit(f"\n{indent}}}"))


def json_value(value: Column) -> Column:
    one = F.to_json(F.array(value))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def comments_reply(comments: DataFrame, offset: int, content_budget: int, reply_budget: int, field: int = 4_000) -> DataFrame:
    """doc, n_comments, next_offset, omitted, reply_bytes, reply: the comments after the first `offset`, as many as both
    budgets hold, in one JSON text for each document; none may be left.

    `comments` have doc, name, document_hash, seq, total, id, page, type, author, note, quote. First the notes, quotes and
    authors must fit the content budget, as in `comment_pages`; then the bytes of the whole reply, with all it says of what
    is left out, must fit the reply budget. A reply without comments is given even if it alone is too long.
    """
    cut = {c: fitting(F.col(c), F.lit(field)) for c in ("note", "quote")}
    item = {c: json_value(cut.get(c, F.col(c))) for c in ("id", "page", "type", "author", "note")}
    short = lambda c: json_value(F.coalesce(F.octet_length(c) > field, F.lit(False)))
    item |= {"noteTruncated": short("note"), "quote": json_value(cut["quote"]), "quoteTruncated": short("quote")}
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in (cut["note"], cut["quote"], F.col("author"))), F.lit(0))
    upto = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.least(F.lit(offset), F.col("total"))

    def reply(n: Column, items: Column) -> Column:
        end = (start + n).cast("int")
        left = end < F.col("total")
        list_ = F.when(n > 0, F.concat(F.lit("[\n    "), items, F.lit("\n  ]"))).otherwise("[]")
        head = {"name": F.col("name"), "documentHash": F.col("document_hash"), "totalComments": F.col("total"), "offset": start}
        tail = {"truncated": left, "nextOffset": F.when(left, end), "omittedComments": F.col("total") - end}
        value = lambda d: {k: json_value(v) for k, v in d.items()}
        return json_object({**value(head), "comments": list_, **value(tail)}, "")

    between = ",\n    "
    c = comments.where(F.col("seq") > offset).withColumn("_item", json_object(item, "    ")).withColumn("_content", F.sum(size).over(upto)).where(F.col("_content") <= content_budget)
    c = c.withColumn("_n", F.col("seq") - offset).withColumn("_items", F.sum(F.octet_length("_item") + len(between)).over(upto) - len(between))
    c = c.withColumn("_bytes", F.octet_length(reply(F.col("_n"), F.lit(""))) + F.col("_items"))
    most = F.max(F.when(F.col("_bytes") <= reply_budget, F.col("_n"))).over(Window.partitionBy("doc"))
    c = c.withColumn("_most", most).where(F.col("_n") <= F.col("_most"))
    kept = c.groupBy("doc").agg(F.max("_n").alias("_kept"), F.array_sort(F.collect_list(F.struct("seq", "_item"))).alias("_l"))  # within the reply budget
    d = comments.groupBy("doc").agg(*[F.first(x).alias(x) for x in ("name", "document_hash", "total")]).join(kept, "doc", "left")
    n = F.coalesce("_kept", F.lit(0)).cast("int")
    d = d.withColumn("reply", reply(n, F.coalesce(F.array_join(F.transform("_l", lambda x: x["_item"]), between), F.lit(""))))
    end = (start + n).cast("int")
    return d.select("doc", n.alias("n_comments"), F.when(end < F.col("total"), end).alias("next_offset"), (F.col("total") - end).cast("int").alias("omitted"), F.octet_length("reply").alias("reply_bytes"), "reply")
