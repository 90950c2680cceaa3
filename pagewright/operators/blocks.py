"""Markdown pages to blocks, heading paths and outlines: gaps and islands, running values over document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import once, plain

LABEL_MOST, RUNNING_MOST, RUNNING_SHARE, RUNNING_LEAST = 48, 80, 0.4, 3


def line_kind(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^#{1,6}\s+.*$"), "heading")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(line.rlike(r"^\s*([-*+]|\d+\.)\s+"), "list")
        .otherwise("paragraph")
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """doc, page, first, b: the blocks of each page as an array of (kind, text), and the number of its first block.

    A page is cut where it is, in time linear in its lines: nothing is exploded, so the one window, which counts the
    blocks of the pages before, sorts pages and not lines.
    """

    def cut(lines: Column) -> Column:
        kinds = F.transform(lines, lambda x: F.when(F.trim(x) != "", line_kind(x)))

        def found(k: Column) -> Column:
            before = lambda i: F.get(k, i - 1)
            opens = lambda i: (i == 0) | F.get(k, i).isNull() | (F.get(k, i) == "heading") | before(i).isNull() | (before(i) != F.get(k, i))
            cuts = F.filter(F.sequence(F.lit(0), F.size(k) - 1), opens)  # a blank line stands alone
            text = lambda c, s, j: F.trim(F.array_join(F.slice(lines, s + 1, F.coalesce(F.get(c, j + 1), F.size(k)) - s), "\n"))
            block = lambda c: F.transform(c, lambda s, j: F.when(F.get(k, s).isNotNull(), F.struct(F.get(k, s).alias("kind"), text(c, s, j).alias("text"))))
            return F.array_compact(once(cuts, block))

        return once(kinds, found)

    p = pages.select("doc", "page", once(F.split(F.coalesce("markdown", F.lit("")), "\n", -1), cut).alias("b"))
    earlier = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("doc", "page", F.coalesce(F.sum(F.size("b")).over(earlier), F.lit(0)).cast("int").alias("first"), "b")


def blocks(pages: DataFrame) -> DataFrame:
    """doc, pos, page, kind, level, title, text. A block ends at a blank line, at a change of kind and at a heading;
    it never crosses a page. The numbering is by document."""
    found = page_blocks(pages).select("doc", "page", "first", F.posexplode("b").alias("i", "x")).select("doc", (F.col("first") + F.col("i")).alias("pos"), "page", "x.kind", "x.text")
    return with_headings(found).select("doc", "pos", "page", "kind", "level", "title", "text")


def with_headings(found: DataFrame) -> DataFrame:
    """Adds level and title of blocks that are headings."""
    heading = F.col("kind") == "heading"
    level = F.when(heading, F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)))
    title = F.when(heading, F.trim(F.regexp_extract("text", r"^#{1,6}\s+(.*)$", 1)))
    return found.withColumn("level", level).withColumn("title", title)


def heading_paths(found: DataFrame) -> DataFrame:
    """Adds headings: array of (title, page), outermost first, of the headings above a block, its own included.

    A heading of a level counts while no heading of a smaller level stands after it; one sort serves the six windows.
    """
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, 7):
        here = F.when(F.col("level") == k, F.struct("pos", "title", "page"))
        found = found.withColumn(f"_h{k}", F.last(here, ignorenulls=True).over(upto))
    kept, above = [], F.lit(-1)
    for k in range(1, 7):
        at = F.col(f"_h{k}.pos")
        kept.append(F.when(at > above, F.struct(F.col(f"_h{k}.title").alias("title"), F.col(f"_h{k}.page").alias("page"))))
        above = F.greatest(above, F.coalesce(at, F.lit(-1)))
    return found.withColumn("headings", F.array_compact(F.array(*kept))).drop(*[f"_h{k}" for k in range(1, 7)])


def outline(found: DataFrame, depth: int = 6) -> DataFrame:
    return found.where((F.col("kind") == "heading") & (F.col("level") <= depth)).select("doc", "pos", "level", "title", "page")


def page_outline(pages: DataFrame, depth: int = 6) -> DataFrame:
    """`outline` of pages. A heading is a block of one line, so of a page only its headings and the number of its blocks go
    on: the window that numbers the blocks sorts no page's text, and no other block is made."""

    def cut(lines: Column) -> Column:
        kinds = F.transform(lines, lambda x: F.when(F.trim(x) != "", line_kind(x)))

        def found(k: Column) -> Column:
            opens = lambda x, i: x.isNotNull() & ((i == 0) | (x == "heading") | F.get(k, i - 1).isNull() | (F.get(k, i - 1) != x))
            starts = F.filter(F.transform(k, lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull())
            row = lambda i, j: F.when(F.get(k, i) == "heading", F.struct(j.alias("i"), F.get(k, i).alias("kind"), F.trim(F.get(lines, i)).alias("text")))
            return once(starts, lambda c: F.struct(F.size(c).alias("n"), F.array_compact(F.transform(c, row)).alias("h")))

        return once(kinds, found)

    p = pages.select("doc", "page", once(F.split(F.coalesce("markdown", F.lit("")), "\n", -1), cut).alias("x")).select("doc", "page", "x.n", "x.h")
    earlier = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    p = p.select("doc", "page", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("int").alias("first"), F.col("h"))
    return outline(with_headings(p.select("doc", "page", "first", F.inline("h")).select("doc", (F.col("first") + F.col("i")).alias("pos"), "page", "kind", "text")), depth)


def outline_parents(headings: DataFrame) -> DataFrame:
    """doc, pos, parent_pos: the nearest earlier heading of a smaller level."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(before) for k in range(1, 7)]
    parent = F.greatest(*[F.when(F.col("level") > k, last[k - 1]) for k in range(1, 7)])
    return headings.select("doc", "pos", parent.alias("parent_pos"))


def running_text(found: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, plain, pages: short paragraphs that stand on many distinct pages (three, or two fifths of those supplied)."""
    total = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    short = found.where("kind = 'paragraph'").select("doc", "page", plain(F.col("text")).alias("plain"))
    short = short.where(F.length("plain").between(1, RUNNING_MOST)).groupBy("doc", "plain").agg(F.countDistinct("page").alias("pages"))
    least = F.greatest(F.lit(RUNNING_LEAST), F.ceil(F.col("total") * RUNNING_SHARE))
    return short.join(total, "doc").where(F.col("pages") >= least).select("doc", "plain", "pages")


def is_label(kind: Column, text: Column, words: Column) -> Column:
    """A one-line paragraph of at most 48 characters without sentence end, in emphasis or nearly all capitals."""
    t = F.trim(text)
    wrapped = (F.length(t) > 4) & (((F.left(t, F.lit(2)) == "**") & (F.right(t, F.lit(2)) == "**")) | ((F.left(t, F.lit(2)) == "__") & (F.right(t, F.lit(2)) == "__")))
    capitals = F.length(F.regexp_replace(words, "[^A-Z ]", "")) / F.length(words) >= 0.8
    shape = F.length(words).between(1, LABEL_MOST) & ~words.rlike("[.!?…]") & ~text.contains("\n") & (kind == "paragraph")
    return shape & (wrapped | (words.rlike("[A-Za-z]") & capitals))


def _with_running(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_blocks whose blocks also have their `plain` words; doc, running: (plain, pages) of the document's running text).

    Pages are together by document already, so neither counting nor joining shuffles them again.
    """
    p = page_blocks(pages).withColumn("b", F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), plain(x["text"]).alias("plain"))))
    short = F.filter("b", lambda x: (x["kind"] == "paragraph") & F.length(x["plain"]).between(1, RUNNING_MOST))
    return p, _running_of(p.select("doc", F.transform(short, lambda x: x["plain"]).alias("said")))


def _running_of(p: DataFrame) -> DataFrame:
    """doc, running: (plain, pages) of the running text of documents, of whose pages `said` has the short paragraphs."""
    said = F.array_union(F.array(F.lit(None).cast("string")), "said")  # the null counts pages
    n = p.select("doc", F.explode(said).alias("plain")).groupBy("doc", "plain").agg(F.count(F.lit(1)).alias("pages"))
    n = n.where(F.col("plain").isNull() | (F.col("pages") >= RUNNING_LEAST)).groupBy("doc")
    n = n.agg(F.max(F.when(F.col("plain").isNull(), F.col("pages"))).alias("total"), F.collect_list(F.when(F.col("plain").isNotNull(), F.struct("plain", "pages"))).alias("l"))
    return n.select("doc", F.filter("l", lambda x: x["pages"] >= F.ceil(F.col("total") * RUNNING_SHARE)).alias("running"))


def running_in(pages: DataFrame) -> DataFrame:
    """`running_text` of pages, whose blocks are found on the way."""
    return _with_running(pages)[1].select("doc", F.inline("running"))


def fold_pages(pages: DataFrame) -> DataFrame:
    """`fold_labels` of pages: doc, pos, page, kind, text, plain, role, local_headings. What becomes of a block is decided
    within its page, once the document's running text stands beside it."""
    p, running = _with_running(pages)
    p = p.join(running, "doc", "left").withColumn("r", F.transform(F.coalesce("running", F.array().cast("array<struct<plain:string,pages:bigint>>")), lambda x: x["plain"]))

    def marked(x: Column) -> Column:
        run = (x["kind"] == "paragraph") & F.array_contains("r", x["plain"])
        return F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["plain"].alias("plain"), run.alias("run"), (~run & is_label(x["kind"], x["text"], x["plain"])).alias("lab"))

    def roles(e: Column) -> Column:
        stays = F.filter(F.transform(e, lambda x, i: F.when(~x["run"] & ~x["lab"], i)), lambda i: i.isNotNull())
        row = lambda x, i, role, labels: F.struct(i.alias("i"), x["kind"].alias("kind"), x["text"].alias("text"), x["plain"].alias("plain"), role.alias("role"), labels.alias("local_headings"))

        def rows(c: Column) -> Column:
            before = lambda k: F.coalesce(F.get(c, k - 1), F.lit(-1))
            labels = lambda i, k: F.transform(F.filter(F.slice(e, before(k) + 2, i - before(k) - 1), lambda x: x["lab"]), lambda x: x["plain"])
            chunk = F.transform(c, lambda i, k: row(F.get(e, i), i, F.lit("chunk"), F.when(F.size(labels(i, k)) > 0, labels(i, k))))
            alone = lambda x, i: F.when(x["run"], "running").when(i < F.coalesce(F.get(c, F.size(c) - 1), F.lit(-1)), "folded").otherwise("chunk")
            others = F.transform(e, lambda x, i: F.when(x["run"] | x["lab"], row(x, i, alone(x, i), F.lit(None).cast("array<string>"))))
            return F.concat(chunk, F.array_compact(others))

        return once(stays, rows)

    f = p.select("doc", "page", "first", F.explode(once(F.transform("b", marked), roles)).alias("x"))
    return f.select("doc", (F.col("first") + F.col("x.i")).alias("pos"), "page", "x.kind", "x.text", "x.plain", "x.role", "x.local_headings")


def foldable_pages(pages: DataFrame) -> DataFrame:
    """What `fold_pages` and `heading_paths` decide by, a row for each page: doc, page, first, b (kind, text, run, label),
    heads (i, level, title), above (level, title, page of the headings that the page
    stands under, outermost first), again (is it a further row of the page before?).

    Windows and the join sort pages by document and nothing else, and rows stay in the order of pages. `run` is running
    text, `label` the words of a label that isn't.
    """
    p = page_blocks(pages)
    paragraph = lambda x: x["kind"] == "paragraph"
    words = F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), F.when(paragraph(x), plain(x["text"])).alias("plain")))
    p = p.withColumn("b", words).withColumn("said", F.transform(F.filter("b", lambda x: F.length(x["plain"]).between(1, RUNNING_MOST)), lambda x: x["plain"]))
    running = _running_of(p.select("doc", "said"))
    lab = lambda x: paragraph(x) & F.length(x["plain"]).between(1, LABEL_MOST) & is_label(x["kind"], x["text"], x["plain"])
    p = p.withColumn("b", F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["plain"].alias("plain"), lab(x).alias("lab")))).drop("said")
    heads = F.filter(F.transform("b", lambda x, i: F.when(x["kind"] == "heading", F.struct(i.alias("i"), x["text"].alias("text")))), lambda x: x.isNotNull())
    level = lambda t: F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))
    title = lambda t: F.trim(F.regexp_extract(t, r"^#{1,6}\s+(.*)$", 1))
    p = p.withColumn("heads", F.transform(heads, lambda x: F.struct(x["i"].alias("i"), level(x["text"]).alias("level"), title(x["text"]).alias("title"))))
    at_level = lambda k: lambda x: x["level"] == k
    order = Window.partitionBy("doc").orderBy("page")
    before, kept, above = order.rowsBetween(Window.unboundedPreceding, -1), [], F.lit(-1)
    p = p.withColumn("again", F.coalesce(F.lag("page").over(order).eqNullSafe(F.col("page")) & (F.col("first") > 0), F.lit(False)))
    for k in range(1, 7):
        own = F.try_element_at(F.filter("heads", at_level(k)), F.lit(-1))
        here = F.when(own.isNotNull(), F.struct((F.col("first") + own["i"]).alias("pos"), own["title"].alias("title"), F.col("page").alias("page")))
        p = p.withColumn(f"_h{k}", F.last(here, ignorenulls=True).over(before))
    for k in range(1, 7):
        at = F.col(f"_h{k}.pos")
        kept.append(F.when(at > above, F.struct(F.lit(k).alias("level"), F.col(f"_h{k}.title").alias("title"), F.col(f"_h{k}.page").alias("page"))))
        above = F.greatest(above, F.coalesce(at, F.lit(-1)))
    p = p.select("doc", "page", "first", "b", "heads", F.array_compact(F.array(*kept)).alias("above"), "again")
    own = running.select("doc", F.transform("running", lambda x: x["plain"]).alias("r"))
    p = p.join(own, "doc", "left").withColumn("r", F.coalesce("r", F.array().cast("array<string>")))
    run = lambda x: paragraph(x) & F.array_contains("r", x["plain"])
    marked = F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), run(x).alias("run"), F.when(x["lab"] & ~run(x), x["plain"]).alias("label")))
    return p.select("doc", "page", "first", marked.alias("b"), "heads", "above", "again")


def fold_labels(found: DataFrame, running: DataFrame) -> DataFrame:
    """doc, pos, role, local_headings: what becomes of each block.

    `running` blocks make no chunk; a label goes to the next block of its page that does (`folded`), or stands alone.
    """
    b = found.withColumn("plain", plain(F.col("text")))
    b = b.join(running.select("doc", "plain", F.lit(True).alias("_run")), ["doc", "plain"], "left")
    b = b.withColumn("is_run", F.coalesce("_run", F.lit(False)) & (F.col("kind") == "paragraph"))
    b = b.withColumn("is_lab", ~F.col("is_run") & is_label(F.col("kind"), F.col("text"), F.col("plain")))
    after = Window.partitionBy("doc", "page").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    follower = F.first(F.when(~F.col("is_run") & ~F.col("is_lab"), F.col("pos")), ignorenulls=True).over(after)
    b = b.withColumn("to", F.when(F.col("is_lab"), follower))
    role = F.when(F.col("is_run"), "running").when(F.col("to").isNotNull(), "folded").otherwise("chunk")
    b = b.withColumn("role", role)
    labels = b.where("to is not null").groupBy("doc", F.col("to").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "plain"))), lambda x: x["plain"]).alias("local_headings"))
    return b.select("doc", "pos", "page", "kind", "text", "plain", "role").join(labels, ["doc", "pos"], "left")
