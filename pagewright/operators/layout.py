"""Positioned text: lines, tables from recognised words, outlines without headings, quotes, and page alignment.

Where the rule is a fold (a running median, a cursor), it runs by page or by document in `applyInPandas`; groups are a
page or one document's page windows, never a table.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.groups import fold_groups
from pagewright.functions.text import collapse

LINES = "doc long, page int, line int, text string, x double, y double, font_size double, bold boolean"
LINES_NAMES = [part.split()[0] for part in LINES.split(", ")]
LINES_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]


def _lines_of(atoms: list[tuple]) -> list[tuple]:
    """(text, x, y, font_size, bold) of each line of a page's atoms (y, x, text, font_size, bold)."""

    def middle(of: list[float]) -> float:  # in order
        return (of[(len(of) - 1) // 2] + of[len(of) // 2]) / 2

    out, line, sizes, heights = [], [], [], []  # sizes and heights: the line's, in order

    def close() -> None:
        own = sorted(line, key=lambda a: a[1])
        text = " ".join(" ".join(a[2] for a in own).split())
        if text:
            out.append((text, float(own[0][1]), float(middle(heights)), float(middle(sizes)), any(a[4] for a in own)))
        for part in (line, sizes, heights):
            part.clear()

    for a in sorted(atoms, key=lambda a: (-a[0], a[1])):
        if line and abs(middle(heights) - a[0]) > max(2.0, 0.35 * max(middle(sizes), a[3])):
            close()
        line.append(a)
        insort(sizes, a[3])
        insort(heights, a[0])
    close()
    return out


def text_lines(atoms: DataFrame) -> DataFrame:
    """doc, page, line, text, x, y, font_size, bold: atoms from top to bottom join a line while they are within
    max(2, 0.35 x font) of its median height, where the font is the greater of the line's median and the atom's own."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, i, *line) for i, line in enumerate(_lines_of([r[2:] for r in rows]))]

    return fold_groups(atoms.select("doc", "page", "y", "x", "text", "font_size", "bold"), ["doc", "page"], [], fold, LINES)


def _listed(column: pa.ListArray) -> Iterator[list[tuple]]:
    """The structs of each row's list, as tuples in the order of their fields."""
    flat = column.flatten()
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    rows = list(zip(*[f.to_pylist() for f in flat.flatten()], strict=True))
    for i in range(len(column)):
        yield rows[offsets[i] : offsets[i + 1]]


def page_lines(pages: DataFrame) -> DataFrame:
    """`text_lines` of pages whose atoms stand in one row: doc, page, atoms (array of y, x, text, font_size, bold). A page
    is folded where it is, nothing is shuffled."""

    def run(batches):
        for b in batches:
            out = [(doc, page, i, *line) for doc, page, atoms in zip(b["doc"].to_pylist(), b["page"].to_pylist(), _listed(b["atoms"]), strict=True) for i, line in enumerate(_lines_of(atoms))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), LINES_ARROW, strict=True)], LINES_NAMES)

    return pages.where("atoms is not null").select("doc", "page", "atoms").mapInArrow(run, LINES)


# Ratios to the body's font, length and word limits, patterns of lines that are no headings.
NUMBERED = r"^(\d+(?:\.\d+){0,4})([.)])?\s+\S"
NO_HEADING = (r"^\d+$", r"(?i)^page\s+\d+", r"^\d{4}[.)]", r"(?i)https?://", r"(?i)\bwww\.", r"^[\d\s._-]+$")
BAND, LEVELS = 0.75, 3


def synthetic_outline(lines: DataFrame, most: int = 250, page_height: float = 792.0) -> DataFrame:
    """doc, page, seq, level, title: lines that stand out by size, weight or a number, in order, at most `most` a document.

    Left out are lines that repeat on three pages and a quarter of all, those in the lowest 8 % of a page unless they are
    numbered, page numbers, years, links, and lines that are too long or end like a sentence. The level is the depth of
    the number, else the place of the font among the three largest bands of candidates (0.75 wide), else by the ratio.
    """
    x = lines.withColumn("title", collapse(F.col("text"))).withColumn("key", F.lower("title"))
    of_doc, of_key = Window.partitionBy("doc"), Window.partitionBy("doc", "key")  # one shuffle by document serves all
    x = x.withColumn("_p", F.dense_rank().over(of_doc.orderBy("page"))).withColumn("pages", F.max("_p").over(of_doc))
    x = x.withColumn("body", F.percentile(F.when(F.col("font_size") > 0, F.col("font_size")), F.lit(0.5)).over(of_doc))
    x = x.withColumn("_k", F.dense_rank().over(of_key.orderBy("page"))).withColumn("on", F.max("_k").over(of_key))
    number, mark = F.regexp_extract("title", NUMBERED, 1), F.regexp_extract("title", NUMBERED, 2)
    depth = F.when((number != "") & (number.contains(".") | (mark != "")), F.size(F.split(number, r"\.")))
    x = x.withColumn("depth", depth).withColumn("ratio", F.col("font_size") / F.col("body")).withColumn("words", F.size(F.split("title", " ")))
    numbered, words, ratio = F.col("depth").isNotNull(), F.col("words"), F.col("ratio")
    sentence = (words > 10) & F.col("title").rlike(r"[.!?]$")
    barred = (F.col("on") >= 3) & (F.col("on") / F.col("pages") >= 0.25)
    for pattern in NO_HEADING:
        barred = barred | F.col("title").rlike(pattern)
    barred = barred | ((F.col("y") < 0.08 * page_height) & ~numbered) | (numbered & (ratio < 1.08) & ~F.col("bold"))
    stands_out = numbered | ((ratio >= 1.28) & (words <= 18)) | ((ratio >= 1.12) & (words <= 14) & ~sentence) | (F.col("bold") & (ratio >= 1.04) & (words <= 16) & ~sentence)
    x = x.where(F.length("title").between(3, 140) & (words <= 22) & ~barred & stands_out)
    font, b = F.col("font_size"), [F.col(f"_b{i}") for i in range(LEVELS)]
    for i in range(LEVELS):  # the largest size, then the largest below its band
        x = x.withColumn(f"_b{i}", F.max(F.when(b[i - 1] - font > BAND, font) if i else font).over(of_doc))
    band = F.coalesce(*[F.when(F.abs(o - font) <= BAND, i) for i, o in enumerate(b, 1)])
    level = F.when(numbered, F.least(F.lit(LEVELS), F.col("depth"))).when(band > 0, band).when(ratio >= 1.35, 1).when(ratio >= 1.18, 2).otherwise(3)
    x = x.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("page", "line"))).where(F.col("seq") <= most)
    return x.select("doc", "page", "seq", level.cast("int").alias("level"), "title")


def page_table(lines: list[list[tuple[str, float, float]]]) -> str | None:
    """Markdown of a page whose word boxes (text, x0, x1) line up in columns; None if they don't.

    A column is a place where words of three fifths of the lines start, after a gap of more than two spaces (the first
    column needs none). The width of a space is the lower quartile of the gaps inside lines.
    """
    able = [i for i, line in enumerate(lines) if len(line) >= 2]
    gaps = sorted(b[1] - a[2] for i in able for a, b in zip(lines[i], lines[i][1:], strict=False) if b[1] > a[2])
    if len(able) < 3 or not gaps or gaps[len(gaps) // 4] <= 0:
        return None
    space = gaps[len(gaps) // 4]
    starts = sorted(w[1] for i in able for w in lines[i])
    ends = [0, *[k for k, (a, b) in enumerate(itertools.pairwise(starts), 1) if b - a > space], len(starts)]
    columns = []
    for k, (first, last) in enumerate(itertools.pairwise(ends)):
        center, backed = (starts[(first + last - 1) // 2] + starts[(first + last) // 2]) / 2, 0
        for i in able:
            for j, w in enumerate(lines[i]):
                if abs(w[1] - center) <= space:
                    backed += k == 0 or j == 0 or w[1] - lines[i][j - 1][2] > 2 * space
                    break
        if backed / len(able) >= 0.6:
            columns.append(center)
    if len(columns) < 2:
        return None
    rows: dict[int, list[str]] = {}
    for i in able:
        cells, now = [[] for _ in columns], None
        for text, x0, _ in lines[i]:
            for c, center in enumerate(columns):
                if abs(x0 - center) <= space:
                    now = c
                    break
            if now is None:
                break
            cells[now].append(text)
        if now is not None and sum(map(bool, cells)) >= 2:
            rows[i] = [" ".join(c) for c in cells]
    if len(rows) < 3:
        return None
    show = lambda cells: "| " + " | ".join(cells) + " |"
    out = []
    for i, line in enumerate(lines):
        if i not in rows:
            out.append(" ".join(w[0] for w in line))
            continue
        out.append(show(rows[i]))
        if i - 1 not in rows:
            out.append(show(["---"] * len(columns)))
    return "\n".join(out)


def _table(words: list[tuple]) -> str | None:
    """`page_table` of a page's words (line, word_no, text, x0, x1), in order."""
    return page_table([[w[2:] for w in line] for _, line in itertools.groupby(words, key=lambda w: w[0])])


def tables_from_words(words: DataFrame) -> DataFrame:
    """doc, page, markdown of pages of recognised words (line, word_no, text, x0, x1) that make a table."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        md = _table([r[2:] for r in rows])
        return [(*key, md)] if md else []

    return fold_groups(words.select("doc", "page", "line", "word_no", "text", "x0", "x1"), ["doc", "page"], ["line", "word_no"], fold, "doc long, page int, markdown string")


def tables_from_pages(pages: DataFrame) -> DataFrame:
    """The same of pages whose words stand in one row: doc, page, words (array of line, word_no, text, x0, x1)."""

    def run(batches):
        for b in batches:
            md = [_table(sorted(words, key=lambda w: w[:2])) for words in _listed(b["words"])]
            keep = pa.array([m is not None for m in md])
            yield pa.RecordBatch.from_arrays([b["doc"].filter(keep), b["page"].filter(keep), pa.array([m for m in md if m is not None], pa.string())], ["doc", "page", "markdown"])

    return pages.where("words is not null").select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), "words").mapInArrow(run, "doc long, page int, markdown string")
