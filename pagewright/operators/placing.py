"""Places of texts in other texts: pages in a converted document, and quotes in the runs of a page.

Pages are found by windows of words, looked up by hash in their document; this and what follows for a document (which of the
places come in order, where a table must not be cut, putting the blocks in) is a fold over its text and its pages.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.functions.groups import fold_groups

# Window sizes in words, the share of distinct words, what is written for a page, what counts as written.
SIZES, DISTINCT = (14, 12, 10, 8, 6), 0.65
AT_ONCE = 64
UNMATCHED = "\n\n---\n\n## Unmatched Page Markers\n\n"
_MARKED = re.compile(r"""<a\s+id=["']page-(\d+)["']\s*></a>|^#{1,6}\s+Page\s+(\d+)\b""", re.I | re.M)
_WORD, _DIVIDER = regex.compile(r"[\p{L}\p{N}]+"), re.compile(r":?-{3,}:?")
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def match_words(text: str) -> list[tuple[str, int]]:
    """(word without accents and case, place) of all runs of letters and numbers."""
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if unicodedata.category(c)[0] != "M").lower()
    return [(m[0].lower() if m[0].isascii() else bare(m[0]), m.start()) for m in _WORD.finditer(text)]


def row_cells(line: str) -> list[str]:
    """Cells of a table row; a pipe after a backslash is text."""
    cells = [c.replace("\0", "|").strip() for c in line.strip(WHITE).replace("\\|", "\0").split("|")]
    bare = line.strip(WHITE)
    return cells[bare.startswith("|") : len(cells) - bare.endswith("|")]


def is_divider(line: str) -> bool:
    cells = row_cells(line) if "|" in line else []
    return bool(cells) and all(_DIVIDER.fullmatch(c) for c in cells)


def table_ranges(text: str) -> list[tuple[int, int]]:
    """(start, end) of each table: a line with a pipe, a divider, and the rows up to a blank line, a line without a pipe or
    another divider. They are in order and don't overlap."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((line, at, at + len(line)))
        at += len(line) + 1
    out, i = [], 0
    while i < len(lines) - 1:
        if "|" in lines[i][0] and is_divider(lines[i + 1][0]):
            end = i + 2
            while end < len(lines) and "|" in lines[end][0].strip(WHITE) and not is_divider(lines[end][0]):
                end += 1
            out.append((lines[i][1], lines[end - 1][2]))
            i = end - 1
        i += 1
    return out


def safe_place(text: str, tables: list[tuple[int, int]], starts: list[int], place: int) -> tuple[int, bool]:
    """(where a block may stand, whether it was moved): the start of the place's line, or the end of the table around it.
    The table is the last one that begins at or before the place."""
    line = text.rfind("\n", 0, place) + 1 if place else 0
    for at in (place, line):
        i = bisect.bisect_right(starts, at) - 1
        if i >= 0 and at < tables[i][1]:
            return tables[i][1], True
    return line, False


def put_in(text: str, blocks: list[tuple[int, str]]) -> str:
    """The text with blocks at their places, from the back, so that places stay right; blocks of one place keep their order."""
    for _, (place, block) in sorted(enumerate(blocks), key=lambda x: (-x[1][0], -x[0])):
        text = f"{text[:place].rstrip(WHITE)}\n\n{block.strip(WHITE)}\n\n{text[place:].lstrip(WHITE)}".strip(WHITE)
    return text


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n words."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)]
    return out


def _spread(ids: np.ndarray) -> np.ndarray:
    """Numbers of words as well-spread 64-bit numbers."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def page_places(pages: list[tuple[int, list[str]]], words: list[str]) -> dict[int, int | None]:
    """The number of the word where each page (page, its words; in order) begins, None if it isn't found.

    Windows of 14, 12, ... 6 words of each page (half overlapping, 65 % distinct at least) are looked up among the
    document's, whose hashes are sorted once for each size that is asked for. A page begins at the first place of the
    longest windows that have one behind the page before.
    """
    names: dict[str, int] = {}
    number = lambda ws: np.array([names.setdefault(w, len(names)) for w in ws], np.int64)
    whole = number(words)
    hashed, sizes = _spread(whole), {}
    cursor, out = 0, {}
    for page, group in itertools.groupby(pages, key=lambda x: x[0]):
        own = [number(ws) for _, ws in group]
        place = None
        for n in SIZES:
            if n not in sizes:
                h = _windows(hashed, n)
                order = np.argsort(h, kind="stable")
                sizes[n] = h[order], order
            h, order = sizes[n]
            for ids in own:
                at = np.arange(0, max(0, len(ids) - n + 1), n // 2)
                if not len(at) or not len(h):
                    continue
                asked = _windows(_spread(ids), n)[at]
                lo, hi = np.searchsorted(h, asked, "left"), np.searchsorted(h, asked, "right")
                for i in np.flatnonzero(hi > lo):
                    spots = order[lo[i] : hi[i]]  # in order, as the sort is stable
                    if place is not None and spots[0] >= place:
                        continue
                    k = int(np.searchsorted(spots, cursor)) if spots[0] < cursor else 0
                    if k == len(spots) or (place is not None and spots[k] >= place):
                        continue
                    window = ids[at[i] : at[i] + n]
                    if len(set(window.tolist())) >= DISTINCT * n and np.array_equal(whole[spots[k] : spots[k] + n], window):
                        place = int(spots[k])
            if place is not None:
                break
        cursor = cursor if place is None else place + 1
        out[page] = place
    return out


def with_page_markers(pages: DataFrame, converted: DataFrame, notes: DataFrame | None = None, headings: bool = True) -> DataFrame:
    """doc, markdown, places (page, position, moved_after_table) of converted documents with a marker where each page begins.

    A page that has its marker already gets none; `notes` (doc, page, block) follow the marker. Pages that have nothing to
    be put in aren't looked for. A place inside a table moves behind it; a page without a place (null) is appended under
    a heading of its own. Documents without pages come back with white space at their ends cut off. Places count in
    characters of the given text. The pages of a document stand beside its text in one row, so only texts are shuffled.
    """
    p = pages.select("doc", "page", "markdown").withColumn("block", F.lit(None).cast("string"))
    p = p if notes is None else p.drop("block").join(notes.select("doc", "page", "block"), ["doc", "page"], "left")
    p = p.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "block", "markdown"))).alias("pages"))  # a document's pages
    both = converted.select("doc", "markdown").join(p, "doc", "left")

    def put(text: str | None, own: list | None) -> tuple[str, list[dict]]:
        text = text or ""
        has = {a or b for a, b in _MARKED.findall(text)}
        given = []  # (page, block, text) of pages that have something to be put in
        for x in own if own is not None else []:
            n = str(x["page"])
            anchor = None if n in has else f'<a id="page-{n}"></a>' + (f"\n\n## Page {n}" if headings else "")
            note = x["block"] if (x["block"] or "").strip(" ") else None
            if block := "\n\n".join(b for b in (anchor, note) if b is not None):
                given.append((x["page"], block, x["markdown"]))
        found = match_words(text) if given else []
        at = page_places([(page, [w for w, _ in match_words(t or "")]) for page, _, t in given], [w for w, _ in found])
        tables = table_ranges(text) if given else []
        starts, blocks, lost, places = [s for s, _ in tables], [], [], []
        for page, block, _ in given:
            if at[page] is None:
                lost.append(block)
                places.append({"page": page, "position": None, "moved_after_table": False})
            else:
                position, moved = safe_place(text, tables, starts, found[at[page]][1])
                blocks.append((position, block))
                places.append({"page": page, "position": position, "moved_after_table": moved})
        done = put_in(text, blocks).strip(WHITE)
        if lost:
            done = (done + UNMATCHED + "\n\n".join(lost)).strip(WHITE)
        return f"{done}\n", places

    fields = both.select("doc").schema.fields + T.StructType.fromDDL("markdown string, places array<struct<page:int,position:int,moved_after_table:boolean>>").fields
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):  # texts of so many documents are held as Python's
                few = b.slice(i, AT_ONCE)
                made = [put(*x) for x in zip(few.column("markdown").to_pylist(), few.column("pages").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([few.column("doc"), *(pa.array(c, arrow.field(k + 1).type) for k, c in enumerate(zip(*made, strict=True)))], schema=arrow)

    return both.mapInArrow(run, schema)


def page_positions(pages: DataFrame, converted: DataFrame) -> DataFrame:
    """doc, page, position, moved_after_table, matched of every page that gets a marker."""
    x = with_page_markers(pages, converted).select("doc", F.explode("places").alias("p"))
    return x.select("doc", "p.page", "p.position", "p.moved_after_table", F.col("p.position").isNotNull().alias("matched"))


def same_form(character: str) -> str:
    """A character for tolerant comparison: compatibility form, lower case."""
    return unicodedata.normalize("NFKC", character).lower()


def flat_quote(quote: str) -> str:
    """White space is one blank, soft hyphens are nothing."""
    return " ".join("".join(" " if c in WHITE else same_form(c) for c in quote if c != "\xad").split())


def flat_runs(runs: list[tuple]) -> tuple[str, list[tuple[int, int] | None]]:
    """The text of runs (text, x, y, width, height) and the (run, character) that each place comes from, None for a blank.

    A blank stands between runs and for white space, never two. A hyphen goes if it ends a line and the next begins with a
    letter. What a character is written out as belongs to it.
    """
    text: list[str] = []
    owner: list[tuple[int, int] | None] = []

    def blank():
        if text and text[-1] != " ":
            text.append(" ")
            owner.append(None)

    for k, (own, _, y, _, height) in enumerate(runs):
        if k:
            new_line = abs(runs[k - 1][2] - y) > min(runs[k - 1][4], height) / 2
            if new_line and text and text[-1] == "-" and own.lstrip(WHITE)[:1].isalpha():
                text.pop()
                owner.pop()
            else:
                blank()
        for i, c in enumerate(own):
            if c in WHITE:
                blank()
            elif c != "\xad":
                for piece in same_form(c):
                    text.append(piece)
                    owner.append((k, i))
    return "".join(text), owner


def covered_lines(runs: list[tuple], owner: list[tuple[int, int] | None]) -> list[list[float]]:
    """[left, bottom, right, top] of each line that the characters cover, top to bottom. Pieces whose heights differ by at
    most half of the smaller height are on one line."""
    span: dict[int, tuple[int, int]] = {}
    for at in owner:
        if at:
            lo, hi = span.get(at[0], (at[1], at[1]))
            span[at[0]] = (min(lo, at[1]), max(hi, at[1]))
    lines: list[list[float]] = []
    for k, (lo, hi) in sorted(span.items()):
        text, x, y, width, height = runs[k]
        unit = width / len(text)
        piece = [x + lo * unit, y, x + (hi + 1) * unit, y + height]
        line = next((r for r in lines if abs(r[1] - y) <= min(r[3] - r[1], height) / 2), None)
        if line is None:
            lines.append(piece)
        else:
            line[:] = [min(line[0], piece[0]), min(line[1], piece[1]), max(line[2], piece[2]), max(line[3], piece[3])]
    return sorted(lines, key=lambda r: (-r[1], r[0]))


def anchor_quotes(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote_id, occurrences, rects: where a quote stands on its page (runs: doc, page, text, x, y, width, height; y grows
    upwards; in the order of `run_no` where there is one, else by height and from the left), forgiving case, amounts of white space, hyphenation, ligatures.

    Occurrences may overlap; the rectangles (left, bottom, right, top; one for each line) are those of the first. Pages are
    folded in Arrow batches, many to a batch.
    """
    columns = ["doc", "page", "kind", "down", "x", "text", "y", "width", "height", "quote_id"]
    down = F.col("run_no").cast("double") if "run_no" in runs.columns else -F.col("y")
    a = runs.select("doc", "page", F.lit(0).alias("kind"), down.alias("down"), "x", F.coalesce("text", F.lit("")).alias("text"), "y", "width", "height", F.lit("").alias("quote_id"))
    zero = F.lit(0.0)
    b = quotes.select("doc", "page", F.lit(1).alias("kind"), zero.alias("down"), zero.alias("x"), F.coalesce("quote", F.lit("")).alias("text"), zero.alias("y"), zero.alias("width"), zero.alias("height"), F.col("quote_id").cast("string"))

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        own = [(r[5], r[4], r[6], r[7], r[8]) for r in rows if r[2] == 0]
        text, owner = flat_runs(own)
        out = []
        for r in rows:
            if r[2]:
                wanted = flat_quote(r[5])
                at = [m.start() for m in re.finditer(f"(?={re.escape(wanted)})", text)] if wanted else []
                out.append((r[9], len(at), covered_lines(own, owner[at[0] : at[0] + len(wanted)]) if at else []))
        return out

    return fold_groups(a.unionByName(b).select(*columns), ["doc", "page"], ["kind", "down", "x"], fold, "quote_id string, occurrences int, rects array<array<double>>")
