"""What a Markdown document shows when it is rendered: its text in segments, and the names of its headings."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.groups import fold_groups
from pagewright.operators.annotations import ROUND, _automaton, shared_terms
from pagewright.operators.placing import WHITE, is_divider, row_cells

# What is markup within a line, and what lines are.
INLINE = re.compile(r"(`[^`]+`|\*\*[^*]+\*\*|\*[^*]+\*|!\[[^\]]*]\([^)]+\)|\[[^\]]+]\([^)]+\))")
FENCE, HEADING = re.compile(r"```([\w-]*)\s*", re.A), re.compile(r"#{1,6}\s+(.+)")
BULLET, NUMBER, QUOTE = re.compile(r"[-*+]\s+(.+)"), re.compile(r"\d+[.)]\s+(.+)", re.A), re.compile(r">\s?(.*)")
RULE, ANCHOR = re.compile(r"[-*_]\s*[-*_]\s*[-*_][-*_\s]*"), re.compile(r"""<a\s+id=["'][-\w]+["']\s*></a>""", re.A)
UNNAMED = "section"
AT_ONCE = 10_000  # matches that are handed on together


def shown(text: str) -> list[str]:
    """The parts of a line that are seen: plain text, and what stands in marks of code, weight or a link; no images."""
    out = []
    for i, part in enumerate(INLINE.split(text)):
        if i % 2 == 0:
            out.append(part)
        elif part[0] == "`":
            out.append(part[1:-1])
        elif part[0] == "*":
            out.append(part.strip("*"))
        elif part[0] == "[":
            out.append(part[1 : part.index("](")])
    return [p for p in out if p]


def _runs(lines: list[str], start: int, kind: re.Pattern) -> tuple[list[str], int]:
    """What consecutive lines of a kind say, and where they end."""
    said, at = [], start
    while at < len(lines) and (m := kind.fullmatch(lines[at].strip(WHITE))):
        said.append(m[1])
        at += 1
    return said, at


def rendered(markdown: str | None) -> list[tuple[str, str]]:
    """(kind, text) of all segments, in the order in which they are shown. Code of diagrams isn't shown as text."""
    lines = re.sub("\r\n?", "\n", markdown or "").split("\n")
    out: list[tuple[str, str]] = []
    open_: list[str] = []

    def say(kind: str, text: str) -> None:
        out.extend((kind, part) for part in shown(text))

    def close() -> None:
        say("paragraph", " ".join(open_).strip(WHITE))
        open_.clear()

    at = 0
    while at < len(lines):
        line, here = lines[at].strip(WHITE), at
        at += 1
        if not line or ANCHOR.fullmatch(line):
            close()
        elif m := FENCE.fullmatch(line):
            close()
            while at < len(lines) and not lines[at].strip(WHITE).startswith("```"):
                at += 1
            if m[1].lower() != "mermaid" and at > here + 1:
                out.append(("code", "\n".join(lines[here + 1 : at])))
            at += 1
        elif m := HEADING.fullmatch(line):
            close()
            say("heading", m[1])
        elif RULE.fullmatch(line):
            close()
        elif "|" in line and at < len(lines) and is_divider(lines[at]):
            close()
            rows, at = [line], at + 1
            while at < len(lines) and "|" in lines[at].strip(WHITE) and not is_divider(lines[at]):
                rows.append(lines[at])
                at += 1
            for row in rows:
                for cell in row_cells(row):
                    say("table", cell)
        elif kind := next((k for k in (BULLET, NUMBER) if k.fullmatch(line)), None):
            close()
            items, at = _runs(lines, here, kind)
            for item in items:
                say("list", item)
        elif line.startswith(">"):
            close()
            said, at = _runs(lines, here, QUOTE)
            say("quote", " ".join(said))
        else:
            open_.append(line)
    close()
    return out


def rendered_segments(documents: DataFrame) -> DataFrame:
    """doc, segment (from 0), kind, text of (doc, markdown)."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in rendered(text)] for text in texts], dtype=object)

    return documents.select("doc", F.posexplode(cut("markdown")).alias("segment", "s")).select("doc", "segment", "s.kind", "s.text")


def markdown_scan(documents: DataFrame, terms: DataFrame, around: int = ROUND) -> DataFrame:
    """doc, term, ordinal, segment, start, snippet: every literal match in what a document shows, ignoring case.

    A match lies within one segment, so never in a link's target or an image's text; ordinals count a term's matches over
    the document, in the order of what is shown. Terms are trimmed, blank ones find nothing; one automaton has them all.
    A document (one row) is rendered and read in one pass, and matches are handed on by the thousands: neither its segments
    nor those of a batch are held, and nothing is shuffled.
    """
    schema = T.StructType([*documents.select("doc").schema.fields, *T.StructType.fromDDL("term string, ordinal int, segment int, start int, snippet string").fields])
    out = None
    for shared in shared_terms(terms):

        def scan(batches, shared=shared):
            find = _automaton(*shared.value) if shared.value[1] else None
            for b in batches:
                rows = []
                for doc, markdown in zip(b["doc"], b["markdown"], strict=True):
                    count: dict[str, int] = {}
                    for segment, (_, whole) in enumerate(rendered(markdown) if find else ()):
                        ends: dict[str, int] = {}  # of each term's last match here
                        for end, (n, names) in find.iter(whole.lower()):
                            start = end - n + 1
                            if start >= ends.get(names[0], 0):
                                ends[names[0]] = end + 1
                                lo, hi = max(0, start - around), min(len(whole), start + n + around)
                                said = f"{'...' if lo else ''}{whole[lo:hi]}{'...' if hi < len(whole) else ''}"
                                for name in names:
                                    rows.append((doc, name, count.get(name, 0), segment, start, said))
                                    count[name] = count.get(name, 0) + 1
                    if len(rows) >= AT_ONCE:
                        yield pd.DataFrame(rows, columns=schema.names)
                        rows = []
                yield pd.DataFrame(rows, columns=schema.names)

        part = documents.select("doc", "markdown").mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def slug(title: str) -> str:
    """A heading's name: its shown words in lower case, letters, numbers and hyphens only, blanks as hyphens."""
    text = regex.sub(r"[^\p{L}\p{N}\s-]", "", "".join(shown(title)).lower()).strip(WHITE)
    return re.sub(r"\s+", "-", text)


def anchor_ids(headings: DataFrame) -> DataFrame:
    """doc, pos, anchor: names of headings; a name that has been given out is numbered. A fold over each document's headings."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        used, last, out = set(), {}, []  # last: the greatest number given out after a name
        for doc, pos, title in rows:
            base = name = slug(title or "") or UNNAMED
            n = last.get(base, 0)
            while name in used:
                n += 1
                name = f"{base}-{n}"
            used.add(name)
            last[base] = n
            out.append((doc, pos, name))
        return out

    return fold_groups(headings.select("doc", "pos", "title"), ["doc"], ["pos"], fold, "doc long, pos int, anchor string")


def clean_target(url: str) -> str:
    """A link's target without the angle brackets around it."""
    bare = url.strip(WHITE)
    return bare[1:-1].strip(WHITE) if bare.startswith("<") and bare.endswith(">") and len(bare) > 1 else bare


def fragment_name(url: str | None) -> str | None:
    """The heading name that a target within the document asks for; null if it leads elsewhere or to no name."""
    target = clean_target(url or "")
    if not target.startswith("#"):
        return None
    said = target[1:]
    if not re.search(r"%(?![0-9A-Fa-f]{2})", said):
        try:
            said = unquote_to_bytes(said).decode("utf-8")
        except UnicodeDecodeError:
            pass  # not an address but a name: taken as it is written
    return slug(said) or None
