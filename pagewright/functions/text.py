"""Column expressions on Markdown and plain text: visible words, snippets, fingerprints, tokens, hashes.

Lengths are code points. White space is the Unicode set, not only ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"
SNIPPET = 260


def _plain_letters() -> tuple[str, str]:
    """Accented lower-case letters that decompose to one letter and marks, and that letter."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x386, 0x460), *range(0x1E00, 0x2000)]):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and c == c.lower() and all(unicodedata.combining(x) for x in d[1:]):
            pairs.append((c, d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return collapse(F.coalesce(text, F.lit(""))) == ""


def plain(markdown: Column) -> Column:
    """The visible words of Markdown: no divider rows, heading or bullet marks, pipes, emphasis."""
    lines = F.filter(F.split(markdown, "\n", -1), lambda x: ~x.rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*#{1,6}\s+", ""), r"^\s*([-*+]|\d+\.)\s+", ""))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.replace(x, F.lit("|"), F.lit(" ")), r"\*\*|__|\*|_|`", ""))
    return collapse(F.array_join(lines, " "))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def fingerprint(text: Column) -> Column:
    """16 hexadecimal digits that stay the same when only white space changes."""
    return F.substring(F.sha2(collapse(text), 256), 1, 16)


def chunk_id(doc: Column, profile: str, version: int, page: Column, idx: Column, part: Column, text: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), F.lit(profile), F.lit(str(version)), page.cast("string"), idx.cast("string"), part.cast("string"), fingerprint(text))


def fold(text: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded runs of letters, numbers and private-use characters, in order."""
    return F.array_remove(F.split(fold(text), NOT_TOKEN, -1), "")


def fnv1a(word: str) -> int:
    """FNV-1a over ASCII characters, as a signed 32-bit number."""
    h = 2166136261
    for c in word.encode("ascii"):
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


MOST_SLOTS = 1 << 20  # words whose slots a task remembers
_BOW_WORD = re.compile("[a-z0-9]+")


class _Slots(dict):
    """Slot of a word, reckoned when it is first met."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        slot = self[word] = abs(fnv1a(word)) % self.dims
        return slot


def bow_vector(text: Column, dims: int = 64) -> Column:
    """Word counts by hash slot, of unit length (no word: zeros; no text: null). The slot is |signed hash| modulo `dims`.
    Texts go through Arrow batches, as each distinct word is hashed once in a task."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = _Slots(dims)
        for texts in batches:
            if len(slots) > MOST_SLOTS:
                slots.clear()
            counts = np.zeros((len(texts), dims))
            for row, t in zip(counts, texts, strict=True):
                if t and (words := _BOW_WORD.findall(t)):
                    row[:] = np.bincount([slots[w] for w in words], minlength=dims)
            size = np.sqrt((counts * counts).sum(axis=1))
            counts /= np.where(size > 0, size, 1.0)[:, None]
            yield pd.Series([None if t is None else v for v, t in zip(counts, texts, strict=True)], dtype=object)

    return vectors(F.lower(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
