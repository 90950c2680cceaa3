"""Counting tokens by word pieces: the longest piece of a vocabulary that fits, again and again, word by word."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Piece within a word; what a broadcast vocabulary may hold; words longer than this are one unknown token.
INSIDE, MOST_PIECES, MOST_BYTES, LONGEST_WORD = "##", 1_000_000, 64 << 20, 100
MOST_LINES, LONG_LINE = 20_000, 400  # lines whose sizes are remembered, and the characters that such a line may have
END = ""  # marks a node of the trie where a piece ends


_ASCII = re.compile(r"[a-z0-9]+|[^\sa-z0-9\x00-\x1f\x7f]", re.A)
_ANY = regex.compile(r"\p{Han}|[[\p{L}\p{N}]--[\p{Han}]]+|[^\s\p{L}\p{N}\p{C}]", regex.V1)


def words(text: str) -> list[str]:
    """Words as the pieces are made of them: lower case without accents, split at white space, signs and ideographs alone."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _ANY.findall("".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn"))


class _Sizes(dict):
    """Sizes of words that have been met, as many as fit."""

    def __init__(self, size, most: int = 200_000):
        super().__init__()
        self._size, self._most = size, most

    def __missing__(self, word: str) -> int:
        if len(self) > self._most:
            self.clear()
        n = self[word] = self._size(word)
        return n


class WordPieces:
    """A vocabulary as two tries, of pieces that begin a word and of those within one."""

    adds_up = True  # no word goes on behind white space

    def __init__(self, pieces: list[str]):
        self.first: dict = {}
        self.inside: dict = {}
        for piece in pieces:
            node, text = (self.inside, piece[len(INSIDE) :]) if piece.startswith(INSIDE) and piece != INSIDE else (self.first, piece)
            for c in text:
                node = node.setdefault(c, {})
            if text:
                node[END] = True
        self._sizes = _Sizes(self.word)
        self._lines = _Sizes(self.line, MOST_LINES)

    def pieces(self, word: str) -> list[str] | None:
        """The pieces of a word, longest first at each place; null if some place has none."""
        out, at = [], 0
        while at < len(word):
            node, end = (self.inside if at else self.first), None
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if END in node:
                    end = i + 1
            if end is None:
                return None
            out.append(word[at:end])
            at = end
        return out

    def word(self, word: str) -> int:
        found = self.pieces(word) if len(word) <= LONGEST_WORD else None
        return 1 if found is None else len(found)

    def line(self, text: str) -> int:
        return sum(map(self._sizes.__getitem__, words(text)))

    def __call__(self, text: str) -> int:
        """No word goes on behind the end of a line, so a text is its lines; those that come again, as the rows and headers of
        a table that is being cut, are sized once."""
        if "\n" not in text:
            return self._lines[text] if len(text) <= LONG_LINE else self.line(text)
        return sum([self._lines[x] if len(x) <= LONG_LINE else self.line(x) for x in text.split("\n")])

    def __getstate__(self) -> dict:
        return {"first": self.first, "inside": self.inside}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._sizes = _Sizes(self.word)
        self._lines = _Sizes(self.line, MOST_LINES)


class Shared:
    """A counter that lies in a broadcast variable: functions that use it carry only its handle."""

    adds_up = True

    def __init__(self, broadcast):
        self._broadcast = broadcast

    def __call__(self, text: str) -> int:
        return self._broadcast.value(text)


def counter(vocabulary: DataFrame, piece: str = "piece") -> Callable[[str], int]:
    """A token counter from a table of pieces, which is measured before it is broadcast. Null and repeated pieces don't
    matter; a piece that starts with `##` stands within a word."""
    v = vocabulary.select(F.col(piece).alias("p")).where("p is not null").distinct()
    size = v.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("p")), F.lit(0)).alias("bytes")).first()
    if size["n"] > MOST_PIECES or size["bytes"] > MOST_BYTES:
        raise ValueError(f"a vocabulary of {size['n']} pieces and {size['bytes']} bytes is too large to be broadcast")
    return Shared(vocabulary.sparkSession.sparkContext.broadcast(WordPieces([r["p"] for r in v.collect()])))


def worst_case(*counters: Callable[[str], int]) -> Callable[[str], int]:
    """The largest of several counts: what fits by it fits every encoder."""
    return lambda text: max(c(text) for c in counters)
