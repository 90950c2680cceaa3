"""Substring dedup by sliding sentence spans: runs of consecutive sentences are hashed and joined over all documents;
sentences covered by any but the first occurrence of a repeated run are removed."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import fields, hold, join_hot, materialize, small_batches, text_key

#: A word ends a sentence if one of the first stands at its end, perhaps before some of the second.
ENDS, CLOSERS = ".!?…", "\"')]»”’"
_LAST = frozenset(ENDS + CLOSERS)
_WORD = re.compile(r"\S+")
#: Two odd multipliers, so that both have inverses modulo 2**64: together a hash has 128 bits.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = {b: np.ones(1, np.uint64) for base in _BASES for b in (base, pow(base, -1, 1 << 64))}
HASH = np.dtype([("h", np.int64), ("g", np.int64)])


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base."""
    if len(_powers[base]) < n:
        out = np.full(max(n, 2 * len(_powers[base])), np.uint64(base))
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def pieces(text: str, long: int = 0, one_in: int = 6) -> tuple[list[str], list[int], list[int]]:
    """(words, ends, whole): the words and the number of words up to the end of each piece and of each whole sentence.

    A sentence ends at its mark or at a line end, and is one piece, whatever its length. Only where `long` is given, one of
    more than `long` words is cut further after words whose hash says so (one in `one_in`; no piece under 4 words or, if
    no hash says so, over 24): where a passage has been put into the middle of other text, or has no marks, its pieces
    still come out alike.
    """
    words: list[str] = []
    ends: list[int] = []
    for line in text.split("\n"):
        own = line.split()
        if not own:
            continue
        at = len(words)
        ends.extend([i for i, w in enumerate(own, at + 1) if w[-1] in _LAST and w.rstrip(CLOSERS)[-1:] in ENDS and w.rstrip(CLOSERS)])
        words.extend(own)
        if not ends or ends[-1] != len(words):
            ends.append(len(words))
    fine, start = [], 0
    for end in ends:
        if long and end - start > long:
            n = 0
            for i in range(start, end - 1):
                n += 1
                if n >= 24 or n >= 4 and xxhash.xxh32_intdigest(words[i].strip(".,;:!?\"'()").encode("utf-8", "surrogatepass")) % one_in == 0:
                    fine.append(i + 1)
                    n = 0
        fine.append(end)
        start = end
    return words, fine, ends


def sentences(text: str, long: int = 0, one_in: int = 6) -> tuple[list[str], list[int]]:
    """The words and the ends of the pieces."""
    return pieces(text, long, one_in)[:2]


def spans(words: list[str], ends: list[int], whole: list[int] | None = None, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first piece, pieces, hash) of all runs of `least` pieces and of all runs of `least` whole sentences (which end at
    `whole`; none given: each piece is one). Longer runs are made up of these: one that is repeated has all of its parts
    repeated, so that it is covered to both ends. Runs are compared word by word, whatever the white space."""
    n = len(ends)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, HASH)
    first = np.arange(n - least + 1)
    last = first + least
    if whole is not None:
        edge = np.searchsorted([0, *ends], [0, *whole])
        more = np.flatnonzero(edge[least:] - edge[:-least] > least)
        first, last = np.append(first, edge[more]), np.append(last, edge[more + least])
    own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(words[a:b]).encode("utf-8", "surrogatepass")) for a, b in zip([0, *ends], ends, strict=False)), np.uint64).reshape(n, 2)
    out = np.zeros(len(first), HASH)
    for k, base in enumerate(_BASES):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own[:, k] * powers(base, n))))
        h = (total[last] - total[first]) * powers(pow(base, -1, 1 << 64), n)[first] + (last - first).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * _MIX
        out[HASH.names[k]] = (h ^ (h >> np.uint64(32))).view(np.int64)
    return first, last - first, out


def covered(hits: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n pieces some hit covers."""
    cover = np.zeros(n + 1, np.int64)
    for i, k in hits:
        cover[i] += 1
        cover[i + k] -= 1
    return np.cumsum(cover[:-1]) > 0


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def cut_out(text: str, ends: list[int], hits: list[tuple[int, int]], part_words: int, whole: list[int] | None = None, least: int = 2) -> tuple[str, int, int]:
    """The text without the pieces that the hits cover: all of those that are runs of at least `least` whole sentences,
    whatever their length, and parts of sentences where the pieces make up a stretch of at least `part_words` words."""
    upto = [0, *ends]
    number = {0: 0} | {end: k for k, end in enumerate(ends if whole is None else whole, 1)}
    full = [(i, n) for i, n in hits if number.get(upto[i + n], -1) - number.get(upto[i], len(upto)) >= least]
    gone_pieces = covered(full, len(ends))
    for i, j in stretches(covered(hits, len(ends))):
        if upto[j] - upto[i] >= part_words:
            gone_pieces[i:j] = True
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    keep, at, removed, gone = [], 0, 0, 0
    for i, j in stretches(gone_pieces):
        keep.append(text[at : starts[upto[i]]])
        at = starts[upto[j]]
        removed += j - i
        gone += upto[j] - upto[i]
    keep.append(text[at:])
    return "".join(keep), removed, gone


def dedup_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 2, long: int = 0, part_words: int = 13) -> DataFrame:
    """`docs` with repeated runs of sentences removed from `text`, and n_removed (pieces) and words_removed added.

    Every repeated run of at least `least` whole sentences goes, however short, and nothing else. With the option `long`
    sentences of over `long` words are looked at in pieces, and stretches of at least `part_words` words of such pieces,
    each repeated together with a neighbour, go as well: passages put into the middle of other sentences are found then.

    The first occurrence is that with the least doc_id (null last; equal ids: by hash of the text), then the first in
    the text; it stays, all others go, in the same document too. Rows with equal doc_id and text are one document. Ids
    may be of any type that can be ordered. Null and empty texts stay as they are, texts are taken whole. Columns of the
    added names, in any case, are replaced; all others stay, whatever their names. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    new = ("n_removed", "words_removed")
    kept = fields(docs, *new)
    others = [c for c in kept if c.lower() != text.lower()]
    keyed = hold(docs, others, F.col(text).alias("text"), F.col(doc_id).alias("doc"), F.substring(text_key(F.col(text)), 1, 8).alias("key"))

    def find(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                got = [spans(*pieces(t, long), least) for t in b.column("text").to_pylist()]
                at, size, h = (np.concatenate([np.zeros(0, HASH if k == 2 else np.int64), *[g[k] for g in got]]) for k in range(3))
                of = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(of), b.column("key").take(of), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h["h"]), pa.array(h["g"])],
                    ["doc", "key", "at", "n", "h", "g"],
                )

    plain = keyed.select("doc", "key", F.coalesce("text", F.lit("")).alias("text"))
    runs = plain.mapInArrow(find, T.StructType([*plain.select("doc", "key").schema.fields, *T.StructType.fromDDL("at int, n int, h long, g long").fields]))
    runs = materialize(runs, "runs")  # hashed once, read twice
    # Of each hash: how many places there are and which is the first.
    place = F.struct(F.col("doc").isNull().alias("z"), "doc", "key", "at")
    repeated = materialize(runs.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).where("c > 1"), "repeated-runs")
    later = join_hot(runs, repeated, ["h", "g"], counted="c").where(place != F.col("first"))
    hits = later.groupBy(F.col("doc").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    hits = materialize(hits, "span-hits")

    @F.pandas_udf("text string, n_removed int, words_removed int")
    def remove(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, f in zip(texts, found, strict=True):
            if t is None or f is None or not len(f):
                out.append((t, 0, 0))
            else:
                _, ends, whole = pieces(t, long)
                out.append(cut_out(t, ends, [(x["at"], x["n"]) for x in f], part_words, whole, least))
        return pd.DataFrame(out, columns=["text", *new])

    remove = remove.asNondeterministic()  # so that a filter on what it returns doesn't run it a second time
    rows = keyed.join(hits, F.col("doc").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    rows = rows.select("row", remove("text", "hits").alias("out"))
    return rows.select(*[F.col("out.text").alias(c) if c.lower() == text.lower() else F.col("row").getField(c).alias(c) for c in kept], *[f"out.{c}" for c in new])
