"""N-gram Jaccard self-join by chosen paths.

Every distinct text is a set of hashed word shingles, embedded as `HASHES` min-wise hashes. A run splits the sets
recursively: at each node a few coordinates are sampled, and sets that agree on one go to its child. Buckets that are
small enough are compared by brute force on the embedding; larger ones are split again. Several runs reach the target
recall. What the runs connect are candidate groups; inside each, all pairs are checked with their exact shingle sets,
block by block. Copies of one text are one set all along.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fields, give, hold, materialize, slices, small_batches, text_key
from pagewright.llm.graph import components

HASHES = 64
_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hash of a word, kept while the dictionary is of moderate size."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


_words = Words()


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of n lower-cased words; a shorter text is one run, also an empty one."""
    words = (text or "").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = max(1, len(h) - n + 1)
    out = np.full(k, np.uint64(len(h) if len(h) < n else n))
    with np.errstate(over="ignore"):
        for i in range(min(n, len(h))):
            out = (out + h[i : i + k]) * _M
            out ^= out >> np.uint64(32)
    return np.unique(mixed(out))


_seeds = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * _M) | np.uint64(1)


def embedding(s: np.ndarray) -> np.ndarray:
    """Min-wise hashes (32 bits each) of a shingle set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            part = (s[i : i + 2048, None] + _seeds) * _seeds
            part ^= part >> np.uint64(29)
            out = np.minimum(out, (part * _M).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def children(path: int, sig: np.ndarray, chance: float) -> list[int]:
    """The nodes below `path` that a set with embedding `sig` goes to: one for each sampled coordinate, one at least."""
    coordinate = np.arange(HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        at = mixed(np.uint64(path % (1 << 64)) + (coordinate + np.uint64(1)) * _M)
    chosen = np.flatnonzero(at < np.uint64(int(chance * 2**64)))
    if not len(chosen):
        chosen = np.array([np.argmin(at)])
    return mixed(at[chosen] ^ mixed(sig[chosen].astype(np.uint64) + np.uint64(1))).view(np.int64).tolist()


def grouped(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of rows with equal keys in a sorted stream of batches."""
    open_: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        same = (b[keys] == b[keys].shift()).all(axis=1).to_numpy()
        starts = np.flatnonzero(~same)
        if open_ and tuple(open_[-1][keys].iloc[-1]) != tuple(b[keys].iloc[0]):
            yield pd.concat(open_) if len(open_) > 1 else open_[0]
            open_ = []
        ends = [*starts[1:], len(b)]
        for s, e in zip(starts, ends, strict=True):
            open_.append(b.iloc[s:e])
            if e < len(b):
                yield pd.concat(open_) if len(open_) > 1 else open_[0]
                open_ = []
    if open_:
        yield pd.concat(open_) if len(open_) > 1 else open_[0]


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n items the least item of its component."""
    root = np.arange(n)
    if len(pairs):
        a, b = pairs[:, 0], pairs[:, 1]
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
    return root


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i, j), i in left and j in right, whose exact Jaccard similarity reaches the threshold."""
    n = np.array([len(s) for s in sets], np.float64)
    if len(sets) <= 3:
        found = []
        for i in left:
            for j in right:
                if i != j and min(n[i], n[j]) >= threshold * max(n[i], n[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= threshold * (n[i] + n[j] - both) - 1e-9:
                        found.append((i, j))
        return np.array(found, np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    codes, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    rank = np.cumsum(times > 1) - 1
    owner, col = owner[shared], rank[col[shared]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for start in range(0, int((times > 1).sum()), width):
        lo, hi = np.searchsorted(col, [start, start + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], col[lo:hi] - start] = 1
        both += m @ m.T
    ok = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
    np.fill_diagonal(ok, False)
    return np.argwhere(ok[np.ix_(left, right)]) if len(left) == len(sets) == len(right) else np.array([(i, j) for i in left for j in right[ok[i, right]]], np.int64).reshape(-1, 2)


def ngram_join(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, words: int = 5,
    target_recall: float = 0.99, bucket: int = 96, depth: int = 4, slack: float = 0.15, block: int = 1024, block_chars: int = 8 << 20,
) -> DataFrame:
    """One row for each row of `docs`: _doc, _key (identity of the text), _root (identity of its group), _links.

    `_links` counts the other rows whose text is a copy or has Jaccard similarity of at least `threshold`; `_root` is
    the same for rows that links connect. Null texts count as empty; texts of fewer than `words` words are one shingle.
    A run is repeated until a pair at the threshold meets in a bucket of the second level with `target_recall`. Ids may
    be of any type that can be ordered. Groups are checked in blocks of about `block` texts and `block_chars` characters.
    """
    small_batches(docs.sparkSession)
    chance = 1 / (threshold * HASHES)
    # A pair agrees on each of about Poisson(1/threshold) (at least one) coordinates with probability `threshold`.
    p0 = math.exp(-1 / threshold)
    meet = 1.0
    for _ in range(2):
        meet = 1 - (math.exp(-meet) - p0) - p0 * (1 - threshold * meet)
    runs = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - min(meet, 0.999))))
    roots = [int(x) for x in mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(7919))]

    rows = docs.select(F.col(doc_id).alias("_doc"), text_key(F.col(text)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    @F.pandas_udf("binary")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([embedding(shingles(t, words)).tobytes() for t in texts], dtype=object)

    embedded = materialize(rows.select("_doc", "_key", embed("_text").alias("sig"), F.length("_text").cast("long").alias("chars")), "embedded")
    sets = materialize(embedded.groupBy(F.col("_key").alias("key")).agg(F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars")), "sets")

    def first_level(batches):
        for b in slices(batches):
            keys, paths = [], []
            for k, s in zip(b["key"], b["sig"], strict=True):
                sig = np.frombuffer(s, np.uint32)
                p = [c for r in roots for c in children(r, sig, chance)]
                paths.extend(p)
                keys.extend([k] * len(p))
            yield pd.DataFrame({"path": np.array(paths, np.int64), "key": keys})

    def next_level(batches):
        for b in slices(batches):
            keys, paths = [], []
            for v, k, s in zip(b["path"], b["key"], b["sig"], strict=True):
                p = children(int(v), np.frombuffer(s, np.uint32), chance)
                paths.extend(p)
                keys.extend([k] * len(p))
            yield pd.DataFrame({"path": np.array(paths, np.int64), "key": keys})

    def brute_force(batches):
        for g in grouped(batches, ["path"]):
            sig = np.stack([np.frombuffer(s, np.uint32) for s in g["sig"]])
            same = (sig[:, None, :] == sig[None, :, :]).mean(axis=2) if len(sig) <= 32 else np.stack([(sig == s).mean(axis=1) for s in sig])
            root = forest(len(sig), np.argwhere(np.triu(same >= threshold - slack, 1)))
            keys = g["key"].to_numpy()
            far = np.flatnonzero(root != np.arange(len(sig)))
            if len(far):
                yield pd.DataFrame({"a": keys[far], "b": keys[root[far]]})

    level = materialize(sets.select("key", "sig").mapInPandas(first_level, "path long, key binary"), "paths")
    edges = None
    for d in range(1, depth + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("least")).where("c > 1")
        sized = materialize(level.join(sizes, "path"), "sized")
        small = sized.where(F.col("c") <= bucket).select("path", "key").join(sets.select("key", "sig"), "key")
        small = small.repartition("path").sortWithinPartitions("path").mapInPandas(brute_force, "a binary, b binary")
        edges = small if edges is None else edges.unionByName(small)
        large = sized.where(F.col("c") > bucket)
        if d == depth:  # sets that agree on so many coordinates: one group, checked exactly below
            edges = edges.unionByName(large.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")))
        elif large.limit(1).count():
            level = materialize(large.select("path", "key").join(sets.select("key", "sig"), "key").select("path", "key", "sig").mapInPandas(next_level, "path long, key binary"), "paths")
        else:
            break
    groups = materialize(components(edges), "groups")

    # All pairs inside a group, block by block, with exact sets.
    sized = groups.join(sets.select(F.col("key").alias("node"), "n", "chars"), "node")
    sizes = sized.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("chars") / block_chars)).cast("int").alias("blocks"))
    placed = sized.drop("chars").join(sizes, "root")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = rows.select(F.col("_key").alias("node"), "_text").join(placed, "node").dropDuplicates(["node"])
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = texts.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "_text")

    def verify(batches):
        for g in grouped(batches, ["root", "i", "j"]):
            s = [shingles(t, words) for t in g["_text"]]
            own, i, j = g["own"].to_numpy(), int(g["i"].iloc[0]), int(g["j"].iloc[0])
            pairs = links(s, np.flatnonzero(own == i), np.flatnonzero(own == j), threshold)
            if not len(pairs):
                continue
            n, keys = g["n"].to_numpy(), g["node"].to_numpy()
            count = np.bincount(pairs[:, 0], n[pairs[:, 1]], len(keys))
            if i != j:
                count = count + np.bincount(pairs[:, 1], n[pairs[:, 0]], len(keys))
            root = forest(len(keys), pairs)
            yield pd.DataFrame({"a": keys, "b": keys[root], "links": count.astype(np.int64)})[count > 0]

    found = tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(verify, "a binary, b binary, links long")
    found = materialize(found, "links")
    final = components(found.select("a", "b"))
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = sets.select("key", "n").join(final.withColumnRenamed("node", "key"), "key", "left").join(counted.withColumnRenamed("node", "key"), "key", "left")
    known = known.select(F.col("key").alias("_key"), F.coalesce("root", "key").alias("_root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"))
    return embedded.select("_doc", "_key").join(known, "_key")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """doc_id, class_id (least doc_id of the group; null ids only if there is no other) and n_links for each row.

    Null texts count as empty, all empty ones are copies of one another; texts are taken whole; repeated rows are rows of
    their own. Other columns don't matter. An empty table gives an empty table.
    """
    joined = materialize(ngram_join(docs, text, doc_id, **how), "joined")
    least = joined.groupBy("_root").agg(F.min("_doc").alias("class_id"))
    return joined.join(least, "_root").select(F.col("_doc").alias(doc_id), "class_id", F.col("_links").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of each group: that with the least doc_id (null last), of equal ids that with the least text hash, of rows
    with equal id and text any one. All columns stay as they are, whatever their names."""
    kept = fields(docs)
    joined = ngram_join(docs, text, doc_id, **how)
    best = joined.groupBy("_root").agg(F.min(F.struct(F.col("_doc").isNull().alias("z"), "_doc", "_key")).alias("x")).select(F.col("x._doc").alias("best"), F.col("x._key").alias("best_key"))
    best = materialize(best, "kept")
    rows = hold(docs, kept, text_key(F.col(text)).alias("key"), F.col(doc_id).alias("doc"))
    rows = rows.join(best, (F.col("key") == F.col("best_key")) & F.col("doc").eqNullSafe(F.col("best")))
    return rows.dropDuplicates(["key", "doc"]).select(*give(kept))
