"""Packing: optimal length buckets by dynamic programming over the global histogram, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import column, fields, give, hold, materialize, prefix_sums, word_count


def padded(length: Column, align: int = 8, fine: int = 7) -> Column:
    """Length rounded up: to `align` while short, later to a 2**fine-th of its power of two.

    So the histogram has at most 2**fine bins for each doubling, however long texts get.
    """
    bits = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("long")
    step = F.greatest(F.lit(align).cast("long"), F.pow(F.lit(2.0), (bits - fine).cast("double")).cast("long"))
    return (F.ceil(length / step) * step).cast("long")


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` length ranges that minimise the sum of (end - length) over all items.

    Dynamic programming over the sorted distinct lengths: best[j] with one more bucket is the least of best[i] plus
    lengths[j] times the items after i up to j.
    """
    order = np.argsort(lengths)
    ends, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    m = len(ends)
    if not m:
        return []
    upto = np.concatenate(([0.0], np.cumsum(c)))
    best, cut = np.full(m + 1, np.inf), []
    best[0] = 0.0
    below = np.tri(m, m + 1, dtype=bool)  # row j (0-based): i <= j
    for _ in range(min(buckets, m)):
        cost = np.where(below, best[None, :] + ends[:, None] * (upto[1:, None] - upto[None, :]), np.inf)
        at = np.argmin(cost, axis=1)
        new = np.concatenate(([0.0], cost[np.arange(m), at]))
        cut.append(at)
        if np.array_equal(new, best):
            break
        best = new
    out, j = [], m
    for at in reversed(cut):
        if j == 0:
            break
        out.append(int(ends[j - 1]))
        j = int(at[j - 1])
    return sorted(out)


def pack(docs: DataFrame, text: str = "text", length: Column | None = None, buckets: int = 16, batch_tokens: int = 1 << 16, align: int = 8, seed: int = 29) -> DataFrame:
    """Adds n_tokens, bucket, bucket_length, batch, slot and padding to `docs` without its text.

    `length` defaults to the number of words, however long the text. All items of a batch are padded to their bucket's
    length; a batch holds as many as fit into `batch_tokens` (one, if the length is above it). Which items meet in a
    batch is a fixed random choice within the bucket, repeated rows are items of their own; the last batch of a bucket
    may be short. Rows without tokens (null or empty text) are not packed: their bucket, batch and slot are null,
    padding 0. An empty table gives an empty table. Columns of the added names, in any case, are replaced; all others
    stay, whatever their names.

    The buckets are optimal for lengths rounded up by `padded`. Padding is thus at most that of the best buckets for
    the lengths themselves plus a 128th of all tokens (below 1,024 words: plus `align` - 1 for each text).
    """
    new = ("n_tokens", "bucket", "bucket_length", "batch", "slot", "padding")
    kept = fields(docs, *new, text)
    count = word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    rows = hold(docs, kept, count.alias("n_tokens"), F.xxhash64(F.lit(seed), *[column(c) for c in fields(docs, *new)]).alias("h"))
    rows = materialize(rows.withColumn("end", padded(F.col("n_tokens"), align)), "pack-lengths")
    histogram = rows.where("n_tokens > 0").groupBy("end").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by padded()
    ends = optimal_buckets(np.array([r["end"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    limits = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.when(F.col("n_tokens") > 0, F.size(F.filter(limits, lambda e: e < F.col("end")))))
    rows = rows.withColumn("bucket_length", F.try_element_at(limits, F.col("bucket") + 1)).withColumn("one", F.lit(1).cast("long"))
    packed = prefix_sums(rows.where("bucket is not null"), ["bucket"], F.col("h"), {"rank": "one"})
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("bucket_length")).cast("long"))
    packed = packed.withColumn("batch", F.floor(F.col("rank") / fit).cast("long")).withColumn("slot", (F.col("rank") % fit).cast("long"))
    packed = packed.withColumn("padding", F.col("bucket_length") - F.col("n_tokens"))
    rest = rows.where("bucket is null").withColumn("batch", F.lit(None).cast("long")).withColumn("slot", F.lit(None).cast("long")).withColumn("padding", F.lit(0).cast("long"))
    return packed.select(*give(kept), *new).unionByName(rest.select(*give(kept), *new))
