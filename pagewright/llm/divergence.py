"""Source divergence audit: every two sources of a language compared by their smoothed term shares, exactly.

Terms are counted inside tasks and summed by (language, source, term); a language keeps the terms of enough documents
and numbers them in byte order. A source's counts become arrays sorted by term number, cut at blocks of numbers. A pair
task gets the arrays of two sources for one block: a galloping intersection finds the shared terms, and shared, one-sided
and absent terms are priced apart. Pair tasks of a tile of sources share their arrays, so an array is sent once for each
tile and not once for each partner. Sums over blocks give the pair's value, which reads the same both ways.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import join_small, materialize, small_batches
from pagewright.llm.ngram_join import grouped

#: ASCII letters in lower case, all else below 128 a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SCALE = 1_000_000_000
BLOCK = 1 << 16


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def count_terms(docs: DataFrame, text: str, lang: str, source: str, most: int = 200_000) -> DataFrame:
    """lang, source, term (binary), count, docs: summed over all documents. Each group that occurs has a row of the empty
    term. Tasks count up to `most` entries before they hand them on, so memory doesn't grow with the table."""
    small_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches):
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush():
            rows = [(g[0], g[1], t, c, within[t]) for g, (total, within) in seen.items() for t, c in total.items()]
            rows += [(*g, b"", 0, 0) for g in seen]
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "source", "term", "count", "docs"])

        for b in batches:
            for own_lang, own_source, words in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                total, within = seen.setdefault((own_lang, own_source), (Counter(), Counter()))
                size -= len(total)
                once = Counter(terms(words))
                total.update(once)
                within.update(once.keys())
                size += len(total)
                if size > most:
                    yield flush()
                    seen, size = {}, 0
        if seen:
            yield flush()

    made = read.mapInArrow(count, "lang string, source string, term binary, count long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / size), three digits at a time: no product leaves 64 bits for sizes below 9e15."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, size)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + digit
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def share_column(count: Column, size: Column) -> Column:
    """`share` as column expressions."""
    rest, out = (count + 2) % size, F.call_function("div", count + 2, size)
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, size)
        rest = rest * 1000 % size
    return out + 1


def gallop(small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two sorted arrays of distinct values, in each of them.

    The smaller array is walked in strides; a stride's two ends bound the part of the larger array in which its values are
    searched, so the work is that of the smaller array times the logarithm of the gaps between its values.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = 0
    for i in range(0, len(small), 4096):
        part = small[i : i + 4096]
        step = 4096
        while low + step < len(large) and large[low + step] <= part[-1]:
            step *= 2
        window = large[low : low + step + 1]
        at = np.searchsorted(window, part)
        hit = at < len(window)
        hit[hit] = window[at[hit]] == part[hit]
        found_a.append(np.flatnonzero(hit) + i)
        found_b.append(at[hit] + low)
        low += int(at[-1]) if len(at) else 0
        low = min(low, max(0, len(large) - 1))
    return np.concatenate(found_a), np.concatenate(found_b)


def price_block(ids_a, p_a, rest_a: int, ids_b, p_b, rest_b: int, kept: int) -> int:
    """Sum of prices over the `kept` terms of a block. `rest_*` is the share of a term that a source doesn't have."""
    if len(ids_a) > len(ids_b):
        ids_a, p_a, rest_a, ids_b, p_b, rest_b = ids_b, p_b, rest_b, ids_a, p_a, rest_a
    i, j = gallop(ids_a, ids_b)
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[i], only_b[j] = False, False
    both = int(price(p_a[i], p_b[j]).sum())
    one = int(price(p_a[only_a], np.int64(rest_b)).sum()) + int(price(np.int64(rest_a), p_b[only_b]).sum())
    none = (kept - len(ids_a) - len(ids_b) + len(i)) * int(price(np.int64(rest_a), np.int64(rest_b)))
    return both + one + none


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10, tile: int = 16) -> DataFrame:
    """lang, source, part, item, value, rank.

    Nulls of the three columns read as ''; rows are documents, repeated ones too. Part `pair`: each other source of the
    language by its divergence. Part `term`: the first `top` terms that the source has a larger share of than its language.
    Values are exact; equal ones are ranked by the item's bytes. Languages that keep no term give pairs of value 0.
    Languages' kept terms may be more than a task holds: blocks of `BLOCK` are. Other columns don't matter. An empty table
    gives an empty table.
    """
    counts = materialize(count_terms(docs, text, lang, source), "terms")
    known = counts.where(F.octet_length("term") > 0)
    terms_of = known.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    numbered = terms_of.drop("docs").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id())
    kept = materialize(numbered.withColumn("block", F.shiftright("id", BLOCK.bit_length() - 1)), "kept")
    rows = materialize(known.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "total", "id", "block"), "counts")

    # A row for each language and each group: small beside the counts.
    blocks = kept.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("n"))
    langs = blocks.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("kept").alias("v"), F.collect_list(F.struct("block", "kept")).alias("blocks"))
    groups = counts.where(F.octet_length("term") == 0).select("lang", "source")
    per_lang = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / tile)).cast("int").alias("tiles"))
    langs = materialize(per_lang.join(langs, "lang", "left"), "langs")
    sizes = rows.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = groups.join(sizes, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    groups = join_small(groups, langs, ["lang"]).withColumn("size", F.col("n") + 2 * F.coalesce("v", F.lit(0)))
    groups = groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    groups = materialize(groups, "groups")

    pairs = pair_values(rows, groups)
    term = group_terms(rows, groups, top)
    both = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return ranked.unionByName(term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: all ordered pairs of the sources of a language."""
    arrays = rows.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("id", "count"))).alias("x"))
    arrays = arrays.select("lang", "source", "block", F.col("x.id").alias("ids"), F.col("x.count").alias("counts"))
    none = F.array().cast("array<long>")
    # Every group is told to every block of its language, also where it has no term; block -1 stands for languages that keep none.
    own = groups.select("lang", "source", "size", "tile", "tiles", F.explode(F.coalesce("blocks", F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("kept"))))).alias("b"))
    own = own.select("lang", "source", "b.block", "b.kept", "size", "tile", "tiles", none.alias("ids"), none.alias("counts"))
    placed = join_small(arrays, groups.select("lang", "source", "size", "tile", "tiles"), ["lang", "source"])
    told = own.unionByName(placed.withColumn("kept", F.lit(0).cast("long")).select(*own.columns))
    told = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tasks = told.select("lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "source", "kept", "size", "ids", "counts")

    def merge(batches):
        for g in grouped(batches, ["lang", "block", "i", "j"]):
            i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
            kept = int(g["kept"].max())
            have: dict[str, tuple] = {}
            for source, tile, size, ids, counts in zip(g["source"], g["tile"], g["size"], g["ids"], g["counts"], strict=True):
                if source not in have or len(ids):
                    size = int(size)
                    have[source] = (tile, np.asarray(ids, np.int64), share(counts, size) if len(ids) else np.zeros(0, np.int64), int(share(np.zeros(1, np.int64), size)[0]) if kept else 0)
            names = sorted(have)
            a, b, value = [], [], []
            for x, one in enumerate(names):
                for other in names[x + 1 :]:
                    if i != j and have[one][0] == have[other][0]:
                        continue  # this pair belongs to the task of its own tile
                    a.append(one)
                    b.append(other)
                    value.append(price_block(*have[one][1:], *have[other][1:], kept) if kept else 0)
            text = {n: pd.Series(v, dtype=object) for n, v in (("lang", [g["lang"].iloc[0]] * len(a)), ("source", a), ("item", b))}
            yield pd.DataFrame({**text, "value": np.array(value, np.int64)})

    keys = ["lang", "block", "i", "j"]
    found = tasks.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merge, "lang string, source string, item string, value long")
    found = materialize(found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    return found.unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def group_terms(rows: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the first terms of each group, first within blocks of terms, then among those."""
    sized = join_small(rows, groups.select("lang", "source", "size", (F.col("lang_n") + 2 * F.col("v")).alias("lang_size")), ["lang", "source"])
    p, q = share_column(F.col("count"), F.col("size")), share_column(F.col("total"), F.col("lang_size"))
    priced = sized.select("lang", "source", "block", "term", p.alias("p"), q.alias("q")).where("p > q")
    priced = priced.select("lang", "source", "block", "term", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    order = [F.desc("value"), F.col("term")]
    first = priced.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source", "block").orderBy(*order))).where(F.col("r") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", "source", F.col("term").cast("string").alias("item"), "value", "rank")
