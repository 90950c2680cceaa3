"""Document fingerprints: threshold-scaled sketches of word shingles; DataFrame functions only.

Every shingle hash below a fixed fraction of the range is kept, so sketches of parts merge to the sketch of the whole
and containment between very unequal documents is estimated without bias. A text without a hash below the threshold
(mostly a short one) is represented by its least hash, so that every text has a sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import SPACE, materialize, text_key
from pagewright.llm.mixing import let

#: The fraction of hashes that a sketch keeps, a choice between size and precision: at a quarter a text of n words has
#: about n / 4 hashes, 4 n characters as hexadecimal text, and likeness errs by about 1 / sqrt(n / 4) at most.
FRACTION = 1 / 4


def threshold(fraction: float) -> int:
    return -(1 << 63) + int(fraction * (1 << 64))


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """64-bit hashes of all runs of `words` words; a shorter text is one run, also an empty one."""
    split = F.filter(F.split(text, SPACE), lambda w: w != "")
    return let(split, lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(a, i, words))))


def sketch(text: Column, fraction: float = FRACTION, words: int = 5) -> Column:
    """Sorted distinct hashes below the threshold; if there is none, the least of all."""
    below = lambda h: F.filter(h, lambda x: x < F.lit(threshold(fraction)))
    return let(shingle_hashes(F.coalesce(text, F.lit("")), words), lambda h: let(below(h), lambda b: F.when(F.size(b) > 0, F.array_sort(F.array_distinct(b))).otherwise(F.array(F.array_min(h)))))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of two shingle sets, from their sketches: a hash that only stood in for a text without
    any below the threshold goes once there is one below."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < F.lit(threshold(fraction)))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def place_among(bounds: list, x: Column, kind: str = "long") -> Column:
    """How many of the sorted bounds, values of the type `kind`, are at most x (null: 0), by binary search."""
    if not bounds:
        return F.lit(0)
    limits = F.array(*[F.lit(b).cast(kind) for b in bounds])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.element_at(limits, middle + 1) <= x
        return F.when(s["lo"] >= s["hi"], s).when(up, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.when(x.isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"]))


def range_bounds(rows: DataFrame, n: int, parts: int, drawn: int = 16) -> list:
    """Ids that cut `n` rows into about `parts` ranges: every `drawn`-th of some drawn * parts ids, chosen by hash, in
    order. Both the sample and the bounds are of the square root of the table at most."""
    share = min(1.0, drawn * parts / n)
    sample = rows.where(F.col("doc_id").isNotNull()).where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    ids = [r[0] for r in sample.select("doc_id").distinct().orderBy("doc_id").limit(2 * drawn * parts).collect()]
    return ids[drawn::drawn]


def with_next(docs: DataFrame, doc_id: str = "doc_id", per_part: int = 4000) -> DataFrame:
    """doc_id, text, fp and next_text, next_fp: those of the next document by ascending id; after the last, the first.

    Null texts count as empty, null ids come first, equal ids stand in the order of their texts' hashes; null ids, and
    equal ones, share a range. Ids may be of any type that can be ordered. Ranges of ids of similar row counts, told from
    a sample of ids by hash, are windows of their own; the first row of each range is repeated as the last of the range
    before, so no window spans the table and the rows move once. A range has about `per_part` rows, in a table of over
    per_part ** 2 rows as many as there are ranges, so that neither a window nor the list of bounds grows with the table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, n // max(per_part, math.isqrt(n)))
    bounds = range_bounds(rows, n, parts) if parts > 1 else []
    rows = rows.withColumn("part", place_among(bounds, F.col("doc_id"), dict(rows.dtypes)["doc_id"])).withColumn("key", text_key(F.col("text")))
    firsts = rows.groupBy("part").agg(F.min_by(F.struct("doc_id", "key", "text"), F.struct("doc_id", "key")).alias("x"))
    firsts = materialize(firsts, "range-firsts")
    # The range before each: windows over the ranges' numbers only, the first comes after the last.
    before = firsts.select(F.col("part").alias("own"), F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("before"))
    firsts = firsts.join(before, F.col("part") == F.col("own")).select(F.col("before").alias("part"), "x.doc_id", "x.key", "x.text")
    both = rows.withColumn("ghost", F.lit(0)).unionByName(firsts.withColumn("ghost", F.lit(1)))
    both = both.repartition("part").withColumn("fp", sketch(F.col("text")))  # after the rows have moved
    order = Window.partitionBy("part").orderBy("ghost", "doc_id", "key")
    return both.select("doc_id", "text", "fp", "ghost", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where("ghost = 0").drop("ghost")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The fingerprint of every whole text and of its edited text, and how like they are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    kept_by_edited (the share of the fingerprint that the edited text's contains). An empty table gives no rows; a
    single document is its own next one; repeated rows are documents of their own. The work on a text is linear in its
    length. Only `doc_id` and `text` are read; other columns don't matter.
    """
    rows = with_next(docs, doc_id).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("efp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("fp"), F.col("efp")).alias("kept_by_edited"),
    )
