"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame functions only.

1. Each source gets a target number of words: shares by weight, at most `max_passes` times its own size, the excess
   shared again by weight until no source is above.
2. Documents are cut into blocks of words. A source's blocks stand in a random but fixed order; whole passes over the
   source and the first blocks of one more pass make up its target exactly (the last block is cut).
3. The sources' block quotas are split among the output shards by a binary tree: at every node each source's quota
   for the left half is a hypergeometric draw given what is left, so quotas of all shards add up exactly.
4. A source's blocks go to the shards in their permuted order, as many as each shard's quota: disjoint draws. Inside
   a shard, `shuffle_key` is a fresh random order.

Every random number is a hash of a seed and a stable identity, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import column, fields, give, hold, materialize, prefix_sums, text_key, word_count


#: Half the width of the region from which ratios of uniforms are proposed: so many standard deviations, and so much more.
_WIDER, _WIDE = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def source_targets(units: DataFrame, weights: Sequence[float] = (1, 2, 3), max_passes: int = 3) -> DataFrame:
    """One row per source: place (1, 2, ... by code point, null last), source, source_size, target.

    A source without words has target 0. The windows run over the table of sources only, which, like `split_quotas`,
    takes it as one task's work: meant for up to some ten thousands of sources.
    """
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("place", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_passes)
    # In order of cap / weight: those before a source are at their caps if it is the first that stays below its own.
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("_w", w).withColumn("_cap", cap)
    sources = sources.withColumn("_free", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    sources = sources.withColumn("_weight", F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = F.when(F.col("_free") / F.col("_weight") * F.col("_w") <= F.col("_cap"), F.col("_free") / F.col("_weight"))
    sources = sources.withColumn("_level", F.first(level, ignorenulls=True).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_w"))
    return sources.select("place", "source", "source_size", target.alias("target"))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column, v: Column) -> Column:
    """How many of `drawn` items from `total` are among the `good`, for uniform `u` (and `v`).

    Exact at every spread. Narrow distributions are inverted with `u` over 8 standard deviations around the mean. Where
    the standard deviation is over 64, numbers are proposed and accepted by ratios of uniforms (a stream derived from
    `v`), so that the work doesn't grow with the spread; 64 proposals are all refused in one case of 1e30.
    """

    def given(x: Column) -> Column:
        n_all, k, n, lo, hi, mean, sd = (x[c] for c in ("t", "k", "n", "lo", "hi", "mean", "sd"))
        first = F.greatest(lo, F.floor(mean - sd * 8 - 8).cast("long"))
        last = F.least(hi, F.ceil(mean + sd * 8 + 8).cast("long"))

        def ratio(i: Column) -> Column:  # probability of i + 1 over that of i
            d = lambda c: c.cast("double")
            return d(k - i) * d(n - i) / (d(i + 1) * d(n_all - k - n + i + 1))

        steps = F.sequence(first, last)
        mass = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
            lambda s, i: F.struct((s["p"] * F.when(i < last, ratio(i)).otherwise(0.0)).alias("p"), (s["sum"] + s["p"]).alias("sum")),
            lambda s: s["sum"],
        )
        exact = let(
            mass * u,
            lambda goal: F.aggregate(
                steps,
                F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), first.alias("at")),
                lambda s, i: F.when(s["sum"] >= goal, s).otherwise(
                    F.struct((s["p"] * F.when(i < last, ratio(i)).otherwise(0.0)).alias("p"), (s["sum"] + s["p"]).alias("sum"), i.alias("at"))
                ),
                lambda s: s["at"],
            ),
        )
        # Ratio of uniforms: a place is proposed around the mean and accepted by its probability over that of the mode.
        mode = F.floor((n + 1).cast("double") * (k + 1) / (n_all + 2)).cast("long")

        def log_ratio(z: Column) -> Column:
            """ln of p(z) / p(mode), arranged so that nothing large cancels: Stirling's series of four factorials."""
            d = (z - mode).cast("double")
            out = -d * F.log(z.cast("double") * (n_all - k - n + z) / ((k - z).cast("double") * (n - z)))
            for sign, at in ((1, mode), (-1, k - mode), (-1, n - mode), (1, n_all - k - n + mode)):
                b = at.cast("double")
                a = b + sign * d
                out = out - ((b + 0.5) * F.log1p(sign * d / b) - sign * d + 1 / (a * 12) - 1 / (b * 12) - 1 / (a * a * a * 360) + 1 / (b * b * b * 360))
            return out

        def attempt(i: Column) -> Column:
            x, y = uniform(v, i, F.lit(0)), uniform(v, i, F.lit(1))
            place = F.floor(mean + 0.5 + (F.sqrt(sd * sd + 0.5) * _WIDER + _WIDE) * (y - 0.5) / x)
            near = (place > lo) & (place < hi) & (F.abs(place - mean) < sd * 16)
            return let(place.cast("long"), lambda z: F.when(near & (F.log(x) * 2 <= log_ratio(z)), z))

        wide = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(None).cast("long"), lambda s, i: F.when(s.isNotNull(), s).otherwise(attempt(i)), lambda s: F.coalesce(s, mode))
        return F.when(lo >= hi, lo).when(sd > 64, wide).otherwise(exact)

    share = good / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(F.lit(0.0), drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1))))
    bounds = F.struct(
        total.cast("long").alias("t"), good.cast("long").alias("k"), drawn.cast("long").alias("n"),
        F.greatest(F.lit(0), drawn + good - total).cast("long").alias("lo"), F.least(drawn, good).cast("long").alias("hi"),
        (drawn * share).alias("mean"), spread.alias("sd"),
    )
    return let(bounds, given)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, quota) of all sources -> (place, shard, quota): the splitting tree, one row per node and level."""
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("place", F.col("quota").cast("long").alias("quota")))).alias("q"), F.sum("quota").cast("long").alias("n"))
    nodes = nodes.where("n is not null").withColumn("node", F.lit(0).cast("long"))
    width = shards
    while width > 1:
        width //= 2
        # Left halves: sources in turn, each given what the earlier ones left.
        start = F.struct(F.col("n").alias("total"), F.floor(F.col("n") / 2).cast("long").alias("left"), F.array().cast("array<struct<place:int,quota:bigint>>").alias("q"))

        level = F.lit(width)

        def step(s: Column, x: Column) -> Column:
            key = [F.lit(seed), level, F.col("node"), x["place"]]  # noqa: B023
            draw = hypergeometric(s["total"], x["quota"], s["left"], uniform(*key), uniform(*key, F.lit(1)))
            return let(
                draw,
                lambda d: F.struct(
                    (s["total"] - x["quota"]).alias("total"),
                    (s["left"] - d).alias("left"),
                    F.concat(s["q"], F.array(F.struct(x["place"].alias("place"), d.cast("long").alias("quota")))).alias("q"),
                ),
            )

        nodes = nodes.withColumn("lq", F.aggregate("q", start, step, lambda s: s["q"]))
        right = F.zip_with("q", "lq", lambda a, b: F.struct(a["place"].alias("place"), (a["quota"] - b["quota"]).alias("quota")))
        half = F.floor(F.col("n") / 2).cast("long")
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), half.alias("n"), F.col("lq").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - half).alias("n"), right.alias("q")),
        )
        nodes = nodes.select(F.explode(both).alias("x")).select("x.node", "x.n", "x.q")
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode("q").alias("x")).select("x.place", "shard", "x.quota")


def mix_units(units: DataFrame, weights: Sequence[float] = (1, 2, 3), max_passes: int = 3, shards: int = 16, block_words: int | None = 256, seed: int = 17) -> DataFrame:
    """Blocks drawn for the mix: unit, block, pass, words, place, source_size, target, shard, shuffle_key.

    `units` has unit (unique), source, size (words) and mix (a stable hash of the unit's content). With `block_words`
    None every unit is one block that is never cut. Units without words are never drawn; an empty table gives none.
    """
    targets = source_targets(units, weights, max_passes)
    if block_words:
        cut = F.posexplode(F.sequence(F.lit(0), F.ceil(F.col("size") / block_words).cast("int") - 1))
        blocks = units.where("size > 0").select("unit", "source", "size", "mix", cut.alias("_p", "block"))
        blocks = blocks.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * F.lit(block_words).cast("long")))
    else:
        blocks = units.where("size > 0").withColumn("block", F.lit(0)).withColumn("words", F.col("size"))
    blocks = blocks.select("unit", "source", "block", "words", F.lit(1).cast("long").alias("_one"), F.xxhash64(F.lit(seed), "mix", "block").alias("_order"))
    blocks = prefix_sums(blocks, ["source"], F.col("_order"), {"_before": "words", "_rank": "_one"})
    named = targets.select(F.col("source").alias("_source"), "place", "source_size", "target")
    blocks = blocks.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    goal = F.round("target").cast("long")
    whole = F.floor(goal / F.col("source_size")).cast("long")
    rest = goal - whole * F.col("source_size") - F.col("_before")
    last = F.greatest(F.lit(0), F.least(rest, F.col("words"))) if block_words else F.when(rest * 2 >= F.col("words"), F.col("words")).otherwise(0)
    blocks = blocks.withColumn("_whole", whole).withColumn("_last", last.cast("long"))
    blocks = materialize(blocks.select("unit", "block", "words", "place", "source_size", "target", "_rank", "_whole", "_last").where("_whole > 0 or _last > 0"), "mix-blocks")

    quotas = blocks.groupBy("place").agg(F.sum(F.col("_whole") + (F.col("_last") > 0).cast("long")).alias("quota"), F.count(F.lit(1)).alias("_blocks"))
    split = split_quotas(quotas.select("place", "quota"), shards, seed)
    ends = split.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("_q"))
    running = F.aggregate("_q", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x["quota"] + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    ends = ends.select("place", running.alias("_ends")).join(quotas.select("place", "_blocks"), "place")

    drawn = blocks.join(ends, "place").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_whole") + (F.col("_last") > 0).cast("long"))))
    # The blocks of whole passes come first, then those of the last; each pass in the permuted order.
    at = (F.col("pass") - 1) * F.col("_blocks") + F.col("_rank")
    # The shard that draws it, by the shards' quotas; what no quota reaches isn't drawn.
    drawn = drawn.withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= at))).where(F.col("_shard") < shards)
    shard = F.col("_shard")
    words = F.when(F.col("pass") <= F.col("_whole"), F.col("words")).otherwise(F.col("_last"))
    return drawn.select("unit", "block", F.col("pass").cast("int").alias("pass"), words.alias("words"), "place", "source_size", "target", shard.alias("shard")).withColumn(
        "shuffle_key", F.xxhash64(F.lit(seed + 1), "shard", "unit", "block", "pass")
    )


def mix_taken(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """Every row of `docs` with size, source_size, target, taken (the words of its blocks that the shards draw) and the
    shards it goes to, instead of its text.

    Columns of these names, in any case, are replaced; all others stay, whatever their names. A null text has size 0, a
    long one many blocks. Rows that are equal in all columns are different rows. Null is a source of its own, the last.
    An empty table gives an empty table.
    """
    names = fields(docs, "size", "source_size", "target", "taken", "shards")
    kept = [c for c in names if c.lower() != text.lower()]
    rows = hold(docs, kept, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(*[column(c) for c in names]).alias("mix"), F.monotonically_increasing_id().alias("unit"))
    rows = materialize(rows, "mix-units")  # so that the row numbers stay as they are
    units = rows.select("unit", "source", "size", "mix")
    mix = mix_units(units, **how)
    taken = mix.groupBy(F.col("unit").alias("taker")).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    targets = source_targets(units, how.get("weights", (1, 2, 3)), how.get("max_passes", 3)).select(F.col("source").alias("from"), "source_size", "target")
    out = rows.join(targets, F.col("source").eqNullSafe(F.col("from"))).join(taken, F.col("unit") == F.col("taker"), "left")
    return out.select(*give(kept), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is drawn, with shard and shuffle_key added.

    Documents are drawn whole, however long; null and empty texts are never drawn. Rows that are equal in all columns
    share one identity and are drawn as often as all of them together. Columns of the added names, in any case, are
    replaced; all others stay, whatever their names. An empty table gives an empty table.
    """
    names = fields(docs, "shard", "shuffle_key")
    key = text_key(F.to_json(F.struct(*[column(c).alias(c) for c in names]), {"ignoreNullFields": "false"}))
    keyed = hold(docs, names, key.alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sizes = keyed.groupBy("key").agg(F.first("source").alias("source"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    copies = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    units = copies.select(F.struct("key", "copy").alias("unit"), "source", "size", F.xxhash64("key", "copy").alias("mix"))
    mix = mix_units(units, block_words=None, **how)
    drawn = mix.select(F.col("unit.key").alias("taker"), "shard", "shuffle_key")
    one = keyed.select("row", "key").dropDuplicates(["key"])
    return one.join(drawn, F.col("key") == F.col("taker")).select(*give(names), "shard", "shuffle_key")


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in shuffled order."""
    mixed.repartition("shard").sortWithinPartitions("shard", "shuffle_key").write.partitionBy("shard").parquet(path)
