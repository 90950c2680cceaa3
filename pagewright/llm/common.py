"""Helpers shared by the training-data operators: shared-folder tables, exact ranks, text keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space separates words, as in the mixing contract.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: dict[str, list[str]] = {}
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`. Where the session names none, a local master (tests)
    gets a temporary folder, and a cluster a folder of its warehouse, unless that is a machine's own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and (warehouse.startswith("file:") or ":" not in warehouse):
            raise ValueError("set spark.checkpoint.dir: on a cluster, executors don't share the warehouse's local folder")
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-pagewright-") if local else f"{warehouse}/_pagewright"
    return _own_folder[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written by `materialize`; results that still read them must be saved
    before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for at in _written.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(at)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def fields(df: DataFrame, *without: str) -> list[str]:
    """The columns of `df` but those of the given names, which are compared without case, as Spark does."""
    gone = {c.lower() for c in without}
    return [c for c in df.columns if c.lower() not in gone]


def column(name: str) -> Column:
    """A column of exactly this name, also if it has dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def hold(df: DataFrame, kept: Sequence[str], *derived: Column) -> DataFrame:
    """The kept columns as one struct `row`, and the derived columns beside it: whatever names the kept ones have, they
    meet none of an operator's own."""
    row = F.struct(*[column(c).alias(c) for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    return df.select(row.alias("row"), *derived)


def give(kept: Sequence[str]) -> list[Column]:
    """The kept columns out of their struct."""
    return [F.col("row").getField(c).alias(c) for c in kept]


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch, where the session names no bound: texts may be long, workers are small.

    A batch ends after the row that passes the bound, so a longer text is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def slices(batches: Iterable[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Arrow batches in smaller parts, so that what is derived from whole texts stays small in memory."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows].reset_index(drop=True)


def text_key(text: Column) -> Column:
    """128-bit identity of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], order: Column, add: dict[str, str], rows_per_part: int = 4_000) -> DataFrame:
    """For each row, the sum of a column over the rows of its key that stand before it.

    `order` is a 64-bit hash column; `add` maps an output name to the summed (long) column. A key with many rows is
    cut into ranges of the hash, so that no window holds a whole hot key: sums of whole ranges are added to the
    sums within the range. Ties of the hash are broken by all summed columns' rows arbitrarily only if equal.
    """
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_part)).cast("long")
    total = total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], ranges.alias("_ranges"))
    rows = df.withColumn("_o", order)
    same = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = c if same is None else same & c
    rows = rows.join(total, same).drop(*[f"_k{i}" for i in range(len(keys))])
    # The hash's upper 31 bits, as a share of 1, times the number of ranges.
    rows = rows.withColumn("_range", F.floor((F.shiftrightunsigned("_o", 33)) * F.col("_ranges") / F.lit(float(2**31))).cast("long"))
    parts = rows.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in add.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in add],
    )
    within = Window.partitionBy(*keys, "_range").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{n}") for n, c in add.items()])
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(parts, on)
    for n in add:
        out = out.withColumn(n, F.col(f"_w_{n}") + F.col(f"_b_{n}"))
    drop = ["_o", "_ranges", "_range", "_r", *[f"_k{i}" for i in range(len(keys))]]
    return out.drop(*drop, *[f"_{x}_{n}" for x in "wb" for n in add])


def join_small(rows: DataFrame, small: DataFrame, on: list[str], most: int = 100_000, salts: int = 64) -> DataFrame:
    """`rows` joined with a table that has one row for each key `on`, whichever key holds many of the rows.

    The rows of `small` are counted: up to `most` they are broadcast. Beyond, they are repeated for each of `salts` parts,
    and the rows of a key are dealt to these parts.
    """
    if small.count() <= most:
        return rows.join(F.broadcast(small), on)
    part = F.pmod(F.hash(*map(column, rows.columns)), F.lit(salts))
    repeated = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_part", part).join(repeated, [*on, "_part"]).drop("_part")


def join_hot(rows: DataFrame, single: DataFrame, on: list[str], bound: int = 20_000, counted: str | None = None) -> DataFrame:
    """`rows` joined with a table that has at most one row for each key `on`, no task holding a hot key.

    Keys are counted first (or `counted` names the column of `single` that has the number of their rows). One with more
    than `bound` rows, or than a millionth of all, so that at most a million keys are broadcast, is dealt to as many parts
    as its count asks for; its single row is repeated for these.
    """
    n = F.col(counted) if counted else F.col("_n")
    counts = single.select(*on, n.alias("_n")) if counted else rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts.where(F.col("_n") > bound), "hot")
    seen = counts.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not seen[0]:
        return rows.join(single, on)
    bound = max(bound, seen[1] // 1_000_000)
    hot = F.broadcast(counts.where(F.col("_n") > bound).select(*on, F.ceil(F.col("_n") / bound).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*map(column, rows.columns)), parts).cast("int")).drop("_parts")
    repeated = single.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"]).drop("_part")
