"""Media columns: chroma fingerprints of audio, and alignment of recordings by offset histograms and bit errors.

Audio is a binary column of 16-bit little-endian mono samples. Frames of a short-time Fourier transform are folded
into twelve pitch classes; over the table of pitch classes by frames, rectangle filters (sums read off an integral
image) give two bits each, packed into one 32-bit integer per frame. Recordings align where many equal integers agree
on one offset; the share of differing bits at that offset says how alike they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import fields, give, hold, join_hot, materialize, small_batches

RATE, FRAME, HOP = 5512, 2048, 512
WIDTH = 8  # frames that a filter spans


def classes_of_bins(rate: int = RATE, frame: int = FRAME, low: float = 100.0, high: float = 2500.0) -> np.ndarray:
    """12 x frequency bins: 1 where a bin's pitch belongs to the class (A = 0)."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    use = (f >= low) & (f <= high)
    pitch = np.round(12 * np.log2(np.where(use, f, 440.0) / 440.0)).astype(int) % 12
    return ((pitch[None, :] == np.arange(12)[:, None]) & use[None, :]).astype(np.float32)


_CLASSES, _HANN = classes_of_bins(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 energies, each frame of unit length (silence: zeros). Shorter than a frame: padded to one; empty: none."""
    if not len(samples):
        return np.zeros((0, 12), np.float32)
    x = samples.astype(np.float32)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.concatenate([(np.abs(np.fft.rfft(frames[i : i + 256] * _HANN, axis=1)) ** 2).astype(np.float32) @ _CLASSES.T for i in range(0, len(frames), 256)])
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of 16 rectangle filters, by a rule over their place in the list."""
    out = []
    for i in range(16):
        kind, height = i % 4, (2, 4, 6, 12)[i // 4 % 4]
        out.append((kind, i * 5 % (13 - height), height, (8, 4, 6, 8)[i % 4]))
    return out


def codes(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each place where the filters fit. Fewer than WIDTH frames: none."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def total(t0, t1, c0, c1):
        return image[t + t1, c1] - image[t + t0, c1] - image[t + t1, c0] + image[t + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in filters():
        half, mid = w // 2, c + h // 2
        if kind == 0:  # earlier against later
            a, b = total(0, half, c, c + h), total(half, w, c, c + h)
        elif kind == 1:  # lower against higher classes
            a, b = total(0, w, c, mid), total(0, w, mid, c + h)
        elif kind == 2:  # checkerboard
            a = total(0, half, c, mid) + total(half, w, mid, c + h)
            b = total(0, half, mid, c + h) + total(half, w, c, mid)
        else:  # middle frames against the outer ones
            q = max(1, w // 4)
            a, b = total(q, w - q, c, c + h), total(0, q, c, c + h) + total(w - q, w, c, c + h)
        ratio = np.log((1 + a) / (1 + b))
        step = (ratio > -0.25).astype(np.uint32) + (ratio > 0) + (ratio > 0.25)
        out = (out << np.uint32(2)) | (step ^ (step >> np.uint32(1)))  # Gray code: near steps differ in one bit
    return out


def fingerprint(audio: bytes | None) -> np.ndarray:
    return codes(chroma(np.frombuffer(audio[: len(audio) // 2 * 2], "<i2"))) if audio else np.zeros(0, np.uint32)


_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, overlapping frames) with b's frame i against a's frame i + offset."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 1.0, 0
    x = a[lo:hi] ^ b[lo - offset : hi - offset]
    return float((_BITS[x & 0xFFFF].sum(dtype=np.int64) + _BITS[x >> 16].sum(dtype=np.int64)) / (32 * len(x))), hi - lo


def fingerprint_audio(df: DataFrame, audio: str = "audio") -> DataFrame:
    """Adds n_frames and fingerprint (little-endian 32-bit integers) to `df`, without the audio.

    Null, empty and very short audio has no frames and an empty fingerprint; audio is taken whole. Columns of the added
    names, in any case, are replaced; all others stay, whatever their names.
    """

    small_batches(df.sparkSession)

    @F.pandas_udf("n_frames int, fingerprint binary")
    def make(values: pd.Series) -> pd.DataFrame:
        prints = [fingerprint(v) for v in values]
        return pd.DataFrame({"n_frames": [len(p) for p in prints], "fingerprint": [p.astype("<u4").tobytes() for p in prints]})

    kept = fields(df, "n_frames", "fingerprint", audio)
    made = hold(df, kept, make(F.col(audio)).alias("made"))
    return made.select(*give(kept), "made.n_frames", "made.fingerprint")


def print_key(fingerprint: Column) -> Column:
    """Identity of a fingerprint: recordings that share it are one class."""
    return F.unhex(F.md5(fingerprint))


def runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, code, frame, length: each maximal run of equal integers in a fingerprint, so that a held tone or silence is
    one row, however long."""
    for b in batches:
        p = [np.frombuffer(f, "<u4") for f in b["fingerprint"]]
        n = [len(x) for x in p]
        of = np.repeat(np.arange(len(p)), n)
        frame = np.concatenate([np.zeros(0, np.int64), *[np.arange(k) for k in n]])
        code = np.concatenate([np.zeros(0, np.uint32), *p]).astype(np.int64)
        start = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (frame == 0))
        length = np.diff(start, append=len(code)).astype(np.int32)
        yield pd.DataFrame({"key": b["key"].to_numpy()[of[start]], "code": code[start], "frame": frame[start].astype(np.int32), "length": length})


def join_codes(a: DataFrame, b: DataFrame, bound: int = 2_000, most: int = 1_000_000) -> DataFrame:
    """`a` (class, code, ...) and `b` (asked, code, ...) joined on the code, no task holding a hot one.

    Codes are counted on both sides. One with more than `bound` rows on a side (or than a part in `most` of all rows, so
    that at most twice `most` codes are broadcast) is dealt to a grid: rows of each side to as many parts as their
    count asks for, each part meeting each of the other side once.
    """
    n = a.groupBy("code").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("code").agg(F.count(F.lit(1)).alias("nb")), "code")
    hot = materialize(n.where(F.greatest("na", "nb") > bound), "hot")
    seen = hot.agg(F.count(F.lit(1)), F.sum("na"), F.sum("nb")).first()
    if not seen[0]:
        return a.join(b, "code")
    bound = max(bound, max(seen[1], seen[2]) // most)
    hot = hot.where(F.greatest("na", "nb") > bound).select("code", F.ceil(F.col("na") / bound).cast("int").alias("pa"), F.ceil(F.col("nb") / bound).cast("int").alias("pb"))

    def deal(rows, own, other, mine, theirs):
        dealt = rows.join(F.broadcast(hot), "code", "left").withColumn(mine, F.pmod(F.xxhash64(*rows.columns), F.coalesce(own, F.lit(1))).cast("int"))
        return dealt.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("pa", "pb")

    left, right = deal(a, F.col("pa"), F.col("pb"), "i", "j"), deal(b, F.col("pb"), F.col("pa"), "j", "i")
    return left.join(right, ["code", "i", "j"]).drop("i", "j")


def offset_votes(distance: np.ndarray, la: np.ndarray, lb: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """(votes, the offset of the first): the offset histogram of a pair from its pairs of runs of lengths `la` and `lb`,
    whose starts are `distance` apart, each `n` times. Two runs vote for a range of offsets, rising and falling."""
    low = distance.astype(np.int64) - lb + 1
    first = int(low.min())
    bend = np.zeros(int((low + la + lb).max()) - first + 1, np.int64)
    for at, sign in ((low, 1), (low + la, -1), (low + lb, -1), (low + la + lb, 1)):
        np.add.at(bend, at - first, sign * n)
    return bend.cumsum().cumsum(), first


def align_classes(prints: DataFrame, queries: DataFrame, most_error: float = 0.3, least_frames: int = 16, bound: int = 2_000) -> DataFrame:
    """class, asked, offset, bit_error, frames: for each two distinct fingerprints of `prints` and `queries` that align,
    the best offset.

    The runs of equal integers of both sides are joined (hot ones dealt, see `join_codes`) and counted by pair and
    distance, which gives the histogram of offsets of each pair in one row; it meets its two fingerprints once. At every
    offset with a vote the bit error is taken over all overlapping frames, at least `least_frames` of them (or the whole
    of the shorter side). Of the offsets with at most `most_error`, that of least error counts, then that of most equal
    integers, then the least.
    """
    distinct = lambda df: materialize(df.select(print_key(F.col("fingerprint")).alias("key"), "fingerprint").dropDuplicates(["key"]), "prints")
    mine, theirs = distinct(prints), distinct(queries)
    schema = "key binary, code long, frame int, length int"
    a = mine.mapInPandas(runs, schema).select(F.col("key").alias("class"), "code", "frame", F.col("length").alias("la"))
    b = theirs.mapInPandas(runs, schema).select(F.col("key").alias("asked"), "code", F.col("frame").alias("their"), F.col("length").alias("lb"))
    met = join_codes(a, b, bound).groupBy("class", "asked", (F.col("frame") - F.col("their")).alias("d"), "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(met.groupBy("class", "asked").agg(F.collect_list(F.struct("d", "la", "lb", "n")).alias("met")), "pairs")

    @F.pandas_udf("offset int, bit_error double, frames int")
    def compare(x: pd.Series, y: pd.Series, d: pd.Series, la: pd.Series, lb: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for f, g, *hits in zip(x, y, d, la, lb, n, strict=True):
            f, g, best = np.frombuffer(f, "<u4"), np.frombuffer(g, "<u4"), None
            votes, first = offset_votes(*hits)
            least = min(least_frames, len(f), len(g))
            for o in np.flatnonzero(votes):
                error, frames = bit_error(f, g, int(o) + first)
                if frames >= least and error <= most_error:
                    found = (error, -int(votes[o]), int(o) + first, frames)
                    best = found if best is None else min(best, found)
            out.append((0, 1.0, -1) if best is None else (best[2], best[0], best[3]))
        return pd.DataFrame(out, columns=["offset", "bit_error", "frames"])

    both = join_hot(pairs, mine.select(F.col("key").alias("class"), F.col("fingerprint").alias("x")), ["class"])
    both = join_hot(both, theirs.select(F.col("key").alias("asked"), F.col("fingerprint").alias("y")), ["asked"])
    column = lambda name: F.transform("met", lambda m: m[name])
    found = both.select("class", "asked", compare("x", "y", *map(column, ("d", "la", "lb", "n"))).alias("c"))
    return found.where("c.frames >= 0").select("class", "asked", "c.offset", "c.bit_error", "c.frames")


def align_recordings(prints: DataFrame, queries: DataFrame, rec: str, most_error: float = 0.3, least_frames: int = 16) -> DataFrame:
    """rec, query, offset, bit_error, frames, n_aligned: for every recording each query that it aligns with, and how many
    do.

    `prints` and `queries` have `rec` and `fingerprint`. Recordings that align with no query have one row of nulls and
    n_aligned 0. Repeated rows are recordings, and queries, of their own; queries without a key are none. Recordings of
    one fingerprint are compared once (see `align_classes`) and written out here for each of them.
    """
    asked = queries.where(F.col(rec).isNotNull())
    found = materialize(align_classes(prints, asked, most_error, least_frames), "aligned")
    named = found.join(asked.select(F.col(rec).alias("query"), print_key(F.col("fingerprint")).alias("asked")), "asked").drop("asked")
    own = hold(prints, [rec], print_key(F.col("fingerprint")).alias("own"), F.monotonically_increasing_id().alias("unit"))
    count = named.groupBy(F.col("class").alias("of")).agg(F.count(F.lit(1)).alias("n_aligned"))
    out = own.join(named, F.col("own") == F.col("class"), "left").join(count, F.col("own") == F.col("of"), "left")
    return out.select(*give([rec]), "query", "offset", "bit_error", "frames", F.coalesce("n_aligned", F.lit(0)).cast("long").alias("n_aligned"))


def melody(values: np.ndarray, note: int = 689, seed: int = 0, noise: float = 0.0, skip: int = 0) -> bytes:
    """Audio of a vector: one tone a value (its pitch by the value), an eighth of a second each."""
    v = np.nan_to_num(np.asarray(values, np.float64))
    pitch = np.clip(np.round(v * 60), -24, 24)
    f = 440.0 * 2 ** (pitch / 12)
    t = np.arange(note) / RATE
    x = np.sin(2 * np.pi * f[:, None] * t) * (0.6 + 0.4 * np.cos(2 * np.pi * t * 4))
    x = x.ravel()[skip:]
    if noise:
        x = x + np.random.default_rng(seed).normal(0, noise, len(x))
    return (np.clip(x, -1.2, 1.2) * 20000).astype("<i2").tobytes()


def audio_of_vectors(vectors: DataFrame, key: str, column: str, noise: float = 0.0, skip: int = 0, rows: int = 64) -> DataFrame:
    """(key, audio): a recording for each vector, derived on the executors. Null vectors give null audio. Recordings are
    much larger than their vectors, so they leave a worker `rows` at a time."""
    asked = vectors.select(F.col(key).alias(key), F.col(column).alias("values"))

    def render(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                audio = [None if v is None else melody(v, seed=0 if k is None else int(k), noise=noise, skip=skip) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(audio, pa.binary())], [key, "audio"])

    return asked.mapInArrow(render, T.StructType([asked.schema.fields[0], T.StructField("audio", T.BinaryType())]))


def match_recordings(vectors: DataFrame, key: str, column: str, every: int = 100) -> DataFrame:
    """Fingerprints of all recordings of `vectors` and their alignment with the query recordings: those of every
    `every`-th key, started late and with noise.

    Returns key, n_frames, fingerprint_sha256, class_id (the least key of the recordings that share the fingerprint) and
    what `align_recordings` says. Each recording has a row; the queries that a class aligns with stand at one of its
    recordings, a row for each, the others have their number in n_aligned only. Null vectors have no frames. Keys are
    whole numbers; a null key is no query. Repeated rows are recordings of their own; other columns don't matter, whatever
    their names. An empty table gives an empty table.
    """
    held = vectors.select(F.col(key).alias("key"), F.col(column).alias("values"))
    prints = fingerprint_audio(audio_of_vectors(held, "key", "values")).withColumn("unit", F.monotonically_increasing_id())
    prints = materialize(prints.withColumn("own", print_key(F.col("fingerprint"))), "fingerprints")
    asked = fingerprint_audio(audio_of_vectors(held.where(F.col("key") % every == 0), "key", "values", noise=0.05, skip=3 * HOP))
    asked = materialize(asked, "queries")
    found = materialize(align_classes(prints, asked), "aligned")
    named = found.join(asked.select(F.col("key").alias("query"), print_key(F.col("fingerprint")).alias("asked")), "asked").drop("asked")
    classes = prints.groupBy("own").agg(F.min("key").alias("class_id"), F.min("unit").alias("first"))
    count = named.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    classes = classes.join(count, F.col("own") == F.col("class"), "left").select(F.col("own").alias("of"), "class_id", "first", F.coalesce("n", F.lit(0)).alias("n_aligned"))
    rows = prints.join(classes, F.col("own") == F.col("of"))
    rows = rows.join(named, (F.col("own") == F.col("class")) & (F.col("unit") == F.col("first")), "left")
    return rows.select(F.col("key").alias(key), "n_frames", F.sha2("fingerprint", 256).alias("fingerprint_sha256"), "class_id", "query", "offset", "bit_error", "frames", "n_aligned")
