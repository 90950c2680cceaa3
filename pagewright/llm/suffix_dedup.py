"""Suffix-array dedup of byte strings: every byte that a repeated string of `length` bytes covers is removed.

1. Each start of a string of `length` bytes belongs to an anchor: the place with the least hash of 8 bytes among the
   first WINDOW places of the string. Equal strings have equal anchors, at the same distance from their starts. The
   `length - WINDOW + 1` bytes from an anchor on, its core, are part of all its strings.
2. Anchors whose core occurs once are done with: none of their strings repeats. That leaves the text around repeated
   cores: up to WINDOW - 1 bytes on each side.
3. For each repeated core, the distinct surroundings (pieces of the left bytes, the core, pieces of the right bytes, a
   symbol each) are put one after the other, with a separator of its own after each, and their suffix array is built
   by linear grouping. A string is repeated if the suffix at its start agrees with a neighbouring one over all symbols
   that the string spans. Surroundings that occur more than once are put in twice; those that agree with no others over
   a whole string stay out. Equal texts are looked into once.
4. A core with more than HOT distinct surroundings is split: of a string, either the bytes before the core or those
   after it make up half of its other bytes, so strings with the same near half on the left (or right) share a longer
   core, and are looked for among the surroundings that have it. This is repeated until each part has few; a part never
   holds more, however often a core occurs.
5. The repeated starts go back to the documents that have those surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fields, give, hold, join_hot, materialize, slices, small_batches, text_key
from pagewright.llm.gsaca import suffix_array

WINDOW = 160
HOT = 1_000


def anchors(texts: list[bytes], length: int, window: int = WINDOW, together: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, anchor, first start, last start) of the runs of starts that share an anchor, for each text
    of at least `length` bytes. Texts are put together up to `together` bytes, which fit a cache; no start whose string
    crosses an end counts."""
    k = 0
    while k < len(texts):
        some, size = [], 0
        while k < len(texts) and (not some or size + len(texts[k]) <= together):
            if len(texts[k]) >= length:
                some.append(k)
                size += len(texts[k])
            k += 1
        if not some:
            continue
        ends = np.cumsum([len(texts[i]) for i in some])
        starts = ends - [len(texts[i]) for i in some]
        b = np.frombuffer(b"".join([*(texts[i] for i in some), bytes(window + 8)]), np.uint8).astype(np.uint64)
        g = b[:-1] | (b[1:] << np.uint64(8))
        g = g[:-2] | (g[2:] << np.uint64(16))
        g = (g[:-4] | (g[4:] << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < window:
            low = np.minimum(low[: width - window], low[window - width :])
        at = (low[:size] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(size + 1, bool)
        for lo, hi in zip(starts.tolist(), (ends - length + 1).tolist(), strict=True):
            inside[lo:hi] = True
        inside = inside[:-1]
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        old = inside.copy()
        old[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(old)
        edge = np.searchsorted(first, [*starts.tolist(), size])
        for j, i in enumerate(some):
            lo, hi = edge[j], edge[j + 1]
            yield i, at[first[lo:hi]] - starts[j], first[lo:hi] - starts[j], last[lo:hi] - starts[j]


def common(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def shared_paths(sides: list[bytes]) -> list[list[tuple[int, tuple[int, int]]]]:
    """For each string its way in the trie of all, as far as another string goes along: (length, name) at each place where
    some part or end. Strings that agree up to a length have the same places and names up to there, so a name stands for all
    bytes before it."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    agree = [common(sides[a], sides[b]) for a, b in zip(order, order[1:], strict=False)]
    parts: list[set[int]] = [set() for _ in sides]
    later: list[int] = []  # rising lengths at which the strings behind part from this one
    for i in range(len(agree) - 1, -1, -1):
        while later and later[-1] >= agree[i]:
            later.pop()
        if agree[i]:
            later.append(agree[i])
        parts[order[i]].update(later)
    out: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in sides]
    sooner: list[tuple[int, int]] = []  # the same of those before, with the first string that agrees so far
    for i, k in enumerate(order):
        if i:
            first, n = i - 1, agree[i - 1]
            while sooner and sooner[-1][0] >= n:
                first = sooner.pop()[1]
            if n:
                sooner.append((n, first))
        j = 0
        for n in sorted(parts[k].union(x for x, _ in sooner)):
            while j < len(sooner) and sooner[j][0] < n:
                j += 1
            out[k].append((n, (n, sooner[j][1] if j < len(sooner) else i)))
    return out


def repeated_runs(members: list[tuple[int, bytes, bytes]], window: int = WINDOW) -> list[list[int]]:
    """For each (core number, left, right): first and last of the runs of starts, from the core on (-3: three bytes before it),
    whose string another member has too.

    The bytes next to a core are taken in pieces, cut where members of the core part from this one, and end where no other
    member goes along: inside a piece members agree wholly or not at all. So the sequence for the suffix array has a symbol
    for each piece, for the core, for the pieces on the other side, and a separator of its own. A member whose shared pieces
    are too short for any string is left out.
    """
    by_core: dict[int, list[int]] = {}
    for k, (core, _, _) in enumerate(members):
        by_core.setdefault(core, []).append(k)
    names: dict[tuple, int] = {}
    text: list[int] = []
    put: list[tuple[int, int, list[int], list[int]]] = []
    for c, ks in by_core.items():
        if len(ks) < 2:
            continue
        lefts, rights = shared_paths([members[k][1][::-1] for k in ks]), shared_paths([members[k][2] for k in ks])
        for k, left, right in zip(ks, lefts, rights, strict=True):
            before, after = [0, *(n for n, _ in left)], [0, *(n for n, _ in right)]
            if before[-1] + after[-1] < window - 1:
                continue
            put.append((k, len(text) + len(left), before, after))
            pieces = [*((c, 0, x) for _, x in reversed(left)), (c, 1, None), *((c, 2, x) for _, x in right)]
            text.extend(names.setdefault(x, len(names)) for x in pieces)
            text.append(-len(put))
    out: list[list[int]] = [[] for _ in members]
    if len(put) < 2:
        return out
    order = suffix_array([s + len(put) for s in text])  # all symbols at least 0; the separators differ
    # Agreement of neighbours in the suffix array.
    t, a, b = np.asarray(text), np.asarray(order[:-1]), np.asarray(order[1:])
    lcp, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    d = 0
    while len(open_):
        fit = (a[open_] + d < len(t)) & (b[open_] + d < len(t))
        open_ = open_[fit]
        open_ = open_[t[a[open_] + d] == t[b[open_] + d]]
        lcp[open_] += 1
        d += 1
    best = np.empty(len(text), np.int64)
    best[np.asarray(order)] = np.maximum(np.concatenate(([0], lcp)), np.concatenate((lcp, [0])))
    best = best.tolist()
    for k, core, before, after in put:
        for j in range(len(before) - 1, -1, -1):
            behind = best[core - j] - j - 1  # pieces behind the core on which another member agrees
            if behind >= 0:
                least = max(before[j - 1] + 1 if j else 0, window - 1 - after[behind])  # fewer bytes before want more behind
                if least <= before[j]:
                    out[k] += [-before[j], -least]
    return out


def repeated_starts(members: list[tuple[int, bytes, bytes]], window: int = WINDOW) -> list[np.ndarray]:
    """The same as a flag for each start in `left` and at the core, the last one that the right bytes allow included."""
    out = [np.zeros(len(left) + len(right) - window + 2, bool) for _, left, right in members]
    for (_, left, _), flags, runs in zip(members, out, repeated_runs(members, window), strict=True):
        for lo, hi in zip(runs[::2], runs[1::2], strict=True):
            flags[len(left) + lo : len(left) + hi + 1] = True
    return out


def ranges(flags: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return np.stack([edge[::2], edge[1::2] - 1], axis=1)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400, window: int = WINDOW, together: int = 5_000, hot: int = HOT) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, kept_sha256 and `kept` (the remaining bytes) instead of the text.

    Texts are taken whole, as UTF-8 (null: empty); matches never cross rows, but may overlap and lie in one row. All
    strings are judged on the input. Equal texts of at least `length` bytes lose all; repeated rows are rows of their
    own. Columns of the added names, in any case, are replaced; all others stay, whatever their names. An empty table
    gives an empty table.
    """
    small_batches(docs.sparkSession)
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    others = fields(docs, *new, text)
    rows = hold(docs, others, F.coalesce(F.col(text), F.lit("")).alias("_text"), text_key(F.col(text)).alias("_key"))
    core_bytes = length - window + 1

    def cores(batches):
        for b in slices(batches):
            keys = b["_key"].to_numpy()
            data = [t.encode("utf-8", "surrogatepass") for t in b["_text"]]
            h, at, of, n = [], [np.zeros(0, np.int64)], [], []
            for i, c, _, _ in anchors(data, length, window):
                d = data[i]
                h.extend(xxhash.xxh3_64_intdigest(d[x : x + core_bytes]) for x in c.tolist())
                at.append(c)
                of.append(i)
                n.append(len(c))
            yield pd.DataFrame({"h": np.array(h, np.uint64).view(np.int64), "at": np.concatenate(at), "_of": keys[np.repeat(np.array(of, np.int64), n)]})

    found = rows.select("_key", "_text").mapInPandas(cores, "h long, at long, _of binary")
    repeated = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "core-counts")
    place = F.when(F.col("c") > hot, -1 - F.col("at")).otherwise(F.col("at"))  # of a hot core: negative
    marked = join_hot(found, repeated, ["h"], counted="c").groupBy("_of").agg(F.array_sort(F.collect_set(place)).alias("_at"))
    copies = rows.groupBy(F.col("_key").alias("_same")).agg(F.count(F.lit(1)).alias("_n"))
    marked = marked.join(copies, F.col("_of") == F.col("_same")).drop("_same")
    marked = materialize(marked, "repeated-cores")
    candidates = rows.join(marked, F.col("_key") == F.col("_of")).drop("_of")
    candidates = materialize(candidates, "candidates")
    # Of equal texts one is looked into, and counts for all.
    own = ["_key", "_text", "_at", "_n"]
    equal = candidates.where("_n > 1").groupBy("_key").agg(*[F.first(c).alias(c) for c in own[1:]])
    texts = candidates.where("_n = 1").select(*own).unionByName(materialize(equal, "equal-texts"))

    def surroundings(b: pd.DataFrame, cold: bool = True, hot: bool = True) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
        data = [t.encode("utf-8", "surrogatepass") for t in b["_text"]]
        marks = [np.concatenate((m[m >= 0] if cold else m[:0], -1 - m[m < 0] if hot else m[:0])) for m in map(np.asarray, b["_at"])]
        for i, c, s0, s1 in anchors(data, length, window):
            d, own = data[i], np.flatnonzero(np.isin(c, marks[i]))
            for a, first, last in zip(c[own].tolist(), s0[own].tolist(), s1[own].tolist(), strict=True):
                core, left, right = d[a : a + core_bytes], d[first:a], d[a + core_bytes : last + length]
                yield i, a, xxhash.xxh3_128_digest(core), left, right, xxhash.xxh3_128_digest(b"%d %d " % (len(left), len(right)) + left + core + right)

    def around(batches, hot=False):
        for b in slices(batches):
            n = b["_n"].tolist()
            yield pd.DataFrame([(*x[2:], n[x[0]]) for x in surroundings(b, not hot, hot)], columns=["core", "left", "right", "whole", "n"])

    def places(batches):
        for b in slices(batches):
            found = [(x[5], x[0], x[1]) for x in surroundings(b)]
            yield pd.DataFrame({"whole": [x[0] for x in found], "_of": b["_key"].to_numpy()[np.array([x[1] for x in found], np.int64)], "at": np.array([x[2] for x in found], np.int64)})

    sides = "core binary, left binary, right binary, whole binary, n long"
    same_sides = ["core", "left", "right", "whole"]
    members = texts.select("_text", "_at", "_n").mapInPandas(around, sides)
    members = members.groupBy(*same_sides).agg(F.sum("n").alias("n")).withColumn("w", F.lit(window))
    crowd = texts.where("exists(_at, x -> x < 0)").select("_text", "_at", "_n").mapInPandas(lambda batches: around(batches, True), sides)
    crowd = materialize(crowd.groupBy(*same_sides).agg(F.sum("n").alias("n")).withColumn("w", F.lit(window)), "crowd")

    def suffixes(batches):
        """Rows sorted by width and core -> (whole, runs of repeated starts, from their distance to the anchor)."""
        done: list[tuple[bytes, list[int]]] = []
        pool: list[tuple[int, bytes, bytes]] = []
        names: list[bytes] = []
        group: list[tuple[bytes, bytes, bytes, int]] = []  # of one core, so far
        size, number = 0, 0

        def close() -> None:
            nonlocal size, number
            for left, right, whole, n in group if len(group) > 1 or group and group[0][3] > 1 else ():
                pool.extend([(number, left, right)] * min(n, 2))
                names.extend([whole, None][: min(n, 2)])
            size = len(pool)
            number += 1
            group.clear()

        def flush() -> pd.DataFrame:
            nonlocal size
            if pool:
                done.extend((w, runs) for w, runs in zip(names, repeated_runs(pool, width), strict=True) if w is not None and runs)
            out = pd.DataFrame(done, columns=["whole", "runs"])
            done.clear()
            pool.clear()
            names.clear()
            size = 0
            return out

        core, width = None, window
        for b in batches:
            for c, left, right, whole, n, w in zip(b["core"], b["left"], b["right"], b["whole"], b["n"], b["w"], strict=True):
                if c != core or w != width:
                    close()
                    core = c
                    if size >= together or len(done) >= 4 * together or w != width:
                        yield flush()
                        width = w
                group.append((left, right, whole, n))
        close()
        yield flush()

    def repeated_in(some: DataFrame) -> DataFrame:
        found = some.repartition("core").sortWithinPartitions("w", "core").mapInPandas(suffixes, "whole binary, runs array<int>")
        return found.where("size(runs) > 0")

    def halves(some: DataFrame) -> DataFrame:
        """Members of crowded cores -> those of the longer cores, with the `parent` and the distance to its anchor."""
        near = F.floor(F.col("w") / 2).cast("int")  # bytes that the left half takes into the core
        far = F.col("w") - near
        bytes_ = lambda c, at, n: F.substring(F.col(c), at, n)
        size = lambda c: F.octet_length(c)
        left = F.struct(
            F.unhex(F.md5(F.concat("core", F.lit(b"l"), bytes_("left", size("left") - near + 1, near)))).alias("core"),
            bytes_("left", F.lit(1), size("left") - near).alias("left"), bytes_("right", F.lit(1), far - 1).alias("right"), far.alias("w"), near.alias("shift"),
        )
        own = F.least(near - 1, size("left"))
        right = F.struct(
            F.unhex(F.md5(F.concat("core", F.lit(b"r"), bytes_("right", F.lit(1), far)))).alias("core"),
            bytes_("left", size("left") - own + 1, own).alias("left"), bytes_("right", far + 1, size("right")).alias("right"), near.alias("w"), F.lit(0).alias("shift"),
        )
        both = F.filter(F.array(F.when(size("left") >= near, left), F.when(size("right") >= far, right)), lambda x: x.isNotNull())
        out = some.select(F.col("whole").alias("parent"), "n", F.explode(both).alias("x")).select("parent", "n", "x.*")
        whole = F.unhex(F.md5(F.concat("core", F.encode(F.concat_ws(" ", size("left"), "w"), "UTF-8"), "left", "right")))
        return out.withColumn("whole", whole)

    # Level by level: parts that have become small enough go to suffix arrays, the others are split again.
    levels, steps = [repeated_in(members)], []
    while True:
        sizes = crowd.groupBy("core", "w").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).where(F.col("all") > 1)
        sized = crowd.join(sizes, ["core", "w"]).drop("all")
        few = repeated_in(sized.where(F.col("m") <= hot).drop("m"))
        levels = [levels[0].unionByName(few)] if not steps else [*levels, few]
        split = sized.where(F.col("m") > hot)
        if not split.limit(1).count():
            break
        children = materialize(halves(split.drop("m")), "halves")
        steps.append(children.select("parent", "shift", F.col("whole").alias("child")).distinct())
        crowd = materialize(children.groupBy(*same_sides, "w").agg(F.sum("n").alias("n")), "crowd")
    repeats = levels[-1]
    for level, step in zip(reversed(levels[:-1]), reversed(steps), strict=True):
        up = repeats.join(step, F.col("whole") == F.col("child")).select(F.col("parent").alias("whole"), F.transform("runs", lambda r: r - F.col("shift")).alias("runs"))
        repeats = level.unionByName(up)
    back = texts.select("_key", "_text", "_at").mapInPandas(places, "whole binary, _of binary, at long").join(repeats, "whole")
    spans = back.groupBy("_of").agg(F.collect_set(F.struct("at", "runs")).alias("_spans"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(texts, spans, strict=True):
            data = t.encode("utf-8", "surrogatepass")
            cover = np.zeros(len(data) + 1, np.int64)
            for x in found if found is not None else ():
                for lo, hi in zip(x["runs"][::2], x["runs"][1::2], strict=True):
                    cover[x["at"] + lo] += 1
                    cover[x["at"] + hi + length] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), len(ranges(gone)), hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=list(new))

    changed = candidates.join(spans, F.col("_key") == F.col("_of"), "left").withColumn("_x", cut("_text", "_spans")).select(*give(others), *[f"_x.{c}" for c in new])
    whole = F.encode("_text", "UTF-8")
    same = rows.join(marked.select("_of"), F.col("_key") == F.col("_of"), "left_anti")
    same = same.select(*give(others), F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), whole.alias("kept"))
    return changed.unionByName(same)
