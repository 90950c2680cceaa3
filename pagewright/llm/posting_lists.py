"""Approximate nearest neighbours by inner product: balanced posting lists around centroids.

Copies of a vector are one class, searched once, with as many of its rows as a result can show. Classes are lifted by one
component so that the largest inner product is the smallest distance. A bounded sample is halved again and again into
equal parts, whose means are the centroids; their neighbour graph is held in memory and broadcast. Walking it gives every
class the centroids near to it: the nearest, and, at boundaries, others almost as near (unless a chosen centroid is nearer
to them than the class is). Queries walk the same graph and read the lists whose distance is within a ratio of the nearest
one's; the ratio is set by the exact neighbours of a few queries. Lists are read in tasks of bounded size, scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import join_hot, materialize, small_batches
from pagewright.llm.ngram_join import grouped


def halved(points: np.ndarray, parts: int) -> np.ndarray:
    """Means of `parts` equally large parts: each set is split in two along the line between two of its own means."""
    out, open_ = [], [(np.arange(len(points)), parts)]
    while open_:
        members, k = open_.pop()
        if k <= 1 or len(members) <= 1:
            out.append(points[members].mean(axis=0))
            continue
        own = points[members]
        far = ((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()
        other = ((own - own[far]) ** 2).sum(axis=1).argmax()
        a, b = own[far], own[other]
        for _ in range(6):
            near = own @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = own[near].mean(axis=0), own[~near].mean(axis=0)
        left = k // 2
        order = np.argsort(own @ (a - b), kind="stable")
        cut = max(1, len(members) * left // k)
        open_ += [(members[order[:cut]], left), (members[order[cut:]], k - left)]
    return np.array(out)


class CentroidGraph:
    """Centroids and for each of them its nearest others, besides a few far ones, so that walks don't get stuck."""

    def __init__(self, centroids: np.ndarray, near: int = 24, far: int = 8):
        self.points = np.ascontiguousarray(centroids, np.float32)
        n = len(self.points)
        size = (self.points**2).sum(axis=1)
        near = min(near, n - 1)
        links = np.zeros((n, near), np.int32)
        for i in range(0, n, 512):
            d = size[None, :] - 2 * self.points[i : i + 512] @ self.points.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links[i : i + 512] = np.argpartition(d, near - 1, axis=1)[:, :near] if near else links[i : i + 512]
        rng = np.random.default_rng(11)
        self.links = np.concatenate([links, rng.integers(0, n, (n, far), np.int32)], axis=1)
        self.entries = rng.permutation(n)[: max(1, math.isqrt(n))]

    def walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of about the `width` centroids nearest to each row, nearest first; -1 and infinity
        where there are fewer. All rows walk together: in each step a row opens the neighbours of its few nearest
        centroids that aren't open yet, until all that it holds are."""
        n, k = len(x), len(self.points)
        x = x.astype(np.float32)
        width = min(width, k)
        number = np.full((n, width), -1, np.int32)
        far = np.full((n, width), np.inf, np.float32)
        open_ = np.ones((n, width), bool)
        seen = np.zeros((n, k), bool)
        rows = np.arange(n)
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        while len(rows):
            new = ~seen[rows[:, None], fresh]
            seen[rows[:, None], fresh] = True
            d = ((self.points[fresh] - x[rows, None, :]) ** 2).sum(axis=2)
            d[~new] = np.inf
            # A number given twice in one step is new twice: keep one.
            order = np.argsort(fresh, axis=1, kind="stable")
            ordered = np.take_along_axis(fresh, order, 1)
            twice = np.zeros(fresh.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            d[twice] = np.inf
            all_d, all_n = np.concatenate([far[rows], d], axis=1), np.concatenate([number[rows], fresh], axis=1)
            all_open = np.concatenate([open_[rows], np.ones(fresh.shape, bool)], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            far[rows], number[rows] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_n, best, 1)
            open_[rows] = np.take_along_axis(all_open, best, 1)
            waiting = open_[rows] & np.isfinite(far[rows])
            live = waiting.any(axis=1)
            rows, waiting = rows[live], waiting[live]
            if not len(rows):
                break
            first = np.argsort(~waiting, axis=1, kind="stable")[:, :4]
            real = np.take_along_axis(waiting, first, 1)
            first = np.where(real, first, first[:, :1])
            open_[rows[:, None], first] = False
            fresh = self.links[number[rows[:, None], first]].reshape(len(rows), -1)
        number[~np.isfinite(far)] = -1
        return number, far.astype(np.float64)


class Index:
    """What is broadcast: the graph, the largest norm, the lists' sizes and the ratio of distances."""

    def __init__(self, graph: CentroidGraph, kind: str, size: int, longest: float):
        self.graph, self.kind, self.size, self.longest = graph, kind, size, longest
        self.ratio, self.floor, self.own = 1.0, 0.0, np.zeros(len(graph.points), np.int64)

    def matrix(self, vectors: list[bytes]) -> np.ndarray:
        """Rows of `size` doubles; shorter vectors end in zeros."""
        width = np.dtype(self.kind).itemsize
        if all(len(v) == width * self.size for v in vectors):
            return np.frombuffer(b"".join(vectors), self.kind).reshape(-1, self.size).astype(np.float64)
        out = np.zeros((len(vectors), self.size))
        for i, v in enumerate(vectors):
            out[i, : len(v) // width] = np.frombuffer(v, self.kind)
        return out

    def lift(self, vectors: list[bytes]) -> np.ndarray:
        """Vectors of the table, in units of the longest, with the component that makes all equally long."""
        x = self.matrix(vectors) / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def aim(self, vectors: list[bytes]) -> np.ndarray:
        """Query vectors: of length 1, none of it in the added component."""
        x = self.matrix(vectors) / self.longest
        return np.concatenate([x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None], np.zeros((len(x), 1))], axis=1)

    def lists_of(self, x: np.ndarray, copies: int, closure: float) -> list[list[int]]:
        """Lists of each row of the table: the nearest centroid's, and those almost as near as it, unless a chosen centroid
        is nearer to them than the row."""
        number, far = self.graph.walk(x, 4 * copies)
        away, points = np.sqrt(far), self.graph.points
        out = []
        for own, d in zip(number, away, strict=True):
            near = own[(own >= 0) & (d <= closure * d[0])].tolist()
            chosen = near[:1]
            for c, r in zip(near[1:], d[1:].tolist(), strict=False):
                if len(chosen) < copies and (((points[chosen] - points[c]) ** 2).sum(axis=1) > r * r).all():
                    chosen.append(c)
            out.append(chosen)
        return out

    def near_lists(self, x: np.ndarray, least: int) -> list[list[int]]:
        """Lists of each query: all within the ratio of the nearest centroid's distance, and as many more as it takes until
        they own `least` classes. The walk is widened until it has passed the ratio: no number of lists is set."""
        out: list = [[] for _ in range(len(x))]
        rows, width = np.arange(len(x)), 64
        while len(rows):
            number, far = self.graph.walk(x[rows], width)
            away, own = np.sqrt(far), np.where(number >= 0, self.own[number], 0)
            before = own.cumsum(axis=1) - own
            take = (number >= 0) & ((away <= self.ratio * np.maximum(away[:, :1], self.floor)) | (before < least))
            done = ~take[:, -1] | (width >= len(self.graph.points))
            for i in np.flatnonzero(done):
                out[rows[i]] = number[i][take[i]].tolist()
            rows, width = rows[~done], 2 * width
        return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner product of each row of x with the row of y, always summed in the same order: copies score alike."""
    return (x * y).sum(axis=1)


def best_of(query: np.ndarray, rough: np.ndarray, vectors: np.ndarray, least: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k vectors with the largest inner product, ties by `least`. `rough` has the products as a
    matrix product gave them, -inf where a vector isn't asked: it tells which can be among the first, these are scored."""
    cut = np.partition(rough, -k)[-k] if len(rough) > k else -np.inf
    can = np.flatnonzero((rough >= cut - slack) & (rough > -np.inf))
    exact = products(vectors[can], query)
    order = np.lexsort((least[can], -exact))[:k]
    return can[order], exact[order]


def classes_of(vectors: DataFrame, key: str, column: str, k: int) -> tuple[DataFrame, DataFrame, str]:
    """(rows, classes, kind): rows is unit, id, same (the vector's hash); classes is same, vec, and members, the first k + 1
    rows by id; kind says how a vec is stored. Vectors that take no part are in neither."""
    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    given = vectors.select(F.col(key).cast("long").alias("id"), (F.col(column) if kind == "<f4" else F.col(column).cast("array<double>")).alias("values"))

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            x = None if v is None else np.asarray(v, kind) + np.dtype(kind).type(0)
            out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
        return pd.Series(out, dtype=object)

    held = given.select("id", packed("values").alias("vec")).where("vec IS NOT NULL")
    held = materialize(held.select(F.monotonically_increasing_id().alias("unit"), "id", F.unhex(F.md5("vec")).alias("same"), "vec"), "vectors")
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy(F.col("id").asc_nulls_last(), "unit"))).where(F.col("r") <= k + 1)
    members = F.transform(F.array_sort(F.collect_list(F.struct("r", "id", "unit"))), lambda m: F.struct(m["id"].alias("id"), m["unit"].alias("unit")))
    return held, materialize(first.groupBy("same").agg(F.first("vec").alias("vec"), members.alias("members")), "classes"), kind


def fit(classes: DataFrame, kind: str, sample: int, posting: int, most_lists: int) -> Index | None:
    """Centroids from about `sample` classes (those of the least hashes), one for each `posting` classes up to `most_lists`.
    The sample is all of the table that the driver sees."""

    def norms(batches):
        best = 0.0
        for b in batches:
            for v in b["vec"]:
                best = max(best, float(np.sqrt((np.frombuffer(v, kind).astype(np.float64) ** 2).sum())))
        yield pd.DataFrame({"norm": [best]})

    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    if not size["n"]:
        return None
    drawn = classes.select("same", "vec")
    if size["n"] > sample:
        drawn = drawn.where(F.pmod(F.xxhash64("same"), F.lit(1 << 30)) < int((1 << 30) * sample / size["n"]))
    drawn = [bytes(r["vec"]) for r in drawn.orderBy("same").limit(sample).select("vec").collect()] or [bytes(classes.first()["vec"])]
    longest = classes.select("vec").mapInPandas(norms, "norm double").agg(F.max("norm")).first()[0]
    width = size["bytes"] // np.dtype(kind).itemsize
    points = Index(CentroidGraph(np.zeros((1, width + 1))), kind, width, longest).lift(drawn)
    return Index(CentroidGraph(halved(points, min(math.ceil(size["n"] / posting), most_lists, len(drawn)))), kind, width, longest)


def post(classes: DataFrame, index: Index, copies: int, closure: float) -> DataFrame:
    """The classes with the lists that each is in, its own list first."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def lists(vecs: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(vecs), 1024):
            out += shared.value.lists_of(shared.value.lift(vecs.iloc[i : i + 1024].tolist()), copies, closure)
        return pd.Series(out, dtype=object)

    return materialize(classes.withColumn("lists", lists("vec")), "posted")


def exact_neighbours(classes: DataFrame, asked: list[tuple[bytes, bytes]], index: Index, k: int) -> list[tuple[int, bytes]]:
    """(place in `asked`, vector) of the k nearest other classes of a few query classes, found by scoring every class."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((index, asked))

    def score(batches):
        own, few = shared.value
        q = own.matrix([v for _, v in few])
        best: list[list[tuple[float, bytes]]] = [[] for _ in few]
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                x, vecs, same = own.matrix(part["vec"].tolist()), part["vec"].tolist(), part["same"].tolist()
                rough = q @ x.T
                for n, row in enumerate(rough):
                    for j in np.argpartition(-row, min(k, len(row) - 1))[: k + 1]:
                        if same[j] != few[n][0]:
                            best[n].append((float(row[j]), vecs[j]))
                    best[n] = sorted(best[n], reverse=True)[:k]
        rows = [(n, s, v) for n, found in enumerate(best) for s, v in found]
        yield pd.DataFrame(rows, columns=["n", "s", "vec"])

    found = classes.select("same", "vec").mapInPandas(score, "n int, s double, vec binary")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("s"), "vec"))).where(F.col("r") <= k)
    return [(r["n"], bytes(r["vec"])) for r in found.select("n", "vec").collect()]


def calibrate(classes: DataFrame, asked: DataFrame, index: Index, copies: int, closure: float, k: int, recall: float, queries: int) -> None:
    """Set the ratio: at it, the share `recall` of the exact neighbours of about `queries` query classes is in a chosen list."""
    few = [(bytes(r["same"]), bytes(r["vec"])) for r in asked.orderBy(F.xxhash64("same")).limit(queries).collect()]
    found = exact_neighbours(classes, few, index, k) if few else []
    if not found:
        return
    aims, points = index.aim([v for _, v in few]), index.graph.points.astype(np.float64)
    away = np.sqrt(np.maximum(0.0, (aims**2).sum(axis=1)[:, None] - 2 * aims @ points.T + (points**2).sum(axis=1)))
    index.floor = float(np.median(away.min(axis=1))) / 20
    needed = []
    for i in range(0, len(found), 1024):
        part = found[i : i + 1024]
        for (n, _), lists in zip(part, index.lists_of(index.lift([v for _, v in part]), copies, closure), strict=True):
            needed.append(away[n, lists].min() / max(away[n].min(), index.floor))
    index.ratio = max(1.0, float(np.quantile(needed, recall, method="higher"))) + 1e-6


def shards(held: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each list, pieces of each shard): neighbouring lists share a shard while it holds up to `piece` classes; a
    longer list is a shard of its own, in several pieces."""
    shard, pieces, full = np.zeros(len(held), np.int64), [], piece + 1
    for i, n in enumerate(held.tolist()):
        if full + n > piece:
            pieces.append(max(1, math.ceil(n / piece)))
            full = 0
        full += n
        shard[i] = len(pieces) - 1
    return shard, np.array(pieces, np.int64)


def read_lists(posted: DataFrame, asked: DataFrame, index: Index, held: np.ndarray, k: int, piece: int, block: int) -> DataFrame:
    """same, best: for each query class the first k rows found in its lists, as (minus score, id is null, id, unit).

    A task has a piece of a shard of lists and a block of the queries that read any of them, so its size is bounded.
    """
    spark = posted.sparkSession
    shard, pieces = shards(held, piece)
    shared = spark.sparkContext.broadcast((index, shard, pieces))

    def dealt(same, vec, lists, members, blocks):
        """Rows of one class or query: by shard its lists there, each for the pieces and blocks that it must meet."""
        _, shard, pieces = shared.value
        by: dict[int, list[int]] = {}
        for one in lists:
            by.setdefault(int(shard[one]), []).append(int(one))
        at = int.from_bytes(same[:6], "big")
        for s, own in by.items():
            if blocks is None:
                yield from ((s, p, at, same, vec, own, None) for p in range(int(pieces[s])))
            else:
                yield from ((s, at % int(pieces[s]), b, same, vec, own, members) for b in range(blocks.get(s, 0)))

    columns = ["shard", "piece", "block", "same", "vec", "lists", "members"]
    schema = "shard int, piece int, block long, same binary, vec binary, lists array<int>, members array<struct<id: long, unit: long>>"

    def aim(batches):
        own = shared.value[0]
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                chosen = own.near_lists(own.aim(part["vec"].tolist()), 2 * k)
                yield pd.DataFrame([r for s, v, x in zip(part["same"], part["vec"], chosen, strict=True) for r in dealt(s, v, x, None, None)], columns=columns)

    readers = materialize(asked.mapInPandas(aim, schema), "readers")
    counts = {r["shard"]: r["n"] for r in readers.where("piece = 0").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    blocks = spark.sparkContext.broadcast({s: math.ceil(n / block) for s, n in counts.items()})

    def deal(batches):
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                rows = [r for s, v, x, m in zip(part["same"], part["vec"], part["lists"], part["members"], strict=True) for r in dealt(s, v, x, m, blocks.value)]
                yield pd.DataFrame(rows, columns=columns)

    def place(block_of: pd.Series, shard_of: pd.Series) -> pd.Series:
        n = np.array([blocks.value[s] for s in shard_of], np.int64)
        return pd.Series(block_of.to_numpy() % np.maximum(n, 1), dtype=np.int64)

    own_block = F.pandas_udf(place, "long")
    tiles = posted.select("same", "vec", "lists", "members").mapInPandas(deal, schema).unionByName(readers.withColumn("block", own_block("block", "shard")))

    def score(batches):
        own = shared.value[0]
        for g in grouped(batches, ["shard", "piece", "block"]):
            query = g["members"].isna().to_numpy()
            there, readers = g[~query], g[query]
            if not len(there) or not len(readers):
                continue
            x, q = own.matrix(there["vec"].tolist()), own.matrix(readers["vec"].tolist())
            rough = np.full((len(q), len(x)), -np.inf)
            asks: dict[int, list[int]] = {}
            has: dict[int, list[int]] = {}
            for into, table in ((asks, readers), (has, there)):
                for i, lists in enumerate(table["lists"]):
                    for one in lists:
                        into.setdefault(int(one), []).append(i)
            for one, places in has.items():
                if one in asks:
                    rough[np.ix_(asks[one], places)] = q[asks[one]] @ x[places].T
            members = there["members"].tolist()
            least = np.array([np.iinfo(np.int64).max if m[0]["id"] is None else m[0]["id"] for m in members], np.int64)
            size = np.sqrt((x * x).sum(axis=1)).max() * 1e-12
            rows = []
            for i, same in enumerate(readers["same"]):
                places, scores = best_of(q[i], rough[i], x, least, size * float(np.sqrt((q[i] * q[i]).sum())), k)
                found = [(-s, m["id"] is None, m["id"], m["unit"]) for p, s in zip(places.tolist(), scores.tolist(), strict=True) for m in members[p]]
                found.sort(key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
                rows += [(same, *f) for f in found[:k]]
            out = pd.DataFrame(rows, columns=["same", "minus", "unknown", "id", "unit"])
            yield out.astype({"id": "Int64"})

    keys = ["shard", "piece", "block"]
    found = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(score, "same binary, minus double, unknown boolean, id long, unit long")
    best = F.slice(F.array_sort(F.collect_set(F.struct("minus", "unknown", "id", "unit"))), 1, k)
    return materialize(found.groupBy("same").agg(best.alias("best")), "found")


def nearest_rows(
    vectors: DataFrame, key: str, column: str, every: int = 20, k: int = 20, recall: float = 0.95, sample: int = 65_536, posting: int = 256,
    most_lists: int = 16_384, copies: int = 4, closure: float = 1.15, calibrating: int = 256, piece: int = 4_096, block: int = 1_024,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by `every` its `k` nearest found.

    Every row but the query's own is a candidate; a row repeated is a row of its own. Nearness is the inner product in
    double precision, ties go to the smaller key, null keys last (they ask nothing). Vectors that are null, empty, all zero
    or hold a null or non-finite component take no part; shorter vectors count as ending in zeros. Keys are whole numbers.
    Fewer than `k` candidates are all returned; an empty table gives an empty table. The centroids come from about `sample`
    vectors; all vectors are indexed. Other columns don't matter.
    """
    small_batches(vectors.sparkSession)
    rows, classes, kind = classes_of(vectors, key, column, k)
    wanted = rows.where(F.col("id") % every == 0).select("unit", "id", "same")
    index = fit(classes, kind, sample, posting, most_lists)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = materialize(classes.join(wanted.select("same").distinct(), "same", "left_semi").select("same", "vec"), "asked")
    posted = post(classes, index, copies, closure)
    held = np.zeros(len(index.graph.points), np.int64)
    for r in posted.select(F.posexplode("lists").alias("at", "list")).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("own")).collect():
        held[r["list"]], index.own[r["list"]] = r["n"], r["own"]
    calibrate(classes, asked, index, copies, closure, k, recall, calibrating)
    found = read_lists(posted, asked, index, held, k + 1, piece, block)
    others = F.slice(F.filter("best", lambda r: r["unit"] != F.col("unit")), 1, k)
    told = join_hot(wanted, found, ["same"]).select(F.col("id").alias("query_id"), F.posexplode(others).alias("i", "x"))
    return told.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
