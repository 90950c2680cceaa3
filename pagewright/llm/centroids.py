"""Centroid clustering in exact integers: Lloyd's rounds whose nearest centroid is found in a vantage-point tree.

Vectors become integers once and are written packed. Each round builds a vantage-point tree over the centroids, broadcasts
it, and every vector walks it best-first: the open node with the least lower bound comes next, and a node is left out only
if its bound lies beyond the best distance so far (nodes at exactly that distance are still visited, they may hold a
smaller number). Distances to vantage points are exact integers; only bounds are floating, with slack on the safe side.
What returns to the driver are sums by centroid and component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fields, give, hold, materialize, small_batches

#: Integers up to this size are handled in 64-bit arithmetic: 4096 squared differences of twice that stay below 2**63.
SAFE = 1 << 24
#: Slack of a floating lower bound, relative to the distances it comes from.
SLACK = 1e-9


class VantageTree:
    """Nodes in arrays: `pivot` is the number of the centroid at the node, `low` and `high` are its two children (-1:
    none), `span` the least and largest distance from the pivot to the points below each child."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.safe = all(abs(x) <= SAFE for c in centroids for x in c) and len(centroids[0] if centroids else []) <= 4096
        self.points = np.array(centroids, np.int64 if self.safe else object)
        self.pivot: list[int] = []
        self.child: list[list[int]] = []
        self.span: list[list[tuple[float, float]]] = []
        if centroids:
            self._grow(list(range(len(centroids))))

    def _grow(self, members: list[int]) -> int:
        """Add a node for `members`: the point farthest from their first is its pivot, the rest is halved by distance."""
        far = squared(self.points[members], self.points[members[0]])
        pivot = members[max(range(len(members)), key=lambda i: (far[i], -members[i]))]
        node = len(self.pivot)
        self.pivot.append(pivot)
        self.child.append([-1, -1])
        self.span.append([(0.0, 0.0), (0.0, 0.0)])
        rest = [m for m in members if m != pivot]
        if rest:
            apart = roots(squared(self.points[rest], self.points[pivot]))
            order = sorted(range(len(rest)), key=lambda i: (apart[i], rest[i]))
            half = (len(order) + 1) // 2
            for side, part in enumerate((order[:half], order[half:])):
                if part:
                    self.span[node][side] = (float(min(apart[i] for i in part)), float(max(apart[i] for i in part)))
                    self.child[node][side] = self._grow([rest[i] for i in part])
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row; of equally near ones the smaller number."""
        n, nodes = len(x), max(1, len(self.pivot))
        if not self.safe and x.dtype != object:
            x = x.astype(object)
        exact = np.int64 if x.dtype != object else object
        best, number = np.full(n, -1, exact), np.full(n, -1, np.int32)
        reach = np.full(n, np.inf)  # the best distance so far, as a float
        bound = np.full((n, nodes), np.inf)
        bound[:, 0] = 0.0
        live = np.arange(n)
        while len(live):
            node = bound[live].argmin(axis=1)
            least = bound[live, node]
            live, node = live[least <= reach[live]], node[least <= reach[live]]
            for at in np.unique(node):
                rows = live[node == at]
                bound[rows, at] = np.inf
                pivot = self.pivot[at]
                d = squared(x[rows], self.points[pivot])
                closer = (number[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (pivot < number[rows]))
                won = rows[closer]
                best[won], number[won] = d[closer], pivot
                away = roots(d)
                reach[won] = away[closer] * (1 + SLACK)
                for side in (0, 1):
                    below = self.child[at][side]
                    if below >= 0:
                        near, far = self.span[at][side]
                        gap = np.maximum(away - far, near - away) - SLACK * (away + far)
                        bound[rows, below] = np.maximum(gap, 0.0)
        return number, best


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to a point; 64-bit integers, or Python's where those are given."""
    apart = x - point
    return (apart * apart).sum(axis=1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) if d.dtype != object else np.array([math.sqrt(v) for v in d], np.float64)


def integers(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, exactly, for components too large for a 64-bit product."""
    return [math.floor(scale * v) if abs(v) < 2**40 else int(v) * scale for v in x.tolist()]


def pack(values: np.ndarray | list[int]) -> bytes:
    """The narrowest of 2, 4 or 8 bytes a component; larger integers as decimal text behind a blank."""
    for kind in ("<i2", "<i4", "<i8"):
        low, high = np.iinfo(kind).min, np.iinfo(kind).max
        if all(low <= int(v) <= high for v in (min(values), max(values))):
            return np.asarray(values, kind).tobytes()
    return (" " + ",".join(map(str, values))).encode()


def unpack(packed: list[bytes], size: int) -> np.ndarray:
    """Rows of 64-bit integers if all fit the safe range, else of Python integers."""
    widths = {len(p) for p in packed}
    kinds = {2 * size: "<i2", 4 * size: "<i4", 8 * size: "<i8"}
    if len(widths) == 1 and (kind := kinds.get(next(iter(widths)))) and not packed[0].startswith(b" "):
        x = np.frombuffer(b"".join(packed), kind).reshape(-1, size).astype(np.int64)
        if np.abs(x).max(initial=0) <= SAFE and size <= 4096:
            return x
        return x.astype(object)
    rows = [[int(v) for v in p[1:].split(b",")] if p[:1] == b" " and len(p) not in kinds else np.frombuffer(p, kinds[len(p)]).tolist() for p in packed]
    return np.array(rows, object) if any(abs(v) > SAFE for r in rows for v in r) or size > 4096 else np.array(rows, np.int64)


def as_integers(vectors: DataFrame, kept: list[str], key: str, column: str, size: int = 64, scale: int = 1024) -> DataFrame:
    """row (the kept columns), id, packed, in the shared folder: rows whose vector has `size` components, none null or not
    finite, as integers floor(scale * x)."""
    small_batches(vectors.sparkSession)
    held = hold(vectors, kept, F.col(key).alias("id"), F.col(column).cast("array<double>").alias("values"))

    @F.pandas_udf("binary")
    def convert(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            x = None if v is None else np.asarray(v, np.float64)
            if x is None or len(x) != size or not np.isfinite(x).all():
                out.append(None)
            elif np.abs(x).max() < 2**40:
                out.append(pack(np.floor(scale * x).astype(np.int64)))
            else:
                out.append(pack(integers(x, scale)))
        return pd.Series(out, dtype=object)

    return materialize(held.select("row", "id", convert("values").alias("packed")).where("packed IS NOT NULL"), "integers")


def starts(kept: DataFrame, clusters: int, seed: int, size: int) -> list[list[int]]:
    """The vectors with the least SHA-256 of `seed:id`; null ids come last, equal ids by their components."""
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "packed")
    rows = first.orderBy(F.col("h").asc_nulls_last(), "packed").limit(clusters).collect()
    return [[int(v) for v in unpack([bytes(r["packed"])], size)[0]] for r in rows]


def limbs(total: int) -> list[int]:
    """A sum as 32-bit digits, the last one signed: Spark adds up each place as a long."""
    out = []
    while not -(1 << 31) <= total < 1 << 31:
        out.append(total & 0xFFFFFFFF)
        total >>= 32
    return [*out, total]


def round_sums(kept: DataFrame, tree: VantageTree, size: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sum of each component of every non-empty cluster. Each task adds up what it reads; Spark adds
    up the tasks; the driver gets a row for each cluster and component."""
    shared = kept.sparkSession.sparkContext.broadcast(tree)

    def add(batches):
        total: dict[int, list[int]] = {}
        count: dict[int, int] = {}
        for b in batches:
            packed = b.column(0).to_pylist()
            for i in range(0, len(packed), 4096):
                x = unpack(packed[i : i + 4096], size)
                number, _ = shared.value.nearest(x)
                for k in np.unique(number).tolist():
                    own = x[number == k]
                    count[k] = count.get(k, 0) + len(own)
                    total[k] = [a + int(s) for a, s in zip(total.get(k, [0] * size), own.sum(axis=0), strict=True)]
        rows = [(k, -1, 0, n) for k, n in count.items()]
        rows += [(k, d, place, v) for k, t in total.items() for d, s in enumerate(t) for place, v in enumerate(limbs(s))]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dim", "place", "v"])

    summed = kept.select("packed").mapInArrow(add, "cluster int, dim int, place int, v long").groupBy("cluster", "dim", "place").agg(F.sum("v").alias("v"))
    out: dict[int, tuple[int, list[int]]] = {}
    rows = summed.collect()
    for r in rows:
        if r["dim"] < 0:
            out[r["cluster"]] = (r["v"], [0] * size)
    for r in rows:
        if r["dim"] >= 0:
            out[r["cluster"]][1][r["dim"]] += r["v"] << (32 * r["place"])
    shared.destroy()
    return out


def cluster_vectors(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3,
) -> DataFrame:
    """All columns of `vectors` but the vector, then cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows without a vector of `size` components, or with a null or non-finite one, are left out. The first centroids are the
    `clusters` vectors with the least SHA-256 of `seed:key` (fewer rows: fewer centroids; null keys last). Each round moves
    every centroid to the floored mean of its vectors; empty ones stay; of equally near centroids the smaller number
    counts, equal centroids included. Repeated rows are vectors of their own. Columns of the added names, in any case, are
    replaced. A distance or sum that is more than a long holds is null. An empty table gives an empty table.
    """
    own = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    kept = [c for c in fields(vectors, *own) if c != column]
    table = as_integers(vectors, kept, key, column, size, scale)
    centroids = starts(table, clusters, seed, size)
    for _ in range(rounds if centroids else 0):
        for k, (n, total) in round_sums(table, VantageTree(centroids), size).items():
            centroids[k] = [s // n for s in total]
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    @F.pandas_udf("cluster int, distance long, exact string")
    def nearest(packed: pd.Series) -> pd.DataFrame:
        numbers, distances = [np.zeros(0, np.int32)], []
        for i in range(0, len(packed), 4096):
            number, d = shared.value.nearest(unpack(packed.iloc[i : i + 4096].tolist(), size))
            numbers.append(number)
            distances.extend(int(v) for v in d)
        fit = pd.array([d if d < 1 << 63 else None for d in distances], "Int64")
        return pd.DataFrame({"cluster": np.concatenate(numbers), "distance": fit, "exact": [None if d < 1 << 63 else str(d) for d in distances]})

    near = materialize(table.select("row", nearest("packed").alias("x")), "assigned")
    wide = F.sum(F.col("x.distance").cast("decimal(38,0)"))
    sums = near.groupBy("x.cluster").agg(F.when(F.count("x.exact") == 0, wide).alias("s")).collect()
    whole = None if any(r["s"] is None for r in sums) else sum(int(r["s"]) for r in sums)
    long = lambda v: F.lit(int(v) if v is not None and v < 1 << 63 else None).cast("long")
    names = F.array(*[F.lit(d) for d in digests]) if digests else F.array(F.lit(""))
    inertia = {r["cluster"]: r["s"] for r in sums}
    by_cluster = F.array(*[long(inertia.get(k)) for k in range(len(centroids))]) if centroids else F.array(long(None))
    c = F.col("x.cluster")
    return near.select(
        *give(kept), c.alias("cluster"), F.col("x.distance").alias("distance"), F.get(by_cluster, c).alias("cluster_inertia"),
        long(whole).alias("inertia"), F.get(names, c).alias("centroid_sha256"),
    )
