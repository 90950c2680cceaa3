"""Clusters, nearest neighbours and the source audit against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewright.llm import centroids, divergence, posting_lists
from pagewright.llm.common import join_hot, join_small


def vectors_of(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, extra string")


# --- centroid clustering -------------------------------------------------------------------------------------------


def lloyd(rows, clusters=8, rounds=10, size=64):
    kept = [(i, [int(math.floor(1024 * v)) if abs(v) < 1e12 else int(v) * 1024 for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    cents = [c for _, c in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[near(x)[1]].append(x)
        for k, own in of.items():
            cents[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    by = Counter()
    for _, k, d in out:
        by[k] += d
    return sorted((str(i), k, d, by[k], sum(by.values()), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, k, d in out)


def clustered(df, **how):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster_vectors(df, **how).collect())


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 0.1, 64) + (i % 5) * 0.2).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 380)]  # copies: ties between equal centroids
    rows += [(1000, None), (1001, [0.5] * 63), (1002, [float("nan")] * 64), (1003, [float("inf")] + [0.0] * 63), (1004, [None] + [0.0] * 63), (1005, [0.0] * 64), (7, rows[7][1]), (None, rows[9][1])]
    df = vectors_of(spark, [(i, x, "e") for i, x in rows])
    assert clustered(df) == lloyd(rows)
    assert centroids.cluster_vectors(df).columns[:2] == ["vec_id", "extra"]


def test_clusters_ties_huge_values_and_few_rows(spark):
    unit = lambda i, v: [v if d == i else 0.0 for d in range(64)]
    rows = [(i, unit(i % 3, float(i % 4))) for i in range(40)]
    assert clustered(vectors_of(spark, [(*r, "") for r in rows])) == lloyd(rows)
    few = [(1, unit(0, 1.0)), (2, unit(1, 1.0)), (3, unit(0, 1.0))]
    assert clustered(vectors_of(spark, [(*r, "") for r in few])) == lloyd(few)
    wide = [(i, unit(0, float(v))) for i, v in enumerate((2.0**20, 2.0**20 + 1, -(2.0**21), 3.0, 4.5, 2.0**17, 2.0**19, 0.0, -1.0, -(2.0**15)))]
    assert clustered(vectors_of(spark, [(*r, "") for r in wide], "array<double>")) == lloyd(wide)
    vast = [(i, unit(i % 64, (-1) ** i * 10.0 ** (i % 9 * 4))) for i in range(30)]
    got, want = clustered(vectors_of(spark, [(*r, "") for r in vast], "array<double>")), lloyd(vast)
    assert [(r[0], r[1], r[5]) for r in got] == [(r[0], r[1], r[5]) for r in want]
    assert all(g[2] == (w[2] if w[2] < 2**63 else None) for g, w in zip(got, want, strict=True))
    assert clustered(vectors_of(spark, [])) == []


def test_tree_finds_the_nearest_of_many_centroids():
    rng = np.random.default_rng(2)
    points = rng.integers(-900, 900, (150, 64))
    points[40] = points[3]
    tree = centroids.VantageTree(points.tolist())
    x = np.concatenate([rng.integers(-900, 900, (500, 64)), points])
    d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    number, best = tree.nearest(x)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    line = centroids.VantageTree([[v] + [0] * 63 for v in (0, 10, 20, 30, 10)])
    x = np.zeros((5, 64), np.int64)
    x[:, 0] = [5, 15, 25, 10, 40]
    assert line.nearest(x)[0].tolist() == [0, 1, 2, 1, 3]


def test_packed_integers_come_back():
    for values in ([-3, 2, 32767], [-40000, 0, 1], [2**40, -1, 0], [10**30, -(10**25), 7]):
        assert centroids.unpack([centroids.pack(values)], 3).tolist() == [values]
        assert sum(v << (32 * i) for i, v in enumerate(centroids.limbs(values[0]))) == values[0]
    mixed = centroids.unpack([centroids.pack([1, 2, 3]), centroids.pack([2**40, 0, 0])], 3)
    assert mixed.tolist() == [[1, 2, 3], [2**40, 0, 0]]


# --- nearest neighbours --------------------------------------------------------------------------------------------


def brute(rows, every=20, k=20):
    there = [(n, i, np.array(x, np.float64)) for n, (i, x) in enumerate(rows) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    size = max((len(x) for _, _, x in there), default=0)
    m = np.array([np.pad(x, (0, size - len(x))) for _, _, x in there]).reshape(len(there), size)
    out = []
    for a, (n, i, _) in enumerate(there):
        if i is None or i % every:
            continue
        s = (m * m[a]).sum(axis=1)
        best = sorted((-float(s[b]), j is None, j or 0) for b, (o, j, _) in enumerate(there) if o != n)[:k]
        out += [(i, r, None if u else j, -s) for r, (s, u, j) in enumerate(best, 1)]
    return out


def found(df, **how):
    return [(r.query_id, r.rank, r.vec_id, r.score) for r in posting_lists.nearest_rows(df, "vec_id", "embedding", **how).collect()]


def test_neighbours_of_few_rows_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(90)]
    rows += [(i, rows[40][1]) for i in range(200, 260)]  # copies of a query: more than are shown
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [None] + [1.0] * 7), (380, [1.0, -2.0]), (400, []), (None, rows[3][1]), (40, rows[40][1]), (420, [9.0] * 8)]
    df = vectors_of(spark, [(*r, "x") for r in rows])
    assert sorted(found(df), key=str) == sorted(brute(rows), key=str)
    assert sorted(found(df, piece=16, block=2), key=str) == sorted(brute(rows), key=str)
    few = rows[:15]
    got = found(vectors_of(spark, [(*r, "") for r in few]))
    assert sorted(got) == sorted(brute(few)) and len(got) == 14
    assert found(vectors_of(spark, [])) == [] and found(vectors_of(spark, [(0, [0.0], "")])) == []


@pytest.mark.parametrize("grown", [False, True])
def test_neighbours_recall_and_scores(spark, grown):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 32)) * 0.6
    x = centers[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 32)) * 0.5
    if grown:
        x *= rng.lognormal(0, 0.6, (6000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = found(vectors_of(spark, [(*r, "") for r in rows]), posting=64, piece=512, block=64), brute(rows)
    assert len(got) == len(want) == 6000
    have, exact = {(q, v): s for q, _, v, s in got}, {(q, v): s for q, _, v, s in want}
    assert len(have.keys() & exact.keys()) / len(exact) > 0.92
    m = np.array([r[1] for r in rows], np.float64)
    assert all(abs(s - float(m[q] @ m[v])) < 1e-9 for (q, v), s in have.items())
    per = defaultdict(list)
    for q, r, v, s in sorted(got):
        per[q].append((-s, v))
    assert all(p == sorted(p) for p in per.values())


def test_graph_walk_finds_what_a_scan_finds():
    rng = np.random.default_rng(6)
    points, x = rng.normal(size=(700, 16)), rng.normal(size=(200, 16))
    graph = posting_lists.CentroidGraph(points)
    number, far = graph.walk(x, 32)
    d = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    true = np.argsort(d, axis=1)[:, :10]
    assert np.mean([np.isin(t, n).mean() for t, n in zip(true, number, strict=True)]) > 0.97
    assert (np.diff(far, axis=1) >= 0).all() and all(len(set(n)) == len(n) for n in number.tolist())
    means = posting_lists.halved(x, 7)
    assert means.shape == (7, 16)


# --- source audit --------------------------------------------------------------------------------------------------


def audited(rows, least=10, top=10):
    docs = [((lang or ""), (source or ""), [bytes(w) for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().translate(bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))).split()]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, found_ in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found_, 1)]
    return sorted(out)


def test_audit_equals_plain_counts(spark):
    rnd = random.Random(5)
    words = ["Haus", "ÉTÉ", "été", "kilo", "Zug", "a1b", "naïve", "你好", "x" * 300, "semi-colon", "don't"] + [f"w{'abcdefgh'[i % 8]}{'ijkl'[i // 8]}" for i in range(30)]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(0, 40))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "S3", "é", None])) for _ in range(300)]
    rows += [("only once", "fr", "s1"), (None, "fr", "s2"), ("", "fr", None), ("123 !", "it", "s1")] + [("same words here", "es", f"p{i % 40}") for i in range(80)] + [(None, None, None)]
    df = spark.createDataFrame([(t, la, s, 1) for t, la, s in rows], "text string, lang string, source string, block int")
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit_sources(df).collect())
    assert got == audited(rows)
    low = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit_sources(df, least_docs=1, tile=2).collect())
    assert low == audited(rows, 1)
    assert divergence.audit_sources(df.limit(0)).collect() == []


def test_audit_of_several_blocks_and_small_memory(spark, monkeypatch):
    rows = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'s' * (j % 3)}" for i in range(j, j + 60)), "en", f"s{j % 5}") for j in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "BLOCK", 4)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit_sources(df).collect())
    assert got == audited(rows)
    few = divergence.count_terms(df, "text", "lang", "source", most=50)
    many = divergence.count_terms(df, "text", "lang", "source")
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_gallop_and_long_division():
    rnd = random.Random(8)
    for n, m in ((0, 5), (5, 0), (3, 100_000), (20_000, 50_000), (9_000, 9_000)):
        a, b = (np.array(sorted(rnd.sample(range(200_000), k)), np.int64) for k in (n, m))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    for count, size in ((0, 7), (10**12, 10**13), (8_999_999_999_999, 9_000_000_000_000), (3, 10**15)):
        assert int(divergence.share(np.array([count]), size)[0]) == 1 + 10**9 * (count + 2) // size


def test_joins_with_hot_keys(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k")
    single = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(49)], "k string, v int")
    want = sorted((r.id, r.v) for r in rows.join(single, "k").collect())
    assert sorted((r.id, r.v) for r in join_hot(rows, single, ["k"], bound=100).select("id", "v").collect()) == want
    assert sorted((r.id, r.v) for r in join_small(rows, single, ["k"], most=10, salts=4).select("id", "v").collect()) == want
