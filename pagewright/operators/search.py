"""Ranking: cosine scores, reciprocal rank fusion, candidate depth, caps, orders, and the whole library search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import cosine
from pagewright.operators import lexical

RRF, DEEPEST, CAP, TOP_K = 60, 1600, 3, 12
MOST_QUERY_BYTES = 128 << 20


def semantic_scores(queries: DataFrame, vectors: DataFrame, least: float | None = None) -> DataFrame:
    """query_id, chunk_id, doc, score: each query against each vector, as column expressions.

    `queries` (query_id, qv) is a batch that fits a broadcast: its rows are counted, and above 10,000 the join is left
    to Spark. `min_score` in `queries`, or `least`, is inclusive.
    """
    q = queries.select("query_id", "qv", *(["min_score"] if "min_score" in queries.columns else []))
    q = F.broadcast(q) if q.limit(10_001).count() <= 10_000 else q
    s = vectors.crossJoin(q).withColumn("score", F.round(cosine(F.col("qv"), F.col("vector")), 6))
    if "min_score" in queries.columns:
        s = s.where(F.col("score") >= F.col("min_score"))
    if least is not None:
        s = s.where(F.col("score") >= least)
    return s.select("query_id", "chunk_id", "doc", "score")


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """block, ids, least, matrix: the queries dealt by hash to so many blocks, each one row: ids, least scores and
    unit vectors as little-endian bytes."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(g["qv"].to_numpy()).astype("<f8")
        m = m / np.linalg.norm(m, axis=1, keepdims=True).clip(1e-300)
        row = (g["block"].iloc[0], g["query_id"].to_numpy("<i8").tobytes(), g["min_score"].to_numpy("<f8").tobytes(), m.tobytes())
        return pd.DataFrame([row], columns=["block", "ids", "least", "matrix"])

    dealt = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "qv", "min_score")
    return dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, least binary, matrix binary")


def vector_tiles(vectors: DataFrame, width: int, tile_bytes: int = 1 << 20) -> DataFrame:
    """chunk_ids, docs, vectors: the vectors of each partition in tiles of about `tile_bytes`, as unit vectors."""
    rows = max(1, min(2048, tile_bytes // (8 * max(1, width))))

    def pack(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                b = b.filter(pc.equal(pc.list_value_length(b.column("vector")), width))  # here, as a filter before would reckon derived vectors twice
                if not b.num_rows:
                    continue
                v = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows, -1)
                v = v / np.linalg.norm(v, axis=1, keepdims=True).clip(1e-300)
                one = lambda c, b=b: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c))
                yield pa.RecordBatch.from_arrays([one("chunk_id"), one("doc"), pa.array([v.tobytes()], pa.binary())], ["chunk_ids", "docs", "vectors"])

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    return vectors.select("chunk_id", F.col("doc").cast("long").alias("doc"), "vector").mapInArrow(pack, f"chunk_ids array<{kind}>, docs array<long>, vectors binary")


def kept_best(number: np.ndarray, score: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the best `depth` rows of each number, ties by id; the numbers that have as many; their last scores)."""
    order = np.lexsort((-score, number))
    n, s = number[order], score[order]
    start = np.flatnonzero(np.diff(n, prepend=-1))
    size = np.diff(start, append=len(n))
    full = size >= depth
    last = np.where(full, s[start + np.minimum(size, depth) - 1], -np.inf)
    floor = np.repeat(last, size)
    tied = np.flatnonzero((s == floor) & np.repeat(size > depth, size))
    keep = s >= floor
    if len(tied):  # of those at the floor, only the least ids find room
        above = np.add.reduceat(s > floor, start)
        keep[tied] = False
        tied = tied[np.argsort(ids[order[tied]], kind="stable")]
        tied = tied[np.argsort(n[tied], kind="stable")]
        first = np.flatnonzero(np.diff(n[tied], prepend=-1))
        place = np.arange(len(tied)) - np.repeat(first, np.diff(first, append=len(tied)))
        group = np.searchsorted(start, tied, "right") - 1
        keep[tied[place < depth - above[group]]] = True
    return order[keep], n[start[full]], last[full]


def semantic_top(queries: DataFrame, vectors: DataFrame, depth: int = DEEPEST, block: int = 1024, most_held: int = 2_000_000) -> DataFrame:
    """The best `depth` chunks of each query by matrix products: query_id, chunk_id, doc, score.

    Queries (query_id, qv, min_score) are packed into blocks of about `block`, vectors into tiles; one stage multiplies
    each tile by each block. The blocks are broadcast up to MOST_QUERY_BYTES, which are counted first; beyond, Spark pairs
    partitions of blocks and tiles. A task keeps what may still be among its best (all ties with them): once it holds
    `most_held` rows it drops the others, or, if few can go, hands them on, and remembers each query's floor. The
    ranking over tasks is the caller's window. Null vectors, and those of another width than the widest query, take no
    part.
    """
    asked = queries.where("qv is not null")
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("qv")), F.lit(0))).first()
    blocks = query_blocks(asked.where(F.size("qv") == width), max(1, -(-n // block)))
    blocks = F.broadcast(blocks) if n * (8 * width + 16) <= MOST_QUERY_BYTES else blocks

    def best(batches):
        floors, names = {}, {}  # by block: the least score that still counts, the queries
        held, size = [], 0  # (block, query's number in it, score, chunk_id, doc)

        def shrink():
            out = []
            for k in sorted({h[0] for h in held}):
                number, score, ids, docs = (np.concatenate(x) for x in zip(*[h[1:] for h in held if h[0] == k], strict=True))
                rows, full, last = kept_best(number, score, ids, depth)
                floors[k][full] = np.maximum(floors[k][full], last)
                out.append((k, number[rows], score[rows], ids[rows], docs[rows]))
            return out

        def give(rows):
            for k, number, score, ids, docs in rows:
                for i in range(0, len(number), 100_000):
                    at = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(names[k][number[at]]), pa.array(ids[at], pa.string()), pa.array(docs[at]), pa.array(score[at])], ["query_id", "chunk_id", "doc", "score"])

        for b in batches:
            for r in range(b.num_rows):
                k = b.column("block")[r].as_py()
                if k not in floors:
                    floors[k] = np.frombuffer(b.column("least")[r].as_py(), "<f8").copy()
                    names[k] = np.frombuffer(b.column("ids")[r].as_py(), "<i8")
                m = np.frombuffer(b.column("matrix")[r].as_buffer(), "<f8").reshape(len(names[k]), -1)
                v = np.frombuffer(b.column("vectors")[r].as_buffer(), "<f8").reshape(-1, m.shape[1])
                s = np.round(m @ v.T, 6)
                s[np.isnan(s)] = -np.inf
                if len(v) > depth:
                    floors[k] = np.maximum(floors[k], np.partition(s, -depth, axis=1)[:, -depth])
                q, c = np.nonzero(s >= floors[k][:, None])
                ids = b.column("chunk_ids")[r].values.take(pa.array(c)).to_numpy(zero_copy_only=False)
                docs = b.column("docs")[r].values.take(pa.array(c)).to_numpy(zero_copy_only=False)
                held.append((k, q, s[q, c], ids, docs))
                size += len(q)
                if size > most_held:
                    held = shrink()
                    size = sum(len(h[1]) for h in held)
                    if size > most_held // 2:
                        yield from give(held)
                        held, size = [], 0
        if held:
            yield from give(shrink())

    pairs = vector_tiles(vectors, width).crossJoin(blocks)
    return pairs.mapInArrow(best, "query_id long, chunk_id string, doc long, score double")


def semantic_pairs(queries: DataFrame, vectors: DataFrame, block: int = 1024) -> DataFrame:
    """query_id, chunk_id, doc, score: each query against each vector, as `semantic_scores` gives them, by matrix products.

    `min_score` in `queries` is inclusive; without it every pair is a row, a zero vector's with 0. The result is what it is
    asked for, a row for each pair, but nothing of it is held or shuffled: a task multiplies a tile of vectors by a block of
    queries and hands on what is left, a slice of the tile at a time. Null vectors, and those of another width than the
    widest query, take no part.
    """
    least = F.col("min_score") if "min_score" in queries.columns else F.lit(None).cast("double")
    asked = queries.select("query_id", "qv", F.coalesce(least, F.lit(float("-inf"))).alias("min_score")).where("qv is not null")
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("qv")), F.lit(0))).first()
    blocks = query_blocks(asked.where(F.size("qv") == width), max(1, -(-n // block)))
    blocks = F.broadcast(blocks) if n * (8 * width + 16) <= MOST_QUERY_BYTES else blocks
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def score(batches):
        for b in batches:
            for r in range(b.num_rows):
                names, low = np.frombuffer(b.column("ids")[r].as_py(), "<i8"), np.frombuffer(b.column("least")[r].as_py(), "<f8")
                m = np.frombuffer(b.column("matrix")[r].as_buffer(), "<f8").reshape(len(names), -1)
                v = np.frombuffer(b.column("vectors")[r].as_buffer(), "<f8").reshape(-1, m.shape[1])
                ids, docs = b.column("chunk_ids")[r].values, b.column("docs")[r].values
                for i in range(0, len(v), 128):
                    s = v[i : i + 128] @ m.T
                    c, q = np.nonzero(~(s < low - 1e-6))  # to the last digit below, once rounded
                    at = pa.array(c + i)
                    yield pa.RecordBatch.from_arrays([pa.array(names[q]), ids.take(at), docs.take(at), pa.array(s[c, q]), pa.array(low[q])], ["query_id", "chunk_id", "doc", "score", "low"])

    pairs = vector_tiles(vectors, width).crossJoin(blocks).mapInArrow(score, f"query_id long, chunk_id {kind}, doc long, score double, low double")
    return pairs.withColumn("score", F.round("score", 6)).where("score >= low").drop("low")


def top(scored: DataFrame, by: str, depth: int, descending: bool = True) -> DataFrame:
    """query_id, chunk_id, doc, place (from 1) and the score: the best `depth` of each query, ties by chunk_id."""
    first = F.col(by).desc() if descending else F.col(by).asc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(first, "chunk_id"))
    return scored.withColumn("place", place).where(F.col("place") <= depth)


def fuse(semantic: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, chunk_id, doc, score, semantic_score, matched_by: sums of 1 / (60 + place) over both rankings."""
    s = semantic.select("query_id", "chunk_id", "doc", F.col("place").alias("sp"), F.col("score").alias("semantic_score"))
    e = exact.select("query_id", "chunk_id", "doc", F.col("place").alias("ep"))
    both = s.join(e, ["query_id", "chunk_id", "doc"], "full_outer")
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    names = F.concat_ws(",", F.when(F.col("sp").isNotNull(), "semantic"), F.when(F.col("ep").isNotNull(), "exact"))
    return both.select("query_id", "chunk_id", "doc", F.round(share("sp") + share("ep"), 9).alias("score"), "semantic_score", names.alias("matched_by"))


def fused_order() -> list:
    agreement = F.when(F.col("matched_by").contains(","), 1).otherwise(0)
    return [F.col("score").desc(), agreement.desc(), F.col("semantic_score").desc_nulls_last(), F.col("chunk_id").asc()]


def top_fused(fused: DataFrame, k: int = TOP_K) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*fused_order()))
    return fused.withColumn("place", place).where(F.col("place") <= k)


def cap_per_document(fused: DataFrame, cap: int = CAP) -> DataFrame:
    """At most `cap` rows of a document for each query, in fused order; place is that among the rows kept."""
    n = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy(*fused_order()))
    kept = fused.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*fused_order())))


def first_depth(k: int) -> int:
    return min(400, max(50, 4 * k))


def depth_ladder(semantic: DataFrame, exact: DataFrame, k: int = TOP_K, cap: int | None = CAP, deepest: int = DEEPEST) -> DataFrame:
    """query_id, depth, chunk_id, doc, place, score, semantic_score, matched_by, candidates_truncated.

    Candidates are read to a depth that doubles while the answer is short and a ranking was full. All depths are
    levels of one table: both rankings (placed, to the deepest) are fused and capped at every level at once, and each
    query keeps the first level that satisfies it.
    """
    depths, d = [], first_depth(k)
    while True:
        depths.append(d)
        if d >= deepest:
            break
        d = min(deepest, d * 2)
    level = F.explode(F.array(*[F.lit(d) for d in depths]))
    s = semantic.withColumn("depth", level).where("place <= depth")
    e = exact.withColumn("depth", level).where("place <= depth")
    full = s.groupBy("query_id", "depth").agg(F.count(F.lit(1)).alias("n")).unionByName(e.groupBy("query_id", "depth").agg(F.count(F.lit(1)).alias("n")))
    full = full.groupBy("query_id", "depth").agg((F.max("n") >= F.col("depth")).alias("full"))
    s = s.select("query_id", "depth", "chunk_id", "doc", F.col("place").alias("sp"), F.col("score").alias("semantic_score"))
    e = e.select("query_id", "depth", "chunk_id", "doc", F.col("place").alias("ep"))
    both = s.join(e, ["query_id", "depth", "chunk_id", "doc"], "full_outer")
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    names = F.concat_ws(",", F.when(F.col("sp").isNotNull(), "semantic"), F.when(F.col("ep").isNotNull(), "exact"))
    fused = both.select("query_id", "depth", "chunk_id", "doc", F.round(share("sp") + share("ep"), 9).alias("score"), "semantic_score", names.alias("matched_by"))
    if cap is not None:
        n = F.row_number().over(Window.partitionBy("query_id", "depth", "doc").orderBy(*fused_order()))
        fused = fused.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")
    fused = fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "depth").orderBy(*fused_order()))).where(F.col("place") <= k)
    found = fused.groupBy("query_id", "depth").agg(F.count(F.lit(1)).alias("n"))
    enough = found.join(full, ["query_id", "depth"]).where((F.col("n") >= k) | ~F.col("full") | (F.col("depth") == depths[-1]))
    chosen = enough.groupBy("query_id").agg(F.min_by(F.struct("depth", "n", "full"), "depth").alias("x"))
    cut = (F.col("x.depth") == depths[-1]) & F.col("x.full") & (F.col("x.n") < k)
    chosen = chosen.select(F.col("query_id").alias("_q"), F.col("x.depth").alias("_d"), cut.alias("candidates_truncated"))
    return fused.join(chosen, (F.col("query_id") == F.col("_q")) & (F.col("depth") == F.col("_d"))).drop("_q", "_d")


def late_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Page and text of the kept candidates only, joined after ranking."""
    return hits.join(chunks.select("chunk_id", "page", "text"), "chunk_id")


def in_scope(chunks: DataFrame, vectors: DataFrame, profile: str, version: int, model: str, model_version: int, dims: int) -> DataFrame:
    """chunk_id, doc, vector of the chunks of a profile and version that have a vector of the model, its version and width."""
    own = vectors.where((F.col("model") == model) & (F.col("model_version") == model_version) & (F.col("dims") == dims))
    return chunks.where((F.col("profile") == profile) & (F.col("version") == version)).select("chunk_id", "doc").join(own.select("chunk_id", "vector"), "chunk_id")


def heading_inherited(headings: Column, page: Column) -> Column:
    """Does the nearest of a chunk's headings (title, page) stand on another page? One of unknown page claims nothing."""
    nearest = F.get(headings, F.size(headings) - 1)["page"]
    return F.coalesce(nearest != page, F.lit(False))


def library_documents(latest: DataFrame, discoverable: DataFrame, scoped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc of the documents that are searched, one row of counts): of the latest versions those that a grant covers, of
    these those with chunks under the active scope."""
    seen = discoverable.select("doc").distinct().withColumn("seen", F.lit(True))
    inside = scoped.select("doc").distinct().withColumn("inside", F.lit(True))
    d = latest.select("doc").join(seen, "doc", "left").join(inside, "doc", "left")
    counts = d.agg(F.count_if(F.col("seen") & F.col("inside")).alias("documents_searched"), F.count_if(F.col("seen").isNull()).alias("documents_not_discoverable"), F.count_if(F.col("seen") & F.col("inside").isNull()).alias("documents_outside_scope"))
    return d.where("seen and inside").select("doc"), counts


def library_search(plan: DataFrame, asked: DataFrame, words: DataFrame, lengths: DataFrame, vectors: DataFrame, searched: DataFrame, k: int = TOP_K, cap: int | None = CAP) -> DataFrame:
    """query_id, status, mode, depth, place, chunk_id, doc, score, semantic_score, matched_by, candidates_truncated of a
    batch of planned queries; a query without hits, or refused, has one row of nulls.

    Each query is ranked as its mode says: by meaning, by exact words, or by both fused. Both rankings cover the same
    chunks, those of the `searched` documents that have one of `vectors` (of the active scope); the statistics of words are
    those of the whole index. `cap` None is for searches in one document.
    """
    modes = plan.groupBy("query_id").agg(F.first("status").alias("status"), F.first("mode").alias("mode"))
    by_meaning = asked.join(modes.where("status = 'ok' and mode <> 'exact'"), "query_id", "left_semi")
    vectors = vectors.join(searched, "doc", "left_semi")
    meant = top(semantic_top(by_meaning, vectors), "score", DEEPEST)
    exact = lexical.bm25(words, plan, lengths, vectors)
    ladder = depth_ladder(meant, top(exact, "rank", DEEPEST, descending=False), k, cap)
    return modes.join(ladder, "query_id", "left").withColumn("candidates_truncated", F.coalesce("candidates_truncated", F.lit(False)))


def document_search(asked: DataFrame, exact: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, place, chunk_id, doc, score, semantic_score, matched_by: each query (query_id, doc, qv, min_score) in its
    one document, both rankings fused and not capped. `exact` ranks the queries in the whole index, so words weigh what
    they weigh there."""
    near = vectors.join(asked, "doc").withColumn("score", F.round(cosine(F.col("qv"), F.col("vector")), 6)).where("score >= min_score")
    inside = exact.join(asked.select("query_id", "doc"), ["query_id", "doc"], "left_semi")
    depth = first_depth(k)
    return top_fused(fuse(top(near.select("query_id", "chunk_id", "doc", "score"), "score", depth), top(inside, "rank", depth, descending=False)), k)


def reading_order(hits: DataFrame) -> DataFrame:
    """query_id, seq: hits of one document by page, then score."""
    order = Window.partitionBy("query_id", "doc").orderBy("page", F.col("score").desc(), "chunk_id")
    return hits.withColumn("seq", F.row_number().over(order))
