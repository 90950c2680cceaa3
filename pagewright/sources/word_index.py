"""The stored word index: postings and lengths of chunks, written once where the chunks are, and changed by what is added.

A replacement writes a generation beside those that are there: the postings of the new chunks, and the documents whose
rows in earlier generations no longer count. What stays is neither read nor written; a read leaves out what is gone. A
generation counts from the moment that its file in `commits` is there, the last step of a change, so a run that fails before
leaves the index as it was and can be repeated. An index that is small, or has many generations, is rewritten as one.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import tokens

FEW_WORDS = 1000  # as many are named in a filter of the scan; more are joined only
MOST_GONE = 1_000_000  # documents that are broadcast
SMALL, MOST_GENERATIONS = 32 << 20, 32  # bytes of an index that is rewritten with each change; generations of any
_HIT = ["chunk_id", "doc", "len", "positions"]


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _generations(spark: SparkSession, path: str) -> dict[int, int]:
    """The generations that count, each with the number of documents that it takes out of earlier ones. The first has
    the whole index as it was then."""
    live: dict[int, int] = {}
    for n in sorted(int(x) for x in _names(spark, f"{path}/commits") if x.isdigit()):
        at, fs = _fs(spark, f"{path}/commits/{n:09d}")
        with_text = fs.open(at)
        said = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_text, "UTF-8"))
        with_text.close()
        live = {n: 0} if said["whole"] else live | {n: said["gone"]}
    return live


def _next(spark: SparkSession, path: str) -> int:
    """A number that no generation has, nor one that was begun and not finished."""
    used = [int(x.removeprefix("gen=")) for name in ("index", "gone", "commits") for x in _names(spark, f"{path}/{name}") if x.removeprefix("gen=").isdigit()]
    return max(used, default=-1) + 1


def _commit(spark: SparkSession, path: str, n: int, whole: bool, gone: int) -> None:
    at, fs = _fs(spark, f"{path}/commits/{n:09d}")
    out = fs.create(at, False)  # fails if another writer had the number
    out.write(bytearray(json.dumps({"whole": whole, "gone": gone}).encode()))
    out.close()


def _grouped(chunks: DataFrame) -> DataFrame:
    """token, hits (chunk_id, doc, len, positions): for each batch of chunks a row for each of its words, in order, and one of
    token null for all its chunks. Words are grouped where the chunks are; nothing is shuffled."""
    words = chunks.select("chunk_id", "doc", tokens(F.coalesce("text", F.lit(""))).alias("t"))

    def group(batches):
        for b in batches:
            offsets, words = b.column("t").offsets.to_numpy(), b.column("t").flatten().dictionary_encode()
            size = np.diff(offsets)
            row, n = np.repeat(np.arange(b.num_rows), size), len(words.dictionary)
            place = np.arange(len(row)) - (offsets[row] - offsets[0])
            rank = np.empty(n, np.int64)
            rank[pa.compute.sort_indices(words.dictionary).to_numpy()] = np.arange(n)
            key = rank[words.indices.to_numpy()] * b.num_rows + row
            order = np.argsort(key, kind="stable")  # places of a word stay in order
            start = np.flatnonzero(np.diff(key[order], prepend=-1))
            of, word = row[order[start]], words.indices.to_numpy()[order[start]]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            of = np.concatenate([np.arange(b.num_rows), of])  # all chunks come first, without places
            ends = np.concatenate([np.zeros(b.num_rows, np.int64), start, [len(order)]])
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            hit = pa.StructArray.from_arrays([b.column("chunk_id").take(pa.array(of)), b.column("doc").take(pa.array(of)), pa.array(size[of], pa.int32()), positions], _HIT)
            lists = pa.array(np.concatenate([[0], first + b.num_rows, [len(of)]]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.take(pa.array(word[first])).cast(pa.string())]), pa.ListArray.from_arrays(lists, hit)], ["token", "hits"])

    return words.mapInArrow(group, _schema(chunks))


def _regrouped(rows: DataFrame) -> DataFrame:
    """Rows as `_live` gives them, as `_grouped` stores them: neighbours of one word are one row again."""

    def group(batches):
        for b in batches:
            code = b.column("token").dictionary_encode().indices.fill_null(-1).to_numpy()
            first = np.flatnonzero(np.diff(code, prepend=-2))
            hit = pa.StructArray.from_arrays([b.column(n) for n in _HIT], _HIT)
            yield pa.RecordBatch.from_arrays([b.column("token").take(pa.array(first)), pa.ListArray.from_arrays(pa.array(np.append(first, b.num_rows), pa.int32()), hit)], ["token", "hits"])

    return rows.select("token", *_HIT).mapInArrow(group, _schema(rows))


def _schema(rows: DataFrame) -> T.StructType:
    own = [T.StructField(f.name, f.dataType) for f in rows.select("chunk_id", "doc").schema.fields]
    hit = T.StructType([*own, *T.StructType.fromDDL("len int, positions array<int>").fields])
    return T.StructType([T.StructField("token", T.StringType()), T.StructField("hits", T.ArrayType(hit))])


def _write(new: dict[str, DataFrame], kept: dict[str, DataFrame], path: str, buckets: int) -> None:
    """A generation that has the whole index: new and kept rows, those in at most as many files as `buckets` for each
    table. Earlier ones are deleted when it counts."""
    first, *more = [*new.values(), *(_regrouped(t).coalesce(buckets) for t in kept.values())]
    for t in more:
        first = first.unionByName(t)
    spark = first.sparkSession
    n = _next(spark, path)
    first.write.parquet(f"{path}/index/gen={n}")
    _commit(spark, path, n, True, 0)
    for name in ("index", "gone", "commits"):
        for x in _names(spark, f"{path}/{name}"):
            if x.removeprefix("gen=").isdigit() and int(x.removeprefix("gen=")) < n:
                at, fs = _fs(spark, f"{path}/{name}/{x}")
                fs.delete(at, True)


def write_index(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """A new index of chunks (chunk_id, doc, text) in an empty folder. Documents of null are one document."""
    _write({"index": _grouped(chunks)}, {}, path, buckets)


def replace_documents(path: str, docs: DataFrame, chunks: DataFrame | None = None, buckets: int = 64) -> None:
    """All chunks of the given documents (doc) go out of the index, and `chunks`, which must be of these documents, come
    in; without `chunks` the documents are forgotten. `buckets`: see `_write`. Of two writers at once one fails."""
    spark = docs.sparkSession
    docs = docs.select("doc").distinct().persist()
    try:
        n_gone = docs.count()
        if not n_gone:
            return
        live = _generations(spark, path)
        stored = 0
        for g in live:
            at, fs = _fs(spark, f"{path}/index/gen={g}")
            stored += fs.getContentSummary(at).getLength() if fs.exists(at) else 0
        new = {"index": _grouped(chunks)} if chunks is not None else {}
        if stored <= SMALL or len(live) >= MOST_GENERATIONS:
            gone = docs.select(F.col("doc").alias("_gone"))
            gone = F.broadcast(gone) if n_gone <= MOST_GONE else gone
            kept = {name: t.join(gone, F.col("doc").eqNullSafe(F.col("_gone")), "left_anti") for name, t in _tables(spark, path).items()}
            _write(new, kept, path, buckets)
            return
        n = _next(spark, path)
        for t in new.values():
            t.write.parquet(f"{path}/index/gen={n}")
        docs.write.parquet(f"{path}/gone/gen={n}")
        _commit(spark, path, n, False, n_gone)
    finally:
        docs.unpersist()


def _live(spark: SparkSession, path: str, cut) -> DataFrame:
    """token, chunk_id, doc, len, positions of the rows that count, of those tokens that `cut` is true of. Rows of a document
    that a later generation takes out are left out."""
    live = _generations(spark, path)
    folders = [f"{path}/index/gen={g}" for g in live if f"gen={g}" in _names(spark, f"{path}/index")]
    rows = spark.read.option("basePath", f"{path}/index").parquet(*folders).where(cut(F.col("token")))
    rows = rows.select(F.col("gen").alias("_gen"), "token", F.inline("hits")).where("chunk_id is not null")
    if later := [g for g, n in live.items() if n]:
        gone = spark.read.option("basePath", f"{path}/gone").parquet(*[f"{path}/gone/gen={g}" for g in later]).groupBy(F.col("doc").alias("_gone")).agg(F.max("gen").alias("_by"))
        gone = F.broadcast(gone) if sum(live.values()) <= MOST_GONE else gone
        rows = rows.join(gone, F.col("doc").eqNullSafe(F.col("_gone")) & (F.col("_gen") < F.col("_by")), "left_anti")
    return rows.drop("_gen")


def _tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"postings": _live(spark, path, lambda t: t.isNotNull()), "lengths": _live(spark, path, lambda t: t.isNull())}


def read_index(spark: SparkSession, path: str, plan: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths). With a query plan, postings of its words: a few are named in the scan's filter, so that no other
    word's rows are made."""
    asked = lambda t: t.isNotNull()
    if plan is not None:
        words = [r["token"] for r in plan.where("token is not null").select("token").distinct().limit(FEW_WORDS + 1).collect()]
        if len(words) <= FEW_WORDS:
            asked = lambda t: t.isin(words)
    index = _live(spark, path, asked).select("token", "chunk_id", "doc", "len", F.size("positions").alias("tf"), "positions")
    return index, _tables(spark, path)["lengths"].select("chunk_id", "doc", "len")
