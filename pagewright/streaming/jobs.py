"""Continuous ingest and views over logs: the same rules for tables and for streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagewright.functions.groups import fold_groups
from pagewright.functions.text import bow_vector
from pagewright.operators import chunking
from pagewright.sources import passages
from pagewright.sources.passages import Scope
from pagewright.sources.store import Store

GAP_MS = 500


def ingest(pages: DataFrame, store: Store, scope: Scope, cut: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Index the pages of a stream (content_hash, doc, page, markdown; the pages of a document in one batch) into a store.

    Each batch is one step of the store (see `add_documents`), so a batch that is run again after a failure changes nothing.
    A batch reads and writes only the buckets that its own documents and contents fall into.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        passages.add_documents(store, batch, scope, cut, epoch)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunked(profile: str = "balanced") -> Callable[[DataFrame], DataFrame]:
    """The chunk job and bag-of-words vectors, as `ingest` wants them."""

    def cut(pages: DataFrame) -> DataFrame:
        c = chunking.chunk_corpus(pages.select("doc", "page", "markdown"), profile)
        return c.select("doc", "chunk_id", "page", "idx", "text", F.to_json("headings").alias("heading_path"), bow_vector(F.col("embed_text")).alias("vector"))

    return cut


def page_stream(spark: SparkSession, path: str, lines: int = 5) -> DataFrame:
    """A stream over folders of the documents table, in pages of some lines: content_hash, doc, page, markdown."""
    d = spark.readStream.schema("doc_id long, text string").parquet(path).withColumn("l", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    d = d.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.col("doc_id").alias("doc"), "l", F.posexplode(F.sequence(F.lit(0), F.ceil(F.size("l") / lines).cast("int") - 1)).alias("p", "i"))
    return d.select("content_hash", "doc", (F.col("i") + 1).alias("page"), F.array_join(F.slice("l", F.col("i") * lines + 1, lines), "\n").alias("markdown"))


def throttled(rows: Iterable[tuple[int, float]], gap_ms: int, last: int | None, best: float) -> tuple[list[tuple[int, float]], int | None, float, tuple[int, float] | None]:
    """Of (ms, progress) in order, what is sent: the first, then at most one each gap; progress never falls back.
    An update without a number, or with one that isn't finite, counts one above the last. Also the state after it and the
    update that waits."""
    out, pending = [], None
    for ms, p in rows:
        best = max(best, p) if p is not None and math.isfinite(p) else best + 1
        if last is None or ms - last >= gap_ms:
            out.append((ms, best))
            last, pending = ms, None
        else:
            pending = (ms, best)
    return out, last, best, pending


def throttle_table(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """key, ms, progress of the updates that are sent for each key, the last always."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        out, _, _, pending = throttled([(r[1], r[3]) for r in rows], gap_ms, None, 0.0)
        return [(*key, ms, float(p)) for ms, p in ([*out, pending] if pending else out)]

    return fold_groups(events.select("key", "ms", "seq", "progress"), ["key"], ["ms", "seq"], fold, "key long, ms long, progress double")


def throttle_stream(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """The same on a stream: what was sent last, and the best progress, are the state of a key; what still waits is
    sent when the key has been silent for a gap of processing time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best, wait_ms, wait_p = state.get if state.exists else (None, 0.0, None, None)
        if state.hasTimedOut:
            state.remove()
            if wait_ms is not None:
                yield pd.DataFrame({"key": [key[0]], "ms": [wait_ms], "progress": [wait_p]})
            return
        g = pd.concat(list(frames)).sort_values(["ms", "seq"])
        out, last, best, pending = throttled(zip(g["ms"].tolist(), g["progress"].tolist(), strict=True), gap_ms, last, best)
        state.update((last, best, pending[0] if pending else None, pending[1] if pending else None))
        state.setTimeoutDuration(gap_ms)
        yield pd.DataFrame({"key": [key[0]] * len(out), "ms": [r[0] for r in out], "progress": [float(r[1]) for r in out]})

    return events.groupBy("key").applyInPandasWithState(run, "key long, ms long, progress double", "last long, best double, wait_ms long, wait_p double", "append", GroupStateTimeout.ProcessingTimeTimeout)
