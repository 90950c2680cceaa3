"""Views of what is latest, on tables and on streams: open documents, suggestions, the stage of a document's preparation.

On a table the latest row of each item comes from an aggregate. On a stream it is kept as state, a map of items for each key;
each change of a key emits the key's whole view anew, with a number that grows, so the row with the largest number is the
view: whatever an earlier row said, that a window was the active one say, is taken back by it. Both ways the rows of a key
go through the same column expressions. Micro-batches in any order end in the same view.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Latest(StatefulProcessor):
    """The latest row, as text, of each item of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getMapState("latest", "item string", "ts long, seq long, row string")
        self._changes = handle.getValueState("changes", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple[int, int, str]] = {}
        for b in rows:
            for item, ts, seq, row in zip(b["item"], b["ts"], b["seq"], b["row"], strict=True):
                if item not in newest or newest[item][:2] < (ts, seq):
                    newest[item] = (int(ts), int(seq), row)
        changed = False
        for item, row in newest.items():
            if not self._rows.containsKey((item,)) or tuple(self._rows.getValue((item,)))[:2] < row[:2]:
                self._rows.updateValue((item,), row)
                changed = True
        if changed:
            n = (self._changes.get()[0] if self._changes.exists() else 0) + 1
            self._changes.update((n,))
            yield pd.DataFrame({"key": [key[0]], "change": [n], "rows": [[v[2] for _, v in self._rows.iterator()]]})

    def close(self) -> None:
        pass


def latest_on_stream(events: DataFrame, key: str, item: str, columns: list[str]) -> DataFrame:
    """key, change, rows: after each change all latest rows of the key, one for each item, by ts and seq. The session needs
    RocksDB as its state store. Items of a key are its state and its task: windows of a reader, suggestions of a document."""
    row = F.struct(*columns)
    schema = events.select(row.alias("r")).schema["r"].dataType
    e = events.select(F.col(key).cast("string").alias("key"), F.col(item).cast("string").alias("item"), micros(events).alias("ts"), F.col("seq").cast("long").alias("seq"), F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))
    made = e.groupBy("key").transformWithStateInPandas(_Latest(), "key string, change long, rows array<string>", "Update", "none")
    return made.select(F.col("key").cast(events.schema[key].dataType).alias(key), "change", F.transform("rows", lambda r: F.from_json(r, schema)).alias("rows"))


def latest_on_table(events: DataFrame, key: str, item: str, columns: list[str]) -> DataFrame:
    """key, rows: the same from a table."""
    last = events.groupBy(key, item).agg(F.max_by(F.struct(*columns), F.struct(micros(events), "seq")).alias("row"))
    return last.groupBy(key).agg(F.collect_list("row").alias("rows"))


def micros(events: DataFrame) -> Column:
    kind = events.schema["ts"].dataType.typeName()
    return F.unix_micros(F.col("ts").cast("timestamp")) if kind.startswith("timestamp") else F.col("ts").cast("long")


def current(changes: DataFrame, key: str) -> DataFrame:
    """The view: of each key the rows with the largest change number."""
    last = F.max("change").over(Window.partitionBy(key))
    return changes.withColumn("_last", last).where("change = _last").drop("_last", "change")


# --- open documents

SNAPSHOT = ["window", "focused", "readable", "active", "refs"]


def _open(rows: DataFrame, key: str, kept: list[str]) -> DataFrame:
    fine = F.filter("rows", lambda r: r["readable"])
    order = F.array_sort(F.transform(fine, lambda r: F.struct((-r["focused"]).alias("f"), (-r["window"]).alias("w"), r.alias("r"))))
    shown = lambda r, ref, first: F.struct(ref.alias("ref"), r["window"].alias("window"), ((first == 0) & r["active"].eqNullSafe(ref)).alias("active"), r["active"].eqNullSafe(ref).alias("active_in_window"))
    docs = F.flatten(F.transform(order, lambda x, i: F.transform(x["r"]["refs"], lambda ref: shown(x["r"], ref, i))))
    listed = F.concat(F.filter("docs", lambda d: d["active"]), F.filter("docs", lambda d: ~d["active"]))
    x = rows.select(*kept, docs.alias("docs"), F.size(fine).alias("windows"), (F.size("rows") - F.size(fine)).alias("unreadable_windows"))
    x = x.select(*kept, "windows", "unreadable_windows", F.posexplode_outer(listed).alias("i", "d"))
    return x.select(*kept, (F.col("i") + 1).alias("place"), "d.ref", "d.window", "d.active", "d.active_in_window", "windows", "unreadable_windows")


def open_documents(snapshots: DataFrame, reader: str = "reader") -> DataFrame:
    """reader, place, ref, window, active, active_in_window, windows, unreadable_windows: what a reader has open.

    Snapshots: reader, window, ts (when it had the focus), seq, readable, refs, active (one of refs, or null). The latest one
    of each window counts; one that can't be read is only counted. The window with the focus last (of equal ones the larger
    number) is in front, and what is active there is the active document; it comes first, the others by window and place.
    A reader with nothing open has one row without a ref.
    """
    return _open(latest_on_table(snapshots.withColumn("focused", micros(snapshots)), reader, "window", SNAPSHOT), reader, [reader])


def open_documents_stream(snapshots: DataFrame, reader: str = "reader") -> DataFrame:
    """The same from a stream, with `change`."""
    return _open(latest_on_stream(snapshots.withColumn("focused", micros(snapshots)), reader, "window", SNAPSHOT), reader, [reader, "change"])


# --- suggestions


def _pending(rows: DataFrame, kept: list[str]) -> DataFrame:
    return rows.select(*kept, F.size(F.filter("rows", lambda r: r["status"] == "pending")).cast("long").alias("pending"))


def suggestion_state(events: DataFrame) -> DataFrame:
    """doc, pending: suggestions whose latest decision (doc, suggestion, status, ts, seq) is still open."""
    s = events.groupBy("doc", "suggestion").agg(F.max_by("status", F.struct(micros(events), "seq")).alias("status"))
    return s.groupBy("doc").agg(F.count_if(F.col("status") == "pending").alias("pending"))


def suggestion_state_stream(events: DataFrame) -> DataFrame:
    """The same from a stream, with `change`."""
    return _pending(latest_on_stream(events, "doc", "suggestion", ["status"]), ["doc", "change"])


# --- preparation

LEAST_PERCENT = 4  # so that work that has begun is seen
STATE = ["source", "status", "current", "total", "within", "dismissed"]


def _badge(w: Column, i: Column) -> Column:
    """What is shown for the latest state of the window and of the index job."""
    known = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    percent = lambda done, total: F.least(F.lit(100), F.greatest(F.lit(LEAST_PERCENT), F.floor(done / total * 100 + 0.5))).cast("int")
    share = lambda s: F.when(known(s["current"]) & known(s["total"]) & (s["total"] > 0), percent(s["current"], s["total"]))
    within = F.when(known(w["within"]), F.least(F.lit(1.0), F.greatest(F.lit(0.0), w["within"]))).otherwise(0.0)
    done = F.least(w["total"].cast("double"), F.greatest(F.lit(0), w["current"] - 1) + within)
    window = F.when(w["current"].isNotNull() & (w["total"] > 0), percent(done, w["total"]))
    counted = lambda s, word, plain: F.when(s["current"].isNotNull() & (s["total"] > 0), F.concat(F.lit(word + " "), s["current"].cast("string"), F.lit("/"), s["total"].cast("string"))).otherwise(plain)
    none = F.lit(None).cast("int")
    badge = lambda stage, label, percent, source: F.struct(F.lit(stage).alias("stage"), (F.lit(label) if isinstance(label, str) else label).alias("label"), percent.alias("percent"), F.lit(source).alias("source"))
    cases = (
        (w["status"] == "error", badge("failed", "OCR failed", none, "document")), (i["status"] == "error", badge("failed", "Index failed", none, "index")),
        (w["status"] == "running", badge("ocr", counted(w, "OCR", "OCR running"), window, "document")), (i["status"] == "ocr", badge("ocr", counted(i, "OCR", "OCR running"), share(i), "index")),
        (w["status"] == "checking", badge("checking-text", "Checking text", none, "document")), (i["status"] == "downloading", badge("downloading", "Downloading model", share(i), "index")),
        (i["status"] == "indexing", badge("indexing", counted(i, "Index", "Indexing"), share(i), "index")), (i["status"] == "checking", badge("checking-index", "Checking index", none, "index")),
        ((w["status"] == "skipped") & ~F.coalesce(w["dismissed"], F.lit(False)), badge("native-text", "Native text detected", none, "document")),
    )
    shown = None
    for when, then in cases:
        shown = F.when(when, then) if shown is None else shown.when(when, then)
    return shown


def _stages(rows: DataFrame, kept: list[str]) -> DataFrame:
    of = lambda source: F.get(F.filter("rows", lambda r: r["source"] == source), F.lit(0))
    e = rows.select(*kept, of("document").alias("w"), of("index").alias("i"))
    return e.select(*kept, _badge(F.col("w"), F.col("i")).alias("b")).select(*kept, "b.stage", "b.label", "b.percent", "b.source")


def stage_rollup(events: DataFrame) -> DataFrame:
    """doc, stage, label, percent, source of the latest states of a document's window (source `document`) and of its index
    job (source `index`); one null stage where there is nothing to show.

    Events: doc, source, status, current, total (pages or chunks), within (share of the current page, of the window only),
    dismissed, ts, seq. In order: a failure of either, recognition in the window, then in the index job, checking the text,
    the model's download, indexing, checking the index, and the notice that a text needs no recognition, until dismissed.
    """
    return _stages(latest_on_table(events, "doc", "source", STATE), ["doc"])


def stage_rollup_stream(events: DataFrame) -> DataFrame:
    """The same from a stream, with `change`."""
    return _stages(latest_on_stream(events, "doc", "source", STATE), ["doc", "change"])


def run_stream(spark: SparkSession, path: str, schema, make, into: str) -> DataFrame:
    """Read a folder as a stream to its end, in a session of its own that has RocksDB, and write what `make` makes of it."""
    own = spark.newSession()
    own.conf.set(*ROCKS)
    changes = make(own.readStream.schema(schema).parquet(path))
    written = changes.schema

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/changes/epoch={epoch}")  # a batch that is run again replaces its rows

    changes.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{into}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(written).parquet(f"{into}/changes").drop("epoch")
