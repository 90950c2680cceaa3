"""Views of what is latest: worked by hand on tables, and on streams in any order of their batches."""

import itertools

import pytest
from pyspark.sql import functions as F

from pagewright.streaming import views

SNAPSHOT = "reader long, window long, ts long, seq long, readable boolean, active string, refs array<string>"
SNAPSHOTS = [
    (1, 1, 10, 1, True, "a", ["a", "b"]), (1, 2, 20, 2, True, "d", ["c", "d"]), (1, 3, 5, 3, False, None, []), (1, 1, 30, 4, True, None, ["b", "e"]), (1, 2, 15, 5, True, "x", ["x"]),
    (2, 1, 10, 6, True, "a", ["a"]), (2, 2, 10, 7, True, "z", ["y", "z"]), (3, 1, 1, 8, True, "a", ["a"]), (3, 1, 2, 9, False, None, None), (4, 1, 1, 10, True, None, []),
]
OPEN = {
    (1, 1, "b", 1, False, False, 2, 1), (1, 2, "e", 1, False, False, 2, 1), (1, 3, "c", 2, False, False, 2, 1), (1, 4, "d", 2, False, True, 2, 1),
    (2, 1, "z", 2, True, True, 2, 0), (2, 2, "y", 2, False, False, 2, 0), (2, 3, "a", 1, False, True, 2, 0), (3, None, None, None, None, None, 0, 1), (4, None, None, None, None, None, 1, 0),
}


def test_open_documents_by_hand(spark):
    got = views.open_documents(spark.createDataFrame(SNAPSHOTS, SNAPSHOT)).collect()
    assert {tuple(r) for r in got} == OPEN and len(got) == len(OPEN)


@pytest.fixture
def streamed(spark, tmp_path):
    number = itertools.count()

    def run(batches, schema, make, key):
        at = f"{tmp_path}/{next(number)}"
        own = spark.newSession()
        own.conf.set(*views.ROCKS)
        for n, rows in enumerate(batches):  # each batch is a run of its own, from the state of the one before
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
            changes = views.run_stream(spark, f"{at}/in", spark.createDataFrame([], schema).schema, make, f"{at}/out")
        return views.current(changes, key), changes

    return run


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_open_documents_on_a_stream(spark, streamed, order):
    parts = [SNAPSHOTS[0:3] + SNAPSHOTS[7:8], SNAPSHOTS[3:6], SNAPSHOTS[6:7] + SNAPSHOTS[8:]]
    view, changes = streamed([parts[i] for i in order], SNAPSHOT, views.open_documents_stream, "reader")
    assert {tuple(r) for r in view.select("reader", "place", "ref", "window", "active", "active_in_window", "windows", "unreadable_windows").collect()} == OPEN
    if order == (0, 1, 2):  # the document that was active is taken back by the next change
        was = {(r["change"], r["ref"]) for r in changes.where("reader = 1 and active").collect()}
        assert was == {(1, "d")}


def test_suggestions_and_stages_on_a_stream(spark, streamed):
    decided = [(d, s, ("pending", "accepted", "rejected")[(d * s + t) % 3], t, t * 7 % 5) for d in range(4) for s in range(5) for t in range(3)]
    schema = "doc long, suggestion long, status string, ts long, seq long"
    view, _ = streamed([decided[20:40], decided[40:] + decided[:3], decided[:20]], schema, views.suggestion_state_stream, "doc")
    assert {tuple(r) for r in view.select("doc", "pending").collect()} == {tuple(r) for r in views.suggestion_state(spark.createDataFrame(decided, schema)).collect()}
    said = [(d, source, status, 1 + t, 8, None if t % 2 else 0.5, t == 5, t, 0) for d, source in itertools.product(range(6), ("document", "index")) for t, status in [((d * 3 + len(source) + k * 5) % 11, s) for k, s in enumerate(("running", "ocr", "checking", "skipped", "indexing", "error")[d % 3 :])]]
    schema = "doc long, source string, status string, current int, total int, within double, dismissed boolean, ts long, seq long"
    half = len(said) // 2
    view, _ = streamed([said[half:], said[:half]], schema, views.stage_rollup_stream, "doc")
    columns = ["doc", "stage", "label", "percent", "source"]
    assert {tuple(r) for r in view.select(*columns).collect()} == {tuple(r) for r in views.stage_rollup(spark.createDataFrame(said, schema)).select(*columns).collect()}
    assert view.where(F.col("stage").isNotNull()).count() > 2
