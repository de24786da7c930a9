"""The coverage ledger against a loop, the stream against the batch, also when it goes on after a stop."""

from pyspark.sql import functions as F

from lodestone.streaming import ledger

SCHEMA = "case_id long, seq long, aspect string, status string, chunk_ids array<string>"
ROWS = [
    (1, 1, "Entry  point ", "partial", ["a", "a", "b"]), (1, 2, "ENTRY POINT", "covered", []), (1, 3, "flow", "covered", ["x", None, ""]), (1, 4, "flow", "nonsense", ["y"]), (1, 5, None, "covered", ["y"]), (1, 6, " ", "gap", None),
    (2, 9, "late", "covered", [f"c{k}" for k in range(12)]), (2, 7, "late", "gap", None), (2, 8, "Config", "gap", None), (None, 1, "flow", "gap", None), *[(3, k, f"aspect {k}", "partial", ["q"]) for k in range(12)],
]
REQUIRED = [(1, 1, "Flow"), (1, 2, "flow"), (1, 3, "Integration"), (2, 1, None), *[(4, k, f"r{k}") for k in range(9)]]


def state(rows):
    return sorted(((r.case_id, r.key, r.aspect, r.first_seq, r.last_seq, r.status, tuple(r.chunk_ids)) for r in rows.collect()), key=repr)


def test_folded(spark):
    got = state(ledger.folded(spark.createDataFrame(ROWS, SCHEMA).repartition(3)))
    assert got[:5] == sorted([(1, "entry point", "Entry point", 1, 2, "partial", ()), (1, "flow", "flow", 3, 3, "covered", ("x",)), (2, "config", "Config", 8, 8, "gap", ()), (2, "late", "late", 7, 9, "covered", tuple(f"c{k}" for k in range(8))), (3, "aspect 0", "aspect 0", 0, 0, "partial", ("q",))], key=repr)
    assert len(got) == 5 + 11 + 1
    assert ledger.folded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reconciled(spark):
    entries, required = ledger.folded(spark.createDataFrame(ROWS, SCHEMA)), spark.createDataFrame(REQUIRED, "case_id long, nth int, aspect string")
    of = lambda rows, case: [(r.aspect, r.status) for r in rows.filter(F.col("case_id") == case).orderBy("place").collect()]
    rows = ledger.reconciled(entries, required)
    assert of(rows, 1) == [("Flow", "covered"), ("Integration", "gap"), ("Entry point", "partial")]
    assert of(rows, 2) == [("late", "covered"), ("Config", "gap")]
    assert of(rows, 3) == [(f"aspect {k}", "partial") for k in range(10)] and of(rows, 4) == [(f"r{k}", "gap") for k in range(6)]
    only = ledger.reconciled(entries, required, required_only=True)
    assert of(only, 1) == [("Flow", "covered"), ("Integration", "gap")] and of(only, 3) == []
    assert len(of(ledger.reconciled(entries), 1)) == 2
    stable = {r.case_id: r.stable for r in ledger.complete_and_stable(rows, rows).collect()}
    assert stable == {None: False, 1: False, 2: False, 3: False, 4: False}
    done = spark.createDataFrame([(1, 1, "A", "covered", ["x", "y"]), (2, 1, "A", "covered", ["x"])], "case_id long, place int, aspect string, status string, chunk_ids array<string>")
    other = spark.createDataFrame([(1, 3, "a", "covered", ["y", "x"]), (2, 1, "A", "covered", ["z"])], done.schema)
    assert {r.case_id: r.stable for r in ledger.complete_and_stable(other, done).collect()} == {1: True, 2: False}


def test_stream_equals_batch(spark, tmp_path):
    frame, source, folder = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "in"), str(tmp_path / "out")
    frame.filter("seq % 2 = 0").repartition(3).write.parquet(source)
    assert state(ledger.stream_ledger(spark, source, frame.schema, folder)) == state(ledger.folded(frame.filter("seq % 2 = 0")))
    frame.filter("seq % 2 = 1").repartition(2).write.mode("append").parquet(source)
    assert state(ledger.stream_ledger(spark, source, frame.schema, folder)) == state(ledger.folded(frame))
    assert state(ledger.stream_ledger(spark, source, frame.schema, folder)) == state(ledger.folded(frame))  # nothing new
