"""The event log's latest state over micro-batches."""

import os

from surveyloom.operators.events import latest_state
from surveyloom.streaming.event_state import current, follow

SCHEMA = "id long, seq long, kind string, value double"


def run(spark, source, out, check):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source / "*"))
    query = follow(events, str(out), str(check), "id", ["seq"], ["kind", "value"])
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return {r.id: (r.kind, r.value) for r in current(spark, str(out), "id", ["kind", "value"]).collect()}


def test_latest_state_over_batches(spark, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    write = lambda rows, name: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(source / name))
    write([(1, 1, "a", 1.0), (2, 2, "b", None)], "x")
    write([(1, 3, None, 5.0), (None, 4, "z", 1.0)], "y")
    assert run(spark, source, out, check) == {1: ("a", 5.0), 2: ("b", None)}
    # a later start goes on from the state; a late line does not win
    write([(2, 1, "old", 2.0), (3, 9, "c", None)], "z")
    assert run(spark, source, out, check) == {1: ("a", 5.0), 2: ("b", 2.0), 3: ("c", None)}


def test_state_is_read_at_its_own_size_and_a_batch_may_run_again(spark, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    rows = [(k % 5, k, f"k{k}" if k % 3 else None, float(k)) for k in range(400)]
    for part in range(8):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], SCHEMA).coalesce(1).write.json(str(source / f"p{part}"))
    got = run(spark, source, out, check)
    want = {r.id: (r.kind, r.value) for r in latest_state(spark.createDataFrame(rows, SCHEMA), "id", ["seq"], ["kind", "value"]).collect()}
    assert got == want
    versions = sorted(int(x[2:]) for x in os.listdir(out) if x.startswith("v="))
    assert len(versions) == 2 and spark.read.parquet(f"{out}/v={versions[-1]}").count() == 5
    # the last batch fails after its write and is run again
    last = max(int(x) for x in os.listdir(check / "commits") if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(check / "commits" / name):
            os.remove(check / "commits" / name)
    assert run(spark, source, out, check) == want
