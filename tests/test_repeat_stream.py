"""The repeat filter as a stream: equal to the batch form over restarts, idle files, state that grows by a column."""

import sys
import time
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parents[1])]

from pulsegrid.operators import repeats  # noqa: E402
from pulsegrid.streaming.repeats import filter_stream  # noqa: E402

SCHEMA = "file string, event_key string, dus array<int>, times array<double>, end boolean, site string"
LISTED = "file string, event_key string, dus array<int>, times array<double>"


def made(n, seed, sources=2):
    """Events of two files, most of them random, some from one of a few fixed sources."""
    rng = np.random.default_rng(seed)
    fixed = rng.integers(0, 5000, (sources, 6))
    times = [fixed[i % sources] if i % 5 == 0 else rng.integers(0, 5000, 6) for i in range(n)]
    return [(f"f{i % 2}", f"{i:04d}", list(range(6)), [float(x) for x in t], False, f"s{i % 3}") for i, t in enumerate(times)]


class Source:
    """A folder of files, each of which is a micro-batch, read by streams that share a checkpoint."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.root / "in" / f"{self.n:03d}"))
        time.sleep(0.02)

    def start(self, trigger, **options):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.root / "in" / "*"))
        writer = filter_stream(stream, **options).writeStream.format("parquet").option("path", str(self.root / "out"))
        return writer.option("checkpointLocation", str(self.root / "state")).trigger(**trigger).start()

    def run(self, **options):
        q = self.start({"availableNow": True}, **options)
        assert q.awaitTermination(240)

    def kept(self, *cols, schema="file string, event_key string, site string"):
        return sorted(tuple(r) for r in self.spark.read.schema(schema).parquet(str(self.root / "out")).select("file", "event_key", *cols).collect())

    def state(self, name):
        return self.spark.read.format("statestore").option("path", str(self.root / "state")).option("stateVarName", name).load()


ENDS = [("f0", None, None, None, True, None), ("f1", None, None, None, True, None)]


@pytest.mark.parametrize("limits", [{}, {"buffer": 8, "history": 3}])
def test_restarts_equal_the_batch_form(spark, tmp_path, limits):
    rows = made(150, 31)
    source = Source(spark, tmp_path)
    for part in (rows[:40], rows[40:90]):
        source.add(part)
    source.run(**limits)
    # What waits is in the state: no more events a file than the buffer and the history hold.
    for name, most in (("live", limits.get("buffer", repeats.REPEAT_BUFFER)), ("gone", limits.get("history", repeats.REPEAT_HISTORY))):
        held = [r["count"] for r in source.state(name).groupBy("key").count().collect()]
        assert len(held) == 2 and max(held) <= most
    source.add(rows[90:])
    source.run(**limits)
    source.add(ENDS)
    source.run(**limits)
    batch = repeats.filter_listed(spark.createDataFrame([r[:4] for r in rows], LISTED), **limits)
    want = sorted(tuple(r) for r in batch.collect())
    assert source.kept() == want and 0 < len(want) < len(rows)
    assert source.state("live").count() == 0 and source.state("gone").count() == 0


def test_idle_files_are_flushed(spark, tmp_path):
    rows = made(40, 32)
    source = Source(spark, tmp_path)
    source.add(rows)
    q = source.start({"processingTime": "200 milliseconds"}, idle=1500)
    want = sorted(tuple(r) for r in repeats.filter_listed(spark.createDataFrame([r[:4] for r in rows], LISTED)).collect())
    try:
        until = time.time() + 120
        while time.time() < until and not (len(list((tmp_path / "out").glob("*.parquet"))) and source.kept() == want):
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    assert source.kept() == want


def test_a_restart_may_carry_more(spark, tmp_path):
    """Events of the buffer of before the restart have a null in the new column, later ones their value."""
    rows = made(60, 33)
    source = Source(spark, tmp_path)
    source.add(rows[:30])
    source.run()
    source.add(rows[30:])
    source.run(carry=["site"])
    source.add(ENDS)
    source.run(carry=["site"])
    site = {r[1]: r[5] if int(r[1]) >= 30 else None for r in rows}
    got = source.kept("site")
    want = repeats.filter_listed(spark.createDataFrame([r[:4] for r in rows], LISTED)).collect()
    assert sorted(g[:2] for g in got) == sorted(tuple(r) for r in want) and all(s == site[k] for _, k, s in got)
    assert {s for _, _, s in got} == {None, "s0", "s1", "s2"}


def test_odd_events(spark, tmp_path):
    """Null files, keys, hits and ends; a file that ended begins anew; repeated rows are repeats of each other."""
    dus, at = list(range(6)), [10.0, 400.0, 90.0, 7000.0, 30.0, 2000.0]
    source = Source(spark, tmp_path)
    source.add([(None, "a", dus, at, None, None), (None, None, None, None, False, None), ("f0", "b", [], [], None, None), ("f0", "c", [1, None], [5.0, 6.0], None, None)])
    source.add([("f1", "d", dus, at, False, "s"), ("f1", "d", dus, at, False, "s"), ("f1", "e", dus, at, True, "s")])
    source.add([("f1", "g", dus, at, False, "s")])
    source.add([(f, None, None, None, True, None) for f in (None, "f0", "f1")])
    source.run()
    got = source.spark.read.schema("file string, event_key string").parquet(str(tmp_path / "out")).collect()
    assert {(r.file, r.event_key) for r in got} == {(None, "a"), (None, None), ("f0", "b"), ("f0", "c"), ("f1", "g")} and len(got) == 5
