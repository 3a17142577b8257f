"""Reading and writing: zones of time, damaged and invalid input, dated tables, streamed stages."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parents[1])]

from pulsegrid.functions import clock  # noqa: E402
from pulsegrid.operators import summaries  # noqa: E402
from pulsegrid.sources import records, sinks, tables  # noqa: E402
from pulsegrid.streaming import stages  # noqa: E402


@pytest.fixture(params=["UTC", "Asia/Tokyo", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_do_not_depend_on_the_zone(spark, zone):
    names = "window_start_utc string, window_end_utc string, DU_ID string, time_offset_add_ns string, x_offset_m string, y_offset_m string, z_offset_m string, ord int"
    # 02:30 of this day doesn't exist in New York.
    raw = [("2024-03-10 02:30:00", "2024-03-10 02:30:01.500000", "7", "1", "0", "0", "0", 1), ("2024-01-01T00:00:00", "2024-01-01T09:00:00+09:00", "8", "1", "0", "0", "0", 2), ("2024-01-01T00:00:00Z", "no time", "9", "1", "0", "0", "0", 3)]
    got = {r.du_id: (r.start_s, r.end_s) for r in tables.parse_calibration(spark.createDataFrame(raw, names)).collect()}
    assert got == {7: (1710037800, 1710037801), 8: (1704067200, 1704067200), 9: (1704067200, None)}
    events = spark.createDataFrame([("f", "1", 1710037800 + 18 - 28800)], "file string, event_key string, gps_time long")
    fits = events.select("file", "event_key", F.lit(60.0).alias("zenith"), F.lit(10.0).alias("azimuth"), F.lit(1.25).alias("chi_square"))
    assert [r.value for r in sinks.direction_lines(fits, events).collect()] == ["1710009018 2024-03-10 02:30:00 60.0 10.0 Chi 1.2"]
    at = spark.createDataFrame([("/a/20240310_023000/b", 5), ("/a/none", 5), ("/a/20249910_023000", 5)], "p string, event_number long")
    assert [r.gps_time for r in records.simulated_clock(at, F.col("p")).collect()] == [1710037805, clock.SYNTHETIC_START + 5, clock.SYNTHETIC_START + 5]
    one = at.limit(1).select(clock.event_time(F.array(F.lit(20240310), F.lit(23000))).cast("string").alias("t"), clock.file_second(F.lit("/d/x_20240310023000.y")).cast("string").alias("f")).first()
    assert (one.t, one.f) == ("2024-03-10 02:30:00", "2024-03-10 02:30:00")


def test_records_without_their_order_are_refused(spark):
    with pytest.raises(ValueError):
        records.keyed_events(spark.createDataFrame([("f", 1)], "file string, event_number long"))


def test_invalid_pair_rows_are_counted_and_kept_as_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text("du_b,du_a,note,distance_m,theoretical_delta_ns\n2,1,a,3.5,4.5\nx,1,b,3,4\n3,,c,1,1\n4,2,d,2,oops\n5,2,,2,7\n")
    pairs, bad, seen = tables.read_pairs_counted(spark, str(tmp_path / "p.csv"))
    assert sorted((r.du_a, r.du_b, r.distance_m, r.theoretical_delta_ns) for r in pairs.collect()) == [(1, 2, 3.5, 4.5), (2, 5, 2.0, 7.0)]
    assert seen.get == {"n_rows": 5, "n_invalid": 3}
    assert sorted((r.text, r.reason) for r in bad.collect()) == [("3,,c,1.0,1.0", "without du_a"), ("4,2,d,2,oops", "unreadable"), ("x,1,b,3,4", "unreadable")]
    (tmp_path / "q.csv").write_text("du_a,distance_m\n1,2\n")
    with pytest.raises(ValueError, match="du_b, theoretical_delta_ns"):
        tables.read_pairs_counted(spark, str(tmp_path / "q.csv"))


def test_damaged_files_are_reported_and_the_others_read(spark, tmp_path):
    for i in range(4):
        spark.range(i * 10, i * 10 + 5 * (i != 3)).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{i}"))
    broken = next((tmp_path / "in" / "d1").glob("*.parquet"))
    broken.write_bytes(broken.read_bytes()[:40])
    (tmp_path / "in" / "d2" / "more.parquet").write_bytes(b"PAR1 no more of it")
    rows, audit = tables.read_surviving(spark, str(tmp_path / "in"))
    assert sorted(r.id for r in rows.select("id").collect()) == [*range(5), *range(20, 25)]
    got = {r.path.split("/in/")[1].split("/")[0] + ("+" if "more" in r.path else ""): (r.status, r.n_rows) for r in audit.collect()}
    assert got == {"d0": ("read", 5), "d1": ("failed", 0), "d2": ("read", 5), "d2+": ("failed", 0), "d3": ("empty", 0)}
    assert {r.status: (r.n_files, r.n_failed) for r in summaries.batch_summary(audit).collect()} == {"read": (2, 0), "failed": (2, 2), "empty": (1, 0)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dated_events_are_pruned(spark, tmp_path):
    path, day = str(tmp_path / "events"), 86400
    events = spark.createDataFrame([(f"f{i % 3}", str(i), i * day // 4 + 18) for i in range(400)], "file string, event_key string, gps_time long")
    sinks.write_events(events, path)
    got = sinks.read_events(spark, path, "1970-01-11 06:00:00", "1970-01-12 00:00:00")
    assert sorted(int(r.event_key) for r in got.collect()) == [41, 42, 43, 44]
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(got).replace("\n", "") and len(got.inputFiles()) > 10
    read = got._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert 0 < read <= 16
    periods = spark.createDataFrame([(1, 10 * day + 18, 10 * day + 18 + day // 2), (2, 99 * day, 120 * day), (3, 5, 4)], "period_id int, start_s long, end_s long")
    found = sinks.events_of_periods(spark.read.parquet(path), periods.where("period_id < 9"))
    want = sorted((p, str(i)) for i in range(400) for p, a, b in ((1, 10 * day + 18, 10 * day + 18 + day // 2), (2, 99 * day, 120 * day)) if a <= i * day // 4 + 18 <= b)
    assert sorted((r.period_id, r.event_key) for r in found.collect()) == want and "dynamicpruning" in plan_of(found)


def test_a_batch_that_runs_twice_leaves_each_row_once(spark, tmp_path):
    """The second stage fails in the first attempt at a batch, after the first one was written; then the stream restarts."""
    source, calls = str(tmp_path / "in"), []
    spark.range(10).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)

    def doubled(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df.select((F.col("id") * 2).alias("twice"))

    def start():
        writer = sinks.stream_stages(stream(), {"all": lambda df: df, "doubled": doubled}, str(tmp_path / "out"), str(tmp_path / "state"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query

    start()
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        start()
    assert sinks.read_streamed(spark, str(tmp_path / "out" / "all")).count() == 20
    start()
    assert sorted(r.id for r in sinks.read_streamed(spark, str(tmp_path / "out" / "all")).collect()) == list(range(20))
    assert sorted(r.twice for r in sinks.read_streamed(spark, str(tmp_path / "out" / "doubled")).collect()) == list(range(0, 40, 2)) and len(calls) == 3


def test_large_layouts_are_joined(spark, monkeypatch):
    hit = "struct<hit_pos: int, du_id: int, time_ns: double, x: double, y: double, z: double>"
    rows = [("f", str(i), i, [(k + 1, 5000 * k - i % 2, float(k), None, None, None) for k in range(i % 4)]) for i in range(1, 20)]
    events = spark.createDataFrame(rows, f"file string, event_key string, gps_time long, hits array<{hit}>")
    layout = spark.createDataFrame([(d, d * 1.0, 2.0, 3.0) for d in range(-1, 9000, 5000)] + [(d, d * 1.0, 2.0, 3.0) for d in (0, 5000)], "du_id int, x double, y double, z double")
    key = lambda df: sorted((r.event_key, r.gps_time, [(h.hit_pos, h.du_id, h.x) for h in r.hits]) for r in df.where("size(hits) > 0").collect())
    small = key(stages.place_stream(events, layout))
    monkeypatch.setattr(stages, "BROADCAST_ROWS", 2)
    assert key(stages.place_stream(events, layout)) == small and 0 < len(small) < 14


def test_bucketed_stages_need_no_exchange(spark):
    """Aligning, re-attaching, grouping and semi-joining stage tables by event."""
    from pulsegrid.constants import EVENT
    from pulsegrid.operators.hits import align, attach, enough_detectors
    from pulsegrid.operators.planewave import moments
    from pulsegrid.plans.staging import Stages

    stages = Stages(spark)
    rows = [(f"f{i % 3}", str(i // 4), i % 4, i % 4, 1.0 * i, 1.0 * i, 2.0, 3.0) for i in range(400)]
    plain = spark.createDataFrame(rows, "file string, event_key string, hit_pos int, du_id int, time_ns double, x double, y double, z double")
    hits = stages.bucketed(plain, "hits")
    fields = [stages.bucketed(plain.groupBy(*EVENT).agg(F.max(c).alias(c)), c) for c in ("time_ns", "x")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = hits.select(*EVENT).distinct()
        for df in (align(keys, *fields), attach(fields[0], fields[1]), enough_detectors(hits, 2), moments(hits), hits.join(fields[0].select(*EVENT), EVENT, "left_anti")):
            assert "Exchange" not in plan_of(df)
        assert align(keys, *fields).count() == plain.select(*EVENT).distinct().count()
        assert sorted(moments(hits).collect()) == sorted(moments(plain).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert stages.bucketed(spark.range(3), "plain").count() == 3
