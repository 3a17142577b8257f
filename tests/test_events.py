"""Operators on hand-made events: closed forms, boundaries, order, brute force."""

import itertools
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parents[1])]

from pulsegrid.constants import C_AIR  # noqa: E402
from pulsegrid.functions import amplitude, clock, geometry  # noqa: E402
from pulsegrid.functions.sphere import ENTRIES, least_on_sphere, solve  # noqa: E402
from pulsegrid.operators import calibration, causality, cuts, planewave, pointsource, repeats, summaries  # noqa: E402
from pulsegrid.operators.hits import consistent_events, resolve_positions, subtract_offsets, unplaced_events, within_radius  # noqa: E402
from pulsegrid.plans.queries import ORACLE, QUERIES, placed_hits  # noqa: E402
from pulsegrid.plans.reconstruct import PipelineConfig, reconstruct  # noqa: E402
from pulsegrid.sources import records, sinks, tables  # noqa: E402

HITS = "file string, event_key string, hit_pos int, du_id int, time_ns double, signal long, x double, y double, z double"


def wave(rng, n, direction=None, source=None, noise=0.0):
    p = np.c_[rng.uniform(-1500, 1500, (n, 2)), rng.uniform(0, 60, n)]
    t = p @ direction / C_AIR if source is None else np.linalg.norm(p - source, axis=1) / C_AIR
    return p, t + rng.normal(0, noise, n) if noise else t


def hit_rows(events):
    return [("f", k, i + 1, 100 + i, float(t), 5, *map(float, p)) for k, (ps, ts) in events.items() for i, (p, t) in enumerate(zip(ps, ts, strict=True))]


def directions(seed, n):
    rng = np.random.default_rng(seed)
    th, ph = np.radians(rng.uniform(20, 80, n)), rng.uniform(0, 2 * np.pi, n)
    return np.c_[np.sin(th) * np.cos(ph), np.sin(th) * np.sin(ph), np.cos(th)]


def test_plane_wave_is_recovered_and_invariant(spark):
    rng, want = np.random.default_rng(1), directions(2, 20)
    events = {str(i): wave(rng, 8, direction=d) for i, d in enumerate(want)}
    got = {r.event_key: r for r in planewave.fit(spark.createDataFrame(hit_rows(events), HITS)).collect()}
    for i, d in enumerate(want):
        r = got[str(i)]
        assert np.allclose([r.nx, r.ny, r.nz], d, atol=1e-5) and r.chi_square < 1e-4
        assert r.zenith == pytest.approx(math.degrees(math.acos(d[2])), abs=1e-3)
    moved = {k: (p[::-1], t[::-1] + 1e5) for k, (p, t) in events.items()}
    again = {r.event_key: r for r in planewave.fit(spark.createDataFrame(hit_rows(moved), HITS)).collect()}
    assert all(again[k].zenith == pytest.approx(got[k].zenith, abs=1e-3) for k in got)


def test_sphere_solver_is_never_above_a_dense_scan(spark):
    """On solid, nearly planar, planar (level and tilted), linear and three-point arrays; mirror solutions by the rule."""
    rng = np.random.default_rng(5)
    th, ph = np.meshgrid(np.radians(np.arange(0.5, 180, 1)), np.radians(np.arange(0, 360, 1)))
    grid = np.stack([np.sin(th) * np.cos(ph), np.sin(th) * np.sin(ph), np.cos(th)], -1).reshape(-1, 3)
    forms = []
    for kind in ("solid", "nearly", "level", "tilted", "line", "three"):
        p = rng.normal(0, 500, (20, 3 if kind == "three" else 7, 3)) * [1, 1, {"solid": 1.0, "nearly": 0.02}.get(kind, 0.0)]
        if kind == "tilted":
            p[:, :, 2] = 0.3 * p[:, :, 0] - 0.2 * p[:, :, 1]
        if kind == "line":
            p = p[:, :, :1] * np.array([0.6, 0.48, 0.64])
        t = np.einsum("bhk,bk->bh", p, directions(7, 20)) / C_AIR + rng.normal(0, 20, p.shape[:2])
        p, t = p - p.mean(1, keepdims=True), t - t.mean(1, keepdims=True)
        a, h = np.einsum("bhi,bhj->bij", p, p) / C_AIR**2, np.einsum("bhi,bh->bi", p, t) / C_AIR
        forms += [(kind, *x) for x in zip(a, h, strict=True)]
    rows = [(i, *map(float, (a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2], *h))) for i, (_, a, h) in enumerate(forms)] + [(len(forms), *[0.0] * 9)]
    entries = ("xx", "xy", "xz", "yy", "yz", "zz")
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{k} double" for k in (*entries, "a", "b", "c")))
    got = {r.i: np.array([r.nx, r.ny, r.nz], float) for r in least_on_sphere(df, {k: k for k in entries}, ["a", "b", "c"]).collect()}
    assert np.isnan(got.pop(len(forms))).all()
    for i, (kind, a, h) in enumerate(forms):
        value = lambda v: np.einsum("...i,ij,...j", v, a, v) - 2 * v @ h  # noqa: B023, E731
        every = value(grid)
        assert abs(np.linalg.norm(got[i]) - 1) < 1e-9 and value(got[i]) <= every.min() + 1e-6 * max(1, abs(every.min()))
        if kind == "level":
            assert got[i][2] >= 0
        if kind in ("tilted", "three"):
            normal = np.linalg.eigh(a)[1][:, 0]
            assert (got[i] - 2 * (got[i] @ normal) * normal)[2] <= got[i][2] + 1e-9
        if kind == "line":
            assert got[i][2] >= grid[every <= every.min() + 1e-4 * abs(every.min())][:, 2].max() - 0.05


def test_sphere_solver_takes_rows_in_batches_once(spark):
    """One Arrow step whatever is asked of its result; the rows of a batch don't touch each other."""
    rng = np.random.default_rng(11)
    p = rng.normal(0, 500, (60, 6, 3)) * np.repeat([[1, 1, 1.0], [1, 1, 0.02], [1, 1, 0]], 20, axis=0)[:, None]
    a, h = np.einsum("bhi,bhj->ijb", p, p), np.einsum("bhi,bh->ib", p, rng.normal(0, 500, (60, 6)))
    form = np.stack([a["xyz".index(k[0]), "xyz".index(k[1])] for k in ENTRIES])
    form[:, 7], h[:, 8], form[2, 9] = 0.0, np.nan, np.nan
    together = solve(form, h)
    alone = np.concatenate([solve(form[:, [i]], h[:, [i]]) for i in range(60)], axis=1)
    assert np.array_equal(together, alone, equal_nan=True)
    assert list(np.flatnonzero(np.isnan(together).any(0))) == [7, 8, 9]
    rows = [(None if v != v else float(v) for v in r) for r in np.concatenate([form, h]).T]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{k} double" for k in (*ENTRIES, "a", "b", "c")))
    found = least_on_sphere(df, {k: k for k in ENTRIES}, ["a", "b", "c"]).where("nx * nx + ny > 0.1 and nz > -0.5")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = {i: v for i, v in enumerate(together.T) if v[0] * v[0] + v[1] > 0.1 and v[2] > -0.5}
    got = {r.i: (r.nx, r.ny, r.nz) for r in found.collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_hits_are_dealt_to_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    """Many shuffle partitions are not merged into tasks of more rows; few are made more."""
    from pulsegrid.sources import fixtures

    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 500)
    line = fixtures.read(spark, sf_dir, "lineitem").count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("2", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            held = fixtures.raw_hits(spark, sf_dir).groupBy(F.spark_partition_id().alias("task")).count().collect()
            assert sum(r["count"] for r in held) == line and max(r["count"] for r in held) < 2 * 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["background_rejection_known", "selected_known_directions", "distribution_tables"])
def test_known_directions_are_not_joined(spark, sf_dir, name):
    """The direction follows from the key, so the hits are derived once for each use of the result."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition(file") <= (2 if name != "distribution_tables" else 4)


def test_cuts_of_hits_that_carry_their_direction(spark, sf_dir):
    """Arrival vectors in the hits give what joined fits give, and the hits are derived once."""
    from pulsegrid.plans.queries import arriving_hits, known_fits

    plan = QUERIES["combined_cuts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition(file") == 2
    hits = arriving_hits(spark, sf_dir).cache()
    fits = known_fits(hits).cache()
    rows = lambda df: {tuple(r[:2]): [round(v, 6) if isinstance(v, float) else v for v in r[2:]] for r in df.collect()}
    plain = hits.drop("vx", "vy", "vz")
    for cut in (cuts.ring, cuts.footprint, cuts.apply_cuts):
        assert rows(cut(hits)) == rows(cut(plain, fits))
    assert rows(cuts.apply_cuts(hits, None, False, False)) == rows(fits)
    hits.unpersist(), fits.unpersist()


def test_plane_chi_square_from_moments_is_that_of_pairs(spark):
    rng = np.random.default_rng(3)
    d = directions(4, 6)
    events = {str(i): wave(rng, 6, direction=v, noise=5) for i, v in enumerate(d)}
    hits = spark.createDataFrame(hit_rows(events), HITS)
    dirs = spark.createDataFrame([("f", str(i), *map(float, v)) for i, v in enumerate(d)], "file string, event_key string, nx double, ny double, nz double")
    pairs = {r.event_key: r.chi_square for r in planewave.pair_chi_square(hits, dirs).collect()}
    m = planewave.moments(hits).join(dirs, ["file", "event_key"])
    closed = m.select("event_key", planewave.chi_square(None, F.col("nx"), F.col("ny"), F.col("nz"), F.col("n")).alias("c"))
    assert all(r.c == pytest.approx(pairs[r.event_key], rel=1e-6) for r in closed.collect())
    fitted = {r.event_key: r.chi_square for r in planewave.fit(hits).collect()}
    assert all(fitted[k] <= pairs[k] * (1 + 1e-9) for k in pairs)


def test_seed_direction(spark):
    rng, d = np.random.default_rng(6), directions(8, 5)
    hits = spark.createDataFrame(hit_rows({str(i): wave(rng, 7, direction=v) for i, v in enumerate(d)}), HITS)
    for r in planewave.seed_direction(planewave.moments(hits)).collect():
        assert np.allclose([r.nx, r.ny, r.nz], d[int(r.event_key)], atol=1e-4)


def test_point_source_and_outlier_removal(spark, keep):
    rng, d = np.random.default_rng(9), directions(10, 8)
    events = {str(i): wave(rng, 9, source=v * rng.uniform(4e3, 2e4), noise=2) for i, v in enumerate(d)}
    truth = dict(events)
    for k in ("1", "2"):
        p, t = events[k]
        events[k] = (p, t + np.eye(9)[4] * 400)
    p, t = events["3"]
    events["3"] = (p, t + np.eye(9)[2] * 500 + np.eye(9)[6] * -450)
    hits = spark.createDataFrame(hit_rows(events), HITS)
    fits = keep(pointsource.fit(hits, planewave.fit(hits)), "fits")
    got = {r.event_key: r for r in fits.collect()}
    assert all(got[k].chi_square < 5 for k in truth if k not in "123") and all(got[k].chi_square > 10 for k in "123")
    done = {r.event_key: r for r in pointsource.remove_outliers(fits, keep).collect()}
    assert set(done) == set(events)
    assert list(done["1"].removed) == [104] and done["1"].chi_square < 10
    assert set(done["3"].removed) >= {102, 106} and len(done["3"].hits) + len(done["3"].removed) == 9
    assert list(done["0"].removed) == []
    at = spark.createDataFrame([("f", k, r.sx, r.sy, r.sz) for k, r in got.items()], "file string, event_key string, sx double, sy double, sz double")
    chi = {r.event_key: r.chi_square for r in pointsource.chi_square(hits, at).collect()}
    assert all(chi[k] == pytest.approx(got[k].chi_square, rel=1e-3, abs=1e-3) for k in chi)
    assert pointsource.fit_four(hits, planewave.fit(hits)).count() == 8 and pointsource.fit_penalised(hits, planewave.fit(hits)).count() == 8


def test_pairs_of_six_hits_need_no_confirmation(spark, keep):
    """Four hits that are left need no hit far off: six-hit events with two small shifts are pruned by the ratio alone."""
    rng, d = np.random.default_rng(19), directions(20, 12)
    events = {str(i): wave(rng, 6, source=v * 8e3, noise=9) for i, v in enumerate(d)}
    hits = spark.createDataFrame(hit_rows(events), HITS)
    fits = keep(pointsource.fit(hits, planewave.fit(hits)).withColumn("chi_square", F.lit(40.0)), "fits")
    found = pointsource._round(fits, 2)
    least = {r.event_key: r for r in found.collect()}
    assert set(least) == set(events) and all(len(r.hits) == 4 and r.chi_square < 32 for r in least.values())
    off = found.select("event_key", pointsource._confirmed().alias("far")).where("not far")
    assert off.count() > 0


def test_penalised_variant_removes_outliers(spark, keep):
    rng, v = np.random.default_rng(17), 299792458 / 1e9 / C_AIR
    az, zen = np.radians([40.0, 120.0, 200.0, 300.0, 3.0]), np.radians([50.0, 60.0, 45.0, 70.0, 55.0])
    d = np.c_[np.sin(zen) * np.cos(az), np.sin(zen) * np.sin(az), np.cos(zen)]
    events = {}
    for i, n in enumerate((8, 8, 9, 6, 8)):
        p, t = wave(rng, n, source=d[i] * 8e3)
        events[str(i)] = (p, t / v + rng.normal(0, 2, n) + (np.eye(n)[3] * 600 if i else 0))
    hits = spark.createDataFrame(hit_rows(events), HITS)
    fits = keep(pointsource.fit_penalised(hits, planewave.fit(hits)), "fits")
    done = {r.event_key: r for r in pointsource.remove_penalised(fits, keep).collect()}
    assert set(done) == set(events) and list(done["0"].removed) == []
    for k in "123":
        assert list(done[k].removed) == [103] and done[k].chi_square < 10
        assert math.cos(math.radians(done[k].phi) - az[int(k)]) > math.cos(math.radians(2.0))
    # Near azimuth 0 the refit counts its penalty: about 500 * 0.7^2 over 8 - 1 - 4 degrees of freedom at 3 degrees.
    assert 103 in done["4"].removed and done["4"].chi_square > 10


def test_edge_penalty_is_part_of_the_objective():
    rng = np.random.default_rng(18)
    u = np.c_[np.full(4, 1e-4), np.radians([40.0, 50.0, 60.0, 70.0]), np.radians([3.0, 357.0, 9.0, 90.0])]
    p, t, w = rng.uniform(-1000, 1000, (4, 6, 3)), rng.normal(0, 9, (4, 6)), np.ones((4, 6))
    at = lambda x: pointsource._with_edge(x, *pointsource._residuals(x, p, t, w, C_AIR), 5e2)
    r, j = at(u)
    assert np.allclose(r[:, -1] ** 2 / 36, 500 * np.array([0.7, 0.7, 0.1, 0.0]) ** 2)
    for k, h in enumerate((1e-9, 1e-6, 1e-6)):
        step = np.eye(3)[k] * h
        assert np.allclose((at(u + step)[0] - at(u - step)[0]) / (2 * h), j[:, :, k], rtol=1e-3, atol=1e-2 * np.abs(j[:, :, k]).max())
    th, ph = np.radians([50.0, 3.0])
    t = np.linalg.norm(p - 8e3 * np.array([np.sin(th) * np.cos(ph), np.sin(th) * np.sin(ph), np.cos(th)]), axis=2) / C_AIR
    t, start = t - t.mean(1, keepdims=True), np.tile([[8e3, 50.0, 3.0]], (4, 1))
    (free, none), (held, cost) = (pointsource.solve_sources(start, p, t, w, edge=e) for e in (0.0, 5e2))
    assert np.allclose(free[:, 2], 3.0, atol=1e-3) and (none < 1e-6).all() and (held[:, 2] > 3.0).all() and (cost > 1e-3).all()


def test_causality_boundaries(spark):
    rows = [(1.02 * 100 / C_AIR, 100.0), (1.0201 * 100 / C_AIR, 100.0), (5.0, 0.0)]
    got = spark.createDataFrame(rows, "dt double, d double").select(causality.causal(F.col("dt"), F.col("d")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, True]


def test_matching_modes_against_brute_force(spark, sf_dir):
    hits = placed_hits(spark, sf_dir)
    events = {}
    for r in hits.collect():
        events.setdefault(r.event_key, []).append(r)

    def apart(a, b):
        return math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) / C_AIR

    def clique(h):
        ok = lambda a, b: apart(a, b) == 0 or abs(a.time_ns - b.time_ns) / apart(a, b) <= 1.02
        order = sorted(h, key=lambda a: (-sum(ok(a, b) for b in h if b is not a), a.hit_pos))
        out = []
        for a in order:
            if all(ok(a, b) for b in out):
                out.append(a)
        return out

    def worst(h):
        h = sorted(h, key=lambda a: (a.time_ns, a.hit_pos))
        while len(h) >= 5:
            bad = [sum(abs(a.time_ns - b.time_ns) > apart(a, b) * 1.01 for b in h) for a in h]
            if not any(bad):
                break
            h.pop(bad.index(max(bad)))
        return h

    for operator, plain in ((causality.match_clique, clique), (causality.prune_worst, worst)):
        want = {k: {a.du_id for a in plain(h)} for k, h in events.items() if len(h) >= 5}
        got = {r.event_key: {h.du_id for h in r.matched} for r in operator(hits).collect()}
        assert got == {k: v for k, v in want.items() if len(v) >= 5}


def test_repeat_filter_forms_agree(spark):
    rng = np.random.default_rng(11)
    rows, clocks = [], []
    base = rng.integers(0, 5000, 6)
    for i in range(120):
        key = f"{i:04d}"
        times = base + rng.integers(-2, 3, 6) if i % 10 == 3 and i < 90 else rng.integers(0, 5000, 6)
        rows += [("f", key, j + 1, j, float(t), 1, 0.0, 0.0, 0.0) for j, t in enumerate(times)]
        clocks.append(("f", key, None if i == 5 else 1000 + i))
    hits, events = spark.createDataFrame(rows, HITS), spark.createDataFrame(clocks, "file string, event_key string, gps_time long")
    kept = {r.event_key for r in repeats.sequential_filter(events, hits).collect()}
    assert kept == {f"{i:04d}" for i in range(120) if not (i % 10 == 3 and i < 90)}
    assert {r.event_key for r in repeats.without_repeats(events, hits).collect()} == kept
    fold = repeats.RepeatFold(buffer=3)
    assert list(fold.push("a", {})) == [] and len(fold.live) == 1


def test_repeat_filter_reach(spark):
    """A repeat beyond the buffer stays, one just inside goes."""
    same = repeats.pairs_of(range(5), [0, 100, 250, 400, 900])
    for gap, stays in ((49, False), (51, True)):
        fold, kept = repeats.RepeatFold(), []
        for i, p in enumerate([same, *[repeats.pairs_of(range(5), np.random.default_rng(i).integers(0, 9999, 5)) for i in range(gap)], same]):
            kept += fold.push(str(i), p)
        kept += fold.flush()
        assert ("0" in kept) == stays


def test_chain_drops_what_the_history_knows(spark, keep):
    """A removed source that fires again beyond the buffer goes too: by default the chain runs the sequential filter."""
    rng, d = np.random.default_rng(15), directions(16, 90)
    p, t = wave(rng, 6, source=d[0] * 9e3)
    again = {0, 10, 85}
    times = {f"{i:04d}": (p, t if i in again else np.linalg.norm(p - d[i] * 9e3, axis=1) / C_AIR) for i in range(90)}
    hits = spark.createDataFrame(hit_rows(times), HITS)
    layout = hits.where("event_key = '0000'").select("du_id", "x", "y", "z")
    events = spark.createDataFrame([("f", k, 1000) for k in times], "file string, event_key string, gps_time long")
    config = PipelineConfig(skip_calibration=True, skip_matching=True, skip_footprint=True, skip_ring=True, remove_outliers=False)
    kept = reconstruct(hits.drop("x", "y", "z"), events, layout, config, keep)["kept"]
    assert {r.event_key for r in kept.select("event_key").distinct().collect()} == {f"{i:04d}" for i in range(90) if i not in again}


def test_sequential_filter_holds_no_file(spark):
    """The fold goes along batches: files that span several are whole, and files that share one don't mix."""
    import pandas as pd

    rng = np.random.default_rng(21)
    base = rng.integers(0, 5000, 6)
    rows = [(f"f{i % 3}", f"{i:04d}", list(range(6)), [float(x) for x in (base if i % 9 == 0 else rng.integers(0, 5000, 6))]) for i in range(240)]
    want = {(f, k) for f, k, _, _ in rows if int(k) % 9}
    frame = pd.DataFrame(sorted(rows[::-1], key=lambda r: r[:2]), columns=["file", "event_key", "dus", "times"])
    got = pd.concat(repeats.fold_sorted(frame[k : k + 7] for k in range(0, 240, 7)))
    assert sorted(map(tuple, got.values)) == sorted(want) and list(repeats.fold_sorted([]))[0].empty
    listed = spark.createDataFrame(rows, "file string, event_key string, dus array<int>, times array<double>")
    out = repeats.filter_listed(listed.repartition(5))
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


def test_stream_equals_batch(spark, tmp_path):
    from pulsegrid.streaming.repeats import filter_stream
    from pulsegrid.streaming.stages import scan_stream

    rng = np.random.default_rng(12)
    base = rng.integers(0, 5000, 6)
    rows = [(f"f{i % 2}", f"{i:04d}", list(range(6)), [float(x) for x in (base if i % 7 == 0 else rng.integers(0, 5000, 6))], False) for i in range(140)]
    schema = "file string, event_key string, dus array<int>, times array<double>, end boolean"
    for n, part in enumerate((rows[:70], rows[70:], [("f0", None, None, None, True), ("f1", None, None, None, True)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = filter_stream(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.file, r.event_key) for r in spark.table("kept").collect())
    batch = repeats.filter_listed(spark.createDataFrame([r[:4] for r in rows], "file string, event_key string, dus array<int>, times array<double>"))
    assert got == sorted((r.file, r.event_key) for r in batch.collect())
    d = directions(3, 4)
    hits = hit_rows({str(i): wave(rng, 6, direction=v) for i, v in enumerate(d)})
    packed = causality.gather(spark.createDataFrame(hits, HITS))
    want = {r.event_key: r.start for r in planewave.scan(planewave.moments(spark.createDataFrame(hits, HITS)), planewave.start_directions()).collect()}
    assert {r.event_key: r.start for r in scan_stream(packed).collect()} == want


def test_calibration_cases(spark):
    windows = spark.createDataFrame([(1, 0, 100), (2, 50, 200), (3, 1000, 1100)], "window_id long, start_s long, end_s long")
    seconds = [(10,), (75,), (150,), (599,), (601,), (None,)]
    got = spark.createDataFrame(seconds, "s long").withColumn("w", calibration.nearest_window(F.col("s"), windows)).collect()
    assert [r.w and (r.w.window_id, r.w.dist) for r in got] == [(1, 0), (1, 0), (2, 0), (2, 399), (3, 399), None]
    hits = spark.createDataFrame([("f", "1", 1, 7, 10.0, 1, 0.0, 0.0, 0.0), ("f", "1", 2, 8, 10.0, 1, 0.0, 0.0, 0.0), ("f", "2", 1, 7, 10.0, 1, 0.0, 0.0, 0.0)], HITS)
    events = spark.createDataFrame([("f", "1", 28), ("f", "2", None)], "file string, event_key string, gps_time long")
    table = spark.createDataFrame([(1, 7, 0.5, 1.0, 0.0, 0.0)], "window_id long, du_id int, dt_ns double, dx double, dy double, dz double")
    out = {(r.event_key, r.du_id): r.time_ns for r in calibration.calibrate_times(hits, events, windows, table).collect()}
    assert out == {("1", 7): 10.0, ("1", 8): 10.0, ("2", 7): 10.0}


def test_many_windows_are_joined(spark):
    """The join against the list: windows that overlap, share starts, hold no second, and gaps on both sides."""
    rng = np.random.default_rng(31)
    starts = rng.integers(0, 40, 60) * 50_000
    rows = [(i, int(s), int(s + rng.integers(0, 60_000))) for i, s in enumerate(starts)]
    windows = spark.createDataFrame(rows, "window_id long, start_s long, end_s long")
    seconds = [(str(i), int(s) if i else None) for i, s in enumerate(rng.integers(-300_000, 2_600_000, 500))] + [("e", rows[0][2]), ("s", rows[0][1])]
    events = spark.createDataFrame(seconds, "event_key string, s long")
    got = {r.event_key: (r.window_id, r.window_dist) for r in calibration.joined_windows(events, windows, F.col("s")).collect()}
    ordered = sorted(rows, key=lambda w: (w[1], w[0]))
    for k, s in seconds:
        dist = lambda w: max(w[1] - s, s - w[2], 0)
        best = s is not None and min(ordered, key=lambda w: (dist(w), w[1], w[0]))
        assert got[k] == ((best[0], dist(best)) if best else (None, None))


def test_sets_of_a_large_event_are_made_in_its_row(spark, keep):
    """An event of 299 hits with two outliers: its plan is small, and both hits go."""
    rng, d = np.random.default_rng(33), directions(34, 1)[0]
    p, t = wave(rng, 299, source=d * 9e3, noise=1)
    t[[7, 200]] += 40_000.0
    hits = spark.createDataFrame(hit_rows({"1": (p, t)}), HITS)
    assert pointsource.subsets(causality.gather(hits), 2).count() == 299 * 298 // 2
    plane = planewave.fit(hits)
    start = plane.select("file", "event_key", F.lit(float(np.degrees(np.arctan2(d[1], d[0])) % 360)).alias("azimuth"), F.lit(float(np.degrees(np.arccos(d[2])))).alias("zenith"))
    fits = keep(pointsource.fit(hits, start, fallback=float("inf")), "fits")
    out = pointsource.remove_outliers(fits, keep).first()
    assert sorted(out.removed) == [107, 300] and out.chi_square < 10 and len(out.hits) == 297
    # A pair at once: of 44,551 those are refitted that promise most.
    chosen = pointsource.promising_subsets(fits.select("file", "event_key", "chi_square", "seed_phi", "hits", "rho", "theta", "phi"), 2, 64, 1 - 1.2 * 0.7)
    assert 64 <= chosen.count() < 2000
    both = pointsource._round(fits, 2).first()
    assert sorted(h.du_id for h in both.gone) == [107, 300] and both.chi_square < 10


def test_gains_are_those_of_refits_without_the_hits():
    """A downdate gives what a linear refit of the others gives, for every hit and every pair."""
    rng = np.random.default_rng(44)
    p, t = wave(rng, 9, source=directions(45, 1)[0] * 8e3, noise=30)
    u = np.array([1 / 8e3, *np.radians([50.0, 20.0])])
    r, j = (x[0] for x in pointsource._residuals(u[None], p[None], (t - t.mean())[None], np.ones((1, 9)), C_AIR))
    # At the fit the residuals have no part along the derivatives.
    base = np.column_stack([j / np.linalg.norm(j, axis=0), np.ones(9)])
    t2 = t - t.mean() + base @ np.linalg.lstsq(base, r, rcond=None)[0]
    r = r - base @ np.linalg.lstsq(base, r, rcond=None)[0]
    for k, sets in ((1, [(i,) for i in range(9)]), (2, list(itertools.combinations(range(9), 2)))):
        numbers, out = pointsource.removal_gains(u, p, t2, k, 1000, 2.0)
        assert sorted(numbers.tolist()) == list(range(len(sets))) and all(tuple(o) == sets[i] for i, o in zip(numbers, out.tolist(), strict=True))
        want = []
        for s in sets:
            left = [i for i in range(9) if i not in s]
            rest = r[left] - base[left] @ np.linalg.lstsq(base[left], r[left], rcond=None)[0]
            want.append(float(r @ r - rest @ rest))
        for most in (3, 10):
            best, _ = pointsource.removal_gains(u, p, t2, k, most, 2.0)
            assert sorted(best.tolist()) == sorted(np.argsort([-w for w in want], kind="stable")[:most].tolist())


def test_promising_subsets_hold_the_best(spark, keep):
    """Events of 14 hits with two outlying ones: of 91 pairs the promising ones give the same removal as all."""
    events = {}
    for i, d in enumerate(directions(51, 6)):
        p, t = wave(np.random.default_rng(60 + i), 14, source=d * 9e3, noise=2)
        t[[2, 9]] += [300.0 + 50 * i, -250.0]
        events[str(i)] = (p, t)
    hits = spark.createDataFrame(hit_rows(events), HITS)
    fits = keep(pointsource.fit(hits, planewave.fit(hits)), "fits").where("fit_status = 'fitted'")
    key = lambda df: {r.event_key: (sorted(h.du_id for h in r.gone), round(r.chi_square, 4)) for r in df.collect()}
    some, every = key(pointsource._round(fits, 2)), key(pointsource._round(fits, 2, exhaustive=True))
    assert some == every and len(some) >= 4


def test_every_pair_is_refitted_whatever_the_fit_before(spark, keep):
    """At a fit far off the downdates point to other pairs than the best one, which is found all the same, in one block or many."""
    events = {}
    for i, d in enumerate(directions(51, 3)):
        p, t = wave(np.random.default_rng(60 + i), 14, source=d * 9e3, noise=2)
        t[[2, 9]] += [300.0 + 50 * i, -250.0]
        events[str(i)] = (p, t)
    hits = spark.createDataFrame(hit_rows(events), HITS)
    off = {"rho": F.lit(2.5e3), "theta": F.lit(80.0), "phi": F.col("phi") + 120.0}
    fits = keep(pointsource.fit(hits, planewave.fit(hits)).withColumns(off), "fits").where("fit_status = 'fitted'")
    key = lambda df: {r.event_key: (sorted(h.du_id for h in r.gone), round(r.chi_square, 6)) for r in df.collect()}
    assert key(pointsource._round(fits, 2)) == {k: ([102, 109], c) for k, (_, c) in key(pointsource._round(fits, 2, exhaustive=True)).items()} and fits.count() == 3


def test_rounds_in_the_batch_are_those_of_tables(spark, keep, monkeypatch):
    """Single hits and pairs, events of many sizes: in the batch, in blocks of few subsets, and with a row for each subset."""
    events = {}
    for i, d in enumerate(directions(71, 12)):
        rng, n = np.random.default_rng(80 + i), 5 + i % 9
        p, t = wave(rng, n, source=d * 9e3, noise=2)
        t[rng.choice(n, i % 3, replace=False)] += [400.0, -300.0][: i % 3]
        events[str(i)] = (p, t)
    hits = spark.createDataFrame(hit_rows(events), HITS)
    fits = keep(pointsource.fit(hits, planewave.fit(hits)), "fits")
    key = lambda df: {r.event_key: (sorted(r.removed), len(r.hits), pytest.approx(r.chi_square, rel=1e-6, abs=1e-6)) for r in df.collect()}
    batch = key(pointsource.remove_outliers(fits, keep))
    assert set(batch) == set(events) and any(x[0] for x in batch.values())
    assert batch == key(pointsource.remove_outliers(fits, lambda df, name: keep(df, f"plain-{name}"), exhaustive=True))
    monkeypatch.setattr(pointsource, "LARGE", 0)
    monkeypatch.setattr(pointsource, "BLOCK", 30)
    assert batch == key(pointsource.remove_outliers(fits, lambda df, name: keep(df, f"blocks-{name}")))
    for n, k in ((7, 1), (7, 2)):
        sets = list(itertools.combinations(range(n), k))
        out, stay = pointsource.sets_out(n, k, 2, len(sets))
        assert out.tolist() == [list(x) for x in sets[2:]] and stay.tolist() == [[i for i in range(n) if i not in x] for x in sets[2:]]


def test_stages_take_a_stream(spark, tmp_path):
    """Calibration, pairs, matching and fits of a stream equal those of the batch forms."""
    from pulsegrid.streaming import stages

    events = {f"{i}": wave(np.random.default_rng(i), 6, direction=v, noise=3) for i, v in enumerate(directions(41, 12))}
    rows = hit_rows(events)
    hits = spark.createDataFrame(rows, HITS)
    # All events share detectors, so the layout is that of the first one.
    layout = hits.where("event_key = '0'").select("du_id", "x", "y", "z")
    clock_rows = spark.createDataFrame([("f", k, 18 + 10 * int(k)) for k in events], "file string, event_key string, gps_time long")
    windows = spark.createDataFrame([(1, 0, 55), (2, 80, 90)], "window_id long, start_s long, end_s long")
    offsets = spark.createDataFrame([(w, 100 + i, w * 0.5 + i, 0.0, 0.0, 0.0) for w in (1, 2) for i in range(5)], "window_id long, du_id int, dt_ns double, dx double, dy double, dz double")
    at = resolve_positions(calibration.calibrate_times(hits, clock_rows, windows, offsets).select(*hits.columns), layout)
    causality.gather(hits).join(clock_rows, ["file", "event_key"]).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    ready = stages.place_stream(stages.calibrate_stream(source, windows, offsets), layout)
    key = lambda df, *c: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select("event_key", *c).collect())
    assert key(run(ready.select("event_key", F.explode("hits").alias("h")).select("event_key", "h.du_id", "h.time_ns", "h.x"), "ready"), "du_id", "time_ns", "x") == key(at, "du_id", "time_ns", "x")
    from pulsegrid.operators.pairs import hit_pairs

    pairs = hit_pairs(at).withColumn("causal", causality.causal(F.col("dt_ns"), F.col("distance_m")))
    assert key(run(stages.pair_stream(ready), "pairs"), "du_a", "du_b", "dt_ns", "distance_m", "causal") == key(pairs, "du_a", "du_b", "dt_ns", "distance_m", "causal")
    matched = causality.scatter(causality.match_clique(at), "matched")
    assert key(run(stages.match_stream(ready).select("event_key", F.explode("hits.du_id").alias("du_id")), "matched"), "du_id") == key(matched, "du_id")
    fits = key(run(stages.fit_stream(ready), "fits"), "n", "zenith")
    assert fits == key(planewave.fit(at), "n", "zenith") and len(fits) == 12


def test_geometry_and_clock(spark):
    one = spark.range(1)
    r = one.select(
        geometry.azimuth(F.lit(0.0), F.lit(-1.0)).alias("a"),
        geometry.incident_zenith(F.lit(0.0), F.lit(0.0), F.lit(-2.0)).alias("z"),
        geometry.incident_azimuth(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("none"),
        geometry.distance_limit(F.lit(75.0)).alias("l75"),
        geometry.distance_limit(F.lit(95.0)).alias("l95"),
        geometry.true_azimuth(F.lit(200.0)).alias("ta"),
        geometry.true_zenith(F.lit(100.0)).alias("tz"),
        clock.event_time(F.array(F.lit(20240102), F.lit(30405))).alias("t"),
        clock.time_in_path(F.lit("/a/20240102_030405/x_20249902_030405_1-2_")).alias("p"),
        clock.local_time(F.lit(18)).cast("string").alias("local"),
    ).first()
    assert (r.a, r.z, r.none, r.l75, r.l95, r.ta, r.tz) == (270.0, 0.0, None, 800.0, 5300.0, 20.0, 80.0)
    assert str(r.t) == str(r.p) == "2024-01-02 03:04:05" and r.local == "1970-01-01 08:00:00"


def test_amplitudes(spark):
    df = spark.createDataFrame([([1.0, -7.5, 3.0],), ([],), (None,)], "t array<double>")
    got = [tuple(r) for r in df.select(amplitude.peak(F.col("t"), 0, 3), amplitude.peak(F.col("t"), 2, 3), amplitude.peak(F.col("t"), 5, 9), amplitude.peak_xy(F.col("t"), F.col("t"), 0, 1)).collect()]
    assert got == [(7, 3, None, 1), (10, 10, 10, 10), (10, 10, 10, 10)]


def test_cuts_and_rejects(spark):
    rng = np.random.default_rng(13)
    d = directions(14, 10)
    hits = spark.createDataFrame(hit_rows({str(i): wave(rng, 3 + i, direction=v) for i, v in enumerate(d)}), HITS)
    fits = planewave.fit(hits)
    assert {r.n_du for r in cuts.footprint(hits, fits).collect()} == set(range(4, 13))
    ring = {r.n_du: r.keep for r in cuts.ring(hits, fits).collect()}
    assert all(ring[n] for n in range(6, 13))
    both, f, r = (cuts.apply_cuts(hits, fits, *s).count() for s in ((True, True), (True, False), (False, True)))
    assert both <= min(f, r) and cuts.apply_cuts(hits, fits, False, False).count() == fits.count()
    rows = [(400.0, 60.0, 30.0, 9000.0), (400.0, 60.0, 100.0, 9000.0), (400.0, 60.0, 100.0, 20000.0), (600.0, 60.0, 30.0, 0.0), (400.0, 90.0, 30.0, 0.0)]
    assert cuts.reject_background(spark.createDataFrame(rows, "chi_square double, zenith double, azimuth double, z double")).count() == 2


def test_positions_signals_and_radius(spark):
    hits = spark.createDataFrame([("f", "1", 1, 1, 0.0), ("f", "1", 2, 2, 0.0), ("f", "2", 1, 1, 0.0), ("f", "2", 2, 9, 0.0)], "file string, event_key string, hit_pos int, du_id int, time_ns double")
    layout = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], "du_id int, x double, y double, z double")
    own = spark.createDataFrame([("f", "1", 1, 50.0, 0.0, 0.0)], "file string, event_key string, du_id int, x double, y double, z double")
    at = resolve_positions(hits, layout, own)
    assert {(r.event_key, r.du_id): r.x for r in at.collect()} == {("1", 1): 50.0, ("1", 2): None, ("2", 1): 1.0, ("2", 9): None}
    assert unplaced_events(at).count() == 2 and within_radius(at, 10.0).count() == 1 and within_radius(at, 0.0).count() == 4
    signals = hits.where("not (event_key = '1' and du_id = 2)")
    known = spark.createDataFrame([(1,), (2,), (9,)], "du_id int")
    assert [r.event_key for r in consistent_events(hits, signals, known).collect()] == ["2"]
    off = spark.createDataFrame([(1, 4.0, 1), (1, 5.0, 2)], "du_id int, mean_ns double, ord int")
    assert {(r.du_id, r.time_offset) for r in subtract_offsets(hits, off).collect()} == {(1, 5.0), (2, 0.0), (9, 0.0)}


def test_text_tables(spark, tmp_path):
    (tmp_path / "layout.txt").write_text("# id x y z\n1 10 20 30\n\n2, 1.5, 2.5, 3.5 # note\n3 4\nx 1 2 3\n1 11 21 31\n")
    got = {r.du_id: (r.x, r.y, r.z) for r in tables.read_layout(spark, str(tmp_path / "layout.txt")).collect()}
    assert got == {1: (11.0, 21.0, 31.0), 2: (1.5, 2.5, 3.5)}
    (tmp_path / "cal.csv").write_text("window_start_utc,window_end_utc,DU_ID,time_offset_add_ns,x_offset_m,y_offset_m,z_offset_m\n2024-01-01 00:00:00,2024-01-02 00:00:00.500000,7,1.5,0,0,0\n2024-01-01 00:00:00,2024-01-02 00:00:00.500000,7,2.5,0.1,,0\n")
    rows = tables.read_calibration(spark, str(tmp_path / "cal.csv")).collect()
    assert [(r.du_id, r.dt_ns, r.dx, r.dy, r.end_s - r.start_s) for r in rows] == [(7, 2.5, 0.1, 0.0, 86400)]
    (tmp_path / "pairs.csv").write_text("du_a,du_b,distance_m,theoretical_delta_ns\n1,2,3.0,4.0\n1,x,3.0,4.0\n")
    good, bad = tables.read_pairs(spark, str(tmp_path / "pairs.csv"))
    assert good.count() == 1 and bad.count() == 1
    lines = spark.createDataFrame([("12.5: [('3', 40), ('4', -7.5), ('5', -7), ('bad', 1)]",)], "value string")
    assert [(r.event_key, r.du_id, r.time_ns) for r in tables.parse_fingerprints(lines).collect()] == [("12.5", 3, 40.0), ("12.5", 5, -7.0)]
    files = spark.createDataFrame([("/d/a_20240101000000.x",), ("/d/a_20240103000000.x",), ("/d/none.x",)], "path string")
    assert tables.files_between(files, "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 1


def test_records(spark):
    raw = spark.createDataFrame(
        [("f", 1, 7, 0, [5, 6, 5], [20240102, 30405, 0], [10, 20, 30], [[[1, -9], [2, 2]], [[0, 3], [4, 4]], [[1, 1], [1, 1]]]), ("f", 1, 8, 1, [5], [20240102, 30405, 0], [-1], [[[1], [1]]])],
        "file string, run_number long, event_number long, idx long, du_id array<int>, gps_time array<long>, du_nanoseconds array<long>, trace_ch array<array<array<short>>>",
    )
    events = records.keyed_events(raw)
    assert {r.du_id: r.time_ns for r in records.trigger_hits(events).where("event_key = '7'").collect()} == {5: 30.0, 6: 20.0}
    got = records.waveform_hits(events, "X", 0, 2, simulated=True).collect()
    assert {(r.event_key, r.du_id): r.signal for r in got} == {("7", 5): 1, ("7", 6): 3}
    low, high = spark.range(1).select(*records.interval(F.lit("adc_10-20_L1.root"))).first()
    assert (low, high) == (10, 20)
    shower = spark.createDataFrame([("s", 0, "e1", 200.0, 100.0)], "file string, idx long, evt_id string, azimuth double, zenith double")
    field = spark.createDataFrame([("s", 0, [1, 2], [[0.0, 0.0, 1.0], [9.0, 0.0, 1.0]], [-1.5, 2.5])], "file string, idx long, det_id array<int>, det_pos array<array<double>>, t_0 array<double>")
    ev = records.aligned_events(shower, field)
    first = ev.first()
    assert (first.truth.azimuth, first.truth.zenith, first.gps_time) == (20.0, 80.0, 1577836800)
    assert records.aligned_hits(ev).count() == 2 and records.aligned_hits(ev, 5.0).count() == 1
    broken = spark.createDataFrame([("s", 0, [1], [[0.0, 0.0, 1.0]], [1.0, 2.0])], field.schema)
    with pytest.raises(Exception, match="differ in length"):
        records.aligned_events(shower, broken).collect()
    short = spark.createDataFrame([("s", 0, [1.0])], "file string, idx long, p2p array<double>")
    for wrong in (short, short.where("idx > 0")):
        with pytest.raises(Exception, match="signals differ in length"):
            records.aligned_hits(records.aligned_events(shower, field, wrong)).collect()
    right = spark.createDataFrame([("s", 0, [1.0, 2.0])], short.schema)
    assert [r.signal for r in records.aligned_hits(records.aligned_events(shower, field, right)).orderBy("du_id").collect()] == [1.0, 2.0]


def test_records_keep_the_order_of_their_files(spark, tmp_path):
    """Of a number that occurs twice the last record in the file stays, however the file is split."""
    rows = [(1, i % 500, [5], [20240102, 30405, 0], [i], *[[[1]]] * 4) for i in range(1000)]
    raw = spark.createDataFrame(rows, records.TRIGGER).coalesce(1)
    raw.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        events = records.trigger_events(spark, str(tmp_path / "t"))
        assert {r.event_number: (r.idx, r.du_nanoseconds[0]) for r in events.collect()} == {i: (500 + i, 500 + i) for i in range(500)}
        lines = "".join(f"{i % 50} {i} 0 0\n" for i in range(2000))
        (tmp_path / "layout.txt").write_text(lines)
        assert {r.du_id: r.x for r in tables.read_layout(spark, str(tmp_path / "layout.txt")).collect()} == {i: 1950.0 + i for i in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_and_writers(spark, tmp_path):
    """Listing, the first files, pair tables and documents, written and read again."""
    from pulsegrid.operators.hits import attach, first_files
    from pulsegrid.sources import sinks

    for n in ("b_1.dat", "a_1.dat", "c.txt"):
        (tmp_path / n).write_text(n)
    assert sorted(Path(r.path).name for r in tables.list_files(spark, str(tmp_path), "*_1.dat").collect()) == ["a_1.dat", "b_1.dat"]
    files = spark.createDataFrame([(f, i) for f in "cab" for i in range(2)], "file string, i int")
    assert {r.file for r in first_files(files, 2).collect()} == {"a", "b"} and first_files(files, 0).count() == 6
    pairs = spark.createDataFrame([(2, 10, 1.5, 2.5), (10, 2, 3.5, 4.5), (1, 2, 0.5, 0.25)], "du_a int, du_b int, distance_m double, theoretical_delta_ns double")
    tables.write_pairs(pairs, str(tmp_path / "pairs"))
    good, bad = tables.read_pairs(spark, str(tmp_path / "pairs"))
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, pairs.collect())) and bad.count() == 0
    events = spark.createDataFrame([("f", "1", "2024-01-01"), ("f", "2", "2024-01-02")], "file string, event_key string, date string")
    hits = spark.createDataFrame([("f", "1", 2, 7, 10.0), ("f", "1", 1, 8, 12.0), ("f", "2", 1, 7, 9.0)], "file string, event_key string, hit_pos int, du_id int, time_ns double")
    documents = sinks.event_documents(events, hits)
    sinks.write_documents(documents, str(tmp_path / "docs"))
    assert {r.event_key: (r.du_ids, r.time[7]) for r in spark.read.parquet(str(tmp_path / "docs")).collect()} == {"1": ([8, 7], 10.0), "2": ([7], 9.0)}
    sinks.export_documents(documents, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_stage(hits, str(tmp_path / "stage"))
    assert attach(spark.read.parquet(str(tmp_path / "stage")), events).where("date = '2024-01-01'").count() == 2
    lines = spark.createDataFrame([(20, "b"), (10, "a")], "gps_time long, value string")
    sinks.write_directions(lines, str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", "b"]


def test_cuts_of_saved_fits(spark, sf_dir, tmp_path):
    from pulsegrid.plans.queries import known_fits

    hits = placed_hits(spark, sf_dir)
    fits = known_fits(hits)
    fits.unionByName(fits.limit(3).select("file", F.lit("none").alias("event_key"), F.lit(None).cast("double").alias("vx"), "vy", "vz")).write.parquet(str(tmp_path / "fits"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(cuts.cut_saved_fits(spark, str(tmp_path / "fits"), hits)) == rows(cuts.apply_cuts(hits, fits))


def test_summaries_and_options(spark):
    h = summaries.histogram(spark.createDataFrame([(float(i),) for i in range(11)], "v double"), "v", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 2, 2, 2, 3]
    low = summaries.histogram(spark.createDataFrame([(1.0,), (10.0,), (100.0,)], "v double"), "v", 4, log=True).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in low] == [(2, 1), (4, 1)] and math.isclose(low[0].low, math.log10(1.01) + (2 - math.log10(1.01)) / 4)
    flat = summaries.histogram(spark.createDataFrame([(2.0,), (2.001,)], "v double"), "v", 9, log=True).collect()
    assert [(r.bin, r.n) for r in flat] == [(9, 2)]
    each = summaries.histograms(spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 9.0), (2, 5.0)], "k int, v double"), "k", "v", 4)
    assert sorted((r.k, r.bin, r.n) for r in each.collect()) == [(1, 1, 1), (1, 4, 2), (2, 3, 1)]
    diffs = spark.createDataFrame([("f", "1", 9, 0.0), ("f", "1", 8, -500.0), ("f", "1", 7, 99.0), ("f", "1", 6, 100.0)], "file string, event_key string, du_id int, time_ns double")
    assert sorted((r.du_id, r.mean_ns) for r in summaries.spread_to_reference(diffs, 9).collect()) == [(7, 99.0), (8, -500.0)]
    assert summaries.batch_summary(spark.createDataFrame([("ok",), ("failed",)], "status string")).count() == 2
    sim = PipelineConfig.for_layout("simulated")
    assert sim.skip_matching and sim.skip_repeats and sim.skip_footprint and not PipelineConfig.for_layout("trigger").skip_matching
    assert len(list(itertools.combinations(range(6), 2))) == 15


def test_kept_and_rejected_events_are_the_input(spark, sf_dir):
    """Of the whole chain, and of simulated events with their own layouts, some of which lack a detector."""
    from pulsegrid.plans.queries import reconstructed
    from pulsegrid.plans.staging import Stages

    def whole(tables):
        ids = lambda df: sorted(r.event_key for r in df.select("file", "event_key").distinct().collect())
        lost = tables["rejects"].collect()
        assert sorted([*ids(tables["source"]), *(r.event_key for r in lost)]) == ids(tables["hits"]) and all(r.reason for r in lost)
        return {r.event_key: (r.stage, r.reason) for r in lost}

    assert {s for s, _ in whole(reconstructed(spark, sf_dir, remove_outliers=False)).values()} >= {"matching", "cuts"}
    events = {f"{i}": wave(np.random.default_rng(i), 6 - i % 3, source=d * 9e3, noise=1) for i, d in enumerate(directions(71, 9))}
    rows = hit_rows(events)
    own = spark.createDataFrame([(r[0], r[1], r[3], *r[6:]) for r in rows if (r[1], r[2]) != ("3", 2)], "file string, event_key string, du_id int, x double, y double, z double")
    hits = spark.createDataFrame(rows, HITS)
    layout = spark.createDataFrame([(999, 0.0, 0.0, 0.0)], "du_id int, x double, y double, z double")
    clock_rows = spark.createDataFrame([("f", k, 18) for k in events], "file string, event_key string, gps_time long")
    config = PipelineConfig.for_layout("simulated", with_signal=False, min_detectors=4)
    tables_of = reconstruct(hits, clock_rows, layout, config, Stages(spark).bucketed, own_layout=own)
    lost = whole(tables_of)
    assert lost["3"] == ("matching", "unknown detector") and all(lost[k] == ("source", "fewer than 5 hits") for k in ("2", "5", "8")) and len(lost) == 4
    assert "signal" not in tables_of["hits"].columns
    truth = {k: np.degrees(np.arccos(d[2])) for k, d in zip(events, directions(71, 9), strict=True)}
    assert all(r.theta == pytest.approx(truth[r.event_key], abs=1.5) for r in tables_of["source"].where("size(hits) = 6").collect())


def test_variants_of_the_source_fit_by_value(spark):
    """Plane fallback, the single start, and four hits, on noise-free fronts."""
    d = directions(81, 4)
    events = {f"{i}": wave(np.random.default_rng(90 + i), 7, source=v * 9e3) for i, v in enumerate(d)}
    hits = spark.createDataFrame(hit_rows(events), HITS)
    plane = planewave.fit(hits)
    seeds = {r.event_key: r for r in plane.collect()}
    for r in pointsource.fit(hits, plane, fallback=-1.0).collect():
        s = seeds[r.event_key]
        assert r.fit_status == "plane_fallback" and (r.rho, r.theta, r.phi) == (1e5, s.zenith, s.azimuth)
        t, p = np.radians([s.zenith, s.azimuth])
        assert np.allclose([r.sx, r.sy, r.sz], 1e5 * np.array([np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)]))
    turned = plane.select("file", "event_key", *[F.lit(0.0).alias(c) for c in ("zenith", "azimuth")]).drop("zenith", "azimuth")
    truth = spark.createDataFrame([(str(i), float(np.degrees(np.arccos(v[2]))), float(np.degrees(np.arctan2(v[1], v[0])) % 360)) for i, v in enumerate(d)], "event_key string, zenith double, azimuth double")
    near = turned.join(truth, "event_key")
    for fits in (pointsource.fit_single(hits, near), pointsource.fit_four(hits.where("hit_pos < 5"), near)):
        rows = fits.collect()
        assert len(rows) == 4 and all(r.chi_square < 1.0 for r in rows)
    assert all(np.linalg.norm(np.array([r.sx, r.sy, r.sz]) - d[int(r.event_key)] * 9e3) < 100 for r in pointsource.fit_single(hits, near).collect())


def test_channels_of_waveforms_by_value(spark):
    traces = F.array(*[F.array(*[F.lit(v) for v in row]) for row in ([1, -9, 2, 0], [3, 0, -4, 1], [0, 5, 3, -7], [8, 1, 1, 1])])
    want = {("F", False): 9, ("X", False): 4, ("Y", False): 5, ("Z", False): 1, ("XY", False): 5, ("F", True): 9, ("X", True): 9, ("Y", True): 4, ("Z", True): 5, ("XY", True): 9}
    got = spark.range(1).select(*[amplitude.amplitude(traces, name, 1, 3, simulated).alias(f"{name}{simulated}") for name, simulated in want]).first()
    assert list(got) == list(want.values())


def test_sources_beyond_the_bound_are_fitted_along_it():
    """Plane waves in whole ns pull the distance beyond its bound; every start must still reach the best direction there."""
    rng, d = np.random.default_rng(23), directions(24, 12)
    p = np.stack([rng.integers(0, 8, (12, 6)) * 400.0 - 1400, rng.integers(0, 8, (12, 6)) * 400.0 - 1400, rng.integers(0, 23, (12, 6)) * 1.0], -1)
    t = np.round(np.einsum("bhk,bk->bh", p, -d) / C_AIR) + rng.integers(-6, 7, (12, 6))
    t -= t.mean(1, keepdims=True)
    azimuth, starts = np.degrees(np.arctan2(d[:, 1], d[:, 0])), np.array(pointsource.STARTS)
    first = np.tile(starts, (12, 1)) + np.repeat(azimuth, len(starts))[:, None] * [0, 0, 1]
    again = lambda a: np.repeat(a, len(starts), axis=0)
    found, total = pointsource.solve_sources(first, again(p), again(t), np.ones((len(first), 6)))
    best = total.reshape(12, -1).min(1)
    for i in np.flatnonzero(np.isclose(found[total.reshape(12, -1).argmin(1) + np.arange(12) * len(starts), 0], 1e6)):
        th, ph = (np.radians(a.ravel()) for a in np.meshgrid(np.arange(5, 95.1, 0.5), np.arange(0, 360, 0.5)))
        u = np.stack([np.full(th.size, 1e-6), th, ph], -1)
        every = lambda a: np.repeat(a[i : i + 1], th.size, axis=0)  # noqa: E731, B023
        r, _ = pointsource._residuals(u, every(p), every(t), np.ones((th.size, 6)), C_AIR)
        assert best[i] <= (r**2).sum(1).min() / 36 * (1 + 1e-9)
    close = total.reshape(12, -1) <= best[:, None] * 1.001 + 1e-6
    assert close.mean() > 0.9


def test_many_equal_windows_meet_no_second_twice(spark):
    """Windows are merged with the seconds, not joined to those of their day, and no frame is summed anew for each row."""
    rows = [(i, 86_400 * (i % 3), 86_400 * (i % 3) + 90_000) for i in range(300)]
    windows = spark.createDataFrame(rows, "window_id long, start_s long, end_s long")
    events = spark.range(0, 400_000, 1000).select(F.col("id").cast("string").alias("event_key"), F.col("id").alias("s"))
    out = calibration.joined_windows(events, windows, F.col("s"))
    frames = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in frames and frames.count("generate explode") == frames.count("generate explode(array(")
    got = {r.s: (r.window_id, r.window_dist) for r in out.collect()}
    assert got[90_000] == (0, 0) and got[91_000] == (1, 0) and got[180_000] == (2, 0) and got[270_000] == (2, 270_000 - 262_800)


def test_direction_lines_close_the_circle(spark):
    """Azimuths that noise leaves a hair below 360 or 0 are 0, in the query and in its SQL."""
    fits = spark.createDataFrame([("f", "a", 60.0, 359.9999999999, 1.0), ("f", "b", 60.0, -0.0, 1.0), ("f", "c", 60.0, 359.9, 1.0)], "file string, event_key string, zenith double, azimuth double, chi_square double")
    events = spark.createDataFrame([("f", k, 1_000_000_018 + i) for i, k in enumerate("abc")], "file string, event_key string, gps_time long")
    shown = [r.value.split()[4] for r in sinks.direction_lines(fits, events).orderBy("gps_time").collect()]
    assert shown == ["0.0", "0.0", "359.9"]
    assert "round(azimuth, 6) % 360 + 0e0" in ORACLE["selected_directions"]


def test_whole_moments_are_exact(spark, sf_dir):
    """The same to the last bit as sums of integers, in whatever order the hits come."""
    hits = placed_hits(spark, sf_dir)
    whole = {r.event_key: r for r in planewave.whole_moments(hits.repartition(7)).collect()}
    events = hits.toPandas().groupby("event_key")
    for key, e in itertools.islice(events, 200):
        of = {k: [int(v) for v in e[c]] for k, c in zip("xyzt", ("x", "y", "z", "time_ns"), strict=True)}
        for m in planewave.MOMENTS:
            a, b = of[m[0]], of[m[1]]
            assert whole[key][m] == len(e) * sum(x * y for x, y in zip(a, b, strict=True)) - sum(a) * sum(b)


def test_source_solver_refills_its_places_and_sums_along_rows(monkeypatch):
    """Starts that converge give their places to the next ones, and hits stay arrays whose rows lie together in memory."""
    rng = np.random.default_rng(29)
    made = [wave(rng, 6, source=s, noise=4.0) for s in directions(30, 40) * rng.uniform(5e3, 5e4, (40, 1))]
    p, t = np.stack([e[0] for e in made]), np.stack([e[1] - e[1].mean() for e in made])
    start = np.array([(3e4, 60.0, 45.0 * k) for k in range(8)])
    of = np.repeat(np.arange(40), 8)
    alone = [pointsource.solve_sources(start, *(np.repeat(a[i : i + 1], 8, axis=0) for a in (p, t)), np.ones((8, 6))) for i in range(40)]
    monkeypatch.setattr(pointsource, "TOGETHER", 6 * 64)
    widths, inner = [], pointsource._normal

    def watched(u, hits, *rest):
        assert all(a.flags.c_contiguous for a in hits)
        widths.append(u.shape[1])
        return inner(u, hits, *rest)

    monkeypatch.setattr(pointsource, "_normal", watched)
    found, total = pointsource.solve_sources(np.tile(start, (40, 1)), p, t, np.ones((40, 6)), of=of)
    assert np.allclose(total, np.concatenate([a[1] for a in alone]), rtol=1e-9, atol=1e-9)
    assert np.allclose(found, np.concatenate([a[0] for a in alone]), rtol=1e-5)
    assert max(widths) == 64 and sorted(widths)[len(widths) // 2] > 16


def test_repeat_fold_equals_comparison_with_all_and_compares_few():
    """The fold by postings gives what comparing with every event of both lists gives, and looks into none that shares no pair."""

    def plain(events, buffer, least, history):
        like = lambda a, b: sum(k in b and abs(t - b[k]) < 10 for k, t in a.items()) >= least
        live, gone, kept, removed = [], [], [], []
        for key, pairs in events:
            first = next((e for e in live if not e[2] and like(pairs, e[1])), None)
            if any(like(pairs, old) for old in gone):
                gone.append(pairs)
                removed.append(key)
            elif first:
                first[2] = True
                gone += [first[1], pairs]
                removed += [first[0], key]
            else:
                live.append([key, pairs, False])
                kept += [e[0] for e in live[:-buffer] if not e[2]]
                live = live[-buffer:]
            gone = gone[-history:]
        return kept + [e[0] for e in live if not e[2]], removed

    rng = np.random.default_rng(31)
    for buffer, least, history in ((5, 3, 4), (50, 5, 200), (8, 1, 1)):
        dus = [rng.choice(6, int(rng.integers(1, 7)), replace=False) for _ in range(400)]
        events = [(i, repeats.pairs_of(d, [float(v) for v in rng.integers(0, 60, len(d))])) for i, d in enumerate(dus)]
        fold = repeats.RepeatFold(buffer=buffer, least=least, history=history)
        kept = [k for key, pairs in events for k in fold.push(key, pairs)] + list(fold.flush())
        assert (kept, fold.removed) == plain(events, buffer, least, history)
        assert len(fold.removed) > 20

    class Watched(dict):
        looked = 0

        def __contains__(self, key):
            Watched.looked += 1
            return super().__contains__(key)

    fold = repeats.RepeatFold()
    for i in range(200):
        list(fold.push(i, Watched(repeats.pairs_of(range(6 * i, 6 * i + 6), range(6)))))
    assert Watched.looked == 0


def test_repeats_derive_hits_once(spark, sf_dir):
    """The sequential form reads the line items once for all its steps, the others once for each side of their join; with a
    reach no difference is dealt to neighbouring buckets; fingerprints are the pairs that a join gives."""
    from pulsegrid.operators.pairs import hit_pairs
    from pulsegrid.plans.queries import QUERIES

    for name, reads in (("events_without_repeats", 2), ("sequential_repeat_filter", 1), ("similar_events", 2)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("l_orderkey" in r and "Relation" in r for r in plan.splitlines()) == reads
        assert "bucket" not in plan
    hits = placed_hits(spark, sf_dir).drop("x", "y", "z")
    want = hit_pairs(hits.withColumn("time_ns", F.col("time_ns").cast("long")))
    assert sorted(map(tuple, repeats.fingerprints(hits).collect())) == sorted(map(tuple, want.collect()))


def test_matches_stand_in_the_plan_once(spark):
    """No filter repeats the match of an event, whichever form it has."""
    events = {str(i): wave(np.random.default_rng(i), 7, direction=d) for i, d in enumerate(directions(33, 5))}
    hits = spark.createDataFrame(hit_rows(events), HITS)
    for operator, mark in ((causality.match_clique, "aggregate("), (causality.prune_worst, "aggregate("), (causality.drop_after_earlier, "exists(")):
        matched = causality.scatter(operator(hits), "matched")
        assert matched._jdf.queryExecution().optimizedPlan().toString().count(mark) == 1
        assert matched.count() == 35
