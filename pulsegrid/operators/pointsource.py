"""Point-source fits: the distance and direction of a spherical front, with removal of outlying hits.

A source is fitted in (1 / rho, theta, phi); the time origin is linear and drops out when residuals lose their mean. Events
and their subsets of hits are rows that carry their hits as arrays. An Arrow batch solves thousands of rows from all starts
at once and gives back the best of each row, so fits need no shuffle; the removal of hits runs in the batch as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.constants import C_AIR, C_VACUUM, EVENT, RHO_MAX, RHO_MIN, SIGMA
from pulsegrid.operators.causality import gather, scatter

STEPS = 60
#: Hits of all starts that are solved together; bounds the memory of a solve and keeps its arrays in the cache.
TOGETHER = 1 << 15
#: Starts (rho, theta, azimuth relative to the seed), two rings of eight azimuths.
STARTS = [(3e4, 60.0, 45.0 * k) for k in range(8)] + [(2e4, 45.0, 22.5 + 45.0 * k) for k in range(8)]
#: Azimuths (relative) of the refits of subsets, of more than four hits and of four.
REFIT, REFIT_FOUR = [(3e4, 60.0, 30.0 * k) for k in range(12)] + [(1e4, 75.0, 0.0)], [(3e4, 60.0, 60.0 * k) for k in range(6)]
#: Fixed values of the removal: chi square that calls for it, gates on the ratio to it, and the residual in ns.
OUTLYING, GATE_TO_FOUR, GATE, CONFIRM = 10.0, 0.8, 0.7, 3 * SIGMA
#: Own choices: starts, and hits of subsets, that are made together (they bound the memory of a solve); hits of the subsets of
#: a block of a large event; ways to leave hits out from which an event counts as large; events of a task on average.
STARTS_TOGETHER, HITS_TOGETHER, BLOCK, LARGE, EVENTS_A_TASK = 1 << 18, 1 << 20, 1 << 18, 1 << 10, 8_000
PLANE_FALLBACK, FALLBACK_RHO = 1e6, 1e5
#: The penalised variant: speed, bounds, gate of its removal, chi square from which all subsets of four of five are tried,
#: strength of the azimuth penalty in refits, least chi square after the removal.
PENALISED = {"c": C_VACUUM, "rho": (2e3, 6e4), "theta": (30.0, 95.0)}
GATE_PENALISED, ALL_FOURS, EDGE_WIDTH, EDGE_STRENGTH, FLOOR_PENALISED = 0.5, 200.0, 10.0, 5e2, 1e-3
#: Its starts around the fit before (factor of rho, differences of theta and azimuth): four of five hits, one of five left
#: out, one of more left out.
AROUND_FOURS = [(1.0, 0.0, 0.0), (1.2, 0.0, 90.0), (0.8, 0.0, -120.0), (1.0, 10.0, -30.0), (1.0, -10.0, 0.0)]
AROUND_FOUR = [(1.0, 0.0, 0.0), (1.2, 0.0, 20.0), (0.8, 0.0, -30.0), (1.0, 10.0, -90.0), (1.0, -10.0, 0.0), (1.0, 0.0, 180.0)]
AROUND = [(1.0, 0.0, 0.0), (1.2, 0.0, 0.0), (0.8, 0.0, 0.0), (1.0, 10.0, 0.0), (1.0, -10.0, 0.0), (1.0, 0.0, 180.0)]


def _residuals(u: np.ndarray, p: np.ndarray, t: np.ndarray, w: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (mean removed) and their derivatives by (1/rho, theta, phi) of rows of padded hits with weights 0 or 1."""
    q, th, ph = u.T
    rho = 1 / q
    d = np.stack([np.sin(th) * np.cos(ph), np.sin(th) * np.sin(ph), np.cos(th)], -1)
    by_th = np.stack([np.cos(th) * np.cos(ph), np.cos(th) * np.sin(ph), -np.sin(th)], -1)
    by_ph = np.stack([-np.sin(th) * np.sin(ph), np.sin(th) * np.cos(ph), np.zeros_like(th)], -1)
    to = p - (rho[:, None] * d)[:, None, :]
    dist = np.linalg.norm(to, axis=2)
    unit = to / dist[..., None]
    # The travel time less that from the origin keeps its digits for far sources.
    r = (dist - rho[:, None]) / c - t
    j = np.stack([(np.einsum("bhk,bk->bh", unit, d) + 1) * (rho**2)[:, None], -np.einsum("bhk,bk->bh", unit, by_th) * rho[:, None], -np.einsum("bhk,bk->bh", unit, by_ph) * rho[:, None]], -1) / c
    n = w.sum(1, keepdims=True)
    centre = lambda x: (x - ((x * (w if x.ndim == 2 else w[..., None])).sum(1, keepdims=True) / (n if x.ndim == 2 else n[..., None]))) * (w if x.ndim == 2 else w[..., None])
    return centre(r), centre(j)


def _edge(phi: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """The residual whose square is the azimuth penalty (in units of sigma^2), and its derivative."""
    a = np.degrees(phi) % 360.0
    unit = SIGMA * np.sqrt(strength) / EDGE_WIDTH
    short = np.maximum(EDGE_WIDTH - np.minimum(a, 360.0 - a), 0.0) * unit
    return short, np.where(short > 0, np.where(a < 180.0, -1.0, 1.0), 0.0) * (unit * 180.0 / np.pi)


def _with_edge(u: np.ndarray, r: np.ndarray, j: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and derivatives with that one more."""
    short, slope = _edge(u[:, 2], strength)
    more = np.stack([np.zeros_like(slope), np.zeros_like(slope), slope], -1)
    return np.concatenate([r, short[:, None]], 1), np.concatenate([j, more[:, None, :]], 1)


def _normal(u: np.ndarray, hits: tuple[np.ndarray, ...], w: np.ndarray | None, c: float, edge: float) -> np.ndarray:
    """Sum of squares, gradient (3) and normal matrix (00, 11, 22, 01, 02, 12) of each row, as ten rows of an array.

    Hits x, y, z, |p|^2, t are arrays of hits x rows, so each operation runs along the rows and holds no derivative longer than
    its sums; w (0 or 1) is None where all rows have as many hits. `edge` is the strength of the azimuth penalty.
    """
    x, y, z, square, t = hits
    q, th, ph = u
    rho, st, ct, sp, cp = 1 / q, np.sin(th), np.cos(th), np.sin(ph), np.cos(ph)
    n = len(x) if w is None else w.sum(0)
    # Arrays of hits are written over and over; fresh ones would cost as much as the arithmetic.
    buf = np.empty_like(x)
    flat = x * cp
    flat += np.multiply(y, sp, out=buf)
    by_ph = x * sp
    by_ph -= np.multiply(y, cp, out=buf)
    by_q = flat * st
    by_q += np.multiply(z, ct, out=buf)
    # dist - rho keeps its digits for far sources.
    less = square - np.multiply(by_q, 2 * rho, out=buf)
    dist = less + rho * rho
    np.sqrt(dist, out=dist)
    less /= np.add(dist, rho, out=buf)
    by_q += less
    share = np.divide(rho / c, dist, out=dist)
    by_q *= share
    by_q *= rho
    flat *= ct
    by_th = np.subtract(np.multiply(z, st, out=buf), flat, out=flat)
    by_th *= share
    by_ph *= share
    by_ph *= st
    less /= c
    less -= t
    rows = (less, by_q, by_th, by_ph)
    for a in rows:
        if w is None:
            a -= a.sum(0) / n
        else:
            a -= np.multiply(a, w, out=buf).sum(0) / n
            a *= w
    out = np.empty((10, len(q)))
    for k, (i, j) in enumerate(((0, 0), (1, 0), (2, 0), (3, 0), (1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3))):
        np.multiply(rows[i], rows[j], out=buf).sum(0, out=out[k])
    if edge:
        short, slope = _edge(ph, edge)
        out[0] += short * short
        out[3] += slope * short
        out[6] += slope * slope
    return out


def solve_sources(start: np.ndarray, p: np.ndarray, t: np.ndarray, w: np.ndarray, *, of: np.ndarray | None = None, c: float = C_AIR, rho: tuple[float, float] = (RHO_MIN, RHO_MAX), theta: tuple[float, float] = (5.0, 95.0), edge: float = 0.0, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares from (rho, theta, phi in degrees) starts: the solutions and their sums of squares / sigma^2,
    with the azimuth penalty of strength `edge`. `of` gives each start's row of hits, if they aren't one for one.

    At most TOGETHER hits of starts are held; where a quarter has converged, the next starts take their places, so that the
    arrays stay full until the last.
    """
    low = np.array([[1 / rho[1]], [np.radians(theta[0])], [-np.inf]])
    high = np.array([[1 / rho[0]], [np.radians(theta[1])], [np.inf]])
    first = np.clip(np.stack([1 / start[:, 0], np.radians(start[:, 1]), np.radians(start[:, 2])]), low, high)
    of = np.arange(len(start)) if of is None else of
    x, y, z = (np.ascontiguousarray(p[:, :, k].T) for k in range(3))
    rows = (x, y, z, x * x + y * y + z * z, np.ascontiguousarray(t.T))
    weights = None if w.all() else np.ascontiguousarray(w.T.astype(float))
    best, total = first.copy(), np.empty(first.shape[1])
    places, begun = max(1, TOGETHER // max(1, p.shape[1])), 0
    at, age, damp, open_ = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
    u, now, hits, weight = np.empty((3, 0)), np.empty((10, 0)), tuple(a[:, :0] for a in rows), None if weights is None else weights[:, :0]
    while True:
        left = np.count_nonzero(open_)
        if left <= 0.75 * (places if begun < len(of) else len(at)):
            best[:, at], total[at] = u, now[0]
            new = np.arange(begun, min(begun + places - left, len(of)))
            begun += len(new)
            if not left and not len(new):
                break
            fresh = tuple(a.take(of[new], -1) for a in rows)
            own = None if weights is None else weights.take(of[new], -1)
            # take, as indexing with a mask would turn the arrays and each sum over the hits would stride.
            keep = np.flatnonzero(open_)
            joined = lambda a, b, keep=keep: np.concatenate([a.take(keep, -1), b], -1)
            now = joined(now, _normal(first[:, new], fresh, own, c, edge)) if len(new) else now.take(keep, -1)
            u, at, age, damp = joined(u, first[:, new]), joined(at, new), joined(age, np.zeros(len(new), np.int64)), joined(damp, np.full(len(new), 1e-3))
            hits = tuple(joined(a, b) for a, b in zip(hits, fresh, strict=True))
            weight = None if weights is None else joined(weight, own)
            open_ = np.ones(len(at), bool)
        # A value at its bound that the gradient pushes outwards is held, or the others' steps would follow its vain one.
        held = ((u <= low) & (now[1:4] > 0)) | ((u >= high) & (now[1:4] < 0))
        trial = np.clip(u + _step(now, damp, ~held), low, high)
        then = _normal(trial, hits, weight, c, edge)
        age += 1
        better = open_ & (then[0] < now[0])
        done = (better & (now[0] - then[0] <= 1e-9 * now[0])) | (damp > 1e7) | (now[0] < 1e-12) | (age >= steps)
        np.copyto(u, trial, where=better)
        np.copyto(now, then, where=better)
        damp = np.clip(np.where(better, damp * 0.2, damp * 5), 1e-12, 1e9)
        open_ &= ~done
    return np.stack([1 / best[0], np.degrees(best[1]), np.degrees(best[2])], -1), total / SIGMA**2


def _step(now: np.ndarray, damp: np.ndarray, free: np.ndarray) -> np.ndarray:
    """-(J'J + damp) \\ g for columns scaled to unit length, by Cramer's rule, in the columns' own units; 0 for those not free."""
    scale = np.sqrt(now[4:7]) + 1e-300
    a, b, c = now[1:4] / scale * free
    x, y, z = (now[k] / (scale[i] * scale[j]) * (free[i] & free[j]) for k, i, j in ((7, 0, 1), (8, 0, 2), (9, 1, 2)))
    d = 1 + damp
    det = d**3 + 2 * x * y * z - d * (x * x + y * y + z * z)
    det = np.where(np.abs(det) < 1e-30, 1e-30, det)
    return -np.stack([a * (d * d - z * z) + b * (y * z - d * x) + c * (x * z - d * y), a * (y * z - d * x) + b * (d * d - y * y) + c * (x * y - d * z), a * (x * z - d * y) + b * (x * y - d * z) + c * (d * d - x * x)]) / (det * scale)


#: Start values (rho, theta, phi) of a batch's rows: an array of rows x starts x 3, from some of their columns.
Starts = Callable[[dict[str, np.ndarray]], np.ndarray]


def relative_to_seed(starts: list[tuple[float, float | None, float]]) -> Starts:
    """Azimuths relative to seed_phi; a start without a zenith takes seed_theta."""

    def of(col: dict[str, np.ndarray]) -> np.ndarray:
        one = np.ones(len(col["seed_phi"]))
        return np.stack([np.stack([rho * one, col["seed_theta"] if theta is None else theta * one, col["seed_phi"] + d], -1) for rho, theta, d in starts], 1)

    return of


def around_fit(starts: list[tuple[float, float, float]], theta: tuple[float, float]) -> Starts:
    """Around the fit (rho, theta, phi) of each row: a factor and two differences; zeniths stay in bounds."""

    def of(col: dict[str, np.ndarray]) -> np.ndarray:
        return np.stack([np.stack([col["rho"] * a, np.clip(col["theta"] + b, *theta), col["phi"] + d], -1) for a, b, d in starts], 1)

    return of


SOLVED = ("rho", "theta", "phi", "total", "sx", "sy", "sz")


def solve_best(rows: DataFrame, starts: Starts, needs: list[str], *, c: float = C_AIR, rho: tuple[float, float] = (RHO_MIN, RHO_MAX), theta: tuple[float, float] = (5.0, 95.0), edge: float = 0.0) -> DataFrame:
    """Rows with hits (array of structs with x, y, z, time_ns), with the solution of least total (sum of squared residuals
    / sigma^2), the first start among equals, in place of a fit before: rho, theta, phi, total and the source sx, sy, sz.

    `needs` names the columns that `starts` reads. Zeniths above 90 are folded.
    """
    kept = [f for f in rows.schema.fields if f.name not in SOLVED]
    schema = T.StructType([*kept, *[T.StructField(k, T.DoubleType()) for k in SOLVED[:4]]])
    at = {k: rows.columns.index(k) for k in ("hits", *needs)}
    rest = [rows.columns.index(f.name) for f in kept]

    def best(hits: pa.ListArray, col: dict[str, np.ndarray]) -> np.ndarray:
        size = np.array(hits.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        flat = hits.flatten()
        values = np.stack([flat.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "z", "time_ns")], -1).astype(float)
        w = np.arange(size.max())[None, :] < size[:, None]
        padded = np.zeros((*w.shape, 4))
        padded[w] = values
        t = padded[..., 3]
        t = (t - t.sum(1, keepdims=True) / size[:, None]) * w
        first = starts(col)
        n, k = first.shape[:2]
        u, total = solve_sources(first.reshape(n * k, 3), padded[..., :3], t, w, of=np.repeat(np.arange(n), k), c=c, rho=rho, theta=theta, edge=edge)
        pick = np.arange(n) * k + total.reshape(n, k).argmin(1)
        return np.column_stack([u[pick], total[pick]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = whole.column(at["hits"]).value_lengths().to_numpy(zero_copy_only=False)
            found = np.empty((whole.num_rows, 4))
            # Rows of the same size are solved together, larger ones with up to an eighth more, so that hardly any are padded.
            like = np.where(size <= 12, size, 100 + np.ceil(8 * np.log2(np.maximum(size, 1))))
            for kind in np.unique(like):
                part = np.flatnonzero(like == kind)
                b = whole.take(pa.array(part))
                found[part] = best(b.column(at["hits"]), {n: b.column(at[n]).to_numpy(zero_copy_only=False).astype(float) for n in needs})
            yield pa.RecordBatch.from_arrays([*(whole.column(i) for i in rest), *[pa.array(found[:, i]) for i in range(4)]], schema.names)

    solved = rows.mapInArrow(run, schema)
    fold = F.when(F.col("theta") > 90.0, 180.0 - F.col("theta")).otherwise(F.col("theta"))
    t, p = F.radians("theta"), F.radians("phi")
    return solved.withColumn("theta", fold).withColumns({"sx": F.col("rho") * F.sin(t) * F.cos(p), "sy": F.col("rho") * F.sin(t) * F.sin(p), "sz": F.col("rho") * F.cos(t)})


def _seeded(hits: DataFrame, plane: DataFrame, least: int) -> DataFrame:
    seeds = plane.select(*EVENT, F.col("azimuth").alias("seed_phi"), F.col("zenith").alias("seed_theta"))
    return gather(hits, least).join(seeds, EVENT)


def fit(hits: DataFrame, plane: DataFrame, *, least: int = 5, starts: list[tuple[float, float, float]] | None = None, c: float = C_AIR, rho: tuple[float, float] = (RHO_MIN, RHO_MAX), theta: tuple[float, float] = (5.0, 95.0), floor: float = 0.0, fallback: float = PLANE_FALLBACK) -> DataFrame:
    """Point-source fit of every event of at least `least` hits that has a plane-wave fit: rho, theta, phi, sx, sy, sz,
    chi_square (over n - 4), fit_status and the hits.

    Where even the best start leaves a chi square above `fallback` the plane wave's direction at 100 km stands in.
    """
    events = _seeded(hits, plane, least)
    out = solve_best(events, relative_to_seed(starts or STARTS), ["seed_phi", "seed_theta"], c=c, rho=rho, theta=theta)
    chi = F.greatest(F.col("total") / F.greatest(F.size("hits") - 4, F.lit(1)), F.lit(floor))
    bad = chi > fallback
    t, p = F.radians("seed_theta"), F.radians("seed_phi")
    back = {"sx": F.sin(t) * F.cos(p), "sy": F.sin(t) * F.sin(p), "sz": F.cos(t)}
    return out.select(
        *EVENT,
        F.when(bad, FALLBACK_RHO).otherwise(F.col("rho")).alias("rho"),
        F.when(bad, F.col("seed_theta")).otherwise(F.col("theta")).alias("theta"),
        F.when(bad, F.col("seed_phi")).otherwise(F.col("phi")).alias("phi"),
        *[F.when(bad, FALLBACK_RHO * e).otherwise(F.col(k)).alias(k) for k, e in back.items()],
        chi.alias("chi_square"),
        F.when(bad, "plane_fallback").otherwise("fitted").alias("fit_status"),
        "seed_phi",
        "hits",
    )


def fit_four(hits: DataFrame, plane: DataFrame) -> DataFrame:
    """Fits of events of at least four hits with the analytic time origin and one degree of freedom."""
    return fit(hits, plane, least=4, starts=REFIT_FOUR)


def fit_single(hits: DataFrame, plane: DataFrame) -> DataFrame:
    """The fit from one start at 13 km along the plane wave."""
    return fit(hits, plane, starts=[(13e3, None, 0.0)], rho=(1.0, 1e9), theta=(0.0, 91.0))


def fit_penalised(hits: DataFrame, plane: DataFrame) -> DataFrame:
    """The variant in vacuum: nearer and higher sources only, eight starts along the seed's azimuth, chi square at least
    0.01, and no plane wave in its place; `remove_penalised` goes on from here."""
    starts = [(7.3e3, None, 0.0)] + [(3e4, t, 0.0) for t in (55.0, 60.0, 65.0, 70.0, 75.0)] + [(4e4, 80.0, 0.0), (2e4, 85.0, 0.0)]
    return fit(hits, plane, starts=starts, **PENALISED, floor=1e-2, fallback=float("inf"))


def edge_penalty(phi: Column, width: float = EDGE_WIDTH, strength: float = 1e3) -> Column:
    """The penalty of azimuths within `width` degrees of 0 or 360, rising with the square."""
    a = F.pmod(phi, F.lit(360.0))
    near = F.least(a, 360.0 - a)
    return F.when(near < width, strength * F.pow((width - near) / width, 2)).otherwise(F.lit(0.0))


def chi_square(hits: DataFrame, sources: DataFrame, fitted: int = 4, c: float = C_AIR) -> DataFrame:
    """Chi square of given sources sx, sy, sz: n * var(distance / c - t) / sigma^2 over n - fitted; one aggregation."""
    d = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2) + F.pow(F.col("z") - F.col("sz"), 2))
    r = d / F.lit(c) - F.col("time_ns")
    j = hits.join(sources.select(*EVENT, "sx", "sy", "sz"), EVENT)
    return j.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.var_pop(r) / F.lit(SIGMA * SIGMA)).alias("total")).select(*EVENT, "n", (F.col("total") / F.greatest(F.col("n") - fitted, F.lit(1))).alias("chi_square"))


def subsets(events: DataFrame, k: int) -> DataFrame:
    """A row for each way to leave k (one or two) hits out and keep at least four: hits (those that stay), gone (those that
    don't) and the subset's number. The index sets are made within the row, so an event may have any number of hits."""
    n = F.size("hits")
    one = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(i))
    two = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.array(i, j))))
    return _divided(events.where(n >= k + 4).select("*", F.posexplode(one if k == 1 else two).alias("subset", "out")), events.columns)


def _divided(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The hits of each row, divided into those that stay and those of its index set `out`."""
    part = lambda want: F.transform(F.filter(F.transform("hits", lambda h, i: F.struct(h.alias("h"), F.array_contains("out", i).alias("o"))), lambda s: s["o"] == want), lambda s: s["h"])
    return rows.select(*[c for c in columns if c != "hits"], "subset", part(False).alias("hits"), part(True).alias("gone"))


def removal_gains(u: np.ndarray, p: np.ndarray, t: np.ndarray, k: int, most: int, enough: float, c: float = C_AIR) -> tuple[np.ndarray, np.ndarray]:
    """The subsets of k hits (one or two) whose removal promises most, as (numbers, indices of the hits): the `most` of
    greatest gain, and all that take away at least `enough` of the sum of squares. An estimate only: the removal doesn't rely
    on it and refits all subsets.

    At the fit u = (1 / rho, theta, phi) the normal equations of all hits are kept; a hit or a pair is taken out of them by a
    downdate, so its gain needs its residuals and its entries of the hat matrix only, and no subset is formed.
    """
    n = len(p)
    r, j = (x[0] for x in _residuals(u[None], p[None], t[None], np.ones((1, n)), c))
    scale = np.linalg.norm(j, axis=0) + 1e-300
    q, s, _ = np.linalg.svd(j / scale, full_matrices=False)
    q = np.column_stack([q[:, s > 1e-9 * s.max(initial=0)], np.full(n, n**-0.5)])
    own = np.maximum(1 - (q**2).sum(1), 1e-9)
    total = max(float(r @ r), 1e-300)
    if k == 1:
        gain = r**2 / own
        best = np.union1d(np.argsort(-gain, kind="stable")[:most], np.flatnonzero(gain >= enough * total))
        return best, best[:, None]
    kept: list[np.ndarray] = []
    step = max(1, (1 << 20) // n)
    for low in range(0, n, step):
        i = np.arange(low, min(low + step, n))
        h = q[i] @ q.T
        gain = (own[None, :] * r[i, None] ** 2 + 2 * h * r[i, None] * r[None, :] + own[i, None] * r[None, :] ** 2) / np.maximum(own[i, None] * own[None, :] - h**2, 1e-12)
        gain = np.where(np.arange(n)[None, :] > i[:, None], gain, -1.0)
        at = np.argsort(-gain.ravel(), kind="stable")[:most]
        at = np.union1d(at, np.flatnonzero(gain.ravel() >= enough * total))
        at = at[gain.ravel()[at] >= 0]
        kept.append(np.column_stack([gain.ravel()[at], i[at // n], at % n]))
    found = np.concatenate(kept)
    found = found[np.argsort(-found[:, 0], kind="stable")]
    found = found[(np.arange(len(found)) < most) | (found[:, 0] >= enough * total)]
    i, j2 = found[:, 1].astype(np.int64), found[:, 2].astype(np.int64)
    return i * n - i * (i + 1) // 2 + j2 - i - 1, np.column_stack([i, j2])


def promising_subsets(events: DataFrame, k: int, most: int, enough: float) -> DataFrame:
    """`subsets`, but only those of `removal_gains` around each event's fit (rho, theta, phi), chosen where the event's row
    is; the hits are divided afterwards, so an event of many hits becomes `most` rows or little more."""
    keep = events.columns
    at = {c: keep.index(c) for c in ("hits", "rho", "theta", "phi")}
    schema = T.StructType([*events.schema.fields, T.StructField("subset", T.IntegerType()), T.StructField("out", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(whole.num_rows):
                b = whole.slice(row, 1)
                hits = b.column(at["hits"]).flatten()
                v = np.stack([hits.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "time_ns")], -1).astype(float)
                rho, theta, phi = (float(b.column(at[c])[0].as_py()) for c in ("rho", "theta", "phi"))
                numbers, out = removal_gains(np.array([1 / rho, np.radians(theta), np.radians(phi)]), v[:, :3], v[:, 3] - v[:, 3].mean(), k, most, enough)
                for low in range(0, len(numbers), 256):
                    part = slice(low, low + 256)
                    again = pa.array(np.zeros(len(numbers[part]), np.int64))
                    yield pa.RecordBatch.from_arrays([*(c.take(again) for c in b.columns), pa.array(numbers[part], pa.int32()), pa.array(out[part].tolist(), pa.list_(pa.int32()))], schema.names)

    return _divided(events.mapInArrow(run, schema), keep)


def _confirmed(c: float = C_AIR) -> Column:
    """Whether every removed hit lies more than 3 sigma off the refit of the others."""
    d = lambda h: F.sqrt(F.pow(h["x"] - F.col("sx"), 2) + F.pow(h["y"] - F.col("sy"), 2) + F.pow(h["z"] - F.col("sz"), 2)) / F.lit(c) - h["time_ns"]
    mean = F.aggregate("hits", F.lit(0.0), lambda s, h: s + d(h)) / F.size("hits")
    return F.forall("gone", lambda h: F.abs(d(h) - mean) > CONFIRM)


def sets_out(n: int, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the ways to leave k (one or two) of n hits out those numbered low to high - 1, as in `subsets`: the indices of the
    hits that go and of those that stay, a row for each."""
    numbers = np.arange(low, high)
    if k == 1:
        out = numbers[:, None]
    else:
        i = np.arange(n - 1)
        before = i * n - i * (i + 1) // 2
        first = np.searchsorted(before, numbers, side="right") - 1
        out = np.column_stack([first, numbers - before[first] + first + 1])
    stay = np.arange(n - k)[None, :]
    for c in range(k):
        stay = stay + (stay >= out[:, c, None])
    return out, stay


def best_removal(v: np.ndarray, seed_phi: np.ndarray, chi: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Of events of n hits each (v: events x n x (x, y, z, time_ns)) the best of the ways low to high - 1 to leave k hits out
    that pass the gate: its number (-1: none passes), rho, theta and phi, the source, and its chi square.

    All of them are refitted, from all starts, at most STARTS_TOGETHER starts and HITS_TOGETHER hits at a time.
    """
    n = v.shape[1]
    four = n - k == 4
    starts = relative_to_seed(REFIT_FOUR if four else REFIT)
    number, best = np.full(len(v), -1, np.int64), np.full(len(v), np.inf)
    fit, source = np.zeros((len(v), 3)), np.zeros((len(v), 3))
    rows = max(1, min(STARTS_TOGETHER // len(REFIT), HITS_TOGETHER // n))
    for begin in range(low, high, rows):
        end = min(begin + rows, high)
        out, stay = sets_out(n, k, begin, end)
        m = end - begin
        together = max(1, rows // m)
        for at in range(0, len(v), together):
            part = v[at : at + together]
            kept = part[:, stay].reshape(-1, n - k, 4)
            p, t = kept[..., :3], kept[..., 3]
            first = starts({"seed_phi": np.repeat(seed_phi[at : at + together], m)})
            each = first.shape[1]
            u, total = solve_sources(first.reshape(-1, 3), p, t - t.mean(1, keepdims=True), np.ones(t.shape, bool), of=np.repeat(np.arange(len(kept)), each))
            pick = np.arange(len(kept)) * each + total.reshape(-1, each).argmin(1)
            u, new = u[pick], total[pick] / max(n - k - 4, 1)
            u[:, 1] = np.where(u[:, 1] > 90.0, 180.0 - u[:, 1], u[:, 1])
            th, ph = np.radians(u[:, 1]), np.radians(u[:, 2])
            s = u[:, :1] * np.column_stack([np.sin(th) * np.cos(ph), np.sin(th) * np.sin(ph), np.cos(th)])
            passed = new < np.repeat((GATE_TO_FOUR if four else GATE) * chi[at : at + together], m)
            if not four:
                late = lambda h, s=s: np.sqrt(((h[..., :3] - s[:, None, :]) ** 2).sum(2)) / C_AIR - h[..., 3]
                passed &= (np.abs(late(part[:, out].reshape(-1, k, 4)) - late(kept).mean(1, keepdims=True)) > CONFIRM).all(1)
            new = np.where(passed, new, np.inf).reshape(-1, m)
            least = new.argmin(1)
            value, where = new[np.arange(len(part)), least], np.arange(len(part)) * m + least
            # Blocks come in the order of their numbers, so that the first of equals stands.
            better = np.flatnonzero(value < best[at : at + together])
            number[at + better], best[at + better] = begin + least[better], value[better]
            fit[at + better], source[at + better] = u[where[better]], s[where[better]]
    return number, fit, source, best


def _values(hits: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of lists of hits, and x, y, z, time_ns of all hits."""
    flat = hits.flatten()
    return np.array(hits.value_lengths().to_numpy(zero_copy_only=False), np.int64), np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "time_ns")], -1).astype(float)


def _blocks(todo: DataFrame, k: int) -> DataFrame:
    """A row for each block of the ways to leave k hits out (numbers low to high - 1), dealt to tasks; a block holds BLOCK
    hits of subsets at most, or one subset, so an event of many hits is spread and no subset is formed here."""
    n = F.size("hits").cast("long")
    ways = n if k == 1 else F.expr("cast(size(hits) as long) * (size(hits) - 1) div 2")
    each = F.greatest(F.lit(1).cast("long"), F.lit(BLOCK) / n).cast("long")
    cut = todo.where(n >= k + 4).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1, each))).withColumn("high", F.least(F.col("low") + each, ways))
    tasks = cut.count()
    least = todo.sparkSession.sparkContext.defaultParallelism
    return cut.repartition(max(1, min(tasks, least), -(-tasks // 64)), *EVENT, "low")


def _round(todo: DataFrame, k: int, exhaustive: bool = False) -> DataFrame:
    """For each outlying event the best way to leave out k hits that passes its gate, or none. All subsets are refitted, in
    blocks of an event's; `exhaustive` is the plain form, with a row for each subset."""
    columns = [*EVENT, "chi_square", "seed_phi", "hits"]
    rows = todo.select(*columns)
    if exhaustive:
        return _round_plain(subsets(rows, k))
    blocks = _blocks(rows, k)
    fields = [*rows.schema.fields, T.StructField("subset", T.LongType()), T.StructField("out", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in ("rho", "theta", "phi", "sx", "sy", "sz")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, v = _values(b.column(4))
            ends = np.cumsum(size)
            chi, seed, low, high = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 5, 6))
            found, chosen = [], []
            # Events of as many hits are solved together, as their blocks are the same.
            kinds, at = np.unique(np.column_stack([size, low, high]), axis=0, return_inverse=True)
            for kind, (n, first, last) in enumerate(kinds.tolist()):
                g = np.flatnonzero(at.ravel() == kind)
                number, fit, source, new = best_removal(v[(ends[g] - n)[:, None] + np.arange(n)], seed[g], chi[g].astype(float), k, first, last)
                ok = np.flatnonzero(number >= 0)
                found.append(g[ok])
                out = sets_out(n, k, first, last)[0][number[ok] - first]
                chosen.append((number[ok], out.tolist(), new[ok], fit[ok], source[ok]))
            take = pa.array(np.concatenate(found)) if found else pa.array([], pa.int64())
            kept = [b.column(i).take(take) for i in range(5)]
            join = lambda i: np.concatenate([c[i] for c in chosen]) if chosen else np.zeros((0, 3))
            outs = [x for c in chosen for x in c[1]]
            more = [*join(3).T, *join(4).T]
            kept[2] = pa.array(join(2).ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(join(0).ravel().astype(np.int64)), pa.array(outs, pa.list_(pa.int32())), *[pa.array(c, pa.float64()) for c in more]], schema.names)

    passed = blocks.select(*columns, "low", "high").mapInArrow(run, schema)
    rest = [c for c in passed.columns if c not in EVENT]
    best = passed.groupBy(*EVENT).agg(F.min_by(F.struct(*rest), F.struct("chi_square", "subset")).alias("b")).select(*EVENT, "b.*")
    return _divided(best, best.drop("subset", "out").columns).select(*EVENT, "rho", "theta", "phi", "sx", "sy", "sz", "chi_square", "seed_phi", "hits", "gone")


def _round_plain(tried: DataFrame) -> DataFrame:
    """The best of subsets that are rows."""
    four = F.size("hits") == 4
    wide = solve_best(tried.where(~four), relative_to_seed(REFIT), ["seed_phi"])
    few = solve_best(tried.where(four), relative_to_seed(REFIT_FOUR), ["seed_phi"])
    refit = wide.unionByName(few)
    new = F.col("total") / F.greatest(F.size("hits") - 4, F.lit(1))
    less = new < F.when(four, GATE_TO_FOUR).otherwise(GATE) * F.col("chi_square")
    gate = less & (four | _confirmed())
    passed = refit.withColumn("new", new).where(gate)
    best = F.min_by(F.struct("rho", "theta", "phi", "sx", "sy", "sz", F.col("new").alias("chi_square"), "seed_phi", "hits", "gone"), F.struct("new", "subset"))
    return passed.groupBy(*EVENT).agg(best.alias("b")).select(*EVENT, "b.*")


def _pruned(state: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """All rounds of the events of a batch, one after the other, where the events are: those that are still outlying go on.

    It gives what the rounds of tables give, without a job and two tables for each. `state` has the columns of `_rounds`.
    """
    at = {c: state.columns.index(c) for c in state.columns}
    fitted = ("rho", "theta", "phi", "sx", "sy", "sz", "chi_square")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(at["hits"])
            size, v = _values(hits)
            du = hits.flatten().field("du_id").to_numpy(zero_copy_only=False)
            col = {c: np.array(b.column(at[c]).to_numpy(zero_copy_only=False), float) for c in (*fitted, "seed_phi")}
            # The hits that stay, by event, in front.
            stay = np.cumsum(size)[:, None] - size[:, None] + np.arange(size.max(initial=0))
            removed = [list(x) for x in b.column(at["removed"]).to_pylist()]
            for k in sizes:
                todo = np.arange(len(size))
                while len(todo):
                    todo = todo[(col["chi_square"][todo] > OUTLYING) & (size[todo] >= 4 + k)]
                    changed = [todo[:0]]
                    for n in np.unique(size[todo]).tolist():
                        g = todo[size[todo] == n]
                        ways = n if k == 1 else n * (n - 1) // 2
                        number, fit, source, new = best_removal(v[stay[g, :n]], col["seed_phi"][g], col["chi_square"][g], k, 0, ways)
                        ok = np.flatnonzero(number >= 0)
                        e = g[ok]
                        out, rest = sets_out(n, k, 0, ways)
                        for i, gone in zip(e.tolist(), du[np.take_along_axis(stay[e], out[number[ok]], 1)].tolist(), strict=True):
                            removed[i] += gone
                        stay[e, : n - k] = np.take_along_axis(stay[e], rest[number[ok]], 1)
                        size[e] -= k
                        for i, c in enumerate(fitted):
                            col[c][e] = [*fit.T, *source.T, new][i][ok]
                        changed.append(e)
                    todo = np.concatenate(changed)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            left = stay[np.arange(stay.shape[1]) < size[:, None]]
            new = {c: pa.array(col[c]) for c in fitted}
            new["hits"] = pa.ListArray.from_arrays(offsets, hits.flatten().take(pa.array(left)))
            new["removed"] = pa.array(removed, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(i)) for c, i in at.items()], list(at))

    return state.mapInArrow(run, state.schema)


def _round_penalised(todo: DataFrame, k: int) -> DataFrame:
    """For each outlying event the refit of the penalised variant that leaves one hit out and passes its gate, or none.

    Of more than five hits the first refit that passes counts, in the order of the hits' residuals; of five that of the
    largest residual, but above ALL_FOURS the best of all that pass comes first. The chi square includes the penalty.
    """
    d = lambda h: F.sqrt(F.pow(h["x"] - F.col("sx"), 2) + F.pow(h["y"] - F.col("sy"), 2) + F.pow(h["z"] - F.col("sz"), 2)) / F.lit(C_VACUUM) - h["time_ns"]
    off = F.transform("hits", d)
    mean = F.aggregate("off", F.lit(0.0), lambda s, v: s + v) / F.size("off")
    ordered = F.array_sort(F.transform("off", lambda v, i: F.struct((-F.abs(v - mean)).alias("v"), i.alias("i"))))
    fits = todo.select(*EVENT, "chi_square", "seed_phi", "rho", "theta", "phi", "sx", "sy", "sz", "hits").withColumn("off", off).withColumn("order", F.transform(ordered, lambda s: s["i"])).drop("off")
    tried = subsets(fits, k).withColumn("place", F.array_position("order", F.col("subset"))).drop("order")
    four = F.size("hits") == 4
    turns = [(0, tried.where(four & (F.col("chi_square") > ALL_FOURS)), AROUND_FOURS), (1, tried.where(four & (F.col("place") == 1)), AROUND_FOUR), (1, tried.where(~four), AROUND)]
    solved = [solve_best(rows.withColumn("turn", F.lit(turn)), around_fit(around, PENALISED["theta"]), ["rho", "theta", "phi"], **PENALISED, edge=EDGE_STRENGTH) for turn, rows, around in turns]
    refit = reduce(DataFrame.unionByName, solved)
    new = F.col("total") / F.greatest(F.size("hits") - 4, F.lit(1))
    passed = refit.withColumn("new", new).where(F.col("new") < GATE_PENALISED * F.col("chi_square"))
    first = F.struct("turn", F.when(F.col("turn") == 0, F.col("new")).otherwise(F.col("place")), "subset")
    best = F.min_by(F.struct("rho", "theta", F.pmod("phi", F.lit(360.0)).alias("phi"), "sx", "sy", "sz", F.col("new").alias("chi_square"), "seed_phi", "hits", "gone"), first)
    return passed.groupBy(*EVENT).agg(best.alias("b")).select(*EVENT, "b.*")


def remove_outliers(fits: DataFrame, checkpoint, *, pairs: bool = True, exhaustive: bool = False) -> DataFrame:
    """Fits after removal of outlying hits, with removed (their detectors).

    While an event's chi square exceeds 10, single hits are left out in turn and the best refit that passes its gate is
    kept; then pairs of hits, for events that are still outlying. Each time all subsets are refitted.

    Outlying events take all their rounds where they are. Those with more than LARGE pairs go through tables instead, a round
    for all of them at once, in which their subsets are dealt to tasks in blocks; each round removes hits of an event or sets it
    aside, so there are at most as many as an event has hits. `checkpoint` (DataFrame, name -> DataFrame) cuts the lineage.
    `exhaustive` takes the plain form of a round for all, with a row for each subset.
    """
    sizes = (1, 2) if pairs else (1,)
    if exhaustive:
        return _rounds(fits, checkpoint, sizes, partial(_round, exhaustive=True))
    n = F.size("hits").cast("long")
    outlying = F.coalesce((F.col("fit_status") == "fitted") & (F.col("chi_square") > OUTLYING) & (n >= 5), F.lit(False))
    large = n * (n - 1) / 2 > LARGE
    begun = fits.withColumn("removed", F.array().cast("array<int>")).select(*_STATE)
    counts = begun.where(outlying).agg(F.count_if(~large).alias("few"), F.count_if(large).alias("many")).first()
    done = [begun.where(~outlying)]
    if counts.few:
        # Refits take far longer than a shuffle, so tasks of the same size pay.
        tasks = max(min(4 * fits.sparkSession.sparkContext.defaultParallelism, -(-counts.few // 500)), -(-counts.few // EVENTS_A_TASK))
        done.append(checkpoint(_pruned(begun.where(outlying & ~large).repartition(tasks, *EVENT), sizes), "pruned"))
    if counts.many:
        done.append(_rounds(fits.where(outlying & large), checkpoint, sizes, _round))
    return reduce(DataFrame.unionByName, done)


def remove_penalised(fits: DataFrame, checkpoint) -> DataFrame:
    """The same after `fit_penalised`: single hits are left out, with refits in vacuum under the azimuth penalty."""
    done = _rounds(fits, checkpoint, (1,), _round_penalised)
    return done.withColumn("chi_square", F.greatest(F.col("chi_square"), F.lit(FLOOR_PENALISED)))


_STATE = [*EVENT, "rho", "theta", "phi", "sx", "sy", "sz", "chi_square", "fit_status", "seed_phi", "hits", "removed"]


def _rounds(fits: DataFrame, checkpoint, sizes: tuple[int, ...], attempt) -> DataFrame:
    """A round carries the events that are still outlying, and nothing else; the others are left where they are written."""
    state = fits.withColumn("removed", F.array().cast("array<int>")).select(*_STATE)
    for k in sizes:
        state = checkpoint(state, f"state-{k}")
        outlying = (F.col("fit_status") == "fitted") & (F.col("chi_square") > OUTLYING) & (F.size("hits") >= 4 + k)
        done, todo, turn = [state.where(~outlying)], state.where(outlying), 0
        while True:
            turn += 1
            better = checkpoint(attempt(todo, k), f"better-{k}-{turn}")
            done.append(todo.join(better.select(*EVENT), EVENT, "left_anti"))
            if better.limit(1).count() == 0:
                break
            removed = F.concat("removed", F.transform("gone", lambda h: h["du_id"]))
            changed = checkpoint(better.join(todo.select(*EVENT, "removed", "fit_status"), EVENT).withColumn("removed", removed).select(*_STATE), f"changed-{k}-{turn}")
            done.append(changed.where(~outlying))
            todo = changed.where(outlying)
        state = reduce(DataFrame.unionByName, done)
    return state


def source_hits(fits: DataFrame) -> DataFrame:
    """The hits that each fit kept."""
    return scatter(fits)
