"""Minimising a quadratic form over the unit sphere, for batches of rows.

n'An - 2h'n with |n| = 1 and a symmetric A without negative eigenvalues. The eigenvalues come from the cubic's closed form
by a cosine, the vector of the one that stands apart from a cross product, the other two from the angle of a 2 x 2 problem
beside it, which is defined for equal eigenvalues too. In the eigenbasis n = g / (d + t), where d counts the eigenvalues
from the least and t is found by Newton steps: from the left of the global minimum's root on 1 / |n|, which is nearly
linear, and from the right of a second local minimum's root on the convex |n|^2.

An Arrow batch is solved with arrays over its rows. As column expressions the same steps took 14 times as long (16.7 s, not
1.2 s, for 489,498 rows on 8 cores): fused into one method they are slow, and folds of lambdas are interpreted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Newton steps of both roots; the iterations are monotone. Rows that are above 1 by no more than SETTLED take none.
STEPS, SETTLED = 40, 1e-14
#: Below this share of the greatest eigenvalue the second one is 0: the points stand on a line.
ON_A_LINE = 1e-12
#: Below this share of the greatest term the component along the first eigenvector is 0.
MIRROR = 1e-9

ENTRIES = ("xx", "xy", "xz", "yy", "yz", "zz")


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising and none below 0 (3 x rows), and their vectors (3 x axes x rows) of 3 x 3 x rows."""
    q = (a[0, 0] + a[1, 1] + a[2, 2]) / 3
    x, y, z = (a[i, i] - q for i in range(3))
    xy, xz, yz = a[0, 1], a[0, 2], a[1, 2]
    p = np.sqrt((x * x + y * y + z * z + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = x * (y * z - yz * yz) - xy * (xy * z - yz * xz) + xz * (xy * yz - y * xz)
    phi = np.where(p > 0, np.arccos(np.clip(det / (2 * p * p * p), -1, 1)) / 3, 0.0)
    most, few = q + 2 * p * np.cos(phi), q + 2 * p * np.cos(phi + 2 * np.pi / 3)
    apart = np.where(3 * q - most - 2 * few >= 2 * most - 3 * q + few, few, most)
    shifted = a - apart * np.eye(3)[:, :, None]
    normals = np.stack([_cross(shifted[i], shifted[j]) for i, j in ((0, 1), (0, 2), (1, 2))])
    sizes = np.stack([_dot(n, n) for n in normals])
    size, longest = np.sqrt(sizes.max(0)), np.take_along_axis(normals, sizes.argmax(0)[None, None], 0)[0]
    w = np.where(size > 1e-150, longest / size, np.array([0.0, 0.0, 1.0])[:, None])
    none = np.zeros_like(q)
    u = np.where(np.abs(w[0]) > np.abs(w[1]), np.stack([-w[2], none, w[0]]), np.stack([none, w[2], -w[1]]))
    u = u / np.sqrt(_dot(u, u))
    v = _cross(w, u)
    along = lambda b, c: _dot(b, np.stack([_dot(row, c) for row in a]))
    uu, uv, vv, ww = along(u, u), along(u, v), along(v, v), along(w, w)
    turn, mean, half = np.arctan2(2 * uv, uu - vv) / 2, (uu + vv) / 2, np.sqrt((uu - vv) * (uu - vv) / 4 + uv * uv)
    lam = np.maximum(np.stack([ww, mean + half, mean - half]), 0.0)
    own = np.stack([w, np.cos(turn) * u + np.sin(turn) * v, np.cos(turn) * v - np.sin(turn) * u])
    order = lam.argsort(0, kind="stable")
    return np.take_along_axis(lam, order, 0), np.take_along_axis(own, order[:, None], 0)


def _powers(g: np.ndarray, d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|n|^2 of the multipliers t, and minus half its slope."""
    e = d + t
    square = g * g / (e * e)
    return square.sum(0), (square / e).sum(0)


def _global_root(g: np.ndarray, d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """From the left of the root, where 1 / |n| grows almost linearly."""
    t, rows = t.copy(), np.arange(len(t))
    for _ in range(STEPS):
        norm, slope = _powers(g[:, rows], d[:, rows], t[rows])
        go = (norm > 1 + SETTLED) & (slope > 0)
        if not go.any():
            break
        rows, norm, slope = rows[go], norm[go], slope[go]
        t[rows] += (np.sqrt(norm) - 1) * norm / slope
    return t


def _second_root(g: np.ndarray, d: np.ndarray, t: np.ndarray, tiny: np.ndarray) -> np.ndarray:
    """From the right of the root, where |n|^2 - 1 is convex; once its minimum is passed there is none (NaN)."""
    t, rows = t.copy(), np.arange(len(t))
    for _ in range(STEPS):
        norm, slope = _powers(g[:, rows], d[:, rows], t[rows])
        above = norm > 1
        t[rows[~((slope < 0) & (~above | (t[rows] > tiny[rows] - d[1, rows])))]] = np.nan
        go = above & (norm > 1 + SETTLED) & ~np.isnan(t[rows])
        if not go.any():
            break
        rows, norm, slope = rows[go], norm[go], slope[go]
        t[rows] += (norm - 1) / (2 * slope)
    return t


def solve(form: np.ndarray, line: np.ndarray, prefer: float = 1e-6) -> np.ndarray:
    """The unit vectors (3 x rows) of `least_on_sphere` for the ENTRIES of A (6 x rows) and h (3 x rows); NaN where it has null."""
    with np.errstate(all="ignore"):
        scale = form[0] + form[3] + form[5]
        scale = np.where(scale > 0, scale, np.nan)
        xx, xy, xz, yy, yz, zz = form / scale
        lam, own = _eigen(np.stack([np.stack(r) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))]))
        g = np.stack([_dot(e, line / scale) for e in own])
        d = lam - lam[0]
        big = np.maximum(lam[2], np.sqrt(_dot(g, g)))
        tiny = 1e-13 * big + 1e-300
        first = np.maximum.reduce([np.abs(g[0]), np.abs(g[1]) - d[1], np.abs(g[2]) - d[2], tiny])
        r1, r2 = g[1] / np.maximum(d[1], tiny), g[2] / np.maximum(d[2], tiny)
        on_line, mirror = lam[1] <= ON_A_LINE * lam[2], (np.abs(g[0]) <= MIRROR * big) & (r1 * r1 + r2 * r2 < 1)
        second = np.where((g[0] != 0) & (d[1] > tiny), -np.maximum(np.abs(g[0]), tiny), np.nan)
        found = np.stack([g / (d + _global_root(g, d, first)), g / (d + _second_root(g, d, second, tiny))])
        spare = np.sqrt(np.maximum(1 - r1 * r1 - r2 * r2, 0.0))
        found = np.where(mirror, np.stack([np.stack([spare, r1, r2]), np.stack([-spare, r1, r2])]), found)
        # On a line only the last component counts; what is left of the unit vector points up as steeply as it can.
        along, steep = np.clip(g[2] / np.maximum(lam[2], tiny), -1, 1), np.hypot(own[0, 2], own[1, 2])
        rim = np.sqrt(np.maximum(1 - along * along, 0.0))
        cone = np.stack([rim * np.where(steep > 1e-9, own[0, 2] / steep, 1.0), rim * np.where(steep > 1e-9, own[1, 2] / steep, 0.0), along])
        found = np.where(on_line, np.stack([cone, np.full_like(cone, np.nan)]), found)
        size = np.stack([_dot(n, n) for n in found])
        unit = found / np.sqrt(np.where(size > 0.25, size, np.nan))[:, None]
        value = np.stack([(lam * e * e - 2 * g * e).sum(0) for e in unit])
        turned = np.stack([np.stack([_dot(e, own[:, k]) for k in range(3)]) for e in unit])
        low = np.fmin(value[0], value[1])
        good = value <= low + prefer * np.maximum(np.abs(low), 1e-12)
        (ax, ay, az), (bx, by, bz) = np.round(turned, 9)
        later = (bz > az) | ((bz == az) & ((bx > ax) | ((bx == ax) & (by > ay))))
        return np.where(good[1] & (later | ~good[0]), turned[1], turned[0])


def least_on_sphere(rows: DataFrame, form: dict[str, str], line: list[str], prefer: float = 1e-6) -> DataFrame:
    """`rows` with nx, ny, nz: the unit vector that minimises n'An - 2h'n, for the entries xx, xy, xz, yy, yz, zz of A and
    the vector h, all SQL expressions.

    Of solutions that are worse than the best by at most `prefer`, relatively, the one of the greatest nz is taken, then of
    the greatest nx and ny (to 9 digits). Without a component along the first eigenvector the solutions are a mirror pair;
    where the points stand on a line, all directions of a cone are solutions, of which the steepest upward one is taken.
    Null where an entry is null, and for points without any extent.
    """

    @F.pandas_udf("nx double, ny double, nz double")
    def direction(*columns: pd.Series) -> pd.DataFrame:
        entries = np.stack([c.to_numpy(float) for c in columns])
        return pd.DataFrame(solve(entries[:6], entries[6:], prefer).T, columns=["nx", "ny", "nz"])

    found = rows.select("*", direction(*[F.expr(form[k]) for k in ENTRIES], *map(F.expr, line)).alias("sphere_found"))
    # A generator ends the chain: filters on the result stay above it, rather than solving the rows once more below.
    return found.selectExpr(*[f"`{c}`" for c in rows.columns], "inline(array(sphere_found))")
