"""Quality cuts on an event's footprint."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import EVENT
from pulsegrid.functions.geometry import distance_limit, incident_azimuth, incident_zenith

#: Fixed values of the footprint cut: opening of the emission cone and largest elongation, factors of the three tests, and
#: coefficients of their dependence on 1 / cos(zenith).
CONE_DEG, MOST_ELONGATED = 2.0, 15.0
SHAPE, SHAPE_SEC = 1.5, (0.9236, 0.2798, 0.0542)
SPREAD, INSIDE = 1.8, 0.8
TIME, TIME_SEC = 2.0, (-60.321, 41.1506, 2.3754, 80.0)
LOW_DETECTORS, RING_DETECTORS, RING_MEAN = 4, 6, 700.0


def _turned(rows: DataFrame, *keep: str) -> DataFrame:
    """Event, `keep`, vx, vy, vz and what turns hits into the axes of that arrival vector."""
    norm = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    # A vector of no length has no direction; its event has no axes.
    unit = rows.select(*EVENT, *keep, "vx", "vy", "vz", *[F.when(norm >= 1e-12, F.col(f"v{k}") / norm).alias(f"u{k}") for k in "xyz"])
    az = F.radians(incident_azimuth(F.col("ux"), F.col("uy"), F.col("uz")))
    slope = lambda c: F.when(F.abs("uz") > 0.05, F.col(c) / F.col("uz")).otherwise(F.lit(0.0))
    return unit.select(*EVENT, *keep, "vx", "vy", "vz", F.col("ux").isNotNull().alias("directed"), F.cos(az).alias("c"), F.sin(az).alias("s"), slope("ux").alias("kx"), slope("uy").alias("ky"), incident_zenith(F.col("ux"), F.col("uy"), F.col("uz")).alias("zenith"))


def _measured(hits: DataFrame, fits: DataFrame | None) -> DataFrame:
    """One row per event that has a fit, with what both cuts need of its hits.

    Means are windows over the event and the sums are grouped by it, so hits are shuffled once. They move along the arrival
    vector to their mean height, which leaves their means where they are, and turn so that the first axis lies along
    the incident direction. Without `fits` the hits have vx, vy, vz themselves, the same in an event, and nothing is joined.
    """
    w = W.partitionBy(*EVENT)
    away = hits.select(*EVENT, "time_ns", *[(F.col(k) - F.avg(k).over(w)).alias(f"d{k}") for k in "xyz"], *(["vx", "vy", "vz"] if fits is None else []))
    off = _turned(away, "time_ns", "dx", "dy", "dz") if fits is None else away.join(_turned(fits), EVENT)
    px, py = F.col("dx") - F.col("dz") * F.col("kx"), F.col("dy") - F.col("dz") * F.col("ky")
    axes = off.select(*EVENT, "vx", "vy", "vz", "directed", "zenith", "time_ns", F.hypot("dx", "dy").alias("away"), (px * F.col("c") + py * F.col("s")).alias("major"), (py * F.col("c") - px * F.col("s")).alias("minor"))
    p = lambda c: F.percentile(c, F.array(F.lit(0.05), F.lit(0.95)))
    return axes.groupBy(*EVENT, "vx", "vy", "vz", "directed", "zenith").agg(
        F.count(F.lit(1)).alias("n_du"),
        F.max("away").alias("d_max"),
        F.avg("away").alias("d_mean"),
        p("major").alias("pa"),
        p("minor").alias("pb"),
        F.regr_syy("time_ns", "major").alias("syy"),
        F.regr_sxy("time_ns", "major").alias("sxy"),
        F.regr_sxx("time_ns", "major").alias("sxx"),
        F.collect_list(F.struct("major", "minor")).alias("points"),
    )


def _with_footprint(measured: DataFrame, shape: float, spread: float, inside: float, time: float, *keep: str) -> DataFrame:
    """The diagnostics of events of at least four hits and a direction, their verdict as `keep`, and further columns of theirs."""
    events = measured.where((F.col("n_du") >= LOW_DETECTORS) & F.col("directed"))
    cos, cone = math.cos(math.radians(CONE_DEG)), math.cos(math.radians(CONE_DEG)) ** 2
    sin_z = F.sin(F.radians("zenith"))
    a, b = F.col("pa")[1] - F.col("pa")[0], F.col("pb")[1] - F.col("pb")[0]
    widths = events.select("*", a.alias("spread_major"), b.alias("spread_minor"), F.least(F.lit(cos) / F.sqrt(F.greatest(F.lit(cone) - sin_z * sin_z, F.lit(1e-12))), F.lit(MOST_ELONGATED)).alias("expected"), (1 / F.cos(F.radians("zenith"))).alias("sec"))
    half = lambda c: F.greatest(F.lit(spread) * F.col(c) / 2, F.lit(1e-6))
    within = F.size(F.filter("points", lambda q: F.pow(q["major"] / half("spread_major"), 2) + F.pow(q["minor"] / half("spread_minor"), 2) <= 1)) / F.size("points")
    rms = F.when(F.col("spread_major") > 1.0, F.sqrt(F.greatest((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / F.col("n_du"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    out = widths.select(*EVENT, *keep, "n_du", "zenith", "sec", "spread_major", "spread_minor", "expected", (F.col("spread_major") / F.greatest("spread_minor", F.lit(1e-6))).alias("observed"), within.alias("share_inside"), rms.alias("time_rms"))
    k0, k1, k2 = SHAPE_SEC
    t0, t1, t2, t3 = TIME_SEC
    s = F.col("sec")
    return out.select(
        "*",
        ((F.col("expected") / F.col("observed") < shape * (k0 + k1 * s + k2 * s * s)) & (F.round("observed", 9) > 1.0)).alias("shape_ok"),
        (F.col("share_inside") >= inside).alias("ellipse_ok"),
        (F.col("time_rms") <= time * (t0 + t1 * s + t2 * s * s + t3)).alias("time_ok"),
    ).withColumn("keep", F.col("shape_ok") & F.col("ellipse_ok") & F.col("time_ok"))


def _with_ring(measured: DataFrame, many: int, mean_limit: float) -> DataFrame:
    zen = incident_zenith(F.col("vx"), F.col("vy"), F.col("vz"))
    out = measured.withColumn("zenith", zen).withColumn("limit", distance_limit(F.col("zenith")))
    return out.withColumn("keep", F.coalesce((F.col("n_du") >= many) | ((F.col("d_max") <= F.col("limit")) & (F.col("d_mean") < mean_limit)), F.lit(False)))


def footprint(hits: DataFrame, fits: DataFrame | None = None, *, shape: float = SHAPE, spread: float = SPREAD, inside: float = INSIDE, time: float = TIME) -> DataFrame:
    """One row of diagnostics per event of at least four hits: spreads, elongations and the three tests.

    `fits` has an event's arrival vector vx, vy, vz; without it the hits have the columns themselves. Spreads are between the 5th and 95th percentile of the axes. The
    time residual is the scatter of the times about a line over the long axis. A vector of no length fails, and so does an
    elongation of 1, whatever noise a sum leaves beyond its ninth decimal.
    """
    return _with_footprint(_measured(hits, fits), shape, spread, inside, time)


def ring(hits: DataFrame, fits: DataFrame | None = None, *, many: int = RING_DETECTORS, mean_limit: float = RING_MEAN) -> DataFrame:
    """Events with d_max and d_mean from the centre of their hits; `keep` for many detectors, or for small distances."""
    return _with_ring(_measured(hits, fits), many, mean_limit).select(*EVENT, "d_max", "d_mean", "n_du", "zenith", "limit", "keep")


def apply_cuts(hits: DataFrame, fits: DataFrame | None = None, run_footprint: bool = True, run_ring: bool = True) -> DataFrame:
    """The events of `fits` that pass the cuts that are switched on; both see the whole input, and the hits are measured
    once for both. Without `fits` the hits have vx, vy, vz themselves, and the events come with these three."""
    if not (run_footprint or run_ring):
        return hits.select(*EVENT, "vx", "vy", "vz").distinct() if fits is None else fits
    kept = _measured(hits, fits)
    if run_ring:
        kept = _with_ring(kept, RING_DETECTORS, RING_MEAN).where("keep").select(*kept.columns)
    if run_footprint:
        kept = _with_footprint(kept, SHAPE, SPREAD, INSIDE, TIME, "vx", "vy", "vz").where("keep")
    if fits is None:
        return kept.select(*EVENT, "vx", "vy", "vz")
    return fits.join(kept.select(*EVENT), EVENT, "left_semi")


def cut_reasons(hits: DataFrame, fits: DataFrame, run_footprint: bool = True, run_ring: bool = True) -> DataFrame:
    """file, event_key and reason of every event of `fits`: which cut it fails (ring, footprint, or that it has too few hits
    to be measured); null where it passes those that are switched on."""
    measured = _measured(hits, fits)
    rung = _with_ring(measured, RING_DETECTORS, RING_MEAN).select(*EVENT, F.col("keep").alias("in_ring"))
    shaped = _with_footprint(measured, SHAPE, SPREAD, INSIDE, TIME).select(*EVENT, F.coalesce("keep", F.lit(False)).alias("in_shape"))
    j = fits.select(*EVENT).join(rung, EVENT, "left").join(shaped, EVENT, "left")
    why = F.when(F.lit(run_ring) & F.coalesce(~F.col("in_ring"), F.lit(False)), "ring").when(F.lit(run_footprint) & F.coalesce(~F.col("in_shape"), F.lit(False)), "footprint")
    return j.select(*EVENT, why.when(F.lit(run_ring or run_footprint) & F.col("in_ring").isNull(), "not measured").alias("reason"))


def cut_saved_fits(spark, fits_path: str, hits: DataFrame) -> DataFrame:
    """The cuts on a saved table of fits; rows without a direction are skipped."""
    return apply_cuts(hits, spark.read.parquet(fits_path).where("vx is not null and vy is not null and vz is not null"))


def reject_background(fits: DataFrame) -> DataFrame:
    """Fits that look like showers: small chi, inclined, and not from the direction and height of known sources."""
    return fits.where("chi_square < 500 and zenith > 50 and zenith < 85 and (azimuth < 40 or azimuth > 225 or abs(z / 1000 - 9) > 1.5)")
