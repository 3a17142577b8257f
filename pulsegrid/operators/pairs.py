"""Detector pairs: of a layout, of an event's hits, and the lookup between them.

A pair is ordered by its detectors' ids as strings, so the sign of a time difference goes with its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import C_AIR, EVENT
from pulsegrid.functions.geometry import distance
from pulsegrid.operators.hits import small


def layout_pairs(positions: DataFrame, c: float = C_AIR) -> DataFrame:
    """All pairs of a layout's detectors with distance and light travel time. A layout is some hundred detectors."""
    side = lambda n: [F.col(k).alias(f"{k}_{n}") for k in ("du_id", "x", "y", "z")]
    a, b = positions.select(*side("a")), small(positions.select(*side("b")))
    d = distance(*(F.col(f"{k}_{n}") for n in "ab" for k in "xyz"))
    near = a.join(b, F.col("du_id_a").cast("string") < F.col("du_id_b").cast("string"))
    return near.select(F.col("du_id_a").alias("du_a"), F.col("du_id_b").alias("du_b"), d.alias("distance_m")).withColumn("theoretical_delta_ns", F.col("distance_m") / F.lit(c))


def hit_pairs(hits: DataFrame) -> DataFrame:
    """The pairs of hits within each event with the signed time difference first minus second, and what stands on hits of
    x, y, z as the distance."""
    with_place = "x" in hits.columns
    cols = ["du_id", "time_ns", *(("x", "y", "z") if with_place else ())]
    side = lambda n: hits.select(*EVENT, *[F.col(c).alias(f"{c}_{n}") for c in cols])
    both = side("a").join(side("b"), EVENT).where(F.col("du_id_a").cast("string") < F.col("du_id_b").cast("string"))
    d = [distance(*(F.col(f"{k}_{n}") for n in "ab" for k in "xyz")).alias("distance_m")] if with_place else []
    return both.select(*EVENT, F.col("du_id_a").alias("du_a"), F.col("du_id_b").alias("du_b"), (F.col("time_ns_a") - F.col("time_ns_b")).alias("dt_ns"), *d)


def with_pair_distance(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs with the distance and travel time of a layout's pair table; null for pairs that it lacks."""
    return pairs.join(small(table), ["du_a", "du_b"], "left")
