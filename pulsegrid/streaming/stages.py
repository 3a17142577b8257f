"""Stateless stages on a stream of events: calibration, pairs, matching, plane waves.

An event is a row of file, event_key, gps_time and its hits, an array of structs in record order (hit_pos, du_id, time_ns, x, y,
z and what else they have). Every stage works within the row, so it takes a stream or a batch alike and needs neither
state nor a shuffle; small static tables are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import C_AIR, EVENT, MAX_RATIO, MIN_DETECTORS
from pulsegrid.functions.geometry import distance
from pulsegrid.operators import causality, planewave
from pulsegrid.operators.calibration import event_windows
from pulsegrid.operators.hits import BROADCAST_ROWS, small


#: A layout on a stream is searched in this many maps, by detector.
LAYOUT_PARTS = 1024


def place_stream(events: DataFrame, layout: DataFrame) -> DataFrame:
    """Events whose hits have x, y, z of a static layout; an event with a hit that it doesn't know is left out.

    Up to BROADCAST_ROWS detectors the layout is one row of the plan, of LAYOUT_PARTS small maps. A batch takes a larger one
    too, by a join of its hits; on a stream that would need state, so there it is an error: use it within foreachBatch.
    """
    if layout.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        if events.isStreaming:
            raise ValueError(f"a layout of more than {BROADCAST_ROWS} detectors takes batches: place_stream within foreachBatch")
        return _placed_by_join(events, layout)
    part = lambda d: F.pmod(d, F.lit(LAYOUT_PARTS)).cast("int")
    parts = layout.groupBy(part(F.col("du_id")).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("du_id", F.struct("x", "y", "z")))).alias("known"))
    known = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "known"))).alias("by_part"))
    known = known.select(F.transform(F.sequence(F.lit(0), F.lit(LAYOUT_PARTS - 1)), lambda i: F.try_element_at("by_part", i)).alias("known_at"))
    at = lambda h: F.try_element_at(F.get("known_at", part(h["du_id"])), h["du_id"])
    placed = F.transform("hits", lambda h: h.withField("x", at(h)["x"]).withField("y", at(h)["y"]).withField("z", at(h)["z"]))
    return events.join(F.broadcast(known)).withColumn("hits", placed).drop("known_at").where(F.forall("hits", lambda h: h["x"].isNotNull()))


def _placed_by_join(events: DataFrame, layout: DataFrame) -> DataFrame:
    """The same by a join of the hits, which are gathered again in their order."""
    rest = [c for c in events.columns if c not in (*EVENT, "hits")]
    hits = events.select(*EVENT, F.posexplode("hits").alias("place", "hit"))
    at = hits.withColumn("du_id", F.col("hit.du_id")).join(layout.select("du_id", "x", "y", "z"), "du_id", "left")
    moved = F.col("hit").withField("x", F.col("x")).withField("y", F.col("y")).withField("z", F.col("z"))
    each = at.groupBy(*EVENT).agg(F.array_sort(F.collect_list(F.struct("place", moved.alias("hit")))).alias("h"), F.every(F.col("x").isNotNull()).alias("whole")).where("whole")
    placed = each.select(*EVENT, F.transform("h", lambda s: s["hit"]).alias("hits"))
    return events.select(*EVENT, *rest).join(placed, EVENT).select(*events.columns)


def calibrate_stream(events: DataFrame, windows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events with window_id, window_dist and the window's offsets added to their times, rounded to whole ns (half to even).

    A window's offsets are one row of a static table. Without a clock, a window or an offset times stay as they are.
    """
    table = offsets.groupBy("window_id").agg(F.map_from_entries(F.collect_list(F.struct("du_id", "dt_ns"))).alias("window_offsets"))
    at = event_windows(events, windows).join(small(table), "window_id", "left")
    offset = lambda h: F.try_element_at("window_offsets", h["du_id"])
    moved = lambda h: F.when(offset(h).isNotNull(), F.bround(h["time_ns"] + offset(h))).otherwise(h["time_ns"])
    return at.withColumn("hits", F.transform("hits", lambda h: h.withField("time_ns", moved(h)))).select(*events.columns, "window_id", "window_dist")


def pair_stream(events: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per pair of an event's hits: du_a, du_b (ordered as strings), dt_ns, distance_m, causal."""

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a["du_id"].alias("du_a"), b["du_id"].alias("du_b"), (a["time_ns"] - b["time_ns"]).alias("dt_ns"), distance(*(h[k] for h in (a, b) for k in "xyz")).alias("distance_m"))

    later = lambda a: F.filter("hits", lambda b: b["du_id"].cast("string") > a["du_id"].cast("string"))
    pairs = F.flatten(F.transform("hits", lambda a: F.transform(later(a), lambda b: pair(a, b))))
    each = events.select(*EVENT, F.explode(pairs).alias("p")).select(*EVENT, "p.*")
    return each.withColumn("causal", causality.causal(F.col("dt_ns"), F.col("distance_m"), max_ratio, C_AIR))


def match_stream(events: DataFrame, least: int = MIN_DETECTORS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Events with their hits reduced to the causal clique; those left with fewer than `least` go."""
    return causality.match_rows(events, least, max_ratio).select(*EVENT, F.col("matched").alias("hits"))


def fit_stream(events: DataFrame, **options) -> DataFrame:
    """Plane-wave fits."""
    return planewave.fit_moments(planewave.moments_in_row(events), **options)


def scan_stream(events: DataFrame) -> DataFrame:
    """The best scanned direction of each event."""
    return planewave.scan(planewave.moments_in_row(events), planewave.start_directions()).select(*EVENT, "start", "chi_square")
