"""Causality matching: keep the hits of an event that could come from one source at no more than the speed of light.

The pair forms give one row per pair and suit SQL; the event forms hold an event's hits in one sorted array, so that the
whole match takes a single shuffle by event and no pair leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import C_AIR, EVENT, MAX_RATIO, MIN_DETECTORS
from pulsegrid.functions.geometry import distance
from pulsegrid.operators.pairs import hit_pairs

HIT = ("du_id", "time_ns", "signal", "x", "y", "z", "hit_pos")


def causal(dt: Column, dist: Column, max_ratio: float = MAX_RATIO, c: float = C_AIR) -> Column:
    """Whether a time difference is at most `max_ratio` of the light travel time; detectors at one place always pass."""
    return F.when(dist == 0, True).otherwise(F.abs(dt) / (dist / F.lit(c)) <= max_ratio)


def edges(hits: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The causal pairs of each event."""
    return hit_pairs(hits).where(causal(F.col("dt_ns"), F.col("distance_m"), max_ratio))


def degrees(hits: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Each hit's number of causal partners in its event, 0 for hits without any."""
    e = edges(hits, max_ratio)
    ends = e.select(*EVENT, F.explode(F.array("du_a", "du_b")).alias("du_id")).groupBy(*EVENT, "du_id").agg(F.count(F.lit(1)).alias("degree"))
    return hits.join(ends, [*EVENT, "du_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def gather(hits: DataFrame, least: int = 0) -> DataFrame:
    """One row per event: its hits as an array in record order. Events of fewer than `least` hits go first."""
    cols = [c for c in HIT if c in hits.columns and c != "hit_pos"]
    events = hits.groupBy(*EVENT).agg(F.array_sort(F.collect_list(F.struct("hit_pos", *cols))).alias("hits"))
    return events.where(F.size("hits") >= least)


def scatter(events: DataFrame, hits_col: str = "hits") -> DataFrame:
    """The hits of array rows as rows again."""
    return events.select(*EVENT, F.explode(hits_col).alias("h")).select(*EVENT, "h.*")


def _apart(a: Column, b: Column) -> Column:
    return distance(a["x"], a["y"], a["z"], b["x"], b["y"], b["z"])


def _fits(a: Column, b: Column, max_ratio: float) -> Column:
    return causal(a["time_ns"] - b["time_ns"], _apart(a, b), max_ratio)


def match_clique(hits: DataFrame, least: int = MIN_DETECTORS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Events with `matched`, the hits of a greedy clique: by falling degree (record order among equals), each hit that
    is causal with every member so far. Events whose clique has fewer than `least` hits are left out.
    """
    return match_rows(gather(hits, least), least, max_ratio)


def match_rows(events: DataFrame, least: int = MIN_DETECTORS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The same for events that hold their hits as arrays in record order; it needs no shuffle, so it runs on a stream."""
    events = events.where(F.size("hits") >= least)
    ranked = F.transform("hits", lambda h: F.struct((-F.size(F.filter("hits", lambda g: (g["du_id"] != h["du_id"]) & _fits(h, g, max_ratio)))).alias("rank"), h["hit_pos"].alias("hit_pos"), h.alias("hit")))
    order = events.select(*EVENT, "hits", F.array_sort(ranked).alias("order"))
    hit_type = order.schema["hits"].dataType.simpleString()
    clique = F.aggregate("order", F.array().cast(hit_type), lambda acc, x: F.when(F.forall(acc, lambda m: _fits(m, x["hit"], max_ratio)), F.concat(acc, F.array(x["hit"]))).otherwise(acc))
    return _enough(order, F.array_sort(clique), least)


def _enough(events: DataFrame, matched: Column, least: int) -> DataFrame:
    """Events with `matched`, if it has at least `least` hits. A generator gives the column, as Catalyst would otherwise write the
    whole match into every filter on it, the one here and those of an explode, and work it out in each."""
    return events.select(*EVENT, F.size("hits").alias("n_hits"), F.explode(F.array(matched)).alias("matched")).where(F.size("matched") >= least)


def _too_fast(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a["time_ns"] - b["time_ns"]) > _apart(a, b) / F.lit(C_AIR) * F.lit(tolerance)


def by_time(events: DataFrame) -> DataFrame:
    """The array of hits sorted by time, record order among equals."""
    timed = F.array_sort(F.transform("hits", lambda h: F.struct(h["time_ns"].alias("t"), h["hit_pos"].alias("p"), h.alias("h"))))
    return events.select(*[c for c in events.columns if c != "hits"], F.transform(timed, lambda s: s["h"]).alias("hits"))


def prune_worst(hits: DataFrame, least: int = MIN_DETECTORS, tolerance: float = 1.01) -> DataFrame:
    """Events with `matched`: while any pair violates causality, the hit with the most violations goes (the earliest
    among equals). An event has at most as many rounds as hits; those left with fewer than `least` are dropped.
    """
    events = by_time(gather(hits, least))

    def step(acc: Column) -> Column:
        counts = F.transform(acc, lambda h: F.size(F.filter(acc, lambda g: _too_fast(h, g, tolerance))))
        worst = F.array_position(counts, F.array_max(counts)).cast("int")
        less = F.concat(F.slice(acc, F.lit(1), worst - 1), F.slice(acc, worst + 1, F.size(acc)))
        return F.when((F.size(acc) >= least) & (F.array_max(counts) > 0), less).otherwise(acc)

    pruned = F.aggregate(F.sequence(F.lit(1), F.size("hits")), F.col("hits"), lambda acc, _: step(acc))
    return _enough(events, pruned, least)


def drop_after_earlier(hits: DataFrame, least: int = MIN_DETECTORS, tolerance: float = 1.01) -> DataFrame:
    """Hits that violate causality with no earlier hit of their event, kept or not; only events left with `least` hits."""
    events = by_time(gather(hits, least))
    kept = F.transform(
        F.filter(F.transform("hits", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda s: ~F.exists(F.slice("hits", F.lit(1), s["i"]), lambda g: _too_fast(s["h"], g, tolerance))),
        lambda s: s["h"],
    )
    return _enough(events, kept, least)


def match_yield(all_events: DataFrame, matched: DataFrame) -> DataFrame:
    """Events before and after matching, and their ratio; one row."""
    n = all_events.select(*EVENT).distinct().agg(F.count(F.lit(1)).alias("n_events"))
    return n.join(matched.select(*EVENT).distinct().agg(F.count(F.lit(1)).alias("n_matched"))).withColumn("ratio", F.col("n_matched") / F.col("n_events"))
