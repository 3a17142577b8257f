"""The event analysis as one chain: calibrate, match, drop repeats, fit plane waves, cut, fit sources."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import EVENT, MAX_RATIO, MIN_DETECTORS
from pulsegrid.operators import calibration, causality, cuts, planewave, pointsource, repeats
from pulsegrid.operators.hits import enough_detectors, placed, resolve_positions


@dataclass(frozen=True)
class PipelineConfig:
    """Which stages run, and their limits."""

    skip_calibration: bool = False
    skip_matching: bool = False
    skip_repeats: bool = False
    skip_footprint: bool = False
    skip_ring: bool = False
    min_detectors: int = MIN_DETECTORS
    max_ratio: float = MAX_RATIO
    relational_repeats: bool = False
    with_signal: bool = True
    remove_outliers: bool = True

    @classmethod
    def for_layout(cls, layout: str, **options) -> PipelineConfig:
        """Simulated events (their layouts come with them) are neither calibrated, matched, filtered nor cut."""
        if layout == "trigger":
            return cls(**options)
        base = cls(skip_calibration=True, skip_matching=True, skip_repeats=True, skip_footprint=True, skip_ring=True)
        return replace(base, **options)


def rejects(before: DataFrame, after: DataFrame, stage: str, reason: Column) -> DataFrame:
    """file, event_key, stage, reason of the events of `before` that `after` no longer has; `reason` is read from the hits or
    rows of an event, of which the first by its text counts."""
    lost = before.withColumn("reason", reason).groupBy(*EVENT).agg(F.min("reason").alias("reason"))
    return lost.join(after.select(*EVENT).distinct(), EVENT, "left_anti").select(*EVENT, F.lit(stage).alias("stage"), "reason")


def matching_rejects(hits: DataFrame, matched: DataFrame, least: int) -> DataFrame:
    """What placing and matching take out: events with an unknown detector, with too few, or without a clique."""
    per_event = hits.groupBy(*EVENT).agg(F.count_distinct("du_id").alias("n_du"), F.count_if(F.col("x").isNull()).alias("unplaced"))
    why = F.when(F.col("unplaced") > 0, "unknown detector").when(F.col("n_du") < least, f"fewer than {least} detectors").otherwise(f"no causal clique of {least}")
    return rejects(per_event, matched, "matching", why)


def reconstruct(hits: DataFrame, events: DataFrame, layout: DataFrame, config: PipelineConfig, checkpoint, *, own_layout: DataFrame | None = None, windows: DataFrame | None = None, offsets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of each stage: hits, matched, kept, plane, cut, source, plane_final; and rejects (file, event_key, stage,
    reason), where each event is that has hits but no source.

    `checkpoint` (DataFrame, name -> DataFrame) writes what several stages read. The last plane-wave table is the first one
    restricted to events with a source, as an event's fit depends on its hits alone.
    """
    if not config.with_signal:
        hits = hits.drop("signal")
    if not config.skip_calibration and windows is not None and offsets is not None:
        hits = calibration.calibrate_times(hits, events, windows, offsets).select(*hits.columns)
        layout = calibration.calibrate_positions(layout, offsets)
    at = checkpoint(resolve_positions(hits, layout, own_layout), "hits")
    whole = placed(at, whole_events=True)
    if config.skip_matching:
        matched = enough_detectors(whole, config.min_detectors)
    else:
        matched = causality.scatter(causality.match_clique(whole, config.min_detectors, config.max_ratio), "matched")
    matched = checkpoint(matched, "matched")
    kept = matched
    if not config.skip_repeats:
        mine = events.join(matched.select(*EVENT).distinct(), EVENT, "left_semi")
        left = (repeats.without_repeats if config.relational_repeats else repeats.sequential_filter)(mine, matched)
        kept = checkpoint(matched.join(left.select(*EVENT), EVENT, "left_semi"), "kept")
    plane = checkpoint(planewave.fit(kept), "plane")
    cut = cuts.apply_cuts(placed(kept, whole_events=False), plane, not config.skip_footprint, not config.skip_ring)
    cut = checkpoint(cut, "cut")
    source = pointsource.fit(kept.join(cut.select(*EVENT), EVENT, "left_semi"), cut)
    if config.remove_outliers:
        source = pointsource.remove_outliers(checkpoint(source, "source0"), checkpoint)
    source = checkpoint(source, "source")
    lost = [
        matching_rejects(at, matched, config.min_detectors),
        rejects(matched, kept, "repeats", F.lit("repeats an earlier event")),
        rejects(kept, plane, "plane", F.lit("fewer than 4 hits")),
        rejects(cuts.cut_reasons(placed(kept, whole_events=False), plane, not config.skip_footprint, not config.skip_ring), cut, "cuts", F.col("reason")),
        rejects(cut, source, "source", F.lit("fewer than 5 hits")),
    ]
    return {"rejects": reduce(DataFrame.unionByName, lost), "hits": at, "matched": matched, "kept": kept, "plane": plane, "cut": cut, "source": source, "plane_final": plane.join(source.select(*EVENT), EVENT, "left_semi")}
