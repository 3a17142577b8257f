"""Time and position calibration by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import EVENT
from pulsegrid.operators.hits import small

#: Up to this many calibration windows stand in the plan as literals; more are joined.
LISTED_WINDOWS = 2_000
#: Seconds of a block of the merge.
BLOCK_SECONDS = 86_400


def first_windows(windows: DataFrame, n: int) -> list:
    return windows.select("window_id", "start_s", "end_s").orderBy("start_s", "window_id").limit(n).collect()


def nearest_window(second: Column, windows: DataFrame | list) -> Column:
    """struct(dist, start_s, ord, window_id) of the window that holds a second (the first by start), else of the nearest.

    The windows, at most LISTED_WINDOWS, stand in the plan as an array, so events need neither a join nor a shuffle;
    `event_windows` takes any number.
    """
    rows = windows if isinstance(windows, list) else first_windows(windows, LISTED_WINDOWS + 1)
    if len(rows) > LISTED_WINDOWS:
        raise ValueError(f"more than {LISTED_WINDOWS} calibration windows")
    listed = F.array(*[F.struct(F.lit(r.start_s).cast("long").alias("start_s"), F.lit(r.end_s).cast("long").alias("end_s"), F.lit(i).alias("ord"), F.lit(r.window_id).cast("long").alias("window_id")) for i, r in enumerate(rows)])
    away = lambda w: F.greatest(w["start_s"] - second, second - w["end_s"], F.lit(0).cast("long"))
    return F.when(second.isNotNull(), F.array_min(F.transform(listed, lambda w: F.struct(away(w).alias("dist"), w["start_s"].alias("start_s"), w["ord"].alias("ord"), w["window_id"].alias("window_id")))))


def event_windows(events: DataFrame, windows: DataFrame, utc: Column | None = None) -> DataFrame:
    """Each event's window and its distance in seconds; `utc` is by default gps_time less 18 s."""
    second = utc if utc is not None else F.col("gps_time") - 18
    rows = first_windows(windows, LISTED_WINDOWS + 1)
    if len(rows) > LISTED_WINDOWS:
        return joined_windows(events, windows, second)
    return events.withColumn("w", nearest_window(second, rows)).select(*events.columns, "w.window_id", F.col("w.dist").alias("window_dist"))


def joined_windows(events: DataFrame, windows: DataFrame, second: Column) -> DataFrame:
    """The same for any number of windows, by a merge of windows and distinct seconds in time.

    Of the windows that hold a second the first by (start, id) counts, so a window counts from where all before it have
    ended: what is left of the windows is disjoint, and the last of these that begins at or before a second is the only one
    that may hold it. A second in a gap takes the nearest end before it or start after it. All three are running extremes
    within a day and, over the days, of one row a day. Equal windows are one (that of the least id) before they are merged.
    """
    at = events.select(second.cast("long").alias("s")).where("s is not null").distinct()
    day = lambda c: F.floor(F.col(c) / BLOCK_SECONDS).cast("long")
    w = windows.select(F.col("window_id").cast("long").alias("window_id"), F.col("start_s").cast("long").alias("start_s"), F.col("end_s").cast("long").alias("end_s"))
    w = w.where("start_s is not null and end_s is not null").groupBy("start_s", "end_s").agg(F.min("window_id").alias("window_id")).withColumn("day", day("start_s"))
    earlier, later = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
    # Where each window begins to count; one that holds no second but in reach of an earlier one keeps its ends for the gaps.
    ended = w.groupBy("day").agg(F.max("end_s").alias("e")).select("day", F.max("e").over(earlier).alias("before_day"))
    in_day = W.partitionBy("day").orderBy("start_s", "window_id", "end_s").rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("in_day", F.max("end_s").over(in_day)).join(ended, "day").withColumn("since", F.greatest(F.col("start_s"), F.col("in_day") + 1, F.col("before_day") + 1))
    # The marks of the merge: an end can only be the nearest for later seconds, a start for earlier ones.
    held = F.when(F.col("since") <= F.col("end_s"), F.struct("since", "end_s", "start_s", "window_id"))
    late = F.struct("end_s", (-F.col("start_s")).alias("negative_start"), (-F.col("window_id")).alias("negative_id"))
    first = F.struct("start_s", "window_id")
    kinds = {"held": "struct<since: bigint, end_s: bigint, start_s: bigint, window_id: bigint>", "before": "struct<end_s: bigint, negative_start: bigint, negative_id: bigint>", "after": "struct<start_s: bigint, window_id: bigint>"}
    mark = lambda t, **v: F.struct(F.col(t).alias("t"), *[v.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])
    of_windows = w.select(F.explode(F.array(mark("since", held=held), mark("end_s", before=late), mark("start_s", after=first))).alias("m")).select("m.*", F.lit(False).alias("asks"))
    marks = at.select(mark("s").alias("m")).select("m.*", F.lit(True).alias("asks")).unionByName(of_windows).withColumn("day", day("t"))
    days = marks.groupBy("day").agg(F.max("held").alias("h"), F.max("before").alias("b"), F.min("after").alias("a"))
    outside = days.select("day", F.max("h").over(earlier).alias("h"), F.max("b").over(earlier).alias("b"), F.min("a").over(later).alias("a"))
    # Both frames grow from their first row: a frame to the end of its partition is summed anew for each row.
    up, down = (W.partitionBy("day").orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.asc("t"), F.desc("t")))
    near = marks.select("day", "t", "asks", F.max("held").over(up).alias("in_h"), F.max("before").over(up).alias("in_b"), F.min("after").over(down).alias("in_a")).where("asks").join(outside, "day")
    near = near.select(F.col("t").alias("s"), F.coalesce("in_h", "h").alias("h"), F.coalesce("in_b", "b").alias("b"), F.coalesce("in_a", "a").alias("a"))
    options = F.array_compact(F.array(
        F.when(F.col("b").isNotNull(), F.struct((F.col("s") - F.col("b.end_s")).alias("dist"), (-F.col("b.negative_start")).alias("start_s"), (-F.col("b.negative_id")).alias("window_id"))),
        F.when(F.col("a").isNotNull(), F.struct((F.col("a.start_s") - F.col("s")).alias("dist"), F.col("a.start_s").alias("start_s"), F.col("a.window_id").alias("window_id"))),
    ))
    inside = F.when(F.col("h.end_s") >= F.col("s"), F.struct(F.lit(0).cast("long").alias("dist"), F.col("h.start_s").alias("start_s"), F.col("h.window_id").alias("window_id")))
    best = near.select("s", F.coalesce(inside, F.array_min(options)).alias("w")).select("s", "w.window_id", F.col("w.dist").alias("window_dist"))
    return events.withColumn("asked_s", second.cast("long")).join(best.withColumnRenamed("s", "asked_s"), "asked_s", "left").select(*events.columns, "window_id", "window_dist")


def calibrate_times(hits: DataFrame, events: DataFrame, windows: DataFrame, table: DataFrame) -> DataFrame:
    """Hits with the window's offset for their detector added, rounded to whole ns (half to even).

    Detectors without an offset, and events without a clock, keep their times. `offset_ns` is null where none was added.
    """
    near = event_windows(events.select(*EVENT, "gps_time"), windows).select(*EVENT, "window_id", "window_dist")
    off = small(table.select("window_id", "du_id", F.col("dt_ns").alias("offset_ns")))
    out = hits.join(near, EVENT, "left").join(off, ["window_id", "du_id"], "left")
    return out.withColumn("time_ns", F.when(F.col("offset_ns").isNotNull(), F.bround(F.col("time_ns") + F.col("offset_ns"))).otherwise(F.col("time_ns"))).select(*hits.columns, "window_id", "window_dist", "offset_ns")


def mean_position_offsets(table: DataFrame) -> DataFrame:
    return table.groupBy("du_id").agg(*[F.avg(c).alias(c) for c in ("dx", "dy", "dz")])


def calibrate_positions(positions: DataFrame, table: DataFrame) -> DataFrame:
    """A layout shifted by each detector's mean offset over all windows, to 4 decimals."""
    out = positions.join(small(mean_position_offsets(table)), "du_id", "left")
    move = lambda c: F.when(F.col(f"d{c}").isNotNull(), F.round(F.col(c) + F.col(f"d{c}"), 4)).otherwise(F.col(c)).alias(c)
    return out.select("du_id", move("x"), move("y"), move("z"))


def usage(calibrated: DataFrame) -> DataFrame:
    """Events, offsets applied, windows used and the largest distance to a window; one row."""
    used = F.col("offset_ns").isNotNull()
    return calibrated.agg(
        F.count_distinct(*EVENT).alias("n_events"),
        F.count_if(used).alias("n_applied"),
        F.count_distinct("window_id").alias("n_windows"),
        F.max("window_dist").alias("max_dist"),
    )
