"""Event records to hits, and the joins that give hits their positions and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import EVENT

#: Tables of at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows; larger tables are joined by shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def explode_events(events: DataFrame, arrays: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """One row per array place: `arrays` maps an array column to the name of its values; hit_pos counts from 1."""
    keep = keep or EVENT
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in arrays.items()])
    return events.select(*keep, F.posexplode(zipped).alias("p", "v")).select(*keep, (F.col("p") + 1).alias("hit_pos"), *[F.col(f"v.{n}").alias(n) for n in arrays.values()])


def last_hits(raw: DataFrame) -> DataFrame:
    """One hit per detector of an event: of several the last one stands, with all its columns.

    Rows that lie together by event stay where they are.
    """
    last = W.partitionBy(*EVENT, "du_id").orderBy(F.desc("hit_pos"))
    rest = [c for c in raw.columns if c not in (*EVENT, "du_id", "hit_pos")]
    return raw.withColumn("last", F.row_number().over(last)).where("last = 1").select(*EVENT, "du_id", *rest, "hit_pos")


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each number in a file."""
    order = W.partitionBy("file", "event_number").orderBy(F.col("idx").desc())
    return events.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def first_events(events: DataFrame, n: int) -> DataFrame:
    """The first n events of each file; all for n of 0."""
    return events.where(F.col("idx") < n) if n > 0 else events


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The rows of the first n files by name; all for n of 0."""
    if n <= 0:
        return files
    return files.join(F.broadcast(files.select("file").distinct().orderBy("file").limit(n)), "file", "left_semi")


def resolve_positions(hits: DataFrame, layout: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Hits with x, y, z: from the event's own layout where the event has one at all, else from the static layout.

    `own` has an event's key, du_id, x, y, z. Hits without a position have nulls.
    """
    static = small(layout.select("du_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz")))
    out = hits.drop("x", "y", "z").join(static, "du_id", "left")
    if own is None:
        return out.withColumnsRenamed({"sx": "x", "sy": "y", "sz": "z"})
    has = own.select(*EVENT).distinct().withColumn("own", F.lit(True))
    own = own.select(*EVENT, "du_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    out = out.join(has, EVENT, "left").join(own, [*EVENT, "du_id"], "left")
    pick = lambda o, s: F.when(F.col("own"), F.col(o)).otherwise(F.col(s))
    return out.select(*hits.drop("x", "y", "z").columns, pick("ox", "sx").alias("x"), pick("oy", "sy").alias("y"), pick("oz", "sz").alias("z"))


def unplaced_events(hits: DataFrame) -> DataFrame:
    """Events in which some detector has no position, with the number of such hits; fits leave them out."""
    return hits.groupBy(*EVENT).agg(F.count_if(F.col("x").isNull()).alias("unplaced")).where("unplaced > 0")


def placed(hits: DataFrame, whole_events: bool) -> DataFrame:
    """Hits that have a position; with `whole_events`, only of events in which all have one."""
    if whole_events:
        return hits.join(unplaced_events(hits), EVENT, "left_anti")
    return hits.where(F.col("x").isNotNull())


def attach(results: DataFrame, events: DataFrame) -> DataFrame:
    """Event metadata for stage results; null where it is missing."""
    return results.join(events, EVENT, "left")


def align(keys: DataFrame, *fields: DataFrame) -> DataFrame:
    """Every field table on one set of keys, missing values null."""
    for f in fields:
        keys = keys.join(f, EVENT, "left")
    return keys


def consistent_events(times: DataFrame, signals: DataFrame, known: DataFrame) -> DataFrame:
    """Events whose time and signal maps name the same detectors, all of them in the layout."""
    t = times.select(*EVENT, "du_id", F.lit(1).alias("t"))
    s = signals.select(*EVENT, "du_id", F.lit(1).alias("s"))
    both = t.join(s, [*EVENT, "du_id"], "full_outer").join(small(known.select("du_id", F.lit(1).alias("k"))), "du_id", "left")
    return both.groupBy(*EVENT).agg(F.every(F.col("t").isNotNull() & F.col("s").isNotNull() & F.col("k").isNotNull()).alias("ok")).where("ok").select(*EVENT)


def within_radius(hits: DataFrame, limit: float) -> DataFrame:
    """Hits at most `limit` metres from the centre (none dropped for a limit of 0 or less); unplaced hits go."""
    return hits.where(F.hypot("x", "y") <= limit) if limit > 0 else hits


def enough_detectors(hits: DataFrame, least: int) -> DataFrame:
    """Hits of events with at least `least` detectors."""
    return hits.join(hits.groupBy(*EVENT).agg(F.count_distinct("du_id").alias("n")).where(F.col("n") >= least), EVENT, "left_semi")


def subtract_offsets(hits: DataFrame, offsets: DataFrame) -> DataFrame:
    """Hits with time_offset, 0 for detectors that have none; of repeated detectors the last row counts (column ord)."""
    last = offsets.groupBy("du_id").agg(F.max_by("mean_ns", "ord").alias("o"))
    return hits.join(small(last), "du_id", "left").withColumn("time_offset", F.coalesce("o", F.lit(0.0))).drop("o")
