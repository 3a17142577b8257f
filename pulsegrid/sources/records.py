"""Raw event records: triggers, simulated events with companions, aligned collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.amplitude import amplitude
from pulsegrid.functions.clock import SYNTHETIC_START, epoch_second, event_time, numbered_second, time_in_path
from pulsegrid.functions.geometry import true_azimuth, true_zenith
from pulsegrid.operators.hits import explode_events, first_events, last_events, last_hits

TRIGGER = "run_number long, event_number long, du_id array<int>, gps_time array<long>, du_nanoseconds array<long>, trace_0 array<array<short>>, trace_1 array<array<short>>, trace_2 array<array<short>>, trace_3 array<array<short>>"
SIMULATED = "run_number long, event_number long, du_id array<int>, du_nanoseconds array<long>, trace_ch array<array<array<short>>>"


def trigger_events(spark: SparkSession, path: str) -> DataFrame:
    """Staged trigger records; events without a detector are left out. Waveforms are pruned unless used."""
    raw = spark.read.schema(TRIGGER).parquet(path)
    return keyed_events(raw.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("idx")).where(F.size("du_id") > 0))


def keyed_events(raw: DataFrame) -> DataFrame:
    """Records with event_key, idx (order of the file) and event_ts; of a number that occurs twice the last one stays.

    Records must bring their idx, as the order of rows isn't known otherwise.
    """
    if "idx" not in raw.columns:
        raise ValueError("records need idx, their order in the file")
    stamped = raw.withColumn("event_ts", event_time(F.col("gps_time"))) if "gps_time" in raw.columns else raw.withColumn("event_ts", F.lit(None).cast("timestamp_ntz"))
    return last_events(stamped).withColumn("event_key", F.col("event_number").cast("string"))


def trigger_hits(events: DataFrame) -> DataFrame:
    """One hit per detector of an event, the last of repeated ones."""
    return last_hits(explode_events(events, {"du_id": "du_id", "du_nanoseconds": "ns"}).withColumn("time_ns", F.col("ns").cast("double")).drop("ns"))


def started(events: DataFrame) -> DataFrame:
    """Events whose first time is positive."""
    return events.where(F.try_element_at("du_nanoseconds", F.lit(1)) > 0)


def waveform_hits(events: DataFrame, channel: str, left: int, right: int, simulated: bool = False) -> DataFrame:
    """Hits with the signal of a channel (F, X, Y, Z or XY) in a window of the waveform."""
    cols = {"du_id": "du_id", "du_nanoseconds": "ns"}
    if simulated:
        hits = explode_events(started(events), {**cols, "trace_ch": "traces"})
    else:
        names = {f"trace_{i}": f"t{i}" for i in range(4)}
        hits = explode_events(started(events), {**cols, **names}).withColumn("traces", F.array(*names.values())).drop(*names.values())
    return last_hits(hits.withColumn("time_ns", F.col("ns").cast("double")).withColumn("signal", amplitude(F.col("traces"), channel, left, right, simulated)).drop("ns", "traces"))


def interval(path: Column) -> tuple[Column, Column]:
    """The event interval _<low>-<high>_ of a file's name."""
    return tuple(F.regexp_extract(path, r"_(\d+)-(\d+)_", i).try_cast("long") for i in (1, 2))


def first_companions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of companion rows that share a key, those of the first file by name."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "file").alias("r")).select(*keys, "r.*")


def with_companions(events: DataFrame, shower: DataFrame, shower_sim: DataFrame, run: DataFrame, run_sim: DataFrame) -> DataFrame:
    """Simulated events with truth (per event) and site (per run); a missing companion leaves nulls.

    Event companions are joined by run_dir, interval low and high, and event_number; run companions by run_dir.
    """
    keys = ["run_dir", "low", "high", "event_number"]
    block = lambda df, ks, name: first_companions(df, ks).select(*ks, F.struct(*[c for c in df.columns if c not in (*ks, "file")]).alias(name))
    out = events.join(block(shower, keys, "truth"), keys, "left").join(block(shower_sim, keys, "truth_sim"), keys, "left")
    return out.join(block(run, ["run_dir"], "run"), "run_dir", "left").join(block(run_sim, ["run_dir"], "run_sim"), "run_dir", "left")


def simulated_clock(events: DataFrame, path: Column) -> DataFrame:
    """Simulated events with gps_time: the time of their path (or 2020-01-01) and their number."""
    base = F.coalesce(epoch_second(time_in_path(path)), F.lit(SYNTHETIC_START))
    return events.withColumn("gps_time", numbered_second(F.col("event_number"), base))


def site_fields(origin: Column) -> Column:
    """Latitude, longitude and altitude of a site from its geodetic origin."""
    return F.struct(F.get(origin, F.lit(0)).cast("double").alias("latitude"), F.get(origin, F.lit(1)).cast("double").alias("longitude"), F.get(origin, F.lit(2)).cast("double").alias("altitude"))


def renamed_truth(rows: DataFrame, names: dict[str, tuple[str, str]]) -> Column:
    """A struct of truth fields: name -> (column, type); unreadable values are null."""
    return F.struct(*[(F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(n) for n, (c, t) in names.items()])


def aligned_events(shower: DataFrame, field: DataFrame, signal: DataFrame | None = None, n: int = 0) -> DataFrame:
    """Events of three collections that belong together by (file, idx); fails where arrays differ in length.

    Truth angles point to where the shower comes from; the clock is numbered.
    """
    j = first_events(shower, n).join(field, ["file", "idx"], "full_outer" if n == 0 else "left")
    j = j.withColumn("checked", F.assert_true((F.size("det_id") == F.size("det_pos")) & (F.size("det_id") == F.size("t_0")), "collections differ in length"))
    if signal is not None:
        j = j.join(signal, ["file", "idx"], "left").withColumn("checked", F.coalesce("checked", F.assert_true(F.coalesce(F.size("p2p") == F.size("det_id"), F.lit(False)), "signals differ in length")))
    truth = F.struct(true_azimuth(F.col("azimuth")).alias("azimuth"), true_zenith(F.col("zenith")).alias("zenith"))
    return j.where("checked is null").withColumn("truth", truth).withColumn("gps_time", numbered_second(F.col("idx"))).withColumn("event_key", F.col("evt_id").cast("string"))


def aligned_hits(events: DataFrame, limit: float = 0.0) -> DataFrame:
    """Hits of aligned events with their own positions (and signals), inside a radius if one is given."""
    arrays = {"det_id": "du_id", "t_0": "time_ns", "det_pos": "pos", **({"p2p": "signal"} if "p2p" in events.columns else {})}
    hits = explode_events(events, arrays)
    placed = hits.select(*[c for c in hits.columns if c != "pos"], *[F.get("pos", F.lit(i)).alias(k) for i, k in enumerate("xyz")])
    return last_hits(placed.where(F.hypot("x", "y") <= limit) if limit > 0 else placed)
