"""Stage tables and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pulsegrid.constants import EVENT, GPS_UTC, LOCAL
from pulsegrid.functions.clock import epoch_second, local_time


def event_documents(events: DataFrame, hits: DataFrame) -> DataFrame:
    """One document per event: its fields and per-detector maps of times (and signals)."""
    in_order = F.array_sort(F.collect_list(F.struct("hit_pos", "du_id", "time_ns", *(["signal"] if "signal" in hits.columns else []))))
    each = hits.groupBy(*EVENT).agg(in_order.alias("h"))
    as_map = lambda c: F.map_from_entries(F.transform("h", lambda h: F.struct(h["du_id"], h[c]))).alias(c.replace("_ns", ""))
    maps = [as_map("time_ns"), *([as_map("signal")] if "signal" in hits.columns else [])]
    return events.join(each.select(*EVENT, *maps, F.col("h.du_id").alias("du_ids")), EVENT)


def write_documents(documents: DataFrame, path: str, by: str = "date") -> None:
    documents.write.partitionBy(by).parquet(path)


def export_documents(documents: DataFrame, path: str) -> None:
    documents.write.json(path)


def write_stage(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


#: The column of a streamed stage table that names the micro-batch of a row.
BATCH = "stage_batch"


def write_batch(table: DataFrame, batch: int, path: str) -> None:
    """A micro-batch as a part of a stage table. The part is named by the batch, so a batch that runs again after a failure
    takes the place of its first attempt, and each row is there once."""
    table.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def stream_stages(events: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that feeds one stage table for each function of `stages`, under `folder`, from every micro-batch.

    The batch is kept while its stages run, so the source is read once. Events of a batch must be whole: a stage sees one
    batch at a time. Start it with a trigger of choice; after a failure the checkpoint replays the last batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, stage in stages.items():
                write_batch(stage(batch), number, f"{folder}/{name}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_streamed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a streamed stage table, without the batch's number."""
    return spark.read.parquet(path).drop(BATCH)


def write_events(events: DataFrame, path: str) -> None:
    """Events as a table with a folder for each day of their clock (gps_time; `event_date` is null without one)."""
    dated = events.withColumn("event_date", local_time(F.col("gps_time") - LOCAL).cast("date"))
    # Rebalanced, so that a day is one file or, where it is large, several.
    dated.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(path)


def read_events(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Events of `write_events` whose UTC second is within [start, end]; folders of other days are not listed."""
    at = lambda s: epoch_second(F.lit(s).try_cast("timestamp_ntz")) + GPS_UTC
    day = lambda s: F.lit(s).try_cast("timestamp_ntz").cast("date")
    return spark.read.parquet(path).where(F.col("event_date").between(day(start), day(end)) & F.col("gps_time").between(at(start), at(end)))


def events_of_periods(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Events of `write_events` by the periods (period_id, start_s, end_s in GPS seconds, both included) that hold them.

    A period is listed under each of its days, so that the join on the day prunes the folders when the query runs.
    """
    day = lambda c: local_time(F.col(c) - LOCAL).cast("date")
    days = periods.select("period_id", "start_s", "end_s", F.explode(F.sequence(day("start_s"), F.greatest(day("start_s"), day("end_s")))).alias("event_date"))
    return events.join(days, "event_date").where("gps_time between start_s and end_s").drop("start_s", "end_s")


#: Columns and decimals of the diagnostics of the footprint cut.
DIAGNOSTICS = {"zenith": 2, "spread_major": 2, "spread_minor": 2, "expected": 3, "observed": 3, "share_inside": 3, "time_rms": 2}


def diagnostics(footprint: DataFrame) -> DataFrame:
    """The footprint cut's diagnostics as twelve columns with fixed decimals; ties go up, whatever noise a sum leaves beyond
    the ninth decimal."""
    fixed = [F.when(F.col(c) < 1e12, F.format_string(f"%.{d}f", F.round(c, 9))).otherwise("inf").alias(c) for c, d in DIAGNOSTICS.items()]
    return footprint.select("event_key", "n_du", *fixed, "shape_ok", "ellipse_ok", "time_ok")


def direction_lines(fits: DataFrame, events: DataFrame) -> DataFrame:
    """Lines `gps utc zenith azimuth Chi chi` of fits with chi < 500 and 45 < zenith < 85, in the order of time."""
    j = fits.where("chi_square < 500 and zenith > 45 and zenith < 85").join(events.select(*EVENT, "gps_time"), EVENT)
    utc = local_time(F.col("gps_time")).cast("string")
    # Ties of the decimal go to the even digit, whatever noise a sum leaves beyond the sixth.
    # An azimuth that noise puts just below 360 is 0.
    full = [F.round("zenith", 6), F.pmod(F.round("azimuth", 6), F.lit(360.0)), F.round("chi_square", 6)]
    shown = [F.bround(c, 1) for c in full]
    return j.select("gps_time", F.format_string("%d %s %.1f %.1f Chi %.1f", "gps_time", utc, *shown).alias("value"))


def write_directions(lines: DataFrame, path: str) -> None:
    lines.orderBy("gps_time", "value").select("value").write.text(path)
