"""Event tables derived from the driver's tables: detectors, hits, clock, calibration windows, offsets, waveforms.

Each is given twice, as DataFrame operations and as SQL for the checking engine; the unit vectors are rational, so that
both give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import EVENT

#: Files that the events are dealt to.
FILES = 64
#: Line items of a task that groups them by event, at most and on average.
ROWS_A_TASK = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 detectors on a grid of 400 m."""
    return _on_grid(read(spark, sf_dir, "part").select((F.col("p_partkey") % 64).cast("int").alias("du_id")).distinct())


def wide_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector for every part, in rows of eight on a grid of 400 m."""
    return _on_grid(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("du_id")).distinct())


def _on_grid(du: DataFrame) -> DataFrame:
    d = F.col("du_id")
    return du.select("du_id", ((d % 8) * F.lit(400.0) - F.lit(1400.0)).alias("x"), (F.floor(d / 8.0) * F.lit(400.0) - F.lit(1400.0)).alias("y"), ((d * 37) % 23).cast("double").alias("z"))


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane waves from four directions with jitter and acausal hits; every 50th event repeats one source.

    A detector may occur twice in an event; hit_pos is the order of the record.
    """
    key, line = F.col("l_orderkey"), read(spark, sf_dir, "lineitem")
    named = line.withColumns({"file": F.concat(F.lit("f"), (key % FILES).cast("string")), "event_key": key.cast("string")})
    tasks = -(-line.count() // ROWS_A_TASK)
    if tasks > 1:
        # Partitions whose number is given are not merged again: by bytes, a task would get some three times as many rows.
        least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        named = named.repartition(max(tasks, least), *EVENT)
    # Numbered by the event's own key, so that what groups the hits by event later finds them together already.
    order = W.partitionBy(*EVENT).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    hits = named.select(
        *EVENT,
        "l_orderkey",
        "l_quantity",
        "l_returnflag",
        F.when(key % 50 == 0, (F.col("l_linenumber") * 9) % 64).otherwise(F.col("l_partkey") % 64).cast("int").alias("du_id"),
        F.row_number().over(order).alias("hit_pos"),
    )
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (key % 4).cast("int") + 1)
    # At most 64 rows, whatever the size of the table they come from.
    at = hits.join(F.broadcast(positions(spark, sf_dir)), "du_id")
    path = (F.col("x") * pick(0.48, -0.6, 0.36, -0.8) + F.col("y") * pick(0.6, 0.48, -0.48, -0.36) + F.col("z") * pick(0.64, 0.64, 0.8, 0.48)) / F.lit(0.29971482979)
    late = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), 20000).otherwise(0)
    quantity = F.col("l_quantity").cast("double")
    return at.select(
        *EVENT,
        "hit_pos",
        "du_id",
        (F.round(F.lit(100000.0) + path).cast("long") + quantity.cast("long") % 13 - 6 + late).cast("double").alias("time_ns"),
        (quantity * 20).cast("long").alias("signal"),
    )


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GPS second of each event."""
    key = F.col("o_orderkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (key % FILES).cast("string")).alias("file"), key.cast("string").alias("event_key"), (day * 86400 + key % 86400 + 18).cast("long").alias("gps_time"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 calibration windows of 60 days, 90 days apart."""
    w = F.col("n_nationkey").cast("long")
    start = F.lit(788918400) + w * 7776000
    return read(spark, sf_dir, "nation").select(w.alias("window_id"), start.alias("start_s"), (start + 5184000).alias("end_s")).distinct()


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration rows (window_id, du_id, dt_ns, dx, dy, dz); every 8th detector has none."""
    w, d = F.col("window_id"), F.col("du_id")
    known = positions(spark, sf_dir).where("du_id % 8 <> 0").select("du_id")
    each = windows(spark, sf_dir).select("window_id").join(known)
    return each.select("window_id", "du_id", (((w * 7 + d * 3) % 41) * F.lit(0.5) - F.lit(10.0)).alias("dt_ns"), (((w + d) % 5) * F.lit(0.25)).alias("dx"), (((w + d * 2) % 5) * F.lit(0.25)).alias("dy"), ((w % 3) * F.lit(0.5)).alias("dz"))


def wide_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position offsets of the detectors of `wide_positions`, one row for each line item of the part; x is often unknown."""
    line = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return line.select(F.col("l_partkey").cast("int").alias("du_id"), F.when(n > 6, n.cast("double")).alias("dx"), (n % 3).cast("double").alias("dy"), (F.col("l_suppkey") % 5).cast("double").alias("dz"))


SQL = """
du_wide as (
  select du_id::int as du_id, (du_id % 8) * 400e0 - 1400e0 as x, floor(du_id / 8e0) * 400e0 - 1400e0 as y, ((du_id * 37) % 23)::double as z
  from (select distinct p_partkey as du_id from part) t),
du_positions as (
  select du_id::int as du_id, (du_id % 8) * 400e0 - 1400e0 as x, floor(du_id / 8e0) * 400e0 - 1400e0 as y, ((du_id * 37) % 23)::double as z
  from (select distinct p_partkey % 64 as du_id from part) t),
raw0 as (
  select l_orderkey, l_quantity::double as q, l_returnflag,
    (case when l_orderkey % 50 = 0 then (l_linenumber * 9) % 64 else l_partkey % 64 end)::int as du_id,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as hit_pos
  from lineitem),
raw_hits as (
  select 'f' || (l_orderkey % 64)::varchar as file, l_orderkey::varchar as event_key, hit_pos, du_id,
    (round(100000e0 + (x * [0.48e0, -0.6e0, 0.36e0, -0.8e0][l_orderkey % 4 + 1] + y * [0.6e0, 0.48e0, -0.48e0, -0.36e0][l_orderkey % 4 + 1]
      + z * [0.64e0, 0.64e0, 0.8e0, 0.48e0][l_orderkey % 4 + 1]) / 0.29971482979e0)::bigint + q::bigint % 13 - 6
      + case when l_returnflag = 'R' and q > 45 then 20000 else 0 end)::double as time_ns,
    (q * 20)::bigint as signal
  from raw0 join du_positions using (du_id)),
hits as (
  select file, event_key, du_id, max_by(time_ns, hit_pos) as time_ns, max_by(signal, hit_pos) as signal, max(hit_pos) as hit_pos
  from raw_hits group by file, event_key, du_id),
ev as (
  select 'f' || (o_orderkey % 64)::varchar as file, o_orderkey::varchar as event_key,
    (datediff('day', date '1970-01-01', o_orderdate::date) * 86400 + o_orderkey % 86400 + 18)::bigint as gps_time from orders),
win as (
  select distinct n_nationkey::bigint as window_id, 788918400 + n_nationkey::bigint * 7776000 as start_s, 788918400 + n_nationkey::bigint * 7776000 + 5184000 as end_s from nation),
cal as (
  select window_id, du_id, ((window_id * 7 + du_id * 3) % 41) * 0.5e0 - 10e0 as dt_ns, ((window_id + du_id) % 5) * 0.25e0 as dx,
    ((window_id + du_id * 2) % 5) * 0.25e0 as dy, (window_id % 3) * 0.5e0 as dz
  from win cross join du_positions where du_id % 8 <> 0)"""
