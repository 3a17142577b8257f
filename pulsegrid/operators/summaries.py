"""Summary tables of events and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import EVENT
from pulsegrid.operators.hits import small


def detector_counts(hits: DataFrame) -> DataFrame:
    """Hits by detector."""
    return hits.groupBy("du_id").agg(F.count(F.lit(1)).alias("n_hits"))


def multiplicities(hits: DataFrame) -> DataFrame:
    """Events by number of detectors."""
    return hits.groupBy(*EVENT).agg(F.count_distinct("du_id").alias("n_du")).groupBy("n_du").agg(F.count(F.lit(1)).alias("n_events"))


def spread_to_reference(hits: DataFrame, reference: int, limit: float = 100.0) -> DataFrame:
    """By detector: count, mean and population deviation of its time differences to a reference detector, of those below
    `limit` (negative ones all count)."""
    d = reference_differences(hits, reference, limit)
    return d.groupBy("du_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_ns"), F.stddev_pop("d").alias("std_ns"))


def reference_differences(hits: DataFrame, reference: int, limit: float = 100.0) -> DataFrame:
    """du_id and d: each hit's time less that of the reference detector in its event, where it is below `limit`."""
    ref = hits.where(F.col("du_id") == reference).select(*EVENT, F.col("time_ns").alias("ref_ns"))
    return hits.where(F.col("du_id") != reference).join(ref, EVENT).select("du_id", (F.col("time_ns") - F.col("ref_ns")).alias("d")).where(F.col("d") < limit)


def histograms(df: DataFrame, group: str, column: str, bins: int) -> DataFrame:
    """The histogram of a column by group, over each group's own range: group, bin (from 1), low, high, n."""
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(group, v.alias("v"))
    ends = rows.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # A group of one value has a range of 1 about it.
    ends = ends.select(group, F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"), F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int") + 1, F.lit(bins))
    counts = rows.join(small(ends), group).groupBy(group, place.alias("bin"), "lo", width.alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(group, "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("lo") + F.col("bin") * F.col("width")).alias("high"), "n")


def histogram(df: DataFrame, column: str, bins: int, *, log: bool = False) -> DataFrame:
    """bin (from 1), low, high, n over the range of a column, the last bin closed; with `log` over log10, from 0.01 above
    the least value, and what lies below that is left out. Where that passes the greatest value, the range starts at a
    tenth of the least."""
    value = F.col(column).cast("double")
    rows = df.where(value.isNotNull()).select((F.log10(value) if log else value).alias("v"), value.alias("raw"))
    above = F.min("raw") + 0.01
    low = F.log10(F.when(above < F.max("raw"), above).otherwise(F.greatest(F.min("raw"), F.lit(1e-6)) / 10.0)) if log else F.min("v")
    ends = rows.agg(low.alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = rows.join(F.broadcast(ends)).where("v >= lo").withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int") + 1, F.lit(bins)))
    return at.where("bin is not null").groupBy("bin").agg(F.first(F.col("lo") + (F.col("bin") - 1) * width).alias("low"), F.first(F.col("lo") + F.col("bin") * width).alias("high"), F.count(F.lit(1)).alias("n"))


def distribution_tables(fits: DataFrame, bins: int = 50, log_bins: int = 99) -> DataFrame:
    """The histograms of fits as one table: quantity, bin, low, high, n. Angles in degrees, sources in km and chi square (by
    its logarithm; low and high are log10 values).

    The quantities are unpivoted, so that one aggregation gives all ranges and one more all bins: the fits are read twice.
    """
    km = [(f"s{k}", f"{k}_km") for k in "xyz" if f"s{k}" in fits.columns]
    taken = {c: F.col(c).cast("double") for c in ("zenith", "azimuth", "chi_square") if c in fits.columns} | {n: F.col(c) / 1000 for c, n in km}
    pairs = F.array(*[F.struct(F.lit(n).alias("quantity"), c.alias("raw")) for n, c in taken.items()])
    long = fits.select(F.explode(pairs).alias("q")).select("q.*").where("raw is not null")
    log = F.col("quantity") == "chi_square"
    value = F.when(log, F.log10("raw")).otherwise(F.col("raw"))
    above = F.col("least") + 0.01
    low = F.when(log, F.log10(F.when(above < F.col("most"), above).otherwise(F.greatest("least", F.lit(1e-6)) / 10.0))).otherwise(F.col("least"))
    high = F.when(log, F.log10("most")).otherwise(F.col("most"))
    # One row a quantity, of which there are seven at most.
    ends = long.groupBy("quantity").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).select("quantity", low.alias("lo"), ((high - low) / F.when(log, log_bins).otherwise(bins)).alias("width"), F.when(log, log_bins).otherwise(bins).alias("last"))
    at = long.join(F.broadcast(ends), "quantity").withColumn("v", value).where("v >= lo")
    place = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")).cast("int") + 1, F.col("last"))
    counts = at.groupBy("quantity", place.alias("bin"), "lo", "width").agg(F.count(F.lit(1)).alias("n")).where("bin is not null")
    return counts.select("quantity", "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("lo") + F.col("bin") * F.col("width")).alias("high"), "n")


def projections(fits: DataFrame, events: DataFrame) -> DataFrame:
    """The sources in km on the three planes, with their time: plane (xy, xz, yz), u, v, gps_time, one row each."""
    at = fits.join(events.select(*EVENT, "gps_time"), EVENT)
    planes = F.array(*[F.struct(F.lit(f"{a}{b}").alias("plane"), (F.col(f"s{a}") / 1000).alias("u"), (F.col(f"s{b}") / 1000).alias("v")) for a, b in ("xy", "xz", "yz")])
    return at.select(*EVENT, "gps_time", F.explode(planes).alias("p")).select(*EVENT, "gps_time", "p.*")


def signal_line(hits: DataFrame, distance: Column) -> DataFrame:
    """By event: slope and intercept of the signal on a distance."""
    return hits.groupBy(*EVENT).agg(F.regr_slope("signal", distance).alias("slope"), F.regr_intercept("signal", distance).alias("intercept"))


def parameters_over_time(fits: DataFrame, events: DataFrame) -> DataFrame:
    """Angles, source in km and chi square (plus 0.01) by event time."""
    cols = [c for c in ("zenith", "azimuth") if c in fits.columns]
    km = [(F.col(s) / 1000).alias(f"{s}_km") for s in ("sx", "sy", "sz") if s in fits.columns]
    return fits.join(events.select(*EVENT, "gps_time"), EVENT).select(*EVENT, "gps_time", *cols, *km, (F.col("chi_square") + 0.01).alias("chi_square"))


def relative_hits(hits: DataFrame) -> DataFrame:
    """Hits with their time less the event's mean, and their signal scaled to [0, 1] within the event (0 if all are equal)."""
    w = W.partitionBy(*EVENT)
    low, high = F.min("signal").over(w), F.max("signal").over(w)
    return hits.select(*EVENT, "du_id", (F.col("time_ns") - F.avg("time_ns").over(w)).alias("rel_ns"), F.when(high > low, (F.col("signal") - low) / (high - low)).otherwise(F.lit(0.0)).alias("scale"))


def batch_summary(audit: DataFrame) -> DataFrame:
    """Files by status, and whether any failed."""
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "failed").alias("n_failed"))
