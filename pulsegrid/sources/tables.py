"""Small text tables: layouts, calibration, pair tables, fingerprints; and the choice of input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.clock import epoch_second, file_second


def parse_layout(lines: DataFrame) -> DataFrame:
    """du_id, x, y, z from lines (column value, in the order of ord): blank- or comma-separated, # starts a comment.

    Short lines and lines with bad numbers are skipped; of a repeated detector the last line stays.
    """
    clean = lines.select("ord", F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v <> ''")
    parts = clean.select("ord", F.split(F.trim(F.regexp_replace("v", r"[,\s]+", " ")), " ").alias("p")).where(F.size("p") >= 4)
    rows = parts.select("ord", F.get("p", F.lit(0)).try_cast("int").alias("du_id"), *[F.get("p", F.lit(i)).try_cast("double").alias(k) for i, k in ((1, "x"), (2, "y"), (3, "z"))]).where("du_id is not null and x is not null and y is not null and z is not null")
    return rows.groupBy("du_id").agg(F.max_by(F.struct("x", "y", "z"), "ord").alias("r")).select("du_id", "r.*")


def file_order() -> Column:
    """The order of the lines of files: by file, by the split that a line was read in, by the line in the split."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return parse_layout(spark.read.text(path).select("value", file_order().alias("ord")))


def parse_calibration(raw: DataFrame) -> DataFrame:
    """Calibration rows with window_id (by start): times with or without fractions; of a window's repeated detector the
    last row stays. `raw` has the columns of the file as text, and ord."""
    # A time without a zone is UTC, whatever the session's zone is.
    zoned = lambda c: F.regexp_like(c, F.lit(r"(?i)(\d\s*(Z|UTC|GMT)|:\d\d(\.\d+)?\s*[+-]\d{1,2}(:?\d\d)?)\s*$"))
    utc = lambda c: F.when(zoned(F.col(c)), F.unix_seconds(F.col(c).try_cast("timestamp"))).otherwise(epoch_second(F.col(c).try_cast("timestamp_ntz")))
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    rows = raw.select(utc("window_start_utc").alias("start_s"), utc("window_end_utc").alias("end_s"), F.col("DU_ID").try_cast("int").alias("du_id"), num("time_offset_add_ns").alias("dt_ns"), num("x_offset_m").alias("dx"), num("y_offset_m").alias("dy"), num("z_offset_m").alias("dz"), "ord")
    last = rows.groupBy("start_s", "end_s", "du_id").agg(F.max_by(F.struct("dt_ns", "dx", "dy", "dz"), "ord").alias("r")).select("start_s", "end_s", "du_id", "r.*")
    return last.withColumn("window_id", F.xxhash64("start_s", "end_s"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    columns = ("window_start_utc", "window_end_utc", "DU_ID", "time_offset_add_ns", "x_offset_m", "y_offset_m", "z_offset_m")
    return parse_calibration(spark.read.option("header", True).csv(path).select(*columns, file_order().alias("ord")))


#: The column names of the files.
PAIR_COLUMNS = ("du_a", "du_b", "distance_m", "theoretical_delta_ns")


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A pair table and its invalid rows; fails where a column is missing."""
    raw = spark.read.option("header", True).csv(path)
    lacking = [c for c in PAIR_COLUMNS if c not in raw.columns]
    if lacking:
        raise ValueError(f"pair table without {', '.join(lacking)}")
    typed = raw.select(F.col("du_a").try_cast("int").alias("du_a"), F.col("du_b").try_cast("int").alias("du_b"), *[F.col(c).try_cast("double").alias(c) for c in PAIR_COLUMNS[2:]])
    ok = F.forall(F.array(*[F.col(c).isNotNull() for c in PAIR_COLUMNS]), lambda x: x)
    return typed.where(ok), typed.where(~ok)


def read_pairs_counted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Observation]:
    """A pair table, its invalid rows as (text, reason), and an observation of n_rows and n_invalid, which any action over
    the pairs fills in the same pass. Fails where a column is missing.

    A row is invalid if it doesn't parse (its whole text is kept) or if a value is missing.
    """
    header = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in PAIR_COLUMNS if c not in header]
    if lacking:
        raise ValueError(f"pair table without {', '.join(lacking)}")
    kinds = dict(zip(PAIR_COLUMNS, ("int", "int", "double", "double"), strict=True))
    schema = ", ".join([*(f"`{c}` {kinds.get(c, 'string')}" for c in header), "bad_row string"])
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_row").schema(schema).csv(path)
    lost = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in PAIR_COLUMNS]))
    reason = F.when(F.col("bad_row").isNotNull(), "unreadable").when(F.size(lost) > 0, F.concat(F.lit("without "), F.array_join(lost, ", ")))
    seen = Observation()
    told = rows.withColumn("reason", reason)
    counted = told.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count("reason").alias("n_invalid"))
    text = F.coalesce("bad_row", F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in header]))
    return counted.where("reason is null").select(*PAIR_COLUMNS), told.where("reason is not null").select(text.alias("text"), "reason"), seen


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(*PAIR_COLUMNS).orderBy(F.col("du_a").cast("string"), F.col("du_b").cast("string")).write.option("header", True).csv(path)


def parse_fingerprints(lines: DataFrame) -> DataFrame:
    """file, event_key, hit_pos, du_id, time_ns from lines `time: [('du', ns), ...]`; bad items are skipped, and so are times
    that aren't whole ns."""
    stamp = F.trim(F.regexp_extract("value", r"^([^:]*(?::\d+)*?):\s*\[", 1))
    items = F.regexp_extract_all("value", F.lit(r"\(\s*'?(\d+)'?\s*,\s*[+-]?\d+\s*\)"), 0)
    rows = lines.where(F.col("value").contains("[")).select(F.col("file") if "file" in lines.columns else F.lit("").alias("file"), stamp.alias("event_key"), F.posexplode(items).alias("p", "i"))
    return rows.select("file", "event_key", (F.col("p") + 1).alias("hit_pos"), F.regexp_extract("i", r"(\d+)", 1).cast("int").alias("du_id"), F.regexp_extract("i", r",\s*([+-]?\d+)", 1).try_cast("double").alias("time_ns")).where("time_ns is not null")


def files_between(files: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of files (column path) whose name carries a second within [start, end]; names without one are dropped."""
    return files.withColumn("file_ts", file_second(F.col("path"))).where(F.col("file_ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length and time of the files of a folder and those below it whose names fit a glob pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def _plain(path: Column) -> Column:
    """A local path with one slash after its scheme; listings and readers write it differently."""
    return F.regexp_replace(path, r"^file:/+", "file:/")


def audit_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """path, status, n_rows and length of each file of a listing (path, length), by the rows that it gave (column path): `read`
    or `silent`. A file that was damaged behind its first rows counts as read, with the rows it gave."""
    given = rows.groupBy(_plain(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    listed = files.withColumn("path", _plain(F.col("path"))).join(given, "path", "left")
    return listed.select("path", F.when(F.col("n_rows") > 0, "read").otherwise("silent").alias("status"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "length")


def read_surviving(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """The rows of the readable Parquet files of a folder, with their path, and the audit of all its files: `read`, `empty` or
    `failed`. Files that can't be read, or no longer are a Parquet file from end to end, have failed; Spark lists no file of
    no bytes at all.

    Only the bytes of files without rows are looked at once more; their names are listed on the driver, as Spark lists all.
    """
    seek = lambda reader: reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    rows = seek(spark.read.option("ignoreCorruptFiles", True)).parquet(folder).withColumn("path", F.col("_metadata.file_path"))
    audit = audit_files(list_files(spark, folder, pattern), rows)
    silent = [r.path for r in audit.where("status = 'silent'").select("path").collect()]
    if not silent:
        return rows, audit
    mark = F.lit(b"PAR1")
    whole = (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark) & (F.octet_length("content") >= 12)
    sound = spark.read.option("ignoreCorruptFiles", True).format("binaryFile").load(silent).where(whole).select(_plain(F.col("path")).alias("path"), F.lit("empty").alias("sound"))
    status = F.when(F.col("status") == "read", "read").otherwise(F.coalesce("sound", F.lit("failed")))
    return rows, audit.join(sound, "path", "left").select("path", status.alias("status"), "n_rows", "length")
