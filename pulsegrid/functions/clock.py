"""Event clocks as column expressions. The session's time zone doesn't matter: times are without zone or in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.constants import GPS_UTC, LEAP_2017, LOCAL

#: The first second of events that are numbered rather than timed (2020-01-01).
SYNTHETIC_START = 1577836800


def wall_time(digits: Column) -> Column:
    """The timestamp without zone of the 14 digits yyyymmddhhmmss; null where they are no date."""
    return F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz")


def epoch_second(time: Column) -> Column:
    """The seconds of a timestamp without zone since the start of 1970."""
    return F.unix_date(time.cast("date")).cast("long") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def event_time(gps_time: Column) -> Column:
    """The timestamp of [yyyymmdd, hhmmss, ...]; null where it is no date."""
    text = F.concat(F.get(gps_time, F.lit(0)).cast("string"), F.lpad(F.get(gps_time, F.lit(1)).cast("string"), 6, "0"))
    return wall_time(text)


def time_in_path(path: Column) -> Column:
    """The YYYYMMDD_HHMMSS of a path, from its last part backwards; parts that hold no valid date are skipped."""
    found = F.transform(F.regexp_extract_all(path, F.lit(r"(\d{8}_\d{6})"), 1), lambda s: wall_time(F.replace(s, F.lit("_"), F.lit(""))))
    return F.try_element_at(F.filter(F.reverse(found), lambda t: t.isNotNull()), F.lit(1))


def file_second(path: Column) -> Column:
    """The YYYYMMDDhhmmss within a file's name; null for names without one."""
    return wall_time(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{14})", 1))


def numbered_second(number: Column, start: Column | int = SYNTHETIC_START) -> Column:
    """A clock for events that have none: the start and the event's number."""
    return (F.lit(start) if isinstance(start, int) else start) + number


def local_time(gps_seconds: Column) -> Column:
    """GPS seconds on the clock of UTC+8, a timestamp without zone."""
    return F.timestamp_add("SECOND", (gps_seconds - GPS_UTC + LOCAL).cast("long"), F.lit("1970-01-01").cast("timestamp_ntz"))


def local_hour(gps_seconds: Column) -> Column:
    """GPS seconds as the decimal hour of UTC+8; 17 leap seconds before 2017, 18 since."""
    leap = F.when(gps_seconds < LEAP_2017, 17).otherwise(18)
    second = F.pmod(gps_seconds - leap + LOCAL, F.lit(86400))
    return F.floor(second / 3600) + F.floor(F.pmod(second, F.lit(3600)) / 60) / 60.0 + F.floor(F.pmod(second, F.lit(60))) / 3600.0
