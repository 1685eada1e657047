"""Clock functions: local times as text, timestamps, epoch seconds, hour buckets."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leadtime.functions.casts import text_to_int

HOUR = 3600
DAY = 86_400
#: Names of the zone without an offset.
UTC = {"UTC", "Etc/UTC", "UCT", "Etc/UCT", "GMT", "Etc/GMT", "Zulu", "Etc/Zulu", "Universal", "Etc/Universal", "Z", "+00:00"}


def in_utc() -> None:
    """Refuse a session in another zone, in which epoch seconds of wall-clock times would be moved."""
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else "UTC"
    if zone not in UTC:
        raise ValueError(f"epoch seconds need a session in UTC, not {zone}: set spark.sql.session.timeZone, or use build_session")


def hhmm_to_minutes(hhmm: Column) -> Column:
    """``HHMM`` as text or number to minutes of the day; text that is no number gives null.

    "2400" is 1440, the end of the day.
    """
    number = text_to_int(hhmm.cast("string"))
    return F.floor(number / 100).cast("int") * 60 + number % 100


def epoch_of(date: Column, hhmm: Column) -> Column:
    """``yyyy-MM-dd`` and ``HHMM`` (leading zeros may be missing) to epoch seconds.

    A time that does not exist on the clock, "2400" among them, gives null.
    """
    in_utc()
    text = F.concat(date, F.lit(" "), F.lpad(hhmm, 4, "0"))
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm")))


def epoch_seconds(ts: Column) -> Column:
    """Timestamp to whole epoch seconds."""
    in_utc()
    return F.unix_timestamp(ts)


def shifted(epoch: Column, offset: Column, unit_seconds: int = 60) -> Column:
    """Epoch seconds moved by an offset; offsets are minutes unless ``unit_seconds`` says otherwise."""
    return epoch + (offset * unit_seconds).cast("bigint")


def local_epoch(ts: Column, zone: Column) -> Column:
    """UTC timestamp to the epoch seconds of the wall clock in ``zone`` at that very moment."""
    in_utc()
    return F.unix_timestamp(F.from_utc_timestamp(ts, zone))


def hour_bucket(epoch: Column) -> Column:
    """Nearest hour, counted from the epoch; half past goes up."""
    return F.floor((epoch + HOUR // 2) / HOUR)


def day_of_year(date: Column) -> Column:
    """Day of the year of a date or ``yyyy-MM-dd`` text."""
    return F.dayofyear(date.try_cast("date"))
