"""Dates and times as the reports print them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

REPORT_ZONE = "Asia/Kolkata"
CLOCK_FORMAT = "yyyy-MM-dd HH:mm:ss"


def ist_text(at: Column | None = None, suffix: str = "", source_zone: Column | None = None) -> Column:
    """An instant as wall-clock text in Indian Standard Time; the current time when none is given.

    A zoned timestamp needs no ``source_zone``; for a zone-less one it says which zone it is in.
    """
    instant = F.current_timestamp() if at is None else at
    if source_zone is None:
        # Through UTC: the wall clock of the session's zone is ambiguous in the hour that clocks go back.
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        zone, wall = F.lit("UTC"), F.timestamp_add("MICROSECOND", F.unix_micros(instant.cast("timestamp_ltz")), epoch)
    else:
        zone, wall = source_zone, instant.cast("timestamp_ntz")
    local = F.convert_timezone(zone, F.lit(REPORT_ZONE), wall)
    text = F.date_format(local, CLOCK_FORMAT)
    return F.concat(text, F.lit(suffix)) if suffix else text


def prediction_date(as_of: dt.date | None = None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


def prediction_date_text(as_of: dt.date | None = None) -> Column:
    return F.date_format(prediction_date(as_of), "yyyy-MM-dd")
