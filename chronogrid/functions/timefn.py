"""Time and grid expressions; every clock is passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronogrid.constants import RESOLUTION_MS

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def floor_index(ms: Column, step_ms: int = RESOLUTION_MS) -> Column:
    """Grid index of an epoch-ms value; floors also below zero."""
    return F.call_function("div", ms - F.pmod(ms, F.lit(step_ms)), F.lit(step_ms)).cast("bigint")


def snap(ms: Column, step_ms: int = RESOLUTION_MS) -> Column:
    return ms - F.pmod(ms, F.lit(step_ms))


def parse_iso_ms(text: Column) -> Column:
    """ISO text to epoch ms; text without a zone is UTC; NULL when unreadable."""
    return F.unix_millis(F.try_to_timestamp(text))


def to_epoch_ms(text: Column) -> Column:
    """Number, numeric text or ISO text to epoch ms."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), parse_iso_ms(text))


def iso_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), ISO_MS)


def format_epoch(ms: Column, zone: str | None = None) -> Column:
    """Display text; an absent or zero time shows a dash."""
    moment = F.timestamp_millis(ms)
    if zone is None:
        text = F.date_format(moment, "yyyy-MM-dd HH:mm:ss 'UTC'")
    else:
        text = F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd HH:mm:ss")
    return F.when(ms.isNull() | (ms == 0), F.lit("—")).otherwise(text)


def rel_time(ms: Column, now_ms: Column) -> Column:
    """Age of a time against an injected now, in the largest whole unit."""
    gap = F.floor((now_ms - ms) / F.lit(1000)).cast("bigint")
    size = F.abs(gap)
    ahead = gap < 0

    def whole(seconds: int) -> Column:
        return F.floor(size / F.lit(seconds)).cast("string")

    hours_left = F.concat(
        whole(3600), F.lit("h "), F.lpad(F.floor(size % 3600 / F.lit(60)).cast("string"), 2, "0"), F.lit("m")
    )
    amount = (
        F.when(size < 3600, F.concat(whole(60), F.lit("m")))
        .when(size < 86400, F.when(ahead, hours_left).otherwise(F.concat(whole(3600), F.lit("h"))))
        .when(size < 86400 * 30, F.concat(whole(86400), F.lit("d")))
        .otherwise(F.concat(whole(86400 * 30), F.lit("mo")))
    )
    return (
        F.when(ms.isNull() | (ms == 0), F.lit("—"))
        .when(size < 60, F.when(ahead, F.lit("in <1m")).otherwise(F.lit("just now")))
        .when(ahead, F.concat(F.lit("in "), amount))
        .otherwise(F.concat(amount, F.lit(" ago")))
    )


def offset_ms(offset: Column) -> Column:
    """``UTC-0400`` to signed milliseconds; anything else is zero."""
    sign = F.regexp_extract(offset, r"UTC([+-])(\d{2})(\d{2})", 1)
    hours = F.regexp_extract(offset, r"UTC([+-])(\d{2})(\d{2})", 2).try_cast("bigint")
    minutes = F.regexp_extract(offset, r"UTC([+-])(\d{2})(\d{2})", 3).try_cast("bigint")
    size = (hours * 3600 + minutes * 60) * 1000
    return F.coalesce(F.when(sign == "-", -size).otherwise(size), F.lit(0).cast("bigint"))


def parse_local_ts_ms(text: Column, offset: Column, offset_mode: str = "reference") -> Column:
    """Local sheet time plus offset text to epoch ms, NULL when unreadable.

    ``reference`` adds the signed offset, as the sheets have always been read;
    ``utc`` subtracts it, which is the true instant of a local clock. The
    fraction is rounded to a whole unit in the first mode (the established
    reading) and kept in milliseconds in the second.
    """
    shape = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})\.(\d{1,6})"
    clean = F.trim(text)
    day = F.regexp_extract(clean, shape, 1)
    clock = F.regexp_extract(clean, shape, 2)
    fraction = F.concat(F.lit("0."), F.regexp_extract(clean, shape, 3)).try_cast("double")
    wall = F.unix_millis(F.try_to_timestamp(F.concat(day, F.lit(" "), clock)))
    shift = offset_ms(F.coalesce(offset, F.lit("")))
    if offset_mode == "reference":
        return wall + shift + F.when(fraction > 0.5, F.lit(1)).otherwise(F.lit(0))
    if offset_mode == "utc":
        return wall - shift + F.floor(fraction * 1000)
    raise ValueError(f"unknown offset_mode {offset_mode!r}")


def late_status(delay_ms: Column, on_time_ms: int, delayed_ms: int) -> Column:
    return (
        F.when(delay_ms <= on_time_ms, F.lit("ON_TIME"))
        .when(delay_ms <= delayed_ms, F.lit("DELAYED"))
        .otherwise(F.lit("BACKFILLED"))
    )
