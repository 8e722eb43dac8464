"""Column functions for slotted captures: names, slots, periods, captions. All stay within Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MINUTES = 5
SLOTS_PER_DAY = 288
FRAMES_PER_SECOND = 24
MIN_BYTES = 1024
HOLD = 6
LOCAL_ZONE = "Europe/Vilnius"
#: A capture's name: the UTC instant to the second.
NAME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}:[0-9]{2}:[0-9]{2}\.jpg$"


def is_name(name: Column) -> Column:
    return name.rlike(NAME)


def slot_of_name(name: Column) -> Column:
    """The slot of the day by character places, not by a parsed time: 12:75 counts as 13:15."""
    minutes = F.substring(name, 12, 2).cast("int") * 60 + F.substring(name, 15, 2).cast("int")
    return F.floor(minutes / SLOT_MINUTES).cast("int")


def day_of_name(name: Column) -> Column:
    return F.substring(name, 1, 10)


def month_of_name(name: Column) -> Column:
    return F.substring(name, 1, 7)


def epoch_of_name(name: Column) -> Column:
    """The instant of a name, in seconds; null where the clock is not one."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(name, 1, 19), F.lit("yyyy-MM-dd_HH:mm:ss")))


def global_slot(day: Column, slot: Column, origin: str) -> Column:
    """Slots since the first of ``origin``."""
    return F.datediff(day.cast("date"), F.lit(origin).cast("date")) * SLOTS_PER_DAY + slot


def slot_time(g: Column, origin: str) -> Column:
    """The instant at which a global slot begins."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(origin).cast("timestamp")) + g * SLOT_MINUTES * 60)


def next_month(month: Column) -> Column:
    return F.date_format(F.add_months(F.concat(month, F.lit("-01")).cast("date"), 1), "yyyy-MM")


def local(ts: Column) -> Column:
    """A UTC instant on the local clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), ts.cast("timestamp_ntz"))


def local_day_badge(ts: Column) -> Column:
    return F.date_format(local(ts), "EEE yyyy-MM-dd")


def zone_letters(ts: Column) -> Column:
    """EET or EEST, from the local clock's distance to UTC."""
    hours = (F.unix_timestamp(local(ts).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 3600
    return F.when(hours == 3, "EEST").otherwise("EET")


def gap_text(minutes: Column) -> Column:
    """How long an outage has lasted, in fixed widths: 59m, 02h 00m, 1d 00h."""
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes < 60, F.format_string("%02dm", minutes))
        .when(minutes < 1440, F.format_string("%02dh %02dm", hours, minutes % 60))
        .otherwise(F.format_string("%dd %02dh", days, hours % 24))
    )


def frame_clock(frame: Column) -> Column:
    """A frame's place in the film as H:MM:SS.cc."""
    cs = F.floor(frame * 100 / FRAMES_PER_SECOND)
    part = lambda of, by: F.floor(cs / of) % by
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), part(6000, 60), part(100, 60), cs % 100)


def chapter_ms(day_index: Column) -> Column:
    return F.floor(day_index * SLOTS_PER_DAY * 1000 / FRAMES_PER_SECOND).cast("long")


def manifest_line(frame: Column, state: Column, src: Column) -> Column:
    return F.format_string("%04d %s %-23s", frame, state, F.coalesce(src, F.lit("")))
