"""The registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import wraps
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

def in_utc(spark: SparkSession) -> bool:
    """Whether the session's zone is UTC all year: the queries turn UTC times without a zone into instants in it."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone in ("Z", "UTC", "GMT", "Etc/UTC", "Etc/GMT", "+00:00", "GMT+0", "UTC+0"):
        return True
    try:
        return all(datetime(2024, m, 1, tzinfo=ZoneInfo(zone)).utcoffset() == timedelta(0) for m in (1, 7))
    except (KeyError, ValueError):  # not a zone's name
        return False


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not in_utc(spark):
                raise ValueError("set spark.sql.session.timeZone to UTC: the tables' times are UTC")
            return f(spark, sf_dir)

        QUERIES[name] = checked
        if sql:
            ORACLE[name] = sql
        return f

    return add


from slotline.plans import captures, joins, metrics, publishing, retention, streams, timelines, web  # noqa: E402, F401
