"""What may be deleted: a report of checks per camera of one period, and the captures whose camera passed all of them.

Nothing here deletes a file. A camera that fails a check does not hold up the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.functions import slots
from slotline.operators import capture, timeline


def report(
    manifest: DataFrame, on_disk: DataFrame, listing: DataFrame, samples: DataFrame, sources: DataFrame,
    period: str, days: int, origin: str, due: bool,
) -> DataFrame:
    """(camera, period, check, found, passed) for every camera with captures on disk.

    ``manifest``: the slots of the output. ``on_disk``: (camera, g) of the captures there now. ``listing``: names, for those
    that are no capture's. ``samples`` with their scores and the ``sources`` that still exist. All but the first two steps
    work on one row for each camera.

    due: the period is old enough. strays: misnamed files, told and never a failure. shape: as many rows as the period has
    slots. days: photos named for another day than they stand at. late: slots on disk that the output does not use.
    samples: samples that are not alike enough, or none checked.
    """
    late = timeline.late_arrivals(on_disk, manifest.filter("state = 'P'")).groupBy("camera").agg(F.count("*").alias("late"))
    shape = timeline.manifest_validate(manifest, days, origin)
    sampled = timeline.sample_reconcile(samples, sources).select("camera", "failing", F.col("passed").alias("alike"))
    each = on_disk.select("camera").distinct()
    for part in (late, shape, sampled, capture.stray_count(listing, "camera")):
        each = each.join(part, "camera", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    sure = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        ("due", F.lit(1).cast("long"), F.lit(due)), ("strays", n("strays"), F.lit(True)), ("shape", n("n_rows"), sure(F.col("complete"))),
        ("days", n("misnamed"), sure(F.col("misnamed") == 0)), ("late", n("late"), n("late") == 0), ("samples", n("failing"), sure(F.col("alike"))),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("check"), f.alias("found"), p.alias("passed")) for c, f, p in checks])
    return each.select("camera", F.lit(period).alias("period"), F.inline(rows))


def deletions(listing: DataFrame, report_: DataFrame) -> DataFrame:
    """Captures of the period, failed ones among them, whose camera passed every check; strays stay."""
    good = report_.groupBy("camera", "period").agg(F.bool_and("passed").alias("good")).filter("good").drop("good")
    named = listing.filter(slots.is_name(F.col("name"))).withColumn("period", slots.month_of_name(F.col("name")))
    return named.join(good, ["camera", "period"], "left_semi")
