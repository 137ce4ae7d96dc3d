"""Progress of jobs, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The share of each stage in percent
WEIGHTS = {"convert": (0, 15), "detect": (15, 25), "ocr": (25, 75), "refine": (75, 90), "embed": (90, 100)}


def percent(stage: Column, current: Column, total: Column) -> Column:
    """The whole job's percent of a stage's progress; unknown stages are taken for the whole job."""
    lo, hi = F.lit(0), F.lit(100)
    for name, (a, b) in WEIGHTS.items():
        lo, hi = F.when(stage == name, a).otherwise(lo), F.when(stage == name, b).otherwise(hi)
    done = lo + (current / F.when(total > 0, total) * (hi - lo)).cast("int")
    return F.when(total <= 0, lo).otherwise(done).cast("int")


def latest(events: DataFrame) -> DataFrame:
    """(job_id, stage, percent, message) of each job's last event; works on streams in complete or update mode."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("stage", "current", "total", "message"), "seq").alias("e"))
    return last.select("job_id", "e.stage", percent(F.col("e.stage"), F.col("e.current"), F.col("e.total")).alias("percent"), "e.message")


def reading_label(dense: Column, sparse: Column) -> Column:
    """What a job is at while it reads pages."""
    return F.when(dense > 0, F.format_string("OCR (%d dense / %d sparse)", dense, sparse)).otherwise(F.lit("OCR"))
