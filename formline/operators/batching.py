"""Temporal batches: matches whose mutual order is uncertain share one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators.ordering import with_ordinal

# --- Fixed values: usable kickoff times -------------------------------------
CLOCK = r"^([01]?\d|2[0-3]):([0-5]?\d)$"
UNTRUSTED_CLOCK = r"^00:[0-5][0-9]$"


def reliable_clock(kickoff: Column) -> Column:
    """True when the kickoff text gives a trustworthy time of day."""
    text = F.trim(F.coalesce(kickoff, F.lit("")))
    return text.rlike(CLOCK) & ~text.rlike(UNTRUSTED_CLOCK)


UNDATED = "matches need a parseable date"


def assign_batches(matches: DataFrame, date: str = "date", kickoff: str = "kickoff", undated: bool = False) -> DataFrame:
    """Add ``batch_ts`` and ``whole_day``. A row without a date stops the job, or with ``undated`` has neither.

    One unreliable kickoff turns its whole date into one batch. The flag is
    aggregated per date before it is joined back, so a hot date never gathers
    in one task; the joined table has one row per calendar day.
    """
    day = F.coalesce(F.col(date), F.raise_error(UNDATED).cast("date"))
    rows = matches if undated else matches.withColumn(date, day)
    days = rows.groupBy(date).agg(F.bool_or(~reliable_clock(F.col(kickoff))).alias("whole_day"))
    text = F.trim(F.coalesce(F.col(kickoff), F.lit("")))
    minutes = (F.regexp_extract(text, CLOCK, 1).try_cast("int") * 60
               + F.regexp_extract(text, CLOCK, 2).try_cast("int"))
    midnight = F.col(date).cast("timestamp_ntz")
    at_kickoff = midnight + F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))
    # Bounded by the calendar: one row per distinct date.
    return rows.join(F.broadcast(days), date, "left" if undated else "inner").withColumn(
        "batch_ts", F.when(F.col("whole_day"), midnight).otherwise(at_kickoff))


def with_identity(df: DataFrame) -> DataFrame:
    """Add ``ident``, the order-independent key used inside a batch."""
    return df.withColumn("ident", F.concat_ws("\x1f", "home", "away"))


def prepare_batches(matches: DataFrame, row_id: str = "match_id") -> DataFrame:
    """Batched matches with the dense ``row_no`` of the (batch, input) order."""
    return with_ordinal(assign_batches(matches), ["batch_ts", row_id], "row_no")
