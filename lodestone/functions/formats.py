"""Numbers and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "n/a"


def grouped_int(c: Column, mark: str = ",") -> Column:
    """Digits in groups of three; null is n/a."""
    return F.coalesce(F.replace(F.format_number(c.cast("bigint"), 0), F.lit(","), F.lit(mark)), F.lit(NONE))


def grouped_float(c: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_number(c.cast("double"), digits), F.lit(NONE))


def percent(c: Column) -> Column:
    """A percentage with two digits; null is n/a."""
    return F.when(c.isNull(), NONE).otherwise(F.concat(F.format_string("%.2f", c.cast("double")), F.lit("%")))


def percent_of(count: Column, total: Column) -> Column:
    """n/a where the total is not positive."""
    return F.when(total > 0, F.concat(F.format_string("%.2f", 100.0 * count / total), F.lit("%"))).otherwise(NONE)


def metric(count: Column, total: Column) -> Column:
    """``1_234 (5.67%)``"""
    return F.concat(grouped_int(count, "_"), F.lit(" ("), percent_of(count, total), F.lit(")"))


def unix_ms(ts: Column) -> Column:
    """Milliseconds since 1970, cut towards zero."""
    micros = F.unix_micros(ts)
    return F.when(micros < 0, -F.floor(-micros / 1000)).otherwise(F.floor(micros / 1000)).cast("bigint")


def from_unix_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso_utc(seconds: Column) -> Column:
    """A decimal text of seconds since 1970 as ``2024-01-01T00:00:00.000+00:00``,
    cut to milliseconds; null where it is no number. Does not depend on the
    time zone of the session."""
    ms = F.floor(F.trim(seconds).try_cast("decimal(28,9)") * 1000).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    rest = F.pmod(ms, F.lit(86_400_000))
    clock = F.format_string("T%02d:%02d:%02d.%03d+00:00", F.floor(rest / 3_600_000).cast("int"), F.pmod(F.floor(rest / 60_000), F.lit(60)).cast("int"), F.pmod(F.floor(rest / 1000), F.lit(60)).cast("int"), F.pmod(rest, F.lit(1000)).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), clock)
