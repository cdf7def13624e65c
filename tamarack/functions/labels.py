"""Formatting of rates, durations, progress and run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, halves away from zero.

    Rounding is done on decimals: a double such as 1.005 is then a true half
    and does not depend on how an engine prints doubles.
    """
    return F.round(value.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")


def rate_label(rate: Column) -> Column:
    """A rate in percent as a file-name-safe label.

    Below 0.01 scientific, below 1 four decimals, else two; the point is
    written ``p``.
    """
    exponent = F.when(rate > 0, F.floor(F.log10(rate)).cast("int")).otherwise(F.lit(0))
    mantissa = rate / F.pow(F.lit(10.0), exponent)
    # 9.995 and above shows as 10.00, which scientific notation writes as 1.00 of the next power
    carry = F.round(mantissa, 2) >= 10
    exponent = F.when(carry, exponent + 1).otherwise(exponent)
    mantissa = F.when(carry, mantissa / 10).otherwise(mantissa)
    scientific = F.concat(
        fixed(mantissa, 2),
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    text = F.when(rate < 0.01, scientific).when(rate < 1, fixed(rate, 4)).otherwise(fixed(rate, 2))
    return F.replace(text, F.lit("."), F.lit("p"))


def duration_label(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours; two decimals."""
    return (
        F.when(seconds < 60, F.concat(fixed(seconds, 2), F.lit(" seconds")))
        .when(seconds < 3600, F.concat(fixed(seconds / 60, 2), F.lit(" minutes")))
        .otherwise(F.concat(fixed(seconds / 3600, 2), F.lit(" hours")))
    )


def remaining_label(seconds: Column) -> Column:
    """Time left: whole seconds, else minutes or hours with one decimal."""
    return (
        F.when(seconds < 60, F.concat(fixed(seconds, 0), F.lit(" seconds")))
        .when(seconds < 3600, F.concat(fixed(seconds / 60, 1), F.lit(" minutes")))
        .otherwise(F.concat(fixed(seconds / 3600, 1), F.lit(" hours")))
    )


def progress_percent(done: Column, total: Column) -> Column:
    """Share done in percent, 0 where nothing is planned."""
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0))


def progress_bar(done: Column, total: Column, blocks: int = 20) -> Column:
    """A bar of full and empty blocks."""
    filled = F.when(total > 0, F.floor(done * blocks / total)).otherwise(F.lit(0)).cast("int")
    filled = F.least(F.greatest(filled, F.lit(0)), F.lit(blocks))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(blocks) - filled))


def run_name(base_path: Column, started: Column) -> Column:
    """Last part of a model path and the start time."""
    base = F.element_at(F.split(F.rtrim(base_path, F.lit("/")), "/"), -1)
    return F.concat_ws("_", base, F.date_format(started, "yyyyMMdd_HHmmss"))
