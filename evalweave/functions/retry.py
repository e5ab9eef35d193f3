"""Retry rules over error messages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.text import contains_any

# Transient error codes and the delay phrase of rate-limit messages.
RETRYABLE_CODES = ("429", "RESOURCE_EXHAUSTED", "503", "UNAVAILABLE")
DELAY_PATTERN = r"retry in ([\d.]+)s"
BACKOFF_BASE_SECONDS = 10
BACKOFF_CAP_SECONDS = 120


def is_retryable(message: Column) -> Column:
    return contains_any(message, RETRYABLE_CODES)


def suggested_delay(message: Column) -> Column:
    """Seconds a message asks to wait; null when it names none."""
    return F.regexp_extract(message, DELAY_PATTERN, 1).try_cast("double")


def retry_delay(message: Column, attempt: Column) -> Column:
    backoff = F.least(
        F.pow(F.lit(2.0), attempt) * BACKOFF_BASE_SECONDS, F.lit(float(BACKOFF_CAP_SECONDS))
    )
    return F.coalesce(suggested_delay(message), backoff)


def retry_action(message: Column, attempt: Column, max_retries: int = 5) -> Column:
    """``wait`` before another try, ``exhausted`` on the last one, ``fail`` at once."""
    return (
        F.when(~is_retryable(message), F.lit("fail"))
        .when(attempt < max_retries - 1, F.lit("wait"))
        .otherwise(F.lit("exhausted"))
    )
