"""One rule for missing values: where a value is needed and absent, the job
fails with a clear message.  A missing score, feature or label is never dropped
or ranked, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def required(c: Column, what: str) -> Column:
    """The column itself; raises for a NULL."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"{what} is missing (NULL)"))).otherwise(c)


def required_number(c: Column, what: str) -> Column:
    """A double; raises for NULL and NaN."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c)
    return F.when(bad, F.raise_error(F.lit(f"{what} is missing (NULL or NaN)"))).otherwise(c)


def required_numbers(c: Column, what: str) -> Column:
    """An array of doubles; raises for a NULL array and NULL or NaN elements."""
    bad = c.isNull() | F.exists(c, lambda v: v.isNull() | F.isnan(v))
    return F.when(bad, F.raise_error(F.lit(f"{what} is missing (NULL or NaN)"))).otherwise(c)
