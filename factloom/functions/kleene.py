"""Three-valued logic where NULL is unknown, also over groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kleene_any(verdict: Column) -> Column:
    """Aggregate: true if any is true, else unknown if any is unknown, else false. A group always has a row, so the
    empty set is up to the caller."""
    return F.when(F.bool_or(verdict), True).when(F.count_if(verdict.isNull()) > 0, None).otherwise(False)


def kleene_all(verdict: Column) -> Column:
    """Aggregate: false if any is false, else unknown if any is unknown, else true."""
    return F.when(~F.bool_and(verdict), False).when(F.count_if(verdict.isNull()) > 0, None).otherwise(True)


def built(present: Column) -> Column:
    """Presence over implementing parts: any true, else any false, else unknown."""
    return F.when(F.bool_or(present), True).when(F.bool_or(~present), False)
