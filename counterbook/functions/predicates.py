"""Filter building blocks shared by the reports and registers.

Predicates compare the raw column against literals so that Catalyst can push
them into the parquet scan (``PushedFilters``) instead of evaluating a
function of the column per row.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(value: str | dt.date) -> Column:
    return F.lit(str(value)).cast("date")


def day_range(c: Column | str, start: str | dt.date | None, end: str | dt.date | None) -> Column:
    """Half-open range ``[start, end + 1 day)`` on a timestamp column; either
    bound may be omitted."""
    c = F.col(c) if isinstance(c, str) else c
    conds = []
    if start is not None:
        conds.append(c >= _date(start))
    if end is not None:
        conds.append(c < F.date_add(_date(end), 1))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def date_between(c: Column | str, start: str | dt.date | None, end: str | dt.date | None) -> Column:
    """Inclusive range on a DATE column; either bound may be omitted."""
    c = F.col(c) if isinstance(c, str) else c
    conds = []
    if start is not None:
        conds.append(c >= _date(start))
    if end is not None:
        conds.append(c <= _date(end))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def not_cancelled(c: Column | str = "order_status") -> Column:
    """``status NOT IN ('cancelled')``: a NULL status is unknown and so is
    dropped, exactly as SQL three-valued logic does."""
    c = F.col(c) if isinstance(c, str) else c
    return ~c.isin("cancelled")


def optional_filters(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """AND of equality predicates, one per argument actually given."""
    for name, value in (filters or {}).items():
        if value is None or value == "":
            continue
        df = df.filter(F.col(name) == F.lit(value))
    return df


def truthy_text(c: Column | str) -> Column:
    """Query-string boolean: only 'true' or '1' (case-sensitive) are true."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isin("true", "1"), F.lit(False))
