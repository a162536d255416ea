"""Money columns.

All money is DECIMAL(12,2) as in the ledgers. Rounding is decimal HALF_UP
and never goes through a double. Report outputs are widened to
DECIMAL(38,2) so sums never overflow, whatever the scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
MONEY_OUT = T.DecimalType(38, 2)


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def money_out(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY_OUT)


def zero_money(out: bool = True) -> Column:
    return F.lit(0).cast(MONEY_OUT if out else MONEY)
