"""Generic reads: newest-first pages, batched key lookups, children of
given parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import _page


def recent_rows(df: DataFrame, where: str | None = None, limit=None, offset=0) -> DataFrame:
    """Optional Spark boolean expression, newest ``created_at`` first (NULL
    first, as PostgreSQL sorts DESC) when the table has it, else ``id``
    descending; ``id`` breaks ties. ``limit=None`` returns the whole
    ordered listing."""
    d = df.filter(F.expr(where)) if where else df
    order = ([F.desc_nulls_first("created_at"), F.desc("id")] if "created_at" in df.columns
             else [F.desc_nulls_first("id")])
    return _page(d, order, limit, offset)


def lookup_by_keys(df: DataFrame, keys: DataFrame, cols: list[str] | str, active_only: bool = False) -> DataFrame:
    """Rows whose ``cols`` match a batch of lookup keys (point reads by id,
    order number, phone, (branch, variant) ... re-aimed at a key set).
    Whether the key set is broadcast is the planner's choice from its measured size."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    k = keys.select(*cols).distinct()
    d = df.filter(F.col("is_active") == F.lit(True)) if active_only else df
    return d.join(k, cols, "left_semi")


def rows_by_parent(child: DataFrame, fk: str, parents: DataFrame, pk: str = "id", limit=None,
                   offset=0) -> DataFrame:
    """Children (order items, PO estimates ...) of the given parent rows; a
    page uses the generic list order (newest ``created_at`` first, else
    ``id`` descending)."""
    p = parents.select(F.col(pk).alias("__pk")).distinct()
    out = child.join(p, child[fk] == p["__pk"], "left_semi")
    if limit is None and not offset:
        return out
    return recent_rows(out, None, limit, offset)
