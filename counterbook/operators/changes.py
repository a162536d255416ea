"""Table-change operators: validated append, patches by id, deletes with
declared foreign-key actions, schema evolution.

Parquet has no row-level update, so each operator returns the full new
table version; the caller writes it to a new path (never over the path being
read)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import new_id
from ..session import cut_lineage
from ..sources.schemas import DEFAULTS, FOREIGN_KEYS
from .quality import validation_errors


def append_rows(target: DataFrame, incoming: DataFrame, table: str | None = None,
                defaults: dict[str, Column] | None = None, key_cols: list[str] | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """Validated INSERT: rows are checked against the table's input rules
    (all required fields); keys that are not target columns are dropped;
    columns not given, or not known to the batch, take ``defaults``, else the
    table's declared defaults, else: ``id`` derived from
    ``key_cols`` when given, else uuid(),
    ``created_at`` / ``updated_at`` = current time, else NULL. A batch with
    no target column at all is refused. Returns (outcome with ``errors``,
    new table)."""
    common = [c for c in incoming.columns if c in target.columns]
    if not common:
        raise ValueError("No valid columns provided for insert")
    checked = incoming.withColumn("errors", validation_errors(incoming, table, True) if table
                                  else F.array().cast("array<string>"))
    ok = checked.filter(F.size("errors") == 0)
    # ids from the batch's natural key when one is named (same on every
    # evaluation); uuid() otherwise
    row_id = (new_id(table or "row", target.schema["id"].dataType, *key_cols)
              if key_cols and "id" in target.columns else F.expr("uuid()"))
    dflt = {"id": row_id, "created_at": F.localtimestamp(), "updated_at": F.localtimestamp()}
    dflt.update({c: F.lit(v) for c, v in DEFAULTS.get(table, {}).items()})
    dflt.update(defaults or {})
    rows = ok.select(*[
        (F.col(c) if c in common else dflt.get(c, F.lit(None))).cast(target.schema[c].dataType).alias(c)
        for c in target.columns])
    return checked, target.unionByName(rows)


def append_accepted(ledger: DataFrame, outcome: DataFrame, namespace: str, id_expr: Column | None = None,
                    as_of="1970-01-01 00:00:00") -> DataFrame:
    """New ledger version: the ledger plus a posting job's accepted rows (``reject_reason`` NULL). Ids
    come from the unique reference number unless ``id_expr`` is given; time stamps not in the outcome are ``as_of``."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    ok = outcome.filter(F.col("reject_reason").isNull())
    row_id = id_expr if id_expr is not None else (
        new_id(namespace, ledger.schema["id"].dataType, "reference_number") if "id" in ledger.columns else None)
    return ledger.unionByName(ok.select(*[
        (row_id if c == "id" else F.col(c) if c in ok.columns else now if c in ("created_at", "updated_at") else F.lit(None))
        .cast(ledger.schema[c].dataType).alias(c) for c in ledger.columns]))


def apply_patches(target: DataFrame, patches: DataFrame, key: str = "id", seq: str | None = None,
                  table: str | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE by key of the patch columns that exist in the target (other
    patch columns are ignored; a batch with none is refused). Several patches
    of one key apply in ``seq`` order, so the last one wins; without ``seq`` their order is
    that of their values (the largest wins), so a key never yields two rows. Patches are
    validated without the required-field rule. Returns (outcome with
    ``errors`` and ``matched``, new table)."""
    cols = [c for c in patches.columns if c in target.columns and c != key]
    if not cols:
        raise ValueError("No valid columns provided for update")
    checked = patches.withColumn("errors", validation_errors(patches, table, False) if table
                                 else F.array().cast("array<string>"))
    ok = checked.filter(F.size("errors") == 0)
    order = F.col(seq) if seq is not None else F.struct(*cols)
    last = ok.groupBy(F.col(key).alias("__pk")).agg(F.max_by(F.struct(*cols), order).alias("__p"))
    last = last.select("__pk", *[F.col("__p." + c).alias("__n_" + c) for c in cols])
    j = target.join(last, target[key] == last["__pk"], "left")
    hit = F.col("__pk").isNotNull()
    new = j.select(*[F.when(hit, F.col("__n_" + c).cast(target.schema[c].dataType)).otherwise(target[c]).alias(c)
                     if c in cols else target[c] for c in target.columns])
    keys = target.select(F.col(key).alias("__tk"))
    outcome = checked.join(keys, checked[key] == keys["__tk"], "left").withColumn(
        "matched", F.col("__tk").isNotNull()).drop("__tk")
    return outcome, new


def delete_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """DELETE ... RETURNING: (kept rows, deleted rows)."""
    k = keys.select(F.col(key).alias("__dk")).distinct()
    kept = df.join(k, df[key] == k["__dk"], "left_anti")
    gone = df.join(k, df[key] == k["__dk"], "left_semi")
    return kept, gone


class DeleteRefused(ValueError):
    pass


def _cascade_order(tables: dict[str, DataFrame], table: str) -> list[str]:
    """The tables given that cascades reach from ``table``, each after all those it takes deletes from."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for child, _, parent, action in FOREIGN_KEYS:
            if parent == name and action == "cascade" and child in tables and child != name:
                visit(child)
        order.insert(0, name)

    visit(table)
    return order


def propagate_deletes(tables: dict[str, DataFrame], table: str, keys: DataFrame, key: str = "id",
                      check_restrict: bool = True) -> dict[str, DataFrame]:
    """Delete ``keys`` from ``table`` and apply the declared foreign-key
    actions to the tables given: CASCADE deletes child rows (recursively),
    SET NULL clears the reference, RESTRICT / NO ACTION refuses the whole
    delete when a child row that is left still refers to a deleted key. Returns the new versions of
    every table.

    Tables are taken in the order of their cascades, so each one's set of deleted keys is found once, from its parents' sets, and checkpointed: the plan grows with
    the foreign keys, not with the ways through them. All RESTRICT keys are checked on the final sets by one aggregate."""
    order = _cascade_order(tables, table)
    doomed = {table: cut_lineage(keys.select(F.col(key).alias("__dk")).distinct())}

    def edges(kind, child=None):
        return [e for e in FOREIGN_KEYS if e[3] == kind and e[0] in tables and e[2] in doomed and (child is None or e[0] == child)]

    def left(name):
        """The table without its deleted rows."""
        df = tables[name]
        own = "id" if name != table else key
        if name in doomed and own in df.columns:
            return df.join(doomed[name], df[own] == F.col("__dk"), "left_anti")
        for _, col, parent, _ in edges("cascade", name):
            df = df.join(doomed[parent], df[col] == F.col("__dk"), "left_anti")
        return df

    for name in order[1:]:
        df = tables[name]
        if "id" in df.columns:  # a child without an id is parent to none
            hit = [df.join(doomed[parent], df[col] == F.col("__dk"), "left_semi").select("id") for _, col, parent, _ in edges("cascade", name)]
            doomed[name] = cut_lineage(reduce(DataFrame.unionByName, hit).select(F.col("id").alias("__dk")).distinct())
    kept = {name: left(name) for name in tables if name in order}
    if check_restrict and (bars := edges("restrict")):
        probes = [kept.get(child, tables[child]).join(doomed[parent], F.col(col) == F.col("__dk"), "left_semi").select(F.lit(n).alias("n")) for n, (child, col, parent, _) in enumerate(bars)]
        held = reduce(DataFrame.unionByName, probes).agg(F.min("n").alias("n")).first()["n"]
        if held is not None:
            child, col, parent, _ = bars[held]
            raise DeleteRefused(f"{child}.{col} still references {parent}")
    out = {**tables, **kept}
    for child, col, parent, _ in edges("set_null"):
        c = out[child]
        j = c.join(doomed[parent], c[col] == F.col("__dk"), "left")
        out[child] = j.select(*[F.when(F.col("__dk").isNotNull(), F.lit(None).cast(c.schema[x].dataType)).otherwise(c[x]).alias(x) if x == col else c[x] for x in c.columns])
    return out


def evolve_schema(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Additive migration: every column of ``schema`` missing from ``df`` is
    added with its default (or NULL); existing columns are left as they are;
    column order follows ``schema`` with extra columns kept at the end."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name))
        else:
            v = defaults.get(f.name)
            cols.append((v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)
