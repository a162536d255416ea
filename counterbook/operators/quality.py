"""Data-quality audits over whole tables: input validation, enum domains,
CHECK constraints, unique keys and foreign keys (orphans).

Each audit is a column expression or one aggregate / anti join; nothing is
collected to the driver."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import UUID_ANY, number
from ..sources.schemas import CHECKS, DOMAINS, ENUMS, FOREIGN_KEYS, TABLE_DDL, VALIDATION, table_schema

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _type_error(c: Column, kind: str, dtype: T.DataType, values: list[str] | None) -> Column:
    """Condition (on a non-NULL value) that the value has the wrong type."""
    is_str = isinstance(dtype, T.StringType)
    if kind in ("string", "text"):
        return F.lit(not is_str)
    if kind == "number":
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.isnan(c)
        return F.lit(not isinstance(dtype, _NUMERIC_TYPES))
    if kind == "numeric":
        if isinstance(dtype, _NUMERIC_TYPES):
            return F.lit(False)
        if is_str:
            return number(c).isNull()
        return F.lit(True)
    if kind == "boolean":
        return F.lit(not isinstance(dtype, T.BooleanType))
    if kind == "uuid":
        # typed (numeric) keys are valid by construction
        return ~c.rlike(UUID_ANY) if is_str else F.lit(not isinstance(dtype, _NUMERIC_TYPES))
    if kind == "enum":
        return ~c.cast("string").isin(*values) if values else F.lit(False)
    if kind in ("date", "timestamp"):
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(False)
        if is_str:
            return F.coalesce(c.try_cast("timestamp"), c.try_cast("date").cast("timestamp")).isNull()
        return F.lit(True)
    return F.lit(False)


# Validation messages ("<table>.<field> " + text).
_MESSAGES = {"string": "must be a string", "text": "must be a string", "number": "must be a number",
             "numeric": "must be numeric", "boolean": "must be boolean", "uuid": "must be a UUID",
             "date": "must be a valid date/time", "timestamp": "must be a valid date/time"}
MSG_REQUIRED = "is required"
MSG_NOT_NULL = "cannot be null"
MSG_ENUM = "must be one of: "


def validation_errors(df: DataFrame, table: str, require_all: bool = True) -> Column:
    """``array<string>`` of every rule the row breaks, in rule order (the
    first one is the message a single-row insert would raise). A column
    missing from the frame is 'not provided' and only fails ``required``."""
    rules = VALIDATION.get(table)
    if not rules:
        return F.array().cast("array<string>")
    msgs = []
    for rule in rules:
        field, kind, flag = rule[0], rule[1], rule[2]
        values = ENUMS.get(rule[3]) if len(rule) > 3 else None
        prefix = f"{table}.{field} "
        if field not in df.columns:
            if require_all and flag == "required":
                msgs.append(F.lit(prefix + MSG_REQUIRED))
            continue
        c = F.col(field)
        dtype = df.schema[field].dataType
        blank = c.isNull() | ((c == "") if isinstance(dtype, T.StringType) else F.lit(False))
        if require_all and flag == "required":
            msgs.append(F.when(blank, F.lit(prefix + MSG_REQUIRED)))
        if flag == "not_null":
            msgs.append(F.when(c.isNull(), F.lit(prefix + MSG_NOT_NULL)))
        if require_all and flag == "required":
            bad = ~blank & _type_error(c, kind, dtype, values)
        else:
            bad = c.isNotNull() & _type_error(c, kind, dtype, values)
        text = (MSG_ENUM + ",".join(values)) if kind == "enum" and values else _MESSAGES.get(kind, "is invalid")
        msgs.append(F.when(bad, F.lit(prefix + text)))
    return F.filter(F.array(*msgs), lambda m: m.isNotNull())


def validate_rows(df: DataFrame, table: str, require_all: bool = True) -> DataFrame:
    """Adds ``errors`` (array<string>, empty when the row is valid)."""
    return df.withColumn("errors", validation_errors(df, table, require_all))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = validated.filter(F.size("errors") == 0).drop("errors")
    bad = validated.filter(F.size("errors") > 0)
    return ok, bad


def audit_domain(df: DataFrame, table: str, domains: dict[str, str] | None = None) -> DataFrame:
    """Values outside each enum domain: (table_name, column_name, value, row_count), in one pass over the table."""
    doms = {c: e for c, e in (domains or DOMAINS.get(table, {})).items() if c in df.columns}
    if not doms:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, value string, row_count bigint")
    outside = [F.when(~F.col(c).cast("string").isin(*ENUMS[e]),
                      F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))) for c, e in doms.items()]
    found = df.select(F.explode(F.filter(F.array(*outside), lambda x: x.isNotNull())).alias("x"))
    return found.groupBy("x.column_name", "x.value").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("table_name"), "column_name", "value", "row_count")


def _columns_of(cond: str) -> set[str]:
    """Names a CHECK condition mentions (its words that are not inside quotes)."""
    return {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", cond))}


def applicable_checks(df: DataFrame, table: str, checks: list[tuple[str, str]] | None = None) -> tuple[list, list[str]]:
    """(checks that the frame has every column for, names of the others). Which words of a
    condition are columns is read from the table's declared schema."""
    declared = {f.name.lower() for f in table_schema(table).fields} if table in TABLE_DDL else set()
    have = {c.lower() for c in df.columns}
    runs, skipped = [], []
    for name, cond in checks or CHECKS.get(table, []):
        if (_columns_of(cond) & declared) - have:
            skipped.append(name)
        else:
            runs.append((name, cond))
    return runs, skipped


def audit_checks(df: DataFrame, table: str, key: str = "id", checks: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows breaking a CHECK constraint: (check_name, row_key), in one pass over the table. A NULL outcome
    passes, as in SQL. A check over a column that the frame lacks is reported as a row of
    its own, with '(skipped)' after its name and a NULL key; any other failure of a condition is raised."""
    runs, skipped = applicable_checks(df, table, checks)
    kind = df.schema[key].dataType.simpleString()
    broken = [F.when(F.coalesce(~F.expr(cond), F.lit(False)), F.lit(name)) for name, cond in runs]
    names = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    out = df.select(F.explode(names).alias("check_name"), F.col(key).alias("row_key"))
    if skipped:
        missing = df.sparkSession.createDataFrame([(f"{n} (skipped)", None) for n in skipped], f"check_name string, row_key {kind}")
        out = out.unionByName(missing)
    return out


def audit_unique(df: DataFrame, cols: list[str], where: str | None = None) -> DataFrame:
    """Key values held by more than one row (rows with a NULL key part are
    ignored, as a unique index does): key columns + row_count."""
    d = df.filter(F.expr(where)) if where else df
    nn = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return d.filter(nn).groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def audit_references(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """Orphans: child rows whose non-NULL ``fk`` has no parent row."""
    p = parent.select(F.col(pk).alias("__pk"))
    c = child.filter(F.col(fk).isNotNull())
    return c.join(p, c[fk] == p["__pk"], "left_anti")


def audit_all_references(tables: dict[str, DataFrame], edges: list[tuple] | None = None, pk: str = "id") -> DataFrame | None:
    """Orphan counts of every declared foreign key between the tables given, (child, fk, parent, row_count) where there are any, in one pass: all
    tables are read once, each row gives a claim for every reference it holds and an offer of its own key for every edge that
    points at its table, and one aggregate by (edge, key) over all of them finds the keys that are claimed and not offered. Claims are
    counted before the shuffle, so a parent that a third of all rows refer to is one row for each task. None without edges."""
    used = [(n, *e[:3]) for n, e in enumerate(edges if edges is not None else FOREIGN_KEYS) if e[0] in tables and e[2] in tables]
    parts = []
    for name, df in tables.items():
        claims = [F.struct(F.lit(n).alias("edge"), F.col(fk).cast("string").alias("key"), F.lit(False).alias("offer")) for n, child, fk, _ in used if child == name]
        offers = [F.struct(F.lit(n).alias("edge"), F.col(pk).cast("string").alias("key"), F.lit(True).alias("offer")) for n, _, _, parent in used if parent == name]
        if claims or offers:
            parts.append(df.select(F.explode(F.array(*claims, *offers)).alias("x")).select("x.*"))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts).filter(F.col("key").isNotNull())
    keys = rows.groupBy("edge", "key").agg(F.bool_or("offer").alias("offered"), F.count_if(~F.col("offer")).alias("claims"))
    missing = keys.filter(~F.col("offered")).groupBy("edge").agg(F.sum("claims").alias("row_count"))
    names = F.create_map(*[x for n, child, fk, parent in used for x in (F.lit(n), F.struct(F.lit(child).alias("child"), F.lit(fk).alias("fk"), F.lit(parent).alias("parent")))])
    return missing.select(names[F.col("edge")].alias("e"), "row_count").select("e.*", "row_count")
