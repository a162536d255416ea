"""Text checks used by the posting and validation jobs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two UUID patterns of the reference (any version; and only
# versions 1-5 with the RFC 4122 variant).
UUID_ANY = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UUID_RFC = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
# Philippine mobile number forms.
MOBILE_LOCAL = r"^09[0-9]{9}$"
MOBILE_INTL = r"^639[0-9]{9}$"
# Fixed value: decimal number text (no type suffix, no NaN or Infinity).
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """NULL or only whitespace."""
    c = col_of(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def required_text(c: Column | str) -> Column:
    """Trimmed text, NULL when missing or blank."""
    c = col_of(c)
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def number(c: Column | str) -> Column:
    """A finite number from a number or from trimmed decimal text, as DOUBLE; NULL for
    anything else ('5d', 'NaN' and blank text are not numbers)."""
    t = F.trim(col_of(c).cast("string"))
    d = F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))
    return F.when(F.abs(d) != float("inf"), d)


def id_ok(c: Column | str, dtype: T.DataType, strict: bool = True) -> Column:
    """An optional id is acceptable when NULL/'' or, for text ids, when it has
    the UUID shape. Typed (numeric) keys are valid by construction."""
    c = col_of(c)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "") | c.rlike(UUID_RFC if strict else UUID_ANY)
    return F.lit(True)


def id_or_null(c: Column | str, dtype: T.DataType) -> Column:
    c = col_of(c)
    if isinstance(dtype, T.StringType):
        return F.when(c != "", c)
    return c


def normalize_mobile(c: Column | str) -> Column:
    """Digits only; '09' + 9 digits kept, '639' + 9 digits rewritten to
    '0' + the rest; anything else is NULL (invalid)."""
    digits = F.regexp_replace(col_of(c).cast("string"), r"[^0-9]", "")
    return (F.when(digits.rlike(MOBILE_LOCAL), digits)
            .when(digits.rlike(MOBILE_INTL), F.concat(F.lit("0"), F.substring(digits, 3, 100))))


def stable_id(namespace: str, *cols: Column | str) -> Column:
    """Deterministic UUID-shaped id (version-5 layout, RFC variant) from a
    namespace and a row's natural unique key. Unlike ``uuid()`` it is the
    same on every evaluation, so a recomputed task (after an executor loss)
    or a second action over the same plan produces the same ids."""
    parts = [F.lit(namespace)] + [F.coalesce(col_of(c).cast("string"), F.lit("∅")) for c in cols]
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def new_id(namespace: str, dtype: T.DataType, *cols: Column | str) -> Column:
    """Deterministic id of a new row for an id column of type ``dtype``:
    UUID-shaped text (``stable_id``) for text ids; for numeric ids a 64-bit
    (BIGINT) or 32-bit (INT) hash of the same key -- supply ``id_expr`` to the
    operator when numeric ids must be collision-free at very large counts."""
    if isinstance(dtype, T.StringType):
        return stable_id(namespace, *cols)
    parts = [F.lit(namespace)] + [col_of(c) for c in cols]
    if isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType)):
        return F.hash(*parts).cast(dtype)
    return F.xxhash64(*parts).cast(dtype)
