"""Wallet (cash-in / cash-out) fee bands: rule matching, overlap audit, rule
loading and posting of wallet transactions.

Matching an amount to a fee band is a range join. It is made an equi-join at any
rule count by dyadic cells over cents: a band of finite width lies in one or two
cells of the smallest power of two that is not below its width; an open-ended band
is cut into the aligned cells from its minimum up to the next power of two, plus the tail beyond it.
An amount lies in one cell of each size, so it meets each band at most once, on
(service type, cell size, cell), and sizes that no rule uses are not probed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.text import id_ok, id_or_null, new_id, number, required_text
from ..session import cut_lineage
from . import serial_bands
from .changes import append_accepted
from .joins import mark_taken

# Rejection texts of fee-rule loading and wallet posting.
ERR_SERVICE_TYPE = "service_type must be one of: cash_in, cash_out"
ERR_NUMERIC = "{field} must be numeric"
ERR_MIN_NEGATIVE = "min_amount must be greater than or equal to 0"
ERR_MAX_BELOW_MIN = "max_amount must be greater than or equal to min_amount"
ERR_OVERLAP = "fee range overlaps existing active rule ({min} - {max})"
ERR_OVERLAP_OPEN_MAX = "infinity"
ERR_WALLET_REF = "reference_number is required"
ERR_PRINCIPAL = "principal_amount must be a positive number"
ERR_NO_RULE = "No active fee rule found for {service_type} at amount {amount}"
ERR_UUID = "{field} must be a UUID"
ERR_DUPLICATE = "reference_number already exists"
ERR_RANGE = "{field} is out of range"

SERVICE_TYPES = ("cash_in", "cash_out")

RULE_FIELDS = ["id", "min_amount", "max_amount", "fee_amount", "effective_from", "effective_to", "created_at"]


def _as_of(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def _applies(rule, amount: Column, at: Column) -> Column:
    return ((amount >= rule["min_amount"])
            & (rule["max_amount"].isNull() | (amount <= rule["max_amount"]))
            & (rule["effective_from"].isNull() | (rule["effective_from"] <= at))
            & (rule["effective_to"].isNull() | (rule["effective_to"] >= at)))


#: Cents that no amount reaches (amounts are cut to it before they are put into cells).
TOP_CENTS = 2**62 - 1


def _cents(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.floor(c * F.lit(100)), F.lit(TOP_CENTS)).cast("bigint"))


def _pieces(rules: DataFrame, keep: list[str]) -> DataFrame:
    """The cells of each active rule of a known service type: (service type ``st``, ``level``,
    ``cell``, kept columns). Level k >= 0 has cells of 2^k cents; level -(m + 1) is the tail from 2^m cents on."""
    a = rules.filter((F.col("is_active") == F.lit(True)) & F.col("service_type").isin(*SERVICE_TYPES))
    low, high = F.greatest(_cents(F.col("min_amount")), F.lit(0)), _cents(F.col("max_amount"))
    # a band stored the wrong way round is put into the cells between its ends
    a = a.select(F.col("service_type").alias("st"), *keep, F.least(low, high).alias("lo"),
                 F.when(high.isNotNull(), F.greatest(low, high)).alias("hi"), high.alias("end"))
    size = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.length(F.bin(F.col("hi") - F.col("lo"))))
    bounded = a.filter("hi is not null and lo >= 0").withColumn("level", size).withColumn(
        "cell", F.explode(F.expr("sequence(shiftright(lo, level), shiftright(hi, level))")))
    open_ended = a.filter("hi is null").withColumn("top", F.when(F.col("lo") > 0, F.length(F.bin("lo"))).otherwise(F.lit(0)))
    # below the tail: cell ceil(lo / 2^k) where that number is odd; zero has the cell of its own cent
    cells = F.expr("""filter(transform(sequence(0, greatest(top - 1, 0)),
                             k -> struct(k as level, shiftright(lo + shiftleft(1L, k) - 1, k) as cell)),
                      x -> if(lo = 0, true, x.cell % 2 = 1))""")
    tail = F.struct((-F.col("top") - 1).alias("level"), F.lit(0).cast("bigint").alias("cell"))
    open_ended = open_ended.withColumn("x", F.explode(F.concat(cells, F.array(tail)))).select("*", "x.level", "x.cell")
    columns = ["st", *keep, "lo", "hi", "end", "level", "cell"]
    return bounded.select(*columns).unionByName(open_ended.select(*columns))


#: The cell of ``cents`` at ``level``; NULL where it has none.
CELL_OF = """case when cents < 0 then null when level >= 0 then shiftright(cents, level)
             when cents >= shiftleft(1L, -level - 1) then 0 end"""


def _levels(pieces: DataFrame) -> DataFrame:
    """The levels in use per service type: a row for each of SERVICE_TYPES at most, of at most 126 numbers, so it may be broadcast."""
    return F.broadcast(pieces.groupBy("st").agg(F.collect_set("level").alias("levels")))


#: Active rules up to which all of a service type travel to every task, as one row for each type.
FEW_RULES = 256


def _listed(rules: DataFrame) -> DataFrame:
    """(st, listed): the active rules of each service type, best first. For ``FEW_RULES`` at most, so it may be broadcast."""
    keys = [(-F.col("min_amount")).alias("k1"), F.col("created_at").isNotNull().alias("k2"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("k3")]
    rule = F.struct(F.col("min_amount").isNull().alias("k0"), *keys, F.col("id").isNull().alias("k4"), F.col("id").alias("k5"), F.struct(*RULE_FIELDS).alias("rule"))
    listed = rules.groupBy(F.col("service_type").alias("__st")).agg(F.sort_array(F.collect_list(rule)).alias("__sorted"))
    return F.broadcast(listed.select("__st", F.transform("__sorted", lambda r: r["rule"]).alias("__rules")))


def match_fee_rules(txns: DataFrame, rules: DataFrame, amount: str = "principal_amount",
                    service_type: str = "service_type", as_of: Column | str = "1970-01-01 00:00:00",
                    prefix: str = "rule_") -> DataFrame:
    """Per transaction the applicable active rule: same service type,
    min ≤ amount ≤ max (NULL max = no upper bound), effective window
    containing ``as_of`` (a literal or a per-row column, e.g. the
    transaction time). Best = largest min_amount, then newest (NULL created_at first, PostgreSQL's DESC
    order), then smallest id. Adds ``{prefix}id``, ``{prefix}fee_amount``, ``{prefix}min_amount``,
    ``{prefix}max_amount`` (NULL when no rule applies).

    A table of ``FEW_RULES`` active rules at most (counted first) is carried to the transactions, which then do not move.
    Beyond that, cells: the best rule is found once per distinct (type, amount, time) and joined back, so every input
    row comes out once, whatever its other columns hold."""
    active = rules.filter((F.col("is_active") == F.lit(True)) & F.col("service_type").isin(*SERVICE_TYPES))
    out = ("id", "fee_amount", "min_amount", "max_amount")
    if active.limit(FEW_RULES + 1).count() <= FEW_RULES:
        t = txns.select("*", F.col(amount).try_cast("decimal(30,6)").alias("__mamt"), _as_of(as_of).alias("__mat"))
        t = t.join(_listed(active), F.col(service_type) == F.col("__st"), "left")
        best = F.try_element_at(F.filter("__rules", lambda r: _applies({f: r[f] for f in RULE_FIELDS}, F.col("__mamt"), F.col("__mat"))), F.lit(1))
        return t.withColumn("__best", best).select(*[txns[c] for c in txns.columns], *[F.col("__best")[f].alias(prefix + f) for f in out])
    pieces = _pieces(rules, RULE_FIELDS)
    t = txns.select("*", F.col(service_type).alias("__mst"), F.col(amount).try_cast("decimal(30,6)").alias("__mamt"),
                    _as_of(as_of).alias("__mat"))
    asked = t.filter(F.col("__mst").isNotNull() & F.col("__mamt").isNotNull()).select("__mst", "__mamt", "__mat").distinct()
    levels = _levels(pieces)
    probes = (asked.withColumn("cents", _cents(F.col("__mamt"))).join(levels, F.col("__mst") == F.col("st")).drop("st")
              .withColumn("level", F.explode("levels")).drop("levels").withColumn("__cell", F.expr(CELL_OF))
              .filter(F.col("__cell").isNotNull()))
    cells = pieces.select(F.col("st").alias("__rst"), F.col("level").alias("__rlevel"), F.col("cell").alias("__rcell"),
                          *[F.col(f).alias("__r_" + f) for f in RULE_FIELDS])
    met = probes.join(cells, (F.col("__mst") == F.col("__rst")) & (F.col("level") == F.col("__rlevel"))
                      & (F.col("__cell") == F.col("__rcell")))
    met = met.filter(_applies({f: F.col("__r_" + f) for f in RULE_FIELDS}, F.col("__mamt"), F.col("__mat")))
    met = met.select("__mst", "__mamt", "__mat", *[F.col("__r_" + f).alias(f) for f in RULE_FIELDS])
    w = Window.partitionBy("__mst", "__mamt", "__mat").orderBy(
        F.desc_nulls_last("min_amount"), F.desc_nulls_first("created_at"), F.asc_nulls_last("id"))
    best = met.select("__mst", "__mamt", "__mat", *RULE_FIELDS, F.row_number().over(w).alias("__rn")).filter("__rn = 1")
    best = best.select(F.col("__mst").alias("__bst"), F.col("__mamt").alias("__bamt"), F.col("__mat").alias("__bat"),
                       *[F.col(f).alias(prefix + f) for f in out])
    j = t.join(best, (F.col("__mst") == F.col("__bst")) & (F.col("__mamt") == F.col("__bamt"))
               & F.col("__mat").eqNullSafe(F.col("__bat")), "left")
    return j.drop("__mst", "__mamt", "__mat", "__bst", "__bamt", "__bat")


#: Blocks that the open-ended bands of a service type are dealt to, for pairing.
PAIR_BLOCKS = 24


def _pairs_by_blocks(bands: DataFrame) -> DataFrame:
    """Every two bands of one service type, the second one's columns with ``w_`` before their names. All of them are pairs, so
    the bands are dealt to blocks and joined per pair of blocks: a type is B * (B + 1) / 2 keys, each a B-th of the bands against another."""
    dealt = bands.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(PAIR_BLOCKS)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1))))
    dealt = dealt.select(*bands.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    w = dealt.select(*[F.col(c).alias("w_" + c) for c in dealt.columns])
    met = dealt.join(w, (F.col("st") == F.col("w_st")) & (F.col("low") == F.col("w_low")) & (F.col("high") == F.col("w_high"))
                     & (F.col("id") < F.col("w_id")) & ((F.col("low") == F.col("high")) | (F.col("block") != F.col("w_block"))))
    return met.drop("block", "low", "high", "w_block", "w_low", "w_high")


def fee_rule_overlaps(rules: DataFrame) -> DataFrame:
    """Pairs of active rules of one service type whose bands overlap (ends
    inclusive, so touching bands overlap; NULL max = no upper bound;
    effective dates ignored, T24). One row per pair, ``rule_id < other_rule_id``.

    Two bounded bands meet in the cells of the wider one's level, in the cell where both begin to overlap; an open-ended band
    holds a bounded one's maximum in just one of its cells; two open-ended bands always overlap, and are paired block by block."""
    keep = ["id", "min_amount", "max_amount"]
    pieces = _pieces(rules, keep)
    wide = pieces.select(*[F.col(c).alias("w_" + c) for c in pieces.columns])
    bands = pieces.filter("hi is not null").select("st", *keep, "lo", "hi", "end", F.col("level").alias("own")).distinct()
    levels = _levels(pieces.filter("hi is not null")).withColumnRenamed("st", "lst")
    narrow = (bands.join(levels, F.col("st") == F.col("lst")).withColumn("level", F.explode("levels")).filter("level >= own")
              .withColumn("cell", F.explode(F.expr("sequence(shiftright(lo, level), shiftright(hi, level))"))))
    both = narrow.join(wide, (F.col("st") == F.col("w_st")) & (F.col("level") == F.col("w_level")) & (F.col("cell") == F.col("w_cell")))
    both = both.filter("w_hi is not null and lo <= w_hi and w_lo <= hi and cell = shiftright(greatest(lo, w_lo), level)"
                       " and max_amount >= w_min_amount and w_max_amount >= min_amount and (own < level or id < w_id)")
    open_levels = _levels(pieces.filter("hi is null")).withColumnRenamed("st", "lst")
    ends = (bands.join(open_levels, F.col("st") == F.col("lst")).withColumn("level", F.explode("levels"))
            .withColumn("cents", F.col("end")).withColumn("cell", F.expr(CELL_OF)).filter("cell is not null"))
    tails = wide.filter("w_hi is null")
    under = ends.join(tails, (F.col("st") == F.col("w_st")) & (F.col("level") == F.col("w_level")) & (F.col("cell") == F.col("w_cell")))
    opened = pieces.filter("hi is null").select("st", *keep).distinct()
    open_pairs = _pairs_by_blocks(opened)
    fields = ["st", *keep, *["w_" + c for c in keep]]
    j = both.select(*fields).unionByName(under.select(*fields)).unionByName(open_pairs.select(*fields))
    first = F.col("id") < F.col("w_id")

    def side(c, lower):
        return F.when(first, F.col(c if lower else "w_" + c)).otherwise(F.col("w_" + c if lower else c))

    return j.select(F.col("st").alias("service_type"), side("id", True).alias("rule_id"), side("id", False).alias("other_rule_id"),
                    side("min_amount", True).alias("rule_min_amount"), side("max_amount", True).alias("rule_max_amount"),
                    side("min_amount", False).alias("other_min_amount"), side("max_amount", False).alias("other_max_amount"))


def _template(text: str, **cols: Column) -> Column:
    """A message template with ``{name}`` slots filled from columns."""
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(cols[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _fmt_amount(c: Column) -> Column:
    s = c.cast("decimal(30,6)").cast("string")
    s = F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)
    return s


def _shown(cents: str) -> Column:
    """An amount of cents as text with two decimals."""
    return F.concat((F.col(cents).cast("bigint") / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.col(cents) % 100).cast("string"), 2, "0"))


def load_fee_rules(candidates: DataFrame, rules: DataFrame, as_of="1970-01-01 00:00:00",
                   id_expr: Column | None = None, seq: str = "seq", clear: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Create or update fee rules, as serial requests in ``seq`` order would. A candidate with the
    ``id`` of a stored rule is an update: fields given (not NULL) overlay the rule as it is by then; ``''`` as max_amount, or
    the name in the ``clear`` column (an array of field names), removes the upper bound. Checks:
    numeric min/max/fee (blank text is not a number), known service type, min ≥ 0, max ≥ min; an active
    rule may not overlap another rule that is active by then (itself excluded on update; an earlier
    update may have moved, opened or deactivated it). Amounts are rounded to cents. The message names the
    overlapping band with the smallest minimum. Returns (outcome, new rules: one row per id).

    What a candidate decides can matter to any later one whose band it meets: the serial decisions are found
    by ``serial_bands.decide``, in rounds over blocks of amounts. ``seq`` must be unique."""
    has = candidates.columns
    now = F.lit(str(as_of)).cast("timestamp_ntz")

    def given(name, kind="string"):
        return (F.col(name) if name in has else F.lit(None)).cast(kind)

    def cents(c):
        return (number(c).try_cast("decimal(30,6)").try_cast(MONEY) * 100).cast("bigint")

    known = rules.select(F.col("id").cast("string").alias("__rid")).distinct()
    max_text = F.trim(given("max_amount"))
    opened = F.coalesce(max_text == "", F.lit(False))
    if clear is not None:
        opened = opened | F.coalesce(F.array_contains(F.col(clear), "max_amount"), F.lit(False))
    c = candidates.select(
        F.col(seq).cast("bigint").alias("seq"), given("id").alias("__id"), given("service_type").alias("st"),
        given("min_amount").isNotNull().alias("mn_given"), cents(given("min_amount")).alias("mn"),
        (given("max_amount").isNotNull() & ~opened).alias("mx_given"), cents(given("max_amount")).alias("mx"), opened.alias("mx_open"),
        given("fee_amount").isNotNull().alias("fee_given"), cents(given("fee_amount")).alias("fee"),
        given("is_active", "boolean").alias("act"))
    c = c.join(known, c["__id"] == known["__rid"], "left").withColumnRenamed("__rid", "rid").drop("__id")
    stored = rules.select(
        F.col("id").cast("string").alias("rid"), F.col("service_type").alias("st"), (F.col("min_amount") * 100).cast("bigint").alias("mn"),
        (F.col("max_amount") * 100).cast("bigint").alias("mx"), (F.col("fee_amount") * 100).cast("bigint").alias("fee"),
        F.col("is_active").alias("act"), F.col("created_at").cast("string").alias("created"))

    def order_of(no_date, made, is_new, rid):
        numeric = rid.rlike("^-?[0-9]{1,18}$")
        values = (no_date, made, is_new, F.when(numeric, 0).otherwise(1), F.when(numeric, rid.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")), F.when(numeric, F.lit("")).otherwise(rid))
        return [v.cast(t).alias(n) for n, t, v in zip(serial_bands.ORDER, serial_bands.ORDER_TYPES, values, strict=True)]

    def faulty(st, mn, mx_told, mx, fee):
        return (F.when(mn.isNull(), F.lit(ERR_NUMERIC.format(field="min_amount")))
                .when(mx_told & mx.isNull(), F.lit(ERR_NUMERIC.format(field="max_amount")))
                .when(fee.isNull(), F.lit(ERR_NUMERIC.format(field="fee_amount"))).when(~F.coalesce(st.isin(*SERVICE_TYPES), F.lit(False)), F.lit(ERR_SERVICE_TYPE))
                .when(mn < 0, F.lit(ERR_MIN_NEGATIVE)).when(mx < mn, F.lit(ERR_MAX_BELOW_MIN)))

    c = cut_lineage(c)
    creates = c.filter("rid is null").withColumns({"act": F.coalesce("act", F.lit(True)), "mx": F.when(F.col("mx_given"), F.col("mx"))})
    creates = creates.withColumn("why", faulty(F.col("st"), F.col("mn"), F.col("mx_given"), F.col("mx"), F.col("fee")))
    live = creates.filter("why is null and act").select("seq", "st", "mn", "mx", *order_of(F.lit(0), F.lit(str(as_of)), F.lit(1), F.col("seq").cast("string")))
    stored = stored.select("rid", "st", "mn", "mx", "fee", F.coalesce("act", F.lit(True)).alias("act"), F.coalesce("act", F.lit(False)).alias("live"),
                           *order_of(F.col("created").isNull().cast("int"), F.coalesce("created", F.lit("")), F.lit(0), F.col("rid")))
    updates = c.filter("rid is not null").select("seq", "rid", "st", F.col("st").isNotNull().alias("st_given"), "mn", "mn_given", F.when(F.col("mx_given"), F.col("mx")).alias("mx"),
                                                 F.col("mx_given").alias("mx_told"), (F.col("mx_given") | F.col("mx_open")).alias("mx_given"), "fee", "fee_given", "act", F.col("act").isNotNull().alias("act_given"))
    new_hits, moved = serial_bands.decide(live, updates, stored, faulty)
    overlap = F.when(F.col("hit").isNotNull(), _template(ERR_OVERLAP, min=_shown("hit.mn"), max=F.coalesce(_shown("hit.mx"), F.lit(ERR_OVERLAP_OPEN_MAX))))
    made = creates.join(new_hits, "seq", "left").select("seq", F.lit(None).cast("string").alias("rid"), "st", "mn", "mx", "fee", "act", F.coalesce("why", overlap).alias("why"))
    walked = made.unionByName(moved.select("seq", "rid", "new.*", F.coalesce("why", overlap).alias("why")))

    def money(name):
        return (F.col(name).cast("decimal(20,0)") / 100).cast(MONEY)

    done = walked.select(F.col("seq").alias("__seq"), "rid", F.col("st").alias("service_type_final"), money("mn").alias("min_amount_final"),
                         money("mx").alias("max_amount_final"), money("fee").alias("fee_amount_final"), F.col("act").alias("is_active_final"),
                         F.col("rid").isNotNull().alias("is_update"), F.col("why").alias("reject_reason"))
    j = candidates.join(done, candidates[seq].cast("bigint") == done["__seq"], "left")
    finals = ["service_type_final", "min_amount_final", "max_amount_final", "fee_amount_final", "is_active_final"]
    outcome = j.select(*[candidates[x] for x in has], *finals, "is_update", "reject_reason")
    ok = j.filter(F.col("reject_reason").isNull())
    last = (ok.filter("is_update").groupBy(F.col("rid").alias("__uid")).agg(F.max_by(F.struct(*finals), F.col("__seq")).alias("__new")))
    r = rules.join(last, rules["id"].cast("string") == last["__uid"], "left")
    vals = {x.removesuffix("_final"): x for x in finals}
    updated = r.select(*[
        F.when(F.col("__uid").isNotNull(), F.col(f"__new.{vals[x]}") if x in vals else now).otherwise(rules[x])
        .cast(rules.schema[x].dataType).alias(x) if x in vals or x == "updated_at" else rules[x] for x in rules.columns])
    # no natural key: the batch time and request order identify a new rule
    rule_id = (id_expr if id_expr is not None
               else new_id("gcash_fee_rule", rules.schema["id"].dataType, F.lit(str(as_of)), F.col(seq)))
    inserted = ok.filter(~F.col("is_update")).select(*[
        (F.col(vals[x]) if x in vals else rule_id if x == "id" else now if x in ("created_at", "updated_at")
         else F.col(x) if x in ("effective_from", "effective_to") and x in has else F.lit(None))
        .cast(rules.schema[x].dataType).alias(x) for x in rules.columns])
    return outcome, updated.unionByName(inserted)


def post_wallet_transactions(requests: DataFrame, rules: DataFrame, ledger: DataFrame,
                             as_of: Column | str = "1970-01-01 00:00:00", seq: str = "seq") -> DataFrame:
    """Price wallet requests with their fee band and check them: known
    service type, reference given, principal a positive number, a rule
    applies, optional ids well-formed, reference new (ledger and earlier
    requests). fee = rule fee; gross = principal + fee (from the unrounded
    principal, T26); cash_impact = gross for cash-in, −principal for cash-out. An amount
    that is no number, or too large for the ledger, rejects its own row only.
    ``as_of`` may be a request-time column. Returns requests + priced
    columns + ``reject_reason``."""
    r = requests
    at = F.col(as_of) if isinstance(as_of, str) and as_of in r.columns else _as_of(as_of)
    p = number(F.col("principal_amount"))
    r = r.select("*", required_text(F.col("reference_number")).alias("__ref"), p.alias("__p"),
                 F.col("principal_amount").alias("__p_raw"))
    r = r.withColumn("__amt", F.col("__p").try_cast("decimal(30,6)"))
    matched = match_fee_rules(r, rules, amount="__amt", service_type="service_type", as_of=at, prefix="__rule_")
    st = F.col("service_type")
    reason = (F.when(~F.coalesce(st.isin(*SERVICE_TYPES), F.lit(False)), F.lit(ERR_SERVICE_TYPE))
              .when(F.col("__ref").isNull(), F.lit(ERR_WALLET_REF))
              .when(F.col("__p").isNull() | (F.col("__p") <= 0), F.lit(ERR_PRINCIPAL))
              .when((F.col("__amt") + F.coalesce(F.col("__rule_fee_amount"), F.lit(0))).try_cast(MONEY).isNull(),
                    F.lit(ERR_RANGE.format(field="principal_amount")))
              .when(F.col("__rule_id").isNull(),
                    _template(ERR_NO_RULE, service_type=st, amount=_fmt_amount(F.col("__amt")))))
    for f in ("order_id", "branch_id", "customer_id", "received_by"):
        if f in r.columns:
            reason = reason.when(~id_ok(F.col(f), r.schema[f].dataType), F.lit(ERR_UUID.format(field=f)))
    m = matched.withColumn("__pre", reason)
    m = mark_taken(m, "__ref", seq, F.col("__pre").isNull(), ledger, "reference_number", "__taken")
    fee = F.col("__rule_fee_amount").cast(MONEY)
    gross = (F.col("__amt") + fee).try_cast(MONEY)
    impact = F.when(st == "cash_in", gross).otherwise((-F.col("__amt")).try_cast(MONEY))
    extra = [id_or_null(F.col(f), r.schema[f].dataType).alias(f) for f in ("order_id", "branch_id", "customer_id",
                                                                         "received_by") if f in r.columns]
    return m.select(
        F.col(seq), "service_type", *extra,
        F.col("__amt").try_cast(MONEY).alias("principal_amount"),
        fee.alias("fee_amount"), gross.alias("gross_amount"), impact.alias("cash_impact"),
        F.col("__ref").alias("reference_number"), F.col("__rule_id").alias("fee_rule_id"),
        *([F.nullif(F.col("notes").cast("string"), F.lit("")).alias("notes")] if "notes" in r.columns else []),
        F.coalesce(F.col("__pre"), F.when(F.col("__taken"), F.lit(ERR_DUPLICATE))).alias("reject_reason"),
    )


def append_wallet_transactions(ledger: DataFrame, outcome: DataFrame, id_expr: Column | None = None,
                               as_of="1970-01-01 00:00:00") -> DataFrame:
    """New ledger version: the ledger plus the accepted rows of ``post_wallet_transactions``."""
    return append_accepted(ledger, outcome, "gcash_transaction", id_expr, as_of)
