"""Requests for bands (closed ranges of cents, by type), decided as if they came one after the other.

A request is accepted if no band that is live by then overlaps its own. New bands stay; a request on a stored rule replaces its band. The decisions depend
on one another in request order, so they are found as the fixed point of rounds:

* the amounts are cut into *blocks* of about ``BLOCK_ROWS`` requests. Requests that lie in one block are walked there in order;
* the others (those that reach into several blocks, and all that replace the band of a stored rule) *travel*: every
  block that they reach is told the decision assumed for them, and tells whether it holds a live band that they overlap;
* what the blocks tell gives the next round's assumptions. When they hold, every decision is the serial one: the first
  request with a wrong decision would have only right ones before it, and none of them could mislead it. Each round settles at least one more traveller, and in practice all that did
  not depend on a wrong assumption, so a few rounds are enough.

A block is streamed in request order; a task holds its live bands and nothing else. A stored band that no request replaces is in the blocks it reaches.
"""

from __future__ import annotations

import sys
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Requests in a block, on average.
BLOCK_ROWS = 4096
#: Cents that no amount reaches.
TOP = 2**62 - 1

#: What orders two live bands with one minimum: how its rule was made, and its id.
ORDER = ["no_date", "made", "is_new", "id_kind", "id_number", "id_text"]
ORDER_TYPES = ["int", "string", "int", "int", "bigint", "string"]
BAND = ["st", "mn", "mx"]
WALKED = ["block", "role", "seq", "key", *BAND, "checked", "applied", *ORDER]
HIT = "struct<mn:bigint," + ",".join(f"{n}:{t}" for n, t in zip(ORDER, ORDER_TYPES, strict=True)) + ",mx:bigint>"
#: Roles of a block's rows: a band that is there from the start, a request of this block, a traveller.
STANDING, LOCAL, TRAVELLER = 0, 1, 2


class LiveBands:
    """Bands in order of (minimum, order), in chunks that know how far they reach."""

    SIZE = 128

    def __init__(self):
        self.chunks: list[list[tuple]] = []
        self.heads: list[tuple] = []
        self.reach: list[int] = []
        self.of: dict[str, tuple] = {}

    def first_overlap(self, low: int, high: int, key: str):
        """The first band that shares an amount with [low, high], but not that of ``key``."""
        for chunk, reach in zip(self.chunks, self.reach, strict=True):
            if chunk[0][0] > high:
                return None
            if reach >= low:
                for band in chunk:
                    if band[0] > high:
                        return None
                    if band[2] >= low and band[3] != key:
                        return band
        return None

    def put(self, key: str, low: int, high: int, order: tuple) -> None:
        band = (low, order, high, key)
        self.of[key] = band
        if not self.chunks:
            self.chunks, self.heads, self.reach = [[band]], [band[:2]], [high]
            return
        k = max(bisect_right(self.heads, band[:2]) - 1, 0)
        chunk = self.chunks[k]
        insort(chunk, band)
        if len(chunk) > 2 * self.SIZE:
            self.chunks[k : k + 1] = [chunk[: self.SIZE], chunk[self.SIZE :]]
            self.heads.insert(k + 1, ())
            self.reach.insert(k + 1, 0)
            self._noted(k + 1)
        self._noted(k)

    def drop(self, key: str) -> None:
        band = self.of.pop(key, None)
        if band is None:
            return
        k = max(bisect_right(self.heads, band[:2]) - 1, 0)
        while band not in self.chunks[k]:  # bands may share a head
            k -= 1
        self.chunks[k].remove(band)
        if self.chunks[k]:
            self._noted(k)
        else:
            del self.chunks[k], self.heads[k], self.reach[k]

    def _noted(self, k: int) -> None:
        self.heads[k] = self.chunks[k][0][:2]
        self.reach[k] = max(b[2] for b in self.chunks[k])


def walked(batches):
    """One result per request and block: the first live band that overlaps it there (null: none)."""
    at, live = None, {}
    names = [f.split(":")[0] for f in HIT[7:-1].split(",")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    hit_type = pa.struct(list(zip(names, kinds, strict=True)))
    for batch in batches:
        blocks, seqs, travels, hits = [], [], [], []
        for block, role, seq, key, st, mn, mx, checked, applied, *order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != at:
                at, live = block, {}
            high, hit = TOP if mx is None else mx, None
            if checked:
                hit = live[st].first_overlap(mn, high, key) if st in live else None
            if role != STANDING:
                blocks.append(block)
                seqs.append(seq)
                travels.append(role == TRAVELLER)
                hits.append(None if hit is None else dict(zip(names, (hit[0], *hit[1], None if hit[2] == TOP else hit[2]), strict=True)))
            if role == TRAVELLER and applied:
                for bands in live.values():
                    bands.drop(key)
            if (applied if role == TRAVELLER else hit is None) and mn is not None:
                live.setdefault(st, LiveBands()).put(key, mn, high, tuple(order))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(seqs, pa.int64()), pa.array(travels, pa.bool_()), pa.array(hits, hit_type)], ["block", "seq", "travels", "hit"])


def block_of(amount: Column, cuts: list[int]) -> Column:
    """How many cuts lie at or below an amount (null: no upper bound, so all)."""
    if not cuts:
        return F.lit(0)
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def found(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(np.int64), "right").astype(np.int32))

    return found(F.coalesce(amount, F.lit(TOP)))


def cuts_of(rows: DataFrame, column: str) -> list[int]:
    """Borders that deal ``rows`` into stretches of about ``BLOCK_ROWS`` by a column: one number for each stretch."""
    count = max(1, -(-rows.count() // BLOCK_ROWS))
    if count == 1:
        return []
    found = rows.agg(F.percentile_approx(column, [k / count for k in range(1, count)], 100 * count).alias("cuts")).first().cuts
    return sorted(set(found or []))


def reached(low: Column, high: Column, cuts: list[int]) -> Column:
    """The blocks that a band reaches."""
    return F.sequence(block_of(low, cuts), F.greatest(block_of(low, cuts), block_of(high, cuts)))


FIELDS = ["st", "mn", "mx", "fee", "act"]


def resolved(updates: DataFrame, rules: DataFrame, assumed: DataFrame) -> DataFrame:
    """``updates`` with their rule's state before (``base``) and after them (``new``), where ``assumed`` (seq, accepted) holds. A field that is not given keeps the value of
    the last accepted request that gave it, looked up by stretches of requests and then inside the stretch, so a rule that many requests change is many groups."""
    told = updates.join(assumed, "seq").withColumns({f"t_{f}": F.when(F.col("accepted") & F.col(f"{f}_given"), F.struct(F.col(f).alias("v"))) for f in FIELDS})
    ends = told.groupBy("rid", "stretch").agg(*[F.max_by(f"t_{f}", F.when(F.col(f"t_{f}").isNotNull(), F.col("seq"))).alias(f"t_{f}") for f in FIELDS])
    earlier = Window.partitionBy("rid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("rid", "stretch", *[F.last(f"t_{f}", True).over(earlier).alias(f"s_{f}") for f in FIELDS])
    before = Window.partitionBy("rid", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = told.withColumns({f"i_{f}": F.last(f"t_{f}", True).over(before) for f in FIELDS}).join(starts, ["rid", "stretch"])
    own = own.join(rules.select("rid", *[F.struct(F.col(f).alias("v")).alias(f"r_{f}") for f in FIELDS], *ORDER), "rid")
    base = {f: F.coalesce(f"i_{f}", f"s_{f}", f"r_{f}")["v"] for f in FIELDS}
    new = {f: F.when(F.col(f"{f}_given"), F.col(f)).otherwise(base[f]) for f in FIELDS}
    return own.select("seq", "rid", "accepted", "mx_told", F.struct(*[base[f].alias(f) for f in FIELDS]).alias("base"), F.struct(*[new[f].alias(f) for f in FIELDS]).alias("new"), *ORDER)


def decide(creates: DataFrame, updates: DataFrame, rules: DataFrame, faulty) -> tuple[DataFrame, DataFrame]:
    """The serial decisions. ``creates``: seq, BAND and ORDER of the requests for new active bands that are sound; ``updates``: seq, rid, FIELDS, for each
    a flag ``_given``, and ``mx_told`` (the maximum was given as a number); ``rules``: rid, FIELDS, ``live`` and ORDER, one row per rid;
    ``faulty(st, mn, mx_told, mx, fee)``: why a state is unsound (null: it is not).

    Returns (seq, hit) of the creates, and (seq, rid, new, why, hit) of the updates. A request is accepted where why and hit are null; a hit is
    the overlapping live band that comes first."""
    creates, updates = cut_lineage(creates), cut_lineage(updates.withColumn("stretch", block_of(F.col("seq"), cuts_of(updates, "seq"))))
    cuts = cuts_of(creates, "mn")
    touched = updates.select("rid").distinct()
    moving = cut_lineage(rules.join(touched, "rid", "left_semi"))
    stored_key, new_key = F.concat(F.lit("R"), F.col("rid")), F.concat(F.lit("C"), F.col("seq").cast("string"))
    reach, none = reached(F.col("mn"), F.col("mx"), cuts), F.array().cast("array<int>")

    def rows(df, role, key, blocks, seq="seq", checked=True, applied=False):
        literal = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(F.explode(blocks).alias("block"), F.lit(role).alias("role"), (F.col(seq) if seq else F.lit(None)).cast("bigint").alias("seq"), key.alias("key"), *BAND,
                         literal(checked).alias("checked"), literal(applied).alias("applied"), *ORDER)

    placed = creates.withColumn("reach", reach)
    standing = rows(rules.where("live and mn is not null"), STANDING, stored_key, reach, seq=None, checked=False)
    still = cut_lineage(standing.unionByName(rows(placed.where("size(reach) = 1"), LOCAL, new_key, F.col("reach"))))
    wide = cut_lineage(placed.where("size(reach) > 1"))
    assumed = updates.select("seq").unionByName(wide.select("seq")).withColumn("accepted", F.lit(False))
    rounds = assumed.count() + 2  # each round settles a traveller more at least
    while rounds:
        rounds -= 1
        new, sound = {f: F.col(f"new.{f}") for f in FIELDS}, F.col("why").isNull()
        state = resolved(updates, moving, assumed)
        state = cut_lineage(state.withColumn("why", faulty(new["st"], new["mn"], F.col("mx_told"), new["mx"], new["fee"])))
        ahead = F.when(new["act"], reached(new["mn"], new["mx"], cuts)).otherwise(none)
        behind = F.when(F.col("accepted") & F.col("base.mn").isNotNull(), reached(F.col("base.mn"), F.col("base.mx"), cuts)).otherwise(none)
        moves = state.where(sound).withColumns({"ahead": ahead, "behind": behind, "st": new["st"], "mx": new["mx"]})
        moves = moves.withColumn("at", F.explode(F.array_union("ahead", "behind"))).withColumn("here", F.array_contains("ahead", F.col("at")))
        # a block that only the former band reaches is told that it is gone, and nothing of the new one
        moves = rows(moves.withColumn("mn", F.when(F.col("here"), new["mn"])), TRAVELLER, stored_key, F.array("at"), checked=F.col("here"), applied=F.col("accepted"))
        wides = rows(wide.join(assumed, "seq"), TRAVELLER, new_key, F.col("reach"), applied=F.col("accepted"))
        blocks = still.unionByName(moves).unionByName(wides).repartition("block").sortWithinPartitions("block", F.col("seq").asc_nulls_first(), "key")
        told = cut_lineage(blocks.select(*WALKED).mapInArrow(walked, f"block int, seq bigint, travels boolean, hit {HIT}"))
        met = told.where("travels").groupBy("seq").agg(F.min("hit").alias("hit"))
        kept = ["seq", "rid", "new", "why", "accepted"]
        others = wide.join(assumed, "seq").select("seq", *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("rid", "new", "why")], "accepted")
        found = cut_lineage(state.select(*kept).unionByName(others).join(met, "seq", "left").withColumn("now", sound & F.col("hit").isNull()))
        if found.where("now <> accepted").isEmpty():
            mine = told.where("not travels").select("seq", "hit").unionByName(found.where("rid is null").select("seq", "hit"))
            return mine, found.where("rid is not null").select("seq", "rid", "new", "why", "hit")
        assumed = found.select("seq", F.col("now").alias("accepted"))
    raise RuntimeError("requests do not settle: seq must be unique, and a rule must have one row")
