"""Join shapes used by several operators.

* ``left_join_nullable``: a left join whose probe key is mostly NULL (reversal
  links, optional user references). NULL keys never match, but a shuffle join
  would still hash every NULL-key row into one partition; those rows probe
  with a spread-out surrogate key that the join condition never lets match.
* ``mark_first_in_key``: "first request wins" per key (serial-insert semantics of a
  unique index inside one batch) with an aggregate + join instead of a window,
  so a hot key is combined map-side rather than sorted in one task.
  NULL keys probe with a spread-out salt.
* ``mark_taken``: the same for a key that must also be new to a ledger, with one lookup for both.
* ``mark_greedy_unique``: the same over several unique keys at once.

Nothing here forces a broadcast: the planner and AQE choose it from measured sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keys_present(ledger: DataFrame, ledger_col: str, probe: DataFrame, probe_col: str, out: str) -> DataFrame:
    """Distinct values of ``probe_col`` that already exist in ``ledger_col``,
    as a one-column frame named ``out``."""
    return _hits(ledger, ledger_col, probe, probe_col, out).distinct()


def _hits(ledger: DataFrame, ledger_col: str, probe: DataFrame, probe_col: str, out: str) -> DataFrame:
    """The values of ``ledger_col`` that ``probe_col`` holds too, one for each ledger row. The (large) ledger is semi-joined
    against the (small) batch of probe keys first, so only matching ledger
    rows are shuffled; the planner / AQE broadcasts the batch keys when their
    measured size allows."""
    batch = probe.select(F.col(probe_col).alias("__probe")).filter(F.col("__probe").isNotNull()).distinct()
    hits = ledger.select(F.col(ledger_col).alias(out))
    return hits.join(batch, hits[out] == batch["__probe"], "left_semi")


def left_join_nullable(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       right_cols: dict[str, str], salt_buckets: int = 4096) -> DataFrame:
    """``left LEFT JOIN right ON left.left_key = right.right_key`` adding
    ``right_cols`` (right column -> output name), for a probe key that is
    mostly NULL. A NULL key never matches, but a shuffle join would hash all
    NULL-key rows into one partition; here they probe with a surrogate key
    spread over ``salt_buckets`` values (a hash of the row) while the join
    condition keeps ``left_key IS NOT NULL``, so they still match nothing.
    One pass over ``left`` (no split and union)."""
    r = right.select(F.col(right_key).alias("__rk"), *[F.col(c).alias(o) for c, o in right_cols.items()])
    kt = left.schema[left_key].dataType
    hashable = [F.col(f.name) for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(salt_buckets)).cast(kt) if hashable else F.lit(0).cast(kt)
    probe = F.coalesce(F.col(left_key), salt)
    return left.join(r, (probe == r["__rk"]) & F.col(left_key).isNotNull(), "left").drop("__rk")


def mark_first_in_key(df: DataFrame, key: str | list[str], seq: str, eligible: Column | None = None,
                      out: str = "is_first") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    elig = eligible if eligible is not None else F.lit(True)
    tagged = df.withColumn("__elig", elig)
    not_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    firsts = (tagged.filter(F.col("__elig") & not_null)
              .groupBy(*keys).agg(F.min(seq).alias("__min_seq"))).withColumn("__salt", F.lit(0))
    # rows with a NULL key match nothing: a salt spreads them over partitions
    salt = F.when(not_null, F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(F.col(seq)), F.lit(4096)).cast("int"))
    joined = tagged.withColumn("__salt", salt).join(firsts, [*keys, "__salt"], "left")
    return (joined.withColumn(out, F.when(F.col("__elig"), F.coalesce(F.col(seq) == F.col("__min_seq"), F.lit(True))))
            .drop("__elig", "__min_seq", "__salt"))


def mark_taken(df: DataFrame, key: str, seq: str, eligible: Column, ledger: DataFrame, ledger_col: str, out: str) -> DataFrame:
    """Serial inserts against a ledger's unique key: ``out`` is true where ``ledger_col`` holds the key already or where an eligible
    row of ``df`` with a smaller ``seq`` has it (told for eligible rows; the others claim nothing). ``df`` is joined once: the ledger's
    hits and the first claims are gathered to one narrow row per key in stages of their own, so that no task sorts the wide rows
    beside the inputs of both lookups. NULL keys are not taken; a salt that no row of the lookup has spreads them over partitions."""
    hits = _hits(ledger, ledger_col, df, key, "__hit")
    hits = hits.select(F.col("__hit").cast(df.schema[key].dataType).alias("__key"), F.lit(None).cast(df.schema[seq].dataType).alias("__claim"), F.lit(True).alias("__held"))
    hits = hits.hint("rebalance")  # the semi join is a stage of its own, whose tasks AQE sizes without the rows of ``df``
    claims = df.filter(eligible & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(seq).alias("__claim"), F.lit(False).alias("__held"))
    known = claims.unionByName(hits).groupBy("__key").agg(
        F.min("__claim").alias("__min_seq"), F.max("__held").alias("__held"), F.max(F.lit(0)).alias("__zero"))  # an aggregate: a literal would be folded out of the join keys
    salt = F.when(F.col(key).isNotNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(F.col(seq)), F.lit(4096)).cast("int"))
    tagged = df.withColumn("__salt", salt)
    joined = tagged.join(known, (tagged[key] == known["__key"]) & (tagged["__salt"] == known["__zero"]), "left")
    late = F.coalesce(F.col(seq) != F.col("__min_seq"), F.lit(False))
    return joined.withColumn(out, F.coalesce(F.col("__held"), F.lit(False)) | late).drop("__key", "__min_seq", "__held", "__zero", "__salt")


#: Rows that are left after a round and settled in one task: a fixed bound, whatever the batch.
WALK_ROWS = 4096


def mark_greedy_unique(df: DataFrame, keys: list[tuple[str, str]], seq: str, eligible: Column,
                       out: str = "batch_reason") -> DataFrame:
    """Serial-insert semantics over several unique keys at once: taking rows
    in ``seq`` order, a row is accepted iff no earlier *accepted* row shares a
    value of any key; otherwise ``out`` gets the message of the first key (in
    the given check order) it shares. Ineligible rows get NULL. ``seq`` must be unique.

    Exact. Rows whose keys occur once are accepted at once. The others go through rounds:

    * a row that is the earliest undecided one of every key value it holds is accepted;
    * a row with one undecided row before it, over all its keys, gets the opposite of that row's decision. Such rows
      point at one another; pointer doubling brings a whole chain to its first row in log(length) joins;
    * rows that share a key value with an accepted row are rejected.

    A round decides the first row at least, all that a hot key holds once its first row is decided, and every chain. The last
    ``WALK_ROWS`` rows are settled in order in one task."""
    from ..session import cut_lineage

    names, msgs = [k for k, _ in keys], [m for _, m in keys]
    ks = [f"__k{i}" for i in range(len(names))]
    rows = df.filter(eligible).select(F.col(seq).alias("__s"), *[F.col(k).alias(a) for k, a in zip(names, ks, strict=True)])
    for k in ks:  # a value that occurs once contests nothing
        often = rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
        rows = rows.join(often, k, "left").withColumn(k, F.when(F.col("__n").isNotNull(), F.col(k))).drop("__n")
    contested = cut_lineage(rows.filter(F.coalesce(*[F.col(k).cast("string") for k in ks]).isNotNull()).select("__s", *ks))
    undecided, taken = contested, []
    while not undecided.isEmpty():
        accepted, rejected = _round(undecided, ks)
        left = undecided.join(accepted.unionByName(rejected).select("__s"), "__s", "left_anti")
        undecided = cut_lineage(_untaken(left, accepted, ks))
        taken.append(accepted)
        if undecided.limit(WALK_ROWS + 1).count() <= WALK_ROWS:
            taken.append(cut_lineage(_walked(undecided, ks)))
            break
    if not taken:
        return df.withColumn(out, F.lit(None).cast("string"))
    accepted = reduce(DataFrame.unionByName, taken)
    failed = contested.join(accepted.select("__s"), "__s", "left_anti")
    for i, k in enumerate(ks):  # of each key value one row at most was accepted, before all that are rejected for it
        held = accepted.filter(F.col(k).isNotNull()).select(k, F.col("__s").alias(f"__by{i}"))
        failed = failed.join(held, k, "left")
    why = F.coalesce(*[F.when(F.col(f"__by{i}") < F.col("__s"), F.lit(m)) for i, m in enumerate(msgs)])
    why = cut_lineage(failed.select("__s", why.alias(out)))
    return df.join(why, df[seq] == why["__s"], "left").drop("__s")


def _untaken(rows: DataFrame, accepted: DataFrame, ks: list[str]) -> DataFrame:
    """The rows that share no key value with an accepted row."""
    for k in ks:
        held = accepted.filter(F.col(k).isNotNull()).select(F.col(k).alias("__held")).distinct()
        rows = rows.join(held, F.col(k) == F.col("__held"), "left_anti")
    return rows


def _round(rows: DataFrame, ks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows that a round can tell: the first of all their keys, and what chains to those."""
    from ..session import cut_lineage

    state = rows
    for i, k in enumerate(ks):
        first = rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("__s").alias(f"__a{i}"))
        state = state.join(first, k, "left")
        second = state.filter(F.col("__s") > F.col(f"__a{i}")).groupBy(k).agg(F.min("__s").alias(f"__b{i}"))
        state = state.join(second, k, "left")
    late = [F.col(f"__a{i}") < F.col("__s") for i in range(len(ks))]
    ahead = F.array_distinct(F.array_compact(F.array(*[F.when(x, F.col(f"__a{i}")) for i, x in enumerate(late)])))
    only = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"__s") <= F.col(f"__b{i}"), F.lit(True)) for i in range(len(ks))])
    state = cut_lineage(state.select("__s", *ks, ahead.alias("__ahead"), only.alias("__only")))
    accepted = state.filter(F.size("__ahead") == 0).select("__s", *ks)
    links = state.filter((F.size("__ahead") == 1) & F.col("__only")).select("__s", F.col("__ahead")[0].alias("to"), F.lit(True).alias("turned"))
    while True:
        further = links.select(F.col("__s").alias("to"), F.col("to").alias("next"), F.col("turned").alias("again"))
        hops = cut_lineage(links.join(further, "to", "left").select("__s", F.coalesce("next", "to").alias("to"), (F.col("turned") != F.coalesce("again", F.lit(False))).alias("turned"), F.col("next").isNotNull().alias("moved")))
        links = hops.drop("moved")
        if hops.filter("moved").isEmpty():
            break
    told = links.join(accepted.select(F.col("__s").alias("to")), "to", "left_semi")
    more = state.join(told.filter("not turned").select("__s"), "__s", "left_semi").select("__s", *ks)
    return cut_lineage(accepted.unionByName(more)), cut_lineage(told.filter("turned").select("__s").join(rows, "__s"))


def _walked(rows: DataFrame, ks: list[str]) -> DataFrame:
    """The rows accepted of a bounded number, walked in order in one task."""
    n = len(ks)

    def walk(pdf):
        taken, good = [set() for _ in range(n)], []
        for row in pdf.sort_values("__s").itertuples(index=False):
            held = [None if v is None or v != v else v for v in row[1:]]
            if not any(v in t for v, t in zip(held, taken, strict=True)):
                good.append(row[0])
                for v, t in zip(held, taken, strict=True):
                    t.add(v) if v is not None else None
        return pdf[pdf["__s"].isin(good)][["__s"]]

    plain = rows.select("__s", *[F.col(k).cast("string").alias(k) for k in ks])
    good = plain.groupBy(F.lit(0).alias("__one")).applyInPandas(lambda pdf: walk(pdf[["__s", *ks]]), f"__s {rows.schema['__s'].dataType.simpleString()}")
    return rows.join(good, "__s", "left_semi").select("__s", *ks)
