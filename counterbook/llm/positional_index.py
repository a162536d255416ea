r"""Operator 7: benchmark decontamination on a positional inverted index.

``build_index`` stores a posting (term, document, position) for every word of
every training text, as Parquet in the shared folder. A test phrase is found by
intersecting the lists of its rarest terms: each posting of such a term at
position p and offset o in the phrase proposes the start p - o, a start that
every chosen term proposes survives, and its words are then compared one by one with
the phrase. Only DataFrame functions are used.

Scale. Postings never leave their map task unless their term is among the
rarest of some test window, and then propose one alignment for all the windows around it, so what is shuffled follows the matches,
not the corpus. The tables of test terms and passages are broadcast while they have at most ``BROADCAST_ROWS`` rows;
larger ones are joined by shuffle on the rare terms.

Defined results: a null or empty text has no words and no hit; a test item
without words has no window; equal items or windows count for each of their
items; rows with the same id and the same text are found as one document and each gets
the result; a null id is a document like others; columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

WINDOW, CHOSEN = 10, 3
BROADCAST_ROWS = 200_000
AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), AZ, AZ.lower())
    return F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, id, th, pos): th is a hash of the whole text, so different texts under one id are different documents."""
    words = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), words_of(docs[text_col]).alias("words"))
    return written(words.select("id", "th", F.posexplode("words").alias("pos", "term")), "postings", "zstd")


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, key, words) of the items with words; equal word sequences have one key."""
    words = items.select(items[id_col].alias("item"), words_of(items[text_col]).alias("words")).where(F.size("words") > 0)
    return words.select("item", F.xxhash64("words").alias("key"), "words")


def small(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it has at most BROADCAST_ROWS rows, else left to the planner; the count is one aggregate row."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): the length of each test term's list, 0 where the corpus doesn't have it."""
    found = index.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def window_matches(docs: DataFrame, index: DataFrame, found: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, key, at, length, start): every place where the ``length`` words of a passage (columns key, words) from word ``at`` on
    stand in a document from word ``start`` on, for each window of ``size`` words (a shorter passage is one window).

    A posting at position p of a term at place t proposes the alignment p - t of its passage, for all the windows around
    t at once; a window survives where each of its rarest terms proposes the same alignment."""
    found = written(found.select("key", "words").dropDuplicates(["key"]), "passages")
    places = found.select("key", F.posexplode("words").alias("t", "term"))
    counts = written(term_counts(index, written(places.select("term").distinct(), "terms")), "term-counts")
    ranked = places.join(counts, "term").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("by_n"))
    starts = found.select("key", F.size("words").alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))).alias("at"))
    starts = starts.select("key", "at", F.least("size", F.lit(size)).alias("length"))
    mine = F.filter("by_n", lambda x: (x["t"] >= F.col("at")) & (x["t"] < F.col("at") + F.col("length")))
    chosen = starts.join(ranked, "key").select("key", "at", "length", F.slice(mine, 1, CHOSEN).alias("rarest"))
    # a window with a term that no document has can't occur
    chosen = chosen.where(F.element_at("rarest", 1)["n"] > 0).select("key", F.struct("at", "length", F.col("rarest.t").alias("rarest")).alias("window"))
    wanted = written(chosen.groupBy("key").agg(F.collect_list("window").alias("windows"), F.min(F.size("window.rarest")).alias("least")), "windows")
    anchors = wanted.select("key", F.explode(F.array_distinct(F.flatten("windows.rarest"))).alias("t")).join(places, ["key", "t"]).select("term", "key", "t")
    anchors = written(anchors, "anchors")
    proposed = index.join(small(anchors), "term").select("id", "th", "key", (F.col("pos") - F.col("t")).alias("shift"), "t")
    agreed = proposed.groupBy("id", "th", "key", "shift").agg(F.collect_set("t").alias("ts")).join(small(wanted), "key").where(F.size("ts") >= F.col("least"))
    whole = F.filter("windows", lambda w: (F.col("shift") + w["at"] >= 0) & (F.size(F.array_except(w["rarest"], "ts")) == 0))
    agreed = agreed.select("id", "th", "key", "shift", F.transform(whole, lambda w: F.struct(w["at"].alias("at"), w["length"].alias("length"))).alias("windows"))
    agreed = written(agreed.where(F.size("windows") > 0), "agreed-shifts")
    # the remaining words, against the text itself
    named = agreed.join(small(found), "key").groupBy("id", "th").agg(F.collect_list(F.struct("key", "shift", "windows", F.col("words").alias("passage"))).alias("all"))
    texts = docs.select(docs[id_col].alias("k"), F.xxhash64(docs[text_col]).alias("kh"), docs[text_col].alias("text"))
    both = texts.join(named, texts["k"].eqNullSafe(named["id"]) & (texts["kh"] == named["th"])).select("id", "th", "all", words_of(F.col("text")).alias("words"))
    one = both.dropDuplicates(["id", "th"]).select("id", "th", "words", F.explode("all").alias("x"))
    equal = F.filter("x.windows", lambda w: F.slice("words", F.col("x.shift") + w["at"] + 1, w["length"]) == F.slice("x.passage", w["at"] + 1, w["length"]))
    return one.select("id", "th", "x.key", "x.shift", F.explode(equal).alias("w")).select("id", "th", "key", "w.at", "w.length", (F.col("shift") + F.col("w.at")).alias("start"))


def phrase_matches(docs: DataFrame, index: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(phrase, id, th, start) of every occurrence of a phrase (columns phrase, text) in a document."""
    found = passages(phrases, "phrase", "text")
    hits = window_matches(docs, index, found, 1 << 30, id_col, text_col)
    return hits.join(found.select(F.col("item").alias("phrase"), "key"), "key").select("phrase", "id", "th", "start")


def proximity_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query, id, th, first, last): places where all distinct terms of a query (columns query, terms) stand within ``within`` words.
    Starts from the rarest term's list; each other term keeps its nearest positions on either side of it."""
    terms = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    counts = term_counts(index, terms.select("term").distinct())
    ranked = terms.join(counts, "term").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("by_n"))
    parts = written(ranked.select("query", F.size("by_n").alias("need"), F.posexplode("by_n").alias("rank", "x")).select("query", "need", "rank", F.col("x.term").alias("term")), "proximity-terms")
    rarest = index.join(small(parts.where("rank = 0")), "term").select("query", "need", "id", "th", F.col("pos").alias("anchor"))
    block = lambda c: F.floor(c / F.lit(within)).cast("long")
    near = F.explode(F.sequence(block(F.col("anchor") - within), block(F.col("anchor") + within)))
    others = index.join(small(parts.where("rank > 0").drop("need")), "term").select("query", "id", "th", "rank", "pos", block(F.col("pos")).alias("block"))
    tests = rarest.select("query", "need", "id", "th", "anchor", near.alias("block"))
    on = [tests["query"] == others["query"], tests["id"].eqNullSafe(others["id"]), tests["th"] == others["th"], tests["block"] == others["block"]]
    met = tests.join(others, on).where(F.abs(F.col("pos") - F.col("anchor")) < within).select(tests["query"], "need", tests["id"], tests["th"], "anchor", "rank", "pos")
    single = rarest.where("need = 1").select("query", "id", "th", F.col("anchor").alias("first"), F.col("anchor").alias("last"))
    # every window of `within` words that starts at one of the positions around the anchor and holds the anchor
    points = met.groupBy("query", "need", "id", "th", "anchor").agg(F.collect_set(F.struct("pos", "rank")).alias("points"))
    begins = points.select("*", F.explode(F.array_distinct(F.transform(F.concat("points", F.array(F.struct(F.col("anchor").alias("pos"), F.lit(0).alias("rank")))), lambda p: p["pos"]))).alias("first")).where("first <= anchor")
    inside = F.filter(F.concat("points", F.array(F.struct(F.col("anchor").alias("pos"), F.lit(0).alias("rank")))), lambda p: (p["pos"] >= F.col("first")) & (p["pos"] < F.col("first") + within))
    whole = begins.select("query", "need", "id", "th", "first", inside.alias("in")).where(F.size(F.array_distinct(F.transform("in", lambda p: p["rank"]))) == F.col("need"))
    firsts = F.transform(F.array_distinct(F.transform("in", lambda p: p["rank"])), lambda r: F.array_min(F.transform(F.filter("in", lambda p: p["rank"] == r), lambda p: p["pos"])))
    found = whole.select("query", "id", "th", "first", F.array_max(firsts).alias("last"))
    return found.union(single).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, th, n_hit, items): per text with an occurring window its words inside windows and the ids of the windows' items."""
    index = build_index(docs, id_col, text_col)
    found = written(passages(items, item_col, item_text_col), "items")
    hits = written(window_matches(docs, index, found, size, id_col, text_col), "window-matches")
    forget(index)
    spans = hits.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["stop"]).alias("to"))
    n_hit = spans.select("id", "th", F.aggregate("spans", begin, step)["n"].cast("long").alias("n_hit"))
    of_item = hits.join(found.select("key", "item"), "key").groupBy("id", "th").agg(F.collect_set("item").alias("items"))
    same = n_hit["id"].eqNullSafe(of_item["id"]) & (n_hit["th"] == of_item["th"])
    return n_hit.join(of_item, same).select(n_hit["id"], n_hit["th"], "n_hit", "items")


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (item ids, as an array)."""
    found = contamination(docs, items, id_col, text_col, **how)
    base = docs.select(docs[id_col].alias("k"), F.xxhash64(docs[text_col]).alias("kh"), F.size(words_of(docs[text_col])).cast("long").alias("n_words"))
    both = base.join(found, base["k"].eqNullSafe(found["id"]) & (base["kh"] == found["th"]), "left")
    return both.select(F.col("k").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a word inside an occurring window, with all their columns."""
    found = contamination(docs, items, id_col, text_col, **how).select("id", "th")
    return docs.join(found, docs[id_col].eqNullSafe(found["id"]) & (F.xxhash64(docs[text_col]) == found["th"]), "left_anti")
