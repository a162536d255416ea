"""The driver's queries of the training-data operators: each applies its
operator, with production parameters, to its whole table and derives the
digest columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bbit_minhash, chat_render, html_blocks, licence_rules, line_chunks, personal_data, positional_index, prefix_trie, quality_lines, rule_ensemble, suffix_dedup, word_bpe, word_runs
from .shared import read_table, written

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.quality_report(read_table(spark, sf_dir, "documents"))


@query
def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text after line dedup as its code points and digest, and the chunks taken out, per document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_chunks.line_dedup(docs)
    return out.select("doc_id", "removed_chunks", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bbit_minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


@query
def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    out = positional_index.contamination_report(docs, items)
    names = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(word_bpe.encode(read_table(spark, sf_dir, "documents"), vocabulary()))


@query
def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = rule_ensemble.train(docs, labels, allowed=fold != 0)
    return rule_ensemble.scored(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"  # a conversation whose texts are control strings
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema))
    out = chat_render.read_back(chat_render.format_conversations(rows))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op5_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licence_rules.licence_scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_known", F.concat_ws(",", "rules").alias("rules"), F.concat_ws(",", "licences").alias("licences"))


ORACLE["op5_licence_rules"] = licence_rules.oracle_sql()


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.extract(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", word_runs.periodic_copy("doc_id", "text").alias("text"))
    out = word_runs.period_runs(docs).withColumn("best", word_runs.strongest("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data.personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in personal_data.KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations rebuilt so that they share beginnings: up to three first turns come from a neighbour."""
    turns = written(prefix_trie.turn_sequences(read_table(spark, sf_dir, "conversations")), "turn-sequences")
    rebuilt = prefix_trie.spliced(turns, 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    out = prefix_trie.prefix_trie(rebuilt)
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE["op12_prefix_trie"] = r"""
with crcs as (
  select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(conv_id::varchar) + 1),
      lambda i: [ord(substring(conv_id::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end), 4294967295::bigint) % 4 as h
  from (select distinct conv_id from conversations where conv_id is not null)),
own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as turn_id,
    length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
  from conversations where conv_id is not null),
spliced as (
  select c.conv_id, 0 as src, o.i, o.turn_id, o.words from crcs c join own o on o.conv_id = c.conv_id - c.conv_id % 20 and o.i <= c.h
  union all select c.conv_id, 1, o.i, o.turn_id, o.words from crcs c join own o on o.conv_id = c.conv_id and o.i > c.h),
prefixes as (
  select conv_id, row_number() over w as depth, string_agg(turn_id, '') over w as path, words from spliced
  window w as (partition by conv_id order by src, i rows between unbounded preceding and current row)
  union all select conv_id, 0, '', 0 from crcs),
nodes as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from prefixes group by path),
ends as (
  select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as digest
  from (select conv_id, arg_max(path, depth) as path from prefixes group by conv_id) group by path),
counted as (
  select n.*, coalesce(c.n, 0) as n_children from nodes n
  left join (select left(path, length(path) - 32) as above, count(*) as n from nodes where depth > 0 group by all) c on c.above = n.path),
below as (
  select left(path, 32 * k) as path, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as k from counted) group by 1)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens,
  coalesce(e.digest, sha256('')) as ends_sha256
from counted n join below b on b.path = n.path left join ends e on e.path = n.path left join nodes p on n.depth > 0 and p.path = left(n.path, length(n.path) - 32)
"""
