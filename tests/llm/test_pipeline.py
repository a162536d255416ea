import hashlib
import re

import corpus_pipeline
import __spark_entry__ as entry
from counterbook.llm import queries
from counterbook.llm import quality_lines as Q
from tests.llm.test_bpe import library
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_dedup import brute_components, brute_runs

SMALL = "/root/testdata/sf0.01"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in Q.quality_report(docs).collect() if r.kept}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    rows = {i: t for i, (gone, t) in brute_runs(rows.items()).items() if not gone or t.strip()}
    group = brute_components(rows.items())
    rows = {i: t for i, t in rows.items() if group[i][1] == i}
    hit = {r[0] for r in contaminated(rows.items(), items) if r[2]}
    rows = {i: t for i, t in rows.items() if i not in hit}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(rows)
    for i in list(rows)[::7]:
        n, ids, text = library(rows[i])
        assert got[i] == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_exact_copies_of_several_lines_go_whole(spark):
    text = lambda n, own="": "\n".join(f"line {k} of text {n} {own} has words {k * n} of its own" for k in range(n))
    rows = [(100 * copy + n, ("\n" if n % 3 == 0 else "") + text(n) + ("\n\n" if n % 4 == 0 else "")) for n in range(2, 41) for copy in (1, 2, 3)]
    rows += [(1, text(30, "other")), (1002, text(6) + "\n" + text(8, "new"))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(4)
    left = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs, SMALL), SMALL)
    got = {r.doc_id: r.text for r in left.collect()}
    assert set(got) == {1, 1002, *(100 + n for n in range(2, 41))}
    assert got[1002] == text(8, "new") and got[140] == dict(rows)[140]


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd):
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_every_query_is_registered():
    names = entry.queries()
    assert sorted(n for n in names if re.match(r"op[0-9]+_", n)) == sorted(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert entry.oracle_sql()["op5_licence_rules"] == queries.ORACLE["op5_licence_rules"]
