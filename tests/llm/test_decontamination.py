import hashlib
import re
from collections import Counter, defaultdict

from counterbook.llm import positional_index as P
from counterbook.llm import queries
from tests.llm.conftest import lower_az

SMALL = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))


def brute(docs, items, size=10):
    wins = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add(i)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {r[0]: r for r in brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])}
    rows = queries.QUERIES["op7_positional_index"](spark, SMALL).collect()
    assert len(rows) == len(want) and any(r.contaminated for r in rows)
    for r in rows:
        _, n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_only_dataframe_functions(spark, odd):
    items = spark.createDataFrame([(1, "and another one")], "item_id long, text string")
    plan = P.contamination_report(odd, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows_short_items_and_overlaps(spark, odd, odd_rows):
    items = [(1, "and ANOTHER one"), (2, None), (3, ""), (4, "another one here and a third"), (5, "and another one"), (6, "zzz never"), (None, "no id here")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = P.contamination_report(odd, frame).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r.items or [])) for r in rows), key=str)
    want = [(i, n, hit, len([x for x in found if x != "None"])) for i, n, hit, found in brute(odd_rows, items)]
    assert got == sorted(want, key=str)
    kept = P.clean_documents(odd, frame)
    assert kept.columns == odd.columns and kept.count() == sum(not r.n_hit for r in rows)
    assert P.contamination_report(odd.limit(0), frame).count() == 0
    assert Counter(r.n_hit for r in P.contamination_report(odd, frame.limit(0)).collect()) == Counter({0: len(odd_rows)})


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "The cat sat. On the cat sat mat"), (2, None), (3, ""), (4, "cat x x x dog y bird cat")], "doc_id long, text string")
    index = P.build_index(docs)
    phrases = spark.createDataFrame([(10, "CAT sat"), (11, "the cat"), (12, ""), (13, "zzz cat")], "phrase long, text string")
    found = sorted((r.phrase, r.id, r.start) for r in P.phrase_matches(docs, index, phrases).collect())
    assert found == [(10, 1, 1), (10, 1, 5), (11, 1, 0), (11, 1, 4)]
    asked = spark.createDataFrame([(1, ["cat", "dog"]), (2, ["mat"]), (3, ["bird", "dog", "cat"])], "query long, terms array<string>")
    near = sorted((r.query, r.id, r["first"], r["last"]) for r in P.proximity_matches(index, asked, 5).collect())
    assert near == [(1, 4, 0, 4), (1, 4, 4, 7), (2, 1, 7, 7), (3, 4, 4, 7)]
