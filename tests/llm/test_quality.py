import re
from collections import Counter

import numpy as np

from counterbook.llm import quality_lines as Q
from counterbook.llm import queries
from tests.llm.conftest import SF


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {j for i in range(len(words) - 7) if found[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 20 or 100 * len(repeat) > 30 * n


def as_tuple(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts_match_brute_force(spark, texts):
    rows = queries.QUERIES["op1_quality_lines"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert as_tuple(r) == counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_clean_documents_stay_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op1_quality_lines"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1 and not r.base_failed)
    junk = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(junk) <= 0.1 * len(junk)


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        e, t = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        score = lambda y: sum(e[k, y[k]] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1))  # noqa: E731, B023
        best = max((tuple(int(c) for c in f"{v:0{n}b}") for v in range(2**n)), key=score)
        assert tuple(Q.viterbi(e, t, np.array([0, n]))) == best
    assert list(Q.viterbi(np.zeros((0, 2)), t, np.array([0, 0, 0]))) == []


PAGE = """Home
About us
Products
Contact
Log in / Register
Search this site
We use cookies to improve your experience on our site
Accept all cookies
Share on Facebook
Follow us on Twitter and Instagram
Subscribe to our newsletter
Privacy policy and terms of use
© 2023 Example Widgets Ltd. All rights reserved."""
NOTE = "The committee met on Tuesday to read the policy on water rights, and about forty people came to the main hall to follow the terms of the deal.\nNobody was ready to accept it.\nA search for a better answer goes on, said the mayor, who will contact the press again next week."


def test_page_furniture_is_boilerplate_and_prose_about_it_is_not(spark):
    rows = Q.quality_report(spark.createDataFrame([(1, PAGE), (2, NOTE), (3, NOTE + "\n© 2023 Example. All rights reserved.")], "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert not got[1].kept and got[1].n_boilerplate_lines >= 11
    assert got[2].kept and got[2].n_boilerplate_lines == 0
    assert got[3].kept and got[3].n_boilerplate_lines <= 1


def test_kinds_of_furniture_that_training_did_not_see(spark):
    for kind in Q.KINDS[5:]:
        model = Q.fit_crf(Q.generated_lines(texts=300, kinds=tuple(k for k in Q.KINDS if k != kind)), steps=120)
        unseen = Q.generated_lines(seed=77, texts=120, kinds=(kind,))
        docs = spark.createDataFrame([(k, "\n".join(lines)) for k, (lines, _) in enumerate(unseen)], "doc_id long, text string")
        truth = {(k, n): label == Q.CONTENT for k, (_, labels) in enumerate(unseen) for n, label in enumerate(labels)}
        right = [truth[r.doc_id, r.line] == r.content for r in Q.line_labels(docs, model=model).collect()]
        assert len(right) == len(truth) and sum(right) >= 0.9 * len(right), (kind, sum(right) / len(right))


def test_odd_rows(odd, odd_rows):
    rows = Q.quality_report(odd).collect()
    assert sorted(map(as_tuple, rows)) == sorted(counts(t) for _, t in odd_rows)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    kept = Q.keep_quality(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert Q.quality_report(odd.limit(0)).count() == 0
    labels = Q.line_labels(odd.where("doc_id = 1")).collect()
    assert [(r.line, r.content) for r in sorted(labels, key=lambda r: r.line)] == [(0, True), (1, True), (2, True)]
