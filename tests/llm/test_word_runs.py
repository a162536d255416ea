import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from counterbook.llm import queries
from counterbook.llm import word_runs as W
from tests.llm.conftest import SF


def brute_runs(words, min_length=6, min_exponent=4):
    """Every maximal stretch with words q apart identical, for each q by itself; those with a smaller period fall out."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[s : i + q]
            if len(stretch) >= max(min_length, min_exponent * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((s, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(words):
    runs, sha = brute_runs(words), lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(kept))


def numbers(words):
    return np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=50), st.integers(1, 9), st.integers(0, 40))
def test_runs_match_brute_force(words, p, a):
    words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    assert W.word_runs(numbers(words)) == brute_runs(words)
    assert W.word_runs(numbers(words), 5, 2) == brute_runs(words, 5, 2)


def test_many_equal_words_and_long_periods():
    assert W.word_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    words = np.random.default_rng(5).integers(0, 900, 20_000)
    assert W.word_runs(np.tile(words, 5)[:-7]) == [(0, 99_993, 20_000)]
    assert W.word_runs(np.concatenate([np.zeros(9, np.int64), np.ones(9, np.int64)])) == [(0, 9, 1), (9, 9, 1)]


def test_large_sets_keep_their_order():
    items = list(np.random.default_rng(2).permutation(20_000))
    held = W.Blocks(sorted(items[:5000]))
    for x in items[5000:]:
        held.insert(x)
    assert list(held) == list(range(20_000)) and len(held) == 20_000
    assert held.beside(0) == (None, 1) and held.beside(777) == (776, 778) and held.beside(19_999) == (19_998, None)


def test_query_matches_brute_force(spark, texts):
    rows = queries.QUERIES["op11_word_runs"](spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        if len(words := planted(r.doc_id, texts[r.doc_id])) < 3000:
            assert tuple(r)[1:8] == brute_row(words), r.doc_id


def test_odd_rows(spark, odd, odd_rows):
    rows = W.period_runs(odd).collect()
    want = sorted(((i, len((t or "").split())) for i, t in odd_rows), key=str)
    assert sorted(((r.doc_id, r.n_words) for r in rows), key=str) == want
    for r in rows:
        assert r.n_words or (r.runs == [] and r.collapsed == "")
    assert W.period_runs(odd.limit(0)).collect() == []
    text = "a b " * 5 + "c" + " x" * 7
    (r,) = W.period_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(0, 10, 2), (11, 7, 1)] and r.collapsed == "a b c x"


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_strongest_of_none_is_null(spark, text):
    df = spark.createDataFrame([(10, text)], "doc_id long, text string").select("doc_id", W.periodic_copy("doc_id", "text").alias("text"))
    (r,) = W.period_runs(df).select("n_words", W.strongest("runs").alias("best")).collect()
    assert (r.n_words, r.best) == (0, None)
