import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from counterbook.llm import personal_data as P
from counterbook.llm import queries
from tests.llm.conftest import SF

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]

KIND = {kind: k for k, (kind, _) in enumerate(PATTERNS)}


def keeps(kind, span):
    d = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        doubled = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    return sorted(((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if keeps(kind, m[0])), key=lambda x: x[:2])


piece = st.sampled_from(["1", "2.", "255", "256", ".", "+", "+1", " ", "-", "(", ")", "@", "a", "é", "a.b", "@x.de", "4111111111111111", "555-1234", "@@", ":", "\n", "000"])


@settings(max_examples=500, deadline=None)
@given(st.lists(piece, max_size=25).map("".join))
def test_base_matches_are_those_of_the_patterns(text):
    got = sorted((a, k, b) for k, a, b, ok in P.base_matches(text) if ok)
    assert got == sorted(brute(text))
    assert {(k, a, b) for k, form, a, b, _ in P.candidates(text) if form == P.BASE} == {(k, a, b) for a, k, b in brute(text)}


def test_query_matches_brute_force(spark, texts):
    rows = queries.QUERIES["op13_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        joined = [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), P.KINDS.index(s.split(":")[0])))


def test_method_adds_what_the_patterns_miss(spark):
    """Other writings and parts of longer sequences are found; order numbers, versions, times and hex digits are left alone."""
    base = [f"write to a{k}@mail.example.com or call +1 (202) 555-01{k:02d}, card 4111 1111 1111 1111, host 10.0.0.{k} there" for k in range(40)]
    noise = [f"order 48453706010312{k:02d} version 1.2.300.{k + 400} at 12:30:{k + 10} token = \"8f{k}a4b812088970e66\" item {k}, 2021-03-{k % 28 + 1:02d}" for k in range(40)]
    new = {
        "mail john.doe [at] example [dot] org now": "john.doe [at] example [dot] org", "contact jörg@müller.de please": "jörg@müller.de",
        "cards 4111111111111111 4012888888881881 both": "4111111111111111|4012888888881881", "server 2001:db8::8a2e:370:7334 is up": "2001:db8::8a2e:370:7334",
        "phone (030) 1234-56789 today": "(030) 1234-56789", "call +1 (826) 555-4081 190.137.223.20 now": "+1 (826) 555-4081|190.137.223.20", "card 4111.1111.1111.1111 here": "4111.1111.1111.1111",
    }
    texts = [*base, *noise, *new]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in P.personal_data(df).collect()}
    for k, t in enumerate(texts):
        spans = [t[s.start : s.stop] for s in got[k]]
        if k < 40:
            assert len(spans) == 4 and all(s.base for s in got[k])
        elif k < 80:
            assert [(s.start, KIND[s.kind], s.stop) for s in got[k]] == brute(t), t  # one number in ten passes the card rule
        else:
            assert "|".join(spans) == new[t], t


def test_reliabilities_of_simulated_labelers():
    r = np.random.default_rng(3)
    truth = r.random(40_000) < 0.3
    right = [0.95, 0.9, 0.85, 0.6]
    votes = np.stack([np.where(r.random(len(truth)) < 0.2, 0, np.where(r.random(len(truth)) < a, 1, -1) * np.where(truth, 1, -1)) for a in right], 1)
    groups, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, share, table = P.reliabilities(groups, n.astype(float))
    assert abs(share - 0.3) < 0.02
    for j, a in enumerate(right):
        assert abs(table[j, 1, 2] / (1 - table[j, 1, 1]) - a) < 0.03
    assert ((p[at.ravel()] > 0.5) == truth).mean() > 0.95


def test_groups_survive_their_code():
    for code in (0, 1, 4711, P.GROUPS - 1):
        assert P.code_of(*decoded) == code if (decoded := P.decoded(code)) else False


def test_odd_rows(spark, odd, odd_rows):
    extra = odd.withColumn("spans", odd["words"]).withColumn("found", odd["hash"])
    rows = P.personal_data(extra).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in odd_rows), key=str)
    assert all(r.spans == [] for r in rows)
    assert P.personal_data(odd.limit(0)).collect() == []
    long = "1" * 300_000 + " a" + "b" * 300_000 + "@ " + "0" * 6000 + ".1.2.3 x@y.de" + "(" * 300_000
    df = spark.createDataFrame([(None, long), (None, long), (3, None)], "doc_id long, text string")
    rows = sorted(P.personal_data(df).collect(), key=lambda r: str(r.doc_id))
    assert [len(r.spans) for r in rows] == [0, 2, 2]
