import hashlib
import random
from collections import defaultdict

from counterbook.llm import prefix_trie as P
from counterbook.llm import queries
from counterbook.plans.compare import compare, duckdb_connection
from tests.llm.conftest import SF

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_trie(convs):
    """{prefix: row} of the trie of {id: tuple of turns}; a turn is (role, text)."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)

    def below(node):
        out = [node]
        for n in out:
            out.extend(children[n])
        return out

    rows = set()
    for node, ids in members.items():
        under = below(node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in under if n)
        rows.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), sum(not children[n] for n in under), saved, sha(",".join(map(str, sorted(ends[node]))))))
    return rows


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = P.prefix_trie(P.turn_sequences(df)).collect()
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out]


def sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for *_, r, t in sorted(v)) for c, v in convs.items()}


def test_query_matches_oracle(spark):
    good, message = compare(queries.QUERIES["op12_prefix_trie"](spark, SF), duckdb_connection(SF), queries.ORACLE["op12_prefix_trie"])
    assert good, message


def test_trie_matches_brute_force_over_many_small_trees(spark, monkeypatch):
    """A first turn that most conversations share, copies, conversations that begin others; trees of three keys leave most nodes open."""
    r = random.Random(4)
    rows = []
    for c in range(400):
        c = c * 37 - 5000
        turns = ["hot start" if r.random() < 0.6 else f"start {r.randrange(5)}"] + [f"{r.choice('ab')} word" for _ in range(r.randrange(7))]
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]
    want = brute_trie(sequences(rows))
    assert sorted(trie(spark, rows), key=str) == sorted(want, key=str)
    monkeypatch.setattr(P, "TREE_KEYS", 3)
    monkeypatch.setattr(P, "BLOCK", 64)
    assert sorted(trie(spark, rows), key=str) == sorted(want, key=str)


def test_layouts_grow_and_paths_split():
    r = random.Random(1)
    for width in (3, 12, 40, 256):
        tree, known = P.RadixTree(), {}
        for _ in range(3000):
            key = bytes(r.randrange(width) for _ in range(r.randrange(4)))
            assert tree.at(key, lambda k=key: [k]) is known.setdefault(key, tree.at(key, list))
        layouts = {type(n.branches).__name__ + str(getattr(n.branches, "room", "")) for n, _, _ in tree.bottom_up()}
        assert {3: "Few4", 12: "Few16", 40: "Indexed", 256: "Direct"}[width] in layouts
        assert all((b := [b for b, _ in n.branches.items()]) == sorted(b) for n, _, _ in tree.bottom_up())
        assert sum(n.value is not None for n, _, _ in tree.bottom_up()) == len(known)
    long = bytes(range(200)) * 40
    tree = P.RadixTree()
    tree.at(long, list)
    tree.at(long[:100], list)
    tree.at(long[:50] + b"\xff", list)
    assert sorted((top, end) for _, top, end in tree.bottom_up()) == [(0, 0), (0, 50), (50, 51), (50, 100), (100, 8000)]


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, None, "", ""), (2, 0, "user", "a b"), (3, 5, "user:", "x"), (4, 5, "user", ":x"),
        (None, 0, "user", "lost"), (5, 1, "user", "long " * 100_000), (6, 1, "user", "long " * 100_000), (-2**62, 0, "user", "a b"), (2**62, 0, "user", "a b"),
    ]
    assert sorted(trie(spark, rows), key=str) == sorted(brute_trie(sequences(rows)), key=str)
    assert trie(spark, []) == []
    df = spark.createDataFrame([(*x, "p", 1) for x in rows], "conv_id long, turn int, role string, text string, path string, id int")
    assert P.turn_sequences(df).count() == 8


def test_spliced_conversations(spark):
    from pyspark.sql import functions as F

    seq = P.turn_sequences(spark.createDataFrame([(c, k, "user", f"{c} {k}") for c in (20, 21, 22, 45) for k in range(c % 20 + 1)], "conv_id long, turn int, role string, text string"))
    ids = {r.conv_id: [t.turn_id for t in r.turns] for r in seq.collect()}
    got = {r.conv_id: [t.turn_id for t in r.turns] for r in P.spliced(seq, 20, F.lit(2)).collect()}
    assert got == {20: ids[20], 21: ids[20], 22: ids[20] + ids[22][2:], 45: ids[45][2:]}
