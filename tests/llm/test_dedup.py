import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from counterbook.llm import bbit_minhash as M
from counterbook.llm import line_chunks as L
from counterbook.llm import queries
from counterbook.llm import suffix_dedup as S
from counterbook.llm import textops as T
from tests.llm.conftest import SF, lower_az

# -- line chunks ------------------------------------------------------------------------------------------------------


def brute_runs(rows):
    """Every run of lines with two or more worded ones that stands earlier too goes: places with an equal line are
    extended line by line. (runs taken out, text) by id."""
    lines, at = [], []
    for i, text in sorted(rows, key=lambda r: r[0]):
        at.append((i, len(lines), len(lines) + len((text or "").split("\n"))))
        lines += [*(text or "").split("\n"), None]  # None: the end of a text
    worded = [bool(x and x.strip(" \t\n\x0b\x0c\r")) for x in lines]
    gone, places = [False] * len(lines), defaultdict(list)
    for p, line in enumerate(lines):
        if not worded[p]:
            continue
        for q in places[line]:
            n = 1
            while lines[p + n] is not None and lines[q + n] == lines[p + n]:
                n += 1
            while not worded[p + n - 1]:
                n -= 1
            if sum(worded[p : p + n]) > 1:
                gone[p : p + n] = [True] * n
        places[line].append(p)
    return {i: (sum(gone[k] and not (k > a and gone[k - 1]) for k in range(a, b)), "\n".join(lines[k] for k in range(a, b) if not gone[k])) for i, a, b in at}


def chunks_of(text):
    """The chunks of a text, as text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    first, last, _, (start, end, _) = L.line_chunks_of(data, np.array([0, len(data)]), T.Hasher(data, T.byte_table(), T.Powers()))
    return [bytes(data[start[a] : end[b]]).decode() for a, b in zip(first, last, strict=True)]


def test_borders_are_chosen_by_content_and_resist_shifts(texts):
    passage = "\n".join(f"line {k} of a shared passage" for k in range(60))
    a, b = chunks_of("intro\n" + passage), chunks_of("other\nheading\n\n" + passage + "\nend")
    assert set(chunks_of(passage)) == {c for c in a if "intro" not in c} <= set(b)
    sizes = Counter(c.count("\n") + 1 for c in chunks_of(passage))
    assert sizes[2] == 59 and sum(sizes.values()) > 100 and max(sizes) > 4  # lengths are the hashes' choice
    for t in list(texts.values())[:50]:
        assert all(c in (t or "") and len([x for x in c.split("\n") if x.strip()]) > 1 for c in chunks_of(t))


def test_rolling_hash_depends_on_its_lines_only():
    lines = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    whole, part = L.rolling_hashes(lines), L.rolling_hashes(lines[10:30])
    assert (whole[10:29] == part).all() and len(set(whole.tolist())) == 49
    assert len(L.rolling_hashes(lines[:1])) == 0


def test_line_dedup_matches_brute_force(spark, texts):
    want = brute_runs(texts.items())
    rows = queries.QUERIES["op3_line_chunks"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r.removed_chunks for r in rows)
    for r in rows:
        gone, kept = want[r.doc_id]
        assert (r.removed_chunks, r.kept_chars, r.kept_sha256) == (gone, len(kept), hashlib.sha256(kept.encode()).hexdigest())


def test_line_dedup_odd_rows(odd):
    out = L.line_dedup(odd)
    assert out.columns == [*odd.columns, "removed_chunks"] and out.count() == odd.count()
    same = {(r.doc_id, r.hash): r.text for r in odd.collect()}
    for r in out.collect():
        if not r.removed_chunks:
            assert r.text == same[r.doc_id, r.hash]
    assert L.line_dedup(odd.limit(0)).count() == 0
    clash = L.line_dedup(odd.withColumnRenamed("kept", "removed_chunks").withColumnRenamed("hash", "_th"))
    assert clash.columns[-1] == "removed_chunks_" and clash.count() == odd.count()


def test_line_dedup_follows_n_chars_and_drops_the_emptied(spark):
    text = "\n".join(f"row {k} with words" for k in range(40))
    docs = spark.createDataFrame([(1, text, len(text)), (2, text, len(text)), (3, "", 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in L.line_dedup(docs).collect()}
    assert out[1].text == text and out[2].n_chars == len(out[2].text) < len(text) and out[3].text == ""


def test_every_repeated_run_of_lines_goes(spark, texts):
    import random

    r = random.Random(5)
    rows = [(k, "\n".join(r.choice(["a", "b", "c", "d e", "", " "]) for _ in range(r.randrange(1, 9)))) for k in range(150)]
    for n in range(2, 41):  # passages of 2 to 40 lines between lines of their own
        passage = "\n".join(f"line {k} of passage {n}" + "\n" * (k % 5 == 4) for k in range(n))
        rows += [(1000 * n + k, f"own {k} {n}\n{passage}\nend {k} {n}") for k in range(3)]
    want = brute_runs(rows)
    assert want[2001] == (1, "own 1 2\nend 1 2")
    got = {x.doc_id: (x.removed_chunks, x.text) for x in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want
    want = brute_runs(texts.items())
    for x in queries.QUERIES["op3_line_chunks"](spark, SF).collect():
        gone, kept = want[x.doc_id]
        assert (x.removed_chunks, x.kept_chars, x.kept_sha256) == (gone, len(kept), hashlib.sha256(kept.encode()).hexdigest())


# -- suffix arrays ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=120).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 6))
def test_suffix_array_and_prefixes(piece, times):
    data = np.frombuffer(piece * times + b"end" + piece, np.uint8)
    order, tied = S.suffix_array(data)
    raw = bytes(data)
    heads = [raw[i : i + S.WINDOW] for i in order]
    assert heads == sorted(heads) and sorted(order) == list(range(len(raw)))

    def prefix(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert list(S.common_prefixes(data, order, tied)) == [0, *(prefix(a, b) for a, b in zip(heads, heads[1:]))]


def test_the_order_tells_exactly_who_shares_a_window():
    """The last refinement stops at the window's length, so no common prefix is left to be walked."""
    block = np.random.default_rng(5).integers(0, 256, S.WINDOW + 5, dtype=np.uint8)
    data = np.concatenate([block, np.array([1], np.uint8), block, np.array([2], np.uint8)])
    order, tied, apart = S.refined(data)
    assert sorted(order[tied] % (S.WINDOW + 6)) == list(range(6)) and (apart == ~tied).all()
    assert ((S.common_prefixes(data, order, tied, apart) < S.WINDOW) == apart).all()


def brute_bytes(rows):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if seen.setdefault(raw[s : s + 100], (i, s)) != (i, s):
                gone[s : s + 100] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup_matches_brute_force(spark, texts):
    rows = queries.QUERIES["op6_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_bytes(texts.items())


def test_suffix_dedup_across_many_shards_with_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 3)
    monkeypatch.setattr(S, "SHARD_BYTES", 3000)
    monkeypatch.setattr(S, "MERGE_WINDOWS", 500)
    passage = "A passage of quite common words that stands in many texts, and long enough to be a repeated string of over one hundred bytes in each. "
    rows = [(k, f"{k * 7919} {passage} tail {k * k}" + ("und " * 90 if k % 3 == 0 else "")) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "a\x00" * 300), (103, "\x00" * 250), (104, "ü" * 180), (105, passage + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.remove_repeats(docs).collect()}
    assert got == brute_bytes(rows)


def test_suffix_dedup_odd_rows(odd, odd_rows):
    rows = S.remove_repeats(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert [r.n_removed for r in by_id[5]] == [0, 0]  # the same row twice is one document
    assert by_id[6][0].n_removed == 2999 and by_id[2][0].n_bytes == 0
    assert S.remove_repeats(odd.limit(0)).count() == 0


# -- near-duplicates ----------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter(p for ids in holders.values() for p in combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    rows = queries.QUERIES["op9_bbit_minhash"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_a_large_group_of_near_copies(spark):
    import random

    r = random.Random(1)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = f"x{i}-{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + k, f"a few w{k}") for k in range(5)] + [(2000, rows[3][1].upper()), (2001, "")]
    got = {x.doc_id: (x.n_shingles, x.component) for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(odd, odd_rows):
    rows = M.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    comp = defaultdict(set)
    for r in rows:
        comp[r.doc_id].add(r.component)
    assert comp[7] == {1} and comp[2] == {2} and comp[None] == {None} and comp[5] == {5}
    assert M.near_duplicates(odd.limit(0)).count() == 0


def test_texts_under_one_id_tie_their_groups(spark):
    r = random.Random(11)
    one, two = ([f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(2))
    near = lambda ws, k: " ".join([*ws[:k], "changed", *ws[k + 1 :]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (5, near(one, 40)), (6, near(two, 90)), (6, None), (7, near(two, 90)), (8, "something else altogether, of six words")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 1), (5, 1), (6, 1), (6, 1), (7, 1), (8, 8)]


def test_a_near_duplicate_run_leaves_only_what_its_last_step_reads(spark):
    from pathlib import Path

    from counterbook.llm.shared import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    M.near_duplicates(spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f h")], "doc_id long, text string")).collect()
    assert sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before) == ["components-2", "minhash", "own"]


def test_texts_meet_the_wanted_ids_by_the_same_join_at_every_size(spark):
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "x y z"), (None, "a b c d e f")], "id long, text string")
    keyed = M.features(texts, "id", "text").where("id = 1").select("id", "set_a", "set_b", "id")
    wanted = spark.createDataFrame([tuple(r) for r in keyed.collect()], "id long, set_a long, set_b long, node long")
    sets = M.full_sets(texts, wanted)
    assert [(r.node, len(r.set)) for r in sets.collect()] == [(1, 16)]
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [id" in plan.split("MapInArrow")[1]


def test_estimate_is_corrected_for_chance():
    assert M.least_agreement() < M.HASHES * (0.75 + 0.25 / 2**M.BITS) < M.HASHES
