import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from counterbook.llm import chat_render as C
from counterbook.llm import queries
from tests.llm.conftest import SF

piece = st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "\\", "[", "<", "a", " ", "\n", "/INST]", "s>"])
text = st.lists(piece, max_size=8).map("".join)


def test_query_matches_brute_force(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = queries.QUERIES["op10_chat_render"](spark, SF).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(turns)
    for r in rows:
        mine = turns[r.conv_id]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(C.instruction_template(mine)))


@settings(max_examples=200, deadline=None)
@given(text)
def test_escaping_is_reversible_and_hides_control_strings(t):
    hidden = C.escape(t)
    assert C.unescape(hidden) == t
    assert not any(c in hidden for c in C.CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[ROLE]"]), text), max_size=6))
def test_spans_cover_the_rendering(turns):
    f = C.format_chat(turns)
    assert f.text == C.instruction_template(turns)
    assert [b for _, b in f.spans[:-1]] == [a for a, _ in f.spans[1:]]
    assert [C.unescape(f.text[a:b]) for a, b in f.texts] == [t for _, t in turns]


def test_a_template_that_rewrites_history_is_found(spark):
    def last_two(turns):
        return "".join(f"<{r}>{t}" for r, t in turns[-2:])

    with pytest.raises(C.RewritesHistory) as e:
        C.format_chat([("user", str(k)) for k in range(5)], last_two)
    assert e.value.turn == 2
    rows = spark.createDataFrame([(1, k, "user", str(k)) for k in range(5)] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.format_conversations(rows, last_two).collect()}
    assert got[1].rewrites_at == 2 and got[1].spans == [] and got[1].formatted == "<user>3<user>4"
    assert got[2].rewrites_at is None


def test_odd_rows(spark):
    rows = [(1, 0, "user", ""), (1, 0, "user", ""), (None, None, None, None), (2, 1, "assistant", "\\[INST]\\\\<s>"), (2, 0, "x[ROLE]", "\n"), (3, 5, "assistant", "w " * 30_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(frame)).collect()}
    assert [(t.role, t.text) for t in got[2].turns] == [("x[ROLE]", "\n"), ("assistant", "\\[INST]\\\\<s>")] and got[2].loss_text == "\\[INST]\\\\<s>"
    assert len(got[1].turns) == 2 and got[1].loss_text == "" and [t.role for t in got[None].turns] == [""]
    assert got[3].loss_text == "w " * 30_000
    assert C.format_conversations(frame.limit(0)).count() == 0


def test_a_false_window_is_found_out():
    def counted(turns):
        return f"{len(turns) // 3}|" + "".join(f"<{r}>{t}" for r, t in turns)

    def late(turns):
        return "".join(f"<{r}>{t}" for r, t in turns) + ("" if len(turns) < 4 else "!")

    counted.window = late.window = 1
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    with pytest.raises(C.RewritesHistory) as e:
        C.format_chat(turns, counted)
    assert e.value.turn == 2
    f = C.format_chat(turns, late)  # nothing rewritten, but a turn depends on more than its window
    assert f.text == late(turns) and f.spans[-1][1] == len(f.text)


def test_roles_are_read_from_the_output(spark):
    roles = ["user", "assistant", "system", "", "[ROLE]", "a[/ROLE]b", "[INST] ", "\\", "us\ner"]
    rows = [(1, k, r, f"[INST] {r}[/ROLE] x") for k, r in enumerate(roles)] + [(2, 0, None, None)]
    out = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).drop("roles")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.read_back(out).collect()}
    assert got == {1: [(r, f"[INST] {r}[/ROLE] x") for r in roles], 2: [("", "")]}
