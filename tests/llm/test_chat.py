"""Spans of turns, the loss mask, templates that rewrite history."""

import hashlib

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from movecheck.llm import chat, queries


def test_query_reads_back_every_turn(spark, sf_dir):
    found = queries.QUERIES["op9_chat_format"](spark, sf_dir).toPandas().set_index("conv_id")
    said = pd.read_parquet(f"{sf_dir}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    said = pd.concat([said, pd.DataFrame(queries.CONTROL_CONVERSATION, columns=said.columns)])
    for conv, turns in said.sort_values("turn").groupby("conv_id"):
        texts = [t or "" for t in turns.text]
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(turns.role, texts))
        loss = "".join(t for r, t in zip(turns.role, texts) if r == "assistant")
        row = found.loc[conv]
        assert row.n_turns == len(turns) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert len(found) == said.conv_id.nunique()
    # Both texts of conversation -7 are 21 characters, six of which are escaped.
    assert found.loc[-7].n_turns == 2 and found.loc[-7].loss_chars == len("</s>[INST] ok [/INST]")


_PARTS = [*"ab \\[]<>/S\n", "[INST] ", " [/INST]", " </s>\n", "<<SYS>> ", "<<ROLE x>> "]
_TEXT = st.lists(st.sampled_from(_PARTS), max_size=12).map("".join)
_TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a>b"]), _TEXT), max_size=7)


@settings(max_examples=300, deadline=None)
@given(_TURNS)
def test_any_conversation_comes_back(turns):
    found = chat.locate(chat.instruct_template, turns)
    assert found.rewrites is None and len(found.spans) == len(turns)
    assert [chat.read_turn(found.text[a:b]) for a, b in found.spans] == turns
    assert [chat.unescape(found.text[a:b]) for a, b in found.inner] == [t for _, t in turns]
    assert "".join(found.text[a:b] for a, b in found.spans) == found.text


@settings(max_examples=60, deadline=None)
@given(_TURNS.filter(lambda t: len(t) > 3))
def test_windows_find_the_same_spans(turns):
    assert chat.locate(chat.instruct_template, turns, window=2) == chat.locate(chat.instruct_template, turns)


def test_long_conversations_stay_linear_with_a_window():
    calls = []

    def render(messages):
        calls.append(len(messages))
        return chat.instruct_template(messages)

    found = chat.locate(render, [("user" if i % 2 else "assistant", f"text {i}") for i in range(3000)], window=32)
    assert len(found.spans) == 3000 and sum(calls) < 3000 * 4 * 32


def test_rewriting_templates_are_detected():
    def forgets(messages):
        """Drops what the assistant said before its last turn."""
        last = max((i for i, m in enumerate(messages) if m[0] == "assistant"), default=-1)
        return "".join(f"<{r}>{t if r != 'assistant' or i == last else '-'}" for i, (r, t) in enumerate(messages))

    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    found = chat.locate(forgets, turns)
    assert found.rewrites == 3 and found.spans == [] and found.text == forgets(turns)
    assert chat.locate(forgets, turns, window=2).rewrites == 3
    assert chat.locate(forgets, turns[:2]).rewrites is None


def test_a_rewrite_by_length_is_detected_at_any_length():
    def at_exactly(n):
        return lambda messages: ("!" if len(messages) == n else "?") + "".join(f"<{r}>{t}" for r, t in messages)

    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(200)]
    for n in (1, 2, 31, 32, 33, 50, 64, 199, 200):
        assert chat.locate(at_exactly(n), turns).rewrites == n - 1
    assert chat.locate(at_exactly(201), turns).rewrites is None


@settings(max_examples=60, deadline=None)
@given(_TURNS)
def test_what_stands_before_all_turns(turns):
    found = chat.locate(lambda messages: "<s>\n" + chat.instruct_template(messages), turns)
    assert [chat.read_turn(found.text[a:b]) for a, b in found.spans] == turns
    assert found == chat.locate(lambda messages: "<s>\n" + chat.instruct_template(messages), turns, window=2)


def test_templates_that_look_back_are_located():
    def numbered(messages):
        return "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(messages))

    turns = [("user", str(i)) for i in range(50)]
    found = chat.locate(numbered, turns, window=4)
    assert [found.text[a:b] for a, b in found.inner] == [t for _, t in turns]


def test_edge_rows(spark):
    rows = [
        (1, 2, "user", "later", 9), (1, 1, None, "no role", 9), (1, 1, None, "no role", 9), (1, None, "user", None, 9),
        (None, 1, "assistant", "lost", 9), (2, 1, "assistant", "", 9), (3, 1, "assistant", "x" * 200_000, 9),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert set(out) == {None, 1, 2, 3}
    turns = [chat.read_turn(out[1].formatted[t.start : t.end]) for t in out[1].turns]
    assert turns == [("user", ""), ("", "no role"), ("", "no role"), ("user", "later")]
    assert [(t.text_start == t.text_end, t.loss) for t in out[2].turns] == [(True, True)]
    assert chat.formatted(df.limit(0)).count() == 0
