import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import chat

ATOMS = ["\\", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE=", "[/ROLE]", "]", "[", "a", "\n", "é", "<", "s>", "/", "INST]"]
texts = st.lists(st.sampled_from(ATOMS), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool]\\"]), texts)


@given(st.lists(st.tuples(roles, texts), min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    back = chat.parse(formatted)
    assert [x[:2] for x in back] == turns
    assert "".join(chat.unescape(formatted[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_plain_texts_are_not_escaped():
    formatted, spans = chat.format_turns([("user", "hi [there] \\o/"), ("assistant", "5 < 6"), ("user", "[/INST]")])
    assert formatted == "[INST]hi [there] \\o/[/INST]<s>5 < 6</s>[INST]\\[/INST][/INST]"
    assert [formatted[a:b] for a, b in spans] == ["5 < 6"]


@pytest.mark.parametrize("bad", ["x", "[INST]a", "[INST]a</s>[/INST]", "[ROLE=a", "<s>a</s>tail"])
def test_conflicts(bad):
    with pytest.raises(chat.Conflict):
        chat.parse(bad)


def test_tables(spark):
    rows = [
        (1, 1, "assistant", "two", 0), (1, 0, "user", "one", 0), (1, None, "system", None, 0), (2, 0, None, "</s>[INST] ok [/INST]", 0),
        (None, 0, "assistant", "", 0), (3, 0, "assistant", "a", 0), (3, 0, "assistant", "a", 0), (4, 0, "assistant", "x" * 300_000, 0),
    ]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert out[1]["turns_sha256"] == digest(("system", ""), ("user", "one"), ("assistant", "two")) and out[1]["n_turns"] == 3
    assert out[1]["loss_chars"] == 3 and out[1]["loss_sha256"] == hashlib.sha256(b"two").hexdigest()
    assert out[2]["turns_sha256"] == digest(("", "</s>[INST] ok [/INST]")) and out[2]["loss_chars"] == 0
    assert out[3]["n_turns"] == 2 and out[3]["loss_chars"] == 2
    assert out[4]["formatted_chars"] == 300_007 and out[None]["n_turns"] == 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).collect() == []
