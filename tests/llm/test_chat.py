import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
T = chat.Template()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\#ec<>/turn: é\n")), max_size=40))
def test_escape_is_reversible_and_holds_no_control_string(text):
    escaped = T.escape(text)
    assert T.unescape(escaped) == text
    for control in T.controls:
        assert control not in escaped
    one = T.parser().fullmatch(T.before("assistant") + escaped + T.ending)
    assert T.unescape(one[2]) == text and T.role_of(one[1]) == "assistant"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "x>: ", ""]), st.text(max_size=20)), max_size=6))
def test_a_whole_formatted_conversation_parses_back(turns):
    whole = "".join(T.before(r) + T.escape(t) + T.ending for r, t in turns)
    found = [(T.role_of(m[1]), T.unescape(m[2])) for m in T.parser().finditer(whole)]
    assert found == turns
    assert sum(len(m[0]) for m in T.parser().finditer(whole)) == len(whole)


def expected(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted((tuple(r)[:5] for r in chat.read_back(chat.format_chats(df)).collect()), key=str)


def test_digests_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").unionByName(chat.planted(spark))
    assert digests(df) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a" * 200_000), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, "tool", "### </turn>"), (None, 0, "user", "q"), (4, 5, "assistant", "first")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROWS + ", valid string")
    assert digests(df) == expected(rows)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize(
    "roles, good",
    [(["user", "assistant"], True), (["system", "user", "assistant"], True), (["user"], False), (["assistant"], False), (["user", "user", "assistant"], False), (["user", "assistant", "system"], False), (["user", "tool"], False)],
)
def test_machine(spark, roles, good):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], ROWS)
    assert chat.read_back(chat.format_chats(df)).first().valid is good


def test_loss_flags(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], ROWS)
    segments = chat.format_chats(df).collect()
    assert [s.text for s in segments if s.loss] == ["a"]
    assert "".join(s.text for s in segments) == "### User: q </turn>\n### Assistant: a </turn>\n"
