"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

The template names the text before and after each role's turns and the roles
that carry loss; the machine names the roles that may follow each role. A
conversation's turns are read in order of turn, so a conversation of any length
streams through one task in constant memory, and the result is a table of
segments: marks (no loss) and bodies (loss by role).

Inside a body every occurrence of the escape character is doubled into
`escape + "e"`, and a control string of the template gets `escape + "c"` after
its first character. No control string contains the escape character, so none
can begin or end in an escaped body and `unescape` restores every text.

Defined cases: null text is empty; a null or unknown role is written under the
template's fallback mark with its own name escaped, carries no loss, and makes
the conversation invalid; turns that tie are ordered by role and text; repeated
rows are turns of their own; a null conv_id is one conversation; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import bound_batches

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands before each role's text, what ends a turn, which roles carry loss, and which role may follow which ('' begins and ends)."""

    opening: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### Role <", ">: ")
    ending: str = " </turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "")}
    )
    controls: tuple[str, ...] = ("###", "</turn>", ">: ")

    def __post_init__(self):
        for text in (*self.opening.values(), *self.other, self.ending):
            assert ESCAPE not in text, "a mark must not hold the escape character"
        for mark in (*self.opening.values(), *self.other, self.ending):
            assert any(c in mark for c in self.controls), "every mark must hold a control string"
        for c in self.controls:
            assert len(c) > 1 and c[0] not in c[1:] or len(set(c)) == 1, "a control string must not overlap itself but by one character"

    def escape(self, text: str) -> str:
        text = text.replace(ESCAPE, ESCAPE + "e")
        for control in self.controls:
            if len(set(control)) == 1:  # a run: part every two neighbours
                text = re.sub(f"{re.escape(control[0])}(?={re.escape(control[0])})", lambda m: m[0] + ESCAPE + "c", text)
            else:
                text = text.replace(control, control[0] + ESCAPE + "c" + control[1:])
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return text.replace(ESCAPE + "c", "").replace(ESCAPE + "e", ESCAPE)

    def before(self, role: str | None) -> str:
        return self.opening[role] if role in self.opening else f"{self.other[0]}{self.escape(role or '')}{self.other[1]}"

    def role_of(self, mark: str) -> str:
        known = {v: k for k, v in self.opening.items()}
        return known[mark] if mark in known else self.unescape(mark[len(self.other[0]) : len(mark) - len(self.other[1])])

    def parser(self) -> re.Pattern:
        """Matches one formatted turn: its mark, its body and its ending."""
        marks = "|".join([*map(re.escape, self.opening.values()), f"{re.escape(self.other[0])}.*?{re.escape(self.other[1])}"])
        return re.compile(f"({marks})(.*?)({re.escape(self.ending)})", re.DOTALL)


SEGMENTS = "conv_id long, turn_no long, part long, text string, loss boolean, valid boolean"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
#: Characters of segments that are sent on at a time.
SENT_CHARS = 4 << 20


def _in_order(conversations: DataFrame) -> DataFrame:
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), c["role"].cast("string").alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments in order: of each turn part 0 (mark), 1 (body), 2 (ending). `valid` says whether the machine has accepted all turns so far.

    The last segment of a conversation (part 3, empty) says whether it may end there.
    """
    bound_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, state, number, valid, some, chars = None, "", 0, True, False, 0

        def flush() -> pa.RecordBatch:
            nonlocal chars
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, _SEGMENTS.types)], schema=_SEGMENTS)
            out.clear()
            chars = 0
            return batch

        def end() -> None:
            if some:
                out.append((conv, number, 3, "", False, valid and "" in template.follows.get(state, ())))

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not some or conv_id != conv:
                    end()
                    conv, state, number, valid, some = conv_id, "", 0, True, True
                valid = valid and role in template.follows.get(state, ())
                state = role or "?"
                body = template.escape(text)
                out += [(conv, number, 0, template.before(role), False, valid), (conv, number, 1, body, role in template.loss, valid), (conv, number, 2, template.ending, False, valid)]
                number, chars = number + 1, chars + len(body)
                if chars > SENT_CHARS:
                    yield flush()
        end()
        yield flush()

    return _in_order(conversations).mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from its formatted segments in order: each turn is put together, parsed by the template's marks and unescaped."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in DIGEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows = template.parser(), []
        turns = loss = None
        n_turns = loss_chars = chars = 0
        parts: list[str] = []
        with_loss = False
        for batch in batches:
            for conv, part, text, flag, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss", "valid"))):
                if turns is None:
                    turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                if part == 3:
                    rows.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    turns = None
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows.clear()
                    continue
                parts.append(text)
                chars += len(text)
                if flag:
                    masked = template.unescape(text)
                    loss.update(masked.encode())
                    loss_chars += len(masked)
                if part == 2:
                    found = parser.fullmatch("".join(parts))
                    turns.update(f"{template.role_of(found[1])}\n{template.unescape(found[2])}\n".encode())
                    n_turns += 1
                    parts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)

    return segments.mapInArrow(run, DIGEST)


def planted(spark) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS of FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text)
), escaped AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\e'), '##', '#\c#'), '##', '#\c#'), '</turn>', '<\c/turn>'), '>: ', '>\c: ') AS body,
    replace(replace(replace(replace(replace(coalesce(role, ''), '\', '\e'), '##', '#\c#'), '##', '#\c#'), '</turn>', '<\c/turn>'), '>: ', '>\c: ') AS name
  FROM placed
), formed AS (
  SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### Role <' || name || '>: ' END || body || ' </turn>' || chr(10) AS turn_text,
    coalesce(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' END, false)
      AND (n < of OR coalesce(role = 'assistant', false)) AS accepted
  FROM escaped
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(turn_text)) AS BIGINT) AS formatted_chars, bool_and(accepted) AS valid
FROM formed GROUP BY conv_id
"""
