"""Chat formatting with a grammar round trip.

Grammar of the output (control strings in quotes; text never holds one, as escaping breaks each apart):

    conversation := turn*
    turn         := "<|turn|>" role "<|text|>" text "<|end|>"                 any role but user and assistant, null too
                  | "<s>[INST] " text " [/INST]"                              user
                  | " " text " </s>"                                          assistant

Escaping puts a zero-width backslash-like mark behind the first character of a control string: a mark of its own,
MARK, which is doubled where the text has it. Rendered text is parsed again by a deterministic left-to-right parser; if
the turns that it finds differ from the source, the text is escaped further, from nothing, to control strings,
to all control characters, until they are identical. The last level always is.

Long conversations are rendered in segments of whole turns, so that no row holds a conversation of any length, and
segments are parsed in order, by a parser that keeps nothing but its state.

Turns are in order of turn, role, text. Null texts count as empty; a null role is an empty role. A null conversation id is a
conversation of its own. Rows that repeat are turns of their own. An empty table gives no rows. Extra columns, whatever their names, are ignored.
A conversation's turns are in one task, as its digests need them in order; they stream through it.
One very long text is a segment of its own, rendered and parsed whole: a row and its escaped form must fit in a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_of

MARK = "\u001a"
OPEN_USER, CLOSE_USER, CLOSE_ASSISTANT = "<s>[INST] ", " [/INST]", " </s>"
OPEN_OTHER, MIDDLE_OTHER, CLOSE_OTHER = "<|turn|>", "<|text|>", "<|end|>"
#: What a text must not hold as it is: the controls, without the blanks that may meet a text's own.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", OPEN_OTHER, MIDDLE_OTHER, CLOSE_OTHER)
LEVELS = (0, 1, 2)
SEGMENT_CHARS = 1 << 20


def escape(text: str, level: int) -> str:
    """0: only marks are doubled; 1: a mark also breaks each control string; 2: it follows each < and [."""
    text = text.replace(MARK, MARK * 2)
    if level == 1:
        for control in CONTROLS:
            text = text.replace(control, control[0] + MARK + "." + control[1:])
    elif level == 2:
        text = text.replace("<", "<" + MARK + ".").replace("[", "[" + MARK + ".")
    return text


def unescape(text: str) -> str:
    """Left to right: a mark and a full stop stand for nothing, two marks for one."""
    if MARK not in text:
        return text
    head, *rest = text.split(MARK)
    out, k = [head], 0
    while k < len(rest):
        if rest[k].startswith("."):
            out.append(rest[k][1:])
            k += 1
        else:  # an empty piece stands between two marks
            if rest[k] or k + 1 == len(rest):
                raise ValueError("a mark stands alone")
            out.append(MARK + rest[k + 1])
            k += 2
    return "".join(out)


def render_turn(role: str, text: str, level: int) -> str:
    body = escape(text, level)
    if role == "user":
        return OPEN_USER + body + CLOSE_USER
    if role == "assistant":
        return " " + body + CLOSE_ASSISTANT
    return OPEN_OTHER + escape(role, level) + MIDDLE_OTHER + body + CLOSE_OTHER


def _take(rendered: str, at: int, close: str) -> tuple[str, int, int]:
    """The text up to the next control, which must be the one in close; where it ends and where parsing goes on.

    The control is sought without its blank, which belongs to the template.
    """
    end = rendered.find(close.lstrip(" "), at)
    stop = end - (close[0] == " ")
    if end < 0 or stop < at or rendered[stop : end + len(close.lstrip(" "))] != close:
        raise ValueError(f"no {close!r} after {at}")
    body = rendered[at:stop]
    if any(c in body for c in CONTROLS):
        raise ValueError(f"a control string inside a text at {at}")
    return body, stop, stop + len(close)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """role, text (unescaped), and the span of the text in rendered, for each turn; ValueError if it isn't of the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if rendered.startswith(OPEN_USER, at):
            role, start, close = "user", at + len(OPEN_USER), CLOSE_USER
        elif rendered.startswith(" ", at):
            role, start, close = "assistant", at + 1, CLOSE_ASSISTANT
        elif rendered.startswith(OPEN_OTHER, at):
            role, _, start = _take(rendered, at + len(OPEN_OTHER), MIDDLE_OTHER)
            role, close = unescape(role), CLOSE_OTHER
        else:
            raise ValueError(f"no turn opens at {at}")
        body, end, at = _take(rendered, start, close)
        turns.append((role, unescape(body), start, end))
    return turns


def render_checked(role: str, text: str) -> str:
    """The rendered turn at the lowest level of escaping at which parsing gives the turn back."""
    for level in LEVELS:
        rendered = render_turn(role, text, level)
        try:
            if [(r, t) for r, t, _, _ in parse(rendered)] == [(role, text)]:
                return rendered
        except ValueError:
            pass
    raise ValueError("the highest level of escaping doesn't give the turn back")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segment (from 0), formatted, loss_starts, loss_ends: rendered conversations with the spans of assistant texts.

    Rows of a conversation follow one another in order of segment within their partition.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text_of(text_col).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, segment, pieces, starts, ends, length = None, 0, [], [], [], 0

        def flush() -> dict:
            return {"conv_id": conv[0], "segment": segment, "formatted": "".join(pieces), "loss_starts": starts, "loss_ends": ends}

        for batch in batches:
            out = []
            for c, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                c = (None if pd.isna(c) else int(c),)
                if pieces and (c != conv or length >= SEGMENT_CHARS):
                    out.append(flush())
                    segment, pieces, starts, ends, length = segment + 1 if c == conv else 0, [], [], [], 0
                conv, piece = c, render_checked(role, text)
                if role == "assistant":
                    starts.append(length + 1)
                    ends.append(length + len(piece) - len(CLOSE_ASSISTANT))
                pieces.append(piece)
                length += len(piece)
            yield _frame(out)
        if pieces:
            yield _frame([flush()])

    return ordered.mapInPandas(render, "conv_id long, segment long, formatted string, loss_starts array<long>, loss_ends array<long>")


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "segment", "formatted", "loss_starts", "loss_ends"])
    return out.astype({"conv_id": "Int64"})


def summaries(segments: DataFrame) -> DataFrame:
    """The contract's columns, from nothing but formatted text and its loss spans, in the order in which formatted() gives them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None

        def done() -> list:
            return [conv[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            out = []
            for c, segment, rendered, starts, ends in batch.itertuples(index=False):
                c = (None if pd.isna(c) else int(c),)
                if segment == 0:
                    if conv is not None:
                        out.append(done())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, ends, strict=True):
                    text = unescape(rendered[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            yield _summary(out)
        if conv is not None:
            yield _summary([done()])

    return segments.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _summary(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def read_back(segments: DataFrame) -> DataFrame:
    """Stored segments, a conversation's together and in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    output = stored(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)), "formatted")
    return summaries(read_back(output))


_CONTROLS_SQL = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROLS)

#: formatted_chars: the template's own characters, two for each broken control string, one for each doubled mark.
OP10_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + 2 * ({_CONTROLS_SQL}) + length(text) - length(replace(text, chr(26), '')) AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + CASE role WHEN 'user' THEN {len(OPEN_USER) + len(CLOSE_USER)} WHEN 'assistant' THEN {1 + len(CLOSE_ASSISTANT)}
                ELSE {len(OPEN_OTHER) + len(MIDDLE_OTHER) + len(CLOSE_OTHER)} + length(role) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
