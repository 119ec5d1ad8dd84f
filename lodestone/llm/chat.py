"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence; one pass over each partition folds
streamed deltas, edits, deletions and regenerations into final messages and renders them. State in memory is
one conversation, which the rendered string needs anyway.

Events: conv_id, seq, kind, msg, role, text.
  message     starts message msg with a role and a first text (or restarts it); without msg, one that no later event names
  delta       appends text to msg
  edit        replaces the text of msg
  regenerate  empties msg and forgets all messages that began after it
  delete      forgets msg
Deltas and edits of an unknown msg start it with the event's role.

Template of a turn: "### ROLE: TEXT </turn>\\n". Inside roles and texts a backslash goes before every
backslash, '#' and '<', in roles also before ':' and line feed, so no text can look like a marker, and removing the
backslashes gives the text back. The loss mask holds the (escaped) text spans of assistant turns.

Defined cases: null text or role counts as empty; null conv_id is a conversation of its own; events equal in seq are ordered by
msg, kind, role and text; an event of another kind, or with none, changes nothing, but its conversation has a row; repeated events count each; very long texts are
kept whole; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, table

TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*) </turn>\n", re.S)
EVENT = "conv_id long, seq long, kind string, msg long, role string, text string"
OUT = "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"[\\#<:\n]" if role else r"[\\#<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Conversation:
    """The fold's state: messages in order of their start."""

    def __init__(self) -> None:
        self.messages: dict[object, tuple[str, list[str]]] = {}

    def apply(self, kind: str, msg: object, role: str, text: str) -> None:
        if kind == "message":
            self.messages[msg if msg else object()] = (role, [text])
        elif kind == "delta":
            self.messages.setdefault(msg, (role, []))[1].append(text)
        elif kind == "edit":
            self.messages[msg] = (self.messages.get(msg, (role,))[0], [text])
        elif kind == "delete":
            self.messages.pop(msg, None)
        elif kind == "regenerate" and msg in self.messages:
            order = list(self.messages)
            for later in order[order.index(msg) + 1 :]:
                del self.messages[later]
            self.messages[msg] = (self.messages[msg][0], [])

    def render(self) -> tuple[str, list[int], list[int]]:
        out, at, starts, ends = [], 0, [], []
        for role, parts in self.messages.values():
            head, text = f"### {escape(role, True)}: ", escape("".join(parts))
            if role == "assistant":
                starts.append(at + len(head))
                ends.append(at + len(head) + len(text))
            out += [head, text, " </turn>\n"]
            at += len(head) + len(text) + 9
        return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, state, rows, size = None, None, [], 0
    for batch in batches:
        for conv, kind, msg, role, text in zip(*(batch[c].tolist() for c in ("conv", "kind", "msg", "role", "text")), strict=True):
            if state is None or conv != current:
                if state is not None:
                    rows.append((current, *state.render()))
                    size += len(rows[-1][1])
                current, state = conv, Conversation()
            state.apply(kind, msg, role, text)
            if size > 4_000_000:
                yield _frame(rows)
                rows, size = [], 0
    if state is not None:
        rows.append((current, *state.render()))
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv", "formatted", "loss_starts", "loss_ends"])
    out["conv_id"] = pd.array([int(c) if c else None for c in out["conv"]], dtype="Int64")
    return out[["conv_id", "formatted", "loss_starts", "loss_ends"]]


def format_chats(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and the loss mask as loss_starts, loss_ends (code points)."""
    small_batches(events.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = events.select(
        text("conv_id").alias("conv"), F.col("seq").cast("long").alias("seq"), text("kind").alias("kind"),
        text("msg").alias("msg"), text("role").alias("role"), text("text").alias("text"),
    )
    order = ["conv", "seq", F.length("msg"), "msg", "kind", "role", "text"]
    return rows.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "msg", "role", "text").mapInPandas(_fold, OUT)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The conversations table as a log: each row, a repeated one too, starts a message of its own."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("msg"), "role", "text"
    )


def _digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Everything here is read back from the formatted string and its mask."""
    for batch in batches:
        rows = []
        for formatted, starts, ends in zip(batch["formatted"], batch["loss_starts"], batch["loss_ends"], strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out.insert(0, "conv_id", batch["conv_id"].astype("Int64").array)
        yield out


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = format_chats(conversation_events(rows))
    return chats.mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '[\\#<:\n]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
