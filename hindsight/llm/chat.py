r"""Chat logs to training text: event-sourced reconstruction, rendering, and the way back.

A log holds events (conv_id, slot, seq, kind, role, text). It is partitioned by conversation and sorted
by (slot, seq); one pass folds the events of each message and writes it when the next begins, so a task
holds one message, never a conversation:

  message     opens a message with its role and text (two in one slot are two messages)
  delta       appends text
  edit        replaces the text
  regenerate  discards the slot's text, from where deltas build the new one, and drops events of later
              slots with a smaller seq (what followed the discarded answer)

Every message is rendered by a template that marks turns: `[INST] text [/INST]` for users, `<s>text</s>`
for assistants, `[ROLE name] text [/ROLE]` for others. Control strings inside texts are escaped by a
backslash after their first character, and backslashes are doubled, so that the texts come back whole.
The loss mask is the span of the escaped assistant text in each piece.

Defined cases: a null text is empty, a null role is the empty role, a null conv_id is a conversation of
its own; events of a slot without a message (say a late delta) open one; an unknown kind raises, wherever
it stands; ties in (slot, seq) are ordered by kind (message, edit, regenerate, delta), then role and text;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, partitions, stored

CONTROL = re.compile(r"\\|\[/?INST\]|</?s>|\[ROLE |\[/ROLE\]")
TURN = re.compile(r"\[INST\] (?P<user>.*) \[/INST\]|<s>(?P<assistant>.*)</s>|\[ROLE (?P<role>(?:[^\\\]]|\\.)*)\] (?P<text>.*) \[/ROLE\]", re.DOTALL)
KINDS = ("message", "edit", "regenerate", "delta")
MESSAGE = "conv_id long, slot long, nth long, role string, text string"
PIECE = "conv_id long, slot long, nth long, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of one turn and its loss span (empty for other roles than assistant)."""
    body = escape(text)
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    return f"[ROLE {escape(role).replace(']', '\\]')}] {body} [/ROLE]", 0, 0


def parse(piece: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    m = TURN.fullmatch(piece)
    if m is None:
        raise ValueError("not a rendered turn")
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["assistant"] is not None:
        return "assistant", unescape(m["assistant"])
    return unescape(m["role"]), unescape(m["text"])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in zip(names, kinds, strict=True)])
    for held in itertools.batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Final messages (conv_id, slot, nth, role, text) from events sorted by conversation, slot and seq."""
    key, open_, nth, cut, later = None, None, 0, None, None
    for conv, slot, seq, kind, role, text in _rows(batches, "conv_id", "slot", "seq", "kind", "role", "text"):
        if key is None or (conv, slot) != key:
            if open_:
                yield (*key, nth, open_[0], "".join(open_[1]))
            if key is None or conv != key[0]:
                cut = later = None
            cut = later if cut is None or (later is not None and later > cut) else cut
            key, open_, nth = (conv, slot), None, 0
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind}")
        if cut is not None and (seq is None or seq < cut):
            continue
        text, role = text or "", role or ""
        if kind == "message":
            if open_:
                yield (*key, nth, open_[0], "".join(open_[1]))
                nth += 1
            open_ = [role, [text]]
            continue
        if open_ is None:
            open_ = [role or "assistant", []]
        if kind == "delta":
            open_[1].append(text)
        elif kind == "edit":
            open_[1] = [text]
        else:
            open_[1] = [text] if text else []
            later = seq if later is None or seq > later else later
    if open_:
        yield (*key, nth, open_[0], "".join(open_[1]))


def reconstruct(events: DataFrame) -> DataFrame:
    """The final messages of every conversation of an event log."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("slot").cast("long").alias("slot"), F.col("seq").cast("long").alias("seq"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"))
    e = e.repartition(partitions(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", "slot", "seq", "rank", "role", "text")
    return e.mapInArrow(lambda batches: _batches(folded(batches), MESSAGE), MESSAGE)


def formatted(messages: DataFrame) -> DataFrame:
    """A rendered piece with its loss span for every message; a conversation's text is its pieces in order."""

    def rows(batches):
        for conv, slot, nth, role, text in _rows(batches, "conv_id", "slot", "nth", "role", "text"):
            yield (conv, slot, nth, *render(role, text))

    return messages.mapInArrow(lambda batches: _batches(rows(batches), PIECE), PIECE)


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation from its pieces, read in order with constant memory."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def turns(batches):
        for conv, slot, nth, piece, a, b in _rows(batches, "conv_id", "slot", "nth", "formatted", "loss_start", "loss_end"):
            role, text = parse(piece)
            yield conv, slot, nth, role, text, unescape(piece[a:b]), len(piece)

    seen = "conv_id long, slot long, nth long, role string, text string, loss string, chars long"

    def rows(batches):
        now, first = None, True
        for conv, role, text, loss, chars in _rows(batches, "conv_id", "role", "text", "loss", "chars"):
            if first or conv != now:
                if not first:
                    yield now, n, all_.hexdigest(), loss_n, lossy.hexdigest(), size
                now, first, n, loss_n, size, all_, lossy = conv, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            n, loss_n, size = n + 1, loss_n + len(loss), size + chars
            all_.update(f"{role}\n{text}\n".encode())
            lossy.update(loss.encode())
        if not first:
            yield now, n, all_.hexdigest(), loss_n, lossy.hexdigest(), size

    parsed = pieces.mapInArrow(lambda batches: _batches(turns(batches), seen), seen)
    parsed = parsed.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "slot", "nth")
    return parsed.mapInArrow(lambda batches: _batches(rows(batches), out), out)


def logged(rows: DataFrame) -> DataFrame:
    """The log of a chat service that ends in the messages of rows(conv_id, turn, role, text).

    A message's events are numbered from 16 times its turn's rank in the conversation on. By a hash of
    conversation and turn it is written at once, streamed in three deltas, written as a draft and edited, or
    answered twice: a draft, a user's turn after it, a regeneration and its deltas. Turns that repeat, are
    null or can't have a turn after them are written at once, as are rows without a conversation.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rank = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), rank.alias("rank"), F.count("*").over(Window.partitionBy("conv_id", "turn")).alias("n"))
    way = F.when((F.col("n") == 1) & (F.col("turn") < 2**63 - 1) & F.col("conv_id").isNotNull(), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))).otherwise(0)
    rows = rows.select("conv_id", F.col("turn").alias("slot"), (F.col("rank") * 16).alias("seq"), "role", "text", way.alias("way"))
    third = F.ceil(F.char_length("text") / 3).cast("int")
    part = lambda i: F.substring("text", third * i + 1, third)
    event = lambda at, kind, text, later=0, role="role": F.struct(F.lit(later).alias("later"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), (F.col("role") if role == "role" else F.lit(role)).alias("role"), text.alias("text"))
    draft, none = F.lit("a draft of </s> something"), F.lit(None).cast("string")
    streamed = lambda first: [event(first + i, "delta", part(i)) for i in range(3)]
    ways = [
        [event(0, "message", F.col("text"))],
        [event(0, "message", none), *streamed(1)],
        [event(0, "message", draft), event(1, "edit", F.col("text"))],
        [event(0, "message", draft), event(1, "delta", draft), event(2, "message", draft, 1, "user"), event(3, "regenerate", none), *streamed(4)],
    ]
    events = F.explode(F.when(F.col("way") == 1, F.array(*ways[1])).when(F.col("way") == 2, F.array(*ways[2])).when(F.col("way") == 3, F.array(*ways[3])).otherwise(F.array(*ways[0])))
    rows = rows.select("conv_id", "slot", "seq", events.alias("e"))
    return rows.select("conv_id", (F.col("slot") + F.col("e.later")).alias("slot"), (F.col("seq") + F.col("e.at")).alias("seq"), "e.kind", "e.role", "e.text")


def op2_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, logged as events, folded, rendered and read back."""
    tricky = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return digests(stored(formatted(reconstruct(logged(rows))), new_dir(spark, "chat")))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '([\[<])(/?INST\]|/?s>|ROLE |/ROLE\])', '\1\\\2', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(escaped) + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 15 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
