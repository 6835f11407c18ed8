"""Chat formatting by event-sourced reconstruction.

A log of events tells how each message of a conversation came about: streamed
deltas append, an edit replaces, a regeneration starts the message anew. The
log is partitioned by conversation and message, sorted by sequence number and
folded into final messages, which are rendered with a template that marks
turns and can be read back exactly.

Folding and rendering work on single messages, so a conversation of any length
is spread over tasks. Only reading back needs its turns in order; that is a
pass over sorted rows which holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"

# the template: "### role:\n" text "\n</turn>\n"; inside role and text, the
# characters that could begin a control string are preceded by a backslash
OPEN, NAMED, CLOSE = "### ", ":\n", "\n</turn>\n"
_ESCAPE = re.compile(r"\\(.)", re.S)
CHUNK = 1 << 20  # characters of a text taken at a time


def escaped(text: Column) -> Column:
    """Backslash, ``#``, ``<`` and ``:`` preceded by a backslash."""
    return F.regexp_replace(text, r"([\\#<:])", r"\\$1")


def fold_messages(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``events(conv_id, message, seq, kind, role, text)`` → one row per
    message: conv_id, message, place, role, text.

    ``seq`` orders the events of a conversation; ``message`` names the message
    that an event belongs to and has no order of its own: ``place``, the first
    ``seq`` of a message, is its place in the conversation. Events are folded by
    ``seq`` (ties: by kind, then text): a delta appends its text, an edit
    replaces the text, a regeneration empties it for the deltas that follow.
    The role is that of the first event that has one, else empty. Null text
    counts as empty; unknown or null kinds count as deltas; an empty log gives
    an empty result. Only the events of one message meet in one place."""
    key = key or ["conv_id", "message"]
    kind = F.when(F.col("kind").isin(EDIT, REGENERATE), F.col("kind")).otherwise(F.lit(DELTA))
    log = events.select(*key, "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    entry = F.struct("seq", "kind", "text", "role")
    reset = F.when(F.col("kind") != DELTA, F.struct("seq", "kind", "text"))
    # the last event that discards what came before it; nothing earlier is gathered
    own = Window.partitionBy(*key)
    log = log.withColumn("last", F.max(reset).over(own)).withColumn("place", F.min("seq").over(own)).filter(
        F.col("last").isNull() | (F.struct("seq", "kind", "text") >= F.col("last")) | F.col("role").isNotNull()
    )
    counts = F.col("last").isNull() | (F.struct("seq", "kind", "text") >= F.col("last"))
    shown = F.when(counts & (F.col("kind") != REGENERATE), F.col("text")).otherwise(F.lit(""))
    log = log.withColumn("text", shown)
    folded = log.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("log"), F.min("place").alias("place"))
    roles = F.filter(F.col("log.role"), lambda r: r.isNotNull())
    return folded.select(
        *key, "place", F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), F.array_join("log.text", "").alias("text")
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``messages`` with ``formatted`` (the marked turn), ``mask_start`` and
    ``mask_length``, the span of ``formatted`` that the loss counts: the
    escaped text of ``trained_role``, nothing for other roles. Role and text are
    not null after :func:`fold_messages`; where they are, ``formatted`` is null.
    Repeated rows each come out, and an empty table gives an empty result."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(NAMED))
    body = escaped(F.col("text"))
    out = messages.withColumn("formatted", F.concat(head, body, F.lit(CLOSE)))
    trained = F.col("role") == trained_role
    return out.withColumns({
        "mask_start": F.length(head).cast("long"),
        "mask_length": F.when(trained, F.length(body)).otherwise(F.lit(0)).cast("long"),
    })


def _even_end(text: str, a: int, z: int) -> bool:
    """Is what stands before ``z`` (from ``a`` on) no open escape?"""
    k = z
    while k > a and text[k - 1] == "\\":
        k -= 1
    return (z - k) % 2 == 0


def turn_spans(formatted: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end) of role and text, both still escaped, of each turn. A scan
    for the next mark: an escaped role holds no bare ``:`` and an escaped text
    no bare ``<``, so the first one ends it."""
    at = 0
    while at < len(formatted):
        head = at + len(OPEN)
        role = formatted.find(NAMED, head) if formatted.startswith(OPEN, at) else -1
        while role >= 0 and not _even_end(formatted, head, role):
            role = formatted.find(NAMED, role + 1)
        text = role + len(NAMED)
        end = formatted.find(CLOSE, text) if role >= 0 else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        yield head, role, text, end
        at = end + len(CLOSE)


def unescaped(text: str, a: int, z: int) -> Iterator[str]:
    """``text[a:z]`` without its escapes, some characters at a time."""
    while a < z:
        end = min(z, a + CHUNK)
        if end < z and not _even_end(text, a, end):
            end += 1  # an escape stays whole
        part = text[a:end]
        yield _ESCAPE.sub(r"\1", part) if "\\" in part else part
        a = end


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [("".join(unescaped(formatted, a, b)), "".join(unescaped(formatted, c, d))) for a, b, c, d in turn_spans(formatted)]


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def conversation_digests(rendered: DataFrame, order: list[str]) -> DataFrame:
    """Digests of each conversation, read back from its formatted turns in the
    order of the columns ``order``. Rows are sorted by conversation within
    partitions and passed once; running digests and one turn, never whole
    conversations, are held, and a turn of any length is read a million
    characters at a time. Turns of no conversation (null) are one of their own;
    ties in ``order`` come in any order; repeated rows are turns of their own; an
    empty table gives an empty result."""
    ship_package(rendered.sparkSession)
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, begun = None, False
        turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for b in batches:
            rows = []
            for c, formatted, start, length in zip(
                b["conv_id"].tolist(), b["formatted"], b["mask_start"].tolist(), b["mask_length"].tolist()
            ):
                c = None if c is None or c != c else int(c)
                if begun and c != conv:
                    rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                conv, begun = c, True
                for spans in turn_spans(formatted):
                    for k in (0, 2):  # role, then text
                        for part in unescaped(formatted, *spans[k : k + 2]):
                            turns.update(part.encode("utf-8", "surrogatepass"))
                        turns.update(b"\n")
                    n += 1
                for part in unescaped(formatted, start, start + length):
                    loss.update(part.encode("utf-8", "surrogatepass"))
                    chars += len(part)
                total += len(formatted)
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        if begun:
            last = [(conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)]
            yield pd.DataFrame(last, columns=names).astype({"conv_id": "Int64"})

    rows = rendered.select("conv_id", *order, "formatted", "mask_start", "mask_length")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return rows.select("conv_id", "formatted", "mask_start", "mask_length").mapInPandas(digest, DIGESTS)


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A log for a table of final turns (conv_id, turn, role, text), numbered by
    conversation: each turn comes about by a first draft that is regenerated,
    the first half of its text, a slip that an edit takes back, and the second
    half. Turns that share a number are messages of their own, ordered by role,
    then text; a message's name says nothing of its place."""
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", tie)
    first = F.expr("left(text, cast(length(text) div 2 as int))")
    second = F.expr("substring(text, cast(length(text) div 2 as int) + 1)")
    steps = [
        (DELTA, F.lit("draft </turn> ")), (REGENERATE, F.lit(None).cast("string")), (DELTA, first),
        (DELTA, F.lit("slip")), (EDIT, first), (DELTA, second),
    ]
    log = F.array(*[
        F.struct(F.struct("turn", "tie", F.lit(i).alias("step")).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
        for i, (kind, text) in enumerate(steps)
    ])
    name = F.xxhash64(F.lit("message"), "conv_id", "turn", "tie")
    return t.select("conv_id", name.alias("message"), "role", F.explode(log).alias("e")).select(
        "conv_id", "message", "e.seq", "e.kind", "role", "e.text"
    )
