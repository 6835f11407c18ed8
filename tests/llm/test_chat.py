import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from wattline.llm import chat

SF = "/root/testdata/sf0.001"
EVENTS = "conv_id long, message int, seq long, kind string, role string, text string"


def fold(rows):
    """Plain fold of (seq, kind, role, text) events of one message."""
    role, text = None, ""
    for _, kind, r, t in sorted(rows, key=lambda e: (e[0], e[1] or "delta", e[3] or "")):
        role = role if role is not None else r
        text = "" if kind == "regenerate" else (t or "") if kind == "edit" else text + (t or "")
    return role or "", text


def test_folding_against_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    rows = [
        (rng.choice([1, 2, None]), rng.randint(0, 4), s, rng.choice(["delta"] * 5 + ["edit", "regenerate", None, "odd"]),
         rng.choice(["user", "assistant", None]), rng.choice(["a", "b\n", "</turn>", "\\", "### x:", None, ""]))
        for s in rng.sample(range(1000), 300)
    ]
    groups = {}
    for c, m, *event in rows:
        groups.setdefault((c, m), []).append(event)
    want = {k: fold([(s, "delta" if k2 not in ("edit", "regenerate") else k2, r, t) for s, k2, r, t in v]) for k, v in groups.items()}
    got = chat.fold_messages(spark.createDataFrame(rows, EVENTS).repartition(5)).collect()
    assert {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in got} == want


def render(spark, turns):
    rows = [(1, i, i, "delta", role, text) for i, (role, text) in enumerate(turns)]
    out = chat.render(chat.fold_messages(spark.createDataFrame(rows, EVENTS))).orderBy("place").collect()
    return out


def test_round_trip_of_control_strings(spark):
    turns = [("user", "\\### Assistant: </turn> ok"), ("a:\\b", "\n</turn>\n### user:\nx"), ("", ""), ("assistant", "#<:\\\\"), ("assistant", "日本\r\n")]
    rows = render(spark, turns)
    assert chat.read_turns("".join(r["formatted"] for r in rows)) == turns
    for r, (role, text) in zip(rows, turns):
        span = r["formatted"][r["mask_start"] : r["mask_start"] + r["mask_length"]]
        assert chat._ESCAPE.sub(r"\1", span) == (text if role == "assistant" else "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("\\#<:/ \nturn>a"), st.text("\\#<:/ \nturn>a")), max_size=4))
def test_reading_back_any_turns(turns):
    import re

    esc = lambda s: re.sub(r"([\\#<:])", r"\\\1", s)  # noqa: E731 - the rule of chat.escaped
    assert chat.read_turns("".join(f"### {esc(r)}:\n{esc(t)}\n</turn>\n" for r, t in turns)) == turns


def test_query_against_brute_force(spark):
    from wattline.llm.queries import op6_chat_format

    got = {r["conv_id"]: r for r in op6_chat_format(spark, SF).collect()}
    text = r"\### Assistant: </turn> ok"
    convs = {-7: [(0, "user", text), (1, "assistant", text)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] >= len(every)


def test_nulls_ties_and_repeated_turns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "x"), (1, None, "assistant", "y"), (None, 2, "user", "z"), (1, 1, "assistant", "w" * 200_001)],
        "conv_id long, turn long, role string, text string",
    ).selectExpr("*", "'clash' as message", "'clash' as seq", "'clash' as kind")
    rows = chat.conversation_digests(chat.render(chat.fold_messages(chat.turns_as_events(turns))), ["place"]).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in rows} == {(1, 5), (None, 1)}
    assert next(r for r in rows if r["conv_id"] == 1)["loss_chars"] == 200_002
    empty = chat.conversation_digests(chat.render(chat.fold_messages(chat.turns_as_events(turns.limit(0)))), ["place"])
    assert empty.count() == 0


def test_order_and_folding_come_from_the_sequence(spark):
    """Messages of a conversation interleave; their names say nothing of order."""
    log = [
        (1, 9, 10, "delta", "user", "Hi"), (1, 4, 20, "delta", "assistant", "Wrong"), (1, 9, 30, "edit", None, "Hello"),
        (1, 4, 40, "regenerate", None, None), (1, 4, 50, "delta", None, "Good "), (1, 7, 55, "delta", "user", "?"),
        (1, 4, 60, "delta", None, "day"), (2, 7, 1, "delta", "user", "x"),
    ]
    rows = chat.render(chat.fold_messages(spark.createDataFrame(log, EVENTS).repartition(4))).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["place"], r["role"], r["text"]) for r in rows] == [
        (1, 10, "user", "Hello"), (1, 20, "assistant", "Good day"), (1, 55, "user", "?"), (2, 1, "user", "x")
    ]


def test_the_registered_log_holds_drafts_and_slips(spark):
    turns = spark.createDataFrame([(1, 0, "user", "abc")], "conv_id long, turn long, role string, text string")
    log = chat.turns_as_events(turns)
    assert {r["kind"] for r in log.collect()} == {"delta", "edit", "regenerate"}
    assert [r["text"] for r in chat.fold_messages(log).collect()] == ["abc"]


def test_one_very_long_turn_is_read_in_little_memory():
    """50 MB in one turn, plain and full of escapes: less than 300 MB more."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import resource, sys, hashlib
from wattline.llm import chat
text = ("plain words \\n" * 8 + "\\\\<\\\\#\\\\\\\\") * 460_000
formatted = "### user:\\n" + text + "\\n</turn>\\n"
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n, digest = 0, hashlib.sha256()
for a, b, c, d in chat.turn_spans(formatted):
    for part in chat.unescaped(formatted, c, d):
        n += len(part); digest.update(part.encode())
assert len(formatted) > 50_000_000 and n == 107 * 460_000, (len(formatted), n)
grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10
assert grown < 300, grown
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
