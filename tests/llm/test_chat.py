import hashlib

from lexiloom.llm import chat

LONG = "conv_id long, turn long, role string, text string"
NASTY = ["", "\\", "### x: ", "</turn>", "\\</turn>\n### assistant: ", "#####", "a\\#\\", "####</turn></turn>", None, "x" * 3000, "é😀###" * 200]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        told = "".join(f"{role}\n{text}\n" for _, role, text in own)
        learned = "".join(text for _, role, text in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_round_trip_of_control_strings(spark):
    rows = [(c, i, role, text) for c in (1, 2, None) for i, (role, text) in enumerate(zip(["user", "assistant", "a:b\\", None] * 3, NASTY))]
    rows += [(1, 0, "user", "")] * 2 + [(5, None, "assistant", "late")]
    rendered = chat.render_messages(chat.fold_events(chat.turns_to_events(spark.createDataFrame(rows, LONG).withColumnRenamed("x", "y"))))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_conversations(rendered).collect()}
    assert got == brute(rows)


def test_fold_edits_and_regenerations(spark):
    log = [(1, 1, "open", 1, "user", ""), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "llo"), (1, 4, "open", 2, "assistant", ""), (1, 5, "delta", 2, None, "bad"), (1, 6, "open", 3, "user", "again"), (1, 7, "regenerate", 2, None, ""), (1, 8, "delta", 2, None, "good"), (1, 9, "open", 4, "user", "thanks"), (1, 10, "edit", 1, None, "hi"), (1, 11, "delta", 1, None, "!"), (2, 1, "delta", 9, None, "lost")]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")).orderBy("conv_id", "msg").collect()
    assert [tuple(r) for r in got] == [(1, 1, "user", "hi!"), (1, 2, "assistant", "good"), (1, 4, "user", "thanks")]


def test_empty(spark):
    empty = spark.createDataFrame([], LONG)
    assert chat.read_conversations(chat.render_messages(chat.fold_events(chat.turns_to_events(empty)))).count() == 0
