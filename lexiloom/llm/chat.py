"""Operator 10: chat formatting from an event log.

A log row is ``conv_id, seq, kind, msg, role, text``: ``open`` starts message ``msg`` with a role, ``delta`` appends
streamed text to it, ``edit`` replaces its text, and ``regenerate`` empties it and drops all later messages of the
conversation that were opened before. ``fold_events`` reconstructs the final messages with windows over the conversation in
sequence order; ``render_messages`` formats them.

The template writes ``### role: text</turn>`` and a line break for each message. Inside roles and texts a backslash is put
before every backslash, before each ``#`` of ``###`` and before ``</turn>`` (and before colons in roles),
so that no text can imitate a mark and every text can be read back. The loss mask of a message spans an assistant's
escaped text, in code points.

A message may be opened again, after a regeneration dropped it or before: its last opening counts. Deltas for a message that was never opened are dropped. Rows of equal
``conv_id, turn`` are all kept, ordered by role and text. A null ``conv_id`` is a conversation of its own. Empty tables
give no row (the query adds conversation -7). Numbering and folding split long conversations by blocks of messages; only the last reading is a
stream over whole conversations, one message at a time, because its digests are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, texts_of

#: Code points of a streamed delta that the query cuts a stored turn into.
DELTA_CHARS = 400
#: Messages of a conversation that are numbered or folded in one task.
BLOCK = 10_000
PROBE_TEXT = "\\### Assistant: </turn> ok"
_HEADER = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_END = re.compile(r"\\.|</turn>\n", re.S)


def _before(rows: DataFrame, value: Column, what, order: list, bucket: str, name: str, frame) -> DataFrame:
    """Add ``what(value)`` over the earlier rows of the conversation: within buckets, and over the buckets before. ``bucket`` grows with ``order``."""
    by = [F.col("conv_id"), F.col(bucket)]
    ahead = rows.groupBy(*by).agg(what(value).alias("_v"))
    ahead = ahead.select(F.col("conv_id").alias("_c"), F.col(bucket).alias("_b"), what("_v").over(Window.partitionBy("conv_id").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
    inside = rows.withColumn("_inside", what(value).over(frame(Window.partitionBy(*by).orderBy(*order))))
    joined = inside.join(ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col(bucket).eqNullSafe(F.col("_b")))
    both = F.coalesce("_inside", F.lit(0)) + F.coalesce("_ahead", F.lit(0)) if what is F.sum else F.greatest("_inside", "_ahead")
    return joined.withColumn(name, both).drop("_inside", "_ahead", "_c", "_b")


def number_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, msg, role, text``: turns numbered from 1 within their conversation, nulls first, ties by role and text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / BLOCK).alias("_block"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    return _before(rows, F.lit(1), F.sum, [F.col("turn").asc_nulls_first(), "role", "text"], "_block", "msg", upto).select("conv_id", F.col("msg").cast("long").alias("msg"), "role", "text")


def streamed(messages: DataFrame, phase: int, first: Column, text: Column) -> DataFrame:
    """The log of messages that are begun by a ``first`` row (its kind) and streamed as deltas of ``text``."""
    cuts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / DELTA_CHARS).cast("int"))
    deltas = F.when(F.length(text) > 0, F.transform(cuts, lambda i: text.substr(i * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))).otherwise(F.array().cast("array<string>"))
    parts = messages.select("conv_id", "msg", "role", first.alias("first"), F.posexplode(F.concat(F.array(F.lit("")), deltas)).alias("part", "text"))
    begins = F.col("part") == 0
    return parts.select("conv_id", F.struct(F.lit(phase).alias("phase"), "msg", "part").alias("seq"), F.when(begins, F.col("first")).otherwise("delta").alias("kind"), "msg", F.when(begins, F.col("role")).alias("role"), "text")


def turns_to_events(turns: DataFrame) -> DataFrame:
    """A log that ends in ``conv_id, turn, role, text``: turns are opened and streamed; a third of them as a draft, reversed, that is then edited; and half of the
    conversations are regenerated from their second message on, which is streamed again and whose successors are opened again."""
    messages = materialise(number_turns(turns), "turns")  # numbered once for all parts of the log
    drafted = F.pmod(F.xxhash64("conv_id", "msg"), F.lit(3)) == 1
    once = streamed(messages, 0, F.lit("open"), F.when(drafted, F.reverse("text")).otherwise(F.col("text")))
    edits = messages.filter(drafted).select("conv_id", F.struct(F.lit(0).alias("phase"), "msg", F.lit(2**31 - 1).alias("part")).alias("seq"), F.lit("edit").alias("kind"), "msg", F.lit(None).cast("string").alias("role"), "text")
    again = messages.filter((F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 1) & (F.col("msg") > 1))
    return once.unionByName(edits).unionByName(streamed(again, 1, F.when(F.col("msg") == 2, "regenerate").otherwise("open"), F.col("text")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, msg, role, text``.

    What decides is found on one light row for each message; texts are shuffled once, by message.
    """
    kind, seq = F.col("kind"), F.col("seq")
    light = events.groupBy("conv_id", "msg").agg(
        F.max(F.when(kind == "open", F.struct("seq", "role"))).alias("opened"), F.max(F.when(kind.isin("open", "edit", "regenerate"), seq)).alias("begin"), F.max(F.when(kind == "regenerate", seq)).alias("again")
    ).withColumn("_block", F.floor(F.col("msg") / BLOCK))
    earlier = lambda w: w.rangeBetween(Window.unboundedPreceding, -1)
    light = _before(light, F.col("again"), F.max, ["msg"], "_block", "dropped", earlier)
    alive = light.filter(F.col("opened").isNotNull() & ~F.coalesce(F.col("dropped") > F.col("opened.seq"), F.lit(False)))
    alive = alive.select(F.col("conv_id").alias("_c"), F.col("msg").alias("_m"), "begin", F.coalesce("opened.role", F.lit("")).alias("_role"))
    live = events.drop("role").join(alive, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("msg").eqNullSafe(F.col("_m"))).filter(seq >= F.col("begin"))
    pieces = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    return live.groupBy("conv_id", "msg").agg(F.first("_role").alias("role"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("\\</turn>")), F.lit("###"), F.lit("\\#\\#\\#"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_messages(messages: DataFrame) -> DataFrame:
    """``conv_id, msg, formatted, loss_start, loss_end``; the mask is empty for other roles than the assistant."""
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:"))
    rows = messages.select("conv_id", "msg", "role", F.concat(F.lit("### "), role, F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"))
    start = F.length("head").cast("long")
    end = start + F.when(F.col("role") == "assistant", F.length("body")).otherwise(0)
    return rows.select("conv_id", "msg", F.concat("head", "body", F.lit("</turn>\n")).alias("formatted"), start.alias("loss_start"), end.alias("loss_end"))


def parse_message(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered message."""
    head = _HEADER.match(formatted)
    end = next(m for m in _END.finditer(formatted, head.end()) if m[0][0] == "<")
    if end.end() != len(formatted):
        raise ValueError("one message was expected")
    return unescape(head[1]), unescape(formatted[head.end() : end.start()])


def read_conversations(rendered: DataFrame) -> DataFrame:
    """Digests of what the rendered messages of each conversation hold, streamed in message order."""
    bounded_batches(rendered.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "loss_start", "loss_end")]
            for conv, a, b, text in zip(*columns, texts_of(batch, "formatted"), strict=True):
                if state is None or state[0] != conv:
                    done += [_finish(state)] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_message(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                learned = unescape(text[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(text)
            if done:
                yield _rows(done, names)
                done = []
        if state:
            yield _rows([_finish(state)], names)

    ordered = rendered.select("conv_id", "msg", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "msg")
    return ordered.drop("msg").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _finish(state: list) -> list:
    conv, n, turns, chars, loss, total = state
    return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), total]


def _rows(rows: list[list], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    events = turns_to_events(turns.unionByName(probe))
    written = materialise(render_messages(fold_events(events)), "chat")
    return read_conversations(written)
