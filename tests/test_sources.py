"""Files written and read again, and streams against their batch twins."""

import math

import pytest
from pyspark.sql import functions as F

from lexiloom.operators.counts import token_counts
from lexiloom.plans.views import read
from lexiloom.sources import archives, text_files
from lexiloom.streaming import streams

SF = "/root/testdata/sf0.001"


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_lists_and_vectors(spark, tmp_path):
    names = text_files.read_segment_list(spark, write(tmp_path / "a", "# x\n\n c/1 \nc/2\n"))
    assert sorted(r.name for r in names.collect()) == ["c/1", "c/2"]
    assert [r.x for r in text_files.read_vector_text(spark, write(tmp_path / "v", "1 2.5  -3\n\n")).collect()] == [[1.0, 2.5, -3.0]]
    assert text_files.read_uem(spark, write(tmp_path / "u", ";; c\nrec 1 0.5 9\n")).first().asDict() == {"recording_id": "rec", "track": 1, "start": 0.5, "end": 9.0}
    assert text_files.read_vocabulary(spark, write(tmp_path / "w", "a\nb\na\n")).count() == 2


def test_ctm_and_stm(spark, tmp_path):
    words = spark.createDataFrame([("r", 1, 0.0, 0.5, "hi", 0.9), ("r", 1, 0.5, 1.25, "you", 1.0)], "recording_id string, track int, start double, end double, word string, conf double")
    text_files.write_ctm(words, f"file://{tmp_path}/ctm")
    assert sorted(text_files.read_ctm(spark, f"file://{tmp_path}/ctm").collect()) == sorted(words.collect())
    segments = spark.createDataFrame([("r", 1, "s", 0.0, 2.0, "<o,f0>", "hi you")], "recording_id string, track int, speaker_id string, start double, end double, condition_id string, orth string")
    text_files.write_stm(segments, f"file://{tmp_path}/stm")
    assert text_files.read_stm(spark, f"file://{tmp_path}/stm").collect() == segments.collect()


def test_arpa(spark, tmp_path):
    text = "\\data\\\nngram 1=2\n\n\\1-grams:\n-1.0\ta\t-0.5\n-2.0\tzz\n\n\\2-grams:\n-0.25\ta a\n-0.5\ta zz\n\\end\\\n"
    grams = text_files.read_arpa(spark, write(tmp_path / "arpa", text), spark.createDataFrame([("a",)], "token string"))
    got = {(r.order, r.history, r.word): (r.score, r.backoff) for r in grams.collect()}
    assert got == {(1, "", "a"): (pytest.approx(math.log(10)), pytest.approx(0.5 * math.log(10))), (2, "a", "a"): (pytest.approx(0.25 * math.log(10)), 0.0)}
    text_files.write_ngrams(grams, f"file://{tmp_path}/ngrams")
    assert text_files.read_ngrams(spark, f"file://{tmp_path}/ngrams").count() == 2


def test_archives(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "name string, v int")
    archives.archive_write(a, f"file://{tmp_path}/a")
    assert sorted(map(tuple, archives.archive_read(spark, f"file://{tmp_path}/a").select("name", "v").collect())) == [("x", 1), ("y", 2)]
    assert {r.name: r.v for r in archives.archive_combine([a, b]).collect()} == {"x": 1, "y": 2, "z": 4}
    assert {r.name: r.v for r in archives.archive_combine([a, b], "replace").collect()} == {"x": 1, "y": 3, "z": 4}
    assert [r.name for r in archives.archive_conflicts([a, b]).collect()] == ["y"]
    assert archives.archive_select(a, b).count() == 1 and archives.archive_remove(a, b).count() == 1


@pytest.mark.parametrize("what", ["integrate", "tokens", "dedup"])
def test_streams_equal_batches(spark, tmp_path, what):
    events = read(spark, SF, "events").select(F.col("user_id").alias("segment_id"), F.col("ts").cast("timestamp").alias("ts"), F.round("value").alias("x"), F.col("event_type").alias("orth"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    source = streams.stream_frames(spark, f"file://{tmp_path}/in", events.schema)
    op = {"integrate": lambda f: streams.stream_integrate(f, "1 day"), "tokens": streams.stream_token_counts, "dedup": lambda f: streams.stream_dedup(f, ["segment_id", "orth"], "3650 days").select("segment_id", "orth")}[what]
    query = op(source).writeStream.format("memory").queryName(f"twin_{what}").outputMode("append" if what == "dedup" else "complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table(f"twin_{what}").collect())) == sorted(map(str, op(events).collect()))
    assert token_counts(events).count() > 0
