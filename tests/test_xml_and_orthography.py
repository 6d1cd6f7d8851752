import math

from pyspark.sql import functions as F

from lexiloom.operators import counts, evaluate, orthography
from lexiloom.operators import language_models as lm
from lexiloom.sources import text_files, xml_files

CORPUS = """<?xml version="1.0" encoding="UTF-8"?>
<corpus name="c">
  <speaker-description name="anna"><gender>female</gender><native-language>xx</native-language></speaker-description>
  <recording name="r1" audio="r1.wav">
    <speaker name="anna"/>
    <segment name="a" start="0.5" end="2.25"><orth>
      a   red boat </orth></segment>
    <segment start="2.25" end="inf"><speaker name="ben"/><condition name="noisy"/><orth>bye</orth></segment>
  </recording>
  <subcorpus name="sub"><recording name="r2" audio="r2.wav"><segment name="x"><orth>one</orth></segment></recording><recording name="r3" audio="r3.wav"></recording></subcorpus>
</corpus>"""
LEXICON = """<?xml version="1.0" encoding="UTF-8"?>
<lexicon>
  <lemma special="silence"><orth>[SILENCE]</orth><orth></orth><phon score="0.5">si</phon><synt/><eval/></lemma>
  <lemma><orth>read</orth><phon weight="0.25">r eh d</phon><phon weight="0.75">r ii d</phon><synt><tok>read</tok></synt></lemma>
  <lemma name="NY"><orth>new york</orth><phon>n uw</phon><eval><tok>new</tok><tok>york</tok></eval></lemma>
</lexicon>"""


def test_corpus(spark, tmp_path):
    (tmp_path / "c.xml").write_text(CORPUS)
    rows = {r.segment_id: r for r in xml_files.read_corpus(spark, str(tmp_path / "c.xml"), "c", speaker="nobody").collect()}
    assert set(rows) == {"c/r1/a", "c/r1/2", "c/sub/r2/x"}
    a, b, x = (rows[k] for k in ("c/r1/a", "c/r1/2", "c/sub/r2/x"))
    assert (a.start, a.end, a.speaker_id, a.condition_id, a.orth, a.audio) == (0.5, 2.25, "anna", None, "a red boat", "r1.wav")
    assert (b.start, b.end, b.speaker_id, b.condition_id) == (2.25, None, "ben", "noisy") and (x.speaker_id, x.start, x.corpus_id) == ("nobody", 0.0, "c/sub")
    assert {tuple(r) for r in xml_files.read_recordings(spark, str(tmp_path / "c.xml"), "c").collect()} == {("c/r1", "c", "r1.wav", 2), ("c/sub/r2", "c/sub", "r2.wav", 1), ("c/sub/r3", "c/sub", "r3.wav", 0)}
    assert [tuple(r) for r in xml_files.read_speakers(spark, str(tmp_path / "c.xml")).collect()] == [("anna", "female", "xx", None)]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.xml").write_text(LEXICON)
    rows = {r.lemma: r for r in xml_files.read_lexicon(spark, str(tmp_path / "l.xml")).collect()}
    assert rows["[SILENCE]"].special == "silence" and rows["[SILENCE]"].orths == ["[SILENCE]"] and rows["[SILENCE]"].synt == [] and rows["[SILENCE]"].prons[0].score == 0.5
    assert [(p.phon, round(p.score, 6)) for p in rows["read"].prons] == [("r eh d", round(-math.log(0.25), 6)), ("r ii d", round(-math.log(0.75), 6))]
    assert rows["NY"].orths == ["new york"] and rows["NY"].synt == ["NY"] and rows["NY"].evals == [["new", "york"]]


def test_readings(spark):
    texts = ["we {drove home|walked back} at six ", "", "a [b] c", "{a {b|c}|d}", "[x {y|z}]"]
    s = spark.createDataFrame(list(enumerate(texts)), "segment_id int, orth string")
    assert [r.t for r in s.orderBy("segment_id").select(orthography.orth_text(F.col("orth")).alias("t")).collect()] == ["we drove home at six", "", "a b c", "a b", "x y"]
    got = {}
    for r in orthography.orth_variants(s).orderBy("variant").collect():
        got.setdefault(r.segment_id, []).append(r.text)
    assert got[0] == ["we drove home at six", "we walked back at six"] and got[1] == [""] and got[2] == ["a b c", "a c"]
    assert sorted(got[3]) == ["a b", "a c", "d"] and sorted(got[4]) == ["", "x y", "x z"]


def test_alignment_in_little_memory(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    a = [rnd.choice("abcd") for _ in range(60)]
    b = [rnd.choice("abcd") for _ in range(50)]
    cost = lambda pairs: sum(i < 0 or j < 0 or a[i] != b[j] for i, j in pairs)
    whole = evaluate.align(a, b)
    monkeypatch.setattr(evaluate, "CELLS", 20)
    halved = evaluate.align(a, b)
    for pairs in (whole, halved):
        assert [i for i, _ in pairs if i >= 0] == list(range(60)) and [j for _, j in pairs if j >= 0] == list(range(50))
    expected = spark.createDataFrame([("".join(a), "".join(b))], "a string, b string").select(F.levenshtein("a", "b")).first()[0]
    assert cost(whole) == cost(halved) == expected


def test_history_mass(spark):
    s = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "b c a", "a a c b"])], "segment_id int, orth string")
    model = counts.estimate_backoff_lm(counts.ngram_counts(s, 2), 2)
    events = counts.lm_events(s, 2)
    vocabulary = spark.createDataFrame([("a",), ("c",), ("</s>",)], "token string")
    got = {r.history: r.mass for r in lm.history_mass(events, model, vocabulary, 2).collect()}
    histories = events.select("history").distinct().collect()
    for h in histories:
        pairs = vocabulary.select(F.lit(0).alias("segment_id"), F.lit(0).alias("pos"), F.col("token").alias("word"), F.lit(h.history).alias("history"))
        brute = counts.lm_score(pairs, model, 2).agg(F.sum(F.exp(-F.col("score")))).first()[0]
        assert abs(got[h.history] - brute) < 1e-9


def test_sentences_are_written(spark, tmp_path):
    s = spark.createDataFrame([("s1", "a b"), ("s2", "")], "segment_id string, orth string")
    text_files.write_sentences(s, str(tmp_path / "out"))
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {"s1\ta b", "s2\t"}
