"""Readings without bounds, sweeps of long texts, n-gram counts, segments of bounded length, clusters, streams: against plain versions."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import tables
from lexiloom.operators import adaptation, arcs, counts, orthography, slots
from lexiloom.operators import language_models as lm
from lexiloom.streaming import streams


def test_all_readings_and_any_depth(spark):
    many = "{" + "|".join(f"r{i}" for i in range(70)) + "}"
    deep = "[" * 12 + "x" + "]" * 12
    rows = [(0, many), (1, deep), (2, "{a|{b|{c|{d|{e|{f|g}}}}}} z"), (3, "plain"), (4, "[a] " * 6), (5, None)]
    data = spark.createDataFrame(rows, "segment_id int, orth string")
    got = {}
    for r in orthography.orth_variants(data).orderBy("variant").collect():
        got.setdefault(r.segment_id, []).append(r.text)
    assert got[0] == [f"r{i}" for i in range(70)] and sorted(got[1]) == ["", "x"] and sorted(got[2]) == [f"{c} z" for c in "abcdefg"] and got[3] == ["plain"]
    assert len(got[4]) == 7 and "" in got[4]
    first = {r.segment_id: r.t for r in data.select("segment_id", orthography.orth_text(F.col("orth")).alias("t")).collect()}
    assert first[1] == "x" and first[2] == "a z" and first[0] == "r0"
    with pytest.raises(Exception, match="readings"):
        orthography.orth_variants(data, most=64).collect()


def plain_matches(words, lexicon, longest):
    reached, out = {0}, []
    for i in range(len(words)):
        if i not in reached:
            continue
        found = [(n, lemma) for n in range(1, longest + 1) for lemma, orth in lexicon if words[i : i + n] == orth.split() and i + n <= len(words)]
        reached |= {i + n for n, _ in found} if found else {i + 1}
        out += [(i, n, lemma) for n, lemma in found] or [(i, 1, None)]
    return out


def test_matches_in_texts_of_any_length(spark):
    rnd = random.Random(1)
    lexicon = [("A", "a"), ("A2", "a"), ("AB", "a b"), ("BCA", "b c a"), ("CC", "c c")]
    texts = {k: [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))] for k in range(40)} | {99: [rnd.choice("abcd") for _ in range(20_000)]}
    data = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "segment_id int, orth string").repartition(3)
    got = {}
    for r in orthography.orth_matches(data, spark.createDataFrame(lexicon, "lemma string, orth string"), 3).collect():
        got.setdefault(r.segment_id, []).append((r.pos, r.n, r.lemma))
    key = lambda x: (x[0], x[1], x[2] or "")
    for k, words in texts.items():
        assert sorted(got.get(k, []), key=key) == sorted(plain_matches(words, lexicon, 3), key=key)


def test_frequent_history_is_spread(spark):
    """The n-grams of one history are in several tasks, each n-gram in one; those of literal marks and of words alone are told apart."""
    data = spark.createDataFrame([(" ".join(f"a w{i} <s>" for i in range(200)),), ("a",), ("",), (None,)], "orth string")
    rows = counts.ngram_counts(data, 2).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in rows if r.history == "a"}) > 1
    got = {(r.order, r.history, r.word): r.n for r in rows}
    assert len(got) == len(rows) and got[1, "", "a"] == 201 and got[2, "a", "w7"] == 1 and got[2, "<s>", "a"] == 201 and got[2, "<s>", "</s>"] == 3 and got[1, "", "<s>"] == 200


def test_coverage_makes_words_once(spark):
    """Texts are read for the windows of segments and for the reference; segments without hits are met by id."""
    from lexiloom.operators import transcripts

    data = spark.createDataFrame([("a", "x y z q"), ("b", "q"), ("c", None), ("d", "y z y z")], "segment_id string, orth string")
    share = transcripts.covered_share(data, spark.createDataFrame([("y z",)], "g string"), 2)
    assert {r.segment_id: r.coverage for r in share.collect()} == {"a": 0.5, "b": 0.0, "c": 0.0, "d": 1.0}
    plan = share._jdf.queryExecution().optimizedPlan().toString()
    assert sum("regexp_replace(" in line for line in plan.splitlines() if "Project" in line) == 1


def test_coverage_needs_no_scores(spark):
    """The n-grams that a model has are read from the counts: nothing is joined but them and the segments."""
    from lexiloom.plans import catalogue

    plan = catalogue.QUERIES["drop_uncovered_by_lm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2


@pytest.mark.parametrize("tokens", [1 << 21, 4])
def test_ngram_counts(spark, monkeypatch, tokens):
    monkeypatch.setattr(counts, "TOKENS", tokens)
    rnd = random.Random(2)
    texts = [None, "", " \t\n", "one"] + [" ".join(rnd.choice(["a", "b", "é", "c\td", "<s>"]) for _ in range(rnd.randint(0, 12))) for _ in range(50)]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "segment_id int, orth string").repartition(3)
    for order in (1, 2, 4):
        want = Counter()
        for t in texts:
            w = ["<s>", *(t or "").replace("\t", " ").split(), "</s>"]
            for e in range(1, len(w)):
                for k in range(1, order + 1):
                    if e - k + 1 >= 0:
                        want[k, " ".join(w[e - k + 1 : e]), w[e]] += 1
        assert {(r.order, r.history, r.word): r.n for r in counts.ngram_counts(data, order).collect()} == want
    assert counts.ngram_counts(data.limit(0), 3).count() == 0


def plain_parts(words, nonspeech, least):
    """Lists of words between the middles of long runs of non-speech."""
    cuts = []
    for i, (start, _, w) in enumerate(words):
        if w in nonspeech and (i == 0 or words[i - 1][2] not in nonspeech):
            speech = next((x[0] for x in words[i:] if x[2] not in nonspeech), None)
            if speech is not None and speech - start > least:
                cuts.append(start + (speech - start) / 2)
    out = {}
    for x in words:
        # a cut counts from the word that begins its run; non-speech before the middle stays behind
        out.setdefault(sum(c <= x[0] for c in cuts), []).append(x)
    return list(out.values())


def test_segments_of_bounded_length(spark):
    rnd = random.Random(5)
    recordings = {}
    for k in range(12):
        at, words = 0.0, []
        for _ in range(60):
            length = rnd.choice([5.0, 10.0])
            words.append((at, at + length, rnd.choice(["q", "q", "w"])))
            at += length
        recordings[k] = words
    data = spark.createDataFrame([(k, *w) for k, words in recordings.items() for w in words], "recording_id int, start double, end double, word string").repartition(3)
    got = sorted((r.recording_id, r.start, r.end, r.n_words) for r in orthography.segment_max_length(data, ["q"], 90.0, [40.0, 20.0, 5.0]).collect())
    want = []
    for k, words in recordings.items():
        open_, done = [words], []
        for least in (40.0, 20.0, 5.0):
            parts = [p for part in open_ for p in plain_parts(part, {"q"}, least)]
            done += [p for p in parts if p[-1][1] - p[0][0] <= 90]
            open_ = [p for p in parts if p[-1][1] - p[0][0] > 90]
        want += [(k, p[0][0], p[-1][1], sum(w[2] == "w" for w in p)) for p in done + open_]
    assert got == sorted(want)
    assert sum(r[3] for r in got) == sum(w[2] == "w" for words in recordings.values() for w in words)  # no word twice


def test_clusters_by_divergence(spark):
    rng = np.random.default_rng(3)
    centres = {0: np.zeros(2), 1: np.array([6.0, 0.0]), 2: np.array([0.0, 6.0])}
    rows = [("r", s, (centres[s % 3] + rng.normal(size=2)).tolist()) for s in range(12) for _ in range(30)]
    data = spark.createDataFrame(rows, "recording_id string, segment_id int, x array<double>").repartition(3)
    x = {s: np.array([r[2] for r in rows if r[1] == s]) for s in range(12)}
    gauss = lambda a: (len(a), a.mean(0), np.cov(a.T, bias=True) + 1e-6 * np.eye(2))
    like = lambda p, q: 0.5 * p[0] * (-np.linalg.slogdet(q[2])[1] - np.trace(np.linalg.inv(q[2]) @ p[2]) - (p[1] - q[1]) @ np.linalg.inv(q[2]) @ (p[1] - q[1]))
    size = lambda a: len(a) * np.linalg.slogdet(gauss(a)[2])[1]
    groups = {s: [s] for s in x}
    while True:
        pairs = [(like(p, p) + like(q, q) - like(p, q) - like(q, p), j, i) for j in groups for i in groups if i < j for p, q in [(gauss(np.concatenate([x[s] for s in groups[i]])), gauss(np.concatenate([x[s] for s in groups[j]])))]]
        _, j, i = min(pairs)
        a, b = (np.concatenate([x[s] for s in groups[k]]) for k in (i, j))
        if not 0.5 * (size(np.concatenate([a, b])) - size(a) - size(b)) < 0.5 * (2 + 0.5 * 2 * 3) * np.log(360):
            break
        groups[i] += groups.pop(j)
    got = {r.segment_id: r.cluster for r in adaptation.segment_clusters(data, 2, criterion="divergence").collect()}
    assert got == {s: k for k, members in groups.items() for s in members} and len(groups) == 3
    with pytest.raises(ValueError):
        adaptation.segment_clusters(data, 2, criterion="other")


def test_cepstra_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(adaptation, "BLOCK", 4)
    rnd = random.Random(3)
    samples = {1: [rnd.gauss(0, 1) for _ in range(500)], 2: [rnd.gauss(0, 1) for _ in range(63)], 3: [0.5] * 10}
    data = spark.createDataFrame([(s, i, v) for s, row in samples.items() for i, v in enumerate(row)], "segment_id int, i int, x double").repartition(3)
    size, shift, filters, cepstra = 32, 10, 8, 5
    got = {(r.segment_id, r.frame): r.cepstrum for r in adaptation.mfcc(data, size, shift, filters, cepstra, ["i"]).collect()}
    mel, cosine = adaptation.mel_filters(size, filters, 16000.0), np.cos(np.pi * np.outer(np.arange(filters) + 0.5, np.arange(cepstra)) / filters)
    want = {}
    for s, row in samples.items():
        v = np.array(row) - np.array([row[0], *row[:-1]])
        for f in range((len(v) - size) // shift + 1 if len(v) >= size else 0):
            want[s, f] = np.log(np.maximum(np.abs(np.fft.rfft(v[f * shift : f * shift + size] * np.hamming(size))) @ mel, 1e-10)) @ cosine
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_sessions_and_joins_of_streams(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, at(t), 1.0) for k in range(3) for t in sorted(rnd.sample(range(600), 40))]
    schema = "segment_id int, ts timestamp, x double"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"file://{tmp_path}/frames")
    targets = [(k, at(t)) for k in range(3) for t in range(0, 600, 7)]
    spark.createDataFrame(targets, "segment_id int, ts timestamp").repartition(2).write.parquet(f"file://{tmp_path}/targets")
    frames = streams.stream_frames(spark, f"file://{tmp_path}/frames", spark.createDataFrame([], schema).schema)
    target = streams.stream_frames(spark, f"file://{tmp_path}/targets", spark.createDataFrame([], "segment_id int, ts timestamp").schema)

    def collected(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    want = []
    for k in range(3):
        times = sorted(r[1] for r in rows if r[0] == k)
        session = [times[0]]
        for t in times[1:]:
            if (t - session[-1]).total_seconds() > 20:
                want.append((k, session[0], session[-1] + datetime.timedelta(seconds=20), len(session)))
                session = []
            session.append(t)
        want.append((k, session[0], session[-1] + datetime.timedelta(seconds=20), len(session)))
    assert sorted(map(tuple, collected(streams.stream_silence_sessions(frames, "20 seconds"), "sessions", "complete"))) == sorted(want)
    joined = collected(streams.stream_sync(frames, target), "joined", "append")
    assert sorted((r.segment_id, r.ts, r.x) for r in joined) == sorted(r for r in rows if (r[0], r[1]) in set(targets))


def test_coverage_over_many_parts(spark):
    rnd = random.Random(3)
    rows = [(f"w{k}", rnd.choice([1, 1, 1, 2, 5, 9])) for k in range(300)]
    data = spark.createDataFrame(rows, "token string, n long").repartition(3)
    vocabulary = spark.createDataFrame([(f"w{k}",) for k in range(0, 300, 3)], "token string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.rank: r for r in counts.coverage_curve(data, vocabulary).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, repeated, covered, seen = sum(n for _, n in rows), sum(n for _, n in rows if n > 1), 0, 0
    for rank, (token, n) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]), reverse=True), 1):
        covered, seen = covered + n, seen + n * (int(token[1:]) % 3 == 0)
        r = got[rank]
        assert (r.token, r.n) == (token, n) and (r.coverage, r.coverage_repeated, r.coverage_known) == pytest.approx((covered / total, min(covered, repeated) / repeated, seen / total), abs=1e-6)
    assert counts.coverage_curve(data.limit(0)).count() == 0


def test_model_of_events(spark):
    """The model of what segments ask for scores them as the whole model does, and a table of counts with totals gives the same model as counts alone."""
    import random

    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randrange(0, 9)))
    training = spark.createDataFrame([(str(i), line()) for i in range(60)], "segment_id string, orth string")
    asked = spark.createDataFrame([(str(i), line() + " z a b") for i in range(15)] + [("none", None)], "segment_id string, orth string")
    plain = counts.estimate_backoff_lm(counts.ngram_counts(training, 3), 3)
    rows = lambda df: sorted((r.segment_id, r.pos, r.word, round(r.score, 9)) for r in df.collect())
    assert rows(counts.score_segments(asked, training, 3)) == rows(counts.lm_score(counts.lm_events(asked, 3), plain, 3))
    model = counts.backoff_lm(training, 3)
    key = lambda df: sorted((r.order, r.history, r.word, round(r.score, 9), round(r.backoff, 9)) for r in df.collect())
    assert key(model) == key(plain)


@pytest.mark.parametrize("frequent, tokens", [(1 << 18, 1 << 21), (3, 10)])
def test_packed_ngrams(spark, monkeypatch, frequent, tokens):
    """Counts and models by packed rows are those by tables, whether words are frequent or named by rows, in any number of parts; no n-gram is shuffled as text."""
    from lexiloom.operators import packed_ngrams

    monkeypatch.setattr(packed_ngrams, "FREQUENT", frequent)
    monkeypatch.setattr(packed_ngrams, "TOKENS", tokens)
    rng = random.Random(frequent)
    words = ["a", "b", "é", "dd", "<s>", "</s>", *(f"w{i}" for i in range(30))]
    line = lambda: " \t".join(rng.choices(words, [9, 8, 7, 6, 1, 1] + [1] * 30, k=rng.randrange(0, 12)))
    texts = [None, "", "\n", "solo"] + [line() for _ in range(80)]
    data = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "segment_id string, orth string").repartition(3)
    asked = spark.createDataFrame([(str(i), line() + " never a") for i in range(20)] + [("none", None)], "segment_id string, orth string")
    key = lambda df: sorted((r.order, r.history, r.word, round(r.score, 9), round(r.backoff, 9)) for r in df.collect())
    rows = lambda df: sorted((r.segment_id, r.pos, r.word, round(r.score, 9)) for r in df.collect())
    for order in (1, 3):
        want = Counter()
        for t in texts:
            w = ["<s>", *(t or "").split(), "</s>"]
            want.update((k, " ".join(w[e - k + 1 : e]), w[e]) for e in range(1, len(w)) for k in range(1, order + 1) if e - k + 1 >= 0)
        table = counts.ngram_counts(data, order)
        assert {(r.order, r.history, r.word): r.n for r in table.collect()} == want
        plain = counts.estimate_backoff_lm(spark.createDataFrame([(*g, n) for g, n in want.items()], "order int, history string, word string, n long"), order)
        model = counts.backoff_lm(data, order)
        assert key(model) == key(plain)
        assert all("hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString() for df in (table, model))
        assert rows(counts.score_segments(asked, data, order)) == rows(counts.lm_score(counts.lm_events(asked, order), plain, order))
        for history in ("", "a b")[:order]:
            of = lambda df: sorted((r.order, r.word, round(r.score, 9)) for r in df.collect())
            assert of(counts.successors(data, order, history)) == of(counts.history_successors(plain, history))
    assert counts.backoff_lm(data.limit(0), 2).count() == 0


def test_asked_counts_are_few(spark):
    """Of the n-grams of a text, only those that are asked for are written, with the totals of their histories; what all of them add to discounts is in the sums."""
    from lexiloom.operators import packed_ngrams

    data = spark.createDataFrame([("a b c",), ("a b d",), ("e f g h",)], "orth string")
    table = packed_ngrams.asked_counts(data, 2, counts._words(data), spark.createDataFrame([("a b z",)], "orth string"))
    got = {(r.order, r.history, r.word): (r.n, r.total, r.types) for r in table.filter("history IS NOT NULL").collect()}
    assert got == {(1, "", "a"): (2, None, None), (1, "", "b"): (2, None, None), (1, "", "</s>"): (3, None, None), (2, "<s>", "a"): (2, 3, 2), (2, "a", "b"): (2, 2, 1), (2, "<s>", None): (None, 3, 2), (2, "a", None): (None, 2, 1), (2, "b", None): (None, 2, 2)}
    sums = table.filter("history IS NULL").groupBy("order").sum("n", "total", "types", "grams").collect()
    assert sorted(map(tuple, sums)) == [(1, 13, 6, 2, 9), (2, 13, 9, 2, 11)]


def test_scores_keep_no_shuffles(spark):
    """Each join of scoring is written before the next, so that the disk has the shuffles of one at a time."""
    data = spark.createDataFrame([("x", "a b c"), ("y", "a b d")], "segment_id string, orth string")
    scores = counts.score_segments(data, data, 3)
    assert "Join" not in scores._jdf.queryExecution().optimizedPlan().toString() and scores.count() == 8


def test_gathered_ngrams_are_added_up(spark, monkeypatch):
    """A task that gathers more n-grams than it should hold adds equal ones up and goes on, with one number for each word."""
    import pyarrow as pa

    from lexiloom.operators import packed_ngrams as packed

    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c d e f g h i j k".split()) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    words = counts._words(spark.createDataFrame([("a a a b b",)], "orth string"))
    rows = [b for t in texts for b in packed._local(pa.array([t]), 3, words, 2, packed.GRAMS, 1)]
    want = Counter()
    for t in texts:
        w = ["<s>", *t.split(), "</s>"]
        want.update(" ".join(w[e - k + 1 : e + 1]) for e in range(1, len(w)) for k in range(1, 4) if e - k + 1 >= 0)
    for most in (packed.GATHERED, 20):
        monkeypatch.setattr(packed, "GATHERED", most)
        found = packed._Gathered(iter(rows), words, True)
        got = [(g, n) for k in (1, 2, 3) for g, n in zip(found.texts(found.get(packed.GRAMS, k, 1)[0]).to_pylist(), found.get(packed.GRAMS, k, 1)[1][0].tolist(), strict=True)]
        assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_class_scores_and_their_shuffles(spark, order):
    """Histories of classes as those of a text of classes; no shuffle puts the words of a frequent class into one task, and at order 1 equal segment ids stay apart."""
    rng = random.Random(7)
    rows = [(f"s{i}", " ".join(rng.choice("a bb c dd e </s> zz".split()) for _ in range(rng.randrange(0, 7)))) for i in range(20)] + [("none", None), ("empty", "\t\n ")]
    rows += [("s0", "a zz"), ("s0", "zz bb a")] if order == 1 else []
    of = {"a": ("one", 0.25), "bb": ("two", 0.5), "c": ("one", 1.25), "dd": ("two", 2.0), "e": ("one", None)}
    own = lambda w: of.get(w, (w, None))
    # each line under its own number and in classes, for the plain way
    classed = spark.createDataFrame([(i, " ".join(own(w)[0] for w in (t or "").split())) for i, (_, t) in enumerate(rows)], "segment_id int, orth string")
    model = counts.estimate_backoff_lm(counts.ngram_counts(classed, order), order)
    plain = {(r.segment_id, r.pos): r.score for r in counts.lm_score(counts.lm_events(classed, order), model, order).collect()}
    words = [(i, s, pos, w) for i, (s, t) in enumerate(rows) for pos, w in enumerate([*(t or "").split(), None])]
    want = [(s, pos, w or "</s>", round(plain[i, pos] + 0.5 * (own(w)[1] or 0.0), 9)) for i, s, pos, w in words]
    classes = spark.createDataFrame([(w, *c) for w, c in of.items()], "token string, class string, emission double")
    df = lm.class_lm_score(spark.createDataFrame(rows, "segment_id string, orth string"), classes, model, order, 0.5)
    assert sorted((r.segment_id, r.pos, r.word, round(r.score, 9)) for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(history#" not in plan and "hashpartitioning(pos#" not in plan and (order > 1 or "hashpartitioning(segment_id#" not in plan)


def test_token_counts_by_parts(spark, monkeypatch):
    """Tasks hand on a row for each token of a part, not for each occurrence; the parts' counts are added up. Order 1 follows from them."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b", "ä", "\u00a0", " ", "\t", "\n", "\r"]) for _ in range(rng.randrange(0, 40)))) for i in range(200)] + [(200, None), (201, ""), (202, "a " * 5000)]
    s = spark.createDataFrame(rows, "segment_id int, orth string").repartition(3)
    want = Counter(w for _, t in rows for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w)
    for most in (counts.TOKENS, 20):
        monkeypatch.setattr(counts, "TOKENS", most)
        df = counts.token_counts(s)
        assert {r.token: r.n for r in df.collect()} == want
    assert "Generate explode" not in df._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(tuple, df.select("order", "history", "word", "n").collect()))
    assert key(counts.unigram_counts(df, s)) == key(counts.ngram_counts(s, 1))
    assert counts.unigram_counts(counts.token_counts(s.limit(0)), s.limit(0)).count() == 0


def test_tables_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """A task's share stays the same: more files, more tasks, in the cuts of long recordings and the sums over slots."""
    spark.range(4000).selectExpr("id % 50 AS recording_id", "10.0D * (id div 50) AS start", "10.0D * (id div 50) + 10 AS end", "if(id % 3 = 0, 'q', 'w') AS word").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 8)
    n = tables.dealt(words, "recording_id").rdd.getNumPartitions()
    assert n > 10
    cut = orthography.segment_max_length(words, ["q"], 90.0, [40.0, 5.0])
    assert cut.rdd.getNumPartitions() == n
    al = words.selectExpr("recording_id AS segment_id", "start AS t", "word AS label", "1.0D AS weight")
    mapping = al.select("label").distinct().withColumn("to", F.lit("x"))
    assert slots.map_labels(al, mapping).rdd.getNumPartitions() >= n
    tied = al.select("label").distinct().withColumn("state", F.lit(True))
    assert slots.set_weights_by_tied_state(al, al, tied).rdd.getNumPartitions() >= n
    cn = al.selectExpr("segment_id", "cast(t AS long) AS slot", "label", "weight AS posterior")
    assert slots.combine_cns([cn, cn], [0.5, 0.5]).rdd.getNumPartitions() >= n
    plan = arcs.arc_penalty(al.withColumn("scores", F.create_map(F.lit("a"), F.lit(1.0))), al.groupBy("label").agg(F.lit(1.0).alias("penalty")), 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # no arcs go to the few tasks of their labels
