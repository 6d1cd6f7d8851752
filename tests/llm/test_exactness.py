"""Words that weak hashes confuse, events out of the usual order, stored counts that are met, and packing against the optimum."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from lexiloom.llm import chat, fingerprints, packing, shingles, suffix_dedup, token_counts
from lexiloom.llm.library_ids import library_encoder

_SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(_SWAP)
    return word


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_equal_polynomial_hashes_have_their_own_ids(name):
    encoder = library_encoder(public_tokenizers.path(name))
    for n in (1024, 2048):
        word = thue_morse(n)
        other = word.translate(_SWAP)
        texts = [f"{word} {other}", f"{other} {word}", "a\0 a a\0\0", "a a\0"]
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_colliding_hashes_are_told_apart_by_the_store(monkeypatch):
    from lexiloom.llm import library_ids

    monkeypatch.setattr(library_ids, "hash_identities", lambda low, high, tags: np.full(len(low), 7, np.uint64))
    encoder = library_ids.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["some words and other words", "words again, some more"]
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_shingles_and_sketches_differ():
    for n in (1024, 2048):
        word = thue_morse(n)
        a, b = (shingles.shingle_hashes([w], 5)[0] for w in (word, word.translate(_SWAP)))
        assert a[0] != b[0] and fingerprints.to_text(fingerprints.sketch(a)) != fingerprints.to_text(fingerprints.sketch(b))


def test_passages_of_equal_polynomial_hashes_stay(spark):
    word = thue_morse(2048)
    docs = spark.createDataFrame([(1, word[:1024]), (2, word[:1024].translate(_SWAP))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()}
    seen = set()
    for doc_id, text in ((1, word[:1024]), (2, word[:1024].translate(_SWAP))):
        gone = set()
        for s in range(len(text) - 99):
            if text[s : s + 100] in seen:
                gone |= set(range(s, s + 100))
            seen.add(text[s : s + 100])
        assert got[doc_id] == "".join(c for i, c in enumerate(text) if i not in gone)


def test_other_texts_under_one_id_are_not_cut(spark):
    passage, other = "".join(map(str, range(1000, 1100))), "".join(map(str, range(5000, 5100)))
    docs = spark.createDataFrame([(1, passage), (2, passage), (2, other)], "doc_id long, text string")
    assert sorted(r.text for r in suffix_dedup.remove_repeats(docs).filter("doc_id = 2").collect()) == sorted(["", other])


def test_reopened_message(spark):
    log = [(1, 1, "open", 2, "user", ""), (1, 2, "delta", 2, None, "old"), (1, 3, "open", 3, "assistant", ""), (1, 4, "delta", 3, None, "first"), (1, 5, "regenerate", 2, None, ""), (1, 6, "delta", 2, None, "new"), (1, 7, "open", 3, "tool", ""), (1, 8, "delta", 3, None, "again"), (1, 9, "edit", 3, None, "edited"), (1, 10, "delta", 9, None, "nobody")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    assert sorted(map(tuple, chat.fold_events(events).collect())) == [(1, 2, "user", "new"), (1, 3, "tool", "edited")]
    assert sorted(map(tuple, chat.fold_events(events.filter("seq < 7")).collect())) == [(1, 2, "user", "new")]


def test_log_with_edits_and_regenerations_ends_in_the_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "x" * rnd.randint(1, 2000)])) for c in [*range(12), None] for t in range(rnd.randint(1, 12))] + [(3, 1, "user", "twice")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat.turns_to_events(turns)
    assert {"open", "delta", "edit", "regenerate"} == {r.kind for r in events.select("kind").distinct().collect()}
    want = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        want += [(r[0], k + 1, r[2] or "", r[3] or "") for k, r in enumerate(group)]
    assert sorted(map(tuple, chat.fold_events(events).collect()), key=str) == sorted(want, key=str)


def test_stored_counts_are_met(spark, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(k, f"text number {k % 7}") for k in range(40)] + [(99, None)], "doc_id long, text string")
    token_counts.fill_cache(docs.filter("doc_id < 20"), path, cache)
    assert spark.read.parquet(cache).count() == 7
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path, cache).collect()}
    assert spark.read.parquet(cache).count() == 8 and len(got) == 41 and got[99] == 0 and got[0] == got[7]


def test_packing_against_the_optimum():
    rnd, hits, cases = random.Random(9), 0, 60
    for _ in range(cases):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        histogram = {n: lengths.count(n) for n in lengths}
        found = min(packing.Plan(histogram, 20, *v).sequences for v in packing.VARIANTS)
        best = optimum(tuple(sorted(lengths, reverse=True)), 20)
        assert best <= found <= best + 1
        hits += found == best
    assert hits >= 0.95 * cases


def optimum(lengths, capacity):
    """The least number of sequences, by trying every place of every piece."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {rooms[i]: i for i in range(len(rooms)) if rooms[i] >= lengths[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best
