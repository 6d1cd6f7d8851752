import random

import numpy as np
import public_tokenizers
import pytest

from lexiloom.llm import pieces, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a ", "\n", " \n a\n\n  b ", "▁▁a ▁ b", "x\x00y", "日本語 😀", " " * 50 + "the" + " " * 37, "a" * 3000, "ab" * 777, "zz \t\t tab", "<s> </s> <unk> <0x0A>", "the same", "the same"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encoding_and_decoding_match_the_library(library):
    model, rnd = pieces.PieceModel(PIECES), random.Random(5)
    alphabet = list("aabbcth e  ▁\n.'é日😀\t!$0123")
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300))) for _ in range(400)]
    ids = model.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert [model.decode(np.append(x, 2)) for x in ids] == [library.decode([*x.tolist(), 2]) for x in ids]
    for _ in range(300):
        some = [rnd.choice([rnd.randint(0, 300), rnd.randint(0, 31999)]) for _ in range(rnd.randint(0, 20))]
        assert model.decode(np.array(some, np.int64)) == library.decode(some)


def test_documents(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "b", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in pieces.encode_documents(docs, PIECES, end_id=2).collect()}
    assert got == {**{i: library.encode(t or "") + [2] for i, t in enumerate(TEXTS)}, None: library.encode("b") + [2]}
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(docs, PIECES), PIECES).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))
    assert pieces.encode_documents(docs.limit(0), PIECES).count() == 0


def test_counts_encode_only_distinct_misses(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    cache = f"file://{tmp_path}/cache"
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(TEXTS)}
    for more in (0, 1):
        if more:
            docs = docs.unionByName(spark.createDataFrame([(99, "brand new text", 1)], docs.schema))
            want[99] = (14, len(library.encode("brand new text")))
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, PIECES, cache).collect()}
        assert got == want
        assert spark.read.parquet(cache).count() == len({(t or "").replace("▁", " ") for t in TEXTS}) + more
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert {r.doc_id for r in token_counts.token_counts(docs, other, cache).collect()} == set(want)


def test_long_unspaced_words_equal_the_library():
    """One word of a million characters takes seconds; shorter ones on both sides of ``LONG`` agree as well."""
    import time

    import sentencepiece

    library, model, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.piece_model(PIECES), random.Random(5)
    letters = "".join(rnd.choice("etaoinshrdlucmfwypvbgk") for _ in range(1_000_000))
    base64 = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(50_000))
    words = "".join(rnd.choice(["the", "quick", "brown", "fox", "über", "jumping", "lazy", "漢字", "éa"]) for _ in range(9_000))
    began = time.time()
    got = model.encode([letters])[0].tolist()
    assert time.time() - began < 40 and got == library.encode(letters)
    for text in (base64, words, "a" * 5_000, "ab" * 700, words[: pieces.LONG - 1], words[: pieces.LONG], words[: pieces.LONG + 1], " " * 3_000, "=" * 4_000 + "-" * 4_000):
        assert model.encode([text])[0].tolist() == library.encode(text)
