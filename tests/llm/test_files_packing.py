import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lexiloom.llm import library_ids, packing, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "x<|endoftext|> y", " \n a\n\n  b ", "\r\n a\rb", "it's 'll we've\n's", "same text", "same text", "word " * 9000, "\x1c a", "日本語 é"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_match_the_library(path):
    rnd, encoder = random.Random(3), library_ids.LibraryEncoder(path)
    alphabet = [*"aabbcth e  ▁\n\r.'é日😀\t!$0123ΣS\x1c\x85", "'ll", "<|endoftext|>", "́"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 4099])
def test_ranks_round_trip(n):
    ranks = np.random.default_rng(n).choice([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], n).astype(np.uint32)
    control, data = token_files.pack_ranks(ranks)
    assert len(control) == -(-n // 4) and (token_files.unpack_ranks(control, data, n) == ranks).all()


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(3 * i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").orderBy("text")
    token_files.write_token_files(docs, f"file://{tmp_path}/t", BYTE, end_id=0)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()}
    start, want, tokenizer = 0, {}, library(BYTE)
    for i, t in enumerate(TEXTS):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[3 * i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/e", BYTE, end_id=0)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def check_plan(lengths, capacity):
    plan = packing.Plan(dict(Counter(lengths)), capacity)
    fill, given = Counter(), Counter()
    for length, lo, hi, base, each, shift in plan.intervals:
        given[length] += hi - lo
        for rank in range(lo, hi):
            fill[base + (rank - lo + shift) // each] += length
    assert given == Counter(lengths) and max(fill.values(), default=0) <= capacity and len(fill) == plan.sequences
    return plan.sequences


@pytest.mark.parametrize("lo,hi,slack", [(1, 4096, 1.02), (1, 600, 1.002), (400, 1500, 1.03), (4096, 4096, 1), (1, 1, 1)])
def test_plans_are_tight(lo, hi, slack):
    lengths = np.random.default_rng(1).integers(lo, hi + 1, 5000).tolist()
    assert check_plan(lengths, 4096) <= slack * -(-sum(lengths) // 4096) + 1


def test_packing(spark):
    rows = [(i, t, 9) for i, t in enumerate(TEXTS)] + [(None, "b", 1), (3, "a", 1)]
    pieces = packing.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, offset int"), WORD, 1)
    got = packing.pack_pieces(pieces, ["doc_id", "piece", "ids_crc32"]).collect()
    tokenizer, want = library(WORD), []
    for i, t, _ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack_pieces(pieces.limit(0), ["doc_id", "piece", "ids_crc32"]).count() == 0
