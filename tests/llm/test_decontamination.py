import random
import re

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontamination as de
from lexiloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, n=10):
    """``(n_words, hit places, ids)`` of every text."""
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    lengths = sorted({len(x) for x in windows})
    out = []
    for text in texts:
        w, hit, ids = words_of(text), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    ids |= windows[tuple(w[k : k + m])]
        out.append((len(w), hit, sorted(ids)))
    return out


def case(seed, n_items=25, n_docs=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "C", "dé", "x1", "ÜBER", "loooooooooooooooooooooooong" + rnd.choice("ab"), "e"])
    sign = lambda: rnd.choice([" ", ", ", "\n", " - ", "\x00", "_"])
    text = lambda k: "".join(word() + sign() for _ in range(k))
    items = [(rnd.choice([i, i, i, i // 2, None]), rnd.choice([text(rnd.randint(1, 30)), text(rnd.randint(8, 14)), None, "", " - "])) for i in range(n_items)]
    texts = []
    for _ in range(n_docs):
        t = text(rnd.randint(0, 40))
        if rnd.random() < 0.5 and items[k := rnd.randrange(n_items)][1]:
            t += items[k][1].upper().replace(",", ";") + text(3)
        texts.append(rnd.choice([t, t, t, t, None, ""]))
    return texts, items


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_against_plain_windows(spark, monkeypatch, block):
    monkeypatch.setattr(de, "BLOCK_BYTES", block)
    for seed in (1, 2):
        texts, items = case(seed)
        texts += texts[:5] + ["a b " * 20_000]
        docs = spark.createDataFrame([(i % 100, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
        bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, block int")
        assert de._item_blocks(bench)[1] > 1 or block > 1000
        judged = de.contamination(docs, bench, F.struct("doc_id", F.md5(F.coalesce("text", F.lit("-"))).alias("m"))).withColumn("n_hit", de.n_hit("spans"))
        got = sorted((r.row.doc_id, r.row.m, r.n_words, r.n_hit, sorted(r["items"])) for r in judged.collect())
        import hashlib

        want = sorted((i % 100, hashlib.md5((t if t is not None else "-").encode()).hexdigest(), n, len(hit), ids) for (i, t), (n, hit, ids) in zip(enumerate(texts), brute(texts, items)))
        assert got == want and any(w[3] for w in want)


def test_hash_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(de, "hash_identities", lambda low, high, sizes: (low & de.np.uint64(1)))
    monkeypatch.setattr(de, "mix", lambda x: x & de.np.uint64(3))
    texts, items = case(7)
    windows = de.WindowSet([str(i) if i is not None else "" for i, t in items if words_of(t)], [" ".join(words_of(t)) for _, t in items if words_of(t)], 10)
    counts, spans, ids = windows.judge([t or "" for t in texts])
    for (n, hit, names), c, s, got in zip(brute(texts, items), counts, spans, ids):
        assert (n, len(hit), names) == (c, sum(b - a for a, b in zip(s[::2], s[1::2])), got)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_removal(spark, monkeypatch, block):
    monkeypatch.setattr(de, "BLOCK_BYTES", block)
    texts, items = case(3)
    docs = spark.createDataFrame([(t, i, "x") for i, t in enumerate(texts)], "text string, doc_id long, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = brute(texts, items)
    kept = de.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, hit, _) in enumerate(plain) if not hit}
    cut = {r.doc_id: r.text for r in de.decontaminate(docs, bench, remove="spans").collect()}
    assert len(cut) == len(texts)
    for i, (_, hit, _) in enumerate(plain):
        if not hit:
            assert cut[i] == texts[i]
        else:
            assert words_of(cut[i]) == [w for k, w in enumerate(words_of(texts[i])) if k not in hit] or re.sub(r"\W|_", "", cut[i].lower()) == "".join(w for k, w in enumerate(words_of(texts[i])) if k not in hit)
    with pytest.raises(ValueError):
        de.decontaminate(docs, bench, remove="all")
    assert de.decontaminate(docs.limit(0), bench, remove="spans").count() == 0 and de.decontaminate(docs, bench.limit(0)).count() == len(texts)


CONTRACT = {
    "op1_pieces": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_token_files": "doc_id start n_tokens ids_crc32", "op3_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_token_counts": "doc_id n_bytes n_tokens over_limit", "op5_near_dedup": "doc_id n_shingles component_id kept", "op6_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op8_pii": "doc_id text n_masked", "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op10_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op11_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified", "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score", "op13_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
}


@pytest.mark.parametrize("rows", [True, False])
def test_every_query_on_edge_tables(spark, tmp_path, rows):
    """Nulls in every column, empty and repeated rows, clashing columns, or no rows at all: the contract's columns come out."""
    long = "some words and numbers 12 " * 50_000  # over a megabyte
    docs = [(1, "a few words, twice. a few words", "en", "s", 3, 0, "k"), (1, "a few words, twice. a few words", "en", "s", 3, 0, "k"), (2, None, None, None, None, None, None), (None, "without an id", "en", None, 4, 1, "q"), (3, "", "de", "", 0, 2, ""), (4, long, "en", "s", len(long), 3, "k"), (5, " \n\t", "", "s", 3, 4, "x")]
    chats = [(1, 0, "user", "hi", 0), (1, 1, "assistant", None, 0), (None, 0, "user", "x", 0), (2, 0, None, "", 0), (2, None, "assistant", "y", 0)]
    vectors = [(0, 1, [0.1, 0.2], 0), (100, None, [0.1], 0), (7, 1, None, 0), (8, 2, [0.5, None], 0), (None, 1, [1.0, 0.0], 0), (9, 1, [0.3, 0.2], 0), (10, 3, [0.1, 0.1], 0)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long, pos int, node string"), "conversations": (chats, "conv_id long, turn long, role string, text string, part int"), "embeddings": (vectors, "vec_id long, label int, embedding array<float>, cluster int"),
        "benchmark": ([(1, "a few words", 0), (None, None, 0), (2, "", 0)], "item_id long, text string, block int"), "labels": ([(1, 1, 0, "z"), (2, None, None, None), (None, 1, 1, "z"), (4, 0, 0, "")], "doc_id long, quality int, toxic int, kept string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data if rows else [], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        out = query(spark, str(tmp_path))
        found = out.collect()
        assert set(CONTRACT[name].split()) <= set(out.columns), name
        if name in ("op1_pieces", "op2_token_files", "op3_quality", "op4_token_counts", "op5_near_dedup", "op6_fingerprints", "op7_suffix_dedup", "op8_pii", "op11_merkle", "op13_decontaminate"):
            assert len(found) == (len(docs) if rows else 0), name
