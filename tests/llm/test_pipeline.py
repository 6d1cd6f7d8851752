import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_quality import brute as base_brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small fixture with copies, near copies, junk, passages and personal data."""
    rnd, path = random.Random(7), tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(80):
        w = [word() for _ in range(rnd.randint(60, 150))]
        if i % 5 == 1:
            w = [x + "$$$" for x in w]
        if i % 7 == 2:
            w.insert(30, passage)
        if i % 4 == 3:
            w.insert(10, "4539578763621486")
        rows.append(" ".join(w))
    rows += [rows[3], rows[3].replace(rows[3].split()[40], "changed", 1), "short text", "", None, "x y z " * 100]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(rows)]
    labels = [(i, int(i % 5 != 1), 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages_against_brute_force(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, path)
        if name == "best_fit_packing":
            got = out.collect()
            assert {r.doc_id for r in got} == set(before) and all(r.offset + r.length <= 4096 for r in got)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.schema["text"] == docs.schema["text"]
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality_rules":
            fails = {d for d, t in texts.items() if (b := base_brute(t or ""))[0] < 50 or 100 * b[4] > 50 * b[0]}
            assert set(got) == {d for d in texts if d not in fails and not (d < 80 and d % 5 == 1)}
        elif name == "near_duplicates":
            want = near_brute(list(before.items()), 5)
            assert set(got) == {d for d, x in want.items() if x[2]} and 80 not in got
        elif name == "repeated_passages":
            seen = set()
            for d in sorted(before):
                raw = before[d].encode()
                gone = set()
                for s in range(len(raw) - 99):
                    if raw[s : s + 100] in seen:
                        gone |= set(range(s, s + 100))
                    seen.add(raw[s : s + 100])
                assert got[d].text.encode() == bytes(b for i, b in enumerate(raw) if i not in gone)
        else:
            for d, text in before.items():
                assert "4539578763621486" not in got[d].text
                assert re.sub(r"[0-9]", "9", got[d].text) == re.sub(r"[0-9]", "9", text)
        assert all(r.n_chars == len(r.text) for r in got.values())
        docs = spark.createDataFrame(list(got.values()), out.schema)


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables[0]).collect()
    assert got and {"doc_id", "piece", "sequence_id", "offset"} <= set(got[0].asDict())
