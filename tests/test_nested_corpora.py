import random
import xml.etree.ElementTree as ET

import pytest

from lexiloom.sources import nested_corpora, xml_files


def plain_segments(root, corpus=None, frames=None, files=None, out=None):
    """The segments of a parsed corpus by recursion over its elements."""
    out = [] if out is None else out
    frames = frames or [{"name": corpus or root.get("name"), "speaker": None, "condition": None}]
    nearest = lambda c: next((f[c] for f in reversed(frames) if f[c]), None)
    path = lambda: "/".join(f["name"] for f in frames)
    number, taken = 0, set()
    for e in root:
        if e.tag in ("speaker", "condition"):
            frames[-1][e.tag] = e.get("name")
        elif e.tag in ("speaker-description", "condition-description") and e.get("name") is None:
            frames[-1][e.tag.removesuffix("-description")] = path() + "/ANONYMOUS"
        elif e.tag == "include":
            plain_segments(ET.fromstring(files[e.get("file")]), None, frames, files, out)
        elif e.tag in ("subcorpus", "recording"):
            frames.append({"name": e.get("name"), "speaker": None, "condition": None})
            plain_segments(e, None, frames, files, out)
            frames.pop()
        elif e.tag == "segment":
            number += 1
            name = e.get("name") or str(number)
            while e.get("name") is None and name in taken:
                name += "+"
            taken.add(name)
            own = {c: (e.find(c).get("name") if e.find(c) is not None else nearest(c)) for c in ("speaker", "condition")}
            out.append((f"{path()}/{name}", number - 1, own["speaker"], own["condition"], " ".join((e.findtext("orth") or "").split())))
    return out


def random_corpus(rnd, depth=0, root="corpus", name="top"):
    parts = [f'<{root} name="{name}">\n']
    taken = iter(range(1000))
    for _ in range(rnd.randint(1, 5 if depth else 9)):
        kind = rnd.choice(["sub", "rec", "rec", "speaker", "condition", "anonymous", "comment"])
        if kind == "sub" and depth < 4:
            parts.append(random_corpus(rnd, depth + 1, "subcorpus", f"s{next(taken)}"))
        elif kind == "rec":
            segments = []
            for k in range(rnd.randint(0, 12)):
                label = rnd.choice(["", "", f' name="n{k}"', f' name="{100 + k}"'] + ([f' name="{k + 2}"'] if k == 3 else []))
                inner = rnd.choice(["", '<speaker name="x"/>', '<condition name="k"/>', "<!-- <segment> <recording name='no'> -->"])
                segments.append(f'<segment start="{k}"{label}>{inner}<orth> w{k} &amp; &lt;{"a" * rnd.randint(0, 30)}  b </orth></segment>\n')
                if rnd.random() < 0.1:
                    segments.append(f'<speaker name="later{k}"/>')
            parts.append(f'<recording name="r{next(taken)}" audio="a.wav">{"".join(segments)}</recording>\n')
        elif kind in ("speaker", "condition"):
            parts.append(f'<{kind} name="{kind}{rnd.randint(0, 9)}"/>\n')
        elif kind == "anonymous":
            parts.append("<speaker-description><gender>male</gender></speaker-description>")
        elif kind == "comment":
            parts.append(f"<!-- a <subcorpus name='lost'> {'x' * rnd.randint(0, 200)} <segment/> </segment> -->\n")
    return "".join([*parts, f"</{root}>\n"])


@pytest.mark.parametrize("split", ["128m", "700"])
def test_any_split_gives_the_same_segments(spark, tmp_path, split):
    rnd = random.Random(5)
    texts = {f"c{k:02}.xml": '<?xml version="1.0" encoding="UTF-8"?>\n' + random_corpus(rnd, name=f"top{k}") for k in range(12)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    want = [row for name in sorted(texts) for row in plain_segments(ET.fromstring(texts[name]))]
    assert len(want) > 100
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = xml_files.read_corpus(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.seq for r in got] == list(range(len(want)))
    assert [(r.segment_id, r.i, r.speaker_id, r.condition_id, r.orth) for r in got] == want


def test_sections_includes_and_defaults(spark, tmp_path):
    files = {
        "main.xml": """<corpus name="all"><condition name="quiet"/>
          <subcorpus name="one"><speaker name="anna"/><recording name="r" audio="1.wav"><segment start="1" end="2"><orth>a</orth></segment></recording></subcorpus>
          <subcorpus name="two"><include file="parts/two.xml"/><recording name="r" audio="/2.wav"><segment/><speaker name="carl"/><segment><speaker-description><gender>male</gender></speaker-description></segment><segment/></recording></subcorpus>
          <recording name="r" audio="3.wav"><segment name="2"/><segment/></recording></corpus>""",
        "parts/two.xml": """<corpus name="two"><speaker name="ben"/><recording name="q" audio="4.wav"><condition name="loud"/><segment name="s"><orth>the <noise>big</noise> <alternatives><orth>cat</orth>
          <orth></orth></alternatives> <optional>sat</optional></orth><left-context-orth> so </left-context-orth></segment></recording></corpus>""",
    }
    (tmp_path / "parts").mkdir()
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = xml_files.read_corpus(spark, str(tmp_path / "main.xml"), audio_dir="/data").orderBy("seq").collect()
    assert [(r.segment_id, r.speaker_id, r.condition_id) for r in rows] == [
        ("all/one/r/1", "anna", "quiet"), ("all/two/q/s", "ben", "loud"), ("all/two/r/1", "ben", "quiet"), ("all/two/r/2", "all/two/r/2/ANONYMOUS", "quiet"), ("all/two/r/3", "carl", "quiet"), ("all/r/2", None, "quiet"), ("all/r/2+", None, "quiet"),
    ]
    assert (rows[1].orth, rows[1].left_orth, rows[1].audio, rows[2].audio) == ("the big {cat|} [sat]", "so", "/data/4.wav", "/2.wav")
    named = xml_files.read_corpus(spark, str(tmp_path / "main.xml"), corpus="x", remove_prefix="x/").orderBy("seq").collect()
    assert [r.segment_id for r in named[:2]] == ["one/r/1", "two/q/s"] and named[-1].segment_id == "x/r/2+"
    (tmp_path / "bad.xml").write_text('<corpus name="b"><include file="parts/two.xml"/></corpus>')
    with pytest.raises(ValueError, match="instead of"):
        xml_files.read_corpus(spark, str(tmp_path / "bad.xml"))
    (tmp_path / "loop.xml").write_text('<corpus name="b"><include file="loop.xml"/></corpus>')
    with pytest.raises(ValueError, match="itself"):
        nested_corpora.entries(spark, str(tmp_path / "loop.xml"))
    (tmp_path / "empty.xml").write_text('<corpus name="b"></corpus>')
    assert xml_files.read_corpus(spark, str(tmp_path / "empty.xml")).count() == 0
