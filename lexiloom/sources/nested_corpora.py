"""Segments of nested corpus files, with what encloses them, however a file is split.

Files are read as text that ends records at ``</segment>``, so Spark cuts large files anywhere and a segment always lies in one record. What encloses a record
(names of corpora and recording, default speaker and condition, number of the segment) may stand in any earlier split. So there are two passes: the
first reduces each split to its *effect*, the marks that are still of importance at its end or at an ``include``; the effects, a few marks for each split,
are followed in file order on the driver, files that include others among them; the second pass parses each split from the state in which it begins.

Comments (commented segments too), character data sections, entities and white space inside tags are understood; documents are UTF-8 and well formed. What may not
stand in a comment or data section within a segment is ``</segment>``.
"""

from __future__ import annotations

import pickle
import posixpath
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[?!][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z_][\w.:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.DOTALL)
_NUMBER = re.compile(r"&#(x?)([0-9A-Fa-f]+);")
_SECTIONS = ("corpus", "subcorpus", "recording")
_ANONYMOUS = "ANONYMOUS"
_NUMERIC = re.compile(r"\d+\+*\Z")


def _plain(text: str) -> str:
    return unescape(_NUMBER.sub(lambda m: chr(int(m[2], 16 if m[1] else 10)), text), {"&quot;": '"', "&apos;": "'"})


class _Text:
    """A transcript while its elements are read: alternatives as ``{a|b}``, optional parts as ``[a]``, other elements flattened."""

    def __init__(self):
        self.open: list[tuple[str, list[str]]] = [("", [])]

    def start(self, name: str) -> None:
        if name in ("alternatives", "orth", "optional"):
            self.open.append((name, []))

    def end(self, name: str) -> None:
        if name not in ("alternatives", "orth", "optional"):
            return
        _, parts = self.open.pop()
        inner = "|".join(parts) if name == "alternatives" else " ".join("".join(parts).split())
        self.open[-1][1].append({"alternatives": f" {{{inner}}} ", "optional": f" [{inner}] " if inner else ""}.get(name, inner))

    def characters(self, text: str) -> None:
        if self.open[-1][0] != "alternatives":  # these hold transcripts alone
            self.open[-1][1].append(text)

    def whole(self) -> str:
        return " ".join("".join(self.open[0][1]).split())


def marks(records: Iterable[str], in_comment: bool = False) -> Iterator[tuple]:
    """``open (kind, attributes)``, ``close (kind)``, ``speaker`` / ``condition`` (name, or None for one without name), ``include (file)``, ``segment (dict)``, at last ``comment (bool)``."""
    segment: dict | None = None
    text: _Text | None = None
    holder, within = "", 0  # the transcript's element; open elements of its name
    for record in records:
        at = 0
        if in_comment:
            at = record.find("-->") + 3
            if at == 2:
                continue
            in_comment = False
        for token in _TOKEN.finditer(record, at):
            if text is not None and token.start() > at:
                text.characters(_plain(record[at : token.start()]))
            at = token.end()
            whole, name = token[0], token["name"]
            if name is None:
                if whole.startswith("<!--"):
                    in_comment = not whole.endswith("-->")
                elif text is not None and token["data"] is not None:
                    text.characters(token["data"])
                continue
            ends, begins = bool(token["end"] or token["empty"]), not token["end"]
            attributes = {k: _plain(a or b) for k, a, b in _ATTRIBUTE.findall(token["attributes"])} if begins else {}
            if text is not None:
                within += (name == holder) * (begins - ends)
                if within:
                    if begins:
                        text.start(name)
                    if ends:
                        text.end(name)
                elif segment is not None:
                    segment[holder], text = text.whole(), None
            elif name == "segment":
                if begins:
                    segment = {"attributes": attributes}
                if ends and segment is not None:
                    yield "segment", segment
                    segment = None
            elif segment is not None:
                if begins and name in ("orth", "left-context-orth", "right-context-orth"):
                    text, holder, within = _Text(), name, 1
                    if ends:
                        segment[holder], text = "", None
                elif begins and name in ("speaker", "condition"):
                    segment.setdefault(name, attributes.get("name"))
                elif begins and name in ("speaker-description", "condition-description"):
                    segment.setdefault(name.removesuffix("-description"), attributes.get("name", _ANONYMOUS))
            elif name in _SECTIONS:
                if begins:
                    yield "open", name, attributes
                if ends:
                    yield "close", name
            elif begins and name in ("speaker", "condition"):
                yield name, attributes.get("name")
            elif begins and name in ("speaker-description", "condition-description") and "name" not in attributes:
                yield name.removesuffix("-description"), None
            elif begins and name == "include":
                yield "include", attributes.get("file")
        if text is not None:
            text.characters(_plain(record[at:]))
    yield "comment", in_comment


def _named(number: int, taken: set[str]) -> str:
    name = str(number)
    while name in taken:
        name += "+"
    return name


class Effect:
    """What is left of a split's marks: sections that end in it count only by their segments, unless a file is included there."""

    def __init__(self):
        self.steps: list[tuple] = []
        self.sections: list[tuple[int, bool]] = []  # where the open sections began, whether they include a file

    def _here(self, kind: str) -> int | None:
        """Where a step of a kind stands since the last section began or ended; there is one of each at most."""
        for k in range(len(self.steps) - 1, -1, -1):
            if self.steps[k][0] == kind:
                return k
            if self.steps[k][0] in ("open", "close", "include"):
                return None
        return None

    def _count(self, kind: str, n: int, names: Iterable[str] = ()) -> None:
        at = self._here(kind)
        if at is None:
            at = len(self.steps)
            self.steps.append((kind, [0], set()))
        self.steps[at][1][0] += n
        self.steps[at][2].update(names)

    def take(self, mark: tuple) -> None:
        kind = mark[0]
        if kind == "segment":
            name = mark[1]["attributes"].get("name")
            self._count("segments", 1, [name] if name is not None and _NUMERIC.match(name) else [])  # only such names can be in the way of a number
        elif kind == "open" and mark[1] != "corpus":
            self.sections.append((len(self.steps), False))
            self.steps.append(mark)
        elif kind == "close" and mark[1] != "corpus" and self.sections:
            at, includes = self.sections.pop()
            if includes:
                self.steps.append(mark)
                if self.sections:
                    self.sections[-1] = (self.sections[-1][0], True)
            else:
                n = sum(s[1][0] for s in self.steps[at:] if s[0] in ("segments", "seen"))
                del self.steps[at:]
                self._count("seen", n)
        elif kind == "include":
            self.sections = [(at, True) for at, _ in self.sections]
            self.steps.append(mark)
        elif kind in ("speaker", "condition"):
            at = self._here(kind)
            if at is not None:
                self.steps[at] = mark
            else:
                self.steps.append(mark)
        elif kind != "comment":
            # what an included corpus sets stays with the section that includes it, so a corpus is kept even if it ends here
            self.steps.append(mark)


class State:
    """The sections around a place: each ``[kind, name, speaker, condition]``; the recording's segments so far and their numeric names; all segments so far."""

    def __init__(self, frames: list[list] | None = None):
        self.frames, self.number, self.taken, self.seen, self.audio = frames or [], 0, set(), 0, None

    def copy(self) -> State:
        other = State()
        seen = {id(f): list(f) for f in self.frames}
        other.frames = [seen[id(f)] for f in self.frames]
        other.number, other.taken, other.seen, other.audio = self.number, set(self.taken), self.seen, self.audio
        return other

    def path(self, kinds: tuple[str, ...] = _SECTIONS) -> str:
        names, known = [], set()
        for f in self.frames:
            if id(f) not in known and f[0] in kinds:
                known.add(id(f))
                names.append(f[1])
        return "/".join(names)

    def nearest(self, field: int) -> str | None:
        return next((f[field] for f in reversed(self.frames) if f[field] is not None), None)

    def take(self, step: tuple) -> None:
        kind = step[0]
        if kind == "open":
            name = step[2].get("name")
            if step[1] == "corpus" and self.frames:  # an included file continues the section that includes it
                if name != self.frames[-1][1]:
                    raise ValueError(f"the included corpus is named {name!r} instead of {self.frames[-1][1]!r}")
                self.frames.append(self.frames[-1])
            else:
                self.frames.append([step[1], name if name is not None else _ANONYMOUS, None, None])
            if step[1] == "recording":
                self.number, self.taken, self.audio = 0, set(), step[2].get("audio")
        elif kind == "close" and self.frames:
            self.frames.pop()
        elif kind in ("speaker", "condition") and self.frames:
            self.frames[-1][2 if kind == "speaker" else 3] = f"{self.path()}/{_ANONYMOUS}" if step[1] is None else step[1]
        elif kind == "segments":
            self.number += step[1][0]
            self.seen += step[1][0]
            self.taken |= step[2]
        elif kind == "seen":
            self.seen += step[1][0]

    def segment(self, found: dict) -> tuple[str, int]:
        """The name and number from 0 of the next segment."""
        name, number = found["attributes"].get("name"), self.number
        self.number, self.seen = number + 1, self.seen + 1
        if name is None:
            name = _named(number + 1, self.taken)
        if _NUMERIC.match(name):
            self.taken.add(name)
        return name, number


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "</segment>").text(paths)
    # what the separator took away is put back; behind the last segment it is one too many and harmless
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("</segment>")).alias("value"))


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The records of each split, as they come."""
    rows = ((f, b, v) for batch in batches for f, b, v in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True))
    ahead: list[tuple] = []

    def records(key: tuple[str, int]) -> Iterator[str]:
        while ahead and ahead[0][:2] == key:
            yield ahead.pop()[2]
            ahead.extend(row for row in [next(rows, None)] if row is not None)

    ahead.extend(row for row in [next(rows, None)] if row is not None)
    while ahead:
        key = ahead[0][:2]
        own = records(key)
        yield key, own
        for _ in own:  # what was not read
            pass


def _effects(spark: SparkSession, paths: list[str]) -> dict[str, list]:
    """For each file its splits in order: ``(block, effect from plain text, effect from inside a comment)``; a row for each split comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), records in _by_split(batches):
            effects, ends = [Effect(), Effect()], [False, True]
            held: list[str] = []
            outside = _watched(records, held)
            for mark in marks(outside):
                effects[0].take(mark)
                ends[0] = mark[1] if mark[0] == "comment" else ends[0]
            if held:
                for mark in marks(iter(held), True):
                    effects[1].take(mark)
                    ends[1] = mark[1] if mark[0] == "comment" else ends[1]
            raw = pickle.dumps([(e.steps, end) for e, end in zip(effects, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([raw], pa.binary())], names=["file", "block", "effects"])

    out = defaultdict(list)
    for row in _records(spark, paths).mapInArrow(run, "file string, block long, effects binary").collect():
        out[row.file].append((row.block, *pickle.loads(bytes(row.effects))))
    return {f: sorted(x, key=lambda s: s[0]) for f, x in out.items()}


def _watched(records: Iterator[str], held: list[str]) -> Iterator[str]:
    """Hand records on; keep them if the split might begin inside a comment: its first comment mark is an end."""
    undecided = True
    for record in records:
        if undecided:
            begin, end = record.find("<!--"), record.find("-->")
            if end >= 0 and (begin < 0 or end < begin):
                undecided = False
                held.append(record)
            elif begin >= 0:
                undecided = False
        elif held:
            held.append(record)
        yield record


class Entry:
    """How a split begins: the state, whether in a comment, and the states after the files that it includes."""

    def __init__(self, state: State, in_comment: bool):
        self.state, self.in_comment, self.after = state, in_comment, []


def entries(spark: SparkSession, path: str) -> tuple[list[str], dict[tuple[str, int], list[Entry]]]:
    """All files that are read, and for each of their splits how it begins: once for each place that includes its file."""
    effects = _effects(spark, [path])
    included: set[str] = set()
    while True:
        named = {_resolved(f, step[1]) for f, splits in effects.items() for _, *both in splits for steps, _ in both for step in steps if step[0] == "include"}
        included |= named
        if not (new := sorted(named - set(effects))):
            break
        effects |= _effects(spark, new)
        if lost := set(new) - set(effects):
            raise FileNotFoundError(sorted(lost)[0])
    begins: dict[tuple[str, int], list[Entry]] = defaultdict(list)

    def follow(file: str, state: State, around: tuple[str, ...]) -> None:
        if file in around:
            raise ValueError(f"{file} includes itself")
        in_comment = False
        for block, *both in effects.get(file, []):
            entry = Entry(state.copy(), in_comment)
            begins[file, block].append(entry)
            steps, in_comment = both[in_comment]
            for step in steps:
                if step[0] == "include":
                    follow(_resolved(file, step[1]), state, (*around, file))
                    entry.after.append(state.copy())
                else:
                    state.take(step)

    seen = 0
    for file in sorted(effects):
        if file not in included:
            state = State()
            state.seen = seen
            follow(file, state, ())
            seen = state.seen
    if lost := [f for f, splits in effects.items() if any((f, s[0]) not in begins for s in splits)]:
        raise ValueError(f"{sorted(lost)[0]} includes itself, by way of others perhaps")
    return sorted(effects), dict(begins)


def _resolved(file: str, include: str | None) -> str:
    """The place of an included file, which is relative to the file that includes it."""
    if not include:
        raise ValueError(f"an include without a file in {file}")
    if re.match(r"[a-z][a-z0-9+.-]*:", include):
        return include
    base = urlsplit(file)
    place = posixpath.normpath(posixpath.join(posixpath.dirname(base.path), include))
    return file[: len(file) - len(base.path)] + place


SCHEMA = "kind string, name string, recording_id string, corpus_id string, audio string, i int, seq long, start string, end string, track string, speaker_id string, condition_id string, orth string, left_orth string, right_orth string"


def sections(spark: SparkSession, path: str) -> DataFrame:
    """A row for each segment (``kind`` segment) and recording (``kind`` recording), as ``SCHEMA`` says; full names begin with the outermost corpus."""
    files, begins = entries(spark, path)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"i": pa.int32(), "seq": pa.int64()}
    inside = ("corpus", "subcorpus")

    def rows(records: Iterator[str], entry: Entry) -> Iterator[tuple]:
        state, after = entry.state.copy(), iter(entry.after)
        for mark in marks(records, entry.in_comment):
            if mark[0] == "segment":
                found = mark[1]
                name, i = state.segment(found)
                own = lambda c, field: f"{state.path()}/{name}/{_ANONYMOUS}" if found.get(c) == _ANONYMOUS else found.get(c) or state.nearest(field)  # noqa: B023, E731
                a = found["attributes"]
                yield ("segment", name, state.path(), state.path(inside), state.audio, i, state.seen - 1, a.get("start"), a.get("end"), a.get("track"), own("speaker", 2), own("condition", 3), found.get("orth"), found.get("left-context-orth"), found.get("right-context-orth"))
            elif mark[0] == "include":
                state = next(after).copy()
            elif mark[0] != "comment":
                state.take(mark)
                if mark[:2] == ("open", "recording"):
                    yield ("recording", state.frames[-1][1], state.path(), state.path(inside), state.audio, *[None] * 10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, records in _by_split(batches):
            places = begins.get(key, [])
            if len(places) > 1:  # a file that is included more than once
                records = list(records)
            for entry in places:
                held: list[tuple] = []
                for row in rows(iter(records), entry):
                    held.append(row)
                    if len(held) == 2000:
                        yield _as_batch(held, names, kinds)
                        held = []
                if held:
                    yield _as_batch(held, names, kinds)

    return _records(spark, files).mapInArrow(run, SCHEMA)


def _as_batch(rows: list[tuple], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
