"""Ids of the ``tokenizers`` library for many texts, at the speed of a dictionary.

The words of a slice of texts are looked up by numpy over one flat byte array, by their bytes (a 128-bit digest beyond 16); the library is asked for those distinct
words that are not in the worker's store; texts are put together from the words by array gathers. The cut is made only where the pre-tokenizer of the file cannot look across, so the ids are those of the whole text.
A new word of Latin letters, perhaps with signs behind them, is two pre-tokens, which the library's own model encodes without the
rest of its pipeline; other new words go through all of it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

from .idstore import IdStore
from .shingles import hash_identities, identities

#: Begin of the UTF-8 forms of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 and following, U+205F, U+3000).
_WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
_OTHER_SPACE = np.zeros(256, bool)
_OTHER_SPACE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: Joins texts in the flat array: a line break, so words end there.
_JOINT = b"\n"
#: Letters (ASCII and Latin-1), then ASCII signs but the apostrophe, which may begin a contraction.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level files write a byte as the character of its number where that is printable, else as the next free one from 256.
_PRINTABLE = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Pre-tokens kept as strings.
MAX_PARTS = 250_000
_SPACE_SIGN, _LINE_SIGN = chr(_BYTE_SIGNS[0x20]), chr(_BYTE_SIGNS[0x0A])


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")
        special = next((t for t in spec["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])), None)
        plain = special and spec["post_processor"] is None and not re.search(r"\s", special["content"])
        pre = spec["pre_tokenizer"] or {}
        self.mode = None
        if plain and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None:
            self.mode = "byte"
        elif plain and pre.get("type") == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in pre["pretokenizers"][0]["pattern"]["Regex"]:
            self.mode = "word"  # white space only parts words and is dropped
        self.mark, self.mark_id = (special["content"], special["id"]) if self.mode else (None, None)
        self.store = IdStore(self.dtype)
        self.empty = np.zeros(0, self.dtype)
        self.parts: dict[str, bytes] = {}  # pre-tokens as the model reads them

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        if len(self.parts) > MAX_PARTS:
            self.parts.clear()
        out: list[bytes] = []
        hard: list[str] = []
        byte, known, part = self.mode == "byte", self.parts.get, self._part
        simple = _SIMPLE.fullmatch
        for w in words:
            line = byte and w[0] == "\n"
            found = simple(w, 1) if line else simple(w)
            if found is None:
                hard.append(w if line or not byte else w[1:] if w[0] == "\r" else " " + w)
                out.append(b"")
                continue
            stem, tail = found.groups()
            if not byte:
                stem = stem.lower()
            if not stem.isascii():
                stem = stem.encode().decode("latin-1").translate(_BYTE_SIGNS)
            if byte and not line:
                stem = _SPACE_SIGN + stem
            ids = known(stem) or part(stem)
            if tail:
                ids += known(tail) or part(tail)
            out.append((known(_LINE_SIGN) or part(_LINE_SIGN)) + ids if line else ids)
        if hard:
            found = iter(self._joined(hard))
            for k, ids in enumerate(out):
                if not ids:
                    out[k] = next(found)
        return out

    def _part(self, part: str) -> bytes:
        ids = self.parts[part] = array(self.dtype.char, [t.id for t in self.model.tokenize(part)]).tobytes()
        return ids

    def _joined(self, words: list[str]) -> list[bytes]:
        """Words joined by a special token, whose id parts the result again."""
        out: list[bytes] = []
        for k in range(0, len(words), 200):
            some = words[k : k + 200]
            if any(self.mark in w for w in some):
                out += self.whole(some)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, self.dtype)
            start = 0
            for end in [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]:
                out.append(ids[start:end].tobytes())
                start = end + 1
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if self.mode is None:
            return [np.frombuffer(b, self.dtype) for b in self.whole(texts)]
        raws = [t.encode() for t in texts]
        blob = _JOINT.join([*raws, b""])
        data = np.frombuffer(blob, np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        text_ends = np.cumsum(sizes + 1) - 1  # the joints
        cut = _CUT[data]
        starts = np.flatnonzero(~cut & np.concatenate([[True], cut[:-1]]))
        ends = np.flatnonzero(cut & np.concatenate([[False], ~cut[:-1]]))
        odd = np.zeros(len(raws), bool)
        if self.mode == "byte":
            odd = self._crowded(data, cut, text_ends, sizes, raws)
            # what stands before a word belongs to it: a space (kind 0), a line break (1), or nothing at the begin of a text (2)
            kinds = np.where(data[starts - 1] == 0x20, 0, 1).astype(np.uint64)
            first = np.isin(starts, text_ends - sizes)
            kinds[first] = 2
        else:
            kinds = np.zeros(len(starts), np.uint64)
        low, high = identities(data, starts, ends)
        tags = (ends - starts).astype(np.uint64) * np.uint64(4) + kinds
        words = np.stack([low, high, tags], axis=1)
        hashes = hash_identities(low, high, tags)
        bounds = np.searchsorted(starts, np.concatenate([[0], text_ends + 1]))
        if odd.any():
            used = ~np.repeat(odd, np.diff(bounds))
            starts, ends, hashes, kinds, words = starts[used], ends[used], hashes[used], kinds[used], words[used]
            bounds = np.searchsorted(starts, np.concatenate([[0], text_ends + 1]))
        if self.store.n > self.store.limit:
            self.store.clear()
        entry = self.store.get(hashes, words)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            order = missing[np.lexsort([*words[missing].T, hashes[missing]])]
            new = np.ones(len(order), bool)
            new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
            at = order[new]
            marks = ("", "\n", "\r") if self.mode == "byte" else ("",)
            self.store.add(hashes[at], words[at], self._encode_words([marks[k] + blob[a:b].decode() for k, a, b in zip(kinds[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)]))
            entry[missing] = self.store.get(hashes[missing], words[missing])
        counts = self.store.counts[entry].astype(np.int64)
        ids = gather(self.store.flat, self.store.starts[entry], counts)
        cuts = np.concatenate([[0], np.cumsum(counts)])[bounds].tolist()
        rest = iter(self.whole([t for t, o in zip(texts, odd, strict=True) if o]))
        return [np.frombuffer(next(rest), self.dtype) if o else ids[a:b] for o, a, b in zip(odd.tolist(), cuts[:-1], cuts[1:], strict=True)]

    def _crowded(self, data: np.ndarray, cut: np.ndarray, text_ends: np.ndarray, sizes: np.ndarray, raws: list[bytes]) -> np.ndarray:
        """Texts of a byte-level file to encode whole: other white space in them, or spaces and line breaks side by side or at an end."""
        odd = np.array([not r.isascii() and any(w in r for w in _WIDE_SPACES) for r in raws], bool)
        begins = text_ends - sizes
        odd |= (sizes > 0) & (cut[begins] | cut[np.maximum(text_ends - 1, 0)])
        inner = cut.copy()
        inner[text_ends] = False
        places = np.flatnonzero(_OTHER_SPACE[data] | (inner & np.concatenate([[False], inner[:-1]])))
        odd[np.searchsorted(text_ends, places)] = True
        return odd


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from each start, one after the other."""
    total = np.cumsum(counts)
    return flat[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
