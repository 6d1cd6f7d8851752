"""Operator 1: SentencePiece encoding and decoding by vectorised merge rounds.

The texts of a slice are cut into words that no vocabulary piece crosses. All words not met before lie in one flat
numpy array of symbols. Each round looks up the rank of every adjacent pair, takes the least rank of each word
(segmented minimum), merges its leftmost occurrences in all words at once and compacts the array, until no pair is left.

In a word of over ``LONG`` symbols a round touches only the occurrences of its least rank and their neighbours: pairs wait in a queue by rank, and
neighbours are found by links instead of compaction, so the work grows with the symbols and not with the rounds.

Merging several occurrences in one round equals the sequential algorithm unless the new piece can at once take part
in a pair of the same or a better rank; for such pieces only the leftmost occurrence is merged in that round.

Null and empty texts give no piece (an end id may follow). Rows are independent: repeated rows repeat their result,
an empty table gives an empty one, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, columns_to_batch, slices, texts_of
from .wordcache import WordCache

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
_SHIFT = 21  # a symbol is a piece id or the vocabulary size plus a code point
_EMPTY = np.int64(-1)
#: Symbols of a word from which pairs wait in a queue.
LONG = 1000


class PairTable:
    """Open-addressing hash table in numpy from a pair of symbols to the id of the merged piece."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True  # one newcomer for each slot
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, or -1."""
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != _EMPTY)]
        return out


class PieceModel:
    """A SentencePiece BPE model with byte fallback and identity normalisation, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalisation is expected")
        kinds, self.pieces = np.array([p.type for p in model.pieces]), [p.piece for p in model.pieces]
        n = self.size = len(self.pieces)
        self.dtype = np.dtype("<u2") if n <= 65536 else np.dtype("<u4")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        normal = [i for i in range(n) if kinds[i] in (1, 4, 5)]
        ids = {self.pieces[i]: i for i in normal}
        scores = -np.array([p.score for p in model.pieces], np.float64)
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        known = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else None)
        keys, values = [], []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = known(piece[:k]), known(piece[k:])
                if left is not None and right is not None:
                    keys.append(left << _SHIFT | right)
                    values.append(i)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.pairs = PairTable(keys, values)
        self.risky = np.zeros(n, bool)
        for part in (keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)):
            inner = part < n
            at = part[inner]
            self.risky[at[self.rank[values[inner]] <= self.rank[at]]] = True
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i in range(n) if kinds[i] == 6}
        self.unknown = next((i for i in range(n) if kinds[i] == 2), 0)
        self.split_words = not any(SPACE in p.lstrip(SPACE) for p in ids)
        self.split_lines = not any("\n" in p for p in ids)
        self.control = {i for i in range(n) if kinds[i] == 3}
        self.byte_ids = {i: b for b, i in self.bytes_of.items()}
        self.surface = [b"" if i in self.control else bytes([self.byte_ids[i]]) if i in self.byte_ids else " ⁇ ".encode() if kinds[i] == 2 else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_byte = kinds == 6
        self.cache = WordCache(self.encode_words)

    # words

    def words(self, text: str) -> list[str]:
        """Cut a text where no piece can cross. A word stands for one space mark and itself, or, from a line break on, for itself."""
        text = text.replace(SPACE, " ")
        if not text:
            return []
        if not self.split_words:
            return [text]
        if self.split_lines:
            spread = text.replace("\n", " \n")
            if "  " not in spread and spread[0] != " " and spread[-1] != " " and spread[0] != "\n":
                return spread.split(" ")
            found = re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)
        else:
            found = re.findall(r" +[^ ]*", " " + text)
        return [w if w[0] == "\n" else w[1:] for w in found]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of every word, as bytes, by merge rounds over one flat array."""
        marks = [w if w[:1] == "\n" and self.split_lines else SPACE * self.prefix + w.replace(" ", SPACE) for w in words]
        lengths = np.fromiter(map(len, marks), np.int64, len(marks))
        symbols = self.symbol[np.frombuffer("".join(marks).encode("utf-32-le"), np.uint32)]
        done_symbols, done_words = [], []
        word = np.repeat(np.arange(len(marks)), lengths)
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            ends = np.cumsum(lengths)
            for k in long.tolist():
                done_symbols.append(self._merge_long(symbols[ends[k] - lengths[k] : ends[k]].copy()))
                done_words.append(np.full(len(done_symbols[-1]), k))
            short = np.repeat(lengths <= LONG, lengths)
            symbols, word = symbols[short], word[short]
        merged = np.full(len(symbols), -1, np.int32)  # what each symbol makes with the next one of its word
        inner = np.flatnonzero(word[1:] == word[:-1])
        merged[inner] = self.pairs.get(symbols[inner] << _SHIFT | symbols[inner + 1])
        while len(symbols):
            ranks = np.where(merged >= 0, self.rank[merged], NO_RANK)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            open_words = least != NO_RANK
            if not open_words.all():
                keep = np.repeat(open_words, sizes)
                done_symbols.append(symbols[~keep])
                done_words.append(word[~keep])
                symbols, word, merged, ranks = symbols[keep], word[keep], merged[keep], ranks[keep]
                least, sizes = least[open_words], sizes[open_words]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            # of overlapping occurrences every other one counts, from the left
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            hit = hit[first | ~self.risky[merged[hit]]] if self.risky[merged[hit[~first]]].any() else hit
            symbols[hit] = merged[hit]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            stay = ~gone
            place = np.cumsum(stay) - 1
            hit = place[hit]
            symbols, word, merged = symbols[stay], word[stay], merged[stay]
            changed = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            merged[changed] = -1
            changed = changed[changed < len(symbols) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            merged[changed] = self.pairs.get(symbols[changed] << _SHIFT | symbols[changed + 1])
        return self._as_bytes(done_symbols, done_words, len(words))

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one long word after all rounds."""
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        merged = np.full(n, -1, np.int32)
        merged[:-1] = self.pairs.get(symbols[:-1] << _SHIFT | symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(rank: int, at: np.ndarray) -> None:
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(heap, rank)
            waiting[rank].append(at)

        def put_all(at: np.ndarray) -> None:
            at = at[merged[at] >= 0]
            if len(at):
                ranks = self.rank[merged[at]]
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(np.diff(ranks)) + 1
                for part, rank in zip(np.split(at, cuts), ranks[np.concatenate([[0], cuts])].tolist(), strict=True):
                    put(rank, part)

        put_all(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (merged[at] >= 0)]
            at = at[self.rank[merged[at]] == rank]
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping occurrences every other one counts, from the left
                every = at
                fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
                if self.risky[merged[at[0]]]:
                    # up to the first one whose new pairs, as they stand before the next one is merged, come before or with it
                    new, left, right = merged[at].astype(np.int64), before[at], after[after[at]]
                    joined = np.concatenate([[False], left[1:] == after[at[:-1]]])
                    pairs = np.concatenate([np.where(joined, new, symbols[left]) << _SHIFT | new, new << _SHIFT | symbols[np.minimum(right, n - 1)]])
                    made = np.where(np.concatenate([left >= 0, right < n]), self.pairs.get(pairs), -1)
                    soon = ((made >= 0) & (self.rank[made] <= rank)).reshape(2, -1).any(axis=0)
                    if soon[:-1].any():
                        at = at[: int(soon.argmax()) + 1]
                        put(rank, every[every > at[-1]])
            gone = after[at]
            symbols[at] = merged[at]
            alive[gone], merged[gone] = False, -1
            then = after[gone]
            after[at] = then
            inner = then < n
            before[then[inner]] = at[inner]
            left = before[at]
            changed = np.unique(np.concatenate([at, left[left >= 0]]))
            merged[changed] = -1
            changed = changed[after[changed] < n]
            merged[changed] = self.pairs.get(symbols[changed] << _SHIFT | symbols[after[changed]])
            put_all(changed)
        return symbols[alive]

    def _as_bytes(self, done_symbols: list[np.ndarray], done_words: list[np.ndarray], n: int) -> list[bytes]:
        if not done_symbols:
            return [b""] * n
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        counts = np.ones(len(symbols), np.int64)
        strange = np.flatnonzero(symbols >= self.size)
        spelled = [self._fallback(int(c)) for c in symbols[strange] - self.size]
        counts[strange] = [len(x) for x in spelled]
        ids = np.repeat(symbols, counts)
        ends = np.cumsum(counts)
        if len(strange):
            at = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in strange])
            ids[at] = np.concatenate(spelled)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(word, weights=counts, minlength=n).astype(np.int64))]) * self.dtype.itemsize
        blob = ids.astype(self.dtype).tobytes()
        cuts = bounds.tolist()
        return [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _fallback(self, code: int) -> list[int]:
        return [self.bytes_of[b] for b in chr(code).encode()] if self.bytes_of else [self.unknown]

    # documents

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        docs = [self.words(t) for t in texts]
        self.cache.learn(docs)
        return [np.frombuffer(self.cache.join(d), self.dtype) for d in docs]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Byte pieces that make no valid UTF-8 become U+FFFD, one for each byte."""
        listed = ids.tolist()
        blob = b"".join(map(self.surface.__getitem__, listed))
        start = next((i for i in listed if i not in self.control), None)
        cut = int(self.prefix and start is not None and self.pieces[start].startswith(SPACE))
        try:
            return blob.decode()[cut:]
        except UnicodeDecodeError:
            return self._decode_runs(listed)[cut:]

    def _decode_runs(self, listed: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*listed, None]:
            if i is not None and self.is_byte[i]:
                run.append(self.byte_ids[i])
                continue
            while run:
                for k in range(1, 5):
                    try:
                        out.append(bytes(run[:k]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    k = 1
                del run[:k]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, emit: Callable[[PieceModel, pa.RecordBatch, list[np.ndarray]], list] | None = None, schema: str = "doc_id long, ids array<int>", end_id: int | None = None) -> DataFrame:
    """Encode ``doc_id, text``. ``emit`` turns the ids of a slice into the columns of ``schema``; by default the id arrays."""
    bounded_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = model.encode(texts_of(part))
                if end_id is not None:
                    ids = [np.append(x, model.dtype.type(end_id)) for x in ids]
                yield columns_to_batch(arrow, emit(model, part, ids) if emit else [part.column("doc_id"), [x.tolist() for x in ids]])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digests(model: PieceModel, part: pa.RecordBatch, ids: list[np.ndarray]) -> list:
    decimal = _decimals(model.size)
    shas = [hashlib.sha256(" ".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
    texts = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids]
    return [part.column("doc_id"), [len(x) for x in ids], shas, texts]


@lru_cache(maxsize=2)
def _decimals(n: int) -> list[str]:
    return list(map(str, range(n)))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", end_id=2)
