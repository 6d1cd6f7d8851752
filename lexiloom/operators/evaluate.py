"""Error counts and rates between reference and hypothesis: ``ref(segment_id, ref)`` and ``hyp(segment_id, hyp)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.tables import slices


#: Cells of a cost matrix that are kept at once; longer pairs are halved.
CELLS = 1 << 20


def is_broken_match(ref: str, hyp: str) -> bool:
    """Whether a reference word that may be broken off stands for ``hyp``: a hyphen at its end or beginning is a wildcard.

    ``ab-``: the word begins with the part, and no hyphen follows there; ``-ab``: it ends with it; ``-ab-``: it holds the part, at least two bytes before its end. Bytes count.
    """
    a, b = ref.encode(), hyp.encode()
    if not a.startswith(b"-"):
        return a == b or (a.endswith(b"-") and b.startswith(a[:-1]) and not b.startswith(a))
    if a.endswith(b"-") and len(b) >= len(a) - 2 >= 0:
        return any(b.startswith(a[1:-1], k) for k in range(len(b) - len(a) + 1))
    return b.endswith(a[1:])


def _equality(number: dict[str, int], broken: bool) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which words of a row of numbers a word of the reference stands for."""
    if not broken:
        return lambda x, row: row == x
    words = list(number)
    tables = {number[w]: np.array([is_broken_match(w, v) for v in words]) for w in words if w.startswith("-") or w.endswith("-")}
    return lambda x, row: tables[x][row] if x in tables else row == x


def _last_row(a: np.ndarray, b: np.ndarray, ins: int, dele: int, sub: int, same: Callable) -> np.ndarray:
    """Costs of aligning all of ``a`` with every beginning of ``b``: two rows in memory."""
    steps = np.arange(len(b) + 1) * ins
    row = steps
    for x in a:
        best = row + dele
        best[1:] = np.minimum(best[1:], row[:-1] + np.where(same(x, b), 0, sub))
        # insertions run along the row: a running minimum without the steps
        row = np.minimum.accumulate(best - steps) + steps
    return row


def align(a: list[str], b: list[str], ins: int = 1, dele: int = 1, sub: int = 1, broken: bool = False) -> list[tuple[int, int]]:
    """Least-cost alignment as index pairs, -1 for none, by divide and conquer: halves of ``a`` meet where both cost least together.

    Within ``CELLS`` the way back is read from the matrix; of equal costs, a match or substitution comes before a deletion, that before an insertion. With ``broken``, words of ``a`` match as ``is_broken_match`` says.
    """
    number = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[w] for w in words], np.int64) for words in (a, b))
    same = _equality(number, broken)
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        lo, hi, left, right = todo.pop()
        if hi - lo < 2 or (hi - lo + 1) * (right - left + 1) <= CELLS:
            out += [(i + lo if i >= 0 else -1, j + left if j >= 0 else -1) for i, j in _small(x[lo:hi], y[left:right], ins, dele, sub, same)]
            continue
        mid = (lo + hi) // 2
        ahead = _last_row(x[lo:mid], y[left:right], ins, dele, sub, same)
        behind = _last_row(x[mid:hi][::-1], y[left:right][::-1], ins, dele, sub, same)[::-1]
        cut = left + int(np.argmin(ahead + behind))
        todo += [(mid, hi, cut, right), (lo, mid, left, cut)]
    return out


def _small(a: np.ndarray, b: np.ndarray, ins: int, dele: int, sub: int, same: Callable) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    cost = np.empty((n + 1, m + 1), np.int64)
    for i in range(n + 1):
        cost[i] = np.arange(m + 1) * ins if not i else 0
        if i:
            best = cost[i - 1] + dele
            best[1:] = np.minimum(best[1:], cost[i - 1, :-1] + np.where(same(a[i - 1], b), 0, sub))
            cost[i] = np.minimum.accumulate(best - cost[0]) + cost[0]
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (0 if same(a[i - 1], b[j - 1 : j])[0] else sub):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i, j] == cost[i - 1, j] + dele:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def edit_alignment(pairs: DataFrame, ins: int = 1, dele: int = 1, sub: int = 1, broken: bool = False) -> DataFrame:
    """``segment_id, pos, a, b, op`` from ``segment_id, ref, hyp`` (arrays of tokens); with ``broken``, parts of words in the reference match as ``is_broken_match`` says and are right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: tuple[list, ...] = ([], [], [], [], [])
            for k, (ref, hyp) in enumerate(zip(batch.column("ref").to_pylist(), batch.column("hyp").to_pylist(), strict=True)):
                for pos, (i, j) in enumerate(align(ref, hyp, ins, dele, sub, broken)):
                    a, b = ref[i] if i >= 0 else None, hyp[j] if j >= 0 else None
                    row = (k, pos, a, b, "ins" if a is None else "del" if b is None else "ok" if a == b or (broken and is_broken_match(a, b)) else "sub")
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            of, pos, *texts = columns
            yield pa.RecordBatch.from_arrays([batch.column("segment_id").take(pa.array(of, pa.int64())), pa.array(pos, pa.int32()), *(pa.array(c, pa.string()) for c in texts)], names=["segment_id", "pos", "a", "b", "op"])

    kind = pairs.schema["segment_id"].dataType.simpleString()
    return pairs.select("segment_id", "ref", "hyp").mapInArrow(run, f"segment_id {kind}, pos int, a string, b string, op string")


def word_errors(pairs: DataFrame, ins: int = 1, dele: int = 1, sub: int = 1, broken: bool = False) -> DataFrame:
    """``segment_id, n_tokens, n_ins, n_del, n_sub``; ``broken`` as in ``edit_alignment``."""
    counted = edit_alignment(pairs, ins, dele, sub, broken).filter("op <> 'ok'").groupBy("segment_id").agg(*(F.count_if(F.col("op") == o).alias(f"n_{o}") for o in ("ins", "del", "sub")))
    sized = pairs.select("segment_id", F.size("ref").cast("long").alias("n_tokens"))
    return sized.join(counted, "segment_id", "left").fillna(0)


def phoneme_errors(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Word errors of the phoneme strings: tokens are replaced by their pronunciation ``lexicon(token, phon)``, phonemes parted by blanks; tokens without one drop out."""

    def spoken(column: str) -> DataFrame:
        words = pairs.select("segment_id", F.posexplode(column).alias("i", "token")).join(lexicon.select("token", F.split("phon", " ").alias("_p")), "token")
        lined = words.groupBy("segment_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "_p"))), lambda x: x["_p"])).alias(column))
        return pairs.select("segment_id").join(lined, "segment_id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))

    return word_errors(spoken("ref").join(spoken("hyp"), "segment_id"))


def letter_distance(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(ref, hyp)


def error_rate(errors: DataFrame, by: list[str]) -> DataFrame:
    """Percent of errors overall (``level`` 1) and for each of ``by``; 100 without tokens; and the share of wrong segments."""
    wrong = F.col("n_ins") + F.col("n_del") + F.col("n_sub")
    sets = errors.groupingSets([[b] for b in by] + [[]], *by)
    out = sets.agg(F.grouping_id().alias("level"), F.sum(wrong).alias("errors"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("segments"), F.count_if(wrong > 0).alias("wrong_segments"))
    return out.withColumn("rate", F.round(F.when(F.col("tokens") > 0, 100 * F.col("errors") / F.col("tokens")).otherwise(100.0), 4)).withColumn("segment_rate", F.round(100 * F.col("wrong_segments") / F.col("segments"), 4))


def confusion_pairs(alignment: DataFrame) -> DataFrame:
    return alignment.filter("op <> 'ok'").groupBy("a", "b", "op").agg(F.count("*").alias("n"))


def normalise_for_eval(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Global mapping ``rules(word, to)`` after lower case; words mapped to the empty string go."""
    lowered = words.withColumn("word", F.lower("word"))
    return lowered.join(rules, "word", "left").withColumn("word", F.coalesce("to", "word")).drop("to").filter("word <> ''")
