"""Trees that grow by a plan of steps, with entropy or Gaussian gains.

A step has its own questions and limits. ``split`` takes the best split of all leaves until none is left; ``partition`` and ``cluster`` go on with the "no" side alone:
the "yes" side waits for the next step (``partition``) or is a leaf for good (``cluster``). ``max_leaves`` holds for the whole plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import _best_questions, cart_apply


@dataclass
class Step:
    questions: dict[str, Column]
    action: str = "split"
    min_obs: float = 1.0
    min_gain: float = 0.0


@dataclass
class _Node:
    """A node of the tree that grows: its way from the root as a number (children 2 k and 2 k + 1)."""

    number: int
    question: Column | None = None
    children: list = field(default_factory=list)


def gaussian_cost(n: Column, v: Column, d: int, min_variance: float) -> Column:
    """Minus the log-likelihood of n vectors under their own Gaussian, by the array of d sums and d sums of squares."""
    mean = lambda i: F.try_divide(F.get(v, F.lit(i)), n)
    variances = [F.greatest(mean(i + d) - mean(i) * mean(i), F.lit(float(min_variance))) for i in range(d)]
    return 0.5 * n * (d * (1 + float(np.log(2 * np.pi))) + sum((F.ln(x) for x in variances), F.lit(0.0)))


def _gaussian_questions(placed: DataFrame, asked: int, d: int, min_obs: float, min_gain: float, min_variance: float) -> DataFrame:
    """``node, gain, question``: the best split of every node by ``placed(node, answers, n, s, q)``. Tasks add up each question's "yes" side and the node; the "no" side is the rest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for node, part in frame.groupby("node"):
                rows = np.concatenate([part["n"].to_numpy(np.float64)[:, None], np.stack(part["s"].to_list()), np.stack(part["q"].to_list())], axis=1)
                yes = np.concatenate([np.stack(part["answers"].to_list()).astype(np.float64), np.ones((len(part), 1))], axis=1)
                sums[node] = sums.get(node, 0) + yes.T @ rows
        for node, m in sums.items():
            yield pd.DataFrame({"node": node, "question": range(asked + 1), "v": m.tolist()})

    # rows of equal answers are added up before Python sees them
    total = lambda c: F.array(*(F.sum(F.get(F.col(c).cast("array<double>"), F.lit(i))) for i in range(d))).alias(c)
    alike = placed.groupBy("node", "answers").agg(F.sum(F.col("n").cast("double")).alias("n"), total("s"), total("q"))
    parts = alike.mapInPandas(run, "node int, question int, v array<double>")
    sides = parts.groupBy("node", "question").agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(2 * d + 1))).alias("yes"))
    whole = sides.filter(F.col("question") == asked).select("node", F.col("yes").alias("whole"))
    both = sides.filter(F.col("question") < asked).join(whole, "node").withColumn("no", F.zip_with("whole", "yes", lambda a, b: a - b))
    both = both.filter((F.get("yes", F.lit(0)) >= min_obs) & (F.get("no", F.lit(0)) >= min_obs) & (F.get("yes", F.lit(0)) > 0) & (F.get("no", F.lit(0)) > 0))
    cost = lambda c: gaussian_cost(F.get(c, F.lit(0)), F.slice(c, 2, 2 * d), d, min_variance)
    gains = both.select("node", "question", (cost("whole") - cost("yes") - cost("no")).alias("gain")).filter((F.col("gain") >= min_gain) & (F.col("gain") > 0))
    return gains.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "question")).alias("b")).select("node", (-F.col("b.loss")).alias("gain"), "b.question")


def grow_tree(examples: DataFrame, plan: list[Step], label: str | None = None, max_leaves: int = 256, min_variance: float = 1e-3) -> dict | int:
    """A tree for ``models.cart_apply``, leaves numbered from 0 from the "yes" side on.

    ``examples`` have a count ``n`` and either a class ``label`` (entropy gain in bits; sides weigh by their number of example rows) or arrays ``s`` and ``q`` of
    sums and sums of squares (gain of the log-likelihood of one Gaussian each, variances at least ``min_variance``). Splits gain something and leave ``min_obs`` observations on both sides;
    of equal gains the first node and question count. An undefined answer goes to "no". A job scores all nodes that the growth reaches next: about one job a level.
    """
    d = None if label is not None else len(examples.select("s").first()[0] or []) if not examples.isEmpty() else 0
    nodes: dict[int, _Node] = {1: _Node(1)}
    waiting, final = [1], set()

    def tree(leaf, k: int = 1):
        node = nodes[k]
        return {"question": node.question, "yes": tree(leaf, 2 * k), "no": tree(leaf, 2 * k + 1)} if node.question is not None else leaf(k)

    def leaves(k: int = 1) -> list[int]:
        return [*leaves(2 * k), *leaves(2 * k + 1)] if nodes[k].question is not None else [k]

    for step in plan:
        if step.action not in ("split", "partition", "cluster"):
            raise ValueError(f"unknown action {step.action}")
        asks = list(step.questions.values())
        answers = F.array(*(F.coalesce(q, F.lit(False)) for q in asks)) if asks else F.array().cast("array<boolean>")
        known: dict[int, tuple[float, int] | None] = {}
        begin, kept = list(waiting), dict(nodes)
        while True:
            # replay the step from its beginning with all gains that are known; stop where one is unknown
            nodes, open_, done, closed, unknown = dict(kept), list(begin), [], set(final), False
            while len(open_) + len(done) + len(closed) < max_leaves and asks:
                unknown = any(k not in known for k in open_)
                if unknown or not (may := [k for k in open_ if known.get(k)]):
                    break
                best = min(may, key=lambda k: (-known[k][0], k))
                nodes[best] = _Node(best, asks[known[best][1]])
                nodes[2 * best], nodes[2 * best + 1] = _Node(2 * best), _Node(2 * best + 1)
                open_.remove(best)
                open_.append(2 * best + 1)
                if step.action == "split":
                    open_.append(2 * best)
                elif step.action == "partition":
                    done.append(2 * best)
                else:
                    closed.add(2 * best)
            if not unknown:
                break
            ask = [k for k in open_ if k not in known]
            number = {k: i for i, k in enumerate(leaves())}
            name = {i: k for k, i in number.items()}
            placed = cart_apply(examples.withColumn("answers", answers), tree(number.get), "node").filter(F.col("node").isin([number[k] for k in ask]))
            if label is None:
                best_of = _gaussian_questions(placed, len(asks), d, step.min_obs, step.min_gain, min_variance)
            else:
                best_of = _best_questions(placed.select("node", label, "n", "answers"), label, step.min_obs, step.min_gain).filter("gain > 0")
            found = {name[r.node]: (r.gain, r.question) for r in best_of.collect()}  # a row for each node
            known |= {k: found.get(k) for k in ask}
        waiting, final = open_ + done, closed
    number = {k: i for i, k in enumerate(leaves())}
    return tree(number.get)
