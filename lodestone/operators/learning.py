"""Learning to rank by boosted trees on lambda gradients, and the training rows for it."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise
from .retrieval import top_k


#: Pairs of cells that are held at once, 8 bytes each in a handful of arrays.
PAIRS = 1 << 20


def lambda_gradients(label: np.ndarray, score: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of a query's documents: over all pairs of different labels, the pull of the better one
    up, by how wrong their order is and by the nDCG that swapping them would change.

    Documents of one score and label form a cell. A pair's order and gain follow from its two cells, and as discounts
    fall with the rank, their differences add up to a count times one's own discount less a sum; so cells meet,
    in blocks of PAIRS, not documents. Only within a score the ranks tell who comes first: there running sums serve.
    """
    n = len(label)
    gain = np.exp2(label) - 1
    order = np.lexsort((np.arange(n), -score))
    discount = 1 / np.log2(np.arange(n) + 2.0)
    best = np.sort(gain)[::-1] * discount
    ideal = best[: k or n].sum()
    if ideal <= 0:
        return np.zeros(n), np.zeros(n)
    if k is not None:
        discount[k:] = 0
    levels, level = np.unique(label[order], return_inverse=True)
    gains, s = np.exp2(levels) - 1, score[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    cells, cell = np.unique(run * len(levels) + level, return_inverse=True)
    runs, kinds = np.divmod(cells, len(levels))
    held = np.stack([np.bincount(cell), np.bincount(cell, weights=discount)], axis=1)
    pulls, bends = np.empty(held.shape), np.empty(held.shape)
    step = max(1, PAIRS // len(cells))
    for at in range(0, len(cells), step):
        r, c = runs[at : at + step, None], kinds[at : at + step, None]
        up = np.sign(c - kinds)
        wrong = 1 / (1 + np.exp(np.clip(up * (s[first[r]] - s[first[runs]]), -50, 50)))
        change = np.abs(gains[c] - gains[kinds]) * np.sign(runs - r) / ideal * wrong
        pulls[at : at + step], bends[at : at + step] = (change * up) @ held, (change * (1 - wrong)) @ held
    pull, bend = (discount * x[cell, 0] - x[cell, 1] for x in (pulls, bends))
    last = np.r_[first[1:], n][run]
    for c in range(len(levels)):
        seen, mass = (np.r_[0, np.cumsum(x)] for x in (level == c, discount * (level == c)))
        i, begin = np.arange(n) + 1, first[run]
        apart = mass[i] - mass[begin] - discount * (seen[i] - seen[begin]) + discount * (seen[last] - seen[i]) - (mass[last] - mass[i])
        change = np.abs(gains[level] - gains[c]) * apart / ideal
        pull += np.sign(level - c) * change / 2
        bend += change / 4
    out = np.empty((2, n))
    out[:, order] = pull, bend
    return out[0], out[1]


def tree_expression(tree: dict, columns: list[str]) -> Column:
    """A fitted tree as an expression, so that ranking needs no vectors and stays in generated code."""
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.col(columns[tree["feature"]]) <= tree["threshold"], tree_expression(tree["left"], columns)).otherwise(tree_expression(tree["right"], columns))


def tree_nodes(model) -> dict:
    """The nodes of a fitted tree of Spark's library."""

    def walk(node) -> dict:
        if node.getClass().getSimpleName() == "LeafNode":
            return {"value": float(node.prediction())}
        split = node.split()
        return {"feature": int(split.featureIndex()), "threshold": float(split.threshold()), "left": walk(node.leftChild()), "right": walk(node.rightChild())}

    return walk(model._java_obj.rootNode())


class LambdaRanker:
    """Trees fitted one after another to the lambda gradients of the ranking so far.

    A query's gradients need its rows together, but only their numbers, labels and scores, ordered by doc_id so that
    ties in score rank alike at every run; the pairs are never held at once. Each tree is fitted by Spark's library over all rows, its leaves being sums of gradients
    over sums of curvatures, as the rows are weighted by curvature and taught gradient over curvature.
    """

    def __init__(self, columns: list[str], rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 42, at: int | None = None, trees: list[dict] | None = None):
        self.columns, self.rounds, self.depth, self.rate, self.seed, self.at = columns, rounds, depth, rate, seed, at
        self.trees = trees or []

    def score(self) -> Column:
        out = F.lit(0.0)
        for tree in self.trees:
            out = out + F.lit(self.rate) * tree_expression(tree, self.columns)
        return out

    def fit(self, rows: DataFrame) -> LambdaRanker:
        """``rows``: query_id, doc_id, label and the feature columns."""
        rate, at = self.rate, self.at
        features = VectorAssembler(inputCols=self.columns, outputCol="features")
        state = materialise(features.transform(rows.select("query_id", "doc_id", F.col("label").cast("double").alias("label"), *self.columns)).withColumn("score", F.lit(0.0)), "ranking")

        def slopes(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("doc_id", kind="stable")
            pull, bend = lambda_gradients(group["label"].to_numpy(), group["score"].to_numpy(), at)
            return pd.DataFrame({"query_id": group["query_id"], "doc_id": group["doc_id"], "step": pull / np.maximum(bend, 1e-9), "weight": bend})

        kinds = dict(rows.dtypes)
        self.trees = []
        for i in range(self.rounds):
            steps = state.select("query_id", "doc_id", "label", "score").groupBy("query_id").applyInPandas(slopes, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, step double, weight double")
            taught = materialise(state.join(steps, ["query_id", "doc_id"]).where("weight > 0"), "slopes")
            if taught.isEmpty():
                break
            fitted = DecisionTreeRegressor(labelCol="step", featuresCol="features", weightCol="weight", maxDepth=self.depth, seed=self.seed + i).fit(taught)
            self.trees.append(tree_nodes(fitted))
            moved = materialise(state.withColumn("score", F.col("score") + F.lit(rate) * tree_expression(self.trees[-1], self.columns)), "ranking")
            discard(state, taught)
            state = moved
        discard(state)
        return self

    def rerank(self, rows: DataFrame, k: int = 100) -> DataFrame:
        """(query_id, rank, doc_id, prediction)."""
        scored = rows.select("query_id", "doc_id", F.round(self.score(), 6).alias("prediction"))
        return top_k(scored, k, score="prediction").select("query_id", "rank", "doc_id", "prediction")

    def importance(self) -> dict[str, int]:
        """How often each feature splits."""
        counts = dict.fromkeys(self.columns, 0)

        def walk(tree: dict) -> None:
            if "feature" in tree:
                counts[self.columns[tree["feature"]]] += 1
                walk(tree["left"])
                walk(tree["right"])

        for tree in self.trees:
            walk(tree)
        return counts

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "rate": self.rate, "trees": self.trees})

    @classmethod
    def from_json(cls, text: str) -> LambdaRanker:
        held = json.loads(text)
        return cls(held["columns"], rate=held["rate"], trees=held["trees"])


def training_rows(candidates: DataFrame, features: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, doc_id, label, score, features...): candidates of the first stage (query_id, doc_id, score) that are
    judged (query_id, doc_id, relevance), with their features."""
    known = candidates.select("query_id", "doc_id", "score").join(judged.select("query_id", "doc_id", F.col("relevance").alias("label")), ["query_id", "doc_id"])
    return known.join(features, ["query_id", "doc_id"])


def group_sizes(rows: DataFrame) -> DataFrame:
    """(query_id, n): how many training rows each query has."""
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
