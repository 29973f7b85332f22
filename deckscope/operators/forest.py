"""A random forest that does not depend on how rows are laid out.

Trees are independent: Spark runs one task per tree over a bounded, broadcast
sample of training rows in key order, and predictions are an Arrow-batched
function over all rows.  Bagging is a Poisson weight from a hash of the row's
key and the tree's number, so neither partitions nor retries change a tree.
A tree is a regression tree on all features: the split with the largest drop of
weighted squared error, halfway between neighbouring values, first feature
first on ties, down to pure leaves or ``max_depth``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, importance array<double>"


def poisson_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A Poisson(1) count per row from its 64-bit key hash."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):   # splitmix64's steps
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(13), 1.0)))
    return np.searchsorted(steps, u, side="right").astype(float)


def best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: np.ndarray):
    """(gain, feature, threshold) of one node, or None if no two values differ.  ``order``: the node's rows sorted by each feature, a row of them a feature."""
    xs, ws = x[np.arange(len(order))[:, None], order], w[order]
    cw, cy = np.cumsum(ws, 1), np.cumsum(ws * y[order], 1)
    total_w, total_y = cw[:, -1:], cy[:, -1:]
    cw, cy = cw[:, :-1], cy[:, :-1]
    score = np.where(xs[:, 1:] > xs[:, :-1], cy**2 / cw + (total_y - cy) ** 2 / (total_w - cw), -np.inf)
    top = score.max(initial=-np.inf)
    if np.isneginf(top):
        return None
    f, i = divmod(int(np.argmax(score >= top - 1e-12 * max(1.0, abs(top)))), score.shape[1])     # the first of equals but for rounding
    cut = (xs[f, i] + xs[f, i + 1]) / 2
    return score[f, i] - total_y[f, 0] ** 2 / total_w[f, 0], f, cut if cut < xs[f, i + 1] else xs[f, i]


def fit_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int) -> dict:
    """Node arrays of a tree (``feature`` -1: leaf; left: value <= threshold) and each feature's share of the gain."""
    feature, threshold, left, right, value = [], [], [], [], []
    gains = np.zeros(x.shape[1])
    x = np.ascontiguousarray(x.T)                                # a feature a row

    def node(rows):
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, float(np.average(y[rows], weights=w[rows])))):
            a.append(v)
        return len(feature) - 1

    rows = np.flatnonzero(w > 0)
    todo = [(node(rows), rows[np.argsort(x[:, rows], axis=1, kind="stable")], 0)] if len(rows) else []
    while todo:
        at, order, depth = todo.pop()
        rows = order[0]
        if depth >= max_depth or len(rows) < 2 or y[rows].min() == y[rows].max():
            continue
        split = best_split(x, y, w, order)
        if split is None or split[0] <= 0:
            continue
        gains[split[1]] += split[0]
        below = (x[split[1]] <= split[2])[order]                # every feature's order is cut in two, and stays in order
        low, high = order[below].reshape(len(order), -1), order[~below].reshape(len(order), -1)
        feature[at], threshold[at] = split[1], float(split[2])
        left[at], right[at] = node(low[0]), node(high[0])
        todo += [(right[at], high, depth + 1), (left[at], low, depth + 1)]
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "value": value,
            "importance": (gains / gains.sum() if gains.sum() > 0 else gains).tolist()}


def predict_rows(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Mean of the trees' leaf values for each row of ``x``."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        going = np.flatnonzero(feature[at] >= 0)
        while len(going):
            here = at[going]
            at[going] = np.where(x[going, feature[here]] <= threshold[here], left[here], right[here])
            going = going[feature[at[going]] >= 0]
        total += value[at]
    return total / max(1, len(trees))


def fit_forest(rows: DataFrame, features_col: str, label_col: str, key_hash_col: str, num_trees: int, max_depth: int, seed: int) -> tuple[list[tuple], np.ndarray]:
    """(trees, importances) of ``rows``: a bounded frame in a fixed order, which is broadcast (the caller's bound)."""
    table = rows.select(features_col, label_col, key_hash_col).toPandas()
    x = np.array(table[features_col].tolist(), float).reshape(len(table), -1)
    data = rows.sparkSession.sparkContext.broadcast((x, table[label_col].to_numpy(float), table[key_hash_col].to_numpy(np.int64)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                a, b, keys = data.value
                yield pa.RecordBatch.from_pylist([{"tree": tree, **fit_tree(a, b, poisson_weights(keys, tree, seed), max_depth)}], schema=ARROW)

    spark = rows.sparkSession
    got = spark.range(0, num_trees, 1, num_trees).selectExpr("cast(id as int) as tree").mapInArrow(fit, TREE).orderBy("tree").collect()
    trees = [tuple(np.array(r[c], t) for c, t in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float))) for r in got if r["value"]]
    return trees, np.mean([r["importance"] for r in got], axis=0) if got else np.zeros(0)


ARROW = pa.schema([("tree", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())),
                   ("right", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("importance", pa.list_(pa.float64()))])


def prediction(df: DataFrame, trees: list[tuple], features: Column) -> Column:
    """The forest's value for a column of feature arrays (trees are broadcast: at most twice the fitted rows a tree)."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def value(x: pd.Series) -> pd.Series:
        return pd.Series(predict_rows(shared.value, np.array(x.tolist(), float).reshape(len(x), -1)))

    return value(features)
