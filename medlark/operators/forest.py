"""Random forests on counted cells: rows whose features fall into the same bins and that have the same label are one cell with
a count, so a pass reads distinct cells, of which there may be no more than the bins allow, however many rows there are.

A bootstrap that draws each row Poisson(1) times draws a cell of n equal rows Poisson(n) times, so trees have the distribution
that they have on single rows. Features become up to BINS bins, all values of a feature that has no more, else quantiles of all
training rows; missing values count as the median. A pass takes nodes of one depth of as many trees as HISTOGRAM allows: tasks
sum their cells' draws by node, feature, bin and class, sums are met by node, where the cut of most weighted Gini gain is found,
and the driver, which holds nothing but the trees, sees a row a node. A node chooses among the root of the number of features.
Siblings that end in the same class are one leaf, and trees are averaged by their leaves' shares of class 1.

Rows: features (numbers; null and NaN are missing), label (0/1), split. Counts are whole numbers and every random choice follows
from the seed, the tree and the place of a cell in a fixed order, so reruns agree. Training rows of one class make a forest of
single leaves; a forest isn't learnt from no rows.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted import _binned, _bytes
from .graph import checkpointed

#: Bins of a feature.
BINS = 32
#: Numbers that the sums of a pass hold in a task.
HISTOGRAM = 1 << 23
#: Cells of a task, about.
CELLS = 25_000
#: Scores of cells that a task keeps, about.
KEPT = 200_000


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, the roots first: a feature below 0 is a leaf. Rows whose bin is at most `cut` go left; the right child
    comes after the left one. `value` is the share of class 1, `worth` the gain times the weight that comes to a node."""

    features: list[str]
    medians: list[float]
    cuts: list[list[float]]
    trees: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    worth: np.ndarray
    tree: np.ndarray

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with score, the probability of label 1."""
        feature, cut, left, value, trees = self.feature, self.cut, self.left, self.value, self.trees

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            seen: dict[bytes, float] = {}
            for column in batches:
                keys = column.to_pylist()
                new = [k for k in dict.fromkeys(keys) if k not in seen]
                if new:
                    b = np.frombuffer(b"".join(new), dtype=np.uint8).reshape(len(new), -1)
                    seen.update(zip(new, value[_ends(feature, cut, left, np.arange(trees), b)].mean(axis=0).tolist(), strict=True))
                yield pa.array([seen[k] for k in keys], pa.float64())
                if len(seen) > KEPT:
                    seen.clear()

        return _cells(rows, self.features, self.medians, self.cuts).withColumn("score", score("_bins")).select(*rows.columns, "score")

    def importances(self) -> list[tuple[str, float]]:
        """Share of the gain of all cuts, by feature; each tree counts as much."""
        sums = np.zeros((self.trees, len(self.features)))
        inner = self.feature >= 0
        np.add.at(sums, (self.tree[inner], self.feature[inner]), self.worth[inner])
        total = (sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        return sorted(zip(self.features, (total / max(total.sum(), 1e-300)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        facts = json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})
        spark.createDataFrame([(facts,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        d = json.loads(spark.read.parquet(path).first()["model"])
        return cls(*[d[k] for k in ("features", "medians", "cuts", "trees")], *[np.array(d[k]) for k in ("feature", "cut", "left", "value", "worth", "tree")])


def _ends(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, roots: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """roots x rows: the node that each row of bins ends in."""
    width = bins.shape[1]
    node, flat = np.repeat(roots, len(bins)), bins.ravel()
    at = np.tile(np.arange(len(bins)) * width, len(roots))
    moving = np.flatnonzero(feature[node] >= 0)
    while len(moving):
        n = node[moving]
        node[moving] = left[n] + (flat[at[moving] + feature[n]] > cut[n])
        moving = moving[feature[node[moving]] >= 0]
    return node.reshape(len(roots), len(bins))


def _clean(name: str):
    return F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double"))


def bounds(train: DataFrame, features: list[str]) -> tuple[list[float], list[list[float]]]:
    """(medians, cuts): the middles between all values of a feature of at most BINS, else quantiles. A row comes to the driver,
    and the values of features that have few."""
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    row = train.agg(*[F.struct(F.percentile_approx(_clean(c), F.lit(0.5), F.lit(10_000)), F.percentile_approx(_clean(c), at, F.lit(10_000)), F.approx_count_distinct(_clean(c))) for c in features]).first()
    medians, cuts = [], []
    for c, (median, quantiles, about) in zip(features, row, strict=True):
        medians.append(0.0 if median is None else float(median))
        values = [] if about > 2 * BINS else sorted(r[0] for r in train.select(_clean(c)).where(_clean(c).isNotNull()).distinct().limit(4 * BINS).collect())
        few = about <= 2 * BINS and len(values) <= BINS
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)] if few else sorted(set(quantiles)))
    return medians, cuts


def _cells(rows: DataFrame, features: list[str], medians: list[float], cuts: list[list[float]]) -> DataFrame:
    """rows with _bins, a byte a feature, from 1."""
    filled = {f"_filled_{k}": F.coalesce(_clean(c), F.lit(m)) for k, (c, m) in enumerate(zip(features, medians, strict=True))}
    return _binned(rows.withColumns(filled), list(filled), cuts)


def best_cuts(sums: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sums (nodes x features x bins x classes): (place among the node's features, cut, gain, left sums) of the cut of most
    Gini gain with rows on both sides, the first of equal ones; gain 0 where none gains."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums[:, :1].sum(axis=2, keepdims=True)
    right = total - left

    def mass(counts):
        w = counts * weights
        all_ = w.sum(axis=-1)
        return all_, all_ - np.divide((w**2).sum(axis=-1), all_, out=np.zeros_like(all_), where=all_ > 0)

    n, own = mass(total)
    gain = (own - mass(left)[1] - mass(right)[1]) / np.maximum(n, 1e-300)
    gain[(left.sum(axis=-1) < 1) | (right.sum(axis=-1) < 1)] = 0.0
    flat = gain.reshape(len(sums), -1)
    at = np.argmax(flat, axis=1)
    rows = np.arange(len(sums))
    place, cut = np.divmod(at, gain.shape[2])
    return place, cut + 1, flat[rows, at], left[rows, place, cut]


_SUMS = "node int, sums binary"
_FOUND = "node int, place int, cut int, gain double, c0 double, c1 double, l0 double, l1 double"


def _found(cells: DataFrame, nodes: np.ndarray, chosen: np.ndarray, facts: tuple, weights: np.ndarray, width: int, seed: int) -> dict[str, np.ndarray]:
    """Columns of _FOUND for nodes, in their order. facts: feature, cut, left and tree of all nodes; chosen: nodes x features."""
    feature, cut, left, tree = facts
    m = chosen.shape[1]
    each = m * BINS * 2
    slot = np.full(len(feature), -1)
    slot[nodes] = np.arange(len(nodes))
    trees, first, many = np.unique(tree[nodes], return_index=True, return_counts=True)

    def summed(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            bins, label, n = _bytes(b.column("bins"), width), b.column("label").to_numpy(), b.column("n").to_numpy()
            total = np.zeros(len(nodes) * each) if total is None else total
            start = zlib.crc32(bins[0].tobytes() + bytes([label[0]]))
            for t, at, k in zip(trees.tolist(), first.tolist(), many.tolist(), strict=True):
                drawn = np.random.default_rng([seed, t, start]).poisson(n)
                where = slot[_ends(feature, cut, left, np.array([t]), bins)[0]]
                used = np.flatnonzero((where >= 0) & (drawn > 0))
                where, weight, y = where[used], drawn[used], label[used]
                for j in range(m):
                    place = (((where - at) * m + j) * BINS + bins[used, chosen[where, j]] - 1) * 2 + y
                    total[at * each : (at + k) * each] += np.bincount(place, weights=weight, minlength=k * each)
        if total is not None:
            for at in range(0, len(nodes), 1000):
                part = total[at * each : (at + 1000) * each].reshape(-1, each)
                some = np.flatnonzero(part.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at + some], pa.int32()), pa.array([part[k].tobytes() for k in some], pa.binary())], names=["node", "sums"])

    def met(batches):
        def done(keys, sums):
            sums = sums.reshape(len(keys), m, BINS, 2)
            place, at, gain, l = best_cuts(sums, weights)
            own = sums[:, 0].sum(axis=1)
            columns = [pa.array(keys, pa.int32()), pa.array(place, pa.int32()), pa.array(at, pa.int32()), *[pa.array(x) for x in (gain, own[:, 0], own[:, 1], l[:, 0], l[:, 1])]]
            return pa.RecordBatch.from_arrays(columns, names=["node", "place", "cut", "gain", "c0", "c1", "l0", "l1"])

        keys, sums = np.empty(0, dtype=np.int32), np.empty((0, each))
        for b in batches:  # in the order of nodes, of which the last may go on in the next batch
            if b.num_rows:
                keys = np.concatenate([keys, b.column("node").to_numpy()])
                sums = np.concatenate([sums, np.frombuffer(b"".join(b.column("sums").to_pylist())).reshape(-1, each)])
                keys, starts = np.unique(keys, return_index=True)
                sums = np.add.reduceat(sums, starts, axis=0)
                if len(keys) > 1:
                    yield done(keys[:-1], sums[:-1])
                    keys, sums = keys[-1:], sums[-1:]
        if len(keys):
            yield done(keys, sums)

    rows = cells.mapInArrow(summed, _SUMS).repartition("node").sortWithinPartitions("node").mapInArrow(met, _FOUND).toArrow()
    order = np.argsort(rows.column("node").to_numpy())
    return {c: rows.column(c).to_numpy()[order] for c in rows.column_names}


def fit(rows: DataFrame, features: list[str], trees: int = 500, depth: int = 20, seed: int = 42) -> Forest:
    """Learns from split 'train'; both classes of it weigh the same."""
    train = rows.where("split = 'train'")
    medians, cuts = bounds(train, features)
    cells = _cells(train, features, medians, cuts).select(F.col("_bins").alias("bins"), F.col("label").cast("int").alias("label")).groupBy("bins", "label").agg(F.count(F.lit(1)).alias("n"))
    cells = checkpointed(cells)
    counts = {r["label"]: (r["n"], r["cells"]) for r in cells.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).collect()}
    if not counts or set(counts) - {0, 1}:
        raise ValueError(f"rows by label: {counts}")
    n, width = sum(v[0] for v in counts.values()), len(features)
    weights = np.array([n / (2.0 * max(counts.get(k, (0, 0))[0], 1)) for k in (0, 1)])
    cells = checkpointed(cells.repartition(-(-sum(v[1] for v in counts.values()) // CELLS), "bins", "label").sortWithinPartitions("bins", "label"))
    m = math.ceil(math.sqrt(width))
    share = lambda c0, c1: np.divide(weights[1] * c1, weights[0] * c0 + weights[1] * c1, out=np.zeros_like(c0), where=c0 + c1 > 0)
    feature, cut, left, tree = np.full(trees, -1), np.zeros(trees, dtype=int), np.zeros(trees, dtype=int), np.arange(trees)
    value, worth = np.full(trees, weights[1] * counts.get(1, (0, 0))[0] / n), np.zeros(trees)
    open_ = np.arange(trees)
    for level in range(depth):
        rng, new = np.random.default_rng([seed, level]), []
        chosen = np.sort(np.argsort(rng.random((len(open_), width)), axis=1)[:, :m], axis=1)
        step = max(1, HISTOGRAM // (m * BINS * 2))
        known = (feature.copy(), cut.copy(), left.copy(), tree.copy())
        position = np.full(len(feature), -1)
        position[open_] = np.arange(len(open_))
        for at in range(0, len(open_), step):
            found = _found(cells, open_[at : at + step], chosen[at : at + step], known, weights, width, seed)
            node, gain, c0, c1, l0, l1 = (found[c] for c in ("node", "gain", "c0", "c1", "l0", "l1"))
            value[node] = share(c0, c1)
            go = gain > 1e-12
            node, k = node[go], len(feature)
            if not len(node):
                continue
            # of a node's children the left one comes first
            sides = np.stack([np.stack([l0[go], l1[go]], 1), np.stack([c0[go] - l0[go], c1[go] - l1[go]], 1)], 1).reshape(-1, 2)
            feature[node] = chosen[position[node], found["place"][go]]
            cut[node], left[node], worth[node] = found["cut"][go], k + 2 * np.arange(len(node)), gain[go] * (weights[0] * c0[go] + weights[1] * c1[go])
            more = 2 * len(node)
            feature, cut, left, worth = (np.concatenate([x, np.full(more, v, dtype=x.dtype)]) for x, v in ((feature, -1), (cut, 0), (left, 0), (worth, 0.0)))
            tree, value = np.concatenate([tree, np.repeat(tree[node], 2)]), np.concatenate([value, share(sides[:, 0], sides[:, 1])])
            new.append(k + np.flatnonzero((sides > 0).all(axis=1)))
        open_ = np.concatenate(new) if new else np.empty(0, dtype=int)
        # nodes of a tree stand together, so that a pass takes few trees
        open_ = open_[np.argsort(tree[open_], kind="stable")]
        if not len(open_):
            break
    for node in np.flatnonzero(feature >= 0)[::-1]:  # children before their parents
        a, b = left[node], left[node] + 1
        if feature[a] < 0 and feature[b] < 0 and (value[a] > 0.5) == (value[b] > 0.5):
            feature[node], worth[node] = -1, 0.0
    return Forest(list(features), medians, cuts, trees, feature, cut, left, value, worth, tree)
