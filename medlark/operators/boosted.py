"""Gradient-boosted trees on distributed histograms: second-order gains, best-first growth to a number of leaves, row and column
subsampling, and a stop by validation AUC.

Features become bins once (at most 255 cuts of the training rows' quantiles, and a bin for missing values), a byte each. For a
tree, tasks sum gradients and curvatures of their rows by node, feature and bin; sums are met by node and feature, where the
best cut is found, so the driver sees a row a node and feature and holds nothing but trees. A pass expands all leaves that the
growth may still want, up to the leaves that are left, so a tree takes about as many passes as it is deep; which of them are
used is decided best first. A row's margin is carried in the table and written anew every REFRESH trees.

Rows: an id, label (0/1), split, features (numbers; null and NaN are missing, and go to the better side of each cut). Cuts are
tried in order of feature and bin, and the first of equal gains counts, so reruns agree. Training rows of one class, or no
validation rows where AUC should stop, fail. An empty table scores to an empty one.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate as EV

#: Bins of a feature: the first is that of missing values.
BINS = 256
#: Trees after which margins are written anew.
REFRESH = 16


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    leaves: int = 31
    depth: int = 0
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    ridge: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 0.0
    patience: int = 30
    seed: int = 42

    def __post_init__(self):
        if min(self.rounds, self.patience) < 1 or self.leaves < 2 or not 0 < self.rows <= 1 or not 0 < self.columns <= 1 or self.rate <= 0 or self.ridge < 0:
            raise ValueError(f"out of range: {self}")


@dataclass
class Tree:
    """Nodes in the order they were made, the root first: a feature below 0 is a leaf. Rows whose bin is at most `cut` go left,
    missing ones where `missing` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    #: Curvatures of the training rows that come to each node.
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing: bool, gain: float) -> int:
        """The number of the left child; the right one comes after it."""
        k = len(self.feature)
        self.feature[node], self.cut[node], self.missing[node], self.left[node], self.gain[node] = feature, cut, missing, k, gain
        for values, v in ((self.feature, -1), (self.cut, 0), (self.missing, False), (self.left, 0), (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
            values += [v, v]
        return k

    def paths(self) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, bool, bool]]]]]]:
        """For each leaf its value, and for each feature on its way the share of rows that goes that way whatever the feature is,
        and the conditions (cut, missing rows to the left, left) on it."""
        out, todo = [], [(0, {})]
        while todo:
            n, way = todo.pop()
            if self.feature[n] < 0:
                out.append((self.value[n], way))
                continue
            f = self.feature[n]
            for child, is_left in ((self.left[n], True), (self.left[n] + 1, False)):
                share, conditions = way.get(f, (1.0, []))
                part = self.cover[child] / self.cover[n] if self.cover[n] else 0.5
                todo.append((child, {**way, f: (share * part, [*conditions, (self.cut[n], self.missing[n], is_left)])}))
        return out

    def attributions(self, bins: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean of the tree over its rows, rows x features): exact Shapley values of the game in which a feature that isn't known
        lets rows go both ways by their shares. A leaf is a product over the features on its way, so its values come from the
        coefficients of a polynomial in the number of known ones."""
        out, mean = np.zeros(bins.shape), 0.0
        for value, way in self.paths():
            features, k = list(way), len(way)
            zero = np.array([way[f][0] for f in features])
            mean += value * zero.prod()
            one = np.ones((len(bins), k))
            for j, f in enumerate(features):
                b = bins[:, f]
                for cut, missing, left in way[f][1]:
                    one[:, j] *= np.where(b == 0, missing, b <= cut) == left
            weights = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]
            for i, f in enumerate(features):
                poly = np.zeros((len(bins), k))
                poly[:, 0] = 1.0
                for j in range(k):
                    if j != i:
                        poly[:, 1:] = poly[:, 1:] * zero[j] + poly[:, :-1] * one[:, [j]]
                        poly[:, 0] *= zero[j]
                out[:, f] += value * (one[:, i] - zero[i]) * (poly @ weights)
        return mean, out

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in; bins: rows x features."""
        feature, cut, missing, left = (np.array(x) for x in (self.feature, self.cut, self.missing, self.left))
        node = np.zeros(len(bins), dtype=np.int64)
        moving = np.flatnonzero(feature[node] >= 0)
        while len(moving):
            at = node[moving]
            b = bins[moving, feature[at]]
            goes = np.where(b == 0, missing[at], b <= cut[at])
            node[moving] = left[at] + ~goes
            moving = moving[feature[node[moving]] >= 0]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass(frozen=True)
class Model:
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    base: float
    history: list[float]

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with score, the probability of label 1."""
        binned, trees, base = _binned(rows, self.features, self.cuts), self.trees, self.base

        @F.arrow_udf("double")
        def score(bins: pa.Array) -> pa.Array:
            b = _bytes(bins, len(self.features))
            return pa.array(1 / (1 + np.exp(-(base + sum((t.values(b) for t in trees), np.zeros(len(b)))))))

        return binned.withColumn("score", score("_bins")).select(*rows.columns, "score")

    def contributors(self, rows: DataFrame, top: int = 5) -> DataFrame:
        """rows with base (the mean margin) and contributors: the `top` features of largest share in the row's margin beside it, as
        (feature, value), and `rest`, the sum of all others: base, values and rest are the margin."""
        binned, names = _binned(rows, self.features, self.cuts), self.features
        trees, start = self.trees, self.base

        @F.arrow_udf("struct<base: double, contributors: array<struct<feature: string, value: double>>, rest: double>")
        def explain(bins: pa.Array) -> pa.Array:
            b = _bytes(bins, len(names))
            base, total = start, np.zeros(b.shape)
            for t in trees:
                mean, part = t.attributions(b)
                base, total = base + mean, total + part
            order = np.argsort(-np.abs(total), axis=1, kind="stable")[:, :top]
            chosen = np.take_along_axis(total, order, axis=1)
            listed = [[{"feature": names[f], "value": v} for f, v in zip(fs, vs, strict=True)] for fs, vs in zip(order.tolist(), chosen.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())]))
            return pa.StructArray.from_arrays([pa.array(np.full(len(b), base)), pa.array(listed, kind), pa.array(total.sum(axis=1) - chosen.sum(axis=1))], names=["base", "contributors", "rest"])

        return binned.withColumn("_x", explain("_bins")).select(*rows.columns, "_x.base", "_x.contributors", "_x.rest")

    def importances(self) -> list[tuple[str, float]]:
        """Share of the gain of all cuts, by feature."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
        return sorted(zip(self.features, (total / max(total.sum(), 1e-300)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        facts = json.dumps({"features": self.features, "cuts": self.cuts, "base": self.base, "history": self.history, "trees": [vars(t) for t in self.trees]})
        spark.createDataFrame([(facts,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        d = json.loads(spark.read.parquet(path).first()["model"])
        return cls(d["features"], d["cuts"], [Tree(**t) for t in d["trees"]], d["base"], d["history"])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def cut_points(train: DataFrame, features: list[str]) -> list[list[float]]:
    """Up to 254 distinct quantiles of each feature; a row comes to the driver. Quantiles are exact to one in 10,000 ranks."""
    at = F.array(*[F.lit((k + 1) / (BINS - 1)) for k in range(BINS - 2)])
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = train.agg(*[F.percentile_approx(clean(c), at, F.lit(10_000)) for c in features]).first()
    return [sorted(set(v)) if v else [] for v in row]


def _binned(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    """rows with _bins, a byte a feature: 0 if missing, else 1 and the number of cuts below the value."""
    arrays = [np.array(c) for c in cuts]

    @F.arrow_udf("binary")
    def bins(*columns: pa.Array) -> pa.Array:
        out = np.empty((len(columns[0]), len(columns)), dtype=np.uint8)
        for k, c in enumerate(columns):
            v = c.fill_null(math.nan).to_numpy(zero_copy_only=False)
            out[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(arrays[k], v, side="left"))
        return pa.array([r.tobytes() for r in out], pa.binary())

    return rows.withColumn("_bins", bins(*[F.col(c).cast("double") for c in features]))


def _drawn(ids: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Whether each row takes part in a tree: by a hash of its id."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


_BEST = "node int, feature int, cut int, missing boolean, gain double, g double, h double"


def best_cut(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[int, bool, float] | None:
    """(cut, missing rows to the left, gain) of sums by bin, or none that gains."""
    own = g.sum() ** 2 / (h.sum() + s.ridge)
    best = None
    for missing in (False, True):
        gl, hl = np.cumsum(g[1:])[:-1] + (g[0] if missing else 0), np.cumsum(h[1:])[:-1] + (h[0] if missing else 0)
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = (gl**2 / (hl + s.ridge) + gr**2 / (hr + s.ridge) - own) / 2
        gain[(hl < s.least_weight) | (hr < s.least_weight)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > max(s.least_gain, 1e-12) and (best is None or gain[k] > best[2] + 1e-12):
            best = (k + 1, missing, float(gain[k]))
        if not g[0] and not h[0]:
            break
    return best


def _best(table: DataFrame, tree: Tree, nodes: list[int], features: list[int], waiting: list[Tree], number: int, s: Settings) -> dict[int, tuple]:
    """For each node: (gain, feature, cut, missing, sum of gradients, of curvatures) of its best cut, gain 0 if there is none."""
    at = np.full(len(tree.feature), -1)
    at[nodes] = np.arange(len(nodes))
    width = table.schema["bins"].metadata["width"]

    def sums(batches):
        total = np.zeros((2, len(nodes), len(features), BINS))
        some = False
        for b in batches:
            bins = _bytes(b.column("bins"), width)
            where = at[tree.leaf_of(bins)]
            used = (where >= 0) & _drawn(b.column("id").to_numpy(), s.seed, number, s.rows)
            bins, where, label = bins[used], where[used], b.column("label").to_numpy()[used]
            if len(bins):
                some = True
                margin = b.column("margin").to_numpy()[used] + sum((t.values(bins) for t in waiting), np.zeros(len(bins)))
                p = 1 / (1 + np.exp(-margin))
                for k, f in enumerate(features):
                    place = where * BINS + bins[:, f]
                    for j, w in enumerate((p - label, p * (1 - p))):
                        total[j, :, k] += np.bincount(place, weights=w, minlength=len(nodes) * BINS).reshape(len(nodes), BINS)
        part = TaskContext.get().partitionId()
        if some:
            for n in range(len(nodes)):
                m = len(features)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[n]] * m, pa.int32()), pa.array(features, pa.int32()), pa.array([part] * m, pa.int32()), pa.array([x.tobytes() for x in total[0, n]], pa.binary()), pa.array([x.tobytes() for x in total[1, n]], pa.binary())], names=["node", "feature", "part", "g", "h"])

    def met(batches):
        key, g, h = None, None, None

        def done():
            found = best_cut(g, h, s)
            row = (*key, *(found or (0, False, 0.0)), float(g.sum()), float(h.sum()))
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=kinds)

        for b in batches:
            for n, f, x, y in zip(*[b.column(c).to_pylist() for c in ("node", "feature", "g", "h")], strict=True):
                if (n, f) != key:
                    if key is not None:
                        yield done()
                    key, g, h = (n, f), np.zeros(BINS), np.zeros(BINS)
                g += np.frombuffer(x)
                h += np.frombuffer(y)
        if key is not None:
            yield done()

    names = ["node", "feature", "cut", "missing", "gain", "g", "h"]
    kinds = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("missing", pa.bool_()), ("gain", pa.float64()), ("g", pa.float64()), ("h", pa.float64())])
    parts = table.where("train").mapInArrow(sums, "node int, feature int, part int, g binary, h binary")
    rows = parts.repartition("node", "feature").sortWithinPartitions("node", "feature", "part").mapInArrow(met, _BEST).collect()
    out: dict[int, tuple] = {}
    for r in sorted(rows, key=lambda r: (r["node"], r["feature"])):  # the first of equal gains
        if r["node"] not in out or r["gain"] > out[r["node"]][0] + 1e-12:
            out[r["node"]] = (r["gain"], r["feature"], r["cut"], r["missing"], r["g"], r["h"])
    return out


def _grown(table: DataFrame, waiting: list[Tree], number: int, width: int, s: Settings) -> Tree | None:
    """A tree, best first, or none if nothing gains."""
    rng = np.random.default_rng([s.seed, number])
    features = sorted(rng.choice(width, max(1, round(s.columns * width)), replace=False).tolist())
    # what was looked at, which may be more than what is used: children are known before their parent is chosen
    seen, known, depth = Tree(), {}, {0: 0}
    known |= _best(table, seen, [0], features, waiting, number, s)
    if not known:
        return None
    while True:
        leaves, used = [0], []
        missing_children = False
        while len(leaves) < s.leaves:
            can = [n for n in leaves if n in known and known[n][0] > 0 and not (s.depth and depth[n] >= s.depth)]
            if not can:
                break
            n = max(can, key=lambda n: (known[n][0], -n))
            if seen.feature[n] < 0:
                missing_children = True
                break
            used.append(n)
            leaves = [x for x in leaves if x != n] + [seen.left[n], seen.left[n] + 1]
        if not missing_children:
            break
        # one pass for all leaves that may still be chosen, the best of them as many as there are leaves left
        open_ = sorted((n for n in leaves if n in known and known[n][0] > 0 and seen.feature[n] < 0 and not (s.depth and depth[n] >= s.depth)), key=lambda n: (-known[n][0], n))[: s.leaves - len(leaves)]
        new = []
        for n in open_:
            k = seen.split(n, *known[n][1:4], known[n][0])
            depth[k] = depth[k + 1] = depth[n] + 1
            new += [k, k + 1]
        known |= _best(table, seen, new, features, waiting, number, s)
    # the tree of the chosen cuts alone
    out, at = Tree(), {0: 0}
    for n in used:
        k = out.split(at[n], seen.feature[n], seen.cut[n], seen.missing[n], seen.gain[n])
        at[seen.left[n]], at[seen.left[n] + 1] = k, k + 1
    for n, k in at.items():
        out.cover[k] = known[n][5] if n in known else 0.0
    for n in leaves:
        g, h = known[n][4:] if n in known else (0.0, 0.0)
        out.value[at[n]] = -s.rate * g / (h + s.ridge)
    return out


def _with_margins(table: DataFrame, trees: list[Tree]) -> DataFrame:
    width = table.schema["bins"].metadata["width"]

    @F.arrow_udf("double")
    def margin(bins: pa.Array, before: pa.Array) -> pa.Array:
        b = _bytes(bins, width)
        return pa.array(before.to_numpy() + sum((t.values(b) for t in trees), np.zeros(len(b))))

    return table.withColumn("margin", margin("bins", "margin"))


def fit(rows: DataFrame, features: list[str], work: str, settings: Settings = Settings(), id: str = "report") -> Model:  # noqa: B008
    """Learns from split 'train'; validation AUC stops after `patience` rounds without a better one, and the trees up to the
    best round are kept. `work` is a shared folder for the binned table."""
    from .quality import require_no_targets

    require_no_targets(features)
    spark, s, width = rows.sparkSession, settings, len(features)
    used = rows.where("split in ('train', 'validation')")
    counts = {r["split"]: (r["n"], r["p"]) for r in used.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("int")).alias("p")).collect()}
    n, positives = counts.get("train", (0, 0))
    if not positives or positives == n or "validation" not in counts:
        raise ValueError(f"rows and positives by split: {counts}")
    cuts = cut_points(used.where("split = 'train'"), features)
    base = math.log(positives / (n - positives))
    table = _binned(used, features, cuts).select(F.xxhash64(id).alias("id"), (F.col("split") == "train").alias("train"), F.col("label").cast("double").alias("label"), F.col("_bins").alias("bins", metadata={"width": width}), F.lit(base).alias("margin"))
    at = f"{work}/rows-0"
    table.write.mode("overwrite").parquet(at)

    def read(path: str) -> DataFrame:
        t = spark.read.parquet(path)
        return t.select("id", "train", "label", F.col("bins").alias("bins", metadata={"width": width}), "margin")

    table, trees, waiting, history, best = read(at), [], [], [], 0
    for k in range(s.rounds):
        tree = _grown(table, waiting, k, width, s)
        if tree is None or len(tree.feature) == 1:
            break
        trees.append(tree)
        waiting.append(tree)
        auc = EV.auc(_with_margins(table.where("not train"), waiting).select(F.col("label").cast("int").alias("label"), F.col("margin").alias("score"))).first()["auc"]
        history.append(-1.0 if auc is None else float(auc))
        if history[-1] > history[best] + 1e-9:
            best = k
        if k - best >= s.patience:
            break
        if len(waiting) == REFRESH:
            at = f"{work}/rows-{k + 1}"
            _with_margins(table, waiting).write.mode("overwrite").parquet(at)
            table, waiting = read(at), []
    return Model(list(features), cuts, trees[: best + 1], base, history)
