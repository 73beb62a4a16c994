"""The inductive patient-drug network, trained data-parallel: two encoders (linear, layer norm, ReLU), one of a patient's own
features and one of the mean of their drugs' vectors, and a head of a hidden layer with dropout over both.

A step is a mini-batch, and an epoch is one Spark job in barrier mode: its tasks, no more than a batch has work for, get their
share of the training table sorted by step, sum the gradients of a step's rows, hand the sums to each other and take the same
AdamW step, so steps cost no jobs and a task holds the parameters and its share of a step. Where executors come and go, which a
barrier doesn't allow, a step is a job of its own: batches are parts of the written training table, sums are met in a tree, and
the driver, which holds nothing but the parameters, takes the step. Labels
of training patients alone drive it; positives weigh as much as negatives; the epoch of best validation AUC counts, and
training stops when none of the next `patience` was better. Every random choice follows from the seed, the epoch, the step and
the place of a row, so reruns agree, and a run that is resumed from its last saved state ends as one that wasn't stopped. A
state is taken up only with the same table and the same parameters.

Rows: patient_index, split, label (0/1), own and near (arrays of numbers of the same lengths in all rows). Null components count
as the mean. A split without rows, or training rows of one class, fail. Rows of other splits are scored, never learnt from.
"""

from __future__ import annotations

import io
import json
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate as EV

Params = dict[str, np.ndarray]

#: Deviations at most this count as none.
FLAT = 1e-6
#: Gradients of so many tasks are summed before they go to the driver.
FAN_IN = 64
#: Rows of a step that are worth a task of their own.
TASK_ROWS = 1024


class TrainingError(ValueError):
    """What can't be learnt from, or a saved state of something else."""


@dataclass(frozen=True)
class Settings:
    epochs: int = 100
    batch: int = 8192
    hidden: int = 64
    dropout: float = 0.2
    rate: float = 1e-3
    decay: float = 1e-4
    patience: int = 15
    seed: int = 42
    save_every: int = 5

    def __post_init__(self):
        whole = min(self.epochs, self.batch, self.hidden, self.patience, self.save_every)
        if whole < 1 or not 0 <= self.dropout < 1 or self.rate <= 0 or self.decay < 0:
            raise TrainingError(f"out of range: {self}")


def initial(own: int, near: int, hidden: int, seed: int) -> Params:
    """Weights evenly within 1 / sqrt(inputs), layer norms of 1 and 0."""
    rng = np.random.default_rng(seed)
    out: Params = {}
    for name, n, m in (("own", own, hidden), ("near", near, hidden), ("head", 2 * hidden, hidden), ("last", hidden, 1)):
        bound = 1 / np.sqrt(n)
        out[f"{name}_w"], out[f"{name}_b"] = rng.uniform(-bound, bound, (n, m)), rng.uniform(-bound, bound, m)
    for name in ("own", "near"):
        out[f"{name}_g"], out[f"{name}_s"] = np.ones(hidden), np.zeros(hidden)
    return out


def _encoded(p: Params, name: str, x: np.ndarray):
    z = x @ p[f"{name}_w"] + p[f"{name}_b"]
    scale = 1 / np.sqrt(z.var(axis=1, keepdims=True) + 1e-5)
    unit = (z - z.mean(axis=1, keepdims=True)) * scale
    return np.maximum(unit * p[f"{name}_g"] + p[f"{name}_s"], 0), unit, scale


def logits(p: Params, own: np.ndarray, near: np.ndarray) -> np.ndarray:
    both = np.concatenate([_encoded(p, "own", own)[0], _encoded(p, "near", near)[0]], axis=1)
    return (np.maximum(both @ p["head_w"] + p["head_b"], 0) @ p["last_w"] + p["last_b"])[:, 0]


def gradients(p: Params, own: np.ndarray, near: np.ndarray, label: np.ndarray, positive: float, keep: np.ndarray | None = None) -> tuple[float, Params]:
    """Sums over the rows of the weighted logistic loss and of its gradients; `keep` is the dropout's factor a row and unit."""
    hidden = p["own_b"].size
    enc = {n: _encoded(p, n, x) for n, x in (("own", own), ("near", near))}
    both = np.concatenate([enc["own"][0], enc["near"][0]], axis=1)
    h = np.maximum(both @ p["head_w"] + p["head_b"], 0)
    kept = h if keep is None else h * keep
    z = (kept @ p["last_w"] + p["last_b"])[:, 0]
    soft = np.logaddexp(0, -np.abs(z)) + np.maximum(z, 0)  # log(1 + exp(z))
    loss = float(np.sum(np.where(label == 1, positive * (soft - z), soft)))
    chance = np.exp(z - soft)
    d = np.where(label == 1, positive * (chance - 1), chance)[:, None]
    out: Params = {"last_w": kept.T @ d, "last_b": d.sum(axis=0)}
    dh = (d @ p["last_w"].T) * (1 if keep is None else keep) * (h > 0)
    out["head_w"], out["head_b"] = both.T @ dh, dh.sum(axis=0)
    back = dh @ p["head_w"].T
    for name, x, de in (("own", own, back[:, :hidden]), ("near", near, back[:, hidden:])):
        y, unit, scale = enc[name]
        de = de * (y > 0)
        out[f"{name}_g"], out[f"{name}_s"] = (de * unit).sum(axis=0), de.sum(axis=0)
        du = de * p[f"{name}_g"]
        dz = scale * (du - du.mean(axis=1, keepdims=True) - unit * (du * unit).mean(axis=1, keepdims=True))
        out[f"{name}_w"], out[f"{name}_b"] = x.T @ dz, dz.sum(axis=0)
    return loss, out


@dataclass
class State:
    """What training goes on from."""

    params: Params
    first: Params
    second: Params
    steps: int = 0
    epoch: int = 0
    best: Params = field(default_factory=dict)
    best_auc: float = -1.0
    best_epoch: int = 0
    history: list = field(default_factory=list)

    def step(self, grads: Params, rate: float, decay: float) -> None:
        """AdamW."""
        self.steps += 1
        for k, g in grads.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            m, v = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.999**self.steps)
            self.params[k] = self.params[k] * (1 - rate * decay) - rate * m / (np.sqrt(v) + 1e-8)

    def packed(self) -> bytes:
        out = io.BytesIO()
        parts = {"p": self.params, "m": self.first, "v": self.second, "b": self.best}
        facts = json.dumps([self.steps, self.epoch, self.best_auc, self.best_epoch, self.history])
        np.savez(out, facts=np.array(facts), **{f"{t}:{k}": a for t, d in parts.items() for k, a in d.items()})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> State:
        z = np.load(io.BytesIO(raw), allow_pickle=False)
        d = {t: {k[2:]: z[k] for k in z.files if k.startswith(f"{t}:")} for t in "pmvb"}
        steps, epoch, best_auc, best_epoch, history = json.loads(str(z["facts"]))
        return cls(d["p"], d["m"], d["v"], steps, epoch, d["b"], best_auc, best_epoch, history)


@dataclass(frozen=True)
class Network:
    """A trained network and the means and deviations that its inputs are brought to."""

    params: Params
    scales: dict[str, list[list[float]]]
    history: list
    best_epoch: int

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with score, the probability of label 1."""
        return _scored(_scaled(rows, self.scales), self.params).select(*rows.columns, "score")

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, facts=np.array(json.dumps([self.scales, self.history, self.best_epoch])), **self.params)
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Network:
        z = np.load(io.BytesIO(raw), allow_pickle=False)
        scales, history, best_epoch = json.loads(str(z["facts"]))
        return cls({k: z[k] for k in z.files if k != "facts"}, scales, history, best_epoch)


def _scales(train: DataFrame) -> dict[str, list[list[float]]]:
    """(means, deviations) of the components of own and near, over training rows; one row comes to the driver."""
    out = {}
    for name in ("own", "near"):
        sizes = train.agg(F.min(F.size(name)), F.max(F.size(name)), F.count_if(F.col(name).isNull())).first()
        if sizes[0] is None or sizes[0] != sizes[1] or sizes[0] < 1 or sizes[2]:
            raise TrainingError(f"{name} has {sizes[0]} to {sizes[1]} components, {sizes[2]} rows have none")
        cols = [x for k in range(sizes[0]) for x in (F.avg(F.col(name)[k].cast("double")), F.stddev_pop(F.col(name)[k].cast("double")))]
        got = [0.0 if v is None else float(v) for v in train.agg(*cols).first()]
        out[name] = [got[::2], [1.0 if s <= FLAT else s for s in got[1::2]]]
    return out


def _scaled(rows: DataFrame, scales: dict) -> DataFrame:
    put = {}
    for name, (means, deviations) in scales.items():
        m, s = F.array(*map(F.lit, means)), F.array(*map(F.lit, deviations))
        put[f"_{name}"] = F.transform(F.arrays_zip(F.col(name).alias("x"), m.alias("m"), s.alias("s")), lambda z: F.coalesce((z["x"].cast("double") - z["m"]) / z["s"], F.lit(0.0)))
    return rows.withColumns(put)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scored(scaled: DataFrame, params: Params) -> DataFrame:
    @F.arrow_udf("double")
    def score(own: pa.Array, near: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-logits(params, _matrix(own), _matrix(near))))) if len(own) else pa.array([], pa.float64())

    return scaled.withColumn("score", score("_own", "_near"))


def _summed(rows: Iterator[tuple[float, int, bytes]]) -> tuple[float, int, np.ndarray] | None:
    loss, n, total = 0.0, 0, None
    for a, b, raw in rows:
        g = np.frombuffer(raw)
        loss, n, total = loss + a, n + b, g.copy() if total is None else total + g
    return None if total is None else (loss, n, total)


def _step(batch: DataFrame, params: Params, positive: float, settings: Settings, epoch: int, step: int) -> tuple[float, int, Params]:
    """(loss, rows, mean gradients) of a batch."""
    names, hidden = sorted(params), settings.hidden
    schema = "part int, loss double, n long, g binary"

    def put(part, loss, n, g):
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "loss": pa.array([loss]), "n": pa.array([n], pa.int64()), "g": pa.array([g.tobytes()], pa.binary())})

    def run(batches):
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([settings.seed, epoch, step, part])
        loss, n, total = 0.0, 0, None
        for b in batches:
            if b.num_rows:
                keep = (rng.random((b.num_rows, hidden)) >= settings.dropout) / (1 - settings.dropout)
                a, g = gradients(params, _matrix(b.column("_own")), _matrix(b.column("_near")), b.column("label").to_numpy(), positive, keep)
                flat = np.concatenate([g[k].ravel() for k in names])
                loss, n, total = loss + a, n + b.num_rows, flat if total is None else total + flat
        if total is not None:
            yield put(part, loss, n, total)

    def add(batches):
        found = _summed(((a, n, g) for b in batches for a, n, g in zip(b.column("loss").to_pylist(), b.column("n").to_pylist(), b.column("g").to_pylist(), strict=True)))
        if found is not None:
            yield put(TaskContext.get().partitionId(), *found)

    sums = batch.select("label", "_own", "_near").mapInArrow(run, schema)
    parts = batch.rdd.getNumPartitions()
    if parts > FAN_IN:
        sums = sums.repartitionByRange(-(-parts // FAN_IN), "part").sortWithinPartitions("part").mapInArrow(add, schema)
    rows = sorted(sums.collect(), key=lambda r: r["part"])  # a row a FAN_IN of tasks
    loss, n, total = _summed(((r["loss"], r["n"], bytes(r["g"])) for r in rows))
    out, at = {}, 0
    for k in names:
        out[k] = total[at : at + params[k].size].reshape(params[k].shape) / n
        at += params[k].size
    return loss, n, out


def _slots(spark: SparkSession) -> int:
    """Tasks that run at once, as those of a barrier must; 0 where executors come and go."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    context = sc._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _by_step(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The pieces (own, near, label) of each step's rows, none where it has no rows here; batches come in the order of steps."""
    pieces, now = [], 0
    for b in batches:
        if b.num_rows:
            at, own, near, label = b.column("step").to_numpy(), _matrix(b.column("_own")), _matrix(b.column("_near")), b.column("label").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(edges, edges[1:], strict=False):
                while now < at[i]:
                    yield pieces
                    pieces, now = [], now + 1
                pieces.append((own[i:j], near[i:j], label[i:j]))
    while now < steps:
        yield pieces
        pieces, now = [], now + 1


def _together(context: BarrierTaskContext, key: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """What sums arrays over the tasks of a barrier, in the order of tasks, so that all get the same bits. The first task adds;
    the barrier's own messages take a second each, so they tell its address only."""
    part, others = context.partitionId(), len(context.getTaskInfos()) - 1
    mine, listener = "", None
    if part == 0:
        listener = Listener(("0.0.0.0", 0), backlog=others + 1, authkey=key)
        mine = f"{context.getTaskInfos()[0].address.split(':')[0]}:{listener.address[1]}"
    host, port = context.allGather(mine)[0].split(":")
    links = {}
    if listener:
        for _ in range(others):
            link = listener.accept()
            links[int.from_bytes(link.recv_bytes(), "big")] = link
        listener.close()
    else:
        links[0] = Client((host, int(port)), authkey=key)
        links[0].send_bytes(part.to_bytes(4, "big"))

    def summed(array: np.ndarray) -> np.ndarray:
        if part:
            links[0].send_bytes(array.tobytes())
            return np.frombuffer(links[0].recv_bytes())
        total = array.copy()
        for k in range(1, others + 1):
            total += np.frombuffer(links[k].recv_bytes())
        for link in links.values():
            link.send_bytes(total.tobytes())
        return total

    return summed


def _epoch(table: DataFrame, order: list[int], state: State, positive: float, settings: Settings, tasks: int) -> tuple[State, float, int]:
    """(state, loss, rows) after a step a batch, in the given order."""
    epoch, start, names, steps, key = state.epoch + 1, state.packed(), sorted(state.params), len(order), secrets.token_bytes(16)

    def run(batches):
        context = BarrierTaskContext.get()
        part, now, loss, seen = context.partitionId(), State.unpacked(start), 0.0, 0
        size, summed = sum(v.size for v in now.params.values()), _together(context, key)
        for step, pieces in enumerate(_by_step(batches, steps)):
            sums = np.zeros(2 + size)
            if pieces:
                own, near, label = (np.concatenate(x) for x in zip(*pieces, strict=True))
                rng = np.random.default_rng([settings.seed, epoch, step, part])
                keep = (rng.random((len(label), settings.hidden)) >= settings.dropout) / (1 - settings.dropout)
                a, g = gradients(now.params, own, near, label, positive, keep)
                sums = np.concatenate([[a, len(label)], *[g[k].ravel() for k in names]])
            total = summed(sums)
            loss, seen, at, mean = loss + total[0], seen + int(total[1]), 2, {}
            for k in names:
                mean[k] = total[at : at + now.params[k].size].reshape(now.params[k].shape) / total[1]
                at += now.params[k].size
            now.step(mean, settings.rate, settings.decay)
        if part == 0:
            yield pa.RecordBatch.from_pydict({"state": pa.array([now.packed()], pa.binary()), "loss": pa.array([float(loss)]), "seen": pa.array([seen], pa.int64())})

    # a row a batch
    at = F.broadcast(table.sparkSession.createDataFrame([(b, k) for k, b in enumerate(order)], "batch int, step int"))
    shares = table.join(at, "batch").repartition(tasks, "patient_index").sortWithinPartitions("step", "patient_index")
    (row,) = shares.select("step", "label", "_own", "_near").mapInArrow(run, "state binary, loss double, seen long", barrier=True).collect()
    return State.unpacked(bytes(row["state"])), row["loss"], row["seen"]


def _fingerprint(train: DataFrame, held: DataFrame) -> list[int]:
    """Sums over the rows' hashes: the same for the same rows in any order."""
    out = []
    for t in (train, held):
        n, h = t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("patient_index", "label", "own", "near").cast("decimal(20,0)"))).first()
        out += [n, int(h or 0)]
    return out


def _saved(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def fit(rows: DataFrame, work: str, settings: Settings = Settings(), resume: bool = False) -> Network:  # noqa: B008
    """Trains on split 'train', stops by split 'validation'. `work` is a shared folder: the training table in batches, and a
    state every save_every epochs, from which `resume` goes on."""
    spark = rows.sparkSession
    rows = rows.select("patient_index", "split", F.col("label").cast("int").alias("label"), "own", "near")
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    n, positives = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not positives or positives == n or held.isEmpty():
        raise TrainingError(f"{n} training rows, {positives} of them positive; validation has {'no ' if held.isEmpty() else ''}rows")
    scales = _scales(train)
    configuration = json.dumps({"rows": _fingerprint(train, held), **{k: v for k, v in vars(settings).items() if k not in ("epochs", "save_every")}}, sort_keys=True)
    batches = max(1, round(n / settings.batch))
    deal = F.pmod(F.xxhash64("patient_index", F.lit(settings.seed)), F.lit(batches)).cast("int")
    ready = _scaled(train, scales).select(deal.alias("batch"), "patient_index", "label", "_own", "_near")
    tasks = min(_slots(spark), max(1, settings.batch // TASK_ROWS))
    if tasks:
        ready.write.mode("overwrite").parquet(f"{work}/train")
    else:
        ready.repartitionByRange("batch", "patient_index").sortWithinPartitions("batch", "patient_index").write.mode("overwrite").partitionBy("batch").parquet(f"{work}/train")
    _scaled(held, scales).select("label", "_own", "_near").write.mode("overwrite").parquet(f"{work}/held")
    table, checked = spark.read.parquet(f"{work}/train"), spark.read.parquet(f"{work}/held")
    there = sorted(r["batch"] for r in table.select("batch").distinct().collect())
    start = initial(len(scales["own"][0]), len(scales["near"][0]), settings.hidden, settings.seed)
    zero = lambda: {k: np.zeros_like(v) for k, v in start.items()}
    state = State(start, zero(), zero())
    if resume:
        found = _saved(spark, f"{work}/states")
        last = None if found is None else found.orderBy(F.desc("epoch")).first()
        if last is None:
            raise TrainingError("there is no saved state")
        if last["configuration"] != configuration:
            raise TrainingError("the saved state is of another graph or other parameters")
        state = State.unpacked(bytes(last["state"]))
    while state.epoch < settings.epochs and state.epoch - state.best_epoch < settings.patience:
        epoch, loss, seen = state.epoch + 1, 0.0, 0
        order = np.random.default_rng([settings.seed, epoch]).permutation(len(there))
        if tasks:
            state, loss, seen = _epoch(table, [there[k] for k in order.tolist()], state, (n - positives) / positives, settings, tasks)
        for step, k in enumerate([] if tasks else order.tolist()):
            a, m, g = _step(table.where(F.col("batch") == there[k]), state.params, (n - positives) / positives, settings, epoch, step)
            state.step(g, settings.rate, settings.decay)
            loss, seen = loss + a, seen + m
        auc = EV.auc(_scored(checked, state.params).select("label", "score")).first()["auc"]
        auc = 0.0 if auc is None else float(auc)
        state.epoch = epoch
        state.history.append({"epoch": epoch, "loss": loss / seen, "auc": auc})
        if auc > state.best_auc + 1e-6:
            state.best, state.best_auc, state.best_epoch = dict(state.params), auc, epoch
        over = epoch == settings.epochs or epoch - state.best_epoch >= settings.patience
        if epoch == 1 or epoch % settings.save_every == 0 or over:
            spark.createDataFrame([(configuration, state.packed())], "configuration string, state binary").coalesce(1).write.mode("overwrite").parquet(f"{work}/states/epoch={epoch}")
    return Network(state.best, scales, state.history, state.best_epoch)


def save(spark: SparkSession, network: Network, path: str) -> None:
    spark.createDataFrame([(network.packed(),)], "network binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    return Network.unpacked(bytes(spark.read.parquet(path).first()["network"]))
