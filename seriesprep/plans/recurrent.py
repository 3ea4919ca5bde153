"""Recurrent window classifiers, trained on the cluster round by round (M1, M3).

A round is one pass over the stored windows. Every task starts from the same weights, takes one
Adam step per small batch of its windows and hands back its weights; they are averaged by the
number of windows, first in ``BUCKETS`` groups on the cluster and then on the driver. Any number
of networks share a pass: each batch is read and decoded once and steps all of them. Only weights
and sums leave the tasks, and a round depends on nothing but the weights before it, so training
stored with :class:`Rounds` goes on after a kill as if nothing had happened.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesprep.plans.classify import score_with
from seriesprep.schema import NUM_CLASSES, SPLIT_SEED, SeriesLayout
from seriesprep.sources.store import read_if_stored

BATCH = 128
#: So few that a layer's values of all steps stay in the processor's cache.
SCORED_AT_ONCE = 256
BUCKETS = 32
RATE_DECAYS = (0.9, 0.999)  # of Adam's two averages
TINY = 1e-8
FORGET_BIAS = 1.0


@dataclass(frozen=True)
class Network:
    """LSTM layers, dropout, a dense layer with ReLU, softmax over the classes.

    ``bidirectional`` reads the window from both ends in the last recurrent layer. ``dropout`` is
    the share of recurrent outputs left out while training; ``rate`` is Adam's step size.
    """

    steps: int
    sensors: int
    units: tuple[int, ...] = (16,)
    bidirectional: bool = False
    dense: int = 32
    dropout: float = 0.0
    rate: float = 0.005
    classes: int = NUM_CLASSES

    def shapes(self) -> list[tuple[int, ...]]:
        shapes: list[tuple[int, ...]] = []
        width = self.sensors
        for last, units in zip([*[False] * (len(self.units) - 1), True], self.units):
            both = 2 if last and self.bidirectional else 1
            shapes += [(width, 4 * units), (units, 4 * units), (4 * units,)] * both
            width = units * both
        return [*shapes, (width, self.dense), (self.dense,), (self.dense, self.classes), (self.classes,)]

    def split(self, weights: np.ndarray) -> list[np.ndarray]:
        sizes = [int(np.prod(s)) for s in self.shapes()]
        return [w.reshape(s) for w, s in zip(np.split(weights, np.cumsum(sizes)[:-1]), self.shapes())]

    def start(self, seed: int = SPLIT_SEED) -> np.ndarray:
        """First weights: uniform by fan-in and fan-out; the forget gates begin open."""
        rng = np.random.default_rng(seed)
        parts = []
        for shape in self.shapes():
            if len(shape) == 2:
                bound = np.sqrt(6 / sum(shape))
                parts.append(rng.uniform(-bound, bound, shape).ravel())
            else:
                parts.append(np.zeros(shape))
        weights = np.concatenate(parts)
        for part, shape in zip(self.split(weights)[2 : 3 * self._n_cells() : 3], self.shapes()[2 : 3 * self._n_cells() : 3]):
            part[shape[0] // 4 : shape[0] // 2] = FORGET_BIAS
        return weights

    def _n_cells(self) -> int:
        return len(self.units) + self.bidirectional


def squash(z: np.ndarray) -> None:
    """``1 / (1 + exp(z))`` in place: a sigmoid of ``-z``, and half of ``tanh(-z / 2) + 1``.
    The exponential of NumPy is several times faster than its ``tanh``."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Outputs of all steps of ``x`` (batch, step, input), and what the backward pass needs.

    Inside, a step's values lie as (unit, batch), so that each gate is one block of memory.
    """
    n, steps, units = len(x), x.shape[1], len(u)
    sign = np.full((4 * units, 1), -1, x.dtype)
    sign[2 * units : 3 * units] = -2
    inputs = np.ascontiguousarray(x.transpose(1, 2, 0))
    gates = np.matmul(w.T * sign, inputs) + b[:, None] * sign
    by_output = u.T * sign
    h, c = np.zeros((2, steps + 1, units, n), x.dtype)
    tanh_c = np.empty((steps, units, n), x.dtype)
    for t in range(steps):
        z = gates[t]
        z += by_output @ h[t]
        squash(z)
        i, f, g, o = z.reshape(4, units, n)
        g *= 2
        g -= 1
        np.multiply(f, c[t], out=c[t + 1])
        c[t + 1] += i * g
        np.multiply(c[t + 1], -2, out=tanh_c[t])
        squash(tanh_c[t])
        tanh_c[t] *= 2
        tanh_c[t] -= 1
        np.multiply(o, tanh_c[t], out=h[t + 1])
    return h[1:].transpose(2, 0, 1), (inputs, gates, h, c, tanh_c)


def lstm_gradient(d_out: np.ndarray, w: np.ndarray, u: np.ndarray, kept: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradient by the inputs and by ``w``, ``u``, ``b`` from that by the outputs of all steps."""
    n, steps, units = d_out.shape
    inputs, gates, h, c, tanh_c = kept
    i, f, g, o = gates.reshape(steps, 4, units, n).transpose(1, 0, 2, 3)
    by_c = np.stack([g * i * (1 - i), c[:-1] * f * (1 - f), i * (1 - g**2)], axis=1)
    c_by_h, o_by_h = o * (1 - tanh_c**2), tanh_c * o * (1 - o)
    d_outputs = np.ascontiguousarray(d_out.transpose(1, 2, 0))
    d_h, d_c = np.zeros((2, units, n), d_out.dtype)
    d_z = np.empty((steps, 4, units, n), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        d_h = d_h + d_outputs[t]
        d_c = d_c + d_h * c_by_h[t]
        np.multiply(by_c[t], d_c, out=d_z[t, :3])
        np.multiply(d_h, o_by_h[t], out=d_z[t, 3])
        d_h, d_c = u @ d_z[t].reshape(4 * units, n), d_c * f[t]
    d_z = d_z.reshape(steps, 4 * units, n)
    turned = d_z.transpose(0, 2, 1)
    found = [np.matmul(inputs, turned).sum(axis=0), np.matmul(h[:-1], turned).sum(axis=0), d_z.sum(axis=(0, 2))]
    return np.matmul(w, d_z).transpose(2, 0, 1), found


def forward(network: Network, weights: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
    """Class probabilities of windows ``x``; with ``rng`` outputs drop out, as in training.
    All is computed in the precision of ``x``."""
    parts = network.split(weights.astype(x.dtype))
    cells, trace = [parts[k : k + 3] for k in range(0, len(parts) - 4, 3)], []
    for k in range(len(network.units)):
        outputs, kept = lstm(x, *cells[k])
        trace.append(kept)
        if k == len(network.units) - 1 and network.bidirectional:
            back, kept_back = lstm(x[:, ::-1], *cells[k + 1])
            trace.append(kept_back)
            last = np.concatenate([outputs[:, -1], back[:, -1]], axis=1)
        else:
            last = outputs[:, -1]
        x = outputs
    mask = np.ones_like(last)
    if rng is not None and network.dropout:
        mask = ((rng.random(last.shape) >= network.dropout) / (1 - network.dropout)).astype(x.dtype)
    dropped = last * mask
    hidden = np.maximum(0, dropped @ parts[-4] + parts[-3])
    scores = hidden @ parts[-2] + parts[-1]
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True), [trace, mask, dropped, hidden]


def gradient(
    network: Network, weights: np.ndarray, x: np.ndarray, labels: np.ndarray, rng: np.random.Generator | None = None
) -> tuple[float, np.ndarray]:
    """Mean cross-entropy and its gradient by the weights, in the precision of ``x``."""
    parts, n = network.split(weights.astype(x.dtype)), len(x)
    probability, (trace, mask, dropped, hidden) = forward(network, weights, x, rng)
    loss = float(-np.log(np.maximum(probability[np.arange(n), labels], 1e-12)).mean())
    d_scores = probability / n
    d_scores[np.arange(n), labels] -= 1 / n
    d_hidden = (d_scores @ parts[-2].T) * (hidden > 0)
    found = [dropped.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d_scores, d_scores.sum(axis=0)]
    d_last = (d_hidden @ parts[-4].T) * mask
    cells = [parts[k : k + 3] for k in range(0, len(parts) - 4, 3)]
    units, at_end = network.units[-1], lambda d: np.concatenate([np.zeros((n, network.steps - 1, d.shape[1]), x.dtype), d[:, None]], axis=1)
    sides = [at_end(d_last[:, :units])] + ([at_end(d_last[:, units:])] if network.bidirectional else [])
    first = len(network.units) - 1
    d_x, top = 0.0, []
    for side, d_out in enumerate(sides):
        by_input, by_weights = lstm_gradient(d_out, *cells[first + side][:2], trace[first + side])
        d_x, top = d_x + (by_input[:, ::-1] if side else by_input), top + by_weights
    found = top + found
    for k in range(first - 1, -1, -1):
        d_x, by_weights = lstm_gradient(d_x, *cells[k][:2], trace[k])
        found = by_weights + found
    return loss, np.concatenate([g.ravel() for g in found])


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.t, self.mean, self.square = rate, 0, np.zeros(size), np.zeros(size)

    def step(self, weights: np.ndarray, by_weights: np.ndarray) -> np.ndarray:
        self.t += 1
        a, b = RATE_DECAYS
        self.mean = a * self.mean + (1 - a) * by_weights
        self.square = b * self.square + (1 - b) * by_weights**2
        return weights - self.rate * (self.mean / (1 - a**self.t)) / (np.sqrt(self.square / (1 - b**self.t)) + TINY)


# --- passes over the windows -------------------------------------------------------------------

Models = Mapping[str, tuple[Network, np.ndarray]]


def decoded(batch: pa.RecordBatch, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """Windows, in single precision, and labels of an Arrow batch; an unknown value counts as the mean, 0."""
    values = batch.column("X").flatten().flatten().to_numpy(zero_copy_only=False)
    x = np.nan_to_num(np.asarray(values, np.float32)).reshape(batch.num_rows, network.steps, network.sensors)
    return x, batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)


def train_round(windows: DataFrame, models: Models, round_number: int, seed: int = SPLIT_SEED, batch: int = BATCH) -> dict[str, np.ndarray]:
    """The weights of every model after one pass over ``X, label``."""
    context = windows.sparkSession.sparkContext
    shared = context.broadcast(dict(models))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, round_number, part])
        # Each by its name, so that a model trains the same in whatever company.
        drops = {name: np.random.default_rng([seed, round_number, part, zlib.crc32(name.encode())]) for name in models}
        now = {name: weights for name, (_, weights) in models.items()}
        steppers = {name: Adam(len(weights), network.rate) for name, (network, weights) in models.items()}
        shape, n = next(iter(models.values()))[0], 0
        for rows in batches:
            x, labels = decoded(rows, shape)
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                for name, (network, _) in models.items():
                    _, by_weights = gradient(network, now[name], x[some], labels[some], drops[name])
                    now[name] = steppers[name].step(now[name], by_weights)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(now)), pa.array([part % BUCKETS] * len(now), pa.int32()),
                    pa.array([n] * len(now), pa.int64()), pa.array([(w * n).tobytes() for w in now.values()], pa.binary()),
                ],
                names=["model", "bucket", "n", "total"],
            )

    def added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, name, bucket = 0, None, None, None
        for part in rows:
            for name, bucket, size, packed in zip(*(c.to_pylist() for c in part.columns)):
                weighted = np.frombuffer(packed)
                n, total = n + size, weighted if total is None else total + weighted
        arrays = [pa.array([name]), pa.array([bucket], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["model", "bucket", "n", "total"])

    schema = "model string, bucket int, n long, total binary"
    trained = windows.select("X", "label").mapInArrow(local, schema)
    sums = trained.groupBy("model", "bucket").applyInArrow(added, schema).orderBy("bucket").collect()
    found = {}
    for name, (_, weights) in models.items():
        mine = [r for r in sums if r["model"] == name]
        n = sum(r["n"] for r in mine)
        found[name] = sum(np.frombuffer(r["total"]) for r in mine) / n if n else weights
    shared.unpersist()
    return found


def quality(windows: DataFrame, models: Models) -> dict[str, tuple[int, float | None, float | None]]:
    """Windows, accuracy and mean cross-entropy of every model, by one pass over ``X, label``."""
    shared = windows.sparkSession.sparkContext.broadcast(dict(models))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for rows in batches:
            x, labels = decoded(rows, next(iter(models.values()))[0])
            right, loss = [], []
            for network, weights in models.values():
                p = np.concatenate([forward(network, weights, x[k : k + SCORED_AT_ONCE])[0] for k in range(0, len(x), SCORED_AT_ONCE)])
                right.append(int((p.argmax(axis=1) == labels).sum()))
                loss.append(float(-np.log(np.maximum(p[np.arange(len(p)), labels], 1e-12)).sum(dtype=float)))
            columns = [pa.array(list(models)), pa.array([len(x)] * len(models), pa.int64()), pa.array(right, pa.int64()), pa.array(loss)]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "n", "n_right", "loss"])

    parts = windows.select("X", "label").mapInArrow(counted, "model string, n long, n_right long, loss double")
    sums = parts.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "n_right", "loss")]).collect()
    known = {r["model"]: (r["n"], r["n_right"] / r["n"], r["loss"] / r["n"]) for r in sums}
    shared.unpersist()
    return {name: known.get(name, (0, None, None)) for name in models}


# --- stored rounds and early stopping ----------------------------------------------------------


@dataclass
class Trained:
    """A network with the weights of its best round and the validation accuracy of every round."""

    network: Network
    weights: np.ndarray
    best_round: int
    history: list[float] = field(default_factory=list)


class Rounds:
    """One Parquet file per finished round under ``path``; a round half written is not there."""

    SCHEMA = "network string, accuracy double, weights binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, number: int, network: Network, accuracy: float, weights: np.ndarray) -> None:
        row = [(json.dumps(asdict(network)), accuracy, weights.tobytes())]
        frame = self.spark.createDataFrame(row, self.SCHEMA).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/round={number}")

    def history(self, network: Network) -> list[float]:
        """Accuracies of the rounds 1, 2, ... that are there without a gap."""
        stored = read_if_stored(self.spark, self.path)
        if stored is None:
            return []
        rows = {r["round"]: r for r in stored.select("round", "network", "accuracy").collect()}
        if any(r["network"] != json.dumps(asdict(network)) for r in rows.values()):
            raise ValueError(f"{self.path} holds rounds of another network")
        found: list[float] = []
        while len(found) + 1 in rows:
            found.append(rows[len(found) + 1]["accuracy"])
        return found

    def weights(self, number: int) -> np.ndarray:
        row = self.spark.read.parquet(f"{self.path}/round={number}").select("weights").first()
        return np.frombuffer(row["weights"])


def fit_recurrent(
    train: DataFrame,
    validation: DataFrame,
    network: Network,
    max_rounds: int = 50,
    patience: int = 10,
    path: str | None = None,
    seed: int = SPLIT_SEED,
) -> Trained:
    """Train until ``patience`` rounds brought no better validation accuracy, or ``max_rounds``.

    The weights of the best round (the first on ties) are returned. With ``path`` every round is
    stored, and rounds found there are not trained again.
    """
    rounds = Rounds(train.sparkSession, path) if path else None
    history = rounds.history(network) if rounds else []
    weights = rounds.weights(len(history)) if history else network.start(seed)
    best = max(range(len(history)), key=lambda k: (history[k], -k), default=None)
    best_weights = rounds.weights(best + 1) if history else weights
    while len(history) < max_rounds and (best is None or len(history) - (best + 1) < patience):
        number = len(history) + 1
        weights = train_round(train, {"model": (network, weights)}, number, seed)["model"]
        _, accuracy, _ = quality(validation, {"model": (network, weights)})["model"]
        if accuracy is None:
            raise ValueError("the validation split has no window")
        if rounds:
            rounds.store(number, network, accuracy, weights)
        history.append(accuracy)
        if best is None or accuracy > history[best]:
            best, best_weights = number - 1, weights
    return Trained(network, best_weights, (best or 0) + 1, history)


def score_recurrent(trained: Trained, windows: DataFrame) -> DataFrame:
    """Windows with class probabilities and predicted class."""
    network, weights = trained.network, trained.weights

    def make() -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: forward(network, weights, np.nan_to_num(x))[0]

    return score_with(windows, make, [network.steps, network.sensors])


# --- search ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trial:
    """A candidate as far as it came."""

    name: str
    network: Network
    bracket: int
    rounds: int
    accuracy: float
    loss: float
    weights: np.ndarray = field(repr=False, compare=False)


@dataclass(frozen=True)
class Search:
    """Candidates, best first. ``window_passes`` is how often a candidate went over the windows,
    ``scans`` how often the windows were read for it."""

    ranking: list[Trial]
    window_passes: int
    scans: int


def bracket_sizes(max_rounds: int, eta: int) -> list[tuple[int, int]]:
    """Candidates and rounds before the first cut of every bracket: many that are cut soon, down
    to a few that all run to the end."""
    deepest = 0
    while eta ** (deepest + 1) <= max_rounds:
        deepest += 1
    return [
        (ceil((deepest + 1) / (s + 1) * eta**s), max(1, max_rounds // eta**s)) for s in range(deepest, -1, -1)
    ]


def successive_halving(
    train: DataFrame, validation: DataFrame, brackets: list[tuple[list[Network], int]], max_rounds: int, eta: int = 3, seed: int = SPLIT_SEED
) -> Search:
    """Train the candidates of all brackets side by side, cutting each to its best ``1/eta`` as
    often as its rounds have grown ``eta``-fold.

    A bracket is its candidates and their rounds before the first cut. Candidates keep their
    weights, and all that are left in any bracket share the pass of a round. Ties in accuracy go
    to the lower loss, then to the earlier candidate.
    """
    trials: dict[str, Trial] = {}
    alive: list[list[str]] = []
    cuts = [first for _, first in brackets]
    for b, (networks, _) in enumerate(brackets):
        names = [f"{b}-{k:04d}" for k in range(len(networks))]
        alive.append(names)
        for name, network in zip(names, networks):
            trials[name] = Trial(name, network, b, 0, -1.0, float("inf"), network.start(seed))
    better = lambda name: (-trials[name].accuracy, trials[name].loss, name)
    passes = scans = 0
    for number in range(1, max_rounds + 1):
        running = [name for names in alive for name in names]
        if not running:
            break
        weights = train_round(train, {n: (trials[n].network, trials[n].weights) for n in running}, number, seed)
        passes, scans = passes + len(running), scans + 1
        for name in running:
            trials[name] = replace(trials[name], rounds=number, weights=weights[name])
        due = [b for b, cut in enumerate(cuts) if number == min(cut, max_rounds) and alive[b]]
        judged = quality(validation, {n: (trials[n].network, trials[n].weights) for b in due for n in alive[b]}) if due else {}
        for name, (n, accuracy, loss) in judged.items():
            if not n:
                raise ValueError("the validation split has no window")
            trials[name] = replace(trials[name], accuracy=accuracy, loss=loss)
        for b in due:
            alive[b] = sorted(alive[b], key=better)[: max(1, len(alive[b]) // eta)] if number < max_rounds else []
            cuts[b] *= eta
    return Search(sorted(trials.values(), key=lambda t: better(t.name)), passes, scans)


def hyperband(
    train: DataFrame,
    validation: DataFrame,
    draw: Callable[[np.random.Generator], Network],
    max_rounds: int = 9,
    iterations: int = 3,
    eta: int = 3,
    seed: int = SPLIT_SEED,
) -> Search:
    """Search over networks that ``draw`` makes, with ``iterations`` sets of brackets."""
    rng = np.random.default_rng(seed)
    sizes = bracket_sizes(max_rounds, eta) * iterations
    brackets = [([draw(rng) for _ in range(n)], first) for n, first in sizes]
    return successive_halving(train, validation, brackets, max_rounds, eta, seed)


def draw_network(layout: SeriesLayout, steps: int) -> Callable[[np.random.Generator], Network]:
    """Draws one, two stacked or two-way recurrent layers, their sizes, dropout and rate."""

    def draw(rng: np.random.Generator) -> Network:
        sizes = lambda many: tuple(int(u) for u in 5 * rng.integers(1, 21, many))
        kind = int(rng.integers(3))
        return Network(
            steps,
            len(layout.sensors),
            units=sizes(2 if kind == 1 else 1),
            bidirectional=kind == 2,
            dense=int(10 * rng.integers(2, 21)),
            dropout=0.5 * float(rng.integers(2)),
            rate=float(10 ** rng.uniform(-5, -1)),
        )

    return draw
