"""Multilayer perceptron classifier (binary) with relu/tanh/logistic/identity, Adam, L2.

Spark's built-in ``MultilayerPerceptronClassifier`` only offers sigmoid hidden
units without L2, Adam or early stopping, so training here is synchronous and
data-parallel: one update is one Spark job.

* Every task adds up the gradient over its Arrow batches of rows, wherever they
  are: the table is not dealt out anew, and all cores work at any table size;
* the sums are reduced by Spark (``posexplode`` → ``groupBy(slot).sum``, partially
  aggregated per task), so the driver only ever receives one vector of parameters
  and takes one Adam step with it;
* the sum of gradients is the same for any partitions, cores and row order, and
  so is the model (but for the rounding of sums).

An update sees all rows, or with ``slices`` > 1 one slice of them by a hash, in
turn.  As one step takes the place of ``rows / (slices * batch_size)`` small ones,
its length grows with the square root of that, up to ``LONGEST_STEP``.

Stopping follows the usual rule: stop after ``n_iter_no_change`` epochs whose
training loss (or, with early stopping, validation accuracy on a 10 %
stratified hold-out) fails to improve by ``tol``.

Scoring needs no Python: the forward pass is compiled into Spark expressions
(one ``zip_with``/``aggregate`` dot product per unit, weights as literals), so
``transform`` runs in whole-stage codegen and also works on streaming frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.errors import PipelineError
from tabwise.session import persist_balanced

ACTIVATIONS = ("relu", "tanh", "logistic", "identity")
#: Adam's step is not lengthened beyond this.
LONGEST_STEP = 0.05


# --------------------------------------------------------------------------- numpy core
def _act(name: str, z):
    if name == "relu":
        return np.maximum(z, 0.0)
    if name == "tanh":
        return np.tanh(z)
    if name == "logistic":
        return 1.0 / (1.0 + np.exp(-z))
    return z


def _act_grad(name: str, a):
    """Derivative expressed through the activation output ``a``."""
    if name == "relu":
        return (a > 0).astype(a.dtype)
    if name == "tanh":
        return 1.0 - a * a
    if name == "logistic":
        return a * (1.0 - a)
    return np.ones_like(a)


def layer_shapes(n_in: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [n_in, *hidden, 1]
    return [(sizes[i], sizes[i + 1]) for i in range(len(sizes) - 1)]


def pack(ws, bs) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b.ravel()]) for w, b in zip(ws, bs)])


def unpack(theta: np.ndarray, shapes):
    ws, bs, o = [], [], 0
    for a, b in shapes:
        ws.append(theta[o:o + a * b].reshape(a, b))
        o += a * b
        bs.append(theta[o:o + b])
        o += b
    return ws, bs


def init_params(shapes, activation: str, seed: int) -> np.ndarray:
    """Glorot-uniform initialisation (factor 2 for logistic units)."""
    rng = np.random.default_rng(seed)
    ws, bs = [], []
    for fan_in, fan_out in shapes:
        factor = 2.0 if activation == "logistic" else 6.0
        bound = np.sqrt(factor / (fan_in + fan_out))
        ws.append(rng.uniform(-bound, bound, (fan_in, fan_out)))
        bs.append(rng.uniform(-bound, bound, fan_out))
    return pack(ws, bs)


def forward(theta, shapes, activation, x):
    ws, bs = unpack(theta, shapes)
    acts = [x]
    for i, (w, b) in enumerate(zip(ws, bs)):
        z = acts[-1] @ w + b
        if i == len(ws) - 1:
            acts.append(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
        else:
            acts.append(_act(activation, z))
    return acts


def loss_and_grad_sums(theta, shapes, activation, x, y) -> tuple[float, np.ndarray]:
    """Log-loss and its gradient, summed over the rows of (x, y)."""
    ws, _ = unpack(theta, shapes)
    acts = forward(theta, shapes, activation, x)
    p = np.clip(acts[-1][:, 0], 1e-15, 1 - 1e-15)
    loss = -np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    delta = (acts[-1][:, 0] - y)[:, None]
    gws, gbs = [None] * len(ws), [None] * len(ws)
    for i in range(len(ws) - 1, -1, -1):
        gws[i] = acts[i].T @ delta
        gbs[i] = delta.sum(axis=0)
        if i > 0:
            delta = (delta @ ws[i].T) * _act_grad(activation, acts[i])
    return float(loss), pack(gws, gbs)


def penalised(theta, shapes, alpha, loss_sum, grad_sum, n, batch) -> tuple[float, np.ndarray]:
    """Mean log-loss + alpha/(2 batch)‖W‖² and its gradient, from sums over n rows."""
    ws, bs = unpack(theta, shapes)
    loss = loss_sum / n + alpha / (2 * batch) * sum(float(np.sum(w * w)) for w in ws)
    return loss, grad_sum / n + pack([alpha / batch * w for w in ws], [np.zeros_like(b) for b in bs])


def loss_and_grad(theta, shapes, activation, alpha, x, y):
    """Mean log-loss + alpha/(2n)‖W‖² and its gradient over the n rows of (x, y)."""
    loss, grad = loss_and_grad_sums(theta, shapes, activation, x, y)
    return penalised(theta, shapes, alpha, loss, grad, len(y), len(y))


@dataclass
class AdamState:
    m: np.ndarray
    v: np.ndarray
    t: int = 0


def adam_step(theta, state: AdamState, grad, lr) -> np.ndarray:
    b1, b2, eps = 0.9, 0.999, 1e-8
    state.t += 1
    state.m = b1 * state.m + (1 - b1) * grad
    state.v = b2 * state.v + (1 - b2) * grad * grad
    step = lr * np.sqrt(1 - b2 ** state.t) / (1 - b1 ** state.t)
    return theta - step * state.m / (np.sqrt(state.v) + eps)


# --------------------------------------------------------------------------- Spark training
@dataclass
class MLPModel:
    theta: list[float]
    n_features: int
    hidden: tuple[int, ...]
    activation: str
    loss_curve: list[float] = field(default_factory=list)
    validation_scores: list[float] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    @property
    def shapes(self):
        return layer_shapes(self.n_features, self.hidden)

    def probability_expr(self, x: Column) -> Column:
        """Forward pass as Spark expressions; ``x`` is an array<double> column."""
        ws, bs = unpack(np.asarray(self.theta), self.shapes)
        layer = x
        for li, (w, b) in enumerate(zip(ws, bs)):
            units = []
            for j in range(w.shape[1]):
                wj = F.array(*[F.lit(float(v)) for v in w[:, j]])
                z = F.aggregate(F.zip_with(layer, wj, lambda a, c: a * c), F.lit(float(b[j])),
                                lambda acc, t: acc + t)
                if li == len(ws) - 1:
                    units.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
                else:
                    units.append(_act_expr(self.activation, z))
            layer = F.array(*units)
        return F.element_at(layer, 1)

    def layer_table(self, spark) -> DataFrame:
        """M6: one row per layer (index, kind, units, activation)."""
        sizes = [self.n_features, *self.hidden, 1]
        rows = [(0, "input", sizes[0], None)]
        rows += [(i + 1, "hidden", h, self.activation) for i, h in enumerate(self.hidden)]
        rows += [(len(sizes) - 1, "output", 1, "logistic")]
        return spark.createDataFrame(rows, "layer int, kind string, units int, activation string")


def _act_expr(name: str, z: Column) -> Column:
    if name == "relu":
        return F.greatest(z, F.lit(0.0))
    if name == "tanh":
        return F.tanh(z)
    if name == "logistic":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return z


def gradient_sums(rows: DataFrame, theta: np.ndarray, shapes, activation: str) -> tuple[float, np.ndarray, int]:
    """Loss, gradient and number of ``rows (_x, _y)``, summed in one job: one vector a task, then one over all."""
    def sums(batches):
        total = np.zeros(len(theta) + 2)
        for batch in batches:
            if batch.num_rows:
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                loss, grad = loss_and_grad_sums(theta, shapes, activation, x, y)
                total += np.concatenate([grad, [loss, len(y)]])
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["vec"])

    out = (rows.select("_x", "_y").mapInArrow(sums, "vec array<double>").select(F.posexplode("vec").alias("j", "x"))
           .groupBy("j").agg(F.sum("x").alias("s")).collect())
    vec = np.zeros(len(theta) + 2)
    for row in out:
        vec[row["j"]] = row["s"]
    return vec[-2], vec[:-2], int(vec[-1])


def fit_mlp(df: DataFrame, features_col: str, label_col: str = "label", hidden=(3, 4),
            activation: str = "relu", batch_size: int = 50, learning_rate: float = 1e-3,
            alpha: float = 1e-4, max_iter: int = 200, tol: float = 1e-4, n_iter_no_change: int = 10,
            early_stopping: bool = False, validation_fraction: float = 0.1, seed: int = 123,
            id_col: str | None = None, slices: int = 1) -> MLPModel:
    """Train on ``features_col`` (array<double>, already scaled) and 0/1 ``label_col``.

    An epoch is ``slices`` updates, one Spark job each.  A row's slice follows
    from a hash of its id (without ``id_col``: of its values).  ``batch_size``
    sets the strength of the penalty and, against the rows of a slice, the step.
    """
    if activation not in ACTIVATIONS:
        raise PipelineError(f"activation must be one of {ACTIVATIONS}")
    hidden = tuple(int(h) for h in hidden)
    if not hidden or any(h < 1 for h in hidden):
        raise PipelineError("hidden_layer_sizes must be positive integers")
    data = df.select(F.col(features_col).cast("array<double>").alias("_x"),
                     F.col(label_col).cast("double").alias("_y"),
                     *([F.col(id_col)] if id_col else []))
    val = None
    if early_stopping:
        if id_col is None:
            raise PipelineError("early stopping needs an id column for the stratified hold-out")
        from tabwise.operators.split import train_test_split
        sp = train_test_split(data, id_col, "_y", validation_fraction, seed, "_part")
        val = sp.where(F.col("_part") == "test").drop("_part").persist(StorageLevel.MEMORY_AND_DISK)
        data = sp.where(F.col("_part") == "train").drop("_part")
    own = F.xxhash64(F.lit(seed), *([F.col(id_col)] if id_col else [F.col("_x"), F.col("_y")]))
    train = persist_balanced(data.select("_x", "_y", F.pmod(own, F.lit(slices)).cast("int").alias("_slice")))
    first = train.select(F.size("_x")).first()
    if first is None:
        raise PipelineError("No training rows")
    n_in = int(first[0])
    shapes = layer_shapes(n_in, hidden)
    theta = init_params(shapes, activation, seed)
    state = AdamState(np.zeros_like(theta), np.zeros_like(theta))
    model = MLPModel(theta.tolist(), n_in, hidden, activation,
                     params={"hidden": list(hidden), "activation": activation, "batch_size": batch_size,
                             "learning_rate": learning_rate, "alpha": alpha, "max_iter": max_iter,
                             "early_stopping": early_stopping, "seed": seed})
    best, stall, best_theta = np.inf if not early_stopping else -np.inf, 0, theta.copy()
    for _ in range(max_iter):
        epoch_loss, seen = 0.0, 0
        for k in range(slices):
            loss, grad, n = gradient_sums(train if slices == 1 else train.where(F.col("_slice") == k), theta, shapes, activation)
            if n == 0:
                continue
            batch = min(batch_size, n)
            loss, grad = penalised(theta, shapes, alpha, loss, grad, n, batch)
            rate = min(learning_rate * np.sqrt(n / batch), max(learning_rate, LONGEST_STEP))
            theta = adam_step(theta, state, grad, rate)
            epoch_loss, seen = epoch_loss + loss * n, seen + n
        epoch_loss /= seen
        model.loss_curve.append(float(epoch_loss))
        if early_stopping:
            cand = MLPModel(theta.tolist(), n_in, hidden, activation)
            score = _accuracy(val, cand, "_x", "_y")
            model.validation_scores.append(score)
            if score > best + tol:
                best, stall, best_theta = score, 0, theta.copy()
            else:
                stall += 1
        else:
            if epoch_loss < best - tol:
                stall = 0
            else:
                stall += 1
            best = min(best, epoch_loss)
            best_theta = theta
        if stall >= n_iter_no_change:
            break
    model.theta = best_theta.tolist()
    train.unpersist()
    if val is not None:
        val.unpersist()
    return model


def _accuracy(df: DataFrame, model: MLPModel, x: str, y: str) -> float:
    scored = predict_mlp(df, model, x)
    return float(scored.agg(F.avg((F.col("prediction").cast("double") == F.col(y)).cast("double"))).first()[0])


def predict_mlp(df: DataFrame, model: MLPModel, features_col: str, threshold: float = 0.5,
                inclusive: bool = False, prob_col: str = "probability",
                pred_col: str = "prediction") -> DataFrame:
    """Probability of class 1 and the class: ``>`` 0.5 for evaluation (``predict``),
    ``inclusive=True`` for the score-time ``>=`` rule.

    Each layer is its own projection column, so a unit's value is computed once
    and reused by every unit of the next layer (no expression duplication).
    """
    ws, bs = unpack(np.asarray(model.theta), model.shapes)
    out = df.withColumn("_l0", F.col(features_col).cast("array<double>"))
    for li, (w, b) in enumerate(zip(ws, bs)):
        prev = F.col(f"_l{li}")
        units = []
        for j in range(w.shape[1]):
            wj = F.array(*[F.lit(float(v)) for v in w[:, j]])
            z = F.aggregate(F.zip_with(prev, wj, lambda a, c: a * c), F.lit(float(b[j])),
                            lambda acc, t: acc + t)
            units.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if li == len(ws) - 1
                         else _act_expr(model.activation, z))
        out = out.withColumn(f"_l{li + 1}", F.array(*units))
    out = out.withColumn(prob_col, F.element_at(F.col(f"_l{len(ws)}"), 1))
    out = out.drop(*[f"_l{i}" for i in range(len(ws) + 1)])
    cmp = (F.col(prob_col) >= F.lit(threshold)) if inclusive else (F.col(prob_col) > F.lit(threshold))
    return out.withColumn(pred_col, cmp.cast("int"))


def loss_table(spark, model: MLPModel) -> DataFrame:
    """M5: loss per epoch (and validation accuracy when early stopping was on)."""
    vs = model.validation_scores + [None] * (len(model.loss_curve) - len(model.validation_scores))
    rows = [(i + 1, float(l), (float(s) if s is not None else None))
            for i, (l, s) in enumerate(zip(model.loss_curve, vs))]
    return spark.createDataFrame(rows, "epoch int, loss double, validation_accuracy double")
