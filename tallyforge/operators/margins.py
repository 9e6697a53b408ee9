"""Linear and Gaussian vector machines by a trust-region Newton method on Spark.

The objective is |w|^2 / 2 + C * sum of losses of the margins y (w x + b), with squared hinge loss, or a hinge whose
corner is rounded over `width` on either side. One pass over the table gives the value and gradient at a point; a
Newton step is found by conjugate gradients inside a trust region. While there are at most MATRIX_COLUMNS columns the
same pass also gives the matrix of second derivatives, so a step is one pass; beyond, each conjugate-gradient step
multiplies the matrix by a vector in a pass of its own. Both give the same step. Where there are rows enough, a descent
begins on a share of them, and that of a hinge on rounder corners; it always ends on all rows within the same tolerance.

The Gaussian kernel is replaced by its Nystrom features: kernels with k-means landmarks over the table, times the
inverse root of the landmarks' kernel matrix. `kernel_error` says how far these are from the kernel. Training with such a
`lift` keeps the table as it is: each pass makes the kernels of a block in its task, and the root, the same for all rows,
is applied to the sums.

Labels are 0 and 1, features are arrays of one width without nulls. The driver holds vectors of the number of columns
and the matrix, or the landmarks; rows stay in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tallyforge.functions.blocks import block_sum, matrix, spread
from tallyforge.session import settle

MATRIX_COLUMNS = 1024
# Bytes of a block of rows as the passes read them, and of the columns they work on at a time, which stay in a core's cache.
PACK_BYTES = 1 << 20
CACHE_BYTES = 1 << 20
# A descent starts on one row of so many, if these are enough, and on corners rounded over so many times their width; each of
# these first descents ends where the gradient has fallen to a share.
EARLY_SHARE, EARLY_ROWS, EARLY_FALL = 16, 20_000, 1e-3
ROUNDER = [20, 6, 2]
# When a step counts, when the region shrinks and grows, and by how much: the usual values of the method.
ACCEPT, POOR, GOOD = 1e-4, 0.25, 0.75
SHRINK, GROW = 0.5, 4.0


@dataclass
class Margin:
    """w, b and how training ended: passes over the table, value, and norm of the gradient."""

    coefficients: np.ndarray
    intercept: float
    passes: int = 0
    value: float = 0.0
    gradient_norm: float = 0.0
    lift: Nystrom | Fourier | None = None

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds `margin` and `prediction`."""
        if self.lift is not None:
            lift, weights = self.lift, self.lift.root @ self.coefficients

            @F.pandas_udf("double")
            def lifted(features: pd.Series) -> pd.Series:
                return pd.Series(lift.raw(np.stack(features.to_numpy())) @ weights if len(features) else [], dtype=float)

            return rows.withColumn("margin", lifted("features") + self.intercept).withColumn("prediction", (F.col("margin") > 0).cast("double"))
        dot = F.aggregate(F.zip_with("features", F.array(*map(F.lit, self.coefficients.tolist())), lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
        return rows.withColumn("margin", dot + self.intercept).withColumn("prediction", (F.col("margin") > 0).cast("double"))


def losses(z: np.ndarray, width: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative at margins z: squared hinge, or a hinge rounded over `width`."""
    gap = 1.0 - z
    if width is None:
        on = gap > 0
        return np.where(on, gap, 0.0) ** 2, np.where(on, -2 * gap, 0.0), np.where(on, 2.0, 0.0)
    bent, straight = np.abs(gap) <= width, gap > width
    return (np.where(straight, gap, np.where(bent, (gap + width) ** 2 / (4 * width), 0.0)),
            np.where(straight, -1.0, np.where(bent, -(gap + width) / (2 * width), 0.0)), np.where(bent, 1 / (2 * width), 0.0))


def packed(rows: DataFrame) -> DataFrame:
    """(features, label) as blocks of numbers, x and y: a pass reads bytes, not a list per row."""
    most = PACK_BYTES

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            step = max(1, most // (8 * max(1, len(batch.column("features")[0])))) if batch.num_rows else 1
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x, y = matrix(part.column("features")), np.asarray(part.column("label"), float)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    # A batch of blocks is bounded in bytes, since their number says little.
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return rows.select("features", "label").mapInArrow(run, "x binary, y binary")


def _share(blocks: DataFrame, share: int) -> DataFrame:
    """About one of `share` rows of packed `blocks`, drawn block by block: where a descent begins may hang on the layout, where it ends does not."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for held, labels in zip(batch.column("x"), batch.column("y")):
                y = np.frombuffer(labels.as_buffer())
                mine = np.random.default_rng(len(y)).random(len(y)) * share < 1
                if mine.any():
                    x = np.frombuffer(held.as_buffer()).reshape(len(y), -1)
                    yield pa.RecordBatch.from_arrays([pa.array([x[mine].tobytes()], pa.binary()), pa.array([y[mine].tobytes()], pa.binary())], ["x", "y"])

    return blocks.mapInArrow(run, "x binary, y binary")


class Objective:
    """Value, gradient and second derivatives of the objective at a point, over `packed` rows; the last column is the constant 1 of b.

    With a `lift` tasks work on its raw columns and at `basis @ w`; `basis` turns their sums into those of the features.
    """

    def __init__(self, rows: DataFrame, columns: int, c: float, width: float | None, free_intercept: bool, matrix_columns: int, lift: Nystrom | Fourier | None = None):
        self.raw, self.basis = None, None
        if lift is not None:
            raw_columns, columns = lift.root.shape
            self.raw, self.basis = lift.raw, np.block([[lift.root, np.zeros((raw_columns, 1))], [np.zeros((1, columns)), np.ones((1, 1))]])
        self.rows, self.size, self.c, self.width, self.passes = rows, columns + 1, c, width, 0
        # The ridge of each weight; an intercept that isn't held gets none.
        self.ridge = np.append(np.ones(columns), 0.0 if free_intercept else 1.0)
        self.dense = columns <= matrix_columns

    def _sum(self, block: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        """The sum of `block(x, signs)` over all rows, its vector and the squares of its rows; x is without the constant column."""
        self.passes += 1
        raw, columns = self.raw, self.size if self.basis is None else len(self.basis)
        step = max(64, CACHE_BYTES // (8 * columns))

        def run(batch: pa.RecordBatch) -> np.ndarray:
            total, head = np.zeros(size), 0
            for held, labels in zip(batch.column("x"), batch.column("y")):
                squares = []
                signs = np.where(np.frombuffer(labels.as_buffer()) > 0, 1.0, -1.0)
                x = np.frombuffer(held.as_buffer()).reshape(len(signs), -1)
                for start in range(0, len(x), step):
                    part = x[start:start + step]
                    sums, bows = block(part if raw is None else raw(part), signs[start:start + step])
                    head = len(sums)
                    total[:head] += sums
                    squares.append(bows)
                    if sum(map(len, squares)) >= columns or start + step >= len(x):
                        whole, squares = np.concatenate(squares), []
                        total[head:] += (whole.T @ whole).ravel() if head < size else 0
            return total

        return block_sum(self.rows, run, size)

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """(value, gradient, product of the second derivatives with a vector)."""
        width, dense, c, ridge = self.width, self.dense, self.c, self.ridge
        out, back = (lambda v: v, lambda v: v) if self.basis is None else (lambda v: self.basis @ v, lambda v: self.basis.T @ v)
        n, u = self.size if self.basis is None else len(self.basis), out(w)

        def block(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            loss, first, second = losses(y * (x @ u[:-1] + u[-1]), width)
            pull = first * y
            bent = np.flatnonzero(second) if dense else []
            bows = np.hstack([x[bent], np.ones((len(bent), 1))]) * np.sqrt(second[bent, None]) if len(bent) else np.zeros((0, n))
            return np.concatenate([[loss.sum()], x.T @ pull, [pull.sum()]]), bows

        def product(v: np.ndarray) -> np.ndarray:
            way = out(v)

            def bend(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                bow = losses(y * (x @ u[:-1] + u[-1]), width)[2] * (x @ way[:-1] + way[-1])
                return np.append(x.T @ bow, bow.sum()), np.zeros((0, n))

            return ridge * v + c * back(self._sum(bend, n))

        total = self._sum(block, 1 + n + (n * n if dense else 0))
        value, gradient = (ridge * w * w).sum() / 2 + c * total[0], ridge * w + c * back(total[1:n + 1])
        if dense:
            bends = np.diag(ridge) + c * back(back(total[n + 1:].reshape(n, n)).T)
            return value, gradient, lambda v: bends @ v
        return value, gradient, product


def _newton_step(gradient: np.ndarray, product: Callable[[np.ndarray], np.ndarray], reach: float) -> tuple[np.ndarray, float]:
    """(step, expected fall) by conjugate gradients within `reach`."""
    step, rest = np.zeros_like(gradient), -gradient
    way, square = rest.copy(), rest @ rest
    enough = 0.01 * np.sqrt(square)
    for _ in range(4 * len(gradient) + 10):
        if np.sqrt(square) <= enough:
            break
        bent = product(way)
        bow = way @ bent
        length = square / bow if bow > 0 else np.inf
        if np.linalg.norm(step + length * way) >= reach or not np.isfinite(length):
            # On to the border of the region.
            a, b, c = way @ way, step @ way, step @ step - reach * reach
            length = (-b + np.sqrt(max(0.0, b * b - a * c))) / a
            step, rest = step + length * way, rest - length * bent
            break
        step, rest = step + length * way, rest - length * bent
        square, before = rest @ rest, square
        way = rest + square / before * way
    return step, -0.5 * (gradient @ step - rest @ step)


def train_margin(train: DataFrame, c: float = 1.0, width: float | None = None, free_intercept: bool = False,
                 tolerance: float = 1e-7, max_iter: int = 1000, matrix_columns: int = MATRIX_COLUMNS, lift: Nystrom | Fourier | None = None) -> Margin:
    """The machine of (features, label), or of what `lift` makes of the features. Ends where the gradient's norm is at most `tolerance`, or where no step falls any more."""
    rows = train.select("features", F.col("label").cast("double").alias("label"))
    blocks = packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    early = _share(blocks, EARLY_SHARE).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        count = _rows_of(blocks)
        if not count:
            raise ValueError("no rows to train on")
        first = blocks.first()
        columns = len(first["x"]) // len(first["y"])

        def goal_of(part: DataFrame, weight: float) -> Objective:
            return Objective(part, columns, weight, width, free_intercept, matrix_columns, lift)

        goal, some = goal_of(blocks, c), _rows_of(early) if count >= EARLY_ROWS * EARLY_SHARE // 2 else 0
        # A share of the rows leads near the end of all of them; only the steps from there on pass over the table.
        start = _near(goal_of(early, c * count / some) if some >= EARLY_ROWS else goal, max_iter, some >= EARLY_ROWS)
        w, value, gradient = _descend(goal, tolerance, max_iter, start)
    finally:
        early.unpersist()
        blocks.unpersist()
    return Margin(w[:-1], float(w[-1]), goal.passes, float(value), float(np.linalg.norm(gradient)), lift)


def _rows_of(blocks: DataFrame) -> int:
    """How many rows are `packed`."""
    return (blocks.agg(F.sum(F.octet_length("y"))).first()[0] or 0) // 8


def _near(goal: Objective, max_iter: int, last: bool) -> np.ndarray | None:
    """A point to begin at: ends of rounder and rounder corners lead to that of a hinge in few steps, and if `last` its own is looked for too."""
    width, point = goal.width, None
    for times in ([] if width is None else ROUNDER) + ([1] if last else []):
        goal.width = width and width * times
        point = _descend(goal, 0.0, max_iter, point, EARLY_FALL)[0]
    goal.width = width
    return point


def _descend(goal: Objective, tolerance: float, max_iter: int, start: np.ndarray | None = None, fall: float = 0.0) -> tuple[np.ndarray, float, np.ndarray]:
    """(point, value, gradient) where the steps end that begin at `start`, or at 0; a gradient of `fall` times the first is an end too."""
    w = np.zeros(goal.size) if start is None else start
    value, gradient, product = goal.at(w)
    tolerance = max(tolerance, fall * np.linalg.norm(gradient))
    reach = max(1.0, np.linalg.norm(gradient))
    for _ in range(max_iter):
        # Missing numbers leave no way down.
        if not np.linalg.norm(gradient) > tolerance:
            break
        step, expected = _newton_step(gradient, product, reach)
        new = goal.at(w + step)
        fall = value - new[0]
        size = np.linalg.norm(step)
        # At the end falls drown in rounding; a smaller gradient then tells.
        better = fall > ACCEPT * expected or (abs(fall) <= 1e-12 * abs(value) and np.linalg.norm(new[1]) < np.linalg.norm(gradient))
        if better:
            w, (value, gradient, product) = w + step, new
            reach = max(reach, GROW * size) if fall > GOOD * expected else reach if fall > POOR * expected else SHRINK * size
        elif expected <= 1e-15 * abs(value):
            break
        else:
            reach = SHRINK * min(size, reach)
    return w, value, gradient


def linear_svm(df: DataFrame, c: float = 1.0, max_iter: int = 1000) -> tuple[Margin, DataFrame]:
    """Squared hinge loss with the intercept held like a weight: (machine, scored test part)."""
    return _fit(df, lambda train: train_margin(train, c, max_iter=max_iter))


def _fit(df: DataFrame, trainer: Callable[[DataFrame], Margin]) -> tuple[Margin, DataFrame]:
    machine = trainer(spread(df.where("split = 'train'").select("features", "label")))
    return machine, machine.score(df.where("split = 'test'"))


# --- the Gaussian kernel --------------------------------------------------------------

def kernel_width(df: DataFrame) -> tuple[int, float]:
    """(d, gamma) with gamma = 1 / (d * variance of all feature values)."""
    sums = F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("s")
    squares = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x).alias("q")
    row = df.select(F.size("features").alias("d"), sums, squares).agg(
        F.max("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("n")).first()
    cells = row["n"] * row["d"]
    variance = row["q"] / cells - (row["s"] / cells) ** 2
    return row["d"], 1.0 / (row["d"] * variance) if variance > 0 else 1.0


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """The kernel of all pairs: one product gives the squared distances times -gamma, the rest works in its place."""
    left = np.column_stack([x, (x * x).sum(axis=1), np.ones(len(x))])
    found = left @ np.vstack([2 * gamma * y.T, np.full(len(y), -gamma), -gamma * (y * y).sum(axis=1)])
    return np.exp(np.minimum(found, 0.0, out=found), out=found)


def landmarks(train: DataFrame, count: int, seed: int = 42) -> np.ndarray:
    """Centres of a k-means run over the whole table, begun by its parallel form of k-means++."""
    vectors = train.select(array_to_vector("features").alias("features"))
    model = KMeans(k=count, initMode="k-means||", initSteps=2, maxIter=5, seed=seed).fit(vectors)
    return np.unique(np.array(model.clusterCenters()), axis=0)


@dataclass
class Nystrom:
    """Features whose inner products stand for the Gaussian kernel."""

    centres: np.ndarray
    gamma: float

    def __post_init__(self):
        values, vectors = np.linalg.eigh(gaussian(self.centres, self.centres, self.gamma))
        kept = values > 1e-10 * values.max()
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.centres, self.gamma)

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) @ self.root

    def map(self, df: DataFrame) -> DataFrame:
        """`df` with `features` replaced, one matrix product per Arrow batch."""

        @F.pandas_udf("array<double>")
        def project(features: pd.Series) -> pd.Series:
            return pd.Series(list(self.features(np.stack(features.to_numpy()))) if len(features) else [], dtype=object)

        return df.withColumn("features", project("features"))


TURN = 2.0 * np.pi


def cosine(turns: np.ndarray) -> np.ndarray:
    """Cosines of angles in whole turns, right to 1e-6: numpy's of single precision are many times as fast as those of doubles."""
    turns -= np.rint(turns)
    return np.cos((turns * TURN).astype(np.float32)).astype(float)


class Fourier:
    """Random Fourier features of the Gaussian kernel (Rahimi and Recht, 2007)."""

    def __init__(self, d: int, gamma: float, size: int = 256, seed: int = 42):
        draw = np.random.default_rng(seed)
        self.weights = draw.normal(0.0, np.sqrt(2.0 * gamma), (size, d)).T
        self.phases = draw.uniform(0.0, 2.0 * np.pi, size)
        self.root = np.eye(size)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosine(x @ (self.weights / TURN) + self.phases / TURN) * np.sqrt(2.0 / len(self.phases))


def kernel_error(df: DataFrame, key: str, features: Nystrom, pairs: int = 1000) -> float:
    """Mean distance between kernel and features over `pairs` pairs of rows, chosen by the hash of their keys."""
    rows = df.select("features").orderBy(F.xxhash64(key), key).limit(2 * pairs).collect()
    x = np.array([r["features"] for r in rows])
    a, b = x[:len(x) // 2], x[len(x) // 2:len(x) // 2 * 2]
    exact = np.exp(-features.gamma * ((a - b) ** 2).sum(axis=1))
    return float(np.abs(exact - (features.features(a) * features.features(b)).sum(axis=1)).mean())


def gaussian_svm(df: DataFrame, c: float = 1.0, count: int = 256, width: float = 0.05, seed: int = 42) -> tuple[Nystrom, Margin, DataFrame]:
    """Gaussian-kernel machine with hinge loss and gamma = 1 / (d * variance): (features, machine, scored test part)."""
    train = df.where("split = 'train'")
    _, gamma = kernel_width(train)
    features = Nystrom(landmarks(train, count, seed), gamma)
    machine, scored = _fit(df, lambda t: train_margin(t, c, width, free_intercept=True, tolerance=1e-5, lift=features))
    return features, machine, scored


def fourier_svm(df: DataFrame, c: float = 1.0, size: int = 256, max_iter: int = 1000, width: float = 0.05, seed: int = 42) -> tuple[Margin, DataFrame]:
    """The same machine on random Fourier features: (machine, scored test part)."""
    df = settle(df)
    features = Fourier(*kernel_width(df.where("split = 'train'")), size, seed)
    return _fit(df, lambda t: train_margin(t, c, width, free_intercept=True, tolerance=1e-5, max_iter=max_iter, lift=features))
