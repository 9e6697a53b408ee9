"""Dense networks with ReLU and dropout, trained by Adam in mini-batches on Spark.

The rows are written once, dealt to mini-batches by a hash of their key and to as many files per batch as its
rows ask for. A step reads one batch; each task forms the gradient of its Arrow blocks with numpy, partial sums
are added in groups, and the driver, which holds nothing but the model, moves the weights. Files are sorted by features:
equal rows next to each other pass the layers before the first dropout once, forward and back. An epoch takes the
batches in an order drawn from the seed. A row's dropout mask is a hash of its key, the epoch, the layer and the
unit, so a task that is run again, or on other partitions, drops the same units.

Weights and moments are written to a folder after every epoch; training goes on from the last whole version there.
Batches grow with the table where `batches` is fixed; the number of steps, each a Spark job, then does not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.functions.blocks import block_sum, matrix
from tallyforge.session import scratch_path

ROWS_A_FILE, LEAST_ROWS_A_FILE = 200_000, 2_000
# Rows whose hidden layers fit into a core's cache.
ROWS_A_STEP = 1024
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7


@dataclass
class DenseNet:
    """Layer widths, the dropout rate behind each hidden layer, and weights: per layer a matrix and its biases."""

    widths: tuple[int, ...]
    dropout: tuple[float, ...] = ()
    seed: int = 42
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.dropout = tuple(self.dropout) or (0.0,) * (len(self.widths) - 2)
        if len(self.dropout) != len(self.widths) - 2 or not all(0 <= r < 1 for r in self.dropout):
            raise ValueError("one dropout rate in [0, 1) for each hidden layer")
        if not self.weights:
            draw = np.random.default_rng(self.seed)
            for a, b in zip(self.widths, self.widths[1:]):
                reach = np.sqrt(6.0 / (a + b))
                self.weights += [draw.uniform(-reach, reach, (a, b)), np.zeros(b)]

    def vector(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def set_vector(self, values: np.ndarray) -> None:
        ends = np.cumsum([w.size for w in self.weights])[:-1]
        self.weights = [part.reshape(w.shape) for part, w in zip(np.split(values, ends), self.weights)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, without dropout."""
        return softmax(forward(self.weights, x, [None] * len(self.dropout))[-1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mixed(rows: np.ndarray, salt: int, width: int) -> np.ndarray:
    """53 random bits for every row hash and unit, by the 64-bit mix of the SplitMix generator."""
    unit = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (rows.astype(np.uint64) ^ np.uint64(salt * 0xD1342543DE82EF95 & (2 ** 64 - 1)))[:, None] + unit[None, :]
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    return z


def hashed_units(rows: np.ndarray, salt: int, width: int) -> np.ndarray:
    """Numbers in [0, 1) for every row hash and unit."""
    return _mixed(rows, salt, width) * 2.0 ** -53


def dropout_masks(net: DenseNet, rows: np.ndarray, epoch: int) -> list[np.ndarray | None]:
    """Per hidden layer 0 for dropped units and 1 / (1 - rate) for the others; None where nothing is dropped."""
    salt = (net.seed * 1_000_003 + epoch) * 64
    return [(_mixed(rows, salt + i + 1, w) >= np.uint64(math.ceil(rate * 2.0 ** 53))) / (1 - rate) if rate else None
            for i, (w, rate) in enumerate(zip(net.widths[1:-1], net.dropout))]


def forward(weights: list[np.ndarray], x: np.ndarray, masks: list[np.ndarray | None]) -> list[np.ndarray]:
    """What each layer passes on: hidden layers after ReLU and dropout, the last as it is."""
    passed = [x]
    for i in range(0, len(weights), 2):
        z = passed[-1] @ weights[i] + weights[i + 1]
        if i + 2 < len(weights):
            z = np.maximum(z, 0.0)
            z = z if masks[i // 2] is None else z * masks[i // 2]
        passed.append(z)
    return passed


def loss_and_gradient(net: DenseNet, x: np.ndarray, y: np.ndarray, rows: np.ndarray, epoch: int) -> np.ndarray:
    """[number of rows, summed cross-entropy, summed gradient of all weights]."""
    total = np.zeros(2 + sum(w.size for w in net.weights))
    for start in range(0, len(y), ROWS_A_STEP):
        part = slice(start, start + ROWS_A_STEP)
        total += _step(net, x[part], y[part], rows[part], epoch)
    return total


def _step(net: DenseNet, x: np.ndarray, y: np.ndarray, rows: np.ndarray, epoch: int) -> np.ndarray:
    masks, weights = dropout_masks(net, rows, epoch), net.weights
    # Runs of equal rows are one row up to the first layer with dropout, or up to the output without any.
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))
    apart = next((k + 1 for k, m in enumerate(masks) if m is not None), len(masks) + 1)
    passed = [x[first]]
    for i in range(0, len(weights), 2):
        z = passed[-1] @ weights[i]
        z += weights[i + 1]
        if i + 2 < len(weights):
            np.maximum(z, 0.0, out=z)
        if len(passed) == apart:
            z = np.repeat(z, np.diff(np.append(first, len(x))), axis=0)
        if i + 2 < len(weights) and masks[i // 2] is not None:
            z *= masks[i // 2]
        passed.append(z)
    p = softmax(passed[-1])
    at = np.arange(len(y))
    loss = -np.log(np.maximum(p[at, y], 1e-300)).sum()
    back, parts = p, []
    back[at, y] -= 1.0
    for k in range(len(weights) // 2, 0, -1):
        if k <= len(masks):
            back = back @ weights[2 * k].T
            back *= passed[k] > 0
            if masks[k - 1] is not None:
                back *= masks[k - 1]
        if k == apart:
            back = np.add.reduceat(back, first, axis=0)
        parts = [(passed[k - 1].T @ back).ravel(), back.sum(axis=0), *parts]
    return np.concatenate([[len(y), loss], *parts])


def deal_batches(train: DataFrame, key: str, batches: int, seed: int, rows_a_file: int = ROWS_A_FILE) -> list[DataFrame]:
    """The mini-batches as frames over files: features, label, and the hash of the row's key."""
    spark = train.sparkSession
    rows_a_batch = -(-train.count() // batches)
    # As many files as the rows ask for, and where that leaves cores idle as many as cores.
    files = max(1, -(-rows_a_batch // rows_a_file), min(spark.sparkContext.defaultParallelism, rows_a_batch // LEAST_ROWS_A_FILE))
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    dealt = train.select("features", F.col("label").cast("int").alias("label"), hashed.alias("row")).withColumns(
        {"batch": F.pmod(F.col("row"), F.lit(batches)).cast("int"), "slice": F.pmod(F.xxhash64("row"), F.lit(files)).cast("int")})
    path = scratch_path(spark, "batches")
    dealt.repartition(batches * files, "batch", "slice").sortWithinPartitions("batch", "features", "row").write.partitionBy("batch").parquet(path)
    whole = spark.read.schema(dealt.schema).parquet(path)
    return [whole.where(F.col("batch") == b).select("features", "label", "row") for b in range(batches)]


def gradient_of(net: DenseNet, batch: DataFrame, epoch: int) -> np.ndarray:
    """`loss_and_gradient` summed over a distributed batch."""

    def block(rows: pa.RecordBatch) -> np.ndarray:
        return loss_and_gradient(net, matrix(rows.column("features")), np.asarray(rows.column("label")), np.asarray(rows.column("row")), epoch)

    return block_sum(batch, block, 2 + sum(w.size for w in net.weights))


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, np.zeros(size), np.zeros(size)

    def move(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m = BETA1 * self.m + (1 - BETA1) * gradient
        self.v = BETA2 * self.v + (1 - BETA2) * gradient ** 2
        rate = self.rate * np.sqrt(1 - BETA2 ** self.step) / (1 - BETA1 ** self.step)
        return weights - rate * self.m / (np.sqrt(self.v) + EPSILON)


_VERSION = "epoch int, step int, loss double, weights array<double>, m array<double>, v array<double>"


def save_version(spark: SparkSession, path: str, epoch: int, loss: float, net: DenseNet, adam: Adam) -> None:
    row = (epoch, adam.step, loss, net.vector().tolist(), adam.m.tolist(), adam.v.tolist())
    spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("append").parquet(path)


def load_version(spark: SparkSession, path: str, net: DenseNet, adam: Adam | None = None) -> int:
    """Puts the newest version into `net` and `adam` and returns its epoch; -1 where the folder has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return -1
    row = spark.read.schema(_VERSION).parquet(path).orderBy(F.desc("epoch")).first()
    if row is None:
        return -1
    net.set_vector(np.array(row["weights"]))
    if adam is not None:
        adam.step, adam.m, adam.v = row["step"], np.array(row["m"]), np.array(row["v"])
    return row["epoch"]


def train_dense(train: DataFrame, net: DenseNet, key: str, batches: int, epochs: int = 10, rate: float = 0.001, path: str | None = None) -> list[float]:
    """Trains `net` on (features, label, key) in place; returns the mean loss of each epoch that was run.

    `path` keeps a version per epoch; a folder that has some is gone on from.
    """
    spark, adam = train.sparkSession, Adam(len(net.vector()), rate)
    path = path or scratch_path(spark, "weights")
    losses, done = [], load_version(spark, path, net, adam)
    parts = deal_batches(train, key, batches, net.seed)
    for epoch in range(done + 1, epochs):
        seen = np.zeros(2)
        for b in np.random.default_rng([net.seed, epoch]).permutation(batches):
            total = gradient_of(net, parts[b], epoch)
            if total[0]:
                net.set_vector(adam.move(net.vector(), total[2:] / total[0]))
                seen += total[:2]
        losses.append(float(seen[1] / max(1, seen[0])))
        save_version(spark, path, epoch, losses[-1], net, adam)
    return losses


def score_dense(net: DenseNet, rows: DataFrame) -> DataFrame:
    """Adds `probability` and `prediction`, the first class of the highest one."""
    @F.pandas_udf("array<double>")
    def probability(features: pd.Series) -> pd.Series:
        return pd.Series(list(net.probabilities(np.stack(features.to_numpy()))) if len(features) else [], dtype=object)

    scored = rows.withColumn("probability", probability("features"))
    return scored.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
