"""Distributed steps equal single-process ones; ReLU networks learn what lines can't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import metrics, nets
from tallyforge.operators.nets import Adam, DenseNet

DRAW = np.random.default_rng(8)


@pytest.fixture(scope="module")
def table(spark):
    x = DRAW.normal(size=(700, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(int)
    rows = [(i, a.tolist(), int(b), "test" if i % 5 == 0 else "train") for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, label int, split string")


def plain_loss(net, x, y, masks):
    """Row by row, unit by unit."""
    total = 0.0
    for r in range(len(x)):
        out = list(x[r])
        for i in range(0, len(net.weights), 2):
            w, b = net.weights[i], net.weights[i + 1]
            out = [sum(out[k] * w[k, j] for k in range(len(out))) + b[j] for j in range(len(b))]
            if i + 2 < len(net.weights):
                mask = masks[i // 2]
                out = [max(v, 0.0) * (1.0 if mask is None else mask[r, j]) for j, v in enumerate(out)]
        e = np.exp(np.array(out) - max(out))
        total -= np.log(e[y[r]] / e.sum())
    return total


def test_gradient_is_the_slope_of_the_plain_loss():
    net = DenseNet((3, 5, 4, 3), (0.0, 0.4), seed=3)
    x, y, rows = DRAW.normal(size=(9, 3)), DRAW.integers(0, 3, 9), DRAW.integers(-2 ** 62, 2 ** 62, 9)
    masks = nets.dropout_masks(net, rows, epoch=2)
    found = nets.loss_and_gradient(net, x, y, rows, epoch=2)
    assert found[0] == 9 and found[1] == pytest.approx(plain_loss(net, x, y, masks), abs=1e-10)
    at = net.vector()
    for k in range(len(at)):
        sides = []
        for h in (1e-6, -1e-6):
            net.set_vector(at + h * (np.arange(len(at)) == k))
            sides.append(plain_loss(net, x, y, masks))
        assert found[2 + k] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-5)


def test_masks_follow_rows_and_epochs():
    net = DenseNet((2, 400, 2), (0.25,))
    rows = DRAW.integers(-2 ** 62, 2 ** 62, 500)
    mask = nets.dropout_masks(net, rows, 0)[0]
    assert set(np.unique(mask)) == {0.0, 1 / 0.75} and abs((mask == 0).mean() - 0.25) < 0.01
    assert abs((mask == 0).mean(axis=0) - 0.25).max() < 0.1 and abs((mask == 0).mean(axis=1) - 0.25).max() < 0.1
    assert (nets.dropout_masks(net, rows[::-1], 0)[0][::-1] == mask).all()
    assert (nets.dropout_masks(net, rows, 1)[0] != mask).mean() > 0.3


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_a_distributed_step_equals_one_process(table, parts, monkeypatch):
    monkeypatch.setattr(nets, "ROWS_A_FILE", 60)
    net, alone = (DenseNet((3, 16, 8, 2), (0.2, 0.5)) for _ in range(2))
    batch = nets.deal_batches(table.repartition(parts), "id", 2, seed=42, rows_a_file=60)[1].repartition(parts)
    rows = batch.collect()
    assert 250 < len(rows) < 450
    x, y, row = np.array([r.features for r in rows]), np.array([r.label for r in rows]), np.array([r.row for r in rows])
    first, second = Adam(len(net.vector()), 0.01), Adam(len(net.vector()), 0.01)
    for epoch in range(3):
        many, one = nets.gradient_of(net, batch, epoch), nets.loss_and_gradient(alone, x, y, row, epoch)
        assert np.abs(many - one).max() < 1e-9
        net.set_vector(first.move(net.vector(), many[2:] / many[0]))
        alone.set_vector(second.move(alone.vector(), one[2:] / one[0]))
        assert np.abs(net.vector() - alone.vector()).max() < 1e-9


def test_partial_sums_in_groups(table):
    from tallyforge.functions.blocks import block_sum, matrix

    block = lambda b: np.append(matrix(b.column("features")).sum(axis=0), b.num_rows)
    want = np.append(np.array([r.features for r in table.collect()]).sum(axis=0), 700)
    for parts, fan in ((1, 64), (30, 3), (30, 30), (29, 2)):
        assert block_sum(table.repartition(parts), block, 4, fan) == pytest.approx(want)
    assert (block_sum(table.where("false"), block, 4) == 0).all()


def test_learns_a_curved_border_and_goes_on_from_a_version(spark, table, tmp_path):
    train, test = (table.where(f"split = '{s}'") for s in ("train", "test"))
    path = str(tmp_path / "w")
    net = DenseNet((3, 32, 16, 2), (0.0, 0.1))
    losses = nets.train_dense(train, net, "id", batches=4, epochs=12, rate=0.02, path=path)
    assert losses[-1] < 0.5 * losses[0]
    assert metrics.accuracy(nets.score_dense(net, test)).first()[0] > 0.85
    # Broken off after some epochs, a second run ends at the same weights.
    again = DenseNet((3, 32, 16, 2), (0.0, 0.1))
    half = str(tmp_path / "h")
    nets.train_dense(train, again, "id", batches=4, epochs=5, rate=0.02, path=half)
    resumed = DenseNet((3, 32, 16, 2), (0.0, 0.1))
    assert len(nets.train_dense(train, resumed, "id", batches=4, epochs=12, rate=0.02, path=half)) == 7
    assert np.abs(resumed.vector() - net.vector()).max() < 1e-9
    row = nets.score_dense(net, test).first()
    assert sum(row.probability) == pytest.approx(1) and row.prediction == int(np.argmax(row.probability))


def test_bad_rates():
    with pytest.raises(ValueError):
        DenseNet((2, 3, 2), (1.0,))


@pytest.mark.parametrize("dropout", [(0.0, 0.0), (0.0, 0.3), (0.4, 0.0)])
def test_equal_rows_lie_together_and_count_as_often(spark, dropout):
    x = DRAW.normal(size=(9, 3))
    rows = spark.createDataFrame([(i, x[i % 9].tolist(), i % 2) for i in range(3000)], "id long, features array<double>, label int").repartition(6)
    batch = nets.deal_batches(rows, "id", 2, seed=42, rows_a_file=1000)[0]
    pieces = batch.withColumn("file", F.input_file_name()).collect()
    changes = sum(a.file != b.file or a.features != b.features for a, b in zip(pieces, pieces[1:]))
    assert len(pieces) > 1300 and changes < 9 * len({r.file for r in pieces})
    net = DenseNet((3, 16, 8, 2), dropout)
    y, row = np.array([r.label for r in pieces]), np.array([r.row for r in pieces])
    alone = sum(nets.loss_and_gradient(net, np.array([r.features]), y[k:k + 1], row[k:k + 1], 1) for k, r in enumerate(pieces))
    assert np.abs(nets.gradient_of(net, batch, 1) - alone).max() < 1e-9
