"""Newton's optimum, its gradient by other means, and Nystrom features against the kernel."""

import numpy as np
import pytest

from tallyforge.operators import margins, metrics

DRAW = np.random.default_rng(21)


@pytest.fixture(scope="module")
def noisy():
    x = DRAW.normal(size=(400, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + 0.4 + DRAW.normal(size=400) > 0).astype(int)
    return x, y


def frame(spark, x, y, parts=5):
    rows = [(i, a.tolist(), int(b), "test" if i % 5 == 0 else "train") for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, label int, split string").repartition(parts)


def slope(x, y, w, b, c):
    s = np.where(y > 0, 1.0, -1.0)
    gap = np.maximum(0, 1 - s * (x @ w + b))
    return np.append(w - 2 * c * x.T @ (gap * s), b - 2 * c * (gap * s).sum())


@pytest.mark.parametrize("matrix_columns", [1024, 0])
def test_squared_hinge_ends_where_the_slope_is_zero(spark, noisy, matrix_columns):
    x, y = noisy
    machine = margins.train_margin(frame(spark, x, y), c=0.7, matrix_columns=matrix_columns)
    assert np.linalg.norm(slope(x, y, machine.coefficients, machine.intercept, 0.7)) < 1e-6
    assert machine.gradient_norm < 1e-6
    # Any step away is worse.
    value = lambda w: w @ w / 2 + 0.7 * (np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w[:-1] + w[-1])) ** 2).sum()
    best = np.append(machine.coefficients, machine.intercept)
    assert machine.value == pytest.approx(value(best))
    assert all(value(best + 1e-3 * DRAW.normal(size=5)) > machine.value for _ in range(50))


def test_few_passes_with_the_matrix(spark, noisy):
    assert margins.train_margin(frame(spark, *noisy)).passes < 25


@pytest.mark.parametrize("width", [None, 0.3, 0.01])
def test_derivatives_of_the_losses(width):
    z, h = np.linspace(-3, 3, 1001) + 1e-4, 1e-7
    loss, first, second = margins.losses(z, width)
    assert np.abs((margins.losses(z + h, width)[0] - margins.losses(z - h, width)[0]) / (2 * h) - first).max() < 1e-4
    slope_ = (margins.losses(z + h, width)[1] - margins.losses(z - h, width)[1]) / (2 * h)
    assert np.abs(slope_ - second).max() < 1e-4 and (loss >= 0).all()
    hinge = np.maximum(0, 1 - z)
    assert width is None or np.abs(loss - hinge).max() <= width / 4 + 1e-12


def exact_machine(kernel, y, c):
    """The dual of the hinge machine by pairs that violate most."""
    s, a = np.where(y > 0, 1.0, -1.0), np.zeros(len(y))
    g = -np.ones(len(y))
    q = kernel * s[:, None] * s[None, :]
    for _ in range(200_000):
        up, down = np.where((s > 0) & (a < c) | (s < 0) & (a > 0), -s * g, -np.inf), np.where((s < 0) & (a < c) | (s > 0) & (a > 0), -s * g, np.inf)
        i, j = up.argmax(), down.argmin()
        if up[i] - down[j] < 1e-6:
            break
        room = min(c - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else c - a[j])
        move = min(room, (up[i] - down[j]) / max(1e-12, kernel[i, i] + kernel[j, j] - 2 * kernel[i, j]))
        old_i, old_j = a[i], a[j]
        a[i] += s[i] * move
        a[j] -= s[j] * move
        g += q[:, i] * (a[i] - old_i) + q[:, j] * (a[j] - old_j)
    return a * s, (up[i] + down[j]) / 2


def test_gaussian_machine_agrees_with_the_exact_one(spark):
    radius, angle = np.where(DRAW.random(500) < 0.4, DRAW.uniform(0, 1.2, 500), DRAW.uniform(0.9, 2.5, 500)), DRAW.uniform(0, 6.283, 500)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    y = (radius > 1).astype(int)
    y[DRAW.random(500) < 0.05] ^= 1
    df = frame(spark, x, y)
    features, machine, scored = margins.gaussian_svm(df, count=80, width=0.02)
    train = np.array([i for i in range(500) if i % 5])
    assert features.gamma == pytest.approx(1 / (2 * x[train].var()))
    dual, b = exact_machine(margins.gaussian(x[train], x[train], features.gamma), y[train], 1.0)
    exact = {i: float(margins.gaussian(x[i:i + 1], x[train], features.gamma)[0] @ dual + b) for i in range(0, 500, 5)}
    got = {r.id: (r.margin, r.prediction) for r in scored.collect()}
    assert sum((exact[i] > 0) == (got[i][1] == 1) for i in got) >= 0.98 * len(got)
    assert np.mean([abs(exact[i] - got[i][0]) for i in got]) < 0.05
    assert margins.kernel_error(df, "id", features, 200) < 0.02


def test_landmarks_that_are_all_rows_give_the_kernel(spark):
    x = DRAW.normal(size=(40, 3))
    features = margins.Nystrom(x, 0.4)
    assert np.abs(features.features(x) @ features.features(x).T - margins.gaussian(x, x, 0.4)).max() < 1e-6
    mapped = features.map(frame(spark, x, np.zeros(40))).collect()
    assert np.allclose([r.features for r in mapped], features.features(np.array([x[r.id] for r in mapped])))


def test_scores_and_errors(spark, noisy):
    machine, scored = margins.linear_svm(frame(spark, *noisy))
    assert metrics.accuracy(scored).first()[0] > 0.75
    row = scored.first()
    assert row.margin == pytest.approx(float(np.dot(row.features, machine.coefficients) + machine.intercept))
    with pytest.raises(ValueError):
        margins.train_margin(scored.where("false"))


@pytest.mark.parametrize("kind", ["landmarks", "fourier"])
@pytest.mark.parametrize("matrix_columns", [1024, 0])
def test_kernels_made_inside_tasks_train_the_machine_of_their_features(spark, noisy, kind, matrix_columns):
    x, y = noisy
    lift = margins.Nystrom(x[:25], 0.3) if kind == "landmarks" else margins.Fourier(4, 0.3, 30)
    mapped = lift.raw(x) @ lift.root
    how = {"c": 0.5, "width": 0.3, "free_intercept": True, "matrix_columns": matrix_columns}
    plain, inside = margins.train_margin(frame(spark, mapped, y), **how), margins.train_margin(frame(spark, x, y), **how, lift=lift)
    assert inside.value == pytest.approx(plain.value, rel=1e-9)
    assert np.abs(inside.coefficients - plain.coefficients).max() < 1e-4 * np.abs(plain.coefficients).max()
    scored = {r["id"]: r["margin"] for r in inside.score(frame(spark, x, y)).collect()}
    assert np.allclose([scored[i] for i in range(len(x))], mapped @ inside.coefficients + inside.intercept)


def test_passes_read_blocks(spark, monkeypatch):
    """A pass reads blocks of bounded bytes, and no list per row."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(rng.normal(size=4).tolist(), float(i % 3 == 0)) for i in range(900)], "features array<double>, label double").repartition(3)
    whole = margins.train_margin(rows)
    read, plain = [], margins.block_sum
    monkeypatch.setattr(margins, "PACK_BYTES", 32 * 50)
    monkeypatch.setattr(margins, "block_sum", lambda df, run, size: read.append([(len(r["x"]), len(r["y"])) for r in df.collect()]) or plain(df, run, size))
    cut = margins.train_margin(rows)
    assert np.allclose(cut.coefficients, whole.coefficients, atol=1e-9) and cut.gradient_norm <= 1e-7
    assert all(x == 4 * y and x <= 32 * 50 for blocks in read for x, y in blocks) and sum(y for _, y in read[0]) == 8 * 900


def test_blocks_of_the_cache_and_cosines(spark, noisy, monkeypatch):
    """However the columns of a pass are cut, sums are the same; cosines are numpy's."""
    x, y = noisy
    lift, how = margins.Fourier(4, 0.3, 30), {"c": 0.5, "width": 0.3, "free_intercept": True}
    whole = margins.train_margin(frame(spark, x, y), **how, lift=lift)
    monkeypatch.setattr(margins, "CACHE_BYTES", 1)
    cut = margins.train_margin(frame(spark, x, y), **how, lift=lift)
    assert np.allclose(cut.coefficients, whole.coefficients, atol=1e-6)
    assert np.abs(lift.raw(x) - np.sqrt(2 / 30) * np.cos(x @ lift.weights + lift.phases)).max() < 1e-6


def test_a_share_of_the_rows_leaves_few_passes_over_all(spark, monkeypatch):
    """The end is that of all rows, wherever a descent begins, and most passes read the share."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 3))
    y = ((x ** 2).sum(axis=1) + rng.normal(size=6000) > 3).astype(int)
    lift, how = margins.Nystrom(x[:40], 0.3), {"width": 0.05, "free_intercept": True, "tolerance": 1e-6}
    rows = frame(spark, x, y)
    plain = margins.train_margin(rows, **how, lift=lift)
    monkeypatch.setattr(margins, "EARLY_ROWS", 200)
    led = margins.train_margin(rows, **how, lift=lift)
    assert led.passes < plain.passes and led.passes < 20
    assert led.value == pytest.approx(plain.value, rel=1e-9) and np.allclose(led.coefficients, plain.coefficients, atol=1e-3 * np.abs(plain.coefficients).max())


def test_missing_numbers_end_at_once(spark, noisy):
    x, y = noisy[0].copy(), noisy[1]
    x[3, 1] = np.nan
    machine = margins.train_margin(frame(spark, x, y), c=0.5, width=0.3, free_intercept=True, lift=margins.Fourier(4, 0.3, 30))
    assert machine.passes < 10 and not machine.coefficients.any()
