"""Recurrent classifier, its early stopping and its search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesprep.plans import classify
from seriesprep.plans import recurrent as rc
from seriesprep.schema import SeriesLayout

AB = SeriesLayout(("P-A", "T-B"), "event_id")
STEPS = 12


@pytest.mark.parametrize("units, both", [((3,), False), ((3, 2), False), ((2,), True), ((2, 3), True)])
def test_gradient_equals_differences(units, both):
    rng = np.random.default_rng(1)
    network = rc.Network(5, 2, units, both, dense=4, classes=3)
    weights = network.start() + rng.normal(0, 0.1, len(network.start()))
    x, labels = rng.normal(size=(6, 5, 2)), rng.integers(0, 3, 6)
    _, by_weights = rc.gradient(network, weights, x, labels)
    for k in rng.permutation(len(weights))[:60]:
        step = np.zeros(len(weights))
        step[k] = 1e-5
        up, down = (rc.gradient(network, weights + s, x, labels)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - by_weights[k]) < 1e-6


@pytest.mark.parametrize("units, both", [((16,), False), ((3, 2), False), ((2, 3), True)])
def test_a_pass_works_in_the_precision_of_its_windows(units, both):
    rng = np.random.default_rng(2)
    network = rc.Network(20, 5, units, both, dense=16, dropout=0.5)
    weights = network.start()
    x, labels = rng.normal(0, 3, (64, 20, 5)), rng.integers(0, 9, 64)
    loss, by_weights = rc.gradient(network, weights, x, labels, np.random.default_rng(0))
    narrow_loss, narrow = rc.gradient(network, weights, x.astype(np.float32), labels, np.random.default_rng(0))
    assert by_weights.dtype == np.float64 and narrow.dtype == np.float32
    assert abs(loss - narrow_loss) < 1e-5 and np.allclose(by_weights, narrow, atol=1e-5)
    far = rc.forward(network, weights, 1e6 * x.astype(np.float32))[0]
    assert np.isfinite(far).all() and np.allclose(far.sum(axis=1), 1, atol=1e-5)


def test_dropout_leaves_out_and_scales():
    network = rc.Network(3, 1, (50,), dropout=0.5)
    x = np.ones((40, 3, 1))
    _, (_, mask, _, _) = rc.forward(network, network.start(), x, np.random.default_rng(0))
    assert set(np.unique(mask)) == {0.0, 2.0} and 0.4 < (mask > 0).mean() < 0.6
    assert (rc.forward(network, network.start(), x)[1][1] == 1).all()


@pytest.fixture(scope="module")
def ordered(spark):
    """A spike of each of two sensors at random steps: the label tells which one came first."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(1_500):
        x = rng.normal(0, 0.1, (STEPS, 2))
        first, second = sorted(rng.choice(STEPS, 2, replace=False))
        label = int(rng.integers(2))
        x[first, label], x[second, 1 - label] = 2.0, 2.0
        rows.append((f"e{k % 50:02d}", k // 50, x.tolist(), label))
    frame = spark.createDataFrame(rows, "event_id string, window_idx long, X array<array<double>>, label int")
    frame = frame.repartition(3, "event_id").sortWithinPartitions("event_id", "window_idx").persist()
    return frame.filter("event_id < 'e40'"), frame.filter("event_id >= 'e40'")


NETWORK = rc.Network(STEPS, 2, (12,), dense=16, dropout=0.1, rate=0.02, classes=9)


def test_learns_the_order_of_steps(ordered):
    train, validation = ordered
    trained = rc.fit_recurrent(train, validation, NETWORK, max_rounds=25, patience=10)
    scored = rc.score_recurrent(trained, validation)
    accuracy = classify.accuracy_and_loss(scored).first()["accuracy"]
    assert accuracy == max(trained.history) > 0.95
    flat = classify.fit_window_classifier(train, STEPS, AB, hidden=16, max_iter=50)
    assert classify.accuracy_and_loss(classify.score_windows(flat, validation)).first()["accuracy"] < accuracy


def test_stops_early_and_goes_on_after_a_kill(spark, ordered, tmp_path):
    train, validation = ordered
    path = str(tmp_path / "run")
    still = rc.replace(NETWORK, rate=0.0)
    whole = rc.fit_recurrent(train, validation, still, max_rounds=20, patience=2, path=path)
    assert whole.best_round == 1 and len(whole.history) == 3
    straight = rc.fit_recurrent(train, validation, NETWORK, max_rounds=4)
    path = str(tmp_path / "killed")
    rc.fit_recurrent(train, validation, NETWORK, max_rounds=2, path=path)
    (tmp_path / "killed" / "round=3" / "_temporary").mkdir(parents=True)  # a round that was not finished
    again = rc.fit_recurrent(train, validation, NETWORK, max_rounds=4, path=path)
    assert again.history == straight.history and again.best_round == straight.best_round
    assert np.array_equal(again.weights, straight.weights)
    with pytest.raises(ValueError):
        rc.fit_recurrent(train, validation, still, path=path)


def test_halving_finds_the_winner_of_the_whole_grid_with_fewer_passes(ordered):
    train, validation = ordered
    grid = [rc.replace(NETWORK, rate=r) for r in (0.0, 1e-5, 1e-4, 0.02, 1e-6, 0.0, 1e-5, 1e-4, 1e-6)]
    whole = rc.successive_halving(train, validation, [(grid, 9)], 9)
    cut = rc.successive_halving(train, validation, [(grid, 1)], 9)
    assert (whole.window_passes, cut.window_passes) == (81, 9 + 3 * 2 + 1 * 6)
    assert cut.scans == 9 and cut.ranking[0].network == whole.ranking[0].network == grid[3]
    assert cut.ranking[0].accuracy == whole.ranking[0].accuracy
    assert [t.accuracy for t in cut.ranking] == sorted((t.accuracy for t in cut.ranking), reverse=True)


def test_brackets():
    assert rc.bracket_sizes(9, 3) == [(9, 1), (5, 3), (3, 9)]
    assert rc.bracket_sizes(1, 3) == [(1, 1)]


def test_hyperband_shares_passes_between_brackets(ordered):
    train, validation = ordered
    made = []

    def draw(rng):
        made.append(rc.replace(NETWORK, rate=float(10 ** rng.uniform(-4, -1))))
        return made[-1]

    found = rc.hyperband(train, validation, draw, max_rounds=3, iterations=1)
    assert len(made) == 5 and found.scans == 3 and len(found.ranking) == 5
    assert found.window_passes == 3 + 1 * 2 + 2 * 3
    network = rc.draw_network(AB, STEPS)(np.random.default_rng(0))
    assert network.steps == STEPS and network.units and 1e-5 <= network.rate <= 0.1


def test_no_windows(ordered):
    train, validation = ordered
    weights = NETWORK.start()
    same = rc.train_round(train.limit(0), {"m": (NETWORK, weights)}, 1)["m"]
    assert np.array_equal(same, weights)
    assert rc.quality(train.filter(F.lit(False)), {"m": (NETWORK, weights)}) == {"m": (0, None, None)}
    with pytest.raises(ValueError):
        rc.fit_recurrent(train, validation.limit(0), NETWORK)
