"""Scoring, alignment, and the whole preparation job against a pandas walk through it."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesprep.functions.labels import softmax
from seriesprep.operators import evaluate as ev
from seriesprep.operators.event_index import index_events
from seriesprep.plans import classify, prepare
from tests.support import (
    AB,
    assert_rows,
    by_event,
    frames_by_event,
    pandas_impute,
    pandas_resample,
    plan_of,
    random_rows,
    recording,
)

RANGES = {"P-A": (-3.0, 3.0), "T-B": (-3.0, 3.0)}
SECONDS, N = 3, 4


def is_valid(part):
    return part[["P-A", "T-B"]].fillna(0).abs().max().max() <= 3


def walk(parts, train):
    """Mean and deviation over the train events, then windows of every event."""
    scaler = {}
    for s in AB.sensors:
        mu = pd.Series([parts[e][s].mean() for e in train]).mean()
        std = []
        for e in train:
            x = parts[e][s]
            with np.errstate(all="ignore"):
                std.append(np.sqrt(np.float64(np.nansum((x - mu) ** 2)) / (x.notna().sum() - 1)))
        scaler[s] = (mu, pd.Series(std).mean())
    result = {}
    for e, part in parts.items():
        dense = pandas_impute(pandas_resample(part, SECONDS), int(part["class_code"].iloc[0]))
        for s in AB.sensors:
            dense[s] = (dense[s] - scaler[s][0]) / scaler[s][1]
        steps = dense[list(AB.sensors)].to_numpy()
        labels = dense["class"].astype(int).map(lambda y: y - 100 if y >= 100 else y).to_list()
        result[e] = [
            (i, *steps[i : i + N].flatten().tolist(), labels[i + N - 1])
            for i in range(len(steps) - N + 1)
        ]
    return {e: rows for e, rows in result.items() if rows}


def flat_rows(windows):
    rows = by_event(windows, "window_idx", ["window_idx", "X", "label"])
    return {e: [(i, *sum(x, []), y) for i, x, y in part] for e, part in rows.items()}


def job_rows():
    # Every event has several values of each sensor, so no deviation is infinite.
    rows = random_rows(31, events=10, longest=150)
    sizes = {e: (p["P-A"].notna().sum(), p["T-B"].notna().sum()) for e, p in frames_by_event(rows).items()}
    return [r for r in rows if min(sizes[r[0]]) > 2]


@pytest.mark.parametrize("size", [32_768, 9])
def test_prepare_windows(spark, size):
    rows = job_rows()
    parts = {e: p for e, p in frames_by_event(rows).items() if is_valid(p)}
    assert 2 < len(parts)
    wanted = walk(parts, list(parts))
    samples = recording(spark, rows).repartition(4)
    found = flat_rows(prepare.prepare_windows(samples, AB, None, SECONDS, N, RANGES, size=size))
    assert set(found) == set(wanted)
    for e in wanted:
        assert_rows(found[e], wanted[e])


@pytest.mark.parametrize("size", [32_768, 9])
def test_prepare_split_fits_on_train_only(spark, size):
    rows = job_rows()
    parts = {e: p for e, p in frames_by_event(rows).items() if is_valid(p)}
    names = sorted(parts)
    split = {e: ("test" if i % 3 == 0 else "train") for i, e in enumerate(names)}
    wanted = walk(parts, [e for e in names if split[e] == "train"])
    divided = spark.createDataFrame(list(split.items()), "event_id string, split string")
    windows = prepare.prepare_split(recording(spark, rows), divided, AB, SECONDS, N, RANGES, size=size)
    found = flat_rows(windows)
    assert set(found) == set(wanted)
    for e in wanted:
        assert_rows(found[e], wanted[e])
    labels = {r["event_id"]: r["split"] for r in windows.select("event_id", "split").distinct().collect()}
    assert labels == {e: split[e] for e in wanted}


def test_train_events_may_be_checked_in_more_sensors(spark):
    rows = [(e, s, float(s), 9.0 if e in "ab" and s == 2 else 0.0, 0.0, 0) for e in "abcd" for s in range(6)]
    divided = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train"), ("d", "train")], "event_id string, split string")
    only_a, ranges = AB.select_sensors("P-A"), {"P-A": (-9, 9), "T-B": (-1, 1)}
    samples = recording(spark, rows)
    loose = prepare.prepare_split(samples, divided, only_a, 1, 3, ranges)
    strict = prepare.prepare_split(samples, divided, only_a, 1, 3, ranges, train_layout=AB)
    events = lambda w: {r["event_id"] for r in w.select("event_id").distinct().collect()}
    assert events(loose) == set("abcd") and events(strict) == set("bcd")


def test_tensor_stats_and_summary(spark):
    rows = job_rows()
    samples = recording(spark, rows)
    windows = prepare.prepare_windows(samples, AB, {"P-A": (0, 1), "T-B": (0, 1)}, SECONDS, N, RANGES)
    wanted = walk_stats(flat_rows(windows))
    stats, summary = prepare.verify_windows(windows, AB)
    found = {r["event_id"]: r for r in stats.collect()}
    assert set(found) == set(wanted)
    for e, w in wanted.items():
        r = found[e]
        assert_rows([(r["min:P-A"], r["max:P-A"], r["min:T-B"], r["max:T-B"], r["share:0"])], [w])
    least = {r["statistic"]: r for r in summary.collect()}["min:P-A"]
    lows = [w[0] for w in wanted.values()]
    assert_rows(
        [(least["smallest"], least["average"], least["largest"], least["total"])],
        [(min(lows), sum(lows) / len(lows), max(lows), sum(lows))],
    )


def walk_stats(rows):
    result = {}
    for e, part in rows.items():
        a = [v for r in part for v in r[1:-1:2]]
        b = [v for r in part for v in r[2:-1:2]]
        share = sum(r[-1] == 0 for r in part) / len(part)
        result[e] = (min(a), max(a), min(b), max(b), share)
    return result


def test_align_predictions(spark):
    rows = [("e", s, 1.0, 1.0, 0.0, 0) for s in range(12)]
    samples = recording(spark, rows)
    predictions = spark.createDataFrame([("e", 0, 5), ("e", 1, 7)], "event_id string, window_idx long, predicted int")
    aligned = ev.align_predictions(samples, index_events(samples, AB), predictions, 3, 3, ["predicted"])
    assert [r["predicted"] for r in aligned.orderBy("ts").collect()] == [None] * 6 + [5] * 3 + [7] * 3


def test_confusion_accuracy_and_loss(spark):
    scored = spark.createDataFrame(
        [(0, [0.7, 0.2, 0.1]), (1, [0.5, 0.4, 0.1]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0])],
        "label int, probability array<double>",
    )
    scored = ev.predicted_class(scored)
    matrix = [tuple(r) for r in ev.confusion_matrix(scored, 3).collect()]
    assert matrix == [(0, 1, 0, 0), (1, 1, 1, 0), (2, 1, 0, 0)]
    quality = ev.accuracy_and_loss(scored).first()
    losses = [-math.log(p) for p in (0.7, 0.4, 1.0, 1e-7)]
    assert_rows([tuple(quality)], [(4, 0.5, sum(losses) / 4)])


def test_labels_are_matched_by_window(spark):
    predictions = spark.createDataFrame([("a", 1, 3), ("a", 0, 2)], "event_id string, window_idx long, predicted int")
    labels = spark.createDataFrame([("a", 0, 2), ("a", 1, 4), ("b", 0, 1)], "event_id string, window_idx long, label int")
    found = ev.match_labels(predictions, labels, "event_id").orderBy("window_idx")
    assert [(r["predicted"], r["label"]) for r in found.collect()] == [(2, 2), (3, 4)]


def test_softmax_sums_to_one(spark):
    row = spark.createDataFrame([([1.0, 2.0, 800.0],)], "s array<double>").select(softmax(F.col("s")).alias("p")).first()
    assert_rows([(sum(row["p"]), row["p"][2])], [(1.0, 1.0)])


@pytest.fixture(scope="module")
def labelled(spark):
    """Windows whose label shows in the level of the first sensor."""
    rows = []
    for e in range(12):
        code = (0, 4)[e % 2]
        rows += [(f"e{e:02d}", s, 3.0 * (code > 0) + 0.1 * (s % 5), 0.0, float(code), code) for s in range(20)]
    scaler = {"P-A": (1.5, 1.5), "T-B": (0.0, 1.0)}
    ranges = {"P-A": (-9, 9), "T-B": (-9, 9)}
    windows = prepare.prepare_windows(recording(spark, rows), AB, scaler, 1, 4, ranges)
    return windows.repartition(2, "event_id").sortWithinPartitions("event_id", "window_idx").persist()


def test_classifier_beats_the_majority_class(spark, labelled):
    train = labelled.filter("event_id < 'e08'")
    model = classify.fit_window_classifier(train, 4, AB, hidden=4, max_iter=30)
    scored, matrix, quality = classify.evaluate_model(model, labelled.filter("event_id >= 'e08'"))
    assert quality.first()["accuracy"] > 0.9
    assert matrix.count() == 9 and scored.filter("size(probability) <> 9").isEmpty()


def test_search_ranks_by_validation_accuracy(spark, labelled):
    train, validation = labelled.filter("event_id < 'e08'"), labelled.filter("event_id >= 'e08'")
    grid = [{"hidden": 4, "max_iter": 1}, {"hidden": 4, "max_iter": 30}]
    model, results = classify.search_classifier(train, validation, 4, AB, grid)
    accuracies = [a for _, a in results]
    assert accuracies == sorted(accuracies, reverse=True) and len(results) == 2
    again = ev.accuracy_and_loss(classify.score_windows(model, validation)).first()["accuracy"]
    assert again == accuracies[0]


def test_scoring_with_a_model_of_ones_own(spark, labelled):
    def make():
        def predict(batch):
            level = batch[:, :, 0].mean(axis=1) > 0
            out = np.zeros((len(batch), 9))
            out[:, 0], out[:, 4] = ~level, level
            return out

        return predict

    scored = classify.score_with(labelled, make, [4, 2])
    assert ev.accuracy_and_loss(scored).first()["accuracy"] == 1.0


def test_scan_reads_only_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "samples")
    wide = recording(spark, random_rows(3, events=3)).withColumn("other", F.lit(1.0))
    wide.write.parquet(path)
    samples = spark.read.parquet(path)
    only_a = AB.select_sensors("P-A")
    windows = prepare.prepare_windows(samples, only_a, {"P-A": (0, 1)}, 3, 4, RANGES)
    schema = plan_of(windows).split("ReadSchema: ")[1]
    assert "P-A" in schema and "T-B" not in schema and "other" not in schema
