"""Global metrics: reference values, tie and null rules, one scan instead of two."""

import math

import numpy as np
import pandas as pd
import pytest

from seriesprep.operators import metrics as mt
from seriesprep.operators.event_index import index_events, moment_columns
from seriesprep.schema import SeriesLayout
from tests.support import AB, assert_rows, frames_by_event, plan_of, random_rows, recording

ONE = SeriesLayout(("x",), "event_id")


def per_event(spark, values):
    rows = [(f"e{i:03d}", None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "event_id string, x double")


@pytest.mark.parametrize(
    "values, k, wanted",
    [
        ([1, 2, 3, 4, 5], 0, 3.0),
        ([-10, 2, 3, 4, 50], 1, 3.0),
        ([2, 3, 4, None], 1, 3.0),
        ([1, 2, 30], 1, 2.0),
        ([4, 5, 60], 1, 5.0),
        ([1, 5, 5], 2, None),
        ([5, 5, 5], 2, 5.0),
        ([3, 3, 3, 1, 9], 2, 3.0),
        ([1e30, 1, 2, 3, -1e30], 1, 2.0),
    ],
)
@pytest.mark.parametrize("listed", [1_000, 0])
def test_trimmed_mean(spark, monkeypatch, listed, values, k, wanted):
    monkeypatch.setattr(mt, "MAX_LISTED_TRIM", listed)
    assert mt.as_mapping(mt.trimmed_mean(per_event(spark, values), ONE, k), ONE) == {"x": wanted}


def test_trimmed_mean_against_pandas(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.2 else float(rng.integers(0, 12)) for _ in range(60)]
    column = pd.Series(values, dtype=float)
    for k in (1, 4, 20):
        drop = set(column.nsmallest(k).index) | set(column.nlargest(k).index)
        wanted = column.drop(list(drop)).mean()
        found = mt.as_mapping(mt.trimmed_mean(per_event(spark, values), ONE, k), ONE)["x"]
        assert found == pytest.approx(wanted)


def test_no_event_gives_no_metric(spark):
    nothing = per_event(spark, [1.0]).limit(0)
    assert mt.as_mapping(mt.trimmed_mean(nothing, ONE, 2), ONE) == {"x": None}


def stds(spark, values, mu, **options):
    rows = [("e", s, None if v is None else float(v), 1.0, 0.0, 0) for s, v in enumerate(values)]
    index = index_events(recording(spark, rows), AB, extra=moment_columns(AB))
    return mt.event_stds(index, {"P-A": mu, "T-B": 1.0}, **options).first()["P-A"]


@pytest.mark.parametrize(
    "values, mu, wanted",
    [
        ([1, 2, 3, 4, 5], 3, 1.5811388300842),
        ([1, 2, 3, 4, None], 2.5, 1.2909944487358),
        ([3, 4, 5], 3, 1.58113883),
        ([None, None], 7, 0.0),
        ([None, None, 19], 18, math.inf),
        ([None, 18], 18, None),
        ([1e9, 1e9 + 1, 1e9 + 2], 0, math.sqrt((3e18 + 6e9 + 5) / 2)),
    ],
)
def test_event_std_about_global_mean(spark, values, mu, wanted):
    found = stds(spark, values, mu)
    assert found == pytest.approx(wanted) if wanted is not None else found is None


def test_event_without_values_can_be_skipped(spark):
    assert stds(spark, [None, None], 7, skip_empty=True) is None


def test_metric_table_against_numpy(spark):
    rows = [r for r in random_rows(11, events=20) if r[0] != "e0"]
    samples = recording(spark, rows)
    found = mt.scaler_of(mt.metric_table(index_events(samples, AB, extra=moment_columns(AB)), 2))
    parts = frames_by_event(rows)
    for sensor in AB.sensors:
        means = pd.Series({e: p[sensor].mean() for e, p in parts.items()}).sort_index()

        def trimmed(column):
            drop = set(column.nsmallest(2).index) | set(column.nlargest(2).index)
            return column.drop(list(drop)).mean()

        mu = trimmed(means)

        def deviation(x):
            with np.errstate(all="ignore"):
                return np.sqrt(np.float64(np.nansum((x - mu) ** 2)) / (x.notna().sum() - 1))

        sigma = trimmed(pd.Series({e: deviation(p[sensor]) for e, p in parts.items()}).sort_index())
        assert_rows([found[sensor]], [(float(mu), float(sigma))])


def test_unusable_variables(spark):
    metrics = spark.createDataFrame(
        [("a", 1.0, 2.0), ("b", None, 0.0), ("c", 1.0, 0.0)],
        "variable string, mean_of_means double, mean_of_stds double",
    )
    assert {r[0] for r in mt.unusable_variables(metrics).collect()} == {"b", "c"}


def test_ranking_is_limited_before_the_shuffle(spark):
    plan = plan_of(mt.trimmed_mean(per_event(spark, range(50)), ONE, 3))
    assert plan.count("WindowGroupLimit") == 4
    assert "NestedLoop" not in plan
