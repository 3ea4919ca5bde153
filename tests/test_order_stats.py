"""Exact order statistics: against sorting, with ties, infinities, NaN, and bounds that are wrong."""

import math
import random

import pytest

from seriesprep.operators import metrics as mt
from seriesprep.operators import order_stats as os_
from seriesprep.schema import SeriesLayout


def series():
    rng = random.Random(5)
    return {
        "spread": [rng.gauss(0, 1) for _ in range(4_000)],
        "tied": [float(rng.randrange(4)) for _ in range(3_000)],
        "hot": [7.0] * 2_000 + [rng.random() * 14 for _ in range(3_000)],
        "ends": [math.inf] * 40 + [-math.inf] * 3 + [rng.random() for _ in range(500)],
        "nan": [math.nan] * 12 + [float(i) for i in range(300)],
        "some": [None] * 900 + [1.0, 3.0, 2.0],
        "none": [None] * 5,
    }


def frame_of(spark, values):
    rows = [(n, v) for n, column in values.items() for v in column]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "variable string, value double").repartition(6)


def in_order(column):
    return sorted((v for v in column if v is not None), key=lambda v: (math.isnan(v), v))


@pytest.mark.parametrize("ranked_rows, size, margin", [(100_000, 2_000, 4), (50, 200, 12), (20, 8, 0)])
def test_equals_sorting(spark, monkeypatch, ranked_rows, size, margin):
    """Also with sketches so small that their bounds miss the rank."""
    monkeypatch.setattr(os_, "SKETCH_SIZE", size)
    monkeypatch.setattr(os_, "MARGIN", margin)
    ranks = (1, 3, 40, 1_500, -1, -12, -13, -45)
    found = os_.order_statistics(frame_of(spark, series()), ranks, ranked_rows).collect()
    got = {(r.variable, r.rank): repr(r.value) for r in found}
    wanted = {}
    for name, column in series().items():
        known = in_order(column)
        for r in ranks:
            if abs(r) <= len(known):
                wanted[name, r] = repr(known[r - 1 if r > 0 else r])
    assert len(found) == len(got) and got == wanted


@pytest.mark.parametrize("k", [1, 3, 700, 1_500, 2_600])
def test_trimmed_mean_equals_ranks(spark, k):
    values = series()
    found = dict(os_.trimmed_by_bounds(frame_of(spark, values), k, 60).collect())
    assert set(found) == set(values)
    for name, column in values.items():
        known = in_order(column)
        low = dict.fromkeys(range(min(k, len(known))))
        # The other end drops, among equal values, those that come first too.
        high = sorted(range(len(known)), key=lambda i: (not math.isnan(known[i]), -known[i] if known[i] == known[i] else 0, i))
        kept = [v for i, v in enumerate(known) if i not in low and i not in set(high[:k])]
        if not kept:
            assert found[name] is None, name
        elif math.isnan(sum(kept)):
            assert math.isnan(found[name]), name
        else:
            assert found[name] == pytest.approx(sum(kept) / len(kept)), name


def test_listed_and_bounded_trim_agree(spark, monkeypatch):
    layout = SeriesLayout(("x", "y"), "event_id")
    rng = random.Random(9)
    rows = [(f"e{i:04d}", rng.choice([None, 0.0, float(rng.randrange(30))]), rng.random()) for i in range(900)]
    events = spark.createDataFrame(rows, "event_id string, x double, y double")
    listed = mt.as_mapping(mt.trimmed_mean(events, layout, 200), layout)
    monkeypatch.setattr(mt, "MAX_LISTED_TRIM", 0)
    bounded = mt.as_mapping(mt.trimmed_mean(events, layout, 200), layout)
    assert bounded == pytest.approx(listed)


def test_empty_and_numbered_variables(spark):
    nothing = frame_of(spark, {"x": [1.0]}).limit(0)
    assert os_.order_statistics(nothing, (1, -1)).count() == 0
    assert os_.trimmed_by_bounds(nothing, 2).count() == 0
    numbered = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0)], "variable int, value double")
    assert sorted(map(tuple, os_.order_statistics(numbered, (2, -2)).collect())) == [(1, -2, 2.0), (1, 2, 4.0)]
