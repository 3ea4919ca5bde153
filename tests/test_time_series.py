"""Down-sampling, gap bins, filling, windows: hand-made cases, pandas, and cut events."""

import pytest
from pyspark.sql import functions as F

from seriesprep.functions.sensors import missing_to_null, standardize
from seriesprep.operators import event_index as ei
from seriesprep.operators.impute import impute, interpolation_overlay
from seriesprep.operators.resample import assign_bins, bin_start, downsample, resample
from seriesprep.operators.segments import exclusive_scan
from seriesprep.operators.windows import cut_for_windows, sliding_windows, window_counts
from tests.support import (
    AB,
    START,
    assert_rows,
    by_event,
    frames_by_event,
    pandas_impute,
    pandas_resample,
    plan_of,
    random_rows,
    recording,
)

T_TPT = [117, 118, 119, 118, 117, 116, 115, 114, 113, None]
T_JUS = [69, 70, None, None, 74, 74, 75, 76, 77, 78]


def ten_seconds(spark):
    rows = [
        ("e", s, a and float(a), b and float(b), 4.0, 4) for s, (a, b) in enumerate(zip(T_TPT, T_JUS))
    ]
    return recording(spark, rows)


def values(frame, order="bin"):
    return [(r["P-A"], r["T-B"], r["class"]) for r in frame.orderBy(order).collect()]


@pytest.mark.parametrize(
    "seconds, wanted, edges",
    [
        (2, [(117.5, 69.5), (118.5, None), (116.5, 74), (114.5, 75.5), (113, 77.5)], [3, 5, 7, 9, 11]),
        (5, [(117.8, 71), (114.5, 76)], [3, 8]),
    ],
)
def test_downsample(spark, seconds, wanted, edges):
    samples = ten_seconds(spark)
    index = ei.index_events(samples, AB)
    bins = bin_start(downsample(samples, index, seconds), samples, index, seconds).orderBy("bin")
    assert_rows(values(bins), [(a, b, 4.0) for a, b in wanted])
    assert [r["ts"] for r in bins.collect()] == [START.replace(second=s) for s in edges]


def test_downsample_label_is_smallest_known(spark):
    rows = [("e", 0, 1.0, 1.0, 104.0, 4), ("e", 1, 1.0, 1.0, 4.0, 4), ("e", 2, 1.0, 1.0, None, 4)]
    samples = recording(spark, rows)
    assert values(downsample(samples, ei.index_events(samples, AB), 5)) == [(1.0, 1.0, 4.0)]


@pytest.mark.parametrize("size", [32_768, 2])
def test_gap_bins(spark, size):
    rows = [("e", 8, 4.0, None, 0.0, 0), ("e", 1, None, None, None, 0), ("e", 0, 1.0, None, None, 0)]
    samples = recording(spark, rows)
    dense = resample(samples, ei.index_events(samples, AB), 2, size)
    assert [(r["bin"], r["P-A"]) for r in dense.orderBy("bin").collect()] == [
        (0, 1.0), (1, None), (2, None), (3, None), (4, 4.0),
    ]
    assert [r["ts"].second for r in dense.orderBy("bin").collect()] == [3, 5, 7, 9, 11]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ([0, None, 2, None, 2, 1], [0, 1, 2, 2, 2, 1]),
        ([None, 21, 22, 23, 22, None], [21, 21, 22, 23, 22, 22]),
        ([None] * 6, [0] * 6),
    ],
)
def test_impute_sensor(spark, given, wanted):
    rows = [("e", s, None if x is None else float(x), 1.0, 0.0, 0) for s, x in enumerate(given)]
    samples = recording(spark, rows)
    found = impute(samples, ei.index_events(samples, AB), 1).orderBy("bin").collect()
    assert [r["P-A"] for r in found] == [float(w) for w in wanted]


@pytest.mark.parametrize(
    "given, wanted", [([None, 0, None, 0, 4, None], [0, 0, 0, 0, 4, 4]), ([None] * 6, [6] * 6)]
)
def test_impute_label(spark, given, wanted):
    rows = [("e", s, 1.0, 1.0, None if c is None else float(c), 6) for s, c in enumerate(given)]
    samples = recording(spark, rows)
    found = impute(samples, ei.index_events(samples, AB), 1).orderBy("bin").collect()
    assert [r["class"] for r in found] == [float(w) for w in wanted]


def test_overlay(spark):
    given = [None, 1, None, None, 4, None]
    rows = [("e", s * s, None if x is None else float(x), None, 0.0, 0) for s, x in enumerate(given)]
    samples = recording(spark, rows)
    index = ei.index_events(samples, AB)
    for limit in (100, 2):
        found = interpolation_overlay(samples, index, limit).orderBy("pos").collect()
        assert [r["P-A"] for r in found] == [None, None, 2.0, 3.0, None, 4.0]
        assert [r["T-B"] for r in found] == [None] * 6


@pytest.mark.parametrize("size", [32_768, 40, 7])
def test_random_events_against_pandas(spark, size):
    rows = random_rows(5)
    samples = recording(spark, rows).repartition(5)
    index = ei.index_events(samples, AB)
    parts = frames_by_event(rows)
    bins = {e: pandas_resample(p, 3) for e, p in parts.items()}
    columns = ["P-A", "T-B", "class"]

    dense = by_event(resample(samples, index, 3, size), "bin", columns)
    filled = by_event(impute(samples, index, 3, 0, size), "bin", columns)
    assert set(dense) == set(filled) == set(bins)
    for event, frame in bins.items():
        code = int(parts[event]["class_code"].iloc[0])
        assert_rows(dense[event], list(frame[columns].itertuples(index=False, name=None)))
        wanted = pandas_impute(frame, code)[columns]
        assert_rows(filled[event], list(wanted.itertuples(index=False, name=None)))


@pytest.mark.parametrize("limit", [1_000_000, 60])
def test_random_overlay_against_pandas(spark, limit):
    rows = random_rows(6)
    samples = recording(spark, rows).repartition(5)
    found = by_event(
        interpolation_overlay(samples, ei.index_events(samples, AB), limit), "pos", ["P-A", "T-B"]
    )
    for event, part in frames_by_event(rows).items():
        known = part[["P-A", "T-B"]]
        wanted = known.interpolate("linear").where(known.isna())
        assert_rows(found[event], list(wanted.itertuples(index=False, name=None)))


@pytest.mark.parametrize("n, windows", [(2, 5), (3, 4), (5, 2)])
def test_windows(spark, n, windows):
    labels = [0, 0, 0, 0, 104, 4]
    rows = [("e", s, float(s), 10.0 * s, float(c), 4) for s, c in enumerate(labels)]
    samples = recording(spark, rows)
    dense = impute(samples, ei.index_events(samples, AB), 1)
    found = sliding_windows(dense, AB, n).orderBy("window_idx").collect()
    assert [r["window_idx"] for r in found] == list(range(windows))
    for w, r in enumerate(found):
        assert r["X"] == [[float(s), 10.0 * s] for s in range(w, w + n)]
        last = labels[w + n - 1] % 100
        assert r["label"] == last and r["y"] == [int(c == last) for c in range(9)]


def test_short_event_has_no_window_but_a_count(spark):
    samples = recording(spark, [("e", s, 1.0, 1.0, 0.0, 0) for s in range(3)])
    index = ei.index_events(samples, AB)
    assert sliding_windows(impute(samples, index, 1), AB, 5).count() == 0
    assert [tuple(r) for r in window_counts(index, 1, 5).collect()] == [("e", 3, 0)]


@pytest.mark.parametrize("n, size", [(5, 6), (5, 23), (20, 20)])
def test_windows_of_cut_events(spark, n, size):
    samples = recording(spark, random_rows(7)).repartition(3)
    index = ei.index_events(samples, AB)
    whole = sliding_windows(impute(samples, index, 3), AB, n)
    wanted = by_event(whole, "window_idx", ["window_idx", "X", "label"])
    cut = sliding_windows(impute(samples, index, 3, n - 1, size), AB, n, size)
    stored = sliding_windows(cut_for_windows(impute(samples, index, 3), n, size), AB, n, size)
    for variant in (cut, stored):
        found = by_event(variant, "window_idx", ["window_idx", "X", "label"])
        assert set(found) == set(wanted)
        for event in wanted:
            assert_rows(
                [(r[0], r[2], *sum(r[1], [])) for r in found[event]],
                [(r[0], r[2], *sum(r[1], [])) for r in wanted[event]],
            )


def test_label_out_of_range_is_an_error(spark):
    samples = recording(spark, [("e", s, 1.0, 1.0, 42.0, 0) for s in range(3)])
    dense = impute(samples, ei.index_events(samples, AB), 1)
    with pytest.raises(Exception, match="label out of range"):
        sliding_windows(dense, AB, 2).collect()


def test_exclusive_scan_over_several_levels(spark):
    units = spark.range(100).select(
        F.lit("e").alias("k"),
        "id",
        F.when(F.col("id") % 7 == 3, F.struct(F.col("id").alias("pos"))).alias("v"),
    )
    known = [u for u in range(100) if u % 7 == 3]
    up = exclusive_scan(units, ["k"], "id", ["v"], 100, False, block=4)
    down = exclusive_scan(units, ["k"], "id", ["v"], 100, True, block=4)
    for row in up.collect():
        before = [u for u in known if u < row["id"]]
        assert (row["v"] and row["v"]["pos"]) == (max(before) if before else None)
    for row in down.collect():
        after = [u for u in known if u > row["id"]]
        assert (row["v"] and row["v"]["pos"]) == (min(after) if after else None)


def test_standardize(spark):
    rows = [("e", s, 100.0 * (s + 1), 5.0, 0.0, 0) for s in range(6)]
    scaled = standardize(recording(spark, rows), {"P-A": (500, 500), "T-B": (5.0, 0.0)}, AB)
    found = scaled.orderBy("ts").collect()
    assert_rows([(r["P-A"],) for r in found], [(x,) for x in (-0.8, -0.6, -0.4, -0.2, 0.0, 0.2)])
    assert {r["T-B"] for r in found} == {None} and {r["class"] for r in found} == {0.0}


def test_nan_is_missing(spark):
    samples = missing_to_null(recording(spark, [("e", 0, float("nan"), 2.0, float("nan"), 0)]), AB)
    assert values(samples, "ts") == [(None, 2.0, None)]


def test_attach_beyond_the_broadcast_bound(spark, monkeypatch):
    """One event with a third of all rows; nothing may be lost on the shuffled way."""
    rows = [("hot", s, 1.0, 1.0, 0.0, 0) for s in range(300)]
    rows += [(f"e{s % 200}", s, 1.0, 1.0, 0.0, 0) for s in range(600)]
    samples = recording(spark, rows)
    index = ei.index_events(samples, AB)
    near = assign_bins(samples, index, 7).select("event_id", "ts", "bin")
    monkeypatch.setattr(ei, "BROADCAST_EVENTS", 10)
    monkeypatch.setattr(ei, "HEAVY_EVENTS", 20)
    far = assign_bins(samples, index, 7).select("event_id", "ts", "bin")
    assert far.count() == 900
    assert near.exceptAll(far).isEmpty() and far.exceptAll(near).isEmpty()


def test_dropped_heavy_event_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ei, "BROADCAST_EVENTS", 10)
    monkeypatch.setattr(ei, "HEAVY_EVENTS", 20)
    rows = [("hot", s, 99.0, 1.0, 0.0, 0) for s in range(300)]
    rows += [(f"e{s % 200}", s, 1.0, 1.0, 0.0, 0) for s in range(600)]
    samples = recording(spark, rows)
    index = ei.index_events(samples, AB, {"P-A": (-1, 5), "T-B": (-1, 5)})
    kept = ei.keep_events(samples, index.keep(F.col("valid")))
    assert [r[0] for r in index.heavy_keys.collect()] == ["hot"]
    assert kept.count() == 600 and kept.filter("event_id = 'hot'").isEmpty()
    # The written index has a known size here, which a large one would be beyond.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ei.keep_events(samples, index.keep(F.col("valid")))
        shuffled = [line for line in plan_of(kept).splitlines() if "Exchange hashpartitioning" in line]
        assert shuffled and "LeftAnti" in plan_of(kept)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plan_moves_bins_and_not_samples(spark):
    samples = recording(spark, random_rows(8))
    index = ei.index_events(samples, AB)
    plan = plan_of(sliding_windows(impute(samples, index, 3), AB, 4))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_avg" in plan and "BroadcastHashJoin" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "unboundedfollowing" not in plan


def test_overlay_of_groups_over_many_batches(spark):
    """Null keys, groups of one row and groups longer than an Arrow batch."""
    lengths = {"a": 1, "b": 30, None: 7, "d": 1, "e": 12}
    rows = [
        (event, s, float(s) if s % 5 == 2 else None, None, 0.0, 0)
        for event, n in lengths.items()
        for s in range(n)
    ]
    samples = recording(spark, rows).repartition(3)
    index = ei.index_events(samples, AB)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = {(r.event_id, r.pos): r["P-A"] for r in interpolation_overlay(samples, index).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for event, s, x, *_ in rows:
        last = max((t for e, t, v, *_ in rows if e == event and v is not None), default=None)
        wanted = None if x is not None or s < 2 or last is None else float(min(s, last))
        assert found[event, s] == wanted
