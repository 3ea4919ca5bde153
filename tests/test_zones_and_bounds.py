"""Results must not depend on the session zone, on segment sizes, or on bad labels."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from support import AB, random_rows, recording

from seriesprep.operators import evaluate as ev
from seriesprep.operators.event_index import index_events
from seriesprep.operators.quality import samples_of_invalid_events
from seriesprep.operators.resample import bin_start, downsample
from seriesprep.operators.windows import event_windows
from seriesprep.plans import classify, prepare

NTZ = "event_id string, ts timestamp_ntz, `P-A` double, `T-B` double, class double, class_code int"


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bins_across_both_clock_changes(spark, zone):
    times = [
        datetime(2024, 3, 10, 1, 59), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 30, 0, 5),
        datetime(2024, 11, 3, 0, 30), datetime(2024, 11, 3, 1, 30), datetime(2024, 11, 3, 2, 30),
    ]
    rows = [("mar" if t.month == 3 else "nov", t, float(i), None, 0.0, 0) for i, t in enumerate(times)]
    samples = spark.createDataFrame(rows, NTZ)
    index = index_events(samples, AB)
    bins = bin_start(downsample(samples, index, 60), samples, index, 60)
    assert bins.schema["ts"].dataType.typeName() == "timestamp_ntz"
    found = sorted((r["event_id"], r["bin"], r["P-A"], r["ts"]) for r in bins.collect())
    assert found == [
        ("mar", 0, 0.0, times[0]), ("mar", 31, 1.0, times[1]), ("mar", 91, 2.0, datetime(2024, 3, 10, 3, 30)),
        ("nov", 0, 3.0, times[3]), ("nov", 60, 4.0, times[4]), ("nov", 120, 5.0, times[5]),
    ]


@pytest.mark.parametrize("size", [3, 7, 40])
def test_windows_of_any_length_in_any_segments(spark, size):
    samples = recording(spark, random_rows(4, events=4, longest=60))
    index = index_events(samples, AB)
    whole = event_windows(samples, index, 3, 9)
    cut = event_windows(samples, index, 3, 9, size=size)
    assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty() and whole.count() > 0


@pytest.mark.parametrize("label", [None, 9, -1])
def test_bad_labels_fail(spark, label):
    schema = "label int, predicted int, probability array<double>"
    scored = spark.createDataFrame([(0, 0, [0.9] + [0.0] * 8), (label, 0, [0.9] + [0.0] * 8)], schema)
    for result in (ev.confusion_matrix(scored), ev.accuracy_and_loss(scored)):
        with pytest.raises(Exception, match="no class in label"):
            result.collect()


def test_nothing_valid_gives_nothing(spark):
    samples = recording(spark, [("a", s, 1e9, 1e9, 0.0, 0) for s in range(9)])
    ranges = {"P-A": (0.0, 1.0), "T-B": (0.0, 1.0)}
    assert prepare.prepare_windows(samples, AB, None, 1, 2, ranges).count() == 0
    bad = samples_of_invalid_events(samples, index_events(samples, AB, ranges))
    assert bad.count() == samples.count()


def test_learning_rates_give_different_models(spark):
    samples = recording(spark, random_rows(8, events=6, longest=60))
    windows = prepare.prepare_windows(samples, AB, None, 3, 3, {"P-A": (-9.0, 9.0), "T-B": (-9.0, 9.0)})
    windows = windows.withColumn("X", F.transform("X", lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit(0.0)))))
    fit = lambda rate: classify.fit_window_classifier(windows, 3, AB, 4, rate, 5).weights.toArray()
    assert abs(fit(0.001) - fit(1.0)).max() > 1e-6


def test_no_validation_window_is_no_ranking(spark):
    samples = recording(spark, random_rows(8, events=3, longest=40))
    windows = prepare.prepare_windows(samples, AB, None, 3, 3, {"P-A": (-9.0, 9.0), "T-B": (-9.0, 9.0)})
    with pytest.raises(ValueError, match="validation"):
        classify.search_classifier(windows, windows.limit(0), 3, AB, [{"hidden": 4}])


def test_a_job_leaves_no_file_and_reads_only_what_it_uses(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from seriesprep.session import cut_lineage, job_folder

    with job_folder(spark) as folder:
        frame = cut_lineage(spark.range(9).selectExpr("id", "id * 2 as `a:b`", "id * 3 as c"))
        narrow = frame.select("`a:b`")
        assert narrow.agg(F.sum("`a:b`")).first()[0] == 72
        plan = narrow._jdf.queryExecution().toString()
        assert "ReadSchema: struct<a:b:bigint>" in plan
        assert Path(urlparse(folder).path).exists()
    assert not Path(urlparse(folder).path).exists()
