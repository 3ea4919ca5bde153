"""Window blocks, the epoch reader, functions over events and packed predictions."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seriesprep.operators import evaluate as ev
from seriesprep.operators import windows as wd
from seriesprep.operators.event_index import index_events
from seriesprep.operators.impute import impute
from seriesprep.schema import SeriesLayout
from seriesprep.sources import store
from support import plan_of

LAYOUT = SeriesLayout(("P-A", "T-B"), "event_id")


@pytest.fixture(scope="module")
def samples(spark):
    """Events of 1 to 400 seconds, with gaps and unknown values."""
    rng = np.random.default_rng(3)
    rows = []
    for e, length in enumerate([1, 5, 19, 20, 21, 64, 65, 400]):
        for s in range(length):
            if s in (0, length - 1) or rng.random() < 0.8:
                a, b = (float(v) if rng.random() < 0.9 else None for v in rng.normal(size=2))
                rows.append((f"e{e}", f"2020-01-01 00:{s // 60:02d}:{s % 60:02d}", a, b, float(e % 3), e % 3))
    schema = "event_id string, ts string, `P-A` double, `T-B` double, class double, class_code int"
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return frame.repartition(3)


def rows_of(windows):
    return sorted((r.event_id, r.class_code, r.window_idx, str(r.X), str(r.y), r.label) for r in windows.collect())


@pytest.mark.parametrize("block", [20, 32, 64, 1_024])
def test_blocks_give_the_windows(spark, samples, tmp_path, block):
    index = index_events(samples, LAYOUT)
    store.write_window_blocks(impute(samples, index, 1), LAYOUT, str(tmp_path / "b"), 20, block)
    for n in (20, 7, 1):
        got = store.read_window_blocks(spark, str(tmp_path / "b"), LAYOUT, n)
        assert rows_of(got) == rows_of(wd.event_windows(samples, index, 1, n)), n
    with pytest.raises(Exception, match="stored for windows of fewer"):
        store.read_window_blocks(spark, str(tmp_path / "b"), LAYOUT, 21).collect()


def test_blocks_hold_no_copies(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("e", s, float(a), float(b), 0.0, 0) for s, (a, b) in enumerate(rng.normal(size=(20_000, 2)))]
    dense = spark.createDataFrame(rows, "event_id string, bin long, `P-A` double, `T-B` double, class double, class_code int")
    store.write_window_blocks(dense, LAYOUT, str(tmp_path / "blocks"), 20)
    store.write_windows(wd.sliding_windows(dense, LAYOUT, 20), LAYOUT, str(tmp_path / "windows"))
    files = lambda name: list((tmp_path / name).rglob("*.parquet"))

    def values(name, column):
        found = 0
        for file in files(name):
            meta = pq.ParquetFile(file).metadata
            groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
            found += sum(g.column(c).num_values for g in groups for c in range(g.num_columns) if g.column(c).path_in_schema.startswith(column))
        return found

    assert values("blocks", "steps.") * 10 <= values("windows", "X.")
    # Parquet's dictionary of values hides part of the copies while it lasts.
    assert sum(f.stat().st_size for f in files("blocks")) * 2 <= sum(f.stat().st_size for f in files("windows"))


def test_epochs_hold_each_window_once_in_different_order(spark, samples, tmp_path):
    index = index_events(samples, LAYOUT)
    dense = impute(samples, index, 1)
    store.write_window_blocks(dense, LAYOUT, str(tmp_path / "b"), 20, 32)
    blocks = spark.read.parquet(str(tmp_path / "b"))
    want = sorted(np.nan_to_num(np.array(r.X, np.float32)).tobytes() for r in wd.event_windows(samples, index, 1, 20).collect())
    seen = []
    for epoch in (1, 2, 1):
        batches = store.epoch_batches(blocks, LAYOUT, 20, epoch, batch=16, buffer=64)
        order, sizes = [], []
        for x, labels in store.local_batches(batches, 20, 2):
            assert x.shape == (len(labels), 20, 2) and set(labels) <= {0, 1, 2}
            order += [w.tobytes() for w in x]
            sizes.append(len(labels))
        assert sorted(order) == want and max(sizes) == 16
        seen.append(order)
    assert seen[0] == seen[2] != seen[1]


def test_events_are_streamed_in_time_order(spark, samples):
    def count(batches):
        event, n, last, parts = None, 0, 0, 0
        for rows in batches:
            seconds = rows.column("ts").cast(pa.int64()).to_pylist()
            assert seconds == sorted(seconds) and seconds[0] >= last
            event, n, last, parts = rows.column("event_id")[0].as_py(), n + len(seconds), seconds[-1], parts + 1
        yield pa.RecordBatch.from_pydict({"event_id": [event], "n": [n], "parts": [parts]})

    mapped = store.map_events(samples, LAYOUT, count, "event_id string, n long, parts long", ["P-A"])
    assert plan_of(mapped).count("Exchange") == 1
    want = {r.event_id: r["count"] for r in samples.groupBy("event_id").count().collect()}
    assert {r.event_id: r.n for r in mapped.collect()} == want
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert max(r.parts for r in mapped.collect()) > 1  # a long event comes in several batches
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_packed_predictions_equal_the_join(spark, samples, monkeypatch):
    monkeypatch.setattr(ev, "RANGE_BINS", 16)
    index = index_events(samples, LAYOUT)
    said = wd.event_windows(samples, index, 1, 5).select("event_id", "window_idx", (F.col("window_idx") % 4).alias("said"))
    holes = said.filter("window_idx % 7 <> 3 and (event_id <> 'e7' or window_idx not between 100 and 180)")
    for spoken in (said, holes, said.limit(0)):
        packed, joined = (
            ev.align_predictions(samples, index, spoken, 1, 5, ["said"], **limits) for limits in ({}, {"most_rows": 0})
        )
        rows = lambda f: sorted(map(str, f.select("event_id", "ts", "bin", "said").collect()))
        assert rows(packed) == rows(joined)
    packed = ev.align_predictions(samples, index, said, 1, 5, ["said"])
    assert "Exchange hashpartitioning" not in plan_of(packed)
