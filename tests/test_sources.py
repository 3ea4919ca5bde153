"""Files in and out: conversion, listing, versions, stores."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesprep.functions.naming import directory_version, version_number
from seriesprep.operators.event_index import index_events
from seriesprep.operators.impute import impute
from seriesprep.operators.windows import sliding_windows
from seriesprep.schema import RAW_CSV_SCHEMA, SeriesLayout
from seriesprep.sources import recordings as rec
from seriesprep.sources import store
from tests.support import AB, plan_of, random_rows, recording


@pytest.fixture
def raw(tmp_path):
    header = ",".join(RAW_CSV_SCHEMA.names)
    for code, name, rows in [
        (0, "WELL-00001_20140124093303", 3),
        (0, "SIMULATED_00103", 2),
        (7, "DRAWN_00004", 4),
    ]:
        folder = tmp_path / "raw" / str(code)
        folder.mkdir(parents=True, exist_ok=True)
        lines = [f"2014-01-24 09:33:0{i}.000000,{i},2.5,,4,5,6,7,,{code}" for i in range(rows)]
        (folder / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")
    (tmp_path / "raw" / "0" / "notes.txt").write_text("skip")
    (tmp_path / "raw" / "misc").mkdir()
    (tmp_path / "raw" / "misc" / "WELL-00002_20140124093303.csv").write_text(f"{header}\n")
    return str(tmp_path / "raw")


def test_conversion(spark, raw, tmp_path):
    out = str(tmp_path / "converted")
    rec.convert_csv_dataset(spark, raw, out)
    samples = rec.read_samples(spark, out)
    assert {r["class_code"]: r["count"] for r in samples.groupBy("class_code").count().collect()} == {0: 5, 7: 4}
    assert samples.select("event_id").distinct().count() == 3
    row = samples.filter("class_code = 7").orderBy("ts").first()
    assert row["ts"].second == 0 and row["P-TPT"] == 2.5 and row["QGL"] is None and row["class"] == 7.0
    event = rec.read_event(samples, row["event_id"]).collect()
    assert [r["P-PDG"] for r in event] == [0.0, 1.0, 2.0, 3.0]
    pruned = samples.filter("class_code = 7").select("P-TPT")
    assert "PartitionFilters: [isnotnull(class_code" in plan_of(pruned)
    assert "ReadSchema: struct<P-TPT:double>" in plan_of(pruned)


def test_changed_header_is_an_error(spark, tmp_path):
    (tmp_path / "3").mkdir()
    names = [RAW_CSV_SCHEMA.names[0], *reversed(RAW_CSV_SCHEMA.names[1:])]
    (tmp_path / "3" / "SIMULATED_1.csv").write_text(",".join(names) + "\n" + ",".join("1" * len(names)) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        rec.read_csv_recordings(spark, str(tmp_path)).collect()


def test_csv_equals_parquet(spark, tmp_path):
    (tmp_path / "in" / "2").mkdir(parents=True)
    pd.DataFrame({"A": [1, 2, 3], "B": [4, 5, 6]}).to_csv(tmp_path / "in" / "2" / "x.csv", index=False)
    schema = T.StructType([T.StructField("A", T.LongType()), T.StructField("B", T.LongType())])
    out = str(tmp_path / "out")
    rec.convert_csv_dataset(spark, str(tmp_path / "in"), out, schema, SeriesLayout(()))
    rows = spark.read.parquet(out).orderBy("A").collect()
    assert [(r["A"], r["B"], r["class_code"]) for r in rows] == [(1, 4, 2), (2, 5, 2), (3, 6, 2)]


def test_listing_counts_and_empty_file(spark, tmp_path):
    folder = tmp_path / "dataset_converted_v1.2.3" / "7"
    folder.mkdir(parents=True)
    frame = pd.DataFrame({"timestamp": ["20140124093303"] * 3, "B": [1, 2, 3]})
    frame.to_parquet(folder / "WELL-00001_20140124093303.parquet")
    frame.iloc[:0].to_parquet(folder / "SIMULATED_1.parquet")
    (folder / "DRAWN_2.npz").write_bytes(b"x" * 11)

    listing = rec.list_dataset(spark, str(tmp_path))
    catalog = rec.dataset_catalog(spark, str(folder.parent))
    found = {r["source"]: r["num_timesteps"] for r in catalog.collect()}
    assert found == {"REAL": 3, "SIMULATED": 0, "HAND_DRAWN": None}

    assert rec.has_converted_data(listing)
    assert not rec.has_converted_data(listing.filter("path like '%.npz'"))
    wanted = sum(f.stat().st_size for f in folder.iterdir())
    assert rec.dataset_size(listing).first()[0] == wanted


def test_per_event_parquet_equals_converted_csv(spark, raw, tmp_path):
    root = tmp_path / "parquet"
    for source in (tmp_path / "raw").glob("[0-9]*/*.csv"):
        target = root / source.parent.name / f"{source.stem}.parquet"
        target.parent.mkdir(parents=True, exist_ok=True)
        numbers = {n: float for n in RAW_CSV_SCHEMA.names[1:]}
        pd.read_csv(source, dtype=numbers).to_parquet(target)
    a = rec.read_parquet_recordings(spark, str(root))
    b = rec.read_csv_recordings(spark, raw)
    assert a.count() == 9 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    catalog = rec.dataset_catalog(spark, str(root))
    joined = a.groupBy("event_id").count().join(catalog, "event_id")
    assert joined.filter("count = num_timesteps").count() == 3


def test_no_files(spark, tmp_path):
    assert rec.dataset_catalog(spark, str(tmp_path)).isEmpty()
    listing = rec.list_dataset(spark, str(tmp_path))
    assert not rec.has_converted_data(listing)
    assert rec.dataset_size(listing).first()[0] == 0


def test_versions(spark):
    names = ["dataset_converted_v2.1.3", "dataset_converted_v1.11", "dataset_converted_v2", "other", "dataset_converted_vx"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    version = directory_version(F.col("n"))
    found = [tuple(r) for r in rows.select(version, version_number(version)).collect()]
    assert found == [("2.1.3", 20103), ("1.11", 11100), ("2", 2), (None, None), (None, None)]


def test_latest_version_is_numeric(spark):
    rows = [
        (f"file:/x/dataset_converted_v{v}/0/a.{suffix}", 5)
        for v, suffix in [("90000", "parquet"), ("100000", "parquet"), ("7", "csv")]
    ]
    versions = rec.dataset_versions(spark.createDataFrame(rows, "path string, length long"))
    assert versions.count() == 3
    latest = rec.latest_version(versions).first()
    assert latest["version"] == "100000" and latest["has_data"]
    assert latest["directory"] == "file:/x/dataset_converted_v100000"


@pytest.mark.parametrize(
    "local, online, required, wanted",
    [("1.0", "1.0", True, True), ("1.0", "1.1", False, True), ("1.0", "1.1", True, False), (None, "1.0", False, False), ("1.0", None, False, False)],
)
def test_valid_conversion(spark, local, online, required, wanted):
    row = spark.createDataFrame([(local, True)], "version string, has_data boolean")
    usable = rec.is_valid_conversion(F.col("version"), F.col("has_data"), online, required)
    assert row.select(usable).first()[0] is wanted


def test_cached_table(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "cache")
    assert store.cached_table(spark, path, build).count() == 1
    assert store.cached_table(spark, path, build).count() == 1
    assert store.cached_table(spark, path, build, use_cached=False).count() == 2
    assert len(calls) == 2


def test_metrics_by_name(spark, tmp_path):
    table = lambda x: spark.createDataFrame(
        [("a", x, 1.0)], "variable string, mean_of_means double, mean_of_stds double"
    )
    root = str(tmp_path / "metrics")
    store.save_metrics(spark, root, "one", lambda: table(1.0))
    store.save_metrics(spark, root, "two", lambda: table(2.0))
    store.save_metrics(spark, root, "two", lambda: table(3.0))
    assert store.load_metrics(spark, root, "two").first()["mean_of_means"] == 2.0
    assert store.load_metrics(spark, root, "one").columns == ["variable", "mean_of_means", "mean_of_stds"]


@pytest.fixture(scope="module")
def windows(spark):
    samples = recording(spark, random_rows(21, events=6, longest=60))
    return sliding_windows(impute(samples, index_events(samples, AB), 3), AB, 4)


def test_tensor_round_trip(spark, windows, tmp_path):
    path = str(tmp_path / "tensors")
    store.write_windows(windows, AB, path)
    stored = store.read_windows(spark, path).select(*windows.columns)
    assert stored.exceptAll(windows).isEmpty() and windows.exceptAll(stored).isEmpty()


@pytest.mark.parametrize("bound", [3, 10_000])
def test_event_batches(spark, windows, bound):
    def batch(frame):
        assert list(frame.columns) == ["event_id", "batch", "window_idx", "label"]
        return pd.DataFrame({"event_id": [frame["event_id"].iloc[0]], "n": [len(frame)]})

    wanted = {r["event_id"]: r["count"] for r in windows.groupBy("event_id").count().collect()}
    asked = (windows, AB, batch, "event_id string, n long", bound, ["label"])
    parts = store.map_event_batches(*asked).collect()
    assert max(r["n"] for r in parts) <= bound and sum(r["n"] for r in parts) == sum(wanted.values())
    merged = store.map_event_batches(*asked, merge=[F.sum("n").alias("n")]).collect()
    assert {r["event_id"]: r["n"] for r in merged} == wanted and len(merged) == len(wanted)


def test_metric_names_are_taken_as_they_are(spark, tmp_path):
    for k, name in enumerate(["7", "007", "a/b", "a b%"]):
        store.save_metrics(spark, str(tmp_path), name, lambda k=k: spark.range(k, k + 1))
    for k, name in enumerate(["7", "007", "a/b", "a b%"]):
        assert [r[0] for r in store.load_metrics(spark, str(tmp_path), name).collect()] == [k]


def test_nested_copies_and_strange_names(spark, tmp_path):
    rows = spark.createDataFrame([("2020-01-01 00:00:00", 1.0, 2.0, 0.0)], "timestamp string, `P-A` double, `T-B` double, class double")
    names = ["WELL-00001_20200101000000", "SIMULATED_a b%", "DRAWN_é+1"]
    frame = rows.toPandas()
    for folder in ("4", "train/4", "test/4", "other"):
        (tmp_path / folder).mkdir(parents=True)
        for name in names:
            frame.to_parquet(tmp_path / folder / f"{name}.parquet")
    (tmp_path / "4" / "SIMULATED_1.npz").write_bytes(b"x")
    (tmp_path / "4" / "notes.txt").write_bytes(b"x")
    frame.head(0).to_parquet(tmp_path / "4" / "DRAWN_0.parquet")
    catalog = rec.dataset_catalog(spark, str(tmp_path)).collect()
    found = {r["path"].rsplit("/", 1)[1]: r["num_timesteps"] for r in catalog}
    assert found == {**{f"{n}.parquet": 1 for n in names}, "DRAWN_0.parquet": 0, "SIMULATED_1.npz": None}
    samples = rec.read_parquet_recordings(spark, str(tmp_path), rows.schema, AB)
    ids = {r["event_id"] for r in catalog if r["num_timesteps"]}
    assert sorted(r["event_id"] for r in samples.collect()) == sorted(ids) and len(ids) == 3


def test_split_store_replaces_an_earlier_draw(spark, tmp_path):
    samples = recording(spark, [(e, s, 1.0, 1.0, 0.0, 0) for e in "abc" for s in range(4)])
    path = str(tmp_path / "split")
    for names in (["train", "test", "validation"], ["train", "train", "test"]):
        divided = spark.createDataFrame(
            [(e, 4, n) for e, n in zip("abc", names)], "event_id string, num_timesteps long, split string"
        )
        store.write_split(samples, divided, AB, path)
    found = spark.read.parquet(path).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in found} == {"train": 8, "test": 4}
    assert store.read_split(spark, path, "test").select("event_id").distinct().collect()[0][0] == "c"


def test_head_of_events(spark):
    samples = recording(spark, [("a", s, float(s), None, None, 0) for s in range(9)] + [("b", 0, 7.0, None, None, 0)])
    heads = rec.head_of_events(samples.repartition(4), AB, 3)
    found = sorted((r["event_id"], r["P-A"]) for r in heads.collect())
    assert found == [("a", 0.0), ("a", 1.0), ("a", 2.0), ("b", 7.0)]
    assert "WindowGroupLimit" in plan_of(heads)
