"""Tables replaced as a whole, and conversion of what changed."""

import os

import pytest
from pyspark.sql import types as T

from seriesprep.schema import SeriesLayout
from seriesprep.sources import store, versions

LAYOUT = SeriesLayout(("P-A",))
SCHEMA = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("P-A", T.DoubleType()), T.StructField("class", T.DoubleType())])


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_a_killed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read_version(spark, path) is None
    versions.write_version(spark.range(2), path)
    reader = versions.read_version(spark, path)
    spark.range(9).write.parquet(f"{path}/v-2")
    os.remove(f"{path}/v-2/_SUCCESS")  # killed before it was done
    assert ids(versions.read_version(spark, path)) == [0, 1]
    versions.write_version(versions.read_version(spark, path).selectExpr("id + 5 as id"), path)
    assert ids(versions.read_version(spark, path)) == [5, 6] and ids(reader) == [0, 1]
    for k in range(3):
        versions.write_version(spark.range(k), path)
    assert [n for n, done in versions._versions(spark, path) if done] == [5, 6]


def test_cache_is_replaced_at_once(spark, tmp_path):
    path = str(tmp_path / "c")
    first = store.cached_table(spark, path, lambda: spark.range(3))
    assert ids(store.cached_table(spark, path, lambda: spark.range(1))) == [0, 1, 2]
    with pytest.raises(Exception):
        store.cached_table(spark, path, lambda: spark.range(1).selectExpr("raise_error('x') as id"), use_cached=False)
    assert ids(store.cached_table(spark, path, lambda: spark.range(1))) == [0, 1, 2]
    assert ids(store.cached_table(spark, path, lambda: spark.range(1), use_cached=False)) == [0] and ids(first) == [0, 1, 2]


def write(root, name, values):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    lines = [f"2020-01-01 00:00:0{k},{v},0.0" for k, v in enumerate(values)]
    (root / name).write_text("\n".join(["timestamp,P-A,class", *lines]) + "\n")


def values(spark, out):
    rows = versions.read_converted(spark, out, LAYOUT).collect()
    return sorted((r["class_code"], r["P-A"]) for r in rows)


def test_only_what_changed_is_converted(spark, tmp_path):
    root, out = tmp_path / "raw", str(tmp_path / "out")
    run = lambda: versions.convert_changed(spark, str(root), out, SCHEMA, LAYOUT)
    write(root, "0/WELL-00001_20170101000000.csv", [1, 2])
    write(root, "4/SIMULATED_00001.csv", [3])
    write(root, "4/DRAWN_00001.csv", [])
    write(root, "notes/a.csv", [99])
    write(root, "4/deeper/b.csv", [98])
    (root / "0" / "x.npz").write_bytes(b"\x00")
    assert values(spark, out) == []
    assert run() == versions.Conversion(3, 0, 0)
    assert values(spark, out) == [(0, 1.0), (0, 2.0), (4, 3.0)]
    assert run() == versions.Conversion(0, 3, 0)
    n_folders = len(list((tmp_path / "out" / "data").iterdir()))
    assert n_folders == 1
    write(root, "4/SIMULATED_00001.csv", [7, 8, 9])
    write(root, "5/DRAWN_00002.csv", [5])
    os.remove(root / "0" / "WELL-00001_20170101000000.csv")
    manifest = versions.current_version(spark, f"{out}/manifest")
    assert run() == versions.Conversion(2, 1, 1)
    assert values(spark, out) == [(4, 7.0), (4, 8.0), (4, 9.0), (5, 5.0)]
    # Killed between the data and the manifest: the table from before is read.
    os.remove(versions.current_version(spark, f"{out}/manifest") + "/_SUCCESS")
    assert versions.current_version(spark, f"{out}/manifest") == manifest
    assert values(spark, out) == [(0, 1.0), (0, 2.0), (4, 3.0)]
    assert run() == versions.Conversion(2, 1, 1)
    assert values(spark, out) == [(4, 7.0), (4, 8.0), (4, 9.0), (5, 5.0)]
