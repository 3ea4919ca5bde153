"""Names, versions, catalog, filters, counts, split and quality checks."""

import hashlib
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seriesprep.functions import naming
from seriesprep.functions.labels import arg_max, fold_transient
from seriesprep.functions.sensors import sensor_unit
from seriesprep.operators import catalog as cat
from seriesprep.operators import quality as ql
from seriesprep.operators import split as sp
from seriesprep.operators.event_index import index_events, minimum_columns
from seriesprep.schema import CLASS_NAMES, SENSOR_RANGES, SOURCE_NAMES, SeriesLayout, class_name
from tests.support import recording, plan_of

FULL = SeriesLayout()
SAMPLE = {
    "event_id": "e", "ts": datetime(2020, 1, 1), "class": 0.0, "class_code": 0,
    "P-PDG": 1.0, "P-TPT": 1.0, "T-TPT": 1.0, "P-MON-CKP": 1.0, "T-JUS-CKP": 1.0,
    "P-JUS-CKGL": 1.0, "QGL": 1.0,
}
SAMPLE_SCHEMA = "event_id string, ts timestamp, class double, class_code int, " + ", ".join(
    f"`{s}` double" for s in FULL.sensors
)


def is_valid(spark, layout=FULL, **changes):
    rows = [SAMPLE, {**SAMPLE, **changes}]
    names = ["event_id", "ts", "class", "class_code", *FULL.sensors]
    samples = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SAMPLE_SCHEMA)
    return ql.event_validity(samples, layout, SENSOR_RANGES).first()["valid"]


@pytest.mark.parametrize(
    "changes, wanted",
    [
        ({}, True),
        ({"P-PDG": None}, True),
        ({"class": None}, True),
        ({"ts": None}, False),
        ({"class": 12.0}, False),
        ({"class": 100.0}, False),
        ({"class": 9.0}, False),
        ({"class": 108.0}, True),
        ({"class": 109.0}, False),
        ({"P-PDG": 2e30}, False),
        ({"P-TPT": 1e9}, True),
        ({"P-TPT": 1.1e9}, False),
        ({"T-TPT": -1001.0}, False),
        ({"QGL": 3.5}, False),
        ({"QGL": -3.0}, True),
    ],
)
def test_one_fault_makes_an_event_invalid(spark, changes, wanted):
    assert is_valid(spark, **changes) is wanted


def test_only_selected_sensors_are_checked(spark):
    assert is_valid(spark, FULL.select_sensors("P-PDG"), QGL=20.0) is True


def test_drop_invalid_events(spark):
    ranges = {"P-A": (-1, 5), "T-B": (-1, 5)}
    rows = [("a", s, float(s), 0.0, 0.0, 0) for s in range(8)]
    rows += [("b", s, 1.0, 0.0, 0.0, 0) for s in range(3)]
    from tests.support import AB

    samples = recording(spark, rows)
    kept = ql.drop_invalid_events(samples, index_events(samples, AB, ranges))
    assert {(r["event_id"], r["n"]) for r in kept.groupBy("event_id").agg(F.count("*").alias("n")).collect()} == {("b", 3)}


def test_flow_state(spark):
    from tests.support import AB

    rows = [
        ("e", 0, 5.0, None, 0.0, 4), ("e", 1, 3.0, None, 104.0, 4), ("e", 2, 4.0, None, 4.0, 4),
        ("e", 3, 6.0, None, None, 4), ("e", 4, None, None, 0.0, 4),
    ]
    samples = recording(spark, rows)
    states = ql.flow_state(samples, index_events(samples, AB, extra=minimum_columns(AB)))
    found = [
        tuple(r)[3:] for r in states.filter("variable = 'P-A'").orderBy("ts").collect()
    ]
    assert found == [
        (5.0, None, None, None, None, "[Pa]"),
        (None, 3.0, None, None, None, "[Pa]"),
        (None, None, 4.0, None, None, "[Pa]"),
        (None, None, None, 6.0, None, "[Pa]"),
        (None, None, None, None, 3.0, "[Pa]"),
    ]


def test_units_fold_and_argmax(spark):
    rows = spark.createDataFrame(
        [("P-X", 104.0, [1.0, 3.0, 3.0]), ("T-X", 100.0, [2.0]), ("QGL", 8.0, [0.0, 1.0]), ("z", None, [5.0, 4.0])],
        "v string, y double, a array<double>",
    )
    found = rows.select(sensor_unit(F.col("v")), fold_transient(F.col("y")), arg_max(F.col("a"))).collect()
    assert [tuple(r) for r in found] == [("[Pa]", 4, 1), ("[ºC]", 0, 0), ("[sm³/s]", 8, 1), ("", None, 0)]


def test_class_names(spark):
    codes = spark.range(9).select(class_name(F.col("id")).alias("n"))
    assert [r["n"] for r in codes.collect()] == list(CLASS_NAMES)
    with pytest.raises(Exception, match="unknown class code"):
        spark.range(10).select(class_name(F.col("id"))).collect()


FILES = [
    ("/d/0/WELL-00001_20140124093303.parquet", 10),
    ("/d/0/WELL-00002_20140124093304.parquet", 20),
    ("/d/0/SIMULATED_00103.parquet", 30),
    ("/d/4/SIMULATED_00104.parquet", 40),
    ("/d/4/DRAWN_00004.npz", 50),
    ("/d/notes/WELL-00009_20140124093303.parquet", 60),
    ("/d/4/readme.txt", 70),
]


def catalog(spark):
    listing = spark.createDataFrame(FILES, "path string, length long")
    counts = spark.createDataFrame([(FILES[0][0], 3), (FILES[3][0], 5)], "path string, n_rows long")
    return cat.event_catalog(listing, counts)


def test_event_catalog(spark):
    rows = {r["path"]: r for r in catalog(spark).collect()}
    assert set(rows) == {path for path, _ in FILES[:5]}
    first = rows[FILES[0][0]]
    digest = hashlib.sha256(b"0/WELL-00001_20140124093303").hexdigest()
    assert first["event_id"] == digest and first["hash_id"] == digest[:7]
    assert (first["class_type"], first["source"], first["well_id"]) == ("NORMAL", "REAL", 1)
    assert first["timestamp"] == datetime(2014, 1, 24, 9, 33, 3)
    assert (first["file_size"], first["num_timesteps"]) == (10, 3)
    assert rows[FILES[2][0]]["well_id"] is None and rows[FILES[2][0]]["timestamp"] is None
    assert rows[FILES[1][0]]["num_timesteps"] == 0
    assert rows[FILES[4][0]]["num_timesteps"] is None and rows[FILES[4][0]]["source"] == "HAND_DRAWN"


@pytest.mark.parametrize(
    "filters, count",
    [
        ({}, 5),
        ({"sources": ["REAL"]}, 2),
        ({"sources": [1]}, 2),
        ({"sources": ["HAND_DRAWN"]}, 1),
        ({"class_types": ["NORMAL"]}, 3),
        ({"class_types": [4]}, 2),
        ({"class_types": [5]}, 0),
        ({"well_ids": [2, 7]}, 1),
        ({"class_types": [0], "sources": [0], "well_ids": [1]}, 1),
        ({"sources": []}, 0),
        ({"sources": [], "empty_means_all": True}, 5),
    ],
)
def test_filter_catalog(spark, filters, count):
    assert cat.filter_catalog(catalog(spark), **filters).count() == count


def test_unknown_filter_values_are_errors(spark):
    with pytest.raises(ValueError):
        cat.filter_catalog(catalog(spark), class_types=["CALM"])


def test_counts(spark):
    table = {r["class_type"]: tuple(r)[1:] for r in cat.class_source_counts(catalog(spark)).collect()}
    assert list(table)[-1] == "Total" and len(table) == 10
    assert table["NORMAL"] == (2, 1, 0, 3)
    assert table["SEVERE_SLUGGING"] == (0, 0, 0, 0)
    assert table["Total"] == (2, 2, 1, 5)
    assert [tuple(r) for r in cat.class_counts(catalog(spark)).collect()] == [
        ("NORMAL", 3), ("FLOW_INSTABILITY", 2),
    ]


@pytest.mark.parametrize(
    "arguments, wanted",
    [
        ((0.2, [0], [0], [1, 2]), "split-20_source-r_class-0_well-1-2"),
        ((0.29, None, None, None), "split-28_source-all_class-all_well-all"),
        ((0.2, None, ["HAND_DRAWN", "REAL", "SIMULATED"], None), "split-20_source-all_class-all_well-all"),
        ((0.2, list(range(9)), ["HAND_DRAWN", 0], [3, 12, 1]), "split-20_source-r-d_class-all_well-1-3-12"),
        ((0.2, [8, "NORMAL"], None, None), "split-20_source-all_class-0-8_well-all"),
    ],
)
def test_split_names(arguments, wanted):
    assert naming.split_base_name("10103", *arguments) == f"dataset_converted_v10103_{wanted}"


def events(spark, sizes):
    rows = []
    for (source, code), n in sizes.items():
        rows += [(f"{source}-{code}-{i}", SOURCE_NAMES[source], CLASS_NAMES[code]) for i in range(n)]
    return spark.createDataFrame(rows, "event_id string, source string, class_type string")


def largest_remainder(pools, share):
    usable = {s: n if n >= 2 else 0 for s, n in pools.items()}
    total = sum(usable.values())
    target = math.ceil(share * total)
    quota = {s: target * n // total for s, n in usable.items()}
    by_rest = sorted(usable, key=lambda s: (-(target * usable[s] % total), s))
    for s in by_rest[: target - sum(quota.values())]:
        quota[s] += 1
    return quota


@pytest.mark.parametrize("buckets", [1, 4_096])
def test_split_quotas_are_exact(spark, buckets):
    # One stratum holds most of the events, one cannot be divided.
    sizes = {(0, 0): 400, (0, 4): 33, (1, 4): 7, (2, 8): 1, (1, 0): 2}
    table = events(spark, sizes)
    drawn = sp.stratified_split(table, "event_id", 0.1, 0.2, buckets=buckets)
    found = {}
    for r in drawn.groupBy("split", "source", "class_type").count().collect():
        stratum = (SOURCE_NAMES.index(r["source"]), CLASS_NAMES.index(r["class_type"]))
        found[(r["split"], stratum)] = r["count"]
    test = largest_remainder(sizes, 0.2)
    validation = largest_remainder({s: n - test[s] for s, n in sizes.items()}, 0.1 / 0.8)
    for s, n in sizes.items():
        assert found.get(("test", s), 0) == test[s]
        assert found.get(("validation", s), 0) == validation[s]
        assert found.get(("train", s), 0) == n - test[s] - validation[s]
    assert found[("train", (2, 8))] == 1
    assert drawn.select("event_id").distinct().count() == sum(sizes.values())


def test_split_does_not_depend_on_partitions_or_buckets(spark):
    table = events(spark, {(0, 0): 50, (1, 3): 20})
    a = sp.stratified_split(table.repartition(7), "event_id", 0.1, 0.2, buckets=1)
    b = sp.stratified_split(table.coalesce(1), "event_id", 0.1, 0.2, buckets=64)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_split_without_validation_and_source(spark):
    table = events(spark, {(0, 0): 10}).unionByName(
        spark.createDataFrame(
            [(f"n{i}", None, "NORMAL") for i in range(10)],
            "event_id string, source string, class_type string",
        )
    )
    counts = {
        (r["split"], r["source"]): r["n"]
        for r in sp.split_counts(sp.stratified_split(table, "event_id", 0.0, 0.2)).collect()
    }
    assert counts == {
        ("test", "REAL"): 2, ("train", "REAL"): 8, ("test", None): 2, ("train", None): 8,
    }


def test_no_stratum_is_ranked_as_a_whole(spark):
    plan = plan_of(sp.stratified_split(events(spark, {(0, 0): 10}), "event_id", 0.1, 0.2))
    assert "_source" in plan and "_bucket" in plan and "NestedLoop" not in plan


def test_shuffle_is_reproducible(spark):
    table = events(spark, {(0, 0): 30})
    a = [r["event_id"] for r in sp.shuffled(table.repartition(4), "event_id").collect()]
    assert a == [r["event_id"] for r in sp.shuffled(table, "event_id").collect()]
    assert a != sorted(a) and sorted(a) == sorted(r["event_id"] for r in table.collect())
