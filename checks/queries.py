"""One registered query per operator; every query reads the given tables whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixture as fx
from checks.fixture import DEEP_RANKS, DEEP_TRIM, LAYOUT, RANGES, SECONDS, SENSORS, TRIM, WINDOW
from seriesprep.functions import naming
from seriesprep.functions.labels import arg_max, softmax
from seriesprep.functions.sensors import sensor_unit, standardize, valid_sample
from seriesprep.operators import catalog as cat
from seriesprep.operators import evaluate as ev
from seriesprep.operators import metrics as mt
from seriesprep.operators import order_stats
from seriesprep.operators import quality as ql
from seriesprep.operators import split as sp
from seriesprep.operators import tensor_stats as ts
from seriesprep.operators import windows as wd
from seriesprep.operators.event_index import attach_events, index_events, minimum_columns, moment_columns
from seriesprep.operators.impute import impute, interpolation_overlay
from seriesprep.operators.resample import bin_start, downsample, resample
from seriesprep.plans import classify, prepare, recurrent
from seriesprep.schema import SeriesLayout, col
from seriesprep.session import cut_lineage, shared_folder
from seriesprep.sources import recordings as rec
from seriesprep.sources import store, versions


def off_tie(value: Column, digits: int = 6) -> Column:
    """Rounded value for comparison; the shift keeps exact decimals off a rounding tie, where
    two engines may go either way, and the sum turns -0.0 into 0.0."""
    return F.round(value + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def rounded(name: str) -> Column:
    return off_tie(col(name)).alias(name)


def sensor_columns() -> list[Column]:
    return [rounded(s) for s in SENSORS]


def time_text(name: str = "ts") -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# --- time series ----------------------------------------------------------------------------


def downsampled(spark, sf):
    samples = fx.samples(spark, sf)
    index = index_events(samples, LAYOUT)
    bins = bin_start(downsample(samples, index, SECONDS), samples, index, SECONDS)
    return bins.select("instance_id", "bin", time_text(), *sensor_columns(), "class")


def gap_bins(spark, sf):
    samples = fx.samples(spark, sf)
    dense = resample(samples, index_events(samples, LAYOUT), SECONDS)
    return dense.select("instance_id", "bin", time_text(), *sensor_columns(), "class")


def imputed(spark, sf):
    samples = fx.samples(spark, sf)
    return impute(samples, index_events(samples, LAYOUT), SECONDS)


def imputed_sensors(spark, sf):
    return imputed(spark, sf).select("instance_id", "bin", *sensor_columns())


def class_fill(spark, sf):
    return imputed(spark, sf).select("instance_id", "bin", "class")


def interp_overlay(spark, sf, **limits):
    samples = fx.samples(spark, sf)
    overlay = interpolation_overlay(samples, index_events(samples, LAYOUT), **limits)
    return overlay.select("instance_id", "event_id", "pos", *sensor_columns())


def overlay_segmented(spark, sf):
    """The overlay with every event of over 20 rows cut into parts."""
    return interp_overlay(spark, sf, limit=20, parts=64)


# --- quality --------------------------------------------------------------------------------


def valid_events(spark, sf):
    return ql.event_validity(fx.samples(spark, sf), LAYOUT, RANGES)


def valid_samples(spark, sf):
    samples = fx.samples(spark, sf)
    kept = ql.drop_invalid_events(samples, index_events(samples, LAYOUT, RANGES))
    return kept.select("instance_id", "event_id")


def invalid_events(spark, sf):
    samples = fx.samples(spark, sf)
    bad = (~valid_sample(LAYOUT, RANGES)).cast("long")
    counts = samples.groupBy("instance_id").agg(F.sum(bad).alias("n_bad"))
    return counts.filter("n_bad > 0")


def invalid_event_samples(spark, sf):
    samples = fx.samples(spark, sf)
    bad = ql.samples_of_invalid_events(samples, index_events(samples, LAYOUT, RANGES))
    return bad.select("instance_id", "event_id")


def attach_shuffled(spark, sf):
    """First time of the event on each sample, by the path for an index too large to broadcast."""
    samples = fx.samples(spark, sf)
    attached = attach_events(samples, index_events(samples, LAYOUT), "t0", broadcast=False)
    return attached.select("instance_id", "event_id", "t0")


def flow_state(spark, sf):
    samples = fx.samples(spark, sf)
    index = index_events(samples, LAYOUT, extra=minimum_columns(LAYOUT))
    states = ("normal", "transient", "permanent", "unknown", "no_data")
    return ql.flow_state(samples, index).select(
        "instance_id", time_text(), "variable", *[rounded(s) for s in states], "unit"
    )


def sensor_units(spark, sf):
    variable = F.upper(F.concat(F.col("event_type"), F.lit("-"), F.col("user_id") % 4))
    return (
        fx.table(spark, sf, "events")
        .select(variable.alias("variable"))
        .groupBy("variable")
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .withColumn("unit", sensor_unit(F.col("variable")))
    )


def variable_selection(spark, sf):
    chosen = LAYOUT.select_sensors("s-click", "s-purchase")
    index = index_events(fx.samples(spark, sf), chosen, RANGES)
    return index.table.select("instance_id", "n_rows", "valid")


def event_head(spark, sf):
    heads = rec.head_of_events(fx.samples(spark, sf), LAYOUT, 10)
    return heads.select("instance_id", "event_id")


def single_event(spark, sf):
    """The recording of the instance with the most samples (lowest id on ties)."""
    samples = fx.samples(spark, sf)
    longest = samples.groupBy("instance_id").count().orderBy(F.desc("count"), "instance_id").first()
    return rec.read_event(samples, longest["instance_id"], LAYOUT).select(
        "instance_id", "event_id", time_text(), *sensor_columns(), "class"
    )


# --- metrics --------------------------------------------------------------------------------


def moments(samples: DataFrame):
    return index_events(samples, LAYOUT, extra=moment_columns(LAYOUT))


def event_means(spark, sf):
    means = mt.event_means(fx.sparse_samples(spark, sf), LAYOUT)
    return means.select("instance_id", *sensor_columns())


def mean_of_means(spark, sf):
    means = mt.event_means(fx.sparse_samples(spark, sf), LAYOUT)
    return mt.trimmed_mean(means, LAYOUT).select("variable", rounded("value"))


def trimmed_means(spark, sf):
    means = mt.event_means(fx.sparse_samples(spark, sf), LAYOUT)
    return mt.trimmed_mean(means, LAYOUT, TRIM).select("variable", rounded("value"))


def order_statistics(spark, sf):
    """Values of some ranks of every sensor over all samples; the bound is far below their number."""
    long = fx.sparse_samples(spark, sf).unpivot([], [col(s) for s in SENSORS], "variable", "value")
    return order_stats.order_statistics(long, DEEP_RANKS, 1_000).select("variable", "rank", rounded("value"))


def deep_trimmed_means(spark, sf):
    """Means of all samples without as many at either end as a ranked list would not hold."""
    long = fx.sparse_samples(spark, sf).unpivot([], [col(s) for s in SENSORS], "variable", "value")
    return order_stats.trimmed_by_bounds(long, DEEP_TRIM, 1_000).select("variable", rounded("value"))


def sparse_stds(spark, sf):
    index = moments(fx.sparse_samples(spark, sf))
    means = mt.trimmed_mean(mt.indexed_means(index), LAYOUT, TRIM)
    return mt.event_stds(index, mt.as_mapping(means, LAYOUT))


def event_stds(spark, sf):
    return sparse_stds(spark, sf).select("instance_id", *sensor_columns())


def mean_of_stds(spark, sf):
    stds = mt.trimmed_mean(sparse_stds(spark, sf), LAYOUT, TRIM)
    return stds.select("variable", rounded("value"))


def metric_table(spark, sf):
    metrics = mt.metric_table(moments(fx.samples(spark, sf)), TRIM)
    return metrics.select("variable", rounded("mean_of_means"), rounded("mean_of_stds"))


def metric_memo(spark, sf):
    root = scratch(spark)
    index = moments(fx.samples(spark, sf))
    store.save_metrics(spark, root, "trimmed", lambda: mt.metric_table(index, TRIM))
    store.save_metrics(spark, root, "plain", lambda: mt.metric_table(index))
    metrics = store.load_metrics(spark, root, "plain")
    return metrics.select("variable", rounded("mean_of_means"), rounded("mean_of_stds"))


def standardized(spark, sf):
    samples = fx.samples(spark, sf)
    index = moments(samples)
    scaler = prepare.fit_scaler(index, TRIM)
    dense = standardize(impute(samples, index, SECONDS), scaler, LAYOUT)
    return dense.select("instance_id", "bin", *sensor_columns(), "class")


# --- windows --------------------------------------------------------------------------------


def checksum(windows: DataFrame) -> DataFrame:
    """Tensors as comparable scalars: a position-weighted sum, the corners, y as text."""
    flat = F.flatten("X")
    weighted = F.transform(flat, lambda v, i: v * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)
    return windows.withColumns(
        {
            "x_sum": off_tie(total, 4),
            "x_first": off_tie(F.get(flat, F.lit(0))),
            "x_last": off_tie(F.get(flat, F.size(flat) - 1)),
            "y_text": F.array_join("y", ""),
        }
    ).drop("X", "y")


def imputed_windows(spark, sf, **segments):
    samples = fx.samples(spark, sf)
    return wd.event_windows(samples, index_events(samples, LAYOUT), SECONDS, WINDOW, **segments)


def windows(spark, sf, **segments):
    return checksum(imputed_windows(spark, sf, **segments)).select(
        "instance_id", "window_idx", "x_sum", "x_first", "x_last"
    )


def windows_segmented(spark, sf):
    """The same windows with every event of over 64 bins cut into segments."""
    return windows(spark, sf, size=64)


def window_labels(spark, sf):
    return imputed_windows(spark, sf).select(
        "instance_id", "window_idx", "label", F.array_join("y", "").alias("y_text")
    )


def window_counts(spark, sf):
    return wd.window_counts(index_events(fx.samples(spark, sf), LAYOUT), SECONDS, WINDOW)


def tensor_stats(spark, sf):
    stats = ts.tensor_stats(prepared(spark, sf), LAYOUT)
    return stats.select("instance_id", *[rounded(c) for c in stats.columns[1:]])


def tensor_summary(spark, sf):
    summary = ts.tensor_summary(ts.tensor_stats(prepared(spark, sf), LAYOUT), LAYOUT)
    return summary.select("statistic", *[rounded(c) for c in summary.columns[1:]])


def verification(spark, sf):
    """Statistics of the stored tensors."""
    path = scratch(spark)
    store.write_windows(prepared(spark, sf), LAYOUT, path)
    stats, _ = prepare.verify_windows(store.read_windows(spark, path), LAYOUT)
    named = [c for c in stats.columns if ":" in c]
    return stats.select("instance_id", "order_hash", *[rounded(c) for c in named])


def tensor_store(spark, sf):
    """Windows made from stored blocks of bins."""
    path = scratch(spark)
    store.write_window_blocks(imputed(spark, sf), LAYOUT, path, WINDOW, block=64)
    return checksum(store.read_window_blocks(spark, path, LAYOUT, WINDOW)).select(
        "instance_id", "class_code", "window_idx", "x_sum", "label", "y_text"
    )


def epoch_reader(spark, sf):
    """Windows and labels of two epochs of training batches, per epoch."""
    path = scratch(spark)
    store.write_window_blocks(imputed(spark, sf), LAYOUT, path, WINDOW)
    blocks = spark.read.parquet(path)

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        for rows in batches:
            labels = [np.frombuffer(b, np.int64) for b in rows.column("labels").to_pylist()]
            columns = [pa.array([len(b) for b in labels], pa.int64()), pa.array([int(b.sum()) for b in labels], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["n_windows", "label_sum"])

    parts = [
        store.epoch_batches(blocks, LAYOUT, WINDOW, epoch).mapInArrow(summed, "n_windows long, label_sum long").withColumn("epoch", F.lit(epoch))
        for epoch in (1, 2)
    ]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("epoch").agg(F.sum("n_windows").alias("n_windows"), F.sum("label_sum").alias("label_sum"))


def longest_gap(batches):
    """Rows of an event and its longest time without one, batch by batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    event, n, last, longest = None, 0, None, 0
    for rows in batches:
        times = rows.column("ts").cast(pa.int64())
        if last is not None:
            longest = max(longest, times[0].as_py() - last)
        steps = pc.subtract(times[1:], times[:-1])
        longest = max(longest, pc.max(steps).as_py() or 0) if len(steps) else longest
        event, n, last = rows.column("instance_id")[0], n + len(times), times[-1].as_py()
    columns = [pa.array([event.as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([longest], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["instance_id", "n_rows", "longest_gap_us"])


def event_map(spark, sf):
    """A function of the user's own over every event in time order."""
    schema = "instance_id long, n_rows long, longest_gap_us long"
    return store.map_events(fx.samples(spark, sf), LAYOUT, longest_gap, schema, tie=["event_id"])


def event_batches(spark, sf):
    def count_batch(batch):
        import pandas as pd

        return pd.DataFrame(
            {
                "instance_id": [batch["instance_id"].iloc[0]],
                "n_windows": [len(batch)],
                "label_sum": [int(batch["label"].sum())],
            }
        )

    return store.map_event_batches(
        imputed_windows(spark, sf),
        LAYOUT,
        count_batch,
        "instance_id long, n_windows long, label_sum long",
        max_windows=64,
        columns=["label"],
        merge=[F.sum(c).alias(c) for c in ("n_windows", "label_sum")],
    )


# --- catalog and split ----------------------------------------------------------------------


def listing(spark, sf):
    return fx.files(spark, sf).withColumn("length", F.col("num_timesteps") * 100)


def catalog(spark, sf):
    rows = fx.files(spark, sf).select("path", F.col("num_timesteps").alias("n_rows"))
    return cat.event_catalog(listing(spark, sf), rows)


def event_catalog(spark, sf):
    wells = F.col("well_id").cast("double")
    return catalog(spark, sf).withColumns({"timestamp": time_text("timestamp"), "well_id": wells})


def cached_catalog(spark, sf):
    path = scratch(spark)
    store.cached_table(spark, path, lambda: catalog(spark, sf), use_cached=False)
    again = store.cached_table(spark, path, lambda: spark.range(0).toDF("path"))
    return again.select("event_id", "path", "num_timesteps")


def hash_ids(spark, sf):
    path = F.col("path")
    return fx.files(spark, sf).select(
        "instance_id", naming.event_key(path).alias("event_key"), naming.hash_id(path).alias("hash_id")
    )


def filename_parse(spark, sf):
    stem = naming.file_stem(F.col("path"))
    recorded = F.date_format(naming.recorded_at(stem), "yyyy-MM-dd HH:mm:ss")
    return fx.files(spark, sf).select(
        "instance_id",
        naming.class_folder(F.col("path")).alias("folder"),
        naming.source_of(stem).alias("source"),
        naming.well_id_of(stem).cast("double").alias("well_id"),
        recorded.alias("recorded"),
    )


def described(spark, sf):
    """The catalog, written once: later filters must not sink below its aggregation."""
    return cut_lineage(cat.describe_files(fx.files(spark, sf)))


def catalog_filter(spark, sf):
    kept = cat.filter_catalog(
        described(spark, sf), ["FLOW_INSTABILITY", 0, 7], ["REAL", 2], None
    )
    return kept.select("instance_id", "class_type", "source")


def well_filter(spark, sf):
    kept = cat.filter_catalog(described(spark, sf), [], None, [1, 2, 5], empty_means_all=True)
    return kept.select("instance_id", "class_type", "well_id")


def class_source_counts(spark, sf):
    return cat.class_source_counts(described(spark, sf))


def class_counts(spark, sf):
    return cat.class_counts(described(spark, sf))


def dataset_versions(spark, sf):
    return rec.dataset_versions(fx.versioned_listing(spark, sf))


def version_latest(spark, sf):
    usable = rec.is_valid_conversion(F.col("version"), F.col("has_data"), "3.11.6", True)
    return rec.latest_version(dataset_versions(spark, sf)).withColumn("usable", usable)


def dataset_size(spark, sf):
    return rec.dataset_size(fx.versioned_listing(spark, sf))


def divided(spark, sf):
    return sp.stratified_split(
        described(spark, sf), "instance_id", fx.VALIDATION_SIZE, fx.TEST_SIZE
    )


def stratified_split(spark, sf):
    return divided(spark, sf).select("instance_id", "source", "class_type", "split")


def split_counts(spark, sf):
    return sp.split_counts(divided(spark, sf))


def split_names(spark, sf):
    job = sp.split_dataset(
        described(spark, sf), "instance_id", fx.VERSION, fx.VALIDATION_SIZE, fx.TEST_SIZE,
        class_types=[4, "NORMAL"], sources=["HAND_DRAWN", "REAL"],
    )
    return job.select("instance_id", "split_name")


def shuffled(spark, sf):
    return sp.shuffled(fx.files(spark, sf).select("instance_id", "path"), "instance_id")


def split_store(spark, sf):
    path = scratch(spark)
    store.write_split(fx.samples(spark, sf), divided(spark, sf), LAYOUT, path)
    parts = [store.read_split(spark, path, s) for s in ("train", "validation", "test")]
    stored = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stored.select("instance_id", "event_id", "class_code", "split")


def class_folders(spark, sf, file_format, **options) -> tuple[str, SeriesLayout, object]:
    """The samples written the way raw recordings lie: files in numeric class folders."""
    root = scratch(spark)
    rows = fx.samples(spark, sf).select(
        F.col("ts").alias("timestamp"), *[col(s) for s in SENSORS], "class", "class_code"
    )
    rows = cut_lineage(rows.withColumn("timestamp", time_text("timestamp")))
    for code in range(9):
        part = rows.filter(F.col("class_code") == code).drop("class_code")
        part.write.format(file_format).options(**options).save(f"{root}/{code}")
    return root, SeriesLayout(SENSORS), rows.drop("class_code").schema


def recordings(spark, sf, suffix) -> tuple[str, SeriesLayout, T.StructType]:
    """A folder with one file per event, and what a reader has to know of it."""
    root = scratch(spark)
    cut_lineage(fx.recording_files(spark, sf, root, suffix))
    fields = [T.StructField(s, T.DoubleType()) for s in [*SENSORS, "class"]]
    return root, SeriesLayout(SENSORS), T.StructType([T.StructField("timestamp", T.StringType()), *fields])


def event_sums(samples: DataFrame) -> DataFrame:
    """Per event: rows, times, labels and the sum of each sensor."""
    return samples.groupBy("event_id", "class_code").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("ts").alias("n_times"),
        F.count("class").alias("n_labelled"),
        F.coalesce(F.sum("class"), F.lit(0.0)).alias("label_sum"),
        *[off_tie(F.sum(col(s)), 4).alias(s) for s in SENSORS],
    )


def csv_conversion(spark, sf):
    """CSV recordings, one file per event, converted; each event counted from the result."""
    root, layout, schema = recordings(spark, sf, "csv")
    converted = scratch(spark)
    rec.convert_csv_dataset(spark, root, converted, schema, layout)
    return event_sums(rec.read_samples(spark, converted, layout))


def csv_incremental(spark, sf):
    """CSV recordings converted in two runs, the second after new, changed and lost files."""
    root, layout, schema = class_folders(spark, sf, "csv", header=True)
    later, converted = scratch(spark), scratch(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = lambda of, code: hadoop.Path(f"{of}/{code}")
    files.mkdirs(hadoop.Path(later))
    for code in (7, 8):  # not there yet
        files.rename(place(root, code), place(later, code))
    rows = spark.read.schema(schema).option("header", True).csv(f"{root}/0")
    rows.write.option("header", True).csv(f"{root}/9")  # gone in the second run
    versions.convert_changed(spark, root, converted, schema, layout)
    for code in (7, 8):
        files.rename(place(later, code), place(root, code))
    files.rename(place(root, 9), hadoop.Path(f"{later}/9"))
    versions.convert_changed(spark, root, converted, schema, layout)
    samples = versions.read_converted(spark, converted, layout)
    return samples.groupBy("class_code").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("ts").alias("n_times"),
        *[off_tie(F.sum(col(s)), 4).alias(s) for s in SENSORS],
    )


def dataset_scan(spark, sf):
    """Parquet recordings scanned in place, next to their catalog: files without rows and files
    of tensors are events, foreign and nested ones are not."""
    root, layout, schema = recordings(spark, sf, "parquet")
    sums = event_sums(rec.read_parquet_recordings(spark, root, schema, layout)).drop("class_code", "n_rows")
    files = rec.dataset_catalog(spark, root)
    present = rec.has_converted_data(rec.list_dataset(spark, root))
    numbers = {n: F.col(n).cast("double") for n in ("well_id", "num_timesteps", "n_times", "n_labelled")}
    events = files.select("event_id", "class_code", "class_type", "source", "well_id", "num_timesteps")
    return events.join(sums, "event_id", "left").withColumns({**numbers, "has_data": F.lit(present)})


# --- scoring --------------------------------------------------------------------------------


def argmax_scores(spark, sf):
    return fx.scores(spark, sf).select("vec_id", "label", arg_max(F.col("scores")).alias("predicted"))


def scored(spark, sf):
    probability = softmax(F.col("scores"))
    return ev.predicted_class(fx.scores(spark, sf).withColumn("probability", probability))


def confusion_matrix(spark, sf):
    return ev.confusion_matrix(scored(spark, sf))


def accuracy_logloss(spark, sf):
    result = ev.accuracy_and_loss(scored(spark, sf))
    return result.select("n_windows", rounded("accuracy"), rounded("loss"))


def align_predictions(spark, sf, **limits):
    samples = fx.samples(spark, sf)
    index = index_events(samples, LAYOUT)
    windows = wd.event_windows(samples, index, SECONDS, WINDOW)
    predictions = windows.withColumnRenamed("label", "predicted")
    aligned = ev.align_predictions(samples, index, predictions, SECONDS, WINDOW, ["predicted"], **limits)
    predicted = F.col("predicted").cast("double").alias("predicted")
    return aligned.select("instance_id", time_text(), "bin", predicted)


def align_shuffled(spark, sf):
    """The same by the path for predictions too large to broadcast."""
    return align_predictions(spark, sf, most_rows=0)


def match_labels(spark, sf):
    """Windows of all events as predictions, those of the valid events as labels."""
    predictions = imputed_windows(spark, sf).select(
        "instance_id", "window_idx", (F.col("label") % 3).alias("predicted")
    )
    matched = ev.match_labels(predictions, prepared(spark, sf), "instance_id")
    return matched.select("instance_id", "window_idx", "predicted", "label")


# --- whole jobs -----------------------------------------------------------------------------


def prepared(spark, sf):
    return prepare.prepare_windows(
        fx.samples(spark, sf), LAYOUT, None, SECONDS, WINDOW, RANGES, TRIM
    )


def full_prepare(spark, sf):
    return checksum(prepared(spark, sf)).select(
        "instance_id", "class_code", "window_idx", "x_sum", "x_first", "x_last", "label", "y_text"
    )


def prepared_split(spark, sf):
    return prepare.prepare_split(
        fx.samples(spark, sf), divided(spark, sf), LAYOUT, SECONDS, WINDOW, RANGES
    )


def split_prepare(spark, sf):
    return checksum(prepared_split(spark, sf)).select(
        "instance_id", "split", "window_idx", "x_sum", "x_last", "label"
    )


def fixed_linear_model():
    """A model of the user's own: class scores are fixed linear functions of the window."""
    import numpy as np

    places = np.arange(WINDOW * len(SENSORS))
    weights = ((places[:, None] * 7 + np.arange(9) * 3) % 11 - 5) / 100.0
    return lambda x: np.nan_to_num(x.reshape(len(x), -1)) @ weights


def user_model_scores(spark, sf):
    scored = classify.score_with(
        prepared(spark, sf), fixed_linear_model, [WINDOW * len(SENSORS)]
    )
    top = off_tie(F.array_max("probability"), 5)
    return scored.select("instance_id", "window_idx", top.alias("top"))


def highest_sensor(windows: DataFrame) -> DataFrame:
    """The windows with a label that their sensors tell: the one with the largest sum over the window."""
    total = lambda s: off_tie(F.aggregate("X", F.lit(0.0), lambda a, step: a + F.coalesce(F.get(step, F.lit(s)), F.lit(0.0))))
    return windows.withColumn("label", arg_max(F.array(*[total(s) for s in range(len(SENSORS))])))


def sensor_windows(spark, sf):
    """Windows of all splits labelled by their sensors, written once since training passes over them many times."""
    path = scratch(spark)
    store.write_windows(highest_sensor(prepared_split(spark, sf)), LAYOUT, path)
    return store.read_windows(spark, path)


def majority_share(windows: DataFrame) -> float | None:
    """Share of the commonest label: the accuracy of the best constant model."""
    row = windows.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("share")).first()
    return row["share"]


def classifier_scores(spark, sf):
    """Every window scored by a trained model, whether its scores are a distribution, and whether
    it beats every constant model on its split."""
    stored = sensor_windows(spark, sf)
    train = stored.filter("split = 'train'")
    model = classify.fit_window_classifier(train, WINDOW, LAYOUT, hidden=16, max_iter=40)
    scored, _, _ = classify.evaluate_model(model, stored)
    scored = cut_lineage(scored)
    right = F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("right")
    shares = scored.groupBy("split", "label").count().groupBy("split").agg((F.max("count") / F.sum("count")).alias("share"))
    beaten = scored.groupBy("split").agg(right).join(shares, "split")
    beaten = beaten.select("split", (F.col("right") > F.col("share")).alias("beats_majority"))  # a row per split
    p = F.col("probability")
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return scored.join(F.broadcast(beaten), "split").select(
        "instance_id",
        "split",
        "window_idx",
        "label",
        ((F.size(p) == 9) & (F.abs(total - 1) < 1e-9)).alias("sums_to_one"),
        (F.get(p, F.col("predicted")) == F.array_max(p)).alias("is_argmax"),
        "beats_majority",
    )


def classifier_search(spark, sf):
    """Real labels of the test split, as the chosen model's confusion matrix counts them, how many
    candidates would have been better on the validation split, and whether the chosen one beats
    every constant model there. Without validation windows nothing is searched: no row."""
    stored = sensor_windows(spark, sf)
    train, validation, test = (stored.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    if validation.isEmpty():
        return spark.createDataFrame([], "label int, n_windows long, n_better int, beats_majority boolean")
    grid = [{"hidden": 8, "max_iter": 1}, {"hidden": 16, "max_iter": 40}]
    model, ranking = classify.search_classifier(train, validation, WINDOW, LAYOUT, grid)
    chosen = ev.accuracy_and_loss(classify.score_windows(model, validation)).first()["accuracy"]
    n_better = sum(accuracy > chosen for _, accuracy in ranking)
    cells = classify.evaluate_model(model, test)[1]
    total = sum((F.col(f"p{c}") for c in range(1, 9)), F.col("p0"))
    beats = F.lit(chosen > majority_share(validation)).alias("beats_majority")
    return cells.select("label", total.alias("n_windows"), F.lit(n_better).alias("n_better"), beats)


def network(**parameters) -> recurrent.Network:
    return recurrent.Network(WINDOW, len(SENSORS), **{"units": (16,), "dense": 16, "rate": 0.01} | parameters)


def recurrent_scores(spark, sf):
    """Windows of each split, and whether a recurrent classifier, stopped early on the validation
    split and stored by rounds, beats every constant model there. No row without validation."""
    stored = sensor_windows(spark, sf)
    train, validation = (stored.filter(F.col("split") == s) for s in ("train", "validation"))
    if validation.isEmpty():
        return spark.createDataFrame([], "split string, n_windows long, beats_majority boolean")
    run = scratch(spark)
    recurrent.fit_recurrent(train, validation, network(), max_rounds=6, patience=3, path=run)
    trained = recurrent.fit_recurrent(train, validation, network(), max_rounds=8, patience=3, path=run)
    scored = cut_lineage(recurrent.score_recurrent(trained, stored).select("split", "label", "predicted"))
    cells = scored.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("right")
    )
    return cells.groupBy("split").agg(
        F.sum("n").alias("n_windows"), (F.sum("right") > F.max("n")).alias("beats_majority")
    )


def recurrent_search(spark, sf):
    """Three candidates by successive halving, two of which cannot learn: rounds that each ran, which
    one was chosen, and the validation windows it was chosen by. No row without validation."""
    stored = sensor_windows(spark, sf)
    train, validation = (stored.filter(F.col("split") == s) for s in ("train", "validation"))
    schema = "candidate int, rounds int, is_best boolean, n_validation long, window_passes int, scans int"
    n = validation.count()
    if not n:
        return spark.createDataFrame([], schema)
    grid = [network(rate=1e-9), network(), network(rate=1e-8)]
    found = recurrent.successive_halving(train, validation, [(grid, 1)], max_rounds=3)
    rows = [
        (grid.index(t.network), t.rounds, rank == 0, n, found.window_passes, found.scans)
        for rank, t in enumerate(found.ranking)
    ]
    return spark.createDataFrame(rows, schema)


QUERIES = {
    "downsample": downsampled,
    "gap_bins": gap_bins,
    "impute": imputed_sensors,
    "class_fill": class_fill,
    "interp_overlay": interp_overlay,
    "overlay_segmented": overlay_segmented,
    "valid_events": valid_events,
    "valid_samples": valid_samples,
    "invalid_events": invalid_events,
    "invalid_event_samples": invalid_event_samples,
    "attach_shuffled": attach_shuffled,
    "flow_state": flow_state,
    "sensor_units": sensor_units,
    "variable_selection": variable_selection,
    "event_head": event_head,
    "single_event": single_event,
    "event_means": event_means,
    "mean_of_means": mean_of_means,
    "trimmed_means": trimmed_means,
    "order_statistics": order_statistics,
    "deep_trimmed_means": deep_trimmed_means,
    "event_stds": event_stds,
    "mean_of_stds": mean_of_stds,
    "metric_table": metric_table,
    "metric_memo": metric_memo,
    "standardize": standardized,
    "windows": windows,
    "windows_segmented": windows_segmented,
    "window_labels": window_labels,
    "window_counts": window_counts,
    "tensor_stats": tensor_stats,
    "tensor_summary": tensor_summary,
    "verification": verification,
    "tensor_store": tensor_store,
    "epoch_reader": epoch_reader,
    "event_map": event_map,
    "event_batches": event_batches,
    "event_catalog": event_catalog,
    "cached_catalog": cached_catalog,
    "hash_ids": hash_ids,
    "filename_parse": filename_parse,
    "catalog_filter": catalog_filter,
    "well_filter": well_filter,
    "class_source_counts": class_source_counts,
    "class_counts": class_counts,
    "dataset_versions": dataset_versions,
    "version_latest": version_latest,
    "dataset_size": dataset_size,
    "stratified_split": stratified_split,
    "split_counts": split_counts,
    "split_names": split_names,
    "shuffled": shuffled,
    "split_store": split_store,
    "csv_conversion": csv_conversion,
    "csv_incremental": csv_incremental,
    "dataset_scan": dataset_scan,
    "argmax_scores": argmax_scores,
    "confusion_matrix": confusion_matrix,
    "accuracy_logloss": accuracy_logloss,
    "align_predictions": align_predictions,
    "align_shuffled": align_shuffled,
    "match_labels": match_labels,
    "full_prepare": full_prepare,
    "split_prepare": split_prepare,
    "user_model_scores": user_model_scores,
    "classifier_scores": classifier_scores,
    "classifier_search": classifier_search,
    "recurrent_scores": recurrent_scores,
    "recurrent_search": recurrent_search,
}
