"""Exact stratified train/validation/test split and reproducible shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesprep.functions.naming import split_base_name, split_name
from seriesprep.operators.catalog import filter_catalog
from seriesprep.schema import SPLIT_SEED, class_code, source_code

# Ranking buckets per stratum. A bucket is a range of the (uniform) order hash, so its rows are
# about 1 / RANK_BUCKETS of the stratum, however large the stratum is.
RANK_BUCKETS = 4_096


def order_hash(key: Column, seed: int = SPLIT_SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def shuffled(events: DataFrame, key: str, seed: int = SPLIT_SEED) -> DataFrame:
    """Events in a random but reproducible order."""
    return events.withColumn("order_hash", order_hash(F.col(key), seed)).orderBy("order_hash")


def stratum_quotas(counts: DataFrame, validation_size: float, test_size: float) -> DataFrame:
    """Test and validation quota of each stratum in ``counts(source_code, class_code, n)``.

    The shares of all rows, rounded up, are dealt out by largest remainder (integer arithmetic;
    ties by stratum code), first the test rows, then the validation rows out of what is left. A
    stratum with a single row left cannot be divided and stays in train.

    ``counts`` has one row per (source, class), so its windows over all rows are tiny.
    """
    everything = W.partitionBy()
    by_code = (F.asc("source_code"), F.asc("class_code"))

    def deal(table: DataFrame, pool: str, share: float, quota: str) -> DataFrame:
        usable = F.when(F.col(pool) >= 2, F.col(pool)).otherwise(F.lit(0))
        table = table.withColumn("_c", usable).withColumn("_all", F.sum("_c").over(everything))
        target = F.ceil(F.lit(share) * F.col("_all")).cast("long")
        table = table.withColumn("_target", target).withColumns(
            {
                "_floor": F.expr("coalesce((_target * _c) div nullif(_all, 0), 0)"),
                "_rest": F.expr("coalesce((_target * _c) % nullif(_all, 0), 0)"),
            }
        )
        rank = F.row_number().over(W.orderBy(F.desc("_rest"), *by_code))
        missing = F.col("_target") - F.sum("_floor").over(everything)
        extra = F.when(rank <= missing, F.lit(1)).otherwise(F.lit(0))
        table = table.withColumn(quota, F.col("_floor") + extra)
        return table.drop("_c", "_all", "_target", "_floor", "_rest")

    table = deal(counts, "n", test_size, "n_test")
    if validation_size > 0:
        table = table.withColumn("_left", F.col("n") - F.col("n_test"))
        table = deal(table, "_left", validation_size / (1 - test_size), "n_validation").drop("_left")
    else:
        table = table.withColumn("n_validation", F.lit(0).cast("long"))
    return table.withColumn("n_train", F.col("n") - F.col("n_test") - F.col("n_validation"))


def ranked_in_stratum(events: DataFrame, strata: list[str], buckets: int = RANK_BUCKETS) -> DataFrame:
    """Add ``_rank``, the 1-based rank by ``order_hash`` within a stratum.

    No stratum is sorted as a whole: rows rank inside their bucket of the hash range, and a
    bucket starts after the rows counted in the buckets before it.
    """
    leading = F.conv(F.substring("order_hash", 1, 8), 16, 10).cast("long")
    bucketed = events.withColumn("_bucket", F.shiftright(leading * buckets, 32))
    counts = bucketed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*strata).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *strata, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    within = W.partitionBy(*strata, "_bucket").orderBy("order_hash")
    # offsets: at most (sources + 1) * classes * buckets rows.
    return (
        bucketed.join(F.broadcast(offsets), [*strata, "_bucket"])
        .withColumn("_rank", F.col("_offset") + F.row_number().over(within))
        .drop("_offset", "_bucket")
    )


def with_strata(catalog: DataFrame) -> DataFrame:
    """Non-null stratum codes; events without a known source form strata of their own."""
    return catalog.withColumns(
        {
            "_source": F.coalesce(source_code(F.col("source")), F.lit(-1)),
            "_class": F.coalesce(class_code(F.col("class_type")), F.lit(-1)),
        }
    )


def stratified_split(
    catalog: DataFrame,
    key: str,
    validation_size: float,
    test_size: float,
    seed: int = SPLIT_SEED,
    buckets: int = RANK_BUCKETS,
) -> DataFrame:
    """Add ``split`` (train, validation or test), stratified by source and class."""
    events = with_strata(catalog).withColumn("order_hash", order_hash(F.col(key), seed))
    strata = ["_source", "_class"]
    counts = events.groupBy(
        F.col("_source").alias("source_code"), F.col("_class").alias("class_code")
    ).agg(F.count(F.lit(1)).alias("n"))
    quotas = stratum_quotas(counts, validation_size, test_size).select(
        F.col("source_code").alias("_source"),
        F.col("class_code").alias("_class"),
        "n_test",
        "n_validation",
    )
    # quotas: one row per (source, class).
    ranked = ranked_in_stratum(events, strata, buckets).join(F.broadcast(quotas), strata)
    split = (
        F.when(F.col("_rank") <= F.col("n_test"), "test")
        .when(F.col("_rank") <= F.col("n_test") + F.col("n_validation"), "validation")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).select(*[F.col(c) for c in catalog.columns], "split")


def split_dataset(
    catalog: DataFrame,
    key: str,
    version: str,
    validation_size: float,
    test_size: float,
    class_types: Sequence[int | str] | None = None,
    sources: Sequence[int | str] | None = None,
    well_ids: Sequence[int] | None = None,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """The whole split job: filter, draw, and name the split each event belongs to."""
    chosen = filter_catalog(catalog, class_types, sources, well_ids, empty_means_all=True)
    base = split_base_name(version, test_size, class_types, sources, well_ids)
    drawn = stratified_split(chosen, key, validation_size, test_size, seed)
    return drawn.withColumns(
        {
            "split_name": split_name(base, F.col("split")),
            "validation_size": F.lit(validation_size),
            "test_size": F.lit(test_size),
        }
    )


def split_counts(divided: DataFrame) -> DataFrame:
    return divided.groupBy("split", "source", "class_type").agg(F.count(F.lit(1)).alias("n"))
