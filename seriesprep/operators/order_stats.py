"""Exact order statistics of many variables at once, without sorting any of them.

Mergeable quantile sketches, one row per task and variable, bound every wanted value; one counting
pass proves or corrects the bounds, so that the sketch's chance never reaches a result. Only values
between proven bounds are written and looked at again, until few enough are left to be ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesprep.session import cut_lineage

#: Values of one target that a single task ranks.
RANKED_ROWS = 100_000
#: Size of a sketch: ranks are off by about 0.2 percent of the values.
SKETCH_SIZE = 2_000
#: Quantiles read from a sketch, and how many of them lie between a rank and its bounds.
STEPS, MARGIN = 1_000, 4


@dataclass
class Target:
    """The ``rank``-th least known value of a variable (from 1), between bounds that are not it."""

    variable: str
    wanted: int
    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def name(self) -> str:
        return f"{self.wanted}:{self.variable}"

    def around(self, quantiles: Sequence[float]) -> tuple[float, float]:
        at = self.rank / self.size * STEPS
        return quantiles[max(int(at) - MARGIN, 0)], quantiles[min(int(at) + 1 + MARGIN, STEPS)]

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Take in the counts of values below ``a``, equal to it, up to ``b`` and equal to ``b``."""
        if self.rank <= below:
            self.high, self.size = a, below
        elif self.rank <= below + at_a:
            self.value = a
        elif self.rank <= below + at_a + between:
            self.low, self.high, self.rank, self.size = a, b, self.rank - below - at_a, between
        elif self.rank <= below + at_a + between + at_b:
            self.value = b
        else:
            passed = below + at_a + between + at_b
            self.low, self.rank, self.size = b, self.rank - passed, self.size - passed


def _sketched(values: DataFrame, by: str) -> list:
    grid = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    sketch = values.groupBy(by).agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch"))
    return sketch.select(by, F.kll_sketch_get_quantile_double("sketch", grid).alias("quantiles")).collect()


def _rows(values: DataFrame, targets: Sequence[Target], bounds: Mapping[str, tuple[float, float]] = {}) -> DataFrame:
    """``target, value`` of the values inside each target's bounds, with ``a`` and ``b``; targets
    are a few per variable, so their table is small whatever the data."""
    rows = [(t.variable, t.name, t.low, t.high, *bounds.get(t.name, (None, None))) for t in targets]
    by = "target" if "target" in values.columns else "variable"
    known = values.sparkSession.createDataFrame(
        rows, "variable string, target string, low double, high double, a double, b double"
    )
    joined = values.join(F.broadcast(known.drop("variable") if by == "target" else known), by)
    after = F.col("low").isNull() | (F.col("value") > F.col("low"))
    before = F.col("high").isNull() | (F.col("value") < F.col("high"))
    return joined.filter(after & before).select("target", "value", "a", "b")


def _count(values: DataFrame, targets: Sequence[Target], bounds: Mapping[str, tuple[float, float]]) -> None:
    """One pass over ``values``: counts about every target's bounds, one row per target."""
    value, a, b = F.col("value"), F.col("a"), F.col("b")
    number = lambda held: F.count_if(held)
    counted = _rows(values, targets, bounds).groupBy("target").agg(
        number(value < a).alias("below"),
        number(value == a).alias("at_a"),
        number((value > a) & (value < b)).alias("between"),
        number((value == b) & (a < b)).alias("at_b"),
    )
    found = {r["target"]: r for r in counted.collect()}
    for t in targets:
        r = found[t.name]
        t.narrow(*bounds[t.name], r["below"], r["at_a"], r["between"], r["at_b"])


def _ranked(values: DataFrame, targets: Sequence[Target]) -> None:
    """The values of targets with at most the ranked rows between their bounds."""
    ranks = values.sparkSession.createDataFrame([(t.name, t.rank) for t in targets], "target string, rank long")
    each = _rows(values, targets).groupBy("target", "value").count()
    reached = F.sum("count").over(W.partitionBy("target").orderBy("value"))
    least = each.withColumn("reached", reached).join(F.broadcast(ranks), "target").filter("reached >= rank")
    found = dict(least.groupBy("target").agg(F.min("value")).collect())
    for t in targets:
        t.value = found[t.name]


def order_statistics(values: DataFrame, ranks: Sequence[int], ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """``variable, rank, value``: for every variable of ``variable, value`` and every rank the
    value of that rank, 1 for the least, -1 for the greatest, ties counted each.

    Nulls have no rank; NaN is greater than every number, as in Spark's order. A rank beyond the
    known values has no row. No variable has to fit a task: at most ``ranked_rows`` values of a
    target are ranked by one, and a value that a large share of the rows hold is one row by then.
    """
    spark = values.sparkSession
    type_of = dict(values.dtypes)["variable"]
    whole = values.select(F.col("variable").cast("string").alias("variable"), F.col("value").cast("double").alias("value"))
    whole = whole.filter(F.col("value").isNotNull())
    number = F.col("value").isNaN()
    sizes = whole.groupBy("variable").agg(F.count_if(~number).alias("n"), F.count_if(number).alias("n_nan")).collect()
    whole = whole.filter(~number)
    targets, done = [], []
    for row in sizes:
        for wanted in dict.fromkeys(ranks):
            rank = wanted if wanted > 0 else row["n"] + row["n_nan"] + 1 + wanted
            if row["n"] < rank <= row["n"] + row["n_nan"]:
                done.append((row["variable"], wanted, float("nan")))
            elif 0 < rank <= row["n"]:
                targets.append(Target(row["variable"], wanted, rank, row["n"]))
    held, by = whole, "variable"
    while large := [t for t in targets if t.value is None and t.size > ranked_rows]:
        quantiles = {r[by]: r["quantiles"] for r in _sketched(held, by)}
        bounds = {t.name: t.around(quantiles[t.variable if by == "variable" else t.name]) for t in large}
        _count(held, large, bounds)
        rest = [t for t in large if t.value is None and t.size > ranked_rows]
        small = [t for t in large if t.value is None and t.size <= ranked_rows]
        if small:
            _ranked(held, small)
        if rest:
            held, by = cut_lineage(_rows(held, rest).select("target", "value")), "target"
    small = [t for t in targets if t.value is None]
    if small:
        _ranked(whole, small)
    done += [(t.variable, t.wanted, t.value) for t in targets]
    found = spark.createDataFrame(done, "variable string, rank int, value double")
    return found.withColumn("variable", F.col("variable").cast(type_of))


def trimmed_by_bounds(values: DataFrame, k: int, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """``variable, value``: the mean of each variable without its k least and k greatest values.

    Which of equal values go does not matter for the mean, only how many; where both ends lie in
    one run of equal values they drop the same rows, so the larger number counts once.
    """
    ends = order_statistics(values, (k, -k), ranked_rows)
    one = lambda rank, name: F.max(F.when(F.col("rank") == rank, F.col("value"))).alias(name)
    ends = ends.groupBy("variable").agg(one(k, "least"), one(-k, "most"))  # a row per variable
    value, least, most = F.col("value"), F.col("least"), F.col("most")
    inside = (value > least) & (value < most)
    counted = values.join(F.broadcast(ends), "variable", "left").groupBy("variable", "least", "most").agg(
        F.sum(F.when(inside, value)).alias("sum"),
        F.count_if(inside).alias("n"),
        (k - F.count_if(value < least)).alias("at_least"),
        (k - F.count_if(value > most)).alias("at_most"),
        F.count_if(value == least).alias("n_least"),
        F.count_if(value == most).alias("n_most"),
    )
    left, right = F.col("n_least") - F.col("at_least"), F.col("n_most") - F.col("at_most")
    part = lambda count, v: F.when(count > 0, count * v).otherwise(0.0)
    total = F.coalesce("sum", F.lit(0.0)) + part(left, least) + part(right, most)
    mean: Column = F.when(least < most, F.try_divide(total, F.col("n") + left + right)).when(
        (least == most) & (F.col("n_least") > F.greatest("at_least", "at_most")), least
    )
    return counted.select("variable", mean.alias("value"))
