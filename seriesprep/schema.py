"""Fixed values of the data model and the column layout every operator works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values ---------------------------------------------------------------------------

SENSORS = (
    "P-PDG",
    "P-TPT",
    "T-TPT",
    "P-MON-CKP",
    "T-JUS-CKP",
    "P-JUS-CKGL",
    "QGL",
)

# Inclusive physical range of each sensor.
SENSOR_RANGES = {
    "P-PDG": (-1e10, 1e10),
    "P-TPT": (-1e9, 1e9),
    "T-TPT": (-1e3, 1e3),
    "P-MON-CKP": (-1e9, 1e9),
    "T-JUS-CKP": (-1e3, 1e3),
    "P-JUS-CKGL": (-1e10, 1e10),
    "QGL": (-3.0, 3.0),
}

# Class code = position.
CLASS_NAMES = (
    "NORMAL",
    "ABRUPT_INCREASE_BSW",
    "SPURIOUS_CLOSURE_DHSV",
    "SEVERE_SLUGGING",
    "FLOW_INSTABILITY",
    "RAPID_PRODUCTIVITY_LOSS",
    "QUICK_RESTRICTION_PCK",
    "SCALING_IN_PCK",
    "HYDRATE_IN_PRODUCTION_LINE",
)
NUM_CLASSES = len(CLASS_NAMES)

# Source code = position.
SOURCE_NAMES = ("REAL", "SIMULATED", "HAND_DRAWN")

# A sample label of 100 + c marks the transient phase of anomaly class c.
TRANSIENT_OFFSET = 100
TRANSIENT_LABELS = (101, 108)
PERMANENT_LABELS = (1, 8)

UNIT_BY_INITIAL = {"P": "[Pa]", "T": "[ºC]", "Q": "[sm³/s]"}

VERSION_PREFIX = "dataset_converted_v"
SPLIT_SEED = 1331

# Columns of a raw recording in file order; T-JUS-CKGL is read past, never used.
RAW_CSV_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.StringType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in (*SENSORS[:6], "T-JUS-CKGL", SENSORS[6], "class")
    ]
)

CATALOG_COLUMNS = (
    "hash_id",
    "class_type",
    "class_code",
    "source",
    "well_id",
    "path",
    "timestamp",
    "file_size",
    "num_timesteps",
)

# --- Layout ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class SeriesLayout:
    """Names of the columns in a long samples table (one row per event and timestep)."""

    sensors: tuple[str, ...] = SENSORS
    key: str = "event_id"
    ts: str = "ts"
    label: str = "class"
    code: str = "class_code"

    def select_sensors(self, *names: str) -> "SeriesLayout":
        return SeriesLayout(tuple(names), self.key, self.ts, self.label, self.code)


def col(name: str) -> Column:
    """Column by its literal name; sensor names contain dashes."""
    return F.col(f"`{name}`")


def class_dimension(spark: SparkSession) -> DataFrame:
    code = F.col("id").cast("int")
    return spark.range(0, NUM_CLASSES, 1, 1).select(
        code.alias("class_code"), class_name(code).alias("class_type")
    )


def class_name(code: Column) -> Column:
    """Name of a class code; an unknown code is an error, a null stays null."""
    names = F.array(*[F.lit(name) for name in CLASS_NAMES])
    known = code.between(0, NUM_CLASSES - 1)
    unknown = F.raise_error(F.concat(F.lit("unknown class code: "), code.cast("string")))
    return F.when(known, F.get(names, code.cast("int"))).when(code.isNotNull(), unknown)


def class_code(name: Column) -> Column:
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return (F.nullif(F.array_position(names, name), F.lit(0)) - 1).cast("int")


def source_code(name: Column) -> Column:
    names = F.array(*[F.lit(n) for n in SOURCE_NAMES])
    return (F.nullif(F.array_position(names, name), F.lit(0)) - 1).cast("int")


def class_label(value: int | str) -> str:
    """Class name from a code or a name, so callers may pass either."""
    if isinstance(value, str):
        if value not in CLASS_NAMES:
            raise ValueError(f"unknown class: {value}")
        return value
    if not 0 <= value < NUM_CLASSES:
        raise ValueError(f"unknown class code: {value}")
    return CLASS_NAMES[value]


def source_label(value: int | str) -> str:
    """Source name from a code or a name, so callers may pass either."""
    if isinstance(value, str):
        if value not in SOURCE_NAMES:
            raise ValueError(f"unknown source: {value}")
        return value
    if not 0 <= value < len(SOURCE_NAMES):
        raise ValueError(f"unknown source code: {value}")
    return SOURCE_NAMES[value]
