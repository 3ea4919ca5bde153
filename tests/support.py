"""Small recordings, plan inspection and comparison helpers."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from seriesprep.schema import SeriesLayout

START = datetime(2017, 3, 16, 12, 2, 3)
AB = SeriesLayout(("P-A", "T-B"), "event_id")
AB_SCHEMA = "event_id string, ts timestamp, `P-A` double, `T-B` double, class double, class_code int"


def recording(spark, rows, layout=AB, schema=AB_SCHEMA):
    """Samples from ``(event, second, a, b, class, code)`` tuples."""
    data = [(e, START + timedelta(seconds=s), a, b, c, code) for e, s, a, b, c, code in rows]
    return spark.createDataFrame(data, schema)


def random_rows(seed, events=12, longest=400, null_share=0.5):
    """Random recordings with gaps, repeated bins, leading and trailing nulls."""
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(events):
        n = int(rng.integers(1, longest))
        seconds = np.sort(rng.choice(np.arange(longest * 3), n, replace=False))
        code = int(rng.integers(0, 9))
        for s in seconds:
            a, b = rng.normal(size=2)
            label = float(rng.choice([0, code, 100 + code if code else 0]))
            rows.append(
                (
                    f"e{e}",
                    int(s),
                    None if rng.random() < null_share else float(a),
                    None if rng.random() < null_share or e == 0 else float(b),
                    None if rng.random() < null_share else label,
                    code,
                )
            )
    return rows


def frames_by_event(rows):
    columns = ["event_id", "second", "P-A", "T-B", "class", "class_code"]
    frame = pd.DataFrame(rows, columns=columns).astype({"P-A": float, "T-B": float, "class": float})
    frame.index = pd.to_datetime(frame["second"].map(lambda s: START + timedelta(seconds=int(s))))
    return {event: part.sort_index() for event, part in frame.groupby("event_id")}


def pandas_resample(part, seconds):
    grid = part.resample(f"{seconds}s", origin="start")
    bins = grid[["P-A", "T-B"]].mean()
    bins["class"] = grid["class"].min()
    return bins


def pandas_impute(bins, code):
    out = bins.copy()
    for c in ("P-A", "T-B"):
        out[c] = bins[c].interpolate("linear").ffill().bfill().fillna(0)
    out["class"] = bins["class"].ffill().bfill().fillna(code)
    return out


def by_event(frame, order, columns):
    """``{event: list of tuples}`` in the given order."""
    result = {}
    for row in frame.orderBy("event_id", order).collect():
        result.setdefault(row["event_id"], []).append(tuple(row[c] for c in columns))
    return result


def same(a, b, tolerance=1e-9):
    missing_a = a is None or (isinstance(a, float) and math.isnan(a))
    missing_b = b is None or (isinstance(b, float) and math.isnan(b))
    if missing_a or missing_b:
        return missing_a and missing_b
    if isinstance(a, float) or isinstance(b, float):
        return a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    return a == b


def assert_rows(found, wanted):
    assert len(found) == len(wanted), (len(found), len(wanted))
    for f, w in zip(found, wanted):
        assert len(f) == len(w) and all(same(x, y) for x, y in zip(f, w)), (f, w)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()
