"""Vectorised scans over sorted groups inside tasks.

Rows arrive sorted by group. Batches are joined until a group is complete, then all complete
groups are handled at once by array operations, so neither a group nor a row costs a call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(rows: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First row of each group; null keys are a group like any other."""
    if rows.num_rows == 0:
        return np.zeros(0, np.int64)
    differs = np.zeros(rows.num_rows - 1, bool)
    for key in keys:
        column = rows[key]
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy()
        differs |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


def whole_groups(
    keys: list[str], handle: Callable[[pa.Table, np.ndarray], pa.Table]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that calls ``handle(rows, starts)`` on complete groups.

    The task's rows must be sorted by ``keys``. It holds one batch and the group that is open.
    """

    def key_of(batch: pa.RecordBatch, row: int) -> list:
        return [batch[key][row].as_py() for key in keys]

    def finished(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from handle(rows, group_starts(rows, keys)).to_batches(max_chunksize=65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cut = int(group_starts(batch, keys)[-1])
            goes_on = bool(held) and key_of(held[-1], held[-1].num_rows - 1) == key_of(batch, 0)
            if cut == 0 and (goes_on or not held):
                held.append(batch)
                continue
            yield from finished([*held, batch.slice(0, cut)] if cut else held)
            held = [batch.slice(cut)]
        if held:
            yield from finished(held)

    return run


@dataclass(frozen=True)
class Neighbours:
    """Per row, the known values at or before it and after it; positions as floats."""

    known: np.ndarray
    has_prev: np.ndarray
    prev_pos: np.ndarray
    prev_val: np.ndarray
    has_next: np.ndarray
    next_pos: np.ndarray
    next_val: np.ndarray


def known_neighbours(
    column: pa.ChunkedArray,
    at: np.ndarray,
    first: np.ndarray,
    last: np.ndarray,
    around: Mapping[str, pa.ChunkedArray] | None = None,
) -> Neighbours:
    """Nearest known values of a column within groups that start at row ``first`` and end before
    row ``last``, else those that ``around`` carries in from outside the group."""
    n = len(at)
    known = pc.is_valid(column).to_numpy()
    values = pc.fill_null(column, 0.0).to_numpy()
    rows = np.arange(n)
    prev = np.maximum.accumulate(np.where(known, rows, -1))
    later = np.minimum.accumulate(np.where(known, rows, n)[::-1])[::-1]
    following = np.append(later[1:], n)

    def side(name: str, index: np.ndarray, inside: np.ndarray):
        index = np.where(inside, index, 0)
        pos, val = at[index].astype(np.float64), values[index]
        if not around:
            return inside, pos, val
        outer_pos, outer_val = around[f"{name}_pos"], around[f"{name}_val"]
        outside = ~inside & pc.is_valid(outer_pos).to_numpy()
        pos = np.where(outside, pc.fill_null(outer_pos, 0).to_numpy(), pos)
        val = np.where(outside, pc.fill_null(outer_val, 0.0).to_numpy(), val)
        return inside | outside, pos, val

    has_prev, prev_pos, prev_val = side("prev", prev, prev >= first)
    has_next, next_pos, next_val = side("next", following, following < last)
    return Neighbours(known, has_prev, prev_pos, prev_val, has_next, next_pos, next_val)
