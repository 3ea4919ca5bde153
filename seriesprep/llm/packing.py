"""Best-fit packing of documents into sequences, under conflicts.

A bin holds at most ``capacity`` words, no two pieces of one source and no two members of one
duplicate cluster. A text longer than the capacity is cut: full pieces fill bins of their own,
the rest is packed. Each bin carries a bitmap of its sources and one of its clusters. Pieces come
largest first; the open bins lie in order of residual space, and the search starts at the least
residual that holds the piece and goes on to the next larger one until a bin without conflict is
found, else a bin is opened.

Packing is dealt over shards by hash of the row, whatever source or cluster it has, so a hot
source is spread evenly. A shard has about ``SHARD_ROWS`` rows; their number follows the input.
Only id, size, source and cluster are shuffled, never text.

Defined results: a text without words is one empty piece, which fits any bin without conflict. A
null source or cluster conflicts with nothing. Rows that repeat are packed each. Equal residuals
are taken in the order bins were opened, equal sizes in order of id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2_048
SHARD_ROWS = 8_192
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, piece int, first_word long, n_words long, bin_id string, bin_offset int"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class ConflictBitmaps:
    """Bit sets over labels, one row of 64-bit words per bin. Labels that occur once get no bit."""

    def __init__(self, labels: np.ndarray, most_bins: int):
        codes, names = pd.factorize(labels)
        repeated = np.bincount(codes[codes >= 0], minlength=len(names)) > 1
        number = np.cumsum(repeated) - 1
        self.bit = np.where((codes >= 0) & repeated[codes], number[codes], -1) if len(names) else np.full(len(labels), -1)
        self.rows = np.zeros((most_bins, max(1, -(-int(repeated.sum()) // 64))), np.uint64)

    def free(self, bins: np.ndarray, item: int) -> np.ndarray:
        bit = int(self.bit[item])
        if bit < 0:
            return np.ones(len(bins), bool)
        return (self.rows[bins, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 0

    def put(self, bin_number: int, item: int) -> None:
        bit = int(self.bit[item])
        if bit >= 0:
            self.rows[bin_number, bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of items given in packing order."""
    n = len(sizes)
    marks = (ConflictBitmaps(sources, n), ConflictBitmaps(clusters, n))
    order = np.empty(n, np.int64)  # residual * n + bin, ascending
    n_bins = 0
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for item in range(n):
        size = int(sizes[item])
        at, found = int(np.searchsorted(order[:n_bins], size * n)), -1
        step = 64
        while at < n_bins:
            near = order[at : min(at + step, n_bins)] % n
            fits = marks[0].free(near, item) & marks[1].free(near, item)
            if fits.any():
                found = at + int(np.argmax(fits))
                break
            at += step
            step *= 2
        if found < 0:
            chosen, residual, found = n_bins, capacity, n_bins
            n_bins += 1
        else:
            residual, chosen = divmod(int(order[found]), n)
        bins[item], offsets[item] = chosen, capacity - residual
        for m in marks:
            m.put(chosen, item)
        key = (residual - size) * n + chosen
        to = int(np.searchsorted(order[:found], key))
        order[to + 1 : found + 1] = order[to:found].copy()
        order[to] = key
    return bins, offsets


def _pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], kind="stable", ignore_index=True)
    bins, offsets = best_fit(rows["size"].to_numpy(), rows["source"].to_numpy(), rows["cluster"].to_numpy(), capacity)
    shard = str(rows["shard"].iloc[0])
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"],
            "piece": (rows["n_words"] // capacity).astype("int32"),
            "first_word": rows["n_words"] // capacity * capacity,
            "n_words": rows["size"],
            "bin_id": [f"{shard}-{b}" for b in bins],
            "bin_offset": offsets.astype("int32"),
        }
    )


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of ``doc_id, n_words, source, cluster, mark`` with their bins.

    ``mark`` (long) tells rows with one id apart. Returns ``doc_id, piece, first_word, n_words,
    bin_id, bin_offset``; every word of every row is in exactly one piece.
    """
    n_shards = -(-sizes.count() // shard_rows) or 1
    size = F.col("n_words") % capacity
    size = F.when((F.col("n_words") > 0) & (size == 0), capacity).otherwise(size)
    rest = sizes.filter((F.col("n_words") % capacity > 0) | (F.col("n_words") == 0))
    rest = rest.withColumns(
        {"size": size, "shard": F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n_shards)).cast("int")}
    )
    packed = rest.groupBy("shard").applyInPandas(lambda rows: _pack_shard(rows, capacity), SCHEMA)
    whole = sizes.filter(F.col("n_words") >= capacity)
    pieces = F.sequence(F.lit(0), (F.col("n_words") / capacity).cast("int") - 1)
    full = whole.select("doc_id", "mark", F.explode(pieces).alias("piece")).select(
        "doc_id", "piece",
        (F.col("piece").cast("long") * capacity).alias("first_word"),
        F.lit(capacity).cast("long").alias("n_words"),
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mark", "piece").alias("bin_id"),
        F.lit(0).alias("bin_offset"),
    )
    return packed.unionByName(full)


def document_sizes(docs: DataFrame, cluster: Column) -> DataFrame:
    """What ``pack`` takes, from ``doc_id, text, source``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        n_words(F.col("text")).alias("n_words"),
        F.col("source").cast("string").alias("source"),
        cluster.alias("cluster"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
    )
