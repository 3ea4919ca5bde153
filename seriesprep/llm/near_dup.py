r"""Near-duplicate detection with HyperMinHash sketches.

A document is its set of distinct shingles of some words (two in op6, five in the pipeline's stage). Its sketch has 128 buckets; a bucket hashes the
whole set with a function of its own and keeps of the least 32-bit value only the number of
leading zeros and the 10 bits after the first one, 16 bits in all. (One function dealt over the
buckets would leave most of a short text's buckets empty.) Four registers make a band, 32 bands a
sketch: documents with similarity 0.8 agree in no band with a chance of 5e-8.

1. Documents with the same set are one class; its members are never paired.
2. Per band bucket every class is paired with one hub, not with every other class. Pairs whose
   estimate, corrected for the chance that unequal minima share a register, is far below the
   limit are dropped; the others are confirmed on the full sets.
3. Confirmed links make components. Where a bucket still holds several components, links between
   non-hub members may be missing; those members go through a prefix join: two sets that are
   similar enough share one of their rarest shingles. Pairs inside a component are never made,
   and a sample of the pairs comes first, which joins most components before the rest is looked
   at. The last pass takes every pair that is left, so no link between components is missed.

Defined results: null or empty texts and texts without words have an empty set, link to nothing
and are kept; a text of fewer words than a shingle is one shingle. Rows with the same id and text get the same answer.
Rows with null id take part, but never name a component unless all its ids are null.
Shingles are compared by 64-bit hash. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesprep.llm.shared import checked_broadcast, fresh, stored
from seriesprep.llm.wordhash import SPACED, mix, word_hashes

PERCENT = 80
#: Words of a shingle where no contract says otherwise, and in op6.
SHINGLE, PAIR = 5, 2
N_BANDS, BAND_ROWS, MANTISSA_BITS = 32, 4, 10
N_BUCKETS = N_BANDS * BAND_ROWS
#: Sets below this size reach 80 percent only with an equal set.
LEAST_SET = 4
#: Estimates have a standard deviation of at most 0.045; four of them below the limit are dropped.
ESTIMATE_MARGIN = 0.2
#: Passes of the prefix join: one in 64 pairs, then one in 8, then all.
DRAWS = (64, 8, 1)

_rng = np.random.Generator(np.random.PCG64(20_240_131))
_XOR = _rng.integers(0, 2**32, N_BUCKETS, np.uint32)
_ODD = _rng.integers(0, 2**32, N_BUCKETS, np.uint32) | np.uint32(1)
_PAIR = np.uint64(0xA24BAED4963EE407)
_ALONE = np.uint64(0x9FB21C651E98DF25)

SKETCH_SCHEMA = "doc_id long, mark long, n int, sum long, xor long, bands array<long>"


def _chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    runs = hashes[: max(len(hashes) - width + 1, 0)]
    with np.errstate(over="ignore"):
        for k in range(1, width):
            runs = mix(runs * _PAIR + hashes[k : k + len(runs)])
    return runs


def shingle_sets(texts: pa.Array, width: int = PAIR) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row; the words of a text of fewer are one shingle."""
    for _, _, hashes, counts in word_hashes(texts, SPACED):
        runs = _chained(hashes, width)
        at = 0
        for n in counts.tolist():
            if 0 < n < width:
                with np.errstate(over="ignore"):
                    yield mix(_chained(hashes[at : at + n], n) * _ALONE)
            else:
                yield np.unique(runs[at : at + max(n - width + 1, 0)])
            at += n


def bucket_minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(N_BUCKETS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        values = (short[at : at + 2048, None] ^ _XOR) * _ODD
        np.minimum(low, values.min(axis=0), out=low)
    return low


def registers(minima: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 32-bit minima in 16 bits."""
    exponent = np.frexp(minima.astype(np.float64))[1]
    zeros = 32 - exponent
    shifted = (minima.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | (shifted >> np.uint64(32 - MANTISSA_BITS))).astype(
        np.uint16
    )


def _sketch(batches: Iterator[pa.RecordBatch], width: int = PAIR) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sums, xors, minima = [], [], [], []
        for s in shingle_sets(batch.column("text"), width):
            sizes.append(len(s))
            again = mix(s ^ _PAIR)
            sums.append(np.add.reduce(s) if len(s) else np.uint64(0))
            xors.append(np.bitwise_xor.reduce(again) if len(s) else np.uint64(0))
            minima.append(bucket_minima(s))
        n = len(sizes)
        bands = registers(np.array(minima, np.uint32).reshape(n, N_BUCKETS)).view(np.int64).reshape(-1)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * N_BANDS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("mark"),
                pa.array(np.array(sizes, np.int32)),
                pa.array(np.array(sums, np.uint64).view(np.int64)),
                pa.array(np.array(xors, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(bands)),
            ],
            names=["doc_id", "mark", "n", "sum", "xor", "bands"],
        )


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def sketches(docs: DataFrame, width: int = PAIR) -> DataFrame:
    """One sketch per row of ``doc_id, text``, in the shared folder."""
    sketched = _marked(docs).mapInArrow(lambda b: _sketch(b, width), SKETCH_SCHEMA)
    return stored(sketched.withColumn("node", F.xxhash64("sum", "xor", "n")), "sketches")


def set_classes(sketched: DataFrame) -> DataFrame:
    """``node, n, bands, lead``: one row per distinct non-empty set; ``lead`` names the row with
    the least id (nulls last)."""
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    grouped = sketched.filter("n > 0").groupBy("node", "n")
    return stored(grouped.agg(lead.alias("lead"), F.first("bands").alias("bands")), "classes")


def shared_buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``band, key, node`` and ``band, key, hub, size`` of buckets with several classes."""
    rows = classes.filter(F.col("n") >= LEAST_SET).select("node", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("size"))
    buckets = stored(buckets.filter("size > 1"), "buckets")
    return stored(rows.join(buckets, ["band", "key"]), "members"), buckets


def estimated(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose sizes allow the limit and whose corrected estimate is not far below
    it. Two unequal minima of sets of n and m share a register with a chance of about
    0.72 * 2^-10 * n*m/(n+m)^2."""
    one = lambda x: classes.select(
        F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"bands{x}")
    )
    joined = pairs.join(one("a"), "a").join(one("b"), "b")
    lanes = lambda x: sum(
        (F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) == 0).cast("int")
        for i in range(BAND_ROWS)
    )
    same = F.zip_with("bandsa", "bandsb", lambda x, y: lanes(x.bitwiseXOR(y)))
    share = F.aggregate(same, F.lit(0), lambda s, v: s + v) / F.lit(float(N_BUCKETS))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    chance = 0.7213 * 2.0**-MANTISSA_BITS * na * nb / F.pow(na + nb, 2)
    estimate = (share - chance) / (1 - chance)
    fits = (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (estimate >= PERCENT / 100 - ESTIMATE_MARGIN)
    return joined.filter(fits).select("a", "b")


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), width)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "shingles"])


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int = PAIR) -> DataFrame:
    """``node, shingles`` (sorted 64-bit hashes) of some classes, from the text of their lead row."""
    wanted = classes.join(nodes, "node").select("node", F.col("lead.doc_id").alias("id"), F.col("lead.mark").alias("m"))
    wanted = checked_broadcast(stored(wanted, "leads"), 1_000_000)
    rows = _marked(docs)
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["mark"] == wanted["m"]))
    sets = rows.select("node", "text").mapInArrow(lambda b: _set_rows(b, width), "node long, shingles binary")
    return stored(sets.dropDuplicates(["node"]), "sets")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("a", "b")], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the limit. A hub may stand in many pairs; the joins are
    plain, so the adaptive skew join splits it."""
    one = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    joined = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb")
    return stored(joined.mapInArrow(_confirm, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every linked node. Each round every vertex goes to its least neighbour
    and links are redrawn between the vertices that are left; ids are hashes, so the number of
    rounds grows with the logarithm of a component's width."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels, live = ends.withColumn("comp", F.col("node")), links
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "step")
        moved = labels.join(step, labels["comp"] == step["a"], "left")
        labels = stored(moved.select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        one = lambda x: step.select(F.col("a").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: E731,B023
        redrawn = live.join(one("a"), "a").join(one("b"), "b").filter("to_a <> to_b")
        live = stored(redrawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "live")
    return labels


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's hub, once over all buckets."""
    return (
        members.filter("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )


def open_nodes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, comp`` of members of buckets of three or more that hold several components."""
    placed = members.filter("size > 2").join(labels, "node", "left")
    placed = placed.select("band", "key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    return stored(placed.join(mixed, ["band", "key"], "left_semi").select("node", "comp").distinct(), "open")


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, packed in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
            s = np.frombuffer(packed, np.int64)
            fixed = [pa.array(np.full(len(s), v, np.int64)) for v in (node, len(s))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(s)], names=["node", "n", "shingle"])


def prefix_heads(sets: DataFrame) -> DataFrame:
    """``shingle, node, n, place``: the rarest shingles of every set that others have too.

    In any common order of shingles, two sets of similarity t share an element among the first
    ``n - ceil(t*n) + 1`` of each. With the rarest first, a passage that many texts share is not
    among them unless it is most of the text."""
    rows = stored(sets.mapInArrow(_explode_sets, "node long, n long, shingle long"), "shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))
    needed = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    # Shingles of one node alone come first in the order; they take places but make no pairs.
    shared = rows.join(counts, "shingle").withColumn("rank", rank)
    n_shared = F.count("*").over(Window.partitionBy("node"))
    heads = shared.withColumn("place", F.col("rank") + F.col("n") - n_shared).filter(F.col("place") <= needed)
    return stored(heads.select("shingle", "node", "n", "place"), "heads")


def prefix_pairs(heads: DataFrame, opened: DataFrame, before: int, now: int) -> DataFrame:
    """Pairs of ``opened`` nodes (``node, comp``) of different components that share a head and
    can still reach the limit: what lies behind the places of their first common shingle bounds
    what they share. Of all pairs those whose hash ``now`` divides and ``before`` does not."""
    placed = heads.join(opened, "node")
    one = lambda x: placed.select(
        "shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "n", "place")]
    )
    most = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    drawn = F.xxhash64("node_a", "node_b")
    fits = (
        (F.col("node_a") < F.col("node_b"))
        & (F.col("comp_a") != F.col("comp_b"))
        & (100 * most >= PERCENT * (F.col("n_a") + F.col("n_b") - most))
        & (F.pmod(drawn, F.lit(now)) == 0)
    )
    if before:
        fits &= F.pmod(drawn, F.lit(before)) != 0
    pairs = one("a").join(one("b"), "shingle").filter(fits)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = PAIR) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, kept`` of every row of ``doc_id, text``, by
    shingles of ``width`` words.

    ``mark`` is a hash of the text that tells rows with one id apart. ``component_id`` is the
    least id of the component, and the row's own id where the set is empty.
    """
    sketched = sketches(docs, width)
    classes = set_classes(sketched)
    members, _ = shared_buckets(classes)
    pairs = stored(estimated(classes, hub_pairs(members)), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    links = confirmed(pairs, full_sets(docs, classes, nodes, width))
    labels = components(links)
    opened = open_nodes(members, labels)
    if not opened.isEmpty():
        sets = full_sets(docs, classes, opened.select("node"), width)
        heads = prefix_heads(sets)
        for before, now in zip((0, *DRAWS), DRAWS):
            found = stored(estimated(classes, prefix_pairs(heads, opened, before, now)), "pairs")
            links = stored(links.union(confirmed(found, sets)), "links")
            labels = components(links)
            opened = open_nodes(members, labels)
    placed = classes.join(labels, "node", "left").select("node", "lead.doc_id", F.coalesce("comp", "node").alias("comp"))
    names = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    names = stored(placed.join(names, "comp").select("node", "component_id"), "names")
    rows = sketched.join(names, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates by shingles of ``width`` words, whole; rows that repeat the kept
    row's id and set are dropped too."""
    mark, drop_id, drop_mark = (fresh(docs, n) for n in ("_mark", "_drop_id", "_drop_mark"))
    found = near_duplicates(docs, width)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(drop_id), F.col("mark").alias(drop_mark))
    gone = checked_broadcast(stored(gone.distinct(), "dropped"), 1_000_000)
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(drop_id)) & (F.col(mark) == F.col(drop_mark))
    left = marked.join(gone, same, "left_anti")
    again = stored(left.groupBy("doc_id", mark).count().filter("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return left.drop(mark)
    twin = again.select(F.col("doc_id").alias(drop_id), F.col(mark).alias(drop_mark))
    single = left.join(twin, same, "left_anti")
    repeated = left.join(twin, same, "left_semi").dropDuplicates(["doc_id", mark])
    return single.unionByName(repeated).drop(mark)
