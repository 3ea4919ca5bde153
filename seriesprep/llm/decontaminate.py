r"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` writes a posting list for every term of every document. The index is cut into
blocks of about ``BLOCK_WORDS`` words of whole documents; a block numbers its words through, with
a gap between documents that no phrase can cross, so one list of positions serves for document
and place. Blocks are equal in size whatever the texts are, so no term or passage is a hot key.

``phrase_matches`` reads only the lists of benchmark terms, brings those of one block together,
and intersects offset-adjusted lists of each phrase, rarest term first. ``proximity_matches``
returns where all terms of a phrase lie within a reach of its rarest term.

The benchmark is taken in parts of ``PART_WORDS`` words, so what is sent to all executors is
bounded; every part runs against the whole index and the hits of all parts are joined by document.

Defined results: null or empty texts have no words and no hits; an item without words has no
window; items with equal text are each reported; repeated documents are reported each; an item
with null id hits words but is not listed. Empty tables give no rows, or rows without hits.
Terms are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesprep.llm.shared import checked_broadcast, fresh, job_path, stored
from seriesprep.llm.wordhash import PLAIN, word_hashes

WINDOW = 10
GAP = 64
BLOCK_WORDS = 1_000_000
PART_WORDS = 1_000_000

INDEX_SCHEMA = "block long, term long, postings binary, doc_id long, mark long, base int, n_words int"
HIT_SCHEMA = "block long, base int, doc_id long, mark long, n_words long, items array<long>, starts array<int>, ends array<int>"


class _Block:
    """Documents and words of one block until it is full."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.docs: list[tuple[np.ndarray, ...]] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, marks: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        bases = self.size + np.cumsum(counts + GAP) - counts - GAP
        places = np.arange(len(hashes)) + np.repeat(bases - (np.cumsum(counts) - counts), counts)
        self.docs.append((ids, marks, bases, counts))
        self.words.append((hashes, places))
        self.size = int(bases[-1] + counts[-1] + GAP)

    def rows(self) -> Iterator[pa.RecordBatch]:
        schema = _arrow_index()
        for ids, marks, bases, counts in self.docs:
            n = len(bases)
            nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            numbers = [pa.array(bases.astype(np.int32)), pa.array(counts.astype(np.int32))]
            block = pa.array(np.full(n, self.number, np.int64))
            yield pa.RecordBatch.from_arrays([block, *nothing, ids, pa.array(marks), *numbers], schema=schema)
        hashes = np.concatenate([h for h, _ in self.words])
        places = np.concatenate([p for _, p in self.words])
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")  # places stay ascending within a term
        hashes, places = hashes[order].view(np.int64), places[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        steps = np.diff(places, prepend=np.int32(0)).astype("<i4")
        steps[first] = places[first]
        n = len(first)
        offsets = np.append(first, len(steps)).astype(np.int32) * 4
        lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(steps.tobytes())])
        terms, block = pa.array(hashes[first]), pa.array(np.full(n, self.number, np.int64))
        rest = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())]
        whole = pa.RecordBatch.from_arrays([block, terms, lists, *rest], schema=schema)
        for at in range(0, n, 20_000):
            yield whole.slice(at, 20_000)


def _arrow_index() -> pa.Schema:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ("block", "term", "postings", "doc_id", "mark", "base", "n_words")
    return pa.schema(list(zip(names, kinds)))


def _index_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    block = _Block(number)
    for batch in batches:
        marks = batch.column("mark").to_numpy(zero_copy_only=False)
        for row, end, hashes, counts in word_hashes(batch.column("text"), PLAIN):
            block.add(batch.column("doc_id").slice(row, end - row), marks[row:end], hashes, counts)
            if block.size >= BLOCK_WORDS:
                yield from block.rows()
                number += 1
                block = _Block(number)
    if block.docs:
        yield from block.rows()


def build_index(docs: DataFrame) -> DataFrame:
    """Positional index of ``doc_id, text`` in the shared folder, one pass without shuffle.

    A null ``term`` marks the row of a document. ``mark`` is a hash of the text, which with the
    id names a row among rows that share an id."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_mark(F.col("text")).alias("mark"), "text")
    path = job_path(docs.sparkSession, "index")
    narrow.mapInArrow(_index_partition, INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def row_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Phrases:
    """Windows of one part of the benchmark: each is a row of term numbers, padded with -1."""

    terms: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[list[int]]


def make_phrases(items: list[tuple[int | None, np.ndarray]], window: int) -> Phrases:
    """Distinct windows of ``window`` words (or all words of a shorter item) with their items."""
    terms = np.unique(np.concatenate([w for _, w in items] or [np.zeros(0, np.int64)]))
    found: dict[bytes, tuple[np.ndarray, set]] = {}
    for item, words in items:
        numbers = np.searchsorted(terms, words).astype(np.int64)
        n = min(window, len(numbers))
        for at in range(len(numbers) - n + 1 if n else 0):
            piece = numbers[at : at + n]
            found.setdefault(piece.tobytes(), (piece, set()))[1].add(item)
    windows = np.full((len(found), window), -1, np.int64)
    for k, (piece, _) in enumerate(found.values()):
        windows[k, : len(piece)] = piece
    owners = [sorted(i for i in owner if i is not None) for _, owner in found.values()]
    return Phrases(terms, windows, (windows >= 0).sum(axis=1), owners)


def _lists(rows: pa.Table, terms: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Occurrences per term number, and the positions of those that occur."""
    counts, lists = np.zeros(len(terms), np.int64), {}
    numbers = np.searchsorted(terms, rows.column("term").to_numpy())
    for number, packed in zip(numbers.tolist(), rows.column("postings").to_pylist()):
        lists[number] = np.cumsum(np.frombuffer(packed, "<i4"), dtype=np.int64)
        counts[number] = len(lists[number])
    return counts, lists


def _occurs(positions: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(positions):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(positions, wanted)
    return (at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] == wanted)


def intersect(phrase: np.ndarray, counts: np.ndarray, lists: dict[int, np.ndarray]) -> np.ndarray:
    """Start positions of a phrase: lists shifted by each term's offset, rarest first."""
    order = np.argsort(counts[phrase], kind="stable")
    starts = lists[phrase[order[0]]] - order[0]
    for offset in order[1:]:
        starts = starts[_occurs(lists[phrase[offset]], starts + offset)]
        if not len(starts):
            break
    return starts


def nearby(phrase: np.ndarray, counts: np.ndarray, lists: dict[int, np.ndarray], reach: int) -> np.ndarray:
    """Positions of a phrase's rarest term with every other term within ``reach`` words."""
    terms = sorted(set(phrase.tolist()), key=lambda t: counts[t])
    places = lists[terms[0]]
    for term in terms[1:]:
        at = np.searchsorted(lists[term], places - reach)
        close = at < len(lists[term])
        places = places[close & (lists[term][np.minimum(at, len(lists[term]) - 1)] <= places + reach)]
        if not len(places):
            break
    return places


def _paired(windows: np.ndarray, n_terms: int, lists: dict[int, np.ndarray]) -> np.ndarray:
    """Windows of which every two neighbouring terms stand side by side somewhere in the block.

    A window that occurs is always among them; the padding counts as side by side.
    """
    if not lists:
        return np.zeros(len(windows), bool)
    places = np.concatenate(list(lists.values()))
    terms = np.repeat(np.fromiter(lists, np.int64, len(lists)), [len(p) for p in lists.values()])
    order = np.argsort(places, kind="stable")
    places, terms = places[order], terms[order]
    beside = places[1:] == places[:-1] + 1
    pairs = np.unique((terms[:-1] * n_terms + terms[1:])[beside])
    kept = np.ones(len(windows), bool)
    for k in range(windows.shape[1] - 1):
        rows = np.flatnonzero(kept)
        left, right = windows[rows, k], windows[rows, k + 1]
        kept[rows] = (right < 0) | _occurs(pairs, left * n_terms + right)
    return kept


def _match_block(table: pa.Table, phrases: Phrases, reach: int | None) -> pa.Table:
    import pyarrow.compute as pc

    is_doc = pc.is_null(table.column("term"))
    docs = table.filter(is_doc).sort_by("base")
    counts, lists = _lists(table.filter(pc.invert(is_doc)), phrases.terms)
    base = docs.column("base").to_numpy()
    n_words = docs.column("n_words").to_numpy().astype(np.int64)
    items: list[set[int]] = [set() for _ in base]
    there = (np.append(counts, 1)[phrases.windows] > 0).all(axis=1)  # the padding is there
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    there &= phrases.lengths > 0
    if reach is None:
        there[there] = _paired(phrases.windows[there], len(phrases.terms), lists)
    for k in np.flatnonzero(there):
        phrase = phrases.windows[k, : phrases.lengths[k]]
        if reach is None:
            starts = intersect(phrase, counts, lists)
            ends = starts + len(phrase)
        else:
            starts = nearby(phrase, counts, lists, reach)
            ends = starts + 1
        if len(starts):
            spans.append((starts, ends))
            for d in np.unique(np.searchsorted(base, starts, "right") - 1).tolist():
                items[d].update(phrases.owners[k])
    first = [[] for _ in base]
    last = [[] for _ in base]
    if spans:
        starts = np.concatenate([s for s, _ in spans])
        ends = np.concatenate([e for _, e in spans])
        order = np.argsort(starts, kind="stable")
        starts, reached = starts[order], np.maximum.accumulate(ends[order])
        opens = np.flatnonzero(np.concatenate([[True], starts[1:] > reached[:-1]]))
        closes = np.append(opens[1:] - 1, len(starts) - 1)
        for d, s, e in zip(
            (np.searchsorted(base, starts[opens], "right") - 1).tolist(), starts[opens].tolist(), reached[closes].tolist()
        ):
            first[d].append(s - int(base[d]))
            last[d].append(e - int(base[d]))
    ints = pa.list_(pa.int32())
    return pa.table(
        {
            "block": docs.column("block"),
            "base": docs.column("base"),
            "doc_id": docs.column("doc_id"),
            "mark": docs.column("mark"),
            "n_words": pa.array(n_words),
            "items": pa.array([sorted(i) for i in items], pa.list_(pa.int64())),
            "starts": pa.array(first, ints),
            "ends": pa.array(last, ints),
        }
    )


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, hashes, counts in word_hashes(batch.column("text"), PLAIN):
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
            ids = batch.column("item_id").slice(row, end - row)
            yield pa.RecordBatch.from_arrays([ids, words], names=["item_id", "words"])


def benchmark_parts(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    """The benchmark's phrases in parts of about ``PART_WORDS`` words; at least one part."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_words, "item_id long, words array<long>"
    )
    total = words.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    n_parts = -(-total // PART_WORDS) or 1
    part = F.pmod(F.xxhash64("item_id", "words"), F.lit(n_parts))
    for k in range(n_parts):
        rows = words.filter(part == k).collect()
        yield make_phrases([(r.item_id, np.array(r.words, np.int64)) for r in rows], window)


def _matches(index: DataFrame, phrases: Phrases, reach: int | None) -> DataFrame:
    spark: SparkSession = index.sparkSession
    sent = spark.sparkContext.broadcast(phrases)
    terms = F.broadcast(spark.createDataFrame([(int(t),) for t in phrases.terms], "term long"))
    docs = index.filter(F.col("term").isNull())
    wanted = docs.unionByName(index.join(terms, "term", "left_semi").select(*index.columns))
    return wanted.groupBy("block").applyInArrow(lambda t: _match_block(t, sent.value, reach), HIT_SCHEMA)


def _of_all_parts(index: DataFrame, benchmark: DataFrame, window: int, reach: int | None) -> DataFrame:
    found = [_matches(index, p, reach) for p in benchmark_parts(benchmark, window)]
    if len(found) == 1:
        return found[0]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    lists = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  one entry per part and document
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    joined = rows.groupBy("block", "base").agg(
        F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(lists("items"))).alias("items"),
        lists("starts").alias("starts"), lists("ends").alias("ends"),
    ).withColumn("spans", spans)
    # A span is cut at the furthest end before it, so no word counts twice.
    until = lambda k: F.aggregate(F.slice("spans", 1, k), F.lit(0), lambda a, s: F.greatest(a, s["ends"]))
    cut = F.transform("spans", lambda s, k: F.struct(F.greatest(s["starts"], until(k)).alias("s"), s["ends"].alias("e")))
    cut = F.filter(cut, lambda s: s["s"] < s["e"])
    return joined.withColumn("cut", cut).select(
        "block", "base", "doc_id", "mark", "n_words", "items",
        F.transform("cut", lambda s: s["s"]).alias("starts"), F.transform("cut", lambda s: s["e"]).alias("ends"),
    )


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of the index: ``items`` with an occurring window, and the hit words as
    disjoint spans ``starts``, ``ends`` (words from 0, end exclusive)."""
    if not 0 < window <= GAP:
        raise ValueError(f"window must be 1 to {GAP}")
    return _of_all_parts(index, benchmark, window, None)


def proximity_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, reach: int = 20) -> DataFrame:
    """As ``phrase_matches``, where a window counts if all its terms, in any order, lie within
    ``reach`` words of its rarest term in the block; the spans mark those terms."""
    if not 0 < reach < GAP:
        raise ValueError(f"reach must be below {GAP}")
    return _of_all_parts(index, benchmark, window, reach)


def n_hit() -> Column:
    both = F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long"))
    return F.aggregate(both, F.lit(0).cast("long"), lambda a, b: a + b)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without any hit word."""
    hits = phrase_matches(build_index(docs), benchmark, window).filter(F.size("starts") > 0)
    bad_id, bad_mark, mark = (fresh(docs, n) for n in ("_bad_id", "_bad_mark", "_mark"))
    bad = checked_broadcast(
        stored(hits.select(F.col("doc_id").alias(bad_id), F.col("mark").alias(bad_mark)).distinct(), "hits"), 1_000_000
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.col(mark) == F.col(bad_mark))
    marked = docs.withColumn(mark, row_mark(F.col("text")))
    return marked.join(bad, same, "left_anti").drop(mark)
