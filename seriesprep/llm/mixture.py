"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens, its documents end to end. In each round every queue's deficit
counter is given its quantum, the tokens of a window times the queue's share, and the queue serves
as many whole tokens as the counter holds, rounded to the nearest; what it is owed or has
overdrawn is carried to the next round. The rounds follow each other as one stream, queues in
fixed order inside a round, and the stream is cut into windows of ``length`` tokens. So every
window holds each source's share, up to the tokens by which rounds and windows are out of step
(half a token per queue).

The counters need not be run through: after ``r`` rounds a queue with the quantum ``q`` has served
``round(r * q)`` tokens. Every task therefore opens with the deficits that the partition
before it would hand over, and places its documents alone. Ids are made once and written in the
task that read the text, with their place among that task's ids of the source; places in the
whole queue follow from one row per task and source. Neither texts nor ids are shuffled.

Shares are those of the corpus, or given; then a queue may end before the others, which share the
rest of the rounds by their own weights. Each such stretch is a *phase*. The stream's last window
is cut into sequences whose lengths are powers of two, so that nothing is padded.

At most ``MOST_QUEUES`` sources have a queue of their own: the largest and all with given shares.
All others stand one behind the other in a last queue.

Defined results: a null or empty text is only the end id; null sources are one source; rows that
repeat are packed each; other columns are ignored. Documents keep the order in which Spark reads
them. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesprep.llm.shared import checked_broadcast, stored
from seriesprep.llm.token_files import END_ID, encoder

LENGTH = 1_024
MOST_QUEUES = 256
MOST_BROADCAST = 1_000_000
TEXTS_AT_ONCE = 256
CELLS_AT_ONCE = 1 << 20
SCAN_PARTS = 4_096
IDS_SCHEMA = "doc_id long, source string, part long, before long, n_tokens long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)


# --- ids ---------------------------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Ids of each text with the end id, and the task's ids of the same source before them."""
    coder, part = encoder(vocabulary), TaskContext.get().partitionId()
    end = np.array([END_ID], coder.kind).tobytes()
    before: defaultdict[str, int] = defaultdict(int)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            rows = batch.slice(at, TEXTS_AT_ONCE)
            ids = [coder.encode(t or "") + end for t in rows.column("text").to_pylist()]
            places, sizes = [], [len(i) // len(end) for i in ids]
            for source, size in zip(rows.column("source").to_pylist(), sizes):
                places.append(before[source])
                before[source] += size
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("source"), pa.array([part] * len(ids), pa.int64()),
                    pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "source", "part", "before", "n_tokens", "ids"],
            )


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of ``doc_id, source, text``, written once. ``source`` is prefixed, ``-`` for null and
    ``=`` for others, so that null is told from every name."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("source")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, "text")
    return stored(told.mapInArrow(lambda b: _encode(b, vocabulary), IDS_SCHEMA), "ids")


# --- queues ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phase:
    """A stretch of rounds in which the same queues are served.

    ``first[q]`` tokens of queue ``q`` and ``position`` tokens of the stream were served before it; it
    serves ``tokens[q]`` of each queue in rounds of ``length`` tokens.
    """

    first: np.ndarray
    tokens: np.ndarray
    position: int
    length: int

    @property
    def total(self) -> int:
        return int(self.tokens.sum())

    @property
    def rounds(self) -> int:
        return -(-self.total // self.length)

    @property
    def block(self) -> int:
        """Rounds counted from one exact starting point, so that products stay below 2**63."""
        return max(1, (1 << 61) // self.total)

    def _from(self, blocks: np.ndarray, queues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens served before each block of rounds (rows) of each queue (columns), and what the
        rounding carries into it: exact, whatever the number of rounds."""
        total, rest = self.total, [self.length * int(t) % self.total for t in self.tokens[queues]]
        pairs = [[divmod(2 * int(b) * self.block * r + total, 2 * total) for r in rest] for b in blocks]
        exact = np.array(pairs, np.int64).reshape(len(blocks), len(rest), 2)
        return exact[:, :, 0], exact[:, :, 1]

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of every queue (columns) served after each number of rounds (rows): the nearest
        integer to rounds times quantum, halves up, but never more than the queue has."""
        whole, rest = np.divmod(self.length * self.tokens, self.total)
        blocks, at = np.unique(rounds // self.block, return_inverse=True)
        served, carried = self._from(blocks, np.arange(len(rest)))
        if len(blocks) > 1:
            served, carried = served[at], carried[at]
        inside = 2 * (rounds % self.block)
        due = (carried + inside[:, None] * rest) // (2 * self.total) + rounds[:, None] * whole + served
        return np.minimum(due, self.tokens)

    def served_of(self, rounds: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """``served`` of one queue for each number of rounds."""
        whole, rest = np.divmod(self.length * self.tokens[queues], self.total)
        blocks, at = np.unique(rounds // self.block, return_inverse=True)
        some, queue = np.unique(queues, return_inverse=True)
        served, carried = (x[at, queue] for x in self._from(blocks, some))
        due = (carried + 2 * (rounds % self.block) * rest) // (2 * self.total) + rounds * whole + served
        return np.minimum(due, self.tokens[queues])

    def round_of(self, places: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """The round, from 1, that serves the token at each place (from 0) of its queue."""
        guess = np.ceil((places + 0.5) * (self.total / (self.length * self.tokens[queues]))).astype(np.int64)
        guess = np.clip(guess, 1, self.rounds)
        while True:  # doubles are off by a round at most
            late = self.served_of(guess - 1, queues) > places
            early = self.served_of(guess, queues) <= places
            if not (late.any() or early.any()):
                return guess
            guess += early.astype(np.int64) - late.astype(np.int64)


def phases(tokens: list[int], weights: list[Fraction], length: int) -> list[Phase]:
    """Phases until all queues are empty. Queues of weight 0 come when no others are left."""
    left, first, position, found = list(tokens), [0] * len(tokens), 0, []
    while any(left):
        active = [q for q, n in enumerate(left) if n and weights[q]] or [q for q, n in enumerate(left) if n]
        weight = {q: weights[q] or Fraction(1) for q in active}
        until = min(left[q] / weight[q] for q in active)  # in units in which a queue gets its weight
        take = [int(until * weight[q]) if q in weight else 0 for q in range(len(left))]
        found.append(Phase(np.array(first, np.int64), np.array(take, np.int64), position, length))
        first = [a + b for a, b in zip(first, take)]
        left = [a - b for a, b in zip(left, take)]
        position += sum(take)
    return found


def _queues(sums: DataFrame, shares: Mapping[str | None, float] | None, most: int) -> tuple[dict[str, int], list[int], list[Fraction]]:
    """Queue of each source that has its own, and tokens and weight of all queues. The last queue
    takes all other sources."""
    given = {"-" if s is None else f"={s}": Fraction(w) for s, w in (shares or {}).items()}
    if any(w < 0 for w in given.values()) or len(given) >= most:
        raise ValueError(f"shares must not be negative, nor more than {most - 1}")
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    is_given = F.col("source").isin(list(given)) if given else F.lit(False)
    own = by_source.orderBy(F.desc(is_given), F.desc("tokens"), "source").limit(most - 1).collect()
    total = by_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    tokens = [r["tokens"] for r in own]
    tokens.append(total - sum(tokens))
    # Of sources without a given share, the weights are their tokens, scaled to the share left over.
    rest = sum(n for r, n in zip(own, tokens) if r["source"] not in given) + tokens[-1]
    free = max(Fraction(0), 1 - sum(given.values())) if given else Fraction(1)
    weights = [given.get(r["source"], free * r["tokens"] / rest if rest else Fraction(0)) for r in own]
    weights.append(free * tokens[-1] / rest if rest else Fraction(0))
    return {r["source"]: q for q, r in enumerate(own)}, tokens, weights


def queue_offsets(sums: DataFrame, own: dict[str, int]) -> DataFrame:
    """``part, source, queue, ahead``: tokens of the queue before each task's of the source.

    Summed in blocks of tasks first, so that no group grows with the number of tasks."""
    spark = sums.sparkSession
    told = spark.createDataFrame(list(own.items()), "source string, queue int") if own else None
    queued = sums.join(F.broadcast(told), "source", "left") if told is not None else sums.withColumn("queue", F.lit(None).cast("int"))
    queued = queued.withColumns({"queue": F.coalesce("queue", F.lit(len(own))), "block": F.floor(F.col("part") / SCAN_PARTS)})
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    ahead = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0))
    blocks = queued.groupBy("queue", "block").agg(F.sum("tokens").alias("block_tokens"))
    blocks = blocks.withColumn("block_ahead", ahead("block_tokens", before("queue").orderBy("block")))
    parts = queued.groupBy("queue", "block", "part").agg(F.sum("tokens").alias("part_tokens"))
    parts = parts.withColumn("part_ahead", ahead("part_tokens", before("queue", "block").orderBy("part")))
    sources = queued.withColumn("source_ahead", ahead("tokens", before("queue", "block", "part").orderBy("source")))
    placed = sources.join(parts, ["queue", "block", "part"]).join(blocks, ["queue", "block"])
    total = F.col("source_ahead") + F.col("part_ahead") + F.col("block_ahead")
    return placed.select("part", "source", "queue", total.alias("ahead"))


# --- pieces ------------------------------------------------------------------------------------


def sequence_starts(total: int, length: int) -> np.ndarray:
    """Starts of the sequences of the last, incomplete window: powers of two, largest first."""
    rest = total % length
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return total - rest + np.cumsum([0, *sizes])[:-1].astype(np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each of ``counts`` copies of every row, and the copy's number from 0."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs_of(plan: list[Phase], queues: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """What stands together in the stream, of stretches of queues: ``row, place in the queue,
    tokens, position in the stream``."""
    found = []
    for phase in plan:
        low = np.maximum(places, phase.first[queues])
        high = np.minimum(places + sizes, phase.first[queues] + phase.tokens[queues])
        rows = np.flatnonzero(low < high)
        if not len(rows):
            continue
        queue = queues[rows]
        low, high = low[rows] - phase.first[queue], high[rows] - phase.first[queue]
        first, last = phase.round_of(low, queue), phase.round_of(high - 1, queue)
        of, step = _spread(last - first + 1)
        cells = max(1, CELLS_AT_ONCE // len(phase.tokens))
        for at in range(0, len(of), cells):
            some, turn = of[at : at + cells], step[at : at + cells]
            rounds, mine = first[some] + turn, queue[some]
            # Rounds of a stretch follow each other: the end of one is the start of the next.
            every, opens = np.arange(len(some)), np.append(True, some[1:] != some[:-1])
            until = phase.served(rounds)
            since = np.empty_like(until)
            since[1:] = until[:-1]
            since[opens] = phase.served(rounds[opens] - 1)
            own_since, own_until = since[every, mine], until[every, mine]
            ahead = np.where(np.arange(len(phase.tokens)) < mine[:, None], until, since).sum(axis=1) - own_since
            start = np.maximum(low[some], own_since)
            end = np.minimum(high[some], own_until)
            position = phase.position + ahead + start
            kept = end > start  # a round may serve a small queue nothing
            found.append(np.stack([rows[some], start + phase.first[mine], end - start, position], axis=1)[kept])
    joined = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return tuple(joined.T)


def _place(
    batches: Iterator[pa.RecordBatch], plan: list[Phase], total: int, length: int
) -> Iterator[pa.RecordBatch]:
    tail = sequence_starts(total, length)
    n_full = total // length

    def sequence(position: np.ndarray) -> np.ndarray:
        return np.where(position < n_full * length, position // length, n_full - 1 + np.searchsorted(tail, position, "right"))

    def begin(number: np.ndarray) -> np.ndarray:
        ends = np.append(tail, total)
        return np.where(number < n_full, number * length, ends[np.clip(number - n_full, 0, len(ends) - 1)])

    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
            batch = whole.slice(at, TEXTS_AT_ONCE)
            queues, sizes = (batch.column(c).to_numpy() for c in ("queue", "n_tokens"))
            places = batch.column("ahead").to_numpy() + batch.column("before").to_numpy()
            rows, place, size, position = runs_of(plan, queues, places, sizes)
            first, last = sequence(position), sequence(position + size - 1)
            of, step = _spread(last - first + 1)
            number = first[of] + step
            start = np.maximum(position[of], begin(number))
            size = np.minimum(position[of] + size[of], begin(number + 1)) - start
            rows, within = rows[of], place[of] + start - position[of] - places[rows[of]]
            if len(plan) > 1:
                order = np.lexsort((within, rows))
                rows, within, size, number, start = (x[order] for x in (rows, within, size, number, start))
            # A piece that goes on where the last one ends, in one sequence, is the same piece.
            goes_on = np.zeros(len(rows), bool)
            goes_on[1:] = (rows[1:] == rows[:-1]) & (number[1:] == number[:-1]) & (start[1:] == start[:-1] + size[:-1])
            heads = np.flatnonzero(~goes_on)
            size = np.add.reduceat(size, heads) if len(heads) else size
            rows, within, number, start = (x[heads] for x in (rows, within, number, start))
            ids = batch.column("ids").to_pylist()
            wide = [memoryview(np.frombuffer(i, f"<u{len(i) // n}").astype("<u4").tobytes()) for i, n in zip(ids, sizes.tolist())]
            ends = 4 * (within + size)
            sums = [zlib.crc32(wide[r][a:b]) for r, a, b in zip(rows.tolist(), (4 * within).tolist(), ends.tolist())]
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(taken), pa.array(within), pa.array(size), pa.array(sums, pa.int64()),
                    batch.column("n_tokens").take(taken), pa.array(number), pa.array(start - begin(number)),
                    batch.column("source").take(taken),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )


def pack_mixture(
    docs: DataFrame,
    vocabulary: str,
    length: int = LENGTH,
    shares: Mapping[str | None, float] | None = None,
    most_queues: int = MOST_QUEUES,
) -> DataFrame:
    """Pieces of ``doc_id, source, text``: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source``. Every id of every document is in exactly one piece.

    ``shares`` gives the target share of sources (None for the null source) in every window; what
    is left to 1 is dealt over the other sources by their size. Without it all sources have the
    share they have in the corpus."""
    ids = encoded(docs, vocabulary)
    sums = stored(ids.groupBy("part", "source").agg(F.sum("n_tokens").alias("tokens")), "sums")
    own, tokens, weights = _queues(sums, shares, most_queues)
    plan, total = phases(tokens, weights, length), sum(tokens)
    offsets = stored(queue_offsets(sums, own), "offsets")
    placed = ids.join(checked_broadcast(offsets, MOST_BROADCAST), ["part", "source"])
    name = F.expr("if(source = '-', null, substr(source, 2))").alias("source")
    placed = placed.select("doc_id", name, "queue", "ahead", "before", "n_tokens", "ids")
    return placed.mapInArrow(lambda b: _place(b, plan, total, length), PIECE_SCHEMA)
