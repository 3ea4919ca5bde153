"""Collocations of two to five words by counting in buckets (PCY), each language on its own.

Words are numbered once per *block*: one task's words of one language, at most ``BLOCK_WORDS``
and one text more. Then, for phrases of one word, of two, and so on:

1. Every block counts its phrases in buckets of their hashes, as many as the corpus has words for.
   Longer phrases are looked for only where both shorter ones are candidates. A block tells its
   buckets as packed arrays, one for each range of buckets: a byte or two a bucket, so what is
   shuffled grows with the words and not with the number of blocks.
2. The arrays of a range are summed over all blocks. A phrase is a candidate if its bucket reaches
   the support, which the bucket of every frequent phrase does.
3. A last pass counts every candidate in every block, tells phrases and counts packed by ranges
   in the same way, and sums by language and phrase.

Candidates travel as bitmaps of bounded size. Buckets and hashes can only let too much
through: step 3 sums by the words themselves, so its counts are exact, and phrases below the
support fall out there.

Text is lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at
spaces and tabs. A null language is ``und``.

Defined results: null and empty texts have no words; repeated rows count each; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesprep.llm.shared import checked_broadcast, stored
from seriesprep.llm.wordhash import mix

MOST_WORDS = 5
SUPPORT = 100
ABSORBED_PERCENT = 100
TOP = 2_000
BLOCK_WORDS = 6_000_000
UNKNOWN_LANGUAGE = "und"
#: Buckets: ``BUCKETS_PER_PHRASE`` for every phrase that the words can make frequent, as a power of two.
BUCKETS_PER_PHRASE, LEAST_BITS, MOST_BITS = 16, 15, 27
#: Ranges of buckets: at least 32, and of at most 2**19 buckets.
LEAST_RANGE_BITS, BITS_IN_A_RANGE = 5, 19
MOST_LANGUAGES = 100_000
TOP_SALTS = 32

#: Bytes of UTF-8 never hold it, so it can stand for the end of a piece.
BREAK = b"\xff"
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + ENDS, bytes(range(97, 123)) + b" " + BREAK * len(ENDS)
)
BLOCK_SCHEMA = "lang string, n_words long, codes binary, vocabulary binary"
ROWS_AT_ONCE = 65_536


class _Block:
    """Words of one language as numbers; 0 ends a piece."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[BREAK]
        self.codes = array("i")
        self.n_words = 0

    def add(self, text: bytes) -> None:
        tokens = text.translate(_TABLE).replace(BREAK, b" \xff ").split()
        tokens.append(BREAK)
        self.codes.extend(map(self.numbers.__getitem__, tokens))
        self.n_words += len(tokens) - tokens.count(BREAK)

    def row(self, lang: str) -> pa.RecordBatch:
        """The block as a row, packed, so that a block is a few MB wherever Spark holds it."""
        packed = (zstandard.compress(b, 1) for b in (self.codes.tobytes(), b"\n".join(self.numbers)))
        columns = [pa.array([lang]), pa.array([self.n_words], pa.int64()), *(pa.array([b], pa.binary()) for b in packed)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "n_words", "codes", "vocabulary"])


def _number(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's texts, words parted by line ends, which no word holds. All open blocks together hold at most ``block_words``, so a task
    with thousands of languages needs no more memory than one with a few."""
    blocks: defaultdict[str, _Block] = defaultdict(_Block)
    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for at in range(0, len(texts), 256):
            for lang, text in zip(batch.column("lang").slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist()):
                block = blocks[lang]
                before = block.n_words
                block.add(text)
                held += block.n_words - before
                if held >= block_words:
                    largest = max(blocks, key=lambda name: blocks[name].n_words)
                    held -= blocks[largest].n_words
                    yield blocks.pop(largest).row(largest)
    for lang, block in blocks.items():
        if block.n_words:
            yield block.row(lang)


def word_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``lang, n_words, codes, vocabulary``: the words of ``text, lang`` in blocks, written once."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang")
    told = docs.select(lang, "text").filter(F.length("text") > 0)
    return stored(told.mapInArrow(lambda b: _number(b, block_words), BLOCK_SCHEMA), "blocks")


#: Which of some phrases, by hash, are wanted.
Keep = Callable[[np.ndarray], np.ndarray]


def phrases_of(codes: np.ndarray, words: np.ndarray, keep: Callable[[int], Keep | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, places, hashes`` of the phrases that ``keep(length)`` wants, by rising length, as
    long as it is not None.

    A longer phrase is offered only where the one without its last and the one without its first
    word were kept.
    """
    wanted_words = keep(1)(words)
    wanted_words[0] = False  # the end of a piece
    places = np.flatnonzero(wanted_words[codes]).astype(np.int32)
    hashes = words[codes[places]]
    for length in range(1, MOST_WORDS + 1):
        if length > 1:
            wants = keep(length)
            if wants is None:
                return
            wanted = wants(hashes)
            places, hashes = places[wanted], hashes[wanted]
        if not len(places):
            return
        yield length, places, hashes
        kept = np.zeros(len(codes) + 1, bool)
        kept[places] = True
        on = kept[places + 1]
        places, hashes = places[on], hashes[on]
        with np.errstate(over="ignore"):
            hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[codes[places + length]])


@dataclass(frozen=True)
class Candidates:
    """Bits of phrase hashes, told by the first ``bits`` bits of a hash."""

    bitmap: np.ndarray
    bits: int

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _opened(batch: pa.RecordBatch, row: int) -> tuple[str, np.ndarray, list[bytes], np.ndarray]:
    """Language, codes, words and their hashes (each language has its own) of a block."""
    lang = batch.column("lang")[row].as_py()
    codes, vocabulary = (zstandard.decompress(batch.column(c)[row].as_buffer()) for c in ("codes", "vocabulary"))
    words, seed = vocabulary.split(b"\n"), xxhash.xxh3_64_intdigest(lang.encode())
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return lang, np.frombuffer(codes, np.int32), words, hashes


def _told(lang: str, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows of one language in batches of bounded size."""
    names = ["lang", *columns]
    for at in range(0, len(next(iter(columns.values()))), ROWS_AT_ONCE):
        parts = [c.slice(at, ROWS_AT_ONCE) for c in columns.values()]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts[0])), *parts], names=names)


@dataclass(frozen=True)
class Buckets:
    """``2**bits`` buckets of hashes in ``ranges`` ranges of ``2**range_bits`` each."""

    bits: int
    range_bits: int
    support: int

    @property
    def ranges(self) -> int:
        return 1 << (self.bits - self.range_bits)

    @staticmethod
    def for_words(n_words: int, support: int) -> Buckets:
        wanted = (BUCKETS_PER_PHRASE * n_words // support).bit_length()
        bits = min(MOST_BITS, max(LEAST_BITS, wanted))
        return Buckets(bits, min(bits - LEAST_RANGE_BITS, BITS_IN_A_RANGE), support)


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers, the first bytes of all before the second ones, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _bucket_counts(batches: Iterator[pa.RecordBatch], known: dict[int, Candidates], length: int, plan: Buckets) -> Iterator[pa.RecordBatch]:
    """How often phrases of ``length`` words fall in each bucket, for every block and range of
    buckets: the gaps between the buckets, and the times up to the support."""
    for batch in batches:
        for row in range(batch.num_rows):
            _, codes, _, words = _opened(batch, row)
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def tell(hashes: np.ndarray) -> np.ndarray:
                at = (hashes >> np.uint64(64 - plan.bits)).astype(np.uint32)
                if length > 1:
                    found.append(np.unique(at, return_counts=True))
                elif len(at) > 1:
                    times, order = np.bincount(codes, minlength=len(at)), 1 + np.argsort(at[1:])
                    buckets, first = np.unique(at[order], return_index=True)
                    found.append((buckets, np.add.reduceat(times[order], first)))
                return np.zeros(len(hashes), bool)

            for _ in phrases_of(codes, words, lambda n: tell if n == length else known.get(n)):
                pass
            for buckets, times in found:
                cuts = np.searchsorted(buckets, np.arange(plan.ranges + 1, dtype=np.uint64) << np.uint64(plan.range_bits))
                full = np.flatnonzero(np.diff(cuts)).tolist()
                times = np.minimum(times, plan.support)
                gaps = [_packed(np.diff(buckets[cuts[k] : cuts[k + 1]], prepend=np.uint32(k << plan.range_bits))) for k in full]
                told = [_packed(times[cuts[k] : cuts[k + 1]]) for k in full]
                arrays = [pa.array(full, pa.int32()), pa.array(gaps, pa.binary()), pa.array(told, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "gaps", "times"])


def candidates(counted: DataFrame, plan: Buckets) -> Candidates:
    """The buckets of ``part, gaps, times`` that reach the support over all blocks."""

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = 0, np.zeros(1 << plan.range_bits, np.int64)
        for batch in rows:
            for part, gaps, times in zip(*(batch.column(c).to_pylist() for c in ("part", "gaps", "times"))):
                total[np.cumsum(_unpacked(gaps))] += _unpacked(times)
        bits = np.packbits(total >= plan.support, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], names=["part", "bits"])

    told = counted.groupBy("part").applyInArrow(summed, "part int, bits binary").toArrow()
    bitmap = np.zeros((plan.ranges, 1 << (plan.range_bits - 3)), np.uint8)
    for part, bits in zip(told.column("part").to_pylist(), told.column("bits").to_pylist()):
        bitmap[part] = np.frombuffer(bits, np.uint8)
    return Candidates(bitmap.reshape(-1).view("<u8"), plan.bits)


def _groups(codes: np.ndarray, places: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of the phrases that are equal word by word."""
    if length == 1:
        times = np.bincount(codes[places])
        first = np.empty(len(times), places.dtype)
        first[codes[places]] = places
        return first[times > 0], times[times > 0]
    _, first, group, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    same = places[first][group]
    if all(np.array_equal(codes[places + j], codes[same + j]) for j in range(length)):
        return places[first], counts
    spelt = np.stack([codes[places + j] for j in range(length)], axis=1)
    _, first, counts = np.unique(spelt, axis=0, return_index=True, return_counts=True)
    return places[first], counts


def _count(batches: Iterator[pa.RecordBatch], known: dict[int, Candidates], plan: Buckets) -> Iterator[pa.RecordBatch]:
    """How often each candidate occurs in each block, those of a length and range of hashes packed
    in a row: parted by line ends, which no word holds."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, codes, vocabulary, words = _opened(batch, row)
            vocabulary = pa.array(vocabulary, pa.binary())
            for length, places, hashes in phrases_of(codes, words, known.get):
                first, counts = _groups(codes, places, hashes, length)
                part = (hashes[np.searchsorted(places, first)] >> np.uint64(64 - plan.bits + plan.range_bits)).astype(np.int32)
                order = np.lexsort((codes[first], part))  # the same words together pack well
                first, counts, part = first[order], counts[order], part[order]
                spelt = [vocabulary.take(pa.array(codes[first + j])) for j in range(length)]
                phrases = (pc.binary_join_element_wise(*spelt, b" ") if length > 1 else spelt[0]).to_pylist()
                parts, starts = np.unique(part, return_index=True)
                cuts = [*starts.tolist(), len(first)]
                packed = [zstandard.compress(b"\n".join(phrases[i:j]), 1) for i, j in zip(cuts, cuts[1:])]
                times = [_packed(counts[i:j]) for i, j in zip(cuts, cuts[1:])]
                arrays = [pa.array([lang] * len(parts)), pa.array(parts), pa.array(packed, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "part", "phrases", "times"])


def _summed(rows: Iterator[pa.RecordBatch], support: int) -> Iterator[pa.RecordBatch]:
    """The phrases of one language and range that occur ``support`` times or more in all blocks."""
    lang, totals = "", defaultdict(int)
    for batch in rows:
        for lang, phrases, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrases", "times"))):
            for phrase, n in zip(zstandard.decompress(phrases).split(b"\n"), _unpacked(times).tolist()):
                totals[phrase] += n
    found = [(phrase, n) for phrase, n in totals.items() if n >= support]
    phrases = pa.array([phrase for phrase, _ in found], pa.binary()).cast(pa.string())
    lengths = pa.array([phrase.count(b" ") + 1 for phrase, _ in found], pa.int32())
    yield from _told(lang, {"phrase": phrases, "n_words": lengths, "a": pa.array([n for _, n in found], pa.int64())})


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, a`` of all phrases of one to five words that occur ``support``
    times or more in their language, with exact counts; and ``lang, n`` with all its words."""
    blocks = word_blocks(docs, block_words)
    sizes = stored(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "languages")
    packed = blocks.select("lang", "codes", "vocabulary")
    plan = Buckets.for_words(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], support)
    context, known = docs.sparkSession.sparkContext, {}
    for length in range(1, MOST_WORDS + 1):
        shared = context.broadcast(dict(known))
        told = packed.mapInArrow(lambda b: _bucket_counts(b, shared.value, length, plan), "part int, gaps binary, times binary")
        known[length] = candidates(told, plan)
    shared = context.broadcast(known)
    counted = packed.mapInArrow(lambda b: _count(b, shared.value, plan), "lang string, part int, phrases binary, times binary")

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(rows, support)

    frequent = counted.groupBy("lang", "part").applyInArrow(summed, "lang string, phrase string, n_words int, a long")
    return stored(frequent, "frequent"), sizes


def scored(frequent: DataFrame, sizes: DataFrame) -> DataFrame:
    """The phrases of two words or more with ``l``, ``r`` and ``score`` of their weakest cut."""
    words = F.split("phrase", " ")
    cuts = frequent.filter("n_words > 1").select(
        "lang", "phrase", "n_words", "a", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k")
    )
    cuts = cuts.select(
        "*",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("right"),
    )
    part = lambda side, name: frequent.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    sided = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    sided = sided.join(checked_broadcast(sizes, MOST_LANGUAGES), "lang")
    long = lambda name: F.col(name).cast("decimal(15,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * long("a") * long("n")).alias("above")
    exact = sided.select("*", above, (long("l") * long("r")).alias("below"))
    cut = F.struct(F.expr("above div below").alias("score"), "k", "l", "r")
    weakest = exact.groupBy("lang", "phrase").agg(
        F.max("n_words").alias("n_words"), F.max("a").alias("a"), F.max("n").alias("n"), F.min(cut).alias("cut")
    )
    return weakest.select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "n", "cut.score")


def unabsorbed(candidates: DataFrame, percent: int = ABSORBED_PERCENT) -> DataFrame:
    """Candidates but those inside a longer one that is (nearly) as frequent.

    Counts fall with length, so a longer one that absorbs has a part of one word more than the
    candidate that does so too: only those have to be looked at.
    """
    words = F.split("phrase", " ")
    parts = F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("n_words") - 1), " "),
        F.array_join(F.slice(words, F.lit(2), F.col("n_words") - 1), " "),
    )
    inside = candidates.filter("n_words > 2").select("lang", F.explode(parts).alias("phrase"), "a")
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    absorbed = F.coalesce(F.col("longer") * 100 >= F.col("a") * percent, F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~absorbed).drop("longer")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language. A large language is first cut down in salted parts."""
    order = "order by score desc, a desc, phrase"
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    for by in ("lang, salt", "lang"):
        salted = salted.withColumn("rank", F.expr(f"row_number() over (partition by {by} {order})")).filter(F.col("rank") <= top)
    return salted.withColumn("rank", F.col("rank").cast("long")).drop("salt")


def collocations(
    docs: DataFrame, support: int = SUPPORT, percent: int = ABSORBED_PERCENT, top: int = TOP, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest phrases of every language."""
    frequent, sizes = frequent_phrases(docs, support, block_words)
    best = ranked(unabsorbed(scored(frequent, sizes), percent), top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
