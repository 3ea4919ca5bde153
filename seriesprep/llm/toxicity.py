r"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A sentence's probability is a logistic function of its words; a document is toxic if any sentence
is (leaky noisy-or: ``1 - (1 - leak) * product(1 - p)``), so document labels train sentence scores
and the sentences that carry a document's score can be pointed at. The leak is the share of
labels that no sentence explains; without it, long documents would pay for label noise.

Learning takes at most ``sample_rows`` labelled documents, chosen by hash of the id, and never a
held-out one. The features of the model are words, and stems of words, whose document counts
differ most between the two labels of the sample. Scoring is one narrow pass over all texts.

Defined results: null or empty texts have no sentence and score the leak; text without any word
of the model scores by its number of sentences alone. A null id is held out. Of several label rows of
a document the highest counts; null labels do not. Without a toxic or without a clean label the
score is 0 throughout. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesprep.llm.shared import stored
from seriesprep.llm.wordhash import PLAIN, hash_stems, mix, pieces

SAMPLE_ROWS = 20_000
MODEL_WORDS = 4_096
LEAST_DOCUMENTS = 5
PAIRS_AT_ONCE = 1_000_000
#: Log-likelihood ratio; chance alone reaches it once in some ten million words.
LEAST_SURPRISE = 30.0
SENTENCE_ENDS = np.isin(np.arange(256), list(b".!?\n"))
FOLDS = 5
#: Bytes of the stems of longer words.
STEMS = (4, 5, 6, 7, 8, 10)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted word hashes, their weights, and the logits of a sentence without any of them and of
    the leak."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``text, toxic`` of at most ``sample_rows`` labelled ids; the ids are broadcast."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and label, summed over each piece of a batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        for row, end, data, offsets in pieces(batch.column("text")):
            _, counts, hashes, number = hash_stems(data, offsets, PLAIN, STEMS)
            doc = np.repeat(np.arange(end - row), counts)[number]
            order = np.lexsort((doc, hashes))
            hashes, doc = hashes[order], doc[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            hashes, bad = hashes[new], toxic[row:end][doc[new]]
            words, first = np.unique(hashes, return_index=True)
            n_bad = np.add.reduceat(bad.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            n_all = np.diff(first, append=len(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(n_bad), pa.array(n_all)], names=["word", "bad", "total"]
            )


def _family_words(batch: pa.RecordBatch, words: np.ndarray) -> Iterator[np.ndarray]:
    """``word, family, bad`` (rows of an array) of every one of ``words`` a document has, once."""
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
    for row, end, data, offsets in pieces(batch.column("text")):
        _, counts, features, number = hash_stems(data, offsets, PLAIN, STEMS)
        hashes = features[: counts.sum()]
        doc_of = np.repeat(np.arange(end - row), counts)
        triples = hashes
        for step in (1, 2):
            behind = np.append(hashes[step:], np.zeros(step, np.uint64))[: len(hashes)]
            outside = np.append(doc_of[step:], np.full(step, -1))[: len(hashes)] != doc_of
            behind[outside] = 0
            triples = mix(triples) ^ behind
        triples = mix(triples)
        full = np.flatnonzero(counts)
        family = np.zeros(end - row, np.uint64)
        family[full] = np.minimum.reduceat(triples, (np.cumsum(counts) - counts)[full]) if len(full) else 0
        at = np.searchsorted(words, features)
        known = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == features)
        once = np.unique(np.stack([doc_of[number[known]], at[known]], axis=1), axis=0)
        yield np.stack([words[once[:, 1]], family[once[:, 0]], toxic[row:end][once[:, 0]].astype(np.uint64)])


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """``word, family, bad`` with each pair of word and family once; bad if any was."""
    word, family, bad = np.concatenate([np.zeros((3, 0), np.uint64), *parts], axis=1)
    order = np.lexsort((family, word))
    word, family, bad = word[order], family[order], bad[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (family[1:] != family[:-1])
    first = np.flatnonzero(new)
    bad = np.maximum.reduceat(bad, first) if len(first) else bad
    return np.stack([word[first], family[first], bad])


def _families(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each of ``words`` with the *families* whose documents have it: the least hash of a document's
    word triples, which copies of a text mostly share and other texts do not.

    A task tells a word and a family once, however many copies of a text it reads; it holds at most
    ``PAIRS_AT_ONCE`` pairs and those of one piece of a batch.
    """
    def told(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in rows], names=["word", "family", "bad"])

    parts, held = [], 0
    for batch in batches:
        for part in _family_words(batch, words):
            parts.append(part)
            held += part.shape[1]
            if held > PAIRS_AT_ONCE:
                merged = _merged(parts)
                parts, held = [merged], merged.shape[1]
                if held > PAIRS_AT_ONCE // 2:
                    yield told(merged)
                    parts, held = [], 0
    yield told(_merged(parts))


def _telling(counts: DataFrame, share: float, most: int) -> np.ndarray:
    """Sorted hashes of the words of ``word, bad, total`` that lie furthest from ``share``."""
    k, n = F.col("bad").cast("double"), F.col("total").cast("double")
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))
    surprise = 2 * (part(k, n * share) + part(n - k, n * (1 - share)))
    rows = (
        counts.filter(F.col("total") >= LEAST_DOCUMENTS)
        .withColumn("surprise", surprise)
        .filter(F.col("surprise") >= LEAST_SURPRISE)
        .orderBy(F.desc("surprise"), "word")
        .limit(most)
        .select("word")
        .collect()
    )
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def telling_words(sample: DataFrame, most: int = MODEL_WORDS) -> np.ndarray:
    """Sorted hashes of the words whose share of documents differs most between the labels, and
    still differs when copies count once: they repeat the label of one text."""
    totals = sample.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("bad")).first()
    if not totals.bad or totals.bad == totals.n:
        return np.zeros(0, np.uint64)
    share = totals.bad / totals.n
    counts = sample.mapInArrow(_word_counts, "word long, bad long, total long").groupBy("word")
    words = _telling(counts.agg(F.sum("bad").alias("bad"), F.sum("total").alias("total")), share, most)
    if not len(words):
        return words
    places = sample.mapInArrow(lambda b: _families(b, words), "word long, family long, bad long")
    once = places.groupBy("word", "family").agg(F.max("bad").alias("bad"))
    return _telling(once.groupBy("word").agg(F.sum("bad").alias("bad"), F.count("*").alias("total")), share, most)


def _sentences(data: np.ndarray, offsets: np.ndarray, words: np.ndarray):
    """Model words in a piece: number and sentence of each, document of every sentence with a
    word, and the start byte of such sentences' first words."""
    starts, counts, features, number = hash_stems(data, offsets, PLAIN, STEMS)
    breaks = np.cumsum(SENTENCE_ENDS[data]) if len(data) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    key = breaks[starts] + doc if len(starts) else np.zeros(0, np.int64)  # rises with either
    new = np.ones(len(key), bool)
    new[1:] = np.diff(key) > 0
    sentence = np.cumsum(new) - 1
    at = np.minimum(np.searchsorted(words, features), max(len(words) - 1, 0))
    known = np.flatnonzero(words[at] == features) if len(words) else np.zeros(0, np.int64)
    known = known[np.argsort(number[known], kind="stable")]
    return at[known], sentence[number[known]], doc[new], starts[new]


def _bags(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document: sentences without model words, and the words of each other sentence."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        for row, end, data, offsets in pieces(batch.column("text")):
            word, sentence, doc, _ = _sentences(data, offsets, words)
            used, inner = np.unique(sentence, return_inverse=True)
            n_all = np.bincount(doc, minlength=end - row)
            n_used = np.bincount(doc[used], minlength=end - row)
            per = np.bincount(doc[sentence], minlength=end - row)
            local = inner - np.repeat(np.cumsum(n_used) - n_used, per)
            bounds = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(toxic[row:end].astype(np.int32)),
                    pa.array((n_all - n_used).astype(np.int32)),
                    pa.ListArray.from_arrays(bounds, pa.array(local.astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(word.astype(np.int32))),
                ],
                names=["toxic", "n_other", "sentence", "word"],
            )


def softplus(x):
    return np.logaddexp(0.0, x)


def fit(bags: list, n_words: int, rounds: int = 500, ridge: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the noisy-or likelihood of the labels (Adam, full batch)."""
    y = np.array([b.toxic for b in bags], float)
    other = np.array([b.n_other for b in bags], float)
    n_used = [max(b.sentence) + 1 if b.sentence else 0 for b in bags]
    shift = np.concatenate([[0], np.cumsum(n_used)])
    sentence = np.concatenate([np.asarray(b.sentence, np.int64) + s for b, s in zip(bags, shift)] or [np.zeros(0, np.int64)])
    word = np.concatenate([np.asarray(b.word, np.int64) for b in bags] or [np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(bags)), n_used)
    theta = np.zeros(n_words + 2)
    theta[-2:] = -8.0, -3.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, b, c = theta[:-2], theta[-2], theta[-1]
        z = b + np.bincount(sentence, w[word], len(doc))
        silence = np.bincount(doc, softplus(z), len(bags)) + other * softplus(b) + softplus(c)  # -log(1 - p)
        pull = np.where(y > 0, -1 / np.expm1(np.clip(silence, 1e-9, 700)), 1.0)
        slope = pull[doc] / (1 + np.exp(-z))
        grad = np.bincount(word, slope[sentence], n_words) / len(bags) + ridge * w
        base = (slope.sum() + (pull * other).sum() / (1 + np.exp(-b))) / len(bags)
        g = np.concatenate([grad, [base, pull.mean() / (1 + np.exp(-c))]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    sample = training_sample(docs, labels, sample_rows)
    words = telling_words(sample)
    if not len(words):
        return ToxicityModel(words, np.zeros(0), -np.inf, -np.inf)
    schema = "toxic int, n_other int, sentence array<int>, word array<int>"
    bags = sample.mapInArrow(lambda b: _bags(b, words), schema).collect()
    return ToxicityModel(words, *fit(bags, len(words)))


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            n = end - row
            word, sentence, doc, starts = _sentences(data, offsets, model.words)
            z = model.bias + np.bincount(sentence, model.weights[word], len(doc))
            silence = np.bincount(doc, softplus(z), n) + softplus(model.leak)
            bad = np.flatnonzero(z >= np.log(least / (1 - least))) if np.isfinite(model.bias) else np.zeros(0, int)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[bad], minlength=n))]).astype(np.int32)
            # Start of the sentence's first word in code points: bytes that begin a code point.
            begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            at = (begins[starts[bad]] - begins[offsets[doc[bad]]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, n),
                    batch.column("held_out").slice(row, n),
                    pa.array(-np.expm1(-silence)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(at)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(1 / (1 + np.exp(-z[bad])))),
                ],
                names=["doc_id", "held_out", "score", "starts", "scores"],
            )


def score(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score`` of every row, and where the sentences of at least ``least``
    begin (``starts``, code points of their first word) with their ``scores``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, score double, starts array<int>, scores array<double>"
    return narrow.mapInArrow(lambda b: _score(b, sent.value, least), schema)
