"""Phrases against counting with a dictionary, whatever the blocks."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seriesprep.llm import collocations as cl

ENDS = str.maketrans({c: "\n" for c in ".,;:!?\n\x0b\x0c\r"} | {chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, support, percent, top):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        for piece in (text or "").translate(ENDS).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            lang_ = "und" if lang is None else lang
            sizes[lang_] += len(words)
            for k in range(1, 6):
                counts.update((lang_, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < support:
            continue
        cuts = [(1000 * a * sizes[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang, words] = (a, counts[lang, words[:k]], counts[lang, words[k:]], sizes[lang], score)
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    kept = {
        (lang, p): v for (lang, p), v in found.items()
        if not any(l == lang and len(q) > len(p) and inside(p, q) and 100 * w[0] >= percent * v[0] for (l, q), w in found.items())
    }
    result = []
    for lang in {l for l, _ in kept}:
        mine = sorted((-v[4], -v[0], " ".join(p).encode(), v) for (l, p), v in kept.items() if l == lang)[:top]
        result += [(lang, r, p.decode(), *v) for r, (_, _, p, v) in enumerate(mine, 1)]
    return sorted(result)


def rows_of(frame):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("support, percent, top, block_words", [(3, 100, 2_000, 6_000_000), (3, 100, 5, 40), (5, 80, 50, 15), (1, 100, 30, 60)])
def test_equals_counting_with_a_dictionary(spark, support, percent, top, block_words):
    rng = random.Random(support + top)
    words = ["Sun", "moon", "sun\xa0x", "é", "a", "b", "the", "字"]
    passage = "the quick sun rose"
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\x0b"]) for _ in range(rng.randrange(30)))
        rows.append((text + (passage if k % 3 == 0 else ""), rng.choice(["en", "en", "de", None])))
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert rows_of(cl.collocations(frame, support, percent, top, block_words)) == brute(rows, support, percent, top)


def test_awkward_rows(spark, documents):
    assert rows_of(cl.collocations(documents)) == brute([(r.text, r.lang) for r in documents.collect()], 100, 100, 2_000)
    assert cl.collocations(documents.limit(0)).count() == 0
    blank = spark.createDataFrame([(" ,. \n", "en"), ("", None), (None, "en")], "text string, lang string")
    assert cl.collocations(blank, 1).count() == 0


def test_counts_stay_exact_where_hashes_collide():
    codes = np.array([1, 2, 0, 1, 3, 0, 1, 2, 0], np.int32)
    places, hashes = np.array([0, 3, 6], np.int32), np.zeros(3, np.uint64)
    first, counts = cl._groups(codes, places, hashes, 2)
    assert sorted(zip(first.tolist(), counts.tolist())) == [(0, 2), (3, 1)]


def test_products_may_pass_64_bits(spark):
    rows = [("en", "a b", 2, 4 * 10**11), ("en", "a", 1, 4 * 10**11), ("en", "b", 1, 5 * 10**11)]
    frequent = spark.createDataFrame(rows, "lang string, phrase string, n_words int, a long")
    sizes = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    (row,) = cl.scored(frequent, sizes).collect()
    assert row.score == 1000 * 4 * 10**11 * 9 * 10**13 // (4 * 10**11 * 5 * 10**11)


@pytest.mark.parametrize("n_blocks", [4, 60])
def test_what_is_told_of_buckets_grows_with_words_not_with_blocks(n_blocks):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(240)]
    plan = cl.Buckets.for_words(48_000, 100)
    told, batches = 0, []
    for k in range(n_blocks):
        frame = pa.RecordBatch.from_pydict({"text": texts[k::n_blocks], "lang": ["en"] * len(texts[k::n_blocks])})
        blocks = list(cl._number(iter([frame]), 10**6))
        batches += [out for block in blocks for out in cl._bucket_counts(iter([block]), {1: lambda h: np.ones(len(h), bool)}, 2, plan)]
    rows = [r for b in batches for r in b.to_pylist()]
    total = np.zeros(1 << plan.bits, int)
    for r in rows:
        total[(r["part"] << plan.range_bits) + np.cumsum(cl._unpacked(r["gaps"]))] += cl._unpacked(r["times"])
        told += len(r["gaps"]) + len(r["times"])
    assert total.sum() == 240 * 199
    assert len(rows) <= n_blocks * plan.ranges and told < 4 * 48_000 + 40 * len(rows)
