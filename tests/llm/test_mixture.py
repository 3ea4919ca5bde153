"""Pieces put together give every text's ids; windows hold the shares; nothing is padded."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from seriesprep.llm import mixture as mx

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.json")


def checked(frame, length=1_024, **options):
    """The pieces, after all that holds for any packing."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    wanted = Counter(tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in frame.collect())
    pieces = mx.pack_mixture(frame, VOCABULARY, length, **options).collect()
    assert sum(p.length for p in pieces) == sum(len(ids) * n for ids, n in wanted.items())
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for number, parts in sequences.items():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        assert total == length or (total < length and total & (total - 1) == 0), number
    assert sorted(sequences) == list(range(len(sequences)))
    return pieces


def frame_of(spark, sizes, parts=3, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(rng.choice(["sun", "moon,", "é", "x1"]) for _ in range(rng.randrange(60))), source))
            k += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts, "doc_id")


@pytest.mark.parametrize("length, options", [(64, {}), (64, {"most_queues": 2}), (128, {"shares": {"a": 0.5, None: 0.25}}), (1_024, {"shares": {"a": 0.0}})])
def test_every_id_is_in_one_piece(spark, length, options):
    frame = frame_of(spark, {"a": 90, "b": 40, None: 20, "null": 7, "c": 1})
    texts = {r.doc_id: (r.text, r.source) for r in frame.collect()}
    pieces = checked(frame, length, **options)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id, (text, source) in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.source) == (at, len(ids), source)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def shares_by_window(pieces, length):
    found = defaultdict(Counter)
    for p in pieces:
        found[p.sequence_id][p.source] += p.length
    return [w for w in found.values() if sum(w.values()) == length]


def test_windows_hold_the_shares_of_the_corpus(spark):
    frame = frame_of(spark, {"a": 300, "b": 100, "c": 50})
    pieces = checked(frame, 256)
    totals = Counter()
    for p in pieces:
        totals[p.source] += p.length
    for window in shares_by_window(pieces, 256):
        for source, n in totals.items():
            assert abs(window[source] - 256 * n / sum(totals.values())) <= 2 + len(totals) / 2


def test_given_shares_hold_while_the_queues_last(spark):
    frame = frame_of(spark, {"a": 300, "b": 100, "c": 50})
    windows = shares_by_window(sorted(checked(frame, 256, shares={"a": 0.25}), key=lambda p: p.sequence_id), 256)
    assert all(abs(w["a"] - 64) <= 3 for w in windows[:10])
    assert windows[-2]["a"] == 256


@pytest.mark.parametrize("seed", range(4))
def test_rounds_carry_their_deficits(seed):
    """Every counter against a loop that gives each queue its quantum round by round."""
    rng = np.random.default_rng(seed)
    tokens = [int(t) for t in rng.integers(1, 3_000, 5)]
    (phase,) = mx.phases(tokens, [Fraction(t) for t in tokens], 128)
    assert phase.rounds == -(-sum(tokens) // 128)
    granted, served = [Fraction(0)] * 5, [0] * 5
    for r in range(1, phase.rounds + 1):
        for q, t in enumerate(tokens):
            granted[q] += Fraction(128 * t, sum(tokens))
            while granted[q] - served[q] >= Fraction(1, 2) and served[q] < t:  # the counter holds a token, to the nearest
                assert phase.round_of(np.array([served[q]]), np.array([q])).tolist() == [r]
                served[q] += 1
        assert phase.served(np.array([r])).tolist() == [served]
    assert served == tokens


def test_rounds_beyond_a_block_are_exact():
    tokens = [7 * 10**15, 3, 10**9]
    phase = mx.Phase(np.zeros(3, np.int64), np.array(tokens), 0, 1_024)
    total = sum(tokens)
    for r in (1, phase.block, phase.block * 5 + 3, phase.rounds):
        want = [min(t, (2 * r * 1_024 * t + total) // (2 * total)) for t in tokens]
        assert phase.served(np.array([r, 1, r])).tolist()[::2] == [want, want]
        assert phase.served_of(np.array([r, r, r]), np.array([1, 0, 2])).tolist() == [want[1], want[0], want[2]]
    places, queues = np.array([tokens[0] // 3, tokens[0] - 1, 2]), np.array([0, 0, 1])
    rounds = phase.round_of(places, queues)
    assert (phase.served_of(rounds - 1, queues) <= places).all() and (places < phase.served_of(rounds, queues)).all()


def test_awkward_rows(spark, documents):
    pieces = checked(documents)
    assert {p.doc_tokens for p in pieces if p.doc_id in (2, 3)} == {1}
    assert mx.pack_mixture(documents.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        mx.pack_mixture(documents, VOCABULARY, shares={"s0": -1})
