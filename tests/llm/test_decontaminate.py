import random
import re

import pyarrow as pa
import pytest

from seriesprep.llm import decontaminate as dc
from seriesprep.llm.wordhash import PLAIN, SPACED, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            for p in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == p:
                        hit.update(range(i, i + n))
                        found.add(item_id)
        out.append((doc_id, len(w), len(hit), tuple(sorted(i for i in found if i is not None))))
    return sorted(out, key=repr)


def cases(seed=3, n=60):
    rng = random.Random(seed)
    letters = ["a", "B", "ç", "d1", "e", "字"]
    text = lambda k: " ".join(rng.choice(letters) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 8]))) for i in range(8)] + [(3, "zz"), (None, "a e"), (9, None)]
    docs = [(i, text(rng.randrange(40))) for i in range(n)] + [(0, "a zz"), (0, "a zz"), (None, "zz"), (7, None), (8, "")]
    return docs, items


@pytest.mark.parametrize("part, block", [(1_000_000, 1_000_000), (6, 100)])
def test_phrases_equal_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(dc, "PART_WORDS", part)
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.phrase_matches(dc.build_index(frame), bench, 4)
    rows = found.select("doc_id", "n_words", dc.n_hit().alias("n_hit"), "items").collect()
    assert sorted(((*r[:3], tuple(r[3])) for r in rows), key=repr) == brute(docs, items, 4)


def test_blocks_of_any_size_agree(monkeypatch):
    docs, items = cases(5, 200)
    words_of = [(i, next(word_hashes(pa.array([t]), PLAIN))[2].view("int64")) for i, t in items]
    phrases = dc.make_phrases(words_of, 4)

    def matched(size):
        monkeypatch.setattr(dc, "BLOCK_WORDS", size)
        blocks, block = [], dc._Block(0)
        import numpy as np

        for i, t in docs:
            for _, _, hashes, counts in word_hashes(pa.array([t], pa.string()), PLAIN):
                block.add(pa.array([i], pa.int64()), np.zeros(1, np.int64), hashes, counts)
            if block.size >= size:
                blocks.append(block)
                block = dc._Block(len(blocks))
        blocks.append(block)
        rows = []
        for b in blocks:
            if b.docs:
                t = pa.Table.from_batches(list(b.rows()))
                keep = [x is None or x in set(phrases.terms.tolist()) for x in t.column("term").to_pylist()]
                rows += dc._match_block(t.filter(pa.array(keep)), phrases, None).drop(["block", "base"]).to_pylist()
        return sorted(map(repr, rows))

    assert matched(10) == matched(10**6)


def test_proximity_needs_all_terms_near(spark):
    docs = [(1, "x b c a y"), (2, "a " + "z " * 30 + "b c"), (3, "a b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = dc.proximity_matches(dc.build_index(frame), bench, 3, reach=5).collect()
    assert {r.doc_id: list(r["items"]) for r in found} == {1: [1], 2: [], 3: []}
    assert all(not list(r["items"]) for r in dc.phrase_matches(dc.build_index(frame), bench, 3).collect())


def test_awkward_rows_and_removal(spark, documents):
    bench = spark.createDataFrame([(1, "beta GAMMA you"), (2, None)], "item_id long, text string")
    found = dc.phrase_matches(dc.build_index(documents), bench)
    assert found.count() == documents.count()
    kept = dc.drop_contaminated(documents, bench)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 4, 5]
    assert dc.drop_contaminated(documents, bench.limit(0)).count() == documents.count()
    assert dc.phrase_matches(dc.build_index(documents.limit(0)), bench).count() == 0


def test_word_classes_agree_with_the_patterns():
    text = "".join(map(chr, [*range(0x100), 0x2028, 0x5B57, 0x1F600])) * 2
    for kind, pattern in ((PLAIN, WORD), (SPACED, re.compile(r"[^\x20\x09-\x0D]+"))):
        counts = [c for *_, c in word_hashes(pa.array([text, None, "a b"]), kind)]
        assert counts[0].tolist() == [len(pattern.findall(text.translate(LOWER))), 0, 2]


def test_many_windows_on_a_large_block():
    """Nearly every term of 45,500 windows is in a block of a million words; few windows are."""
    import time

    import numpy as np

    rng = np.random.default_rng(4)
    text = rng.integers(0, 5_000, 1_000_000)
    items = [(k, rng.integers(0, 5_000, 100)) for k in range(500)]
    items[7][1][40:60] = text[700_000:700_020]
    phrases = dc.make_phrases(items, 10)
    places = {int(t): np.flatnonzero(text == t) for t in phrases.terms[:5_000]}
    packed = [np.diff(p, prepend=0).astype("<i4").tobytes() for p in places.values()]
    index = pa.table(
        {
            "block": pa.array([0] * (1 + len(places)), pa.int64()),
            "term": pa.array([None, *places], pa.int64()),
            "postings": pa.array([None, *packed], pa.binary()),
            "doc_id": pa.array([1] + [None] * len(places), pa.int64()),
            "mark": pa.array([0] + [None] * len(places), pa.int64()),
            "base": pa.array([0] + [None] * len(places), pa.int64()),
            "n_words": pa.array([len(text)] + [None] * len(places), pa.int64()),
        }
    )
    start = time.perf_counter()
    found = dc._match_block(index, phrases, None).to_pylist()[0]
    took = time.perf_counter() - start
    assert len(phrases.windows) == 45_500
    assert (found["items"], found["starts"], found["ends"]) == ([7], [700_000], [700_020])
    assert took < 5  # all windows one by one take some ten seconds
