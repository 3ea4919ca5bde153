import random
import re

import numpy as np
import pyarrow as pa

from seriesprep.llm import near_dup as nd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute(rows, width=2):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    group = {}
    for i, (doc_id, _) in enumerate(rows):
        group.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in group[find(i)] if x is not None]
        comp = doc_id if not sets[i] else min(known, default=None)
        out.append((doc_id, len(sets[i]), comp, doc_id == comp))
    return sorted(out, key=repr)


def corpus(seed=1, families=12, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 12, 40, 200]))] for _ in range(families)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + len(text) // 8)):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.3:
            text += passage
        rows.append((i, " ".join(text)))
    return rows + [(3, rows[3][1]), (200, None), (201, ""), (202, " \n"), (None, rows[5][1]), (203, "Only"), (204, "ONLY")]


def found(spark, rows, width=2):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(frame, width).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(map(tuple, got), key=repr)


def test_components_equal_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_chains_and_shared_passages_equal_brute_force(spark):
    rng = random.Random(9)
    text = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):  # each version differs a little more from the first
        text = list(text)
        text[rng.randrange(60)] = f"x{i}"
        rows.append((100 - i, " ".join(text)))
    shared = " ".join(f"p{i}" for i in range(70))
    rows += [(1_000 + i, shared + " " + " ".join(f"q{i}_{k}" for k in range(rng.randrange(5, 60)))) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_registers_hold_zeros_and_mantissa():
    minima = np.array([0xFFFFFFFF, 0x80000000, 1, 0, 0x00C00000], np.uint32)
    got = nd.registers(minima)
    assert [int(g) >> 10 for g in got] == [0, 0, 31, 32, 8]
    assert [int(g) & 1023 for g in got] == [1023, 0, 0, 0, 512]


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3_000).astype(np.uint64)
    a, b = x[:2_000], x[500:2_500]  # 1500 of 2500
    same = [(nd.registers(nd.bucket_minima(a)) == nd.registers(nd.bucket_minima(b))).mean()]
    assert abs(same[0] - 0.6) < 0.15


def test_one_of_a_group_stays_and_columns_too(spark, documents):
    kept = nd.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5]
    assert nd.near_duplicates(documents.limit(0)).count() == 0


def test_sets_of_awkward_texts():
    sets = list(nd.shingle_sets(pa.array([None, "", "one", "a b", "a b a b", "x" * 300_000 + " y z"])))
    assert [len(s) for s in sets] == [0, 0, 1, 1, 2, 2]


def test_five_word_shingles_equal_brute_force(spark):
    rows = corpus(7) + [(300, "one two three"), (301, "one two three"), (302, "two three one"), (303, "One two  THREE four")]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_stage_takes_five_words(spark):
    """One word changed in 24: alike by pairs of words, not by runs of five."""
    words = [f"w{i}" for i in range(24)]
    changed = [*words[:12], "other", *words[13:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in nd.keep_one(frame).collect()} == {1, 2}
    assert {r.doc_id for r in nd.keep_one(frame, nd.PAIR).collect()} == {1}
