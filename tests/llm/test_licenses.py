import random
import re

import pytest
from pyspark.sql import functions as F

from seriesprep.llm import licenses as lc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    """Detections by the same rules over the words, and all places of the base phrases."""
    w = words(text)
    spaced = " " + "  ".join(w) + " "
    found = []
    for k, r in enumerate(lc.RULES):
        if set(r.keywords) <= set(w):
            for m in re.finditer(lc._spaced(r.regex), spaced):
                start = spaced[: m.start()].count(" ") // 2
                found.append((start, -(start + m[0].count(" ") // 2), r.priority, k, r.label, r.base))
    found.sort()
    outer = [d for i, d in enumerate(found) if not any(e[1] <= d[1] for e in found[:i])]
    best = []
    for d in sorted(outer, key=lambda d: (d[2], d[3], d[0])):  # the better ones first
        if all(-k[1] <= d[0] or -d[1] <= k[0] for k in best):
            best.append(d)
    places = [
        (i, label) for label, p in lc.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()
    ]
    starts = [i for i, _ in places]
    return (
        len(w), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
        ",".join(sorted({label for _, label in places} | {d[4] for d in best})), len(best),
    )


def test_scan_equals_brute_force(spark):
    rng = random.Random(4)
    pool = (
        "licensed under the mit license version 2 0 apache software cc by nc sa 4 gnu general public lesser gpl v 3 "
        "bsd clause spdx identifier terms of subject to released creative commons attribution Ünï 字 open font"
    ).split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [
        None, "", "...", "MIT", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0",
        "cc by nc cc by nc", "under the MIT license\nunder the mit LICENSE!", "the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0", "under the mit license " * 300,
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lc.summary(lc.scan(frame)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.n_detections)
        assert got == brute(t), t
        assert 0 <= r.score <= 1 and (r.score == 1) == (r.n_base > 0) or r.n_detections


def test_hundreds_of_rules_and_awkward_rows(spark, documents):
    assert len(lc.RULES) > 300
    rows = lc.summary(lc.scan(documents)).collect()
    assert len(rows) == documents.count()
    assert lc.summary(lc.scan(documents.limit(0))).count() == 0


def forms_of(regex):
    """Texts that the small language of the rules writes out: groups, alternatives, optional parts."""
    import itertools
    import re._parser as parser

    def out(tree):
        parts = []
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                parts.append([chr(arg)])
            elif name == "IN":
                parts.append([chr(a) for _, a in arg])
            elif name == "MAX_REPEAT":
                parts.append([*out(arg[2]), ""])
            elif name == "SUBPATTERN":
                parts.append(out(arg[3]))
            else:
                assert name == "BRANCH", name
                parts.append([t for branch in arg[1] for t in out(branch)])
        return ["".join(p) for p in itertools.islice(itertools.product(*parts), 200)]

    return out(parser.parse(regex))


def test_every_alternative_fires_through_the_gate():
    for r in lc.RULES:
        for text in forms_of(r.regex):
            w = text.split()
            assert re.search(lc._spaced(r.regex), " " + "  ".join(w) + " "), (r.regex, text)
            assert set(r.keywords) <= set(w), (r.regex, text)


def test_spelt_out_names_joined_versions_and_bodies_are_labelled(spark):
    wanted = {
        "Licensed under the Creative Commons Attribution 4.0 License": "cc-by",
        "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa",
        "Creative Commons Attribution Share Alike license": "cc-by-sa",
        "creative commons attribution non-commercial no derivs 3.0": "cc-by-nc-nd",
        "under the Creative Commons Zero license": "cc0",
        "CC Zero licence": "cc0",
        "under the Expat license": "mit",
        "do what the fuck you want to public license": "wtfpl",
        "GPLv2": "gpl-2",
        "This is GPLv3 code": "gpl-3",
        "released under LGPLv2.1": "lgpl-2.1",
        "GNU GPL v3": "gpl-3",
        "http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "a text under a cloud, by the general public": "",
    }
    frame = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in lc.summary(lc.scan(frame)).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


@pytest.mark.parametrize(
    "found, kept",
    [
        ([(0, 4, 2), (3, 8, 1), (7, 12, 0)], [0, 7]),  # the middle one is gone, so the first stays
        ([(0, 6, 1), (2, 8, 3), (4, 10, 2)], [0]),  # all overlap: only the best
        ([(0, 6, 2), (5, 9, 2), (9, 12, 7)], [0, 9]),  # of equal ones the earlier rule, then start
        ([], []),
    ],
)
def test_overlaps_go_by_priority(spark, found, kept):
    kind = "array<struct<start:int,until:int,priority:int,rule:int,label:string,confidence:double,base:boolean>>"
    rows = [(start, -end, priority, 0, "x", 1.0, False) for start, end, priority in found]
    frame = spark.createDataFrame([(rows,)], f"found {kind}")
    got = frame.select(lc.surviving(F.col("found")).alias("kept")).first()["kept"]
    assert [d.start for d in got] == kept


def test_many_phrases_in_one_text(spark):
    """Places are numbered and overlaps resolved in linear time; texts as long as whole lists of licenses."""
    import time

    n = 100_000
    frame = spark.createDataFrame([(1, "cc by nc and so on " * n)], "doc_id long, text string")
    spark.createDataFrame([(0, "mit license")], "doc_id long, text string").transform(lambda f: lc.summary(lc.scan(f))).collect()
    began = time.monotonic()
    (row,) = lc.summary(lc.scan(frame)).collect()
    assert time.monotonic() - began < 40  # some seconds on a free machine
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (6 * n, n, 0, 6 * (n - 1))
    assert (row.base_labels, row.labels, row.n_detections) == ("cc-by-nc", "cc-by-nc", n)
