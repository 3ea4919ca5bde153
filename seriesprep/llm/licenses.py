r"""License scan: ordered signature rules with keyword gate, priority and containment.

A text is brought to its words, each between two spaces of its own, and every rule is a regex over
that form. Its keywords are the words that every match has, so running it only on texts that have
them all as whole words loses nothing, and most texts run none. A detection that lies inside another is suppressed; of two that overlap otherwise, the one
with the better priority stays. The stated base phrases are rules too; their detections are
reported whatever suppresses them.

Native: array functions within one row, no shuffle and no join; a text of any length and with any
number of detections is one row.

Defined results: a null or empty text has no words and no detection, score 0. Of equal intervals
the better priority, then the first rule stays. Rows that repeat are scanned each; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesprep.llm.shared import let

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """``regex`` over single-spaced words, tried where all ``keywords`` are, the first of them the
    rarest; lower ``priority`` is better."""

    label: str
    regex: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


# The stated phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Families: label, regexes of the names (each without an alternation that decides what words it
#: has), words that a version may be written onto, versions (words between dots). Fixed values.
FAMILIES = (
    ("mit", ("mit(?: x11)?", "expat(?: x11)?"), (), ()),
    ("mit-0", ("mit 0",), (), ()),
    ("apache", ("apache(?: software)?", "asl"), ("apache", "asl"), ("1 0", "1 1", "2", "2 0")),
    ("bsd", ("(?:new |modified |revised |simplified |original )?bsd",), (), ()),
    ("bsd-2", ("bsd 2 clause", "2 clause(?: bsd)?", "bsd two clause", "two clause(?: bsd)?"), (), ()),
    ("bsd-3", ("bsd 3 clause", "3 clause(?: bsd)?", "bsd three clause", "three clause(?: bsd)?"), (), ()),
    ("bsd-4", ("bsd 4 clause", "4 clause(?: bsd)?", "bsd four clause", "four clause(?: bsd)?"), (), ()),
    ("0bsd", ("0bsd", "zero clause bsd"), (), ()),
    ("gpl", ("gnu general public", "(?:gnu )?gpl"), ("gpl",), ("1", "2", "2 0", "3", "3 0")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "(?:gnu )?lgpl"), ("lgpl",), ("2", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public", "(?:gnu )?agpl"), ("agpl",), ("1", "3", "3 0")),
    ("gfdl", ("gnu free documentation", "(?:gnu )?gfdl", "gnu fdl"), ("gfdl",), ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public", "mpl"), ("mpl",), ("1 0", "1 1", "2", "2 0")),
    ("epl", ("eclipse public", "epl"), ("epl",), ("1 0", "2", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("cddl",), ("1 0", "1 1")),
    ("cpl", ("common public", "cpl"), ("cpl",), ("1 0",)),
    ("eupl", ("european union public", "eupl"), ("eupl",), ("1 0", "1 1", "1 2")),
    ("osl", ("open software", "osl"), ("osl",), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free", "afl"), ("afl",), ("1 1", "2 1", "3 0")),
    ("artistic", ("artistic",), ("artistic",), ("1 0", "2", "2 0")),
    ("isc", ("isc",), (), ()),
    ("zlib", ("zlib(?: libpng)?",), (), ()),
    ("boost", ("boost software", "bsl"), (), ("1 0",)),
    ("ofl", ("(?:sil )?open font", "(?:sil )?ofl"), ("ofl",), ("1 0", "1 1")),
    ("unlicense", ("unlicense",), (), ()),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public"), ("wtfpl",), ("2",)),
    ("odbl", ("open database", "odbl"), ("odbl",), ("1 0",)),
    ("cc0", ("cc0", "cc zero", "creative commons zero"), (), ("1 0",)),
    *(
        (
            "cc-" + short.replace(" ", "-"),
            (f"cc {short}", f"creative commons {short}", f"cc {spelt}", f"creative commons {spelt}"),
            (),
            ("1 0", "2 0", "2 5", "3 0", "4 0"),
        )
        for short, spelt in (
            ("by", "attribution"),
            ("by sa", "attribution share ?alike"),
            ("by nd", "attribution no ?deriv(?:ative)?(?:s|works)?"),
            ("by nc", "attribution non ?commercial"),
            ("by nc sa", "attribution non ?commercial share ?alike"),
            ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?(?:s|works)?"),
        )
    ),
)
_UNDER = "(?:licensed|released|published|available|provided|distributed) under(?: the)?(?: terms of(?: the)?)? "
#: Forms a name without a version stands in, and their confidence. Better ones first.
FORMS = (
    ("spdx license identifier {name}", 0.99),
    (_UNDER + "{name}(?: licen[sc]e)?", 0.95),
    ("subject to the(?: terms of the)? {name} licen[sc]e", 0.9),
    ("under(?: the)? {name}(?: licen[sc]e)?", 0.8),
    ("{name} license", 0.6),
    ("{name} licence", 0.6),
)
#: The same for a name with its version.
VERSION_FORMS = (
    ("spdx license identifier {name}", 0.99),
    (_UNDER + "{name}", 0.98),
    ("subject to the(?: terms of the)? {name}", 0.93),
    ("under(?: the)? {name}", 0.83),
    ("{name}", 0.63),
)
#: Labels whose version is part of no name; the version makes a detection surer, not another label.
UNVERSIONED = ("cc0", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "wtfpl", "boost", "odbl")

#: Sentences of license bodies and of the notices that stand in files, with their labels.
SIGNATURES = (
    ("mit", "to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit-0", "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "apache org licenses license 2 0"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "gnu general public license version 2 as published by the free software foundation"),
    ("lgpl-2", "gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "creativecommons org publicdomain zero"),
    *((f"cc-{k.replace(' ', '-')}", f"creativecommons org licenses {k}") for k in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")),
)

#: Words that many texts have; a rule is anchored at another one where it has one.
FREQUENT = frozenset(
    "a all and any as at be by common copy document free general in is it license licence of open or org public person "
    "software source subject terms the this to under union use v version zero 0 1 2 3 4 5 two three four".split()
)


def implied_words(regex: str) -> tuple[str, ...]:
    """Words that every match of ``regex`` has, the anchor first: what is optional, joined or one
    of several is none of them."""
    while (bare := re.sub(r"\(\?:[^()]*\)\??", lambda m: " * " if m[0].startswith("(?: ") or m[0].rstrip("?").endswith(" )") else "*", regex)) != regex:
        regex = bare
    sure = [w for w in re.sub(r"\w+ \?", "*", regex).split() if re.fullmatch("[a-z0-9]+", w)]
    return tuple(sorted(dict.fromkeys(sure), key=lambda w: w in FREQUENT))


def all_rules() -> tuple[Rule, ...]:
    """Base phrases, then every name in every form, with each of its versions before none, then
    the signatures. Keywords are the words that the rule's own regex implies."""

    def rule(label: str, regex: str, priority: int, confidence: float) -> Rule:
        return Rule(label, regex, implied_words(regex), priority, confidence)

    def built() -> Iterator[Rule]:
        for label, phrase in BASE:
            anchor = next(w for w in phrase.split() if w in ("mit", "apache", "cc"))
            yield Rule(label, phrase, tuple(dict.fromkeys([anchor, *phrase.split()])), 0, 1.0, base=True)
        for label, names, joined, versions in FAMILIES:
            for version in reversed(versions):
                number = version.removesuffix(" 0").replace(" ", ".")
                full = label if label in UNVERSIONED else f"{label}-{number}"
                written = [f"{n}(?: licen[sc]e)? (?:version |v |v)?{version}" for n in names]
                written += [f"(?:gnu )?{j}{v}{version}" for j in joined for v in ("v", "")]
                for k, (form, confidence) in enumerate(VERSION_FORMS):
                    for name in written:
                        yield rule(full, form.format(name=name), 1 + k, confidence)
            for k, (form, confidence) in enumerate(FORMS):
                for name in names:
                    yield rule(label, form.format(name=name), 1 + k + len(FORMS), confidence)
        for label, sentence in SIGNATURES:
            yield rule(label, sentence, 1, 0.97)

    return tuple(dict.fromkeys(built()))


RULES = all_rules()


def _spaced(regex: str) -> str:
    """Every word of the text stands between two spaces of its own."""
    out, optional = "", regex.replace("(?: ", "(?:\0").replace(" ?", "\1")
    for c in optional:
        out += "  " if c == " " else c
    return " " + out.replace("\0", "  ").replace("\1", "(?:  )?").replace("  )?  ", " )?  ") + " "


def _literal(rules: tuple[Rule, ...]) -> Column:
    """Rules by their anchor, the first keyword; one constant, as thousands of calls take minutes."""
    groups: dict[str, list[dict]] = {}
    for number, r in enumerate(rules):
        row = {
            "regex": _spaced(r.regex), "keywords": r.keywords, "label": r.label, "priority": r.priority,
            "rule": number, "confidence": r.confidence, "base": r.base,
        }
        groups.setdefault(r.keywords[0], []).append(row)
    rule = "regex:string,keywords:array<string>,label:string,priority:int,rule:int,confidence:double,base:boolean"
    rows = json.dumps([{"anchor": a, "rules": g} for a, g in groups.items()])
    return F.from_json(F.lit(rows), f"array<struct<anchor:string,rules:array<struct<{rule}>>>>")


#: Put around a match; control characters are in no word.
OPEN, CLOSE = "\x01", "\x02"
#: Detections that one fold goes through: what it keeps grows by copying.
SCAN_BLOCK = 64


def _places(spaced: Column, rule: Column) -> Column:
    """Detections of one rule: first word, end word and what the rule says.

    Every match is put between two marks, and the marks are found among the words: linear in the
    text, however many matches there are. The j-th match has 2 * j marks before its own."""

    def located(marked: Column) -> Column:
        tokens = F.array_remove(F.split(marked, " ", -1), "")
        marks = F.transform(tokens, lambda t, i: F.when(t.isin(OPEN, CLOSE), i))
        return let(F.array_compact(marks), numbered)

    def numbered(marks: Column) -> Column:
        def one(j: Column) -> Column:
            start = F.get(marks, 2 * j) - 2 * j
            end = F.get(marks, 2 * j + 1) - 2 * j - 1
            return F.struct(
                start.cast("int").alias("start"), (-end).cast("int").alias("until"), rule["priority"].alias("priority"),
                rule["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
                rule["base"].alias("base"),
            )

        return F.transform(F.sequence(F.lit(0), (F.size(marks) / 2).cast("int") - 1), one)

    marked = F.regexp_replace(spaced, rule["regex"], F.lit(f" {OPEN} $0 {CLOSE} "))
    return let(marked, lambda m: F.when(F.length(m) > F.length(spaced), located(m)))


def detections(words: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All detections of the rules whose keywords are among ``words``; ``until`` is minus the end,
    so that the natural order is by start, then longest, then priority and rule."""
    anchors = F.array(*[F.lit(a) for a in sorted({r.keywords[0] for r in rules})])
    wanted = F.array(*[F.lit(k) for k in sorted({k for r in rules for k in r.keywords})])
    groups = _literal(rules)

    def run(state: Column) -> Column:
        near = F.filter(groups, lambda g: F.array_contains(state["anchors"], g["anchor"]))
        near = F.flatten(F.transform(near, lambda g: g["rules"]))
        able = F.filter(near, lambda r: F.size(F.array_except(r["keywords"], state["keys"])) == 0)
        return F.array_sort(F.flatten(F.array_compact(F.transform(able, lambda r: _places(state["text"], r)))))

    def gated(present: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
        keys = F.array_intersect(words, wanted)
        return let(F.struct(present.alias("anchors"), keys.alias("keys"), spaced.alias("text")), run)

    return let(F.array_intersect(words, anchors), lambda present: F.when(F.size(present) > 0, gated(present)))


def surviving(found: Column) -> Column:
    """Sorted detections without contained ones, then without those that overlap a better one that
    stays: they are gone through by priority, rule and start."""

    def step(state: Column, d: Column) -> Column:
        free = -d["until"] > state["reached"]
        kept = F.when(free, F.concat(state["kept"], F.array(d))).otherwise(state["kept"])
        return F.struct(F.greatest(state["reached"], -d["until"]).alias("reached"), kept.alias("kept"))

    def unheld(blocks: Column) -> Column:
        # Blocks are folded on their own, each from the furthest end of the blocks before it.
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda d: -d["until"])))

        def fold(furthest: Column) -> Column:
            def one(block: Column, i: Column) -> Column:
                reached = F.when(i > 0, F.array_max(F.slice(furthest, 1, i))).otherwise(0)
                start = F.struct(reached.alias("reached"), F.filter(block, lambda d: F.lit(False)).alias("kept"))
                return F.aggregate(block, start, step, lambda s: s["kept"])

            return F.flatten(F.transform(blocks, one))

        return let(ends, fold)

    firsts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(SCAN_BLOCK))
    outer = let(F.transform(firsts, lambda i: F.slice(found, i, SCAN_BLOCK)), unheld)

    def best(group: Column) -> Column:
        """Of detections that hang together: by priority, rule and start, each that overlaps none before it."""

        def take(kept: Column, d: Column) -> Column:
            meets = F.exists(kept, lambda k: (k["start"] < -d["until"]) & (d["start"] < -k["until"]))
            return F.when(meets, kept).otherwise(F.concat(kept, F.array(d)))

        ranked = F.transform(group, lambda d: F.struct(d["priority"].alias("p"), d["rule"].alias("r"), d["start"].alias("s"), d.alias("d")))
        inner = F.transform(F.array_sort(ranked), lambda x: x["d"])
        return F.when(F.size(group) == 1, group).otherwise(F.aggregate(inner, F.filter(group, lambda d: F.lit(False)), take))

    def grouped(kept: Column) -> Column:
        # None holds another, so ends rise with starts: a group ends where the next does not overlap the last.
        after = F.sequence(F.lit(1), F.size(kept))
        ends = F.filter(after, lambda k: F.coalesce(F.get(kept, k)["start"] >= -F.get(kept, k - 1)["until"], F.lit(True)))
        from_ = lambda e, j: F.when(j > 0, F.get(e, j - 1)).otherwise(0)
        groups = let(ends, lambda e: F.transform(e, lambda k, j: F.slice(kept, from_(e, j) + 1, k - from_(e, j))))
        return F.when(F.size(kept) > 0, F.array_sort(F.flatten(F.transform(groups, best)))).otherwise(kept)

    return let(outer, grouped)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_words, base, detections`` of every row of ``doc_id, text``: places of base
    phrases, and the surviving detections, each ``start, until (minus end), rule, label, ...``."""
    text = F.lower(F.coalesce("text", F.lit("")))  # makes no delimiter of anything and no other of A-Z
    words = F.array_remove(F.split(text, DELIMITERS, -1), "")
    split = docs.select("doc_id", words.alias("words"))
    found = split.select("doc_id", F.size("words").cast("long").alias("n_words"), detections(F.col("words"), rules).alias("found"))
    some = F.col("found").isNotNull() & (F.size("found") > 0)
    return found.select(
        "doc_id",
        "n_words",
        F.when(some, F.filter("found", lambda d: d["base"])).alias("base"),
        F.when(some, surviving(F.col("found"))).alias("detections"),
    )


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score per document."""
    starts = F.transform("base", lambda d: d["start"])
    base = F.coalesce(F.transform("base", lambda d: d["label"]), F.array().cast("array<string>"))
    other = F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    sure = F.array_max(F.transform(F.concat("base", "detections"), lambda d: d["confidence"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, other)).alias("labels"),
        F.coalesce(sure, F.lit(0.0)).alias("score"),
        F.coalesce(F.size("detections"), F.lit(0)).cast("long").alias("n_detections"),
    )
