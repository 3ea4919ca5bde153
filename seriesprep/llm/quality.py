"""Quality rules: base counts, and distribution divergence from the document's language.

Two histograms of a document are compared with those of its language by Jensen-Shannon distance
(base 2, 0 to 1): character classes, and the language's commonest words with all others as one
bin. The references are the mean histograms of all documents of the language that are long
enough. A document shorter than ``least_words`` is not judged by divergence, as its histograms
are noise.

Native: DataFrame functions only, one narrow pass over the text; nothing but one row per language
is shuffled.

Defined results: a null or empty text has no words, so it fails the base rule. A null language is
a language of its own. A language with no document that is long enough judges nobody. Repeated
rows are judged each; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesprep.llm.shared import checked_broadcast, fresh, let, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Common words of each language; documents of other languages have one bin.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
N_COMMON = 12
N_CLASSES = 5


@dataclass(frozen=True)
class QualityLimits:
    """Base limits, and distances beyond which the divergence rule rejects."""

    least_words: int = 10
    repeat_percent: int = 20
    judged_words: int = 50
    class_distance: float = 0.25
    word_distance: float = 0.29


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more. Windows are compared by 64-bit hash; only
    texts with a repeated hash pay for sorting."""

    def covered(places: Column) -> Column:
        gap = lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, b: a + b)

    def places(ranked: Column) -> Column:
        twin = lambda s, k: (
            F.coalesce(F.get(ranked, k - 1)["h"] == s["h"], F.lit(False))
            | F.coalesce(F.get(ranked, k + 1)["h"] == s["h"], F.lit(False))
        )
        return F.array_sort(F.transform(F.filter(ranked, twin), lambda s: s["i"]))

    def repeats(grams: Column) -> Column:
        ranked = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        full = let(let(ranked, places), covered)
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), full).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        ids = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(ids, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    few = F.lit(0)
    return let(words, lambda w: F.when(F.size(w) > WINDOW, let(windows(w), repeats)).otherwise(few)).cast("long")


def text_counts(text: Column) -> Column:
    """A-Z, digits, symbols, characters in words, and all characters."""
    found = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return F.struct(
        found("[A-Z]").alias("upper"),
        found("[0-9]").alias("digits"),
        found(f"[{SYMBOLS}]").alias("symbols"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(text).cast("long").alias("chars"),
    )


def class_shares(counts: Column) -> Column:
    """Shares of A-Z, digits, symbols, white space and all else, from ``text_counts``."""
    total = F.greatest(counts["chars"], F.lit(1))
    spaces = counts["chars"] - counts["word_chars"]
    parts = [counts["upper"], counts["digits"], counts["symbols"], spaces]
    return _with_rest(F.array(*[p / total for p in parts]))


def _with_rest(shares: Column) -> Column:
    return let(shares, lambda s: F.concat(s, F.array(1 - F.aggregate(s, F.lit(0.0), lambda a, b: a + b))))


def common_words(lang: Column) -> Column:
    chosen = F.array().cast("array<string>")
    for code, listed in COMMON.items():
        chosen = F.when(lang == code, F.array(*map(F.lit, listed))).otherwise(chosen)
    return chosen


def word_shares(words: Column, lang: Column) -> Column:
    """Share of each common word of the language, and of all other words at the end."""
    known = sorted({w for listed in COMMON.values() for w in listed})

    def shares(found: Column) -> Column:
        total = F.greatest(found["n"], F.lit(1))
        share = lambda k: F.size(F.filter(found["w"], lambda w: w == k)) / total
        return _with_rest(F.transform(found["k"], share))

    def found(w: Column) -> Column:
        few = F.filter(w, lambda x: x.isin(*known))
        return F.struct(F.size(w).alias("n"), few.alias("w"), common_words(lang).alias("k"))

    return let(let(words, found), shares)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two aligned histograms."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, b: a + b)))


def text_features(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns ``keep`` and a struct of counts and histograms, from one pass over the text."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    words, counts, out = (fresh(docs, n) for n in ("_words", "_counts", "_features"))
    split = docs.withColumns({words: words_of(text), counts: text_counts(text)})
    w, c = F.col(words), F.col(counts)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    features = F.struct(
        lang.alias("lang"),
        F.size(w).cast("long").alias("n_words"),
        c["word_chars"].alias("word_chars"),
        c["symbols"].alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        class_shares(c).alias("classes"),
        word_shares(w, lang).alias("words"),
    )
    return split.select(*[F.col(f"`{k}`") for k in keep], features.alias(out)), out


def language_references(features: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """``ref_lang, ref_class, ref_words``: mean histograms over all long enough documents."""
    judged = features.filter(F.col("n_words") >= limits.judged_words)
    means = lambda name, n: [
        F.avg(F.get(F.col(name), F.lit(i))).alias(f"{name}{i}") for i in range(n)
    ]
    rows = judged.groupBy("lang").agg(*means("classes", N_CLASSES), *means("words", N_COMMON + 1))
    pack = lambda name, n: F.array(*[F.col(f"{name}{i}") for i in range(n)])
    # A language without list has one bin, so only the first mean is there.
    return rows.select(
        F.col("lang").alias("ref_lang"),
        pack("classes", N_CLASSES).alias("ref_class"),
        F.filter(pack("words", N_COMMON + 1), lambda x: x.isNotNull()).alias("ref_words"),
    )


def judge_quality(
    docs: DataFrame, keep: list[str] | None = None, limits: QualityLimits = QualityLimits()
) -> tuple[DataFrame, str]:
    """The columns ``keep`` (default all) of every row with one struct column of counts, distances
    and ``kept``, and that column's name.

    The features are written to the shared folder, so that the text is read and cut once though
    the references need a first look at all documents.
    """
    kept = docs.columns if keep is None else keep
    features, name = text_features(docs, kept)
    features = stored(features, "quality")
    references = stored(language_references(features.select(f"{name}.*"), limits), "references")
    references = checked_broadcast(references, 10_000)
    ref = fresh(docs, "_ref")
    referenced = references.select(
        F.col("ref_lang").alias(ref), F.struct("ref_class", "ref_words").alias(f"{ref}_h")
    )
    f, h = F.col(name), F.col(f"{ref}_h")
    judged = (f["n_words"] >= limits.judged_words) & h.isNotNull()
    distances = F.struct(
        F.when(judged, js_distance(f["classes"], h["ref_class"])).alias("c"),
        F.when(judged, js_distance(f["words"], h["ref_words"])).alias("w"),
    )
    failed = (f["n_words"] < limits.least_words) | (
        100 * f["n_repeat_words"] > limits.repeat_percent * f["n_words"]
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdict(d: Column) -> Column:
        far = (F.coalesce(d["c"], F.lit(0.0)) > limits.class_distance) | (
            F.coalesce(d["w"], F.lit(0.0)) > limits.word_distance
        )
        return F.struct(
            *[f[k].alias(k) for k in counts],
            failed.alias("base_failed"),
            (~failed & ~far).alias("kept"),
            d["c"].alias("class_distance"),
            d["w"].alias("word_distance"),
        )

    out = fresh(docs, "_quality")
    joined = features.join(referenced, f["lang"] == F.col(ref), "left")
    return joined.select(*[F.col(f"`{k}`") for k in kept], let(distances, verdict).alias(out)), out
