"""One query per operator of this subpackage over the whole given tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesprep.llm import (
    collocations,
    decontaminate,
    html_text,
    licenses,
    mixture,
    near_dup,
    packing,
    pii,
    quality,
    token_files,
    toxicity,
    urls,
    whitening,
)
from seriesprep.llm.shared import table


def rounded(value: Column) -> Column:
    """Six digits, shifted off rounding ties, where two engines may go either way."""
    return F.round(value + F.lit(1e-9), 6) + F.lit(0.0)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select(
        "doc_id", "held_out", "score", predicted.alias("predicted"), F.size("starts").cast("long").alias("n_offending")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    found = decontaminate.phrase_matches(index, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies are the duplicate clusters; a null text is no copy of another."""
    docs = table(spark, sf_dir, "documents")
    copies = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    return packing.pack(packing.document_sizes(docs, cluster=copies))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = urls.page_outcomes(table(spark, sf_dir, "labels"))
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.withColumns({c: rounded(F.col(c)) for c in ("bad_mean", "bad_low")})


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, out = pii.find_spans(docs, pii.train(docs), keep=["doc_id"])
    named = lambda c: F.array_join(
        F.transform(f"{out}.{c}", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter(f"{out}.base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(named("base").cast("binary"), 256).alias("base_sha256"),
        named("spans").alias("spans"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.read_digests(*token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged, out = quality.judge_quality(docs, keep=["doc_id"])
    flat = judged.select("doc_id", f"{out}.*")
    return flat.withColumns({c: rounded(F.col(c)) for c in ("class_distance", "word_distance")})


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.select("vec_id", F.inline(white.columns[-1]))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return mixture.pack_mixture(table(spark, sf_dir, "documents"), vocabulary)


QUERIES = {
    q.__name__: q
    for q in (
        op1_license_scan,
        op2_toxicity,
        op3_decontamination,
        op4_best_fit_packing,
        op5_url_filter,
        op6_near_dedup,
        op7_pii,
        op8_token_files,
        op9_quality_rules,
        op10_html_text,
        op11_collocations,
        op12_whitening,
        op13_mixture_packing,
    )
}
