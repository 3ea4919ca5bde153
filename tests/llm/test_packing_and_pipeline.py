import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from seriesprep.llm import packing as pk


def plain_best_fit(sizes, sources, clusters, capacity):
    bins = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (b["left"], k) for k, b in enumerate(bins)
            if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])
        ]
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
            fits = [(capacity, len(bins) - 1)]
        k = min(fits)[1]
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
    return out


def test_best_fit_equals_the_plain_form():
    rng = random.Random(2)
    for n, sources in ((0, 3), (1, 1), (400, 5), (400, 200)):
        sizes = np.array(sorted((rng.randrange(0, 100) for _ in range(n)), reverse=True), int)
        source = np.array([rng.choice([None, *range(sources)]) for _ in range(n)], object)
        cluster = np.array([rng.choice([None, *range(90)]) for _ in range(n)], object)
        bins, offsets = pk.best_fit(sizes, source, cluster, 100)
        assert list(zip(bins.tolist(), offsets.tolist())) == plain_best_fit(sizes.tolist(), source, cluster, 100)


def test_pieces_are_whole_and_bins_hold(spark, documents):
    docs = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 50))
    sizes = pk.document_sizes(docs, cluster=F.xxhash64("text"))
    for shard_rows in (3, 1_000):
        rows = pk.pack(sizes, capacity=64, shard_rows=shard_rows).collect()
        assert sum(r.n_words for r in rows) == sizes.agg(F.sum("n_words")).first()[0]
        used = {}
        for r in rows:
            used.setdefault(r.bin_id, []).append((r.bin_offset, r.n_words))
        for spans in used.values():
            spans.sort()
            assert sum(n for _, n in spans) <= 64
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]) if n)
    assert pk.pack(sizes.limit(0)).count() == 0


def test_pipeline_equals_its_parts(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    leak = line(12)
    clean = [(i, line(60), "xx", f"s{i % 3}", 0) for i in range(20)]
    docs = clean + [
        (30, clean[4][1], "xx", "s0", 0),  # copy
        (31, clean[5][1] + " tail", "xx", "s0", 0),  # near copy
        (32, f"{line(20)} {leak} {line(20)}", "xx", "s0", 0),  # benchmark
        (33, "few words", "xx", "s0", 0),  # too short
        (34, f"{line(30)} mail me at who@mail.example.org now {line(5)}", "xx", "s0", 0),
        (35, None, None, None, None),
    ]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in packed) == [*range(20), 34]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
    masked = {r.doc_id: r for r in docs.collect()}
    assert "<EMAIL>" in masked[34].text and "who@" not in masked[34].text
    assert masked[34].n_chars == len(masked[34].text)
    assert masked[0].text == clean[0][1]


def test_pipeline_over_nothing(spark, tmp_path, documents):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    extra = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, str(tmp_path))
        assert extra.columns == documents.columns


def test_null_texts_are_no_copies(spark):
    docs = spark.createDataFrame([(k, None, f"s{k}") for k in range(4)] + [(9, "", "s9")], "doc_id long, text string, source string")
    copies = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    bins = pk.pack(pk.document_sizes(docs, cluster=copies)).collect()
    assert len({b.bin_id for b in bins}) == 1
