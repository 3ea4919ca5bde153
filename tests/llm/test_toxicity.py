import numpy as np
import pyarrow as pa
import pytest

from seriesprep.llm import toxicity as tx


def corpus(spark):
    rng = np.random.default_rng(5)
    plain = ["sun", "rain", "tree", "road", "lamp", "bird", "stone"]
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(rng.integers(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.integers(len(sentences))] += " filth vermin"
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(toxic) if i % 50 else 1))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        dict(docs),
    )


def test_held_out_documents_are_told_apart(spark):
    docs, labels, texts = corpus(spark)
    rows = tx.score(docs, tx.train(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert 60 < len(held) < 180
    for r in held:
        assert (r.score >= 0.5) == ("filth" in texts[r.doc_id])
    for r in rows:
        if "filth" in texts[r.doc_id]:
            (start,) = r.starts
            sentence = texts[r.doc_id][start:].split(".")[0]
            assert "filth" in sentence
        else:
            assert list(r.starts) == []


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = tx.train(docs, labels), tx.train(docs, flipped)
    assert (one.words == two.words).all() and (one.weights == two.weights).all()


def test_awkward_rows(spark, documents):
    docs, labels, _ = corpus(spark)
    model = tx.train(docs, labels)
    rows = tx.score(documents, model).collect()
    assert len(rows) == documents.count() and all(0 <= r.score < 0.5 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3)}
    assert len(empty) == 1
    nothing = tx.train(docs, labels.limit(0))
    assert {r.score for r in tx.score(documents, nothing).collect()} == {0.0}
    assert tx.score(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("at_once", [1_000_000, 30, 1])
def test_copies_tell_their_words_once_a_task(monkeypatch, at_once):
    monkeypatch.setattr(tx, "PAIRS_AT_ONCE", at_once)
    texts = ["filth vermin sun rain"] * 500 + ["sun rain tree road", "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0] * 499 + [1, 0, 0, 0])], names=["text", "toxic"])
    words = np.unique(tx.hash_stems(*next(tx.pieces(batch.column("text")))[2:], tx.PLAIN, tx.STEMS)[2])
    rows = [r for out in tx._families(iter([batch.slice(0, 250), batch.slice(250)]), words) for r in out.to_pylist()]
    bad, pairs = {}, [(r["word"], r["family"]) for r in rows]
    for pair, row in zip(pairs, rows):
        bad[pair] = max(bad.get(pair, 0), row["bad"])
    families = {family for _, family in pairs}
    by_family = sorted((sum(f == family for _, f in bad), {b for (_, f), b in bad.items() if f == family}) for family in families)
    assert [b for _, b in by_family] in ([{0}, {1}], [{1}, {0}]) and sum(n for n, _ in by_family) == len(bad)
    assert len(rows) <= 2 * len(bad) + (0 if at_once > 1 else 2 * len(words))
