import random
import zlib
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pytest

from seriesprep.llm import token_files as tf

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.json")


def whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_parts_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    texts = ["", " ", "a  b", "a \nb", " x", "x ", "<|endoftext|> a", "don't. ,.. ...\n\n q", "x\u00a0y \u2003z", "\x00 \x7f"]
    texts += ["".join(rng.choice(" ab.,'\n1é🙂 ") for _ in range(30)) for _ in range(500)]
    coder = tf.Encoder(VOCABULARY)
    for text, ids in zip(texts, whole(texts)):
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == ids[:-1], text


def test_frequent_parts_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(tf, "CACHE_ENTRIES", 40)
    coder, asked = tf.Encoder(VOCABULARY), []
    make = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda letters: asked.append(letters) or make(letters))
    texts = ["the sun, " + " ".join("abcdefghij"[int(d)] * 3 + "xyz"[k % 3] * (k // 3 % 40) for d in str(k)) + " sun the" for k in range(600)]
    for text, ids in zip(texts, whole(texts)):
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == ids[:-1]
    assert len(coder.parts) <= 40 and len(coder.parts.last) <= 40 and len(asked) > 300
    assert asked.count(coder.space + "sun") == 1 and asked.count(coder.space + "the") == 1


def test_a_worker_keeps_no_more_than_its_bytes(monkeypatch):
    """Texts without spaces are long parts: their number alone does not bound the table."""
    monkeypatch.setattr(tf, "CACHE_BYTES", 100_000, raising=False)
    monkeypatch.setattr(tf, "LONG_BYTES", 20_000, raising=False)
    rng, coder = random.Random(2), tf.Encoder(VOCABULARY)
    texts = [" ".join("".join(rng.choice(["日本", "の、", "été", "ab;", "x9"]) for _ in range(n)) for _ in range(4)) for n in [3, 200] * 60 + [9_000]]
    held = lambda table: sum(getsizeof(k) + getsizeof(v) for k, v in table.items())
    for text, ids in zip(texts, whole(texts)):
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == ids[:-1]
        assert held(coder.parts) <= 100_000 and held(coder.parts.last) <= 100_000 and held(coder.pieces) <= 100_000
    assert len(coder.parts) > 10


@pytest.mark.parametrize("rows_per_file, length, broadcast", [(16_384, 2_048, 9), (5, 4, 1_000), (5, 4, 0)])
def test_round_trip(spark, monkeypatch, documents, rows_per_file, length, broadcast):
    monkeypatch.setattr(tf, "ROWS_PER_FILE", rows_per_file)
    monkeypatch.setattr(tf, "FILES_PER_RANGE", 3)
    monkeypatch.setattr(tf, "MOST_BROADCAST_FILES", broadcast)
    monkeypatch.setattr(tf, "BATCH_SEQUENCES", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "rain,", "Ünï", "x1"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    index, folder = tf.write_token_files(frame, VOCABULARY, length)
    got = {r.doc_id: r for r in tf.read_digests(index, folder).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        (ids,) = whole([text])
        r = got[doc_id]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    for path in {r.path for r in index.collect()}:
        file = pa.ipc.open_file(path)
        assert file.schema.field("ids").type.list_size == length
        mask = np.concatenate([file.get_batch(k).column("mask").flatten().to_numpy(False) for k in range(file.num_record_batches)])
        used = sum(r.n_tokens for r in index.collect() if r.path == path)
        assert mask.sum() == used and not mask[used:].any()


def test_awkward_rows(spark, documents):
    rows = tf.read_digests(*tf.write_token_files(documents, VOCABULARY)).collect()
    assert len(rows) == documents.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert tf.read_digests(*tf.write_token_files(documents.limit(0), VOCABULARY)).count() == 0
