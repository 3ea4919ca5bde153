import random
import re

from seriesprep.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_base(text):
    """The stated patterns, read as they are written."""
    spans = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), "ip"))
    for m in pii.CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            spans.append((m.start(), m.end(), "card"))
    for m in pii.PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            spans.append((m.start(), m.end(), "phone"))
    return pii.in_order(spans)


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(1)
    for _ in range(4_000):
        text = "".join(rng.choice("a.@@12 5-+(é0") for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in ("4111 1111 1111 1111", "x 256.1.1.1 1.2.3.4.5", "+1 (017) 555-7713", "ü a@b.c@d.e.f", "001.02.3.255"):
        assert pii.base_spans(text) == plain_base(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def texts(n=300, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    things = [
        lambda: f"{word()}.{rng.randrange(99)}@{word()}.example.com",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
        lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        lambda: f"version {rng.randrange(9)}.{rng.randrange(9)}",
    ]
    return [" ".join([word() for _ in range(9)] + [rng.choice(things)()] + [word() for _ in range(9)]) for _ in range(n)]


def test_the_model_finds_secrets_and_keeps_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    model = pii.train(docs)
    fresh = spark.createDataFrame(list(enumerate(texts(seed=7))), "doc_id long, text string")
    found, out = pii.find_spans(fresh, model)
    right = total = 0
    for r in found.collect():
        base = [tuple(s) for s in r[out].base]
        spans = [tuple(s) for s in r[out].spans]
        assert base == plain_base(r.text) and set(base) <= set(spans)
        secrets = {m.span(1) for m in re.finditer('"([0-9a-f]{40})"', r.text)}
        right += len(secrets & {s[:2] for s in spans if s[2] == "secret"})
        total += len(secrets)
        assert not [s for s in spans if s not in base and s[2] != "secret"]
    assert total and right >= 0.95 * total


def test_awkward_rows_and_masking(spark, documents):
    assert pii.train(documents.filter("doc_id = 1")) is None
    masked = pii.mask(documents)
    assert masked.columns == documents.columns
    assert sorted((r.text or "") for r in masked.collect()) == sorted((r.text or "") for r in documents.collect())
    assert pii.mask(documents.limit(0)).count() == 0
    assert pii.redact("mail a@b.co now", None) == "mail <EMAIL> now"
    assert list(pii.areas("no telling token")) == []


def test_long_runs_cost_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "@" * 50_000):
        pii.base_spans(text)


def test_copies_and_rarity_empty_no_kind(spark):
    rng = random.Random(3)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a7" for _ in range(4)]
    rare = [f'the key is token = "{s}" and no more of it' for s in secrets]
    years = [f"in {1000 + k} there were {k * 7} of them and {k} more" for k in range(3_000)]
    copies = ["a text of the year 1999 that stands here again"] * 3_000
    docs = spark.createDataFrame(list(enumerate(rare + years + copies)), "doc_id long, text string").repartition(6)
    model = pii.train(docs)
    for text, secret in zip(rare, secrets):
        assert secret not in pii.redact(text, model)
    assert all(pii.redact(t, model) == t for t in years[:50])
    pieces = pii.training_areas(docs)
    assert pieces == pii.training_areas(docs.coalesce(1)) and len(set(pieces)) == len(pieces)
    assert sum(pii.area_kinds(p) == {"secret"} for p in pieces) == 4
    assert sum(pii.area_kinds(p) == {""} for p in pieces) == pii.OTHER_AREAS


def test_long_areas_are_decoded_in_blocks_of_bounded_memory(monkeypatch):
    import tracemalloc

    model = pii.fit([t for t in texts()[:120]])
    rng = random.Random(9)
    text = " ".join(rng.choice(["12.5", "7", "1999-01-02", "a@b2.c3", "+1 555 123 4567", "f0" * 20]) for _ in range(9_000))
    [place] = pii.area_places(text)
    tracemalloc.start()
    found = model.decode(text, *place)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 30e6
    short = text[:20_000]
    [place] = pii.area_places(short)
    in_blocks = model.decode(short, *place)
    monkeypatch.setattr(pii, "BLOCK_TOKENS", 10**6)
    assert in_blocks == model.decode(short, *place)
