import math
import random

import numpy as np

from seriesprep.llm import html_text as ht
from seriesprep.llm import quality as ql
from seriesprep.llm import urls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<!-- <p>no</p> --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>
 three<br>four &eacute;&#233;</p><form><p>Name</p></form><aside>More</aside><div class="share">Share</div>
<p>Five<article class="comment"><p>First!</p></article></article><section id="comments"><p>Nice</p></section>
<footer>&copy; x</footer>"""


def test_article_without_the_rest():
    found = ht.blocks_of(PAGE)
    assert [t for z, t in found if z == ht.ARTICLE] == ["A & B", "One two three", "four éé", "Five"]
    assert ht.blocks_of("") == [] and ht.blocks_of("plain &lt;text&gt;") == [(ht.OUTSIDE, "plain <text>")]
    assert ht.blocks_of("<nav>never closed <p>x") == []
    assert ht.blocks_of("<p title='a>b'>x</p><p class=\"\">y<") == [(0, "x"), (0, "y<")]


def plain_repeats(tokens, pages, n, least):
    seen = {}
    for i in range(len(tokens) - n + 1):
        seen.setdefault(tuple(tokens[i : i + n]), set()).add(pages[i])
    covered = [False] * len(tokens)
    for i in range(len(tokens) - n + 1):
        if len(seen[tuple(tokens[i : i + n])]) >= least:
            covered[i : i + n] = [True] * n
    return covered


def test_repeats_equal_the_plain_form():
    rng = random.Random(3)
    for _ in range(60):
        tokens, pages, wall = [], [], 0
        for page in range(rng.randrange(1, 6)):
            for _ in range(rng.randrange(1, 3)):
                wall -= 1
                block = [rng.randrange(3) for _ in range(rng.randrange(1, 15))]
                tokens += [*block, wall]
                pages += [page] * (len(block) + 1)
        got = ht.repeated_places(np.array(tokens), np.array(pages), 3, 2)
        assert got.tolist() == plain_repeats(tokens, pages, 3, 2)


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark):
    menu = "<div>alpha beta gamma delta epsilon zeta eta theta iota</div>"
    rows = [(i, "http://h.example.org/x", f"{menu}<div>story {i} of its own kind</div>") for i in range(5)]
    rows += [(9, "http://other.example.org/", menu), (10, None, None), (10, None, None), (11, "http://h.example.org", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ht.extract(pages).collect()}
    assert [got[i] for i in range(5)] == [f"story {i} of its own kind" for i in range(5)]
    assert got[9].startswith("alpha") and got[10] == "" and got[11].startswith("A & B\nOne")
    assert ht.extract(pages).count() == len(rows) and ht.extract(pages.limit(0)).count() == 0


def test_urls(spark):
    wanted = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "https://EN.Example.NET/en/1?q": ("en.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://a.org/fr/x#y": ("a.org", "/fr/x", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, "allow"),
        "x://y://z/": ("y:", "//z/", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://u@h.co.uk:80/\n?": ("u@h.co.uk:80", "/\n", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate([*wanted, None])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, none).collect()}
    assert got == {i: wanted.get(u, ("", "", None, "allow")) for i, u in rows}
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows, bad = [], []
    for k, (host, n, share) in enumerate([("bad.a.org", 60, 1.0), ("new.a.org", 1, 1.0), ("good.b.org", 60, 0.0), ("once.b.org", 1, 1.0)]):
        for i in range(n):
            rows.append((k * 100 + i, f"http://{host}/p"))
            bad.append((k * 100 + i, int(i < share * n)))
    pages = spark.createDataFrame(rows + [(0, rows[0][1])], "page_id long, url string")
    got = {r.host: r for r in urls.filter_urls(pages, spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert got["bad.a.org"].verdict == "block" and got["once.b.org"].verdict == got["good.b.org"].verdict == "allow"
    assert got["good.b.org"].bad_mean < got["once.b.org"].bad_mean < got["new.a.org"].bad_mean < got["bad.a.org"].bad_mean


def test_outcomes(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 1, 0), (3, None, 1), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in urls.page_outcomes(labels).collect()} == {(1, 1), (2, 0), (3, 1)}


def plain_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_the_plain_form(spark, documents):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab #\n\t\x0b é") + rng.choice(["", " "]) for _ in range(rng.randrange(120)))) for i in range(120)]
    rows += [(900, " ".join(["a b c d e f"] * 5)), (901, None), (902, "x " * 4), (903, "a b c d e"), (904, "\n\n \n")]
    frame = spark.createDataFrame([(*r, "xx") for r in rows], "doc_id long, text string, lang string")
    judged, out = ql.judge_quality(frame)
    for r in judged.collect():
        q = r[out]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain_counts(r.text)
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
        assert not (q.kept and q.base_failed)
    again, name = ql.judge_quality(documents)
    assert again.columns == [*documents.columns, name] and again.count() == documents.count()
    assert ql.judge_quality(documents.limit(0))[0].count() == 0


def test_divergence_rejects_strange_text_and_keeps_the_rest(spark):
    rng = random.Random(5)
    words = ["the", "of", "and", "river", "stone", "light", "to", "in", "house", "water", "is", "garden"]
    fine = [(i, " ".join(rng.choice(words) + (str(i) if rng.random() < 0.02 else "") for _ in range(120)), "en") for i in range(60)]
    odd = (99, " ".join("".join(rng.choice("QXZ#*%") for _ in range(6)) for _ in range(120)), "en")
    frame = spark.createDataFrame([*fine, odd], "doc_id long, text string, lang string")
    judged, out = ql.judge_quality(frame)
    verdicts = {r.doc_id: r[out] for r in judged.collect()}
    assert not verdicts[99].kept and not verdicts[99].base_failed
    assert sum(v.class_distance <= 0.25 and v.word_distance <= 0.29 for k, v in verdicts.items() if k < 99) == 60
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    from pyspark.sql import functions as F

    got = spark.range(1).select(ql.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_repeats_count_different_pages_of_the_whole_host(spark, monkeypatch):
    rng = random.Random(6)
    passages = [" ".join(f"p{k}w{j}" for j in range(rng.randrange(7, 14))) for k in range(12)]
    pages = []
    for i in range(60):
        chosen = [p for k, p in enumerate(passages) if rng.random() < (0.04 if k < 9 else 0.5)]
        pages.append(f"<div>own story {i}</div>" + "".join(f"<div>{p}</div>" for p in chosen))
    copied = "<div>a page of many words that is there three times and on no other page</div>"
    rows = [(i, "http://h.example.org/x", p) for i, p in enumerate(pages)]
    rows += [(100 + k, "http://h.example.org/y", copied) for k in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = {}
    tokens, owner, wall = [], [], 0
    blocks = [[t for _, t in ht.blocks_of(p)] for p in [*pages, copied]]
    for k, page in enumerate(blocks):
        for block in page:
            wall -= 1
            tokens += [*block.split(" "), wall]
            owner += [k] * (len(block.split(" ")) + 1)
    covered, at = plain_repeats(tokens, owner, ht.LEAST_TOKENS, ht.LEAST_PAGES), 0
    for k, page in enumerate(blocks):
        kept = []
        for block in page:
            words = block.split(" ")
            kept.append(" ".join(w for j, w in enumerate(words) if not covered[at + j]))
            at += len(words) + 1
        wanted[k if k < 60 else 100] = "\n".join(t for t in kept if t)
    wanted |= {101: wanted[100], 102: wanted[100]}
    assert wanted[100].startswith("a page of many words")
    for size in (2, 10, 256):
        monkeypatch.setattr(ht, "SHARD_PAGES", size)
        assert {r.page_id: r.text for r in ht.extract(frame).collect()} == wanted, size


def test_broken_markup_takes_linear_time():
    import time

    def took(page):
        start = time.perf_counter()
        found = ht.blocks_of(page)
        return time.perf_counter() - start, found

    for piece in ("<a ", "<p x='", "</script ", "<!-", "<script></script ", "<p \"'>", "<"):
        seconds, _ = took(piece * (1_000_000 // len(piece)))
        assert seconds < 4, piece


def test_broken_markup():
    text = lambda page: [t for _, t in ht.blocks_of(page)]
    assert text("a < b <p>c <d") == ["a < b", "c <d"]
    assert text("<p title='x > y'>one</p><p title='open>two</p><p>three") == ["one", "two", "three"]
    assert text("one<!-- > -->two<!-- three > four") == ["onetwo"]
    assert text("one<script>two</script three>four</ >five<!DOCTYPE x>six<?p?>") == ["onefourfivesix"]
    assert text("one<script>two</script") == ["one"]
