r"""Main text of web pages: markup zones, and a suffix array per host where markup says nothing.

A page is cut into blocks, each in the zone of an ``article``, of a ``main`` element, or outside
both; menus, headers, footers, asides, forms, scripts, adverts, notices and comments are left out
by tag, role or class. The text is the blocks of the best zone that has any word.

Blocks outside both zones may be boilerplate without any sign of it. For pages that have nothing
else, the token streams of the pages of a host are laid end to end and a suffix array finds runs
of ``LEAST_TOKENS`` or more that stand on ``LEAST_PAGES`` different pages; these are removed and
the unique runs kept. Pages of a host with the same blocks are one page here. Inside an article repeated runs stay: articles are copied and quoted, and
nothing of an article may be dropped.

A host's different pages are dealt into shards of about ``SHARD_PAGES``, so a hot host is many
groups. Every shard counts its runs of ``LEAST_TOKENS`` tokens, the counts are added over the whole
host, and the frequent runs go back to their shards to be removed: the result does not depend on
the shards. Runs are compared by 64-bit hash within a host.

Defined results: null or empty html gives an empty text; an unclosed element lasts to the end of
the page; a url without host forms a host of its own. Rows that repeat are extracted each. Empty
tables give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesprep.llm.shared import checked_broadcast, stored
from seriesprep.llm.urls import url_parts
from seriesprep.llm.wordhash import mix

LEAST_TOKENS = 8
LEAST_PAGES = 3
SHARD_PAGES = 256
ARTICLE, MAIN, OUTSIDE = 2, 1, 0
_STEP = np.uint64(0xA24BAED4963EE407)

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")  # quotes do not hide its end
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LETTER = re.compile("[a-zA-Z]")
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form dialog head template svg math object select button menu audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies share "
    "sharing social related recommended newsletter subscribe popup modal overlay widget toolbar pagination pager".split()
)
COMMENTS = frozenset("comment comments disqus reply replies".split())


def _left_out(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is no part of a main text."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            parts = set(re.split(r"[^a-z0-9]+", value))
            if parts & (COMMENTS if name == "article" else HINTS):
                return True
    return False


class Markup:
    """The markup of a page from front to back, in time linear in its length.

    Where no ``>`` follows, ``<`` is text. A tag with a quote that nothing closes ends at its first
    ``>``, and quotes hide nothing in the tags after it. A comment may last to the end of the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.last_close = page.rfind(">")
        self.tag = TAG

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """``start, end, is_end_tag, name, attributes``; the name of other markup is empty."""
        page = self.page
        while True:
            at = page.find("<" if at <= self.last_close else "<!--", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, False, "", ""
            if at < self.last_close:
                follows = page[at + 1 : at + 3]
                if follows[:1] in ("!", "?") or follows[:1] == "/" and not LETTER.match(follows, 1):
                    return at, page.find(">", at) + 1, False, "", ""
                if LETTER.match(follows, follows[:1] == "/"):
                    m = self.tag.match(page, at)
                    if not m:
                        self.tag = LOOSE_TAG
                        m = self.tag.match(page, at)
                    return at, m.end(), bool(m[1]), m[2].lower(), m[3]
            at += 1

    def after_raw(self, name: str, at: int) -> int:
        """Where the text of an element without markup, such as a script, has ended."""
        end = re.compile(rf"</{re.escape(name)}\b", re.I).search(self.page, at)
        return self.page.find(">", end.end()) + 1 if end and end.end() <= self.last_close else len(self.page)


def blocks_of(page: str) -> list[tuple[int, str]]:
    """``zone, text`` of the non-empty blocks in page order."""
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    depth = {"article": 0, "main": 0}
    at, block_zone = 0, OUTSIDE
    skipped, nested = "", 0

    def zone() -> int:
        return ARTICLE if depth["article"] else MAIN if depth["main"] else OUTSIDE

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((block_zone, text))
        parts.clear()

    markup = Markup(page)
    while True:
        m = markup.next(at)
        if not skipped:
            parts.append(page[at : m[0] if m else len(page)])
        if not m:
            break
        _, at, ends, name, attrs = m
        if not name:
            continue
        if not ends and name in RAW:
            at = markup.after_raw(name, at)
            continue
        if skipped:
            if name == skipped and not (not ends and attrs.endswith("/")):
                nested += -1 if ends else 1
                skipped = skipped if nested else ""
            continue
        if name in INLINE and not (not ends and name == "span" and _left_out(name, attrs, bool(depth["article"]))):
            continue
        close_block()
        if not ends and name not in VOID and _left_out(name, attrs, bool(depth["article"])):
            skipped, nested = name, 1
        elif name in depth:
            depth[name] = max(0, depth[name] + (-1 if ends else 1))
        block_zone = zone()
    close_block()
    return found


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zones, texts = [], []
        for page in batch.column("html").to_pylist():
            found = blocks_of(page or "")
            best = max((z for z, _ in found), default=OUTSIDE)
            zones.append(best)
            texts.append([t for z, t in found if z == best])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(zones, pa.int32()), pa.array(texts, pa.list_(pa.string()))],
            names=["page_id", "url", "host", "zone", "blocks"],
        )


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks of the prefixes of 1, 2, 4, ... tokens (prefix doubling)."""
    _, rank = np.unique(tokens, return_inverse=True)
    levels, step, n = [rank], 1, len(tokens)
    while True:
        behind = np.full(n, -1, np.int64)
        behind[: max(0, n - step)] = rank[step:]
        order = np.lexsort((behind, rank))
        fresh_rank = (np.diff(rank[order]) != 0) | (np.diff(behind[order]) != 0)
        ranked = np.empty(n, np.int64)
        ranked[order] = np.concatenate([[0], np.cumsum(fresh_rank)])[:n]
        if n == 0 or ranked[order[-1]] == n - 1:
            return order, levels
        rank, step = ranked, step * 2
        levels.append(rank)


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Tokens that each suffix shares with the one before it in order; 0 for the first."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = order[:-1] + shared[1:], order[1:] + shared[1:]
        inside = (a < n) & (b < n)
        level = np.append(levels[k], -1)
        same = inside & (level[np.minimum(a, n)] == level[np.minimum(b, n)])
        shared[1:] += np.where(same, 1 << k, 0)
    return shared


def run_groups(tokens: np.ndarray, pages: np.ndarray, least_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the group of each by its first ``least_tokens``, and the pages of each group."""
    order, levels = suffix_array(tokens)
    group = np.cumsum(common_prefixes(order, levels) < least_tokens) - 1
    pairs = np.unique(np.stack([group, pages[order]], axis=1), axis=0)
    return order, group, np.bincount(pairs[:, 0], minlength=group[-1] + 1 if len(group) else 0)


def covered_places(starts: np.ndarray, n: int, least_tokens: int) -> np.ndarray:
    """Whether each of ``n`` tokens lies in a run of ``least_tokens`` from one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + least_tokens, n), -1)
    return np.cumsum(change[:-1]) > 0


def repeated_places(tokens: np.ndarray, pages: np.ndarray, least_tokens: int, least_pages: int) -> np.ndarray:
    """Whether each token lies in a run of ``least_tokens`` that stands on ``least_pages`` pages.
    Negative tokens are walls that occur once each."""
    order, group, often = run_groups(tokens, pages, least_tokens)
    return covered_places(order[often[group] >= least_pages], len(tokens), least_tokens)


def _streams(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all blocks with a wall behind each, the page of each token, and the hash of the
    run of ``LEAST_TOKENS`` from it; 0 where a block has fewer left."""
    numbers: dict[str, int] = {}
    stream, owner, left, wall = [], [], [], 0
    for k, blocks in enumerate(pages):
        for block in blocks:
            words = [numbers.setdefault(w, len(numbers)) for w in block.split(" ")]
            wall -= 1
            stream += [*words, wall]
            owner += [k] * (len(words) + 1)
            left += range(len(words), -1, -1)
    tokens = np.array(stream, np.int64)
    digests = b"".join(blake2b(w.encode(), digest_size=8).digest() for w in numbers)
    by_number = np.append(np.frombuffer(digests, np.uint64), np.uint64(0))
    single = by_number[np.maximum(tokens, -1)]
    runs = np.zeros(len(tokens), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LEAST_TOKENS):
            runs = mix(runs * _STEP + np.append(single[k:], np.zeros(min(k, len(tokens)), np.uint64)))
    whole = np.array(left, np.int64) >= LEAST_TOKENS
    return tokens, np.array(owner, np.int64), np.where(whole, np.maximum(runs, np.uint64(1)), np.uint64(0)).view(np.int64)


def _count_runs(table: pa.Table) -> pa.Table:
    """The runs of one shard of a host, each with the number of pages it stands on."""
    tokens, owner, hashes = _streams(table.column("blocks").to_pylist())
    order, group, often = run_groups(tokens, owner, LEAST_TOKENS)
    first = order[np.unique(group, return_index=True)[1]]
    inside = hashes[first] != 0
    n = int(inside.sum())
    fixed = [pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in ("host", "shard")]
    return pa.table([*fixed, pa.array(hashes[first][inside]), pa.array(often[inside])], names=["host", "shard", "run", "pages"])


def _unique_runs(pages: pa.Table, frequent: pa.Table) -> pa.Table:
    """The blocks of one shard of a host without the runs that are frequent on the host."""
    lists = pages.column("blocks").to_pylist()
    tokens, _, hashes = _streams(lists)
    starts = np.flatnonzero(np.isin(hashes, frequent.column("run").to_numpy()) & (hashes != 0))
    covered = covered_places(starts, len(tokens), LEAST_TOKENS)
    left, at = [], 0
    for blocks in lists:
        kept = []
        for block in blocks:
            words = block.split(" ")
            runs = " ".join(w for w, c in zip(words, covered[at : at + len(words)].tolist()) if not c)
            kept += [runs] if runs else []
            at += len(words) + 1
        left.append(kept)
    return pa.table({"host": pages.column("host"), "content": pages.column("content"), "blocks": pa.array(left, pa.list_(pa.string()))})


def without_repeats(rest: DataFrame) -> DataFrame:
    """``page_id, url, blocks`` of every row of ``page_id, url, host, blocks`` without the runs that
    stand on ``LEAST_PAGES`` different pages of the host."""
    # Blocks hold no line feed.
    content = F.sha2(F.array_join("blocks", "\n").cast("binary"), 256)
    named = stored(rest.select("page_id", "url", "host", content.alias("content"), "blocks"), "unmarked")
    different = named.groupBy("host", "content").agg(F.first("blocks").alias("blocks"))
    counted = named.select("host", "content").distinct().groupBy("host").agg(F.ceil(F.count("*") / SHARD_PAGES).alias("shards"))
    dealt = different.join(checked_broadcast(stored(counted, "hosts"), 1_000_000), "host")
    shard = F.pmod(F.xxhash64("content"), "shards").alias("shard")
    dealt = stored(dealt.select("host", shard, "content", "blocks"), "shards")
    runs = stored(
        dealt.groupBy("host", "shard").applyInArrow(_count_runs, "host string, shard long, run long, pages long"), "runs"
    )
    often = runs.groupBy("host", "run").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    frequent = runs.join(often.select("host", "run"), ["host", "run"]).select("host", "shard", "run")
    left = dealt.groupBy("host", "shard").cogroup(frequent.groupBy("host", "shard"))
    cleaned = left.applyInArrow(_unique_runs, "host string, content string, blocks array<string>")
    return named.drop("blocks").join(cleaned, ["host", "content"]).select("page_id", "url", "blocks")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``page_id, url, html``."""
    host, _ = url_parts(F.col("url"))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    cut = stored(
        narrow.mapInArrow(_page_rows, "page_id long, url string, host string, zone int, blocks array<string>"), "blocks"
    )
    marked = cut.filter(F.col("zone") > OUTSIDE).select("page_id", "url", "blocks")
    rest = cut.filter((F.col("zone") == OUTSIDE) & (F.size("blocks") > 0))
    empty = cut.filter((F.col("zone") == OUTSIDE) & (F.size("blocks") == 0)).select("page_id", "url", "blocks")
    unique = without_repeats(rest.select("page_id", "url", "host", "blocks"))
    whole = marked.unionByName(unique).unionByName(empty)
    return whole.select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
