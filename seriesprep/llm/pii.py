r"""Personal data: base patterns, and a semi-Markov conditional random field beside them.

The field scores whole spans of up to ``MAX_TOKENS`` tokens (counts of digits, letters and marks,
check digits, what stands at their borders), and dynamic programming over the tokens chooses
boundaries and kinds of all entities of an area at once. Areas are the tokens around digits and
``@``; nothing else can hold an entity. It is trained by likelihood, where the base patterns and
long mixed tokens (secrets) are the labels, on distinct areas of all texts: of each labelled kind
the ``KIND_AREAS`` with the least hash, and ``OTHER_AREAS`` without a label. Spans that it finds beside the base ones are added.

Two narrow passes over whole texts, one to train; nothing is shuffled but the bounded sample.

Defined results: a null or empty text has no spans. Base spans of several kinds may overlap; an
added span overlaps no other. Without any labelled area nothing is added. Rows that repeat are
searched each; empty tables give no rows. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from heapq import heappop, heappush
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesprep.llm.shared import fresh, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
MAX_TOKENS = 12
#: First tokens whose spans are scored at once.
BLOCK_TOKENS = 512
AROUND = 2
KIND_AREAS = 80
OTHER_AREAS = 240
#: Groups by hash that order their areas before the groups are put together.
SAMPLE_GROUPS = 32
AREA_TOKENS = 40

# The stated patterns, written so that no start is tried twice in one run.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TELLING = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")
LONG_TOKEN = re.compile(r"[A-Za-z0-9]{32}")
SECRET = re.compile(r"(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{32,128}\Z")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            done = found.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the stated patterns, by start and then kind."""
    if not TELLING.search(text):
        return []
    spans = list(_emails(text))
    for m in IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            spans.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), m.end(), "phone"))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def area_places(text: str) -> Iterator[tuple[int, int]]:
    """Places of the tokens around tokens with a digit or ``@``; overlapping surroundings are one
    area."""
    recent: list[tuple[int, int]] = []
    opened, last, left = -1, 0, 0
    for m in TOKEN.finditer(text):
        place = m.span()
        if TELLING.search(m[0]):
            if opened < 0:
                opened = recent[0][0] if recent else place[0]
            last, left = place[1], AROUND
        elif opened >= 0:
            last = place[1]
            left -= 1
            if not left:
                yield opened, last
                opened = -1
        # What follows may begin the next area, so the tail stays for it.
        recent = [*recent[1 - AROUND :], place]
    if opened >= 0:
        yield opened, last


def areas(text: str, most: int | None = None) -> Iterator[list[tuple[int, int]]]:
    """Token places of every area, or of those of at most ``most`` tokens."""
    for start, end in area_places(text):
        found = [m.span() for m in islice(TOKEN.finditer(text, start, end), most and most + 1)]
        if most is None or len(found) <= most:
            yield found


def _one_of(values: np.ndarray, bounds: list[int]) -> list[np.ndarray]:
    at = np.searchsorted(bounds, values, "right")
    return [at == k for k in range(len(bounds) + 1)]


def span_features(text: str, tokens: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which spans ``[first token, length - 1]`` may be entities, and the features of all spans."""
    n, longest = len(tokens), MAX_TOKENS
    words = [text[a:b] for a, b in tokens]
    first = np.repeat(np.arange(n), longest)
    last = first + np.tile(np.arange(longest), n)
    there = last < n
    last = np.minimum(last, n - 1)
    gaps = np.array([0] + [tokens[k][0] > tokens[k - 1][1] for k in range(1, n)])

    def total(of) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum([of(w) for w in words])])
        return sums[last + 1] - sums[first]

    digits = total(lambda w: sum(map(str.isdecimal, w)) if w.isascii() else 0)
    letters = total(lambda w: sum(map(str.isalpha, w)) if w.isascii() else 0)
    at, dots, dashes = (total(lambda w, c=c: w == c) for c in "@.-")
    plus, brackets = total(lambda w: w == "+"), total(lambda w: w in "()")
    other = total(lambda w: not w.isalnum() and w not in "@.-+()")
    spaces = np.concatenate([[0], np.cumsum(gaps)])
    spaces = spaces[last + 1] - spaces[first + 1]
    alnum = np.array([w.isalnum() for w in words])
    plus_first = np.array([w == "+" for w in words])[first]
    glued = np.append(gaps == 0, True)
    glued[0] = tokens[0][0] > 0 and not text[tokens[0][0] - 1].isspace()
    glued[n] = tokens[-1][1] < len(text) and not text[tokens[-1][1]].isspace()
    before = [text[a - 1] if a else " " for a, _ in tokens]
    quoted = np.array([c in "\"'=:" for c in before])[first]
    may = there & ((digits > 0) | (at > 0))
    checks = np.zeros((4, len(first)), bool)
    for k in np.flatnonzero(may & (digits >= 4)):
        if letters[k] == 0 and at[k] == 0 and other[k] == 0:
            whole = text[tokens[first[k]][0] : tokens[last[k]][1]]
            if 14 <= digits[k] <= 19 and CARD.fullmatch(whole):
                checks[0, k], checks[1, k] = True, luhn(re.sub("[ -]", "", whole))
            elif dots[k] == 3 and IP.fullmatch(whole):
                checks[2, k] = all(int(p[-4:]) <= 255 and len(p) < 4 for p in whole.split("."))
        elif first[k] == last[k] and len(words[first[k]]) >= 32:
            checks[3, k] = bool(SECRET.match(words[first[k]]))
    rows = [
        np.ones(len(first), bool),
        *_one_of(digits, [1, 4, 7, 10, 14, 16, 17, 20]),
        *_one_of(letters, [1, 6, 21]),
        *_one_of(at, [1, 2]),
        *_one_of(dots, [1, 2, 3, 4]),
        *_one_of(spaces, [1, 2, 3, 4]),
        *_one_of(last - first, [1, 2, 5, 8]),
        dashes > 0, brackets > 0, other > 0, plus_first, plus > plus_first,
        alnum[first], alnum[last], glued[first], glued[last + 1], quoted,
        *checks,
        plus_first & (digits >= 10) & (digits <= 15) & (letters == 0) & (at == 0),
        (at == 1) & (dots > 0) & (spaces == 0) & (other == 0),
    ]
    return may.reshape(n, longest), np.stack(rows, axis=1).reshape(n, longest, -1)


@dataclass(frozen=True)
class SpanModel:
    """Weights of span features per kind; a token outside every span scores 0."""

    weights: np.ndarray

    def decode(self, text: str, start: int, end: int) -> list[Span]:
        """Best segmentation of the area at ``start`` to ``end``. Spans are scored for
        ``BLOCK_TOKENS`` first tokens at a time; of the tokens before, the last ``MAX_TOKENS`` scores
        are carried, and a place, length and kind each are kept."""
        begins, ends, back, kinds = array("i"), array("i"), bytearray(1), bytearray(1)
        best, score, kind = [0.0], np.zeros((0, MAX_TOKENS)), np.zeros((0, MAX_TOKENS), np.int64)
        tokens = (m.span() for m in TOKEN.finditer(text, start, end))
        block = list(islice(tokens, BLOCK_TOKENS + MAX_TOKENS))
        while block:
            size = len(block) if len(block) < BLOCK_TOKENS + MAX_TOKENS else BLOCK_TOKENS
            may, features = span_features(text, block)
            scores = np.where(may[:size, :, None], features[:size] @ self.weights, -np.inf)
            # Rows of first tokens before the block, whose spans may end inside it.
            carried = len(score)
            kind, score = np.concatenate([kind, scores.argmax(axis=2)]), np.concatenate([score, scores.max(axis=2)])
            for k in range(carried, carried + size):
                lengths = np.arange(min(MAX_TOKENS, k + 1))
                options = np.array(best[-MAX_TOKENS:])[-1 - lengths] + score[k - lengths, lengths]
                length = int(options.argmax())
                taken = options[length] > best[-1]
                best.append(float(options[length]) if taken else best[-1])
                back.append(length + 1 if taken else 0)
                kinds.append(int(kind[k - length, length]) if taken else 0)
            begins.extend(a for a, _ in block[:size])
            ends.extend(b for _, b in block[:size])
            best, score, kind = best[-MAX_TOKENS:], score[1 - MAX_TOKENS :], kind[1 - MAX_TOKENS :]
            block = block[size:]
            block += islice(tokens, BLOCK_TOKENS + MAX_TOKENS - len(block))
        spans, at = [], len(begins)
        while at:
            if back[at]:
                first = at - back[at]
                spans.append((begins[first], ends[at - 1], KINDS[kinds[at]]))
                at = first
            else:
                at -= 1
        return spans[::-1]


def all_spans(text: str, model: SpanModel | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with what the model adds."""
    base = base_spans(text)
    if model is None or not TELLING.search(text):
        return base, base
    starts = [s for s, _, _ in base]
    reached = list(accumulate((e for _, e, _ in base), max))
    found = list(base)
    for place in area_places(text):
        for start, end, kind in model.decode(text, *place):
            before = bisect_left(starts, end)
            if not before or reached[before - 1] <= start:
                found.append((start, end, kind))
    return base, in_order(found)


def _labels(text: str, tokens: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int, int]] | None:
    """Labelled spans as (first token, length - 1, kind); None if one is not made of tokens."""
    starts = {a: k for k, (a, _) in enumerate(tokens)}
    ends = {b: k for k, (_, b) in enumerate(tokens)}
    gold, free = [], tokens[0][0]
    for start, end, kind in base:
        if end <= tokens[0][0] or start >= tokens[-1][1]:
            continue
        if start not in starts or end not in ends or start < free or ends[end] - starts[start] >= MAX_TOKENS:
            return None
        gold.append((starts[start], ends[end] - starts[start], KINDS.index(kind)))
        free = end
    covered = {k for f, length, _ in gold for k in range(f, f + length + 1)}
    for k, (a, b) in enumerate(tokens):
        if k not in covered and SECRET.match(text[a:b]):
            gold.append((k, 0, KINDS.index("secret")))
    return gold


def area_kinds(piece: str) -> set[str]:
    """Kinds of the labels in a padded area as :func:`fit` sees them; ``""`` for an area without."""
    base = base_spans(piece)
    if not base and not LONG_TOKEN.search(piece):
        return {""}
    labels = [_labels(piece, tokens, base) for tokens in areas(piece) if len(tokens) <= AREA_TOKENS]
    return {KINDS[kind] for gold in labels for *_, kind in gold or ()} or ({""} if labels and None not in labels else set())


def _most(kind: str) -> int:
    return KIND_AREAS if kind else OTHER_AREAS


class LeastAreas:
    """The distinct areas of each kind with the least hash, as many as :func:`_most` says."""

    def __init__(self) -> None:
        self.heaps: dict[str, list[tuple[int, str]]] = {}
        self.held: set[tuple[str, str]] = set()

    def add(self, piece: str) -> None:
        number = int.from_bytes(blake2b(piece.encode(), digest_size=7).digest())
        # The root of a heap is the greatest of the least.
        if all(self._full(k) and number > -self.heaps[k][0][0] for k in ("", *KINDS)):
            return
        for kind in area_kinds(piece):
            if (kind, piece) in self.held or self._full(kind) and number > -self.heaps[kind][0][0]:
                continue
            heap = self.heaps.setdefault(kind, [])
            heappush(heap, (-number, piece))
            self.held.add((kind, piece))
            if len(heap) > _most(kind):
                self.held.remove((kind, heappop(heap)[1]))

    def _full(self, kind: str) -> bool:
        return len(self.heaps.get(kind, ())) >= _most(kind)


def _sample_areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least areas of all texts of a task: the least of a table are among those of its tasks."""
    least = LeastAreas()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for tokens in areas(text or "", AREA_TOKENS):
                a, b = max(0, tokens[0][0] - 1), tokens[-1][1] + 1
                least.add(text[a:b])
    rows = [(kind, -number, piece) for kind, heap in least.heaps.items() for number, piece in heap]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
    yield pa.RecordBatch.from_arrays(columns, names=["kind", "number", "area"])


def fit(pieces: list[str], rounds: int = 150, ridge: float = 0.02) -> SpanModel | None:
    """Weights that maximise the likelihood of the labelled segmentations, over padded areas."""
    examples = []
    for piece in pieces:
        base = base_spans(piece)
        for tokens in areas(piece):
            gold = _labels(piece, tokens, base) if len(tokens) <= AREA_TOKENS else None
            if gold is not None:
                examples.append((*span_features(piece, tokens), gold))
    if not any(gold for *_, gold in examples):
        return None
    width = examples[0][1].shape[2]
    a, t = len(examples), AREA_TOKENS
    x = np.zeros((a, t, MAX_TOKENS, width), np.float32)
    may = np.zeros((a, t, MAX_TOKENS), bool)
    gold = np.zeros((a, t, MAX_TOKENS, len(KINDS)), np.float32)
    size = np.array([len(m) for m, *_ in examples])
    for k, (m, f, spans) in enumerate(examples):
        x[k, : len(m)], may[k, : len(m)] = f, m
        for first, length, kind in spans:
            gold[k, first, length, kind] = 1
    used = np.argwhere(may)
    where = tuple(used.T)
    x, gold = x[where], gold[where]
    w = np.zeros((width, len(KINDS)))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        scores = np.full((a, t, MAX_TOKENS, len(KINDS)), -np.inf)
        scores[where] = x @ w
        spans = np.logaddexp.reduce(scores, axis=3)
        ahead = np.full((a, t + 1), -np.inf)
        ahead[:, 0] = 0.0
        for e in range(1, t + 1):
            parts = [ahead[:, e - 1], *(ahead[:, e - 1 - k] + spans[:, e - 1 - k, k] for k in range(min(MAX_TOKENS, e)))]
            ahead[:, e] = np.logaddexp.reduce(parts, axis=0)
        behind = np.full((a, t + 1), -np.inf)
        behind[np.arange(a), size] = 0.0
        for b in range(t - 1, -1, -1):
            parts = [behind[:, b + 1], *(behind[:, b + 1 + k] + spans[:, b, k] for k in range(min(MAX_TOKENS, t - b)))]
            parts.append(np.where(size == b, 0.0, -np.inf))
            behind[:, b] = np.logaddexp.reduce(parts, axis=0)
        log_z = behind[:, 0]
        area, first, length = where
        weight = ahead[area, first] + behind[area, first + length + 1] - log_z[area]
        chance = np.exp(scores[where] + weight[:, None])
        g = x.T @ (chance - gold) / a + ridge / a * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    return SpanModel(w)


def training_areas(docs: DataFrame) -> list[str]:
    """Distinct areas of all texts, of each kind those with the least hash."""
    telling = docs.select("text").filter(F.col("text").rlike("[0-9@]"))
    found = stored(telling.mapInArrow(_sample_areas, "kind string, number long, area string"), "areas").distinct()
    most = F.when(F.col("kind") == "", OTHER_AREAS).otherwise(KIND_AREAS)
    for group in (["kind", F.pmod("number", F.lit(SAMPLE_GROUPS))], ["kind"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("number", "area"))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    rows = found.select("number", "area").distinct().collect()
    return [r.area for r in sorted(rows)]


def train(docs: DataFrame) -> SpanModel | None:
    return fit(training_areas(docs))


def find_spans(docs: DataFrame, model: SpanModel | None, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` (default all) and an array column ``base`` and ``spans`` in one struct
    of ``start, end, kind`` entries; returns the frame and the struct's name."""
    kept = docs.columns if keep is None else keep
    out = fresh(docs, "_pii")
    source = fresh(docs, "_source_text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<start:int,end:int,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(source))
    added = StructType.fromDDL(f"{out} struct<base:{span},spans:{span}>")
    schema = StructType([*narrow.drop(source).schema.fields, *added.fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(len(kept)).to_pylist():
                for to, found in zip((base, spans), all_spans(text or "", sent.value)):
                    to.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            both = pa.StructArray.from_arrays([pa.array(base, kind), pa.array(spans, kind)], names=["base", "spans"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], both], names=[*kept, out])

    return narrow.mapInArrow(search, schema), out


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; ``n_chars``
    follows where there is such a column."""
    model = train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t, sent.value) for t in batch.column(column).to_pylist()]
            columns = list(batch.columns)
            columns[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    changed = docs.mapInArrow(masked, docs.schema)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n))
    return changed


def redact(text: str, model: SpanModel | None) -> str:
    parts, at = [], 0
    for start, end, kind in all_spans(text, model)[1]:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
