"""Token ids in Arrow files with fixed-size lists, for random access without copying.

Documents are dealt into ascending ranges of ids, encoded, closed with an end id, and their ids
written back to back as sequences of equal length: each file is an Arrow IPC file whose batches
hold ``ids`` (fixed-size list of uint16, or uint32 for larger vocabularies) and ``mask``
(fixed-size list of booleans, false in the padding of the file's last sequence). All buffers are
uncompressed, so a reader maps the file and sequence ``k`` is a slice of the mapped bytes. The
index, one row per document, is a Parquet table beside the files: file, start in the file, length.

A task writes its file under a name of its own attempt and only a finished task's rows reach the
index, so a lost executor leaves at most a file nobody names.

Encoding cuts a text at single spaces. Byte-level BPE takes such a space into the word behind it and
joins nothing across, so the ids of a part are the same wherever it stands and are looked up in
a table of the worker, bounded in entries and bytes, whose full half goes when the other is full: what is
frequent stays. A text with white space beside white space, or with the brackets of special tokens,
is encoded whole.

Defined results: a null or empty text is only the end id. Rows that repeat are written each, in
order of their text's hash. Empty tables give no files and no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesprep.llm.shared import checked_broadcast, job_path, stored

SEQUENCE = 2_048
BATCH_SEQUENCES = 256
END_ID = 0
ROWS_PER_FILE = 16_384
#: Files of one range, and most ranges: one row per range is broadcast.
FILES_PER_RANGE, FILE_RANGES = 2_000, 4_096
MOST_BROADCAST_FILES = 1_000_000
#: Most entries and bytes of half a table of parts (a worker has two halves, and as much again as one
#: for pieces), bytes of an entry beside letters and ids, and of the longest entry.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 80 << 20
ENTRY_BYTES, LONG_BYTES = 150, 64 << 10
INDEX_SCHEMA = "doc_id long, path string, start long, n_tokens long"


def _byte_letters() -> dict[int, str]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for themselves,
    the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)}


def _size(part: str, ids: bytes) -> int:
    """Bytes of an entry, at most: a letter takes up to four."""
    return ENTRY_BYTES + 4 * len(part) + len(ids)


class _Parts(dict):
    """Ids of parts behind a space; what is not there is made. Two generations: a full one becomes
    the last, and what is still asked for comes back from it. Long parts are not kept."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.last: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        found = self.last.get(part)
        if found is None:
            found = self.make(part)
        size = _size(part, found)
        if size > LONG_BYTES:
            return found
        if len(self) >= CACHE_ENTRIES or self.held + size > CACHE_BYTES:
            self.last = {}  # gone before the copy is made
            self.last = dict(self)
            self.clear()
            self.held = 0
        self[part] = found
        self.held += size
        return found


class _Uncut(Exception):
    """The text cannot be cut at this part."""


class Encoder:
    """Ids of whole texts as bytes (of the machine's order, little-endian on all that Arrow files
    are written for here), with looked-up parts."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 65_536 else ("<u4", "I")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = _byte_letters()
        self.space = self.letters[ord(" ")]
        #: Pieces of parts that are more than one run of letters.
        self.pieces: dict[str, bytes] = {}
        self.pieces_held = 0
        self.parts = _Parts(self._part)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self._ids(piece.encode().decode("latin-1").translate(self.letters))
            size = _size(piece, found)
            if size > LONG_BYTES:
                return found
            if len(self.pieces) >= CACHE_ENTRIES or self.pieces_held + size > CACHE_BYTES:
                self.pieces.clear()
                self.pieces_held = 0
            self.pieces[piece] = found
            self.pieces_held += size
        return found

    def _part(self, part: str) -> bytes:
        if part.isalpha():  # one run of letters
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            return self._ids(self.space + letters)
        if part and part[-1] in ",." and part[:-1].isalpha():
            return self.parts[part[:-1]] + self._piece(part[-1])
        return self._cut(part, " ")

    def _cut(self, part: str, space: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace() or "<|" in part:
            raise _Uncut
        return b"".join(map(self._piece, self.pattern.findall(space + part)))

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self._cut(first, "") + b"".join(map(self.parts.__getitem__, rest))
        except _Uncut:
            return self._whole(text)


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return Encoder(vocabulary)


class SequenceWriter:
    """Writes a stream of ids as fixed-size lists; pads the last sequence."""

    def __init__(self, folder: str, kind: str, length: int):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{uuid.uuid4().hex}.arrow"
        self.kind, self.length = np.dtype(kind), length
        self.ids = pa.list_(pa.from_numpy_dtype(self.kind), length)
        self.schema = pa.schema([("ids", self.ids), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.n_waiting = self.written = 0

    def add(self, packed: bytes) -> int:
        """Start of these ids in the file."""
        start = self.written + self.n_waiting
        self.waiting.append(packed)
        self.n_waiting += len(packed) // self.kind.itemsize
        if self.n_waiting >= self.length * BATCH_SEQUENCES:
            self._flush(last=False)
        return start

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        batch = self.length * BATCH_SEQUENCES
        n = -(-len(ids) // self.length) if last else len(ids) // batch * BATCH_SEQUENCES
        take = min(len(ids), n * self.length)
        padded = np.full(n * self.length, END_ID, self.kind)
        padded[:take] = ids[:take]
        mask = np.arange(n * self.length) < take
        for at in range(0, n, BATCH_SEQUENCES):
            rows = slice(at * self.length, min(at + BATCH_SEQUENCES, n) * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[rows]), self.length) for x in (padded, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.waiting = [ids[take:].tobytes()]
        self.n_waiting, self.written = len(ids) - take, self.written + take

    def close(self) -> None:
        self._flush(last=True)
        self.out.close()
        self.sink.close()


class SequenceReader:
    """Random access to the ids of a file: only the batches that a request covers are touched."""

    def __init__(self, folder: str, path: str):
        fs, _ = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size

    def ids(self, start: int, n: int) -> np.ndarray:
        per_batch = self.length * BATCH_SEQUENCES
        found, at = [], start
        while at < start + n:
            batch = self.file.get_batch(at // per_batch)
            values = batch.column("ids").flatten().to_numpy()
            inside = at % per_batch
            take = min(start + n - at, per_batch - inside)
            found.append(values[inside : inside + take])
            at += take
        return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, np.uint16)])


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, length: int) -> Iterator[pa.RecordBatch]:
    writer, coder = None, encoder(vocabulary)
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id")
        for at in range(0, len(texts), 256):
            encoded = [coder.encode(t or "") for t in texts.slice(at, 256).to_pylist()]
            writer = writer or SequenceWriter(folder, coder.kind, length)
            end = np.array([END_ID], coder.kind).tobytes()
            starts = [writer.add(e + end) for e in encoded]
            counts = [len(e) // writer.kind.itemsize + 1 for e in encoded]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, 256), pa.array([writer.path] * len(starts)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "path", "start", "n_tokens"],
            )
    if writer:
        writer.close()


def write_token_files(docs: DataFrame, vocabulary: str, length: int = SEQUENCE) -> tuple[DataFrame, str]:
    """Files of ``doc_id, text`` in ascending order of id, and their index (``doc_id, path, start,
    n_tokens``); returns the index and the folder of the files."""
    spark = docs.sparkSession
    folder = job_path(spark, "tokens")
    uri = folder if "://" in folder else re.sub(r"^(file:)?/+", "file:///", folder)
    n_files = -(-docs.count() // ROWS_PER_FILE) or 1
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = narrow.repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    index = dealt.mapInArrow(lambda b: _write(b, uri, vocabulary, length), INDEX_SCHEMA)
    return stored(index, "token-index"), uri


def _digests(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    readers: dict[str, SequenceReader] = {}
    for batch in batches:
        sums = []
        for path, start, n in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "n_tokens"))):
            if path not in readers:
                readers = {path: SequenceReader(folder, path)}  # rows of a file stand together
            sums.append(zlib.crc32(readers[path].ids(start, n).astype("<u4").tobytes()))
        columns = [batch.column(c) for c in ("doc_id", "shift", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], names=["doc_id", "shift", "start", "n_tokens", "ids_crc32"])


def file_shifts(index: DataFrame) -> DataFrame:
    """``path, shift``: the ids in all files before each one.

    Files are dealt over ranges of their first id, summed by range, and counted on inside a
    range: no task sees all files, and only one row per range is broadcast."""
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    files = stored(index.groupBy("path").agg(F.sum("n_tokens").alias("size"), first), "files")
    n_ranges = min(FILE_RANGES, -(-files.count() // FILES_PER_RANGE) or 1)
    ranged = files.repartitionByRange(n_ranges, "first.known", "first.doc_id", "path")
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "ranges")  # a lost task cannot renumber them
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("range").agg(F.sum("size").alias("size"))  # at most FILE_RANGES rows
    ranges = ranges.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy("first.known", "first.doc_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return stored(ranged.join(F.broadcast(ranges), "range").select("path", shift.alias("shift")), "shifts")


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, its ids read from the files.

    ``start`` counts the ids of all documents before it: the start in the file and the sizes of
    the files before. Beyond the broadcast bound files meet their documents by shuffle."""
    shifts = checked_broadcast(file_shifts(index), MOST_BROADCAST_FILES)
    placed = index.join(shifts, "path").sortWithinPartitions("path", "start").select("doc_id", "path", "shift", "start", "n_tokens")
    schema = "doc_id long, shift long, start long, n_tokens long, ids_crc32 long"
    read = placed.mapInArrow(lambda b: _digests(b, folder), schema)
    return read.select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32")
