"""Best-fit packing of token sequences, bounded-space and online.

Documents become pieces of at most `size` tokens (only longer documents are cut). Pieces are dealt out by a hash to packing
partitions; there each goes, in a fixed order, into the open bin that it fits best. The open bins are a fixed number; a bitset
has a bit for each amount of free space that some open bin has, so that the best fit is the lowest set bit from the piece's
length on. If no bin fits and all are open, the fullest is closed first.

Only (doc_id, piece, start, length, checksum) are shuffled, never tokens. AQE makes packing partitions as large as its advisory
size (about a million pieces), so that the bins still open at a partition's end are few against those it has filled.

Defined cases: a null text is an empty text: one piece, the end id alone; a doc_id of any type, null too, comes back as it was;
equal rows are packed as rows of their own; an empty table gives an empty table; of docs only doc_id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import ship, text_of
from .words import runs

SIZE = 2048
OPEN_BINS = 4096
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


class OpenBins:
    """At most `most` open bins of `size`; place() gives a bin's number and the place in it."""

    def __init__(self, size: int = SIZE, most: int = OPEN_BINS):
        self.size, self.most = size, most
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.n_open, self.n_made = 0, 0

    def _take(self, room: int) -> int:
        own = self.bins[room]
        b = own.pop()
        if not own:
            self.free ^= 1 << room
        self.n_open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = self._take(room)
        else:
            if self.n_open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            b, room = self.n_made, self.size
            self.n_made += 1
        left = room - length
        if left:
            if not self.bins[left]:
                self.free |= 1 << left
            self.bins[left].append(b)
            self.n_open += 1
        return b, self.size - room


def pieces(docs: DataFrame, path: str, text: str = "text", size: int = SIZE, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) for each piece."""
    ship(docs.sparkSession)
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1)
            for lo, hi in runs(texts):
                ids, at = e.encode_run(texts.slice(lo, hi - lo))
                raw, ends = memoryview(ids.astype("<u4")).cast("B"), at.tolist()
                whose, parts = [], []
                for row, (s, t) in enumerate(zip(ends[:-1], ends[1:], strict=True), lo):
                    n = t - s + 1  # with the end
                    for k, i in enumerate(range(0, n, size)):
                        upto = min(n, i + size)
                        crc = zlib.crc32(raw[4 * (s + i) : 4 * min(s + upto, t)])
                        whose.append(row)
                        parts.append((k, i, upto - i, zlib.crc32(last, crc) if upto == n else crc))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*parts, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whose, pa.int32())), *columns], names=PIECE)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(text).alias("t")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """parts (with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    ship(parts.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(size, open_bins)
        for b in batches:
            placed = [bins.place(n) for n in b.column("length").to_pylist()]
            more = [pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*PIECE, "sequence_id", "offset"])

    dealt = parts.select(*PIECE).repartition(F.xxhash64("doc_id", "piece", "ids_crc32"))
    ordered = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), *PIECE)
    return ordered.mapInArrow(fill, f"{', '.join(f'{c} {parts.schema[c].dataType.simpleString()}' for c in PIECE)}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, text: str = "text", size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    return pack(pieces(docs, path, text, size), size, open_bins)


def op1_best_fit_packing(docs: DataFrame, path: str) -> DataFrame:
    """The contract's digest: `pack_documents` as it is."""
    return pack_documents(docs, path)
