"""Language-model scores from a log-frequency Bloom filter.

Counts of single tokens and of token pairs are taken over all training documents. Pair counts are quantised to powers of two; a
pair of level q is entered into a Bloom filter q times, as (pair, 1) ... (pair, q), and its count is read back by probing levels
upwards until one is missing. The probability of a token after another is the pair's count smoothed towards the token's own
(add-one) probability. Filter segments are built where the counts meet, one task for several segments, and are as long as their
own entries ask for.

The filter is one and the same at any size, and so are its probes and the scores; what the size decides is where a pair is probed.
The filter and the table of single counts are broadcast if together they hold at most MAX_BROADCAST bytes, which is checked before
pairs are counted: a filter has at most as many entries as there are training tokens. Beyond, nothing is collected: the texts of a
run of documents stay together, and the run sends each of its distinct tokens and pairs once, with its own count of them, to the
segment they belong to. There the counts meet, the filter is built, and the same rows are answered in their order; the answers go
back to the run. So a pair travels once for both counting and probing, a frequent token brings a row a run, and no row is made for
a pair of a document.

All probes of an entry fall into one block of 512 bits, a line of the processor's cache.

Tokens are words between white space, A-Z in lower case, and one end after each document; the end also stands before the first.

Defined cases: a null text is an empty text: one token, the end; a null doc_id is in the training part; without training tokens
N and V are 0 and every token has probability 1 (log 0); equal rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, ship, text_of
from .near import _mix
from .words import bytes_of, hash_each, runs, split_words, word_hashes

MAX_BROADCAST = 256 * 1024 * 1024
SEGMENT_BITS = 12
BITS_PER_ENTRY, PROBES = 10, 6
BLOCK_BITS = 512
#: Only tests still set this: a token is asked for once a run, so that a frequent one needs no way of its own.
FREQUENT = 1000
#: Bytes of text that ask together where the model is not broadcast.
ASK = 8_000_000
#: Weight of the smoothing, in tokens.
SMOOTHING = 4.0
_FLUSH = 4_000_000
_U = np.uint64
_END = word_hashes([b"\n"])[0]  # no word holds a line feed


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, the end last."""
    h = word_hashes((text or "").encode("utf-8", "replace").lower().split())
    return np.append(h, _END)


def pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it."""
    before = np.empty_like(h)
    before[0], before[1:] = _END, h[:-1]
    with np.errstate(over="ignore"):
        return _mix(before * _U(0x9E3779B97F4A7C15) + h)


class Run:
    """The tokens of some texts, one after the other, an end after each: the end stands before the next text's first token."""

    def __init__(self, texts: pa.Array):
        at, codes, words = split_words(texts, lower=True)
        self.distinct = np.append(hash_each(words), _END)
        self.codes = np.insert(codes.astype(np.int64), at[1:], len(words))
        self.first = at[:-1] + np.arange(len(texts))
        self.size = np.diff(at) + 1

    @property
    def hashes(self) -> np.ndarray:
        return self.distinct[self.codes]


def level(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.floor(np.log2(count)).astype(np.int64) + 1


def counted_as(lv: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(lv > 0, (2.0 ** (lv - 1) + 2.0**lv - 1) / 2, 0.0)


def _places(h: np.ndarray, lv: int, n_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the block of (h, lv) begins, and a number that holds nine bits for each probe's place in it."""
    with np.errstate(over="ignore"):
        x = _mix(h + _U(lv) * _U(0xD6E8FEB86659FD93))
        return (((x >> _U(32)) * (n_bits // _U(BLOCK_BITS))) >> _U(32)) * _U(BLOCK_BITS), _mix(x ^ _U(0x9E3779B97F4A7C15))


def _probe(block: np.ndarray, mix: np.ndarray, i: int) -> np.ndarray:
    return (block + ((mix >> _U(9 * i)) & _U(BLOCK_BITS - 1))).astype(np.int64)


def build_segment(h: np.ndarray, count: np.ndarray) -> tuple[int, bytes]:
    """Bits and bytes of the filter of these pairs."""
    lv = level(count)
    n_bits = max(1, -(-int(lv.sum()) * BITS_PER_ENTRY // BLOCK_BITS)) * BLOCK_BITS
    bits = np.zeros(n_bits, bool)
    for q in range(1, int(lv.max(initial=0)) + 1):
        block, mix = _places(h[lv >= q], q, _U(n_bits))
        for i in range(PROBES):
            bits[_probe(block, mix, i)] = True
    return n_bits, np.packbits(bits, bitorder="little").tobytes()


class Model:
    """Single counts (sorted hashes, counts), N, V and the filter's segments."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int, segments: list[tuple[int, int, bytes]]):
        self.words, self.counts, self.n, self.v = words, counts, n, v
        size = 1 << SEGMENT_BITS
        self.n_bits = np.full(size, BLOCK_BITS, _U)
        self.start = np.zeros(size, np.int64)
        data, at = [b"\0" * (BLOCK_BITS // 8)], BLOCK_BITS // 8
        for seg, n_bits, raw in segments:
            self.n_bits[seg], self.start[seg] = n_bits, at
            data.append(raw)
            at += len(raw)
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def single(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], 0)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of pairs, by probing upwards; an entry is given up at its first probe that fails."""
        out = np.zeros(len(h), np.int64)
        seg = (h >> _U(64 - SEGMENT_BITS)).astype(np.int64)
        start, n_bits = self.start[seg], self.n_bits[seg]
        live = np.arange(len(h))
        q = 0
        while len(live):
            q += 1
            block, mix = _places(h[live], q, n_bits[live])
            for i in range(PROBES):
                at = _probe(block, mix, i)
                hit = (self.data[start[live] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
                live, block, mix = live[hit], block[hit], mix[hit]
            out[live] = q
        return out

    def score(self, run: Run) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of each text. Each distinct token and pair is looked up once."""
        distinct, which = np.unique(pairs(run.hashes), return_inverse=True)
        return scored(run, self.single(run.distinct), self.levels(distinct)[which], self.n, self.v)


def scored(run: Run, count: np.ndarray, lv: np.ndarray, n: int, v: int) -> list[np.ndarray]:
    """The same from the counts of the run's distinct tokens and the levels of its pairs."""
    one = add_one(count, n, v)
    c, single = count[run.codes], one[run.codes]
    before = np.append(count[-1], c[:-1])
    p = smoothed(counted_as(lv), before, single)
    total = lambda x: np.add.reduceat(x, run.first)
    return [run.size, total((c > 0).astype(np.int64)), total(np.log10(one)[run.codes]), total(np.log10(p))]


def add_one(c, n: int, v: int):
    return (c + 1) / (n + 1 * (v + 1))


def smoothed(pair, before, single):
    """P(token | token before): the pair's count, at most the count of the token before, against that count."""
    return (np.minimum(pair, before) + SMOOTHING * single) / (before + SMOOTHING)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _counts(docs: DataFrame, of_pairs: bool) -> DataFrame:
    """h, n: counts as far as a task has met them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for lo, hi in runs(b.column(0)):
                h = Run(b.column(0).slice(lo, hi - lo)).hashes
                parts.append(pairs(h) if of_pairs else h)
                size += len(h)
                if size >= _FLUSH:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return docs.select(text_of().alias("t")).mapInArrow(count, "h long, n long")


def single_counts(train: DataFrame) -> DataFrame:
    """h, n of each token of the training documents."""
    return _counts(train, False).groupBy("h").agg(F.sum("n").alias("n"))


def segments(train: DataFrame) -> DataFrame:
    """segment, n_bits, bits: the filter, built where the pair counts of a segment meet. A pair brings a row a task at most."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ns, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = np.concatenate(hs), np.concatenate(ns)
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            return h[first], np.add.reduceat(n, first)

        for b in batches:
            hs.append(b.column("h").to_numpy().view(np.uint64))
            ns.append(b.column("n").to_numpy())
            size += len(b)
            if size > 2 * _FLUSH:
                h, n = merged()
                hs, ns, size = [h], [n], 0
        if not size and not hs:
            return
        h, n = merged()
        seg = (h >> _U(64 - SEGMENT_BITS)).astype(np.int64)
        cut = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(h)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi > lo:
                n_bits, raw = build_segment(h[lo:hi], n[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([int(seg[lo])], pa.int32()), pa.array([n_bits], pa.int64()), pa.array([raw], pa.binary())], names=["segment", "n_bits", "bits"])

    dealt = _counts(train, True).repartition(F.shiftrightunsigned("h", 64 - SEGMENT_BITS))
    return dealt.mapInArrow(build, "segment int, n_bits long, bits binary")


_SCORE = "n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, train: DataFrame | Column, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs. train: documents, or the condition that rows of
    docs meet which are to be learnt from."""
    ship(docs.sparkSession)
    own = docs.where(train) if isinstance(train, Column) else train
    singles = keep(single_counts(own))
    n, v = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    most = 16 * v + n * BITS_PER_ENTRY // 8 + (BLOCK_BITS // 8 << SEGMENT_BITS)  # a level is at most its count
    if most <= max_broadcast:
        filters = keep(segments(own))
        out = _by_broadcast(docs, singles, filters, n, v)
        forget(singles, filters)  # the model holds them
    else:
        forget(singles)
        out = keep(_by_segment(docs, train, n, v))
    return out.withColumn("train_tokens", F.lit(n).cast("long")).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _by_broadcast(docs: DataFrame, singles: DataFrame, filters: DataFrame, n: int, v: int) -> DataFrame:
    words, counts = np.empty(v, _U), np.empty(v, np.int64)
    table = singles.toArrow()
    words[:], counts[:] = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    del table
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    rows = [(r["segment"], r["n_bits"], bytes(r["bits"])) for r in filters.toLocalIterator()]
    sent = docs.sparkSession.sparkContext.broadcast(Model(words, counts, n, v, rows))
    del words, counts, rows, order

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for lo, hi in runs(b.column(1)):
                made = model.score(Run(b.column(1).slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, made)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", text_of().alias("t")).mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCORE}")


def probed(docs: DataFrame, filters: DataFrame) -> DataFrame:
    """pair, lv: the level that the filter gives each pair of docs, where it is not 0. Pairs meet the bits of their segment."""

    def probe(pairs_: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(pairs_["h"].to_numpy().view(_U))
        model = Model(np.empty(0, _U), np.empty(0, np.int64), 0, 0, [(int(s), int(n), bytes(b)) for s, n, b in zip(own["segment"], own["n_bits"], own["bits"], strict=True)])
        lv = model.levels(h)
        return pd.DataFrame({"pair": h[lv > 0].view(np.int64), "lv": lv[lv > 0]})

    asked = _counts(docs, True).select("h", F.shiftrightunsigned("h", 64 - SEGMENT_BITS).cast("int").alias("segment"))
    return asked.groupBy("segment").cogroup(filters.groupBy("segment")).applyInPandas(probe, "pair long, lv long")


def _cut(h: np.ndarray) -> np.ndarray:
    """Where the segments of sorted hashes begin, and the last ends."""
    bounds = np.arange(1, 1 << SEGMENT_BITS, dtype=_U) << _U(64 - SEGMENT_BITS)
    return np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])


def _blobs(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """values[cut[i]:cut[i + 1]] as binary i."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _read(blobs: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs one after the other, and where each blob begins (and the last ends)."""
    blobs = pa.concat_arrays(blobs.chunks) if blobs.num_chunks != 1 else blobs.chunk(0)
    at, data = bytes_of(blobs)
    return data[at[0] : at[-1]].view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _asked(h: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Sorted hashes and counts by segment. The segment knows its own 12 bits: the next 4 are a byte, which repeats, the rest are 6."""
    cut, raw = _cut(h), h.astype("<u8").view(np.uint8).reshape(-1, 8)
    return [_blobs(np.ascontiguousarray(raw[:, :6]), cut), _blobs(raw[:, 6] & np.uint8(15), cut), _blobs(n.astype("<u4"), cut)]


def _met(segment: int, low: pa.ChunkedArray, high: pa.ChunkedArray, n: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a segment and their counts over all runs; for what was asked, its place among them, and where each run begins."""
    top, at = _read(high, "u1")
    raw = np.zeros((len(top), 8), np.uint8)
    raw[:, :6], raw[:, 6] = _read(low, "u1")[0].reshape(-1, 6), top
    h = raw.view("<u8").ravel() | (_U(segment) << _U(64 - SEGMENT_BITS))
    distinct, which = np.unique(h, return_inverse=True)
    count = np.bincount(which, _read(n, "<u4")[0], len(distinct)).astype(np.int64)
    return distinct, count, which, at


def _distinct(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, sorted, and which of them each of run.distinct is; distinct pairs, sorted, and which of them each token ends."""
    return *np.unique(run.distinct, return_inverse=True), *np.unique(pairs(run.hashes), return_inverse=True)


def _by_segment(docs: DataFrame, train: DataFrame | Column, n: int, v: int) -> DataFrame:
    """The same where nothing is collected: runs ask, segments answer."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if isinstance(train, Column):
        own = docs.select("doc_id", text_of().alias("t"), F.coalesce(train, F.lit(False)).alias("counted"), F.lit(True).alias("scored"))
    else:
        own = docs.select("doc_id", text_of().alias("t"), F.lit(False).alias("counted"), F.lit(True).alias("scored"))
        own = own.unionAll(train.select(F.lit(None).cast(kind).alias("doc_id"), text_of(), F.lit(True), F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["run", "docs"])

        for b in batches:
            for lo, hi in runs(b.column(1), ASK):
                held.append(b.slice(lo, hi - lo))
                size += pc.sum(pc.binary_length(held[-1].column(1))).as_py() + 16 * (hi - lo)
                if size >= ASK // 2:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()

    def unpack(blob: pa.Scalar) -> pa.RecordBatch:
        return pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches()[0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for which, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = unpack(blob)
                run = Run(own.column(1))
                words, word, both, pair = _distinct(run)
                counted = np.repeat(own.column(2).to_numpy(zero_copy_only=False), run.size)
                of_words = np.bincount(word[run.codes[counted]], minlength=len(words))
                of_pairs = np.bincount(pair[counted], minlength=len(both))
                used = np.flatnonzero((np.diff(_cut(words)) > 0) | (np.diff(_cut(both)) > 0))
                columns = [pa.array(np.full(1 << SEGMENT_BITS, which)), pa.array(np.arange(1 << SEGMENT_BITS, dtype=np.int32)), *_asked(words, of_words), *_asked(both, of_pairs)]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "segment", "w0", "w1", "w2", "p0", "p1", "p2"]).take(pa.array(used))

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        segment = key[0].as_py()
        _, count, which, at = _met(segment, *(asked[c] for c in ("w0", "w1", "w2")))
        both, seen, pair, begin = _met(segment, *(asked[c] for c in ("p0", "p1", "p2")))
        held = [(segment, *build_segment(both[seen > 0], seen[seen > 0]))] if seen.any() else []
        lv = Model(np.empty(0, _U), np.empty(0, np.int64), 0, 0, held).levels(both).astype(np.uint8)
        return pa.table({"run": asked["run"], "segment": asked["segment"], "counts": _blobs(count[which], at), "levels": _blobs(lv[pair], begin)})

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        own = unpack(packed["docs"][0])
        answers = answers.sort_by("segment")
        run = Run(own.column(1))
        words, word, both, pair = _distinct(run)
        count, lv = _read(answers["counts"], "<i8")[0], _read(answers["levels"], "u1")[0].astype(np.int64)
        if packed.num_rows != 1 or len(count) != len(words) or len(lv) != len(both):
            raise RuntimeError("the documents were dealt out otherwise when they were read again")
        made = scored(run, count[word], lv[pair], n, v)
        return pa.table([own.column(0), *map(pa.array, made)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]).filter(own.column(3))

    # Both sides read this one exchange: runs are made once.
    packed = own.mapInArrow(pack, "run long, docs binary").repartition("run")
    asks = packed.mapInArrow(ask, "run long, segment int, w0 binary, w1 binary, w2 binary, p0 binary, p1 binary, p2 binary")
    answers = asks.groupBy("segment").applyInArrow(answer, "run long, segment int, counts binary, levels binary")
    return packed.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(score, f"doc_id {kind}, {_SCORE}")


def op6_lm_scoring(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    own = docs.select("doc_id", "text")
    return score_documents(own, ~held_out()).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
