"""Substring de-duplication by difference-cover anchors.

A difference cover D of the numbers modulo PERIOD holds, for any distance, two of its members that far apart; so for any two
positions i, j there is a shift below PERIOD that takes both into D. Windows of WINDOW - PERIOD + 1 words are hashed only where
the position modulo PERIOD is in D. If a window of WINDOW words occurs twice, some anchor inside it is aligned in both places,
so both places have an anchor whose hash occurs twice. From such anchors the windows of full length around them are extended
to: these (and no others) are hashed over all their words, and a window whose 96-bit hash occurs twice is a repeat.

No pairs are made. A row is one place of one hash; a task first meets its own copies: of places that share a hash inside a task
one goes on for all with weight 2, and the others are known repeats that need no partner (weight 0, dealt out by themselves).
So a hash brings at most a row a task to the place where it is counted, however many rows hold it.

Defined cases: a null text has no words; texts shorter than the window are left as they are; rows that repeat a document (with
its doc_id) repeat its windows, so they lose them; a doc_id of any type, null too, comes back as it was; windows are judged on the
input; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_KEYS, keep, ship, text_of
from .words import hashed_words, runs, split_words

WINDOW = 35
#: A perfect difference set modulo 21: every distance from 1 to 20 is the difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_FLUSH = 3_000_000


class Rolling:
    """Hashes of any windows of a sequence, from prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base = base | 1
        self._grow(1024)

    def _grow(self, n: int) -> None:
        inverse = pow(self.base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)

    def windows(self, h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        if len(h) > len(self.up):
            self._grow(2 * len(h))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])
            x = (sums[at + length] - sums[at]) * self.down[at]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            return x ^ (x >> np.uint64(29))


_FIRST, _SECOND = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)


def anchor_places(n_words: int, window: int, period: int, cover: Sequence[int]) -> np.ndarray:
    """Positions of a text at which an anchor window is hashed."""
    if n_words < window:
        return np.zeros(0, np.int64)
    last = n_words - (window - period + 1)
    at = (np.arange(0, last + 1, period)[:, None] + np.array(cover)[None, :]).ravel()
    return at[at <= last]


def candidate_starts(anchors: np.ndarray, n_words: int, window: int, period: int) -> np.ndarray:
    """Starts of the full windows that hold one of the anchors whole."""
    mark = np.zeros(n_words - window + 2, np.int64)
    np.add.at(mark, np.clip(anchors - period + 1, 0, n_words - window + 1), 1)
    np.add.at(mark, np.clip(anchors + 1, 0, n_words - window + 1), -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """For each word whether a window from starts covers it."""
    mark = np.zeros(n_words + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark[:-1]) > 0


_PLACES = "g long, g2 int, w int, key long, at int"


def _meet(parts: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]) -> pa.RecordBatch:
    """Places (hash, second hash, key, positions) of one task with weights, as the module says."""
    g = np.concatenate([p[0] for p in parts])
    g2 = np.concatenate([p[1] for p in parts])
    key = np.concatenate([np.full(len(p[3]), p[2], np.int64) for p in parts])
    at = np.concatenate([p[3] for p in parts]).astype(np.int32)
    order = np.lexsort((g2, g))
    a, b = g[order], g2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    w = np.where(new, 1, 0).astype(np.int32)
    w[new] = np.minimum(size, 2)
    weight = np.empty(len(order), np.int32)
    weight[order] = w
    lone = weight == 0
    with np.errstate(over="ignore"):
        apart = (key.view(np.uint64) + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    columns = [np.where(lone, apart, g).view(np.int64), np.where(lone, 0, g2).astype(np.int32), weight, key, at]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "g2", "w", "key", "at"])


def _repeats(places: DataFrame) -> DataFrame:
    """key, at of the places whose hash occurs twice or more."""
    n = F.sum("w").over(Window.partitionBy("g", "g2"))
    return places.withColumn("n", n).where("n > 1 or w = 0").select("key", "at")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("t")).withColumn("key", F.xxhash64("doc_id", "t"))


def _with_places(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of keyed that have places, with them; only those rows are shuffled if their keys are few enough to broadcast."""
    if places.count() <= MOST_KEYS:
        keyed = keyed.join(F.broadcast(places.select("key")), "key", "left_semi")
    return keyed.join(places, "key")


def repeated_starts(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: Sequence[int] = COVER) -> DataFrame:
    """key (hash of doc_id and text) and starts (array of the positions of all windows that occur elsewhere too)."""
    ship(docs.sparkSession)
    short = window - period + 1
    none = np.zeros(0, np.int32)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            for lo, hi in runs(b.column("t")):
                ends, hashes = hashed_words(b.column("t").slice(lo, hi - lo))
                for key, s, e in zip(b.column("key").slice(lo, hi - lo).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    at = anchor_places(e - s, window, period, cover)
                    if len(at):
                        parts.append((_FIRST.windows(hashes[s:e], at, short), np.zeros(len(at), np.int32), key, at))
                        n += len(at)
                if n >= _FLUSH:
                    yield _meet(parts)
                    parts, n = [], 0
        if parts:
            yield _meet(parts)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            for lo, hi in runs(b.column("t")):
                ends, hashes = hashed_words(b.column("t").slice(lo, hi - lo))
                found = b.column("places").slice(lo, hi - lo)
                for k, (key, s, e) in enumerate(zip(b.column("key").slice(lo, hi - lo).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    at = candidate_starts(np.unique(found[k].values.to_numpy().astype(np.int64)), e - s, window, period)
                    h = hashes[s:e]
                    parts.append((_FIRST.windows(h, at, window), _SECOND.windows(h, at, window).astype(np.uint32).view(np.int32), key, at))
                    n += len(at)
                    if n >= _FLUSH:
                        yield _meet(parts)
                        parts, n = [], 0
        if parts:
            yield _meet(parts)

    keyed = _keyed(docs)
    met = _repeats(keyed.select("key", "t").mapInArrow(anchors, _PLACES))
    met = keep(met.groupBy("key").agg(F.collect_list("at").alias("places")))
    full = _repeats(_with_places(keyed.select("key", "t"), met).mapInArrow(windows, _PLACES))
    return keep(full.groupBy("key").agg(F.collect_set("at").alias("starts")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: Sequence[int] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of docs."""
    starts = repeated_starts(docs, window, period, cover)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in runs(b.column("t")):
                part = b.slice(lo, hi - lo)
                ends, codes, words = split_words(part.column("t"))
                gone = np.zeros(len(codes), bool)
                if "starts" in b.schema.names:
                    for k in np.flatnonzero(part.column("starts").is_valid().to_numpy(zero_copy_only=False)).tolist():
                        gone[ends[k] : ends[k + 1]] = covered(part.column("starts")[k].values.to_numpy().astype(np.int64), int(ends[k + 1] - ends[k]), window)
                left = np.concatenate([[0], np.cumsum(~gone)])[ends]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(codes[~gone]))), " ")
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), kept], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept string"
    keyed = _keyed(docs)
    if starts.count() <= MOST_KEYS:
        clean = keyed.join(F.broadcast(starts.select("key")), "key", "left_anti")
        cut_rows = _with_places(keyed, starts).select("doc_id", "t", "starts").mapInArrow(cut, schema)
        return clean.select("doc_id", "t").mapInArrow(cut, schema).unionByName(cut_rows)
    return keyed.join(starts, "key", "left").select("doc_id", "t", "starts").mapInArrow(cut, schema)


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest of `remove_repeats`."""
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: Sequence[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """What op9 must say of (doc_id, text) rows, by counting all windows."""
    from collections import Counter

    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out
