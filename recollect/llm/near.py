"""Near-duplicates by order MinHash.

A text's k-mers are its runs of five words, each labelled with its occurrence, so that repeats count. For each of SKETCHES hash
functions the ELL k-mers of the smallest hashes are sampled and kept in text order; equal samples make two texts candidates.
Candidates are verified by banded alignment of their words: similarity is 1 - (edit distance in words) / (words of the longer
text), and texts of similarity 0.8 or more are linked. Classes are the connected components of the links.

Equal texts (up to white space) are one node from the start. A bucket of candidates is not spread out into pairs: first each
member is aligned with a leader of the bucket, and components are taken. Only where a bucket still spans several components are
members of different components compared too, each with each: the bucket meets itself in blocks of at most BLOCK members, and only
pairs of which neither lengths nor a bit for each word show that they are too far apart go on to be aligned. That test never drops
a similar pair, so no link between candidates is lost, however large the bucket; its work grows with the square of the texts that
share a passage. Pairs inside a component could not change a class.

Short texts have few k-mers: texts of at most SHORT words are sampled one k-mer at a time too; a text of less than five words is
one k-mer.

Defined cases: a null text is empty, and all texts without words are copies of each other; a class is named by its smallest
doc_id (null if it has none); of each class one row is kept: that of the smallest doc_id (null after all others), of several such
rows that of the smallest hash of the text, and of rows alike in doc_id and text any one; rows that share a doc_id but not their
text may be in two classes, and each class keeps its own; an empty table gives an empty table; other columns pass through
`keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KEYS, forget, keep, only, ship, text_of
from .words import hashed_words, runs, word_hashes

K, SIMILARITY = 5, 0.8
ELL, SKETCHES, SHORT = 2, 96, 40
#: A bucket that spans components meets itself in blocks of BLOCK members; a matrix of a tile has at most TILE numbers.
BLOCK, TILE = 2048, 1 << 20
#: Signatures that a task sorts at once.
FLUSH = 1_000_000

_U = np.uint64
_ODD = (np.random.default_rng(20240201).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) << _U(1)) | _U(1)
_CHUNK = 40_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of k words, with its occurrence: the second of two equal runs is another k-mer."""
    if len(h) == 0:
        return h
    with np.errstate(over="ignore"):
        k = min(k, len(h))
        x = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            x = x * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
            x ^= x >> _U(29)
        order = np.argsort(x, kind="stable")
        s = x[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        if not new.all():
            first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            nth = np.empty(len(s), _U)
            nth[order] = (np.arange(len(s)) - first).astype(_U)
            x = x + nth * _U(0xD6E8FEB86659FD93)
        return _mix(x)


def sketch(x: np.ndarray, ell: int, odd: np.ndarray) -> np.ndarray:
    """One signature for each hash function: its ell smallest k-mers in text order."""
    ell = min(ell, len(x))
    with np.errstate(over="ignore"):
        best = np.zeros((len(odd), 0), np.int64)
        for at in range(0, len(x), _CHUNK):
            part = x[at : at + _CHUNK]
            y = odd[:, None] * part[None, :]
            own = np.empty((len(odd), min(ell, len(part))), np.int64)
            for i in range(own.shape[1]):
                own[:, i] = y.argmin(axis=1)
                y[np.arange(len(odd)), own[:, i]] = _U(0xFFFFFFFFFFFFFFFF)
            best = np.hstack([best, own + at])
            if best.shape[1] > ell:
                z = odd[:, None] * x[best]
                best = np.take_along_axis(best, np.argsort(z, axis=1, kind="stable")[:, :ell], axis=1)
        best.sort(axis=1)
        sig = _mix(np.arange(len(odd), dtype=_U) + _U(ell * 1000))
        for i in range(ell):
            sig = _mix(sig * _U(0x9E3779B97F4A7C15) + x[best[:, i]])
        return sig


_NONE = np.zeros(0, _U)


def signatures_of(h: np.ndarray) -> np.ndarray:
    """The signatures of a text given by the hashes of its words."""
    x = kmers(h)
    if len(x) == 0:
        return _NONE
    out = [sketch(x, ELL, _ODD)] if len(h) >= SHORT // 2 else []
    if len(h) <= SHORT:
        out.append(sketch(x, 1, _ODD[: SKETCHES // 3]))
    return np.concatenate(out)


def signatures(words: Sequence[bytes]) -> np.ndarray:
    return signatures_of(word_hashes(words))


def within_band(a: np.ndarray, b: np.ndarray, band: int, most: int) -> int:
    """The edit distance of a and b over alignments that stay within `band` of the diagonal; over `most` once that is sure.

    For 0, 1, 2 ... edits: how far each diagonal of the band can be followed. Equal words are passed at once, by a table of the
    next difference on each diagonal; where that table would be large, row by row instead."""
    la, lb = len(a), len(b)
    far = la + lb + 1
    if abs(la - lb) > band:
        return far
    if (2 * band + 1) * (la + 1) > 4_000_000:
        return _by_rows(a, b, band, most)
    k = np.arange(-band, band + 1)
    padded = np.full(la + 2 * band + 1 + lb, -1, np.int64)
    padded[band : band + lb] = b
    same = np.lib.stride_tricks.sliding_window_view(padded, la)[: 2 * band + 1] == a if la else np.zeros((2 * band + 1, 0), bool)
    following = np.full((2 * band + 1, la + 1), la, np.int32)
    following[:, :la] = np.where(same, la, np.arange(la, dtype=np.int32))
    following = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
    end = np.minimum(la, lb - k)
    row, goal = np.arange(2 * band + 1), lb - la + band
    reach = np.full(2 * band + 1, -far)
    reach[band] = min(following[band, 0], end[band])
    edits = 0
    while reach[goal] < la:
        edits += 1
        if edits > most:
            return far
        step = reach + 1
        step[1:] = np.maximum(step[1:], reach[:-1])
        step[:-1] = np.maximum(step[:-1], reach[1:] + 1)
        step = np.minimum(step, end)
        live = (step >= 0) & (step + k >= 0)
        reach = np.where(live, np.minimum(following[row, np.where(live, step, 0)], end), -far)
    return edits


def _by_rows(a: np.ndarray, b: np.ndarray, band: int, most: int) -> int:
    la, lb = len(a), len(b)
    far = la + lb + 1
    width = 2 * band + 1
    offset = np.arange(width)
    prev = np.where(offset >= band, offset - band, far)  # row 0: j = offset - band
    prev[offset - band > lb] = far
    padded = np.full(lb + 2 * width, -1, np.int64)
    padded[width : width + lb] = b
    for i in range(1, la + 1):
        j = offset + (i - band)
        here = padded[width + i - band - 1 : width + i - band - 1 + width]  # b[j - 1]
        cur = prev + (here != a[i - 1])
        cur[:-1] = np.minimum(cur[:-1], prev[1:] + 1)
        cur[(j < 0) | (j > lb)] = far
        if i <= band:
            cur[band - i] = i
        cur = np.minimum.accumulate(cur - offset) + offset
        cur[(j < 0) | (j > lb)] = far
        if cur.min() > most:
            return far
        prev = cur
    return int(prev[lb - la + band])


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the similarity of two word sequences reaches the threshold. Bands widen until one shows it or none can."""
    la, lb = len(a), len(b)
    longest = max(la, lb)
    most = int((1 - similarity) * longest + 1e-9)
    if abs(la - lb) > most:
        return False
    if la == lb and int((a != b).sum()) <= most:  # the band of width 0
        return True
    bins = 4096 if longest > 256 else 512
    gap = np.bincount(a & (bins - 1), minlength=bins) - np.bincount(b & (bins - 1), minlength=bins)
    if max(int(gap[gap > 0].sum()), -int(gap[gap < 0].sum())) > most:  # words that no alignment can match
        return False
    short = min(la, lb)
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    short -= head
    if short:
        same = a[::-1][:short] == b[::-1][:short]
        tail = short if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    band = min(most, abs(la - lb) + 8)
    while True:
        if within_band(a, b, band, most) <= most:
            return True
        if band >= most:
            return False
        band = min(most, 4 * band)


def components(links: DataFrame) -> DataFrame:
    """tid, comp for each node of links (a, b): comp is the smallest node of its component. Alternating stars, each round kept."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, keep(small.where("u <> v").distinct())
        forget(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("tid"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("tid"), F.col("v").alias("comp")).distinct())


# Candidates --------------------------------------------------------------------------------------------------------------


def identity(h: np.ndarray) -> int:
    """A text's number, by its words alone."""
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, raw (hash of the text as it is), tid (hash of its words), sigs: a row for each row of docs. Of copies that a task meets
    the first alone has signatures."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo, hi in runs(b.column(2)):
                at, h = hashed_words(b.column(2).slice(lo, hi - lo))
                tids, sigs = [], []
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    tid = identity(h[s:e])
                    tids.append(tid)
                    sigs.append(_NONE if tid in seen else signatures_of(h[s:e]))
                    seen.add(tid)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sigs])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in (0, 1)), pa.array(tids, pa.int64()), lists], names=["doc_id", "raw", "tid", "sigs"])

    own = docs.select("doc_id", F.xxhash64(text_of()).alias("raw"), text_of().alias("t"))
    return own.mapInArrow(sketches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw long, tid long, sigs array<long>")


def buckets(sketches: DataFrame) -> DataFrame:
    """sig, tid, lead of the texts that share a signature with another: lead is a member of the bucket, its first as far as a task or
    the place where the bucket meets can tell, so that the pairs (lead, tid) of a bucket connect it.

    A task brings one row of a bucket to the place where the bucket meets: its other members, which have found a partner already,
    are dealt out by themselves."""

    def within_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            sig, tid = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((tid, sig))
            sig, tid = sig[order], tid[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (tid[1:] != tid[:-1])
            sig, tid = sig[new], tid[new]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            at = np.flatnonzero(first)
            many = np.repeat(np.diff(np.append(at, len(sig))), np.diff(np.append(at, len(sig)))) > 1
            lead = tid[np.repeat(at, np.diff(np.append(at, len(sig))))]
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(tid), pa.array(lead, mask=~many)], names=["sig", "tid", "lead"])

        for b in batches:
            ends = b.column("sigs").offsets.to_numpy()
            parts.append((b.column("sigs").flatten().to_numpy(), np.repeat(b.column("tid").to_numpy(), np.diff(ends))))
            size += len(parts[-1][0])
            if size >= FLUSH:
                yield out()
                parts, size = [], 0
        if size:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of sig, tid; the last bucket of a batch may go on in the next one."""
        open_sig = open_lead = None
        wait: int | None = None  # a text that is alone in its bucket so far
        for b in batches:
            sig, tid = b.column("sig").to_numpy(), b.column("tid").to_numpy()
            found, lead = b.column("lead").is_valid().to_numpy(zero_copy_only=False), pc.fill_null(b.column("lead"), 0).to_numpy()
            apart = found & (lead != tid)  # dealt out by themselves
            outs = [(sig[apart], tid[apart], lead[apart])]
            sig, tid, found = sig[~apart], tid[~apart], found[~apart]
            if len(sig):
                if wait is not None:
                    sig, tid, found = np.append(open_sig, sig), np.append(wait, tid), np.append(False, found)
                first = np.ones(len(sig), bool)
                first[1:] = sig[1:] != sig[:-1]
                goes_on = wait is None and open_sig is not None and sig[0] == open_sig
                at = np.flatnonzero(first)
                size = np.diff(np.append(at, len(sig)))
                own = tid[at]
                if goes_on:
                    own[0] = open_lead
                lead = np.repeat(own, size)
                several = np.repeat((np.maximum.reduceat(tid, at) != own) | np.logical_or.reduceat(found, at), size)
                open_sig, open_lead = sig[-1], own[-1]
                last = slice(at[-1], None)
                wait = None
                if not several[-1]:  # one text so far, and no task has found it a partner
                    wait = int(tid[-1])
                    several[last] = False
                outs.append((sig[several], tid[several], lead[several]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*outs, strict=True)], names=["sig", "tid", "lead"])

    rows = sketches.where(F.size("sigs") > 0).select("tid", "sigs").mapInArrow(within_task, "sig long, tid long, lead long")
    apart = F.col("lead").isNotNull() & (F.col("lead") != F.col("tid"))
    dealt = rows.repartition(F.when(apart, F.xxhash64("sig", "tid")).otherwise(F.col("sig"))).sortWithinPartitions("sig", "tid")
    return dealt.mapInArrow(meet, "sig long, tid long, lead long")


def presence(words: np.ndarray) -> bytes:
    """A bit for each word of a text, in four to eight times as many bits as it has words."""
    size = 1 << max(6, int(4 * len(words) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[words & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _unpacked(bits: list[bytes], size: int) -> np.ndarray:
    """Rows of `size` zeros and ones; longer rows are folded."""
    own = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
    return own.reshape(len(bits), -1, size).max(axis=1).astype(np.float32)


def near_enough(n: np.ndarray, comp: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of left and right that lie in different components and that neither their lengths nor their bits show to be
    further apart than the similarity allows: a bit that only one of two texts has stands for a word without a partner. All pairs of
    a tile are one matrix product."""
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.fromiter((8 * len(x) for x in bits), np.int64, len(bits))
    left, right = left[np.lexsort((n[left], size[left]))], right[np.lexsort((n[right], size[right]))]
    for d in np.unique(size[left]):
        lefts = left[size[left] == d]
        for other in (d // 2, d, 2 * d):
            rights = right[size[right] == other]
            width = int(min(d, other))
            tile = int(np.clip(TILE // width, 1, 1024))
            nr = n[rights]
            for at in range(0, len(lefts) if len(rights) else 0, tile):
                i = lefts[at : at + tile]
                lo, hi = np.searchsorted(nr, [int(similarity * n[i[0]]) - 1, int(n[i[-1]] / similarity) + 2])
                a = _unpacked([bits[k] for k in i], width) if hi > lo else None
                for start in range(lo, hi, tile):
                    j = rights[start : min(hi, start + tile)]
                    b = _unpacked([bits[k] for k in j], width)
                    gap = np.maximum(a.sum(axis=1)[:, None], b.sum(axis=1)[None, :]) - a @ b.T
                    most = np.floor((1 - similarity) * np.maximum(n[i][:, None], n[j][None, :]) + 1e-9)
                    fit = (gap <= most) & (np.abs(n[i][:, None] - n[j][None, :]) <= most) & (comp[i][:, None] != comp[j][None, :])
                    x, y = np.nonzero(fit)
                    found_i.append(i[x])
                    found_j.append(j[y])
    return np.concatenate(found_i), np.concatenate(found_j)


def by_cell(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that come in the order of their column cell: work gets whole cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key = t.column("cell").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield from work(t.slice(0, last).combine_chunks())
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield from work(rest.combine_chunks())

    return run


def _cuts(key: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return zip(cut[:-1], cut[1:], strict=True)


def across(spread: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): links inside the buckets of spread (sig, tid, comp, size) that join components.

    Buckets meet themselves in blocks: a member of block x goes to the cells (x, y) of all blocks y, and a cell is two blocks at most,
    whatever the bucket. A pair that shares several signatures is looked at under the least of them alone. What goes on from a cell are
    its members that have a partner which may be similar, each with the list of its partners: a row a member, not a row a pair. Then the
    words of these members come to the cell and pairs are aligned there, but for those whose components other pairs of the cell have
    joined by then."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.frombuffer(w, np.uint32) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array([len(x) for x in h], pa.int32()), pa.array([presence(x.astype(np.int64)) for x in h], pa.binary())], names=["tid", "n", "bits"])

    def meet(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ("cell", "sig", "tid", "n", "comp", "block", "x", "y")
        key, sig, tid, n, comp, block, x, y = (cells.column(c).to_numpy() for c in names)
        bits, sigs, n = cells.column("bits").to_pylist(), cells.column("sigs").combine_chunks(), n.astype(np.int64)
        rows: list[tuple[int, list[int]]] = []
        for lo, hi in _cuts(key):
            inner = x[lo] == y[lo]
            first = np.flatnonzero(block[lo:hi] == x[lo])
            i, j = near_enough(n[lo:hi], comp[lo:hi], bits[lo:hi], first, first if inner else np.flatnonzero(block[lo:hi] != x[lo]), similarity)
            if inner:
                i, j = i[i < j], j[i < j]
            own = {k: frozenset(sigs[lo + k].values.to_numpy().tolist()) for k in np.unique(np.concatenate([i, j])).tolist()}
            partners: dict[int, list[int]] = {}
            least = int(sig[lo])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if min(own[a] & own[b]) == least:
                    partners.setdefault(a, []).append(int(tid[lo + b]))
                    partners.setdefault(b, [])
            rows += [(lo + k, others) for k, others in partners.items()]
        at = pa.array([k for k, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*(cells.column(c).combine_chunks().take(at) for c in ("cell", "tid", "comp")), pa.array([o for _, o in rows], pa.list_(pa.int64()))], names=["cell", "tid", "comp", "others"])

    def align(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        key, tid, comp = (cells.column(c).to_numpy() for c in ("cell", "tid", "comp"))
        others, packed = cells.column("others").combine_chunks(), cells.column("words").combine_chunks()
        links: list[tuple[int, int]] = []
        for lo, hi in _cuts(key):
            place = {t: lo + k for k, t in enumerate(tid[lo:hi].tolist())}
            up = {c: c for c in comp[lo:hi].tolist()}

            def top(c: int) -> int:
                while up[c] != c:  # noqa: B023
                    up[c] = c = up[up[c]]  # noqa: B023
                return c

            h = lambda k: np.frombuffer(packed[k].as_buffer(), np.uint32).astype(np.int64)
            for k in range(lo, hi):
                own = None
                for t in others[k].as_py():
                    j = place[t]
                    a, b = top(int(comp[k])), top(int(comp[j]))
                    if a != b:
                        own = h(k) if own is None else own
                        if similar(own, h(j), similarity):
                            up[a] = b
                            links.append((min(int(tid[k]), t), max(int(tid[k]), t)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = spread.withColumn("block", F.pmod(F.xxhash64("tid", "sig"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "tid", "comp")
    lists = spread.groupBy("tid").agg(F.collect_list("sig").alias("sigs"))  # SKETCHES and a third of them at most
    members = words.select("tid", "words").mapInArrow(present, "tid long, n int, bits binary").join(lists, "tid")
    met = placed.join(members, "tid").withColumn("cell", F.xxhash64("sig", "x", "y")).repartition("cell").sortWithinPartitions("cell")
    met = met.select("cell", "sig", "x", "y", "block", "tid", "n", "comp", "bits", "sigs")
    found = keep(met.mapInArrow(by_cell(meet), "cell long, tid long, comp long, others array<long>"))
    ready = found.join(words, "tid").repartition("cell").sortWithinPartitions("cell").select("cell", "tid", "comp", "others", "words")
    links = keep(ready.mapInArrow(by_cell(align), "a long, b long"))
    forget(found)
    return links


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words, from texts (tid, words as 32-bit hashes), align well enough."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            good = [similar(*(np.frombuffer(c[k].as_buffer(), np.uint32).astype(np.int64) for c in (x, y)), similarity) for k in range(len(b))]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("tid").alias("a"), F.col("words").alias("x"))
    right = texts.select(F.col("tid").alias("b"), F.col("words").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(align, "a long, b long")


def words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """tid, words (32-bit hashes) of the texts whose raw hash is in wanted (raw)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in runs(b.column(0)):
                at, h = hashed_words(b.column(0).slice(lo, hi - lo))
                texts = [h[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([identity(x) for x in texts], pa.int64()), pa.array([x.astype(np.uint32).tobytes() for x in texts], pa.binary())], names=["tid", "words"])

    few = F.broadcast(wanted) if wanted.count() <= MOST_KEYS else wanted
    own = docs.select(F.xxhash64(text_of()).alias("raw"), text_of().alias("t")).join(few, "raw", "left_semi")
    return own.select("t").mapInArrow(pack, "tid long, words binary").dropDuplicates(["tid"])


def text_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, raw, tid of each row of docs, and tid, comp of each text that has a link."""
    ship(docs.sparkSession)
    sketches = keep(sketched(docs))
    texts = keep(sketches.select("doc_id", "raw", "tid"))
    members = keep(buckets(sketches))
    forget(sketches)
    stars = keep(members.where("lead <> tid").select(F.least("lead", "tid").alias("a"), F.greatest("lead", "tid").alias("b")).distinct())
    # One raw text for each text that has a candidate.
    wanted = keep(texts.join(members.select("tid").distinct(), "tid", "left_semi").groupBy("tid").agg(F.min("raw").alias("raw")).select("raw"))
    words = keep(words_of(docs, wanted))
    links = keep(verified(stars, words, similarity))
    comps = keep(components(links))
    # Buckets that still span components: align across, never within.
    placed = members.select("sig", "tid").distinct().join(comps, "tid", "left").select("sig", "tid", F.coalesce("comp", "tid").alias("comp"))
    open_ = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    spread = keep(placed.join(open_.select("sig", "size"), "sig"))
    forget(members, links)
    more = across(spread, words, similarity)
    forget(spread, words, stars, wanted)
    if more.isEmpty():
        return texts, comps
    found = keep(components(comps.select(F.col("tid").alias("a"), F.col("comp").alias("b")).unionByName(more)))
    forget(comps, more)
    return texts, found


def rows_of_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, raw, class_id, class_size, kept for each row of docs."""
    texts, found = text_classes(docs.select("doc_id", "text"), similarity)
    rows = keep(texts.join(found, "tid", "left").select("doc_id", "raw", F.coalesce("comp", "tid").alias("comp"), F.monotonically_increasing_id().alias("row")))
    forget(texts, found)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw", "row")).alias("first")
    named = keep(rows.groupBy("comp").agg(first, F.count(F.lit(1)).alias("class_size")))  # written: Spark splits a join's hot key only beside a scan
    return rows.join(named, "comp").select("doc_id", "raw", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept for each row of docs: one row of a class is kept."""
    return rows_of_classes(docs, similarity).drop("raw")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, with its own columns: that of the smallest doc_id."""
    return only(docs, rows_of_classes(docs, similarity))


def op4_order_minhash(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return classes(docs.select("doc_id", "text"))


def edit_similarity(a: Sequence, b: Sequence) -> float:
    """By the full table, for tests."""
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return 1 - prev[-1] / max(1, len(a), len(b))
