"""Rows of two tables that meet all with all, within groups if asked: both sides are cut into parts, each pair of parts is a cell of its own.

A cell holds one part of the left side and meets the right side chunk by chunk, so that memory is bounded by a part, and cells are dealt
out over the tasks whatever their group. How vectors meet is a worker's: made of the left part, given chunks of the right one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..store import keep, ship

#: Rows of a packed block; most rows of a part at 128 dimensions or fewer, and the least if there are several; parts are made smaller until
#: there are this many cells; rows of a chunk of the right side, and of a tile of the left part that meets it at once.
BLOCK, MOST, LEAST, CELLS, CHUNK, TILE = 512, 32_768, 4096, 256, 4096, 512


class Side:
    """Rows of one side: ids, vectors as they came (NaN where null), and whatever further numbers were asked for."""

    def __init__(self, blocks: list[tuple]):
        self.ids = np.concatenate([b[0] for b in blocks])
        if len(widths := {b[1].shape[1] for b in blocks}) > 1:
            raise ValueError(f"vectors of {' and '.join(map(str, sorted(widths)))} dimensions")
        self.vectors = np.concatenate([b[1] for b in blocks]).astype(np.float64)
        self.more = [np.concatenate([b[2][i] for b in blocks]) for i in range(len(blocks[0][2]))]

    def take(self, rows: np.ndarray) -> None:
        self.ids, self.vectors, self.more = self.ids[rows], self.vectors[rows], [x[rows] for x in self.more]

    def unit(self) -> Side:
        """Vectors of length 1 (or 0) in double and single precision; rows that are not all numbers go, as they are similar to nothing."""
        fine = np.isfinite(self.vectors).all(axis=1)
        if not fine.all():
            self.take(np.flatnonzero(fine))
        n = np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.vectors = np.divide(self.vectors, n, out=np.zeros_like(self.vectors), where=n > 0)
        self.single = self.vectors.astype(np.float32)
        return self


def margin(width: int, digits: int) -> float:
    """How far a product of unit vectors in single precision may be from its value rounded to so many digits."""
    return (width + 16) * 2.0**-23 + 0.6 * 10.0**-digits


def exact(left: Side, at: int, right: Side, row: np.ndarray, col: np.ndarray, digits: int) -> np.ndarray:
    """Cosines in double precision of chosen pairs of a tile of the left side (from `at` on) and the right side; of many, by one product."""
    if len(row) * 64 > TILE * len(right.ids):
        s = (left.vectors[at : at + TILE] @ right.vectors.T)[row, col]
    else:
        s = np.einsum("ij,ij->i", left.vectors[at + row], right.vectors[col])
    return np.round(s, digits) + 0.0


def packed(df: DataFrame, keys: list[str], key: str = "id", vector: str = "embedding", more: tuple[str, ...] = ()) -> DataFrame:
    """keys..., n, width, single, ids, vectors, m0 ...: blocks of rows of the same keys, written so that they stay as they are. Rows without a
    key, an id or a vector are left out."""
    ship(df.sparkSession)
    single = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    rows = df.select(*keys, F.col(key).cast("long").alias("k"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("v"), *(F.col(m).cast("long").alias(f"m{i}") for i, m in enumerate(more)))
    for c in [*keys, "k", "v"]:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.withColumn("_g", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    n_more = len(more)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            widths = np.diff(v.offsets.to_numpy())
            values = v.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
            starts = np.concatenate([[0], np.cumsum(widths)])
            _, first, code = np.unique(np.char.add(np.char.add(widths.astype(str), " "), np.asarray(b.column("_g").to_pylist(), dtype=str)), return_index=True, return_inverse=True)
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code))
            ids, ms = b.column("k").to_numpy(), [b.column(f"m{i}").to_numpy() for i in range(n_more)]
            out: dict[str, list] = {c: [] for c in ("at", "n", "width", "single", "ids", "vectors", *(f"m{i}" for i in range(n_more)))}
            for g, end in enumerate(ends):
                own, w = order[(ends[g - 1] if g else 0) : end], int(widths[first[g]])
                for at in range(0, len(own), BLOCK):
                    part = own[at : at + BLOCK]
                    m = values[starts[part][:, None] + np.arange(w)[None, :]]
                    for c, x in {"at": int(first[g]), "n": len(part), "width": w, "single": single, "ids": ids[part].tobytes(), "vectors": m.tobytes()}.items():
                        out[c].append(x)
                    for i in range(n_more):
                        out[f"m{i}"].append(ms[i][part].tobytes())
            head = [b.column(c).take(pa.array(out["at"], pa.int32())) for c in keys]
            cols = [pa.array(out["n"], pa.int64()), pa.array(out["width"], pa.int32()), pa.array(out["single"], pa.bool_()), *(pa.array(out[c], pa.binary()) for c in ("ids", "vectors", *(f"m{i}" for i in range(n_more))))]
            yield pa.RecordBatch.from_arrays([*head, *cols], names=[*keys, "n", "width", "single", "ids", "vectors", *(f"m{i}" for i in range(n_more))])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys) + "n long, width int, single boolean, ids binary, vectors binary" + "".join(f", m{i} binary" for i in range(n_more))
    return keep(rows.mapInArrow(pack, kinds))


def meet(left: DataFrame, right: DataFrame, keys: list[str], make: Callable[[Side, bool], object], schema: str, half: bool = False, most: int = MOST) -> DataFrame:
    """What the workers make of packed rows of equal keys. half: both sides are the same table and a pair of parts meets once; `make` is told
    whether a cell's two parts are the same."""
    ship(left.sparkSession)
    n_more = len([c for c in left.columns if c[0] == "m" and c[1:].isdigit()])
    size = lambda df, n: df.groupBy(*keys).agg(F.sum("n").cast("double").alias(n), F.max("width").alias(f"w{n}"))
    a, b = size(left, "_nl"), size(right, "_nr")
    both = keep(a.join(b, keys) if keys else a.crossJoin(b).where("_nl is not null and _nr is not null"))
    pairs, width = both.agg(F.sum(F.col("_nl") * F.col("_nr")), F.max(F.greatest("w_nl", "w_nr"))).first()
    rows = int(min(most, max(64, 2**22 // max(width or 1, 1)), max(LEAST, ((pairs or 0) / CELLS) ** 0.5)))
    parts = both.select(*keys, F.ceil(F.col("_nl") / rows).cast("int").alias("_lp"), F.ceil(F.col("_nr") / rows).cast("int").alias("_rp"))
    cells = parts.agg(F.sum(F.col("_lp").cast("long") * F.col("_rp"))).first()[0] or 0
    cut = parts.where("_lp > 1 or _rp > 1")  # no more than there are parts

    def dealt(df: DataFrame, side: int) -> DataFrame:
        known = df.join(F.broadcast(cut), keys, "left") if keys else df.crossJoin(F.broadcast(parts))
        own, other = ("_lp", "_rp") if side == 0 else ("_rp", "_lp")
        part = F.pmod(F.xxhash64("ids"), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
        first, last = F.lit(0), F.coalesce(other, F.lit(1)) - 1
        first, last = (F.col("_own") if half and side == 0 else first), (F.col("_own") if half and side == 1 else last)
        known = known.withColumn("_own", part).withColumn("_other", F.explode(F.sequence(first, last)))
        l, r = ("_own", "_other") if side == 0 else ("_other", "_own")
        cell = F.to_json(F.struct(*keys, F.col(l).alias("_l"), F.col(r).alias("_r")))
        return known.select(cell.alias("cell"), (F.col(l) == F.col(r)).alias("same"), F.lit(side).alias("side"), "width", "single", "ids", "vectors", *(f"m{i}" for i in range(n_more)))

    def block(b: pa.RecordBatch, i: int) -> tuple:
        get = lambda c: b.column(c)[i].as_buffer()
        kind, width = (np.float32 if b.column("single")[i].as_py() else np.float64), b.column("width")[i].as_py()
        ids = np.frombuffer(get("ids"), np.int64)
        return ids, np.frombuffer(get("vectors"), kind).reshape(len(ids), width), [np.frombuffer(get(f"m{j}"), np.int64) for j in range(n_more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, same, own, chunk, held, worker = None, False, [], [], 0, None

        def fed() -> Iterator[pa.RecordBatch]:
            nonlocal worker, own, chunk, held
            if worker is None and own and chunk:
                worker, own = make(Side(own), same), []
            if worker is not None and chunk:
                yield from worker.add(Side(chunk))
            chunk, held = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal worker
            yield from fed()
            if worker is not None:
                yield from worker.done()
                worker = None

        for b in batches:
            cells_, sides, sames = b.column("cell").to_pylist(), b.column("side").to_pylist(), b.column("same").to_pylist()
            for i in range(b.num_rows):
                if cells_[i] != now:
                    yield from done()
                    now, same, own = cells_[i], sames[i], []
                if sides[i] == 0:
                    own.append(block(b, i))
                    continue
                chunk.append(block(b, i))
                held += len(chunk[-1][0])
                if held >= CHUNK - BLOCK // 2:
                    yield from fed()
        yield from done()

    tasks = max(1, min(int(cells) * 3 if cells > 1 else 1, max(int(cells), 192), 4096))  # as many as cells would give some tasks several of few
    met = dealt(left, 0).unionByName(dealt(right, 1)).repartition(tasks, "cell").sortWithinPartitions("cell", "side")
    return met.mapInArrow(run, schema)


def batches(names: list[str], arrays: list[np.ndarray], rows: int = 500_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(arrays[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + rows]) for x in arrays], names=names)


class Best:
    """The k best of the right side for each row of the left part, from the threshold on; of equal scores the smallest id; never a row of
    the same id. Products in single precision tell which pairs can count; only those are worked out in double precision and rounded."""

    def __init__(self, left: Side, k: int, threshold: float, digits: int, names: list[str]):
        self.left, self.k, self.threshold, self.digits, self.names = self.prepared(left), k, threshold, digits, names
        n = len(self.left.ids)
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def prepared(self, side: Side) -> Side:
        return side.unit()

    def rough(self, at: int, right: Side) -> tuple[np.ndarray, float]:
        """Scores of a tile, and how far off they may be."""
        return self.left.single[at : at + TILE] @ right.single.T, margin(right.vectors.shape[1], self.digits)

    def sure(self, at: int, right: Side, s: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return exact(self.left, at, right, row, col, self.digits)

    def add(self, right: Side) -> Iterator[pa.RecordBatch]:
        right = self.prepared(right)
        order = np.argsort(right.ids, kind="stable")
        by_id = right.ids[order]
        for at in range(0, len(self.left.ids), TILE):
            own = self.left.ids[at : at + TILE]
            s, off = self.rough(at, right)
            low, high = np.searchsorted(by_id, own, "left"), np.searchsorted(by_id, own, "right")
            for i in np.flatnonzero(high > low):
                s[i, order[low[i] : high[i]]] = -np.inf
            least = np.maximum(self.score[at : at + TILE, -1], self.threshold) - off
            if s.shape[1] > self.k and np.isneginf(self.score[at : at + TILE, -1]).any():
                least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * off)
            row, col = np.divmod(np.flatnonzero(s >= least[:, None].astype(s.dtype)), s.shape[1])
            if len(row):
                score = self.sure(at, right, s, row, col)
                fits = score >= self.threshold
                self.merge(at + row[fits], score[fits], right.ids[col[fits]])
        return iter(())

    def merge(self, row: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        u = np.unique(row)
        r = np.concatenate([np.repeat(u, self.k), row])
        s, i = np.concatenate([self.score[u].ravel(), score]), np.concatenate([self.id[u].ravel(), id_])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        first = place < self.k
        self.score[r[first], place[first]], self.id[r[first], place[first]] = s[first], i[first]

    def done(self) -> Iterator[pa.RecordBatch]:
        row, place = np.nonzero(self.score > -np.inf)
        yield from batches(self.names, [self.left.ids[row], self.id[row, place], self.score[row, place]])


class BestMasked(Best):
    """Best over the dimensions that a left row knows (those that are not NaN), all in double precision."""

    def prepared(self, side: Side) -> Side:
        side.known = ~np.isnan(side.vectors)
        side.vectors = np.where(side.known, side.vectors, 0.0)
        return side

    def rough(self, at: int, right: Side) -> tuple[np.ndarray, float]:
        p, known, e = self.left.vectors[at : at + TILE], self.left.known[at : at + TILE], right.vectors
        own = np.linalg.norm(p, axis=1)[:, None]
        e2 = e * e
        other = np.sqrt(e2 @ known[0])[None, :] if (known == known[0]).all() else np.sqrt(known.astype(np.float64) @ e2.T)
        n = own * other
        return np.divide(p @ e.T, n, out=np.zeros((len(p), len(e))), where=n > 0), 0.6 * 10.0**-self.digits

    def sure(self, at: int, right: Side, s: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return np.round(s[row, col], self.digits) + 0.0


class Links:
    """a, b (a < b), score of the pairs from the threshold on, each pair of rows once."""

    def __init__(self, left: Side, same: bool, threshold: float, digits: int):
        self.left, self.same, self.threshold, self.digits = left.unit(), same, threshold, digits

    def add(self, right: Side) -> Iterator[pa.RecordBatch]:
        right = right.unit()
        least = np.float32(self.threshold - margin(right.vectors.shape[1], self.digits))
        for at in range(0, len(self.left.ids), TILE):
            row, col = np.divmod(np.flatnonzero(self.left.single[at : at + TILE] @ right.single.T >= least), len(right.ids))
            x, y = self.left.ids[at + row], right.ids[col]
            few = np.flatnonzero(x < y if self.same else x != y)
            score = exact(self.left, at, right, row[few], col[few], self.digits)
            fits = score >= self.threshold
            x, y = x[few][fits], y[few][fits]
            yield from batches(["a", "b", "score"], [np.minimum(x, y), np.maximum(x, y), score[fits]])

    def done(self) -> Iterator[pa.RecordBatch]:
        return iter(())
