"""Effects of memory on memory: interference, priming, reconsolidation. Time windows meet by buckets, never by all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import _c, clamp
from . import cells


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def within(left: DataFrame, right: DataFrame, hours: float, by: list[str] | None = None, when: str = "when") -> DataFrame:
    """Pairs with l.when - hours <= r.when < l.when (r before l), matched by `by` too. Columns become l and r structs.

    Time is cut into buckets as long as the window; a left row meets its own bucket and the one before."""
    size = int(hours * 3.6e9)
    a = left.withColumn("_t", _micros(when)).withColumn("_b", F.explode(F.array(F.floor(F.col("_t") / size), F.floor(F.col("_t") / size) - 1)))
    b = right.withColumn("_t", _micros(when)).withColumn("_b", F.floor(F.col("_t") / size))
    a = a.select(*(F.col(c).alias(f"_k_{c}") for c in by or []), "_b", F.col("_t").alias("_lt"), F.struct(*left.columns).alias("l"))
    b = b.select(*(F.col(c).alias(f"_k_{c}") for c in by or []), "_b", F.col("_t").alias("_rt"), F.struct(*right.columns).alias("r"))
    met = a.join(b, [f"_k_{c}" for c in by or []] + ["_b"])
    return met.where((F.col("_rt") < F.col("_lt")) & (F.col("_rt") >= F.col("_lt") - size)).select("l", "r", ((F.col("_lt") - F.col("_rt")) / 3.6e9).alias("hours"))


class Windows:
    """id, n, total: for each row of one side how many of the other lie in its window and are of similarity `least` or more, and the sum of
    (s - .6)/.4 over them (0 if it is not asked for). Left rows are the later ones. Both sides are put in the order of time, so that a row's
    window is a range of columns and tiles outside all windows are not worked out."""

    def __init__(self, left: cells.Side, size: int, least: float, of_later: bool, mean: bool, digits: int = 6):
        self.left, self.size, self.least, self.of_later, self.mean, self.digits = self.in_order(left), size, least, of_later, mean, digits
        self.n, self.total = np.zeros(len(self.left.ids), np.int64), np.zeros(len(self.left.ids))

    def in_order(self, side: cells.Side) -> cells.Side:
        side = side.unit()
        side.take(order := np.argsort(side.more[0], kind="stable"))
        side.single = side.single[order]
        return side

    def add(self, right: cells.Side) -> Iterator[pa.RecordBatch]:
        right = self.in_order(right)
        n, total = np.zeros(len(right.ids), np.int64), np.zeros(len(right.ids))
        off, times = cells.margin(right.vectors.shape[1], self.digits), right.more[0]
        for at in range(0, len(self.left.ids), cells.TILE):
            t = self.left.more[0][at : at + cells.TILE]
            low, high = np.searchsorted(times, t - self.size, "left"), np.searchsorted(times, t, "left")
            first, last = low[0], high[-1]
            if first >= last:
                continue
            s = self.left.single[at : at + cells.TILE] @ right.single[first:last].T
            hit = s >= np.float32(self.least + off)
            near = np.flatnonzero((s >= np.float32(self.least - off)) ^ hit)  # too near to tell
            row, col = np.divmod(near, last - first)
            hit[row, col] = cells.exact(self.left, at, right, row, col + first, self.digits) >= self.least
            if low[-1] > first or high[0] < last:
                place = np.arange(first, last)
                hit &= (place >= low[:, None]) & (place < high[:, None])
            own = slice(at, at + len(t))
            self.n[own] += np.count_nonzero(hit, axis=1)
            n[first:last] += np.count_nonzero(hit, axis=0)
            if self.mean:
                row, col = np.divmod(np.flatnonzero(hit), last - first)
                w = (cells.exact(self.left, at, right, row, col + first, self.digits) - 0.6) / 0.4
                self.total[own] += np.bincount(row, w, len(t))
                total[first:last] += np.bincount(col, w, last - first)
        if not self.of_later:
            yield from self.found(right.ids, n, total)

    def found(self, ids: np.ndarray, n: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = n > 0
        yield from cells.batches(["id", "n", "total"], [ids[some], n[some], total[some]])

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.of_later:
            yield from self.found(self.left.ids, self.n, self.total)


def _interference(episodes: DataFrame, hours: float, least: float, by: list[str] | None, of_later: bool, mean: bool) -> DataFrame:
    """id, n, m: for each later (or else earlier) episode how many others of similarity `least` or more lie in its window before (after)
    it, and the mean of (s - .6)/.4 over them (if asked for).

    Time is cut into buckets as long as the window; parts of a bucket meet those of the bucket and of the one before it in cells, of which
    only a row for each episode goes on: no pair of rows is ever made, and a full bucket is no one task's."""
    size, keys = int(hours * 3.6e9), [*(by or []), "_bucket"]
    rows = episodes.withColumn("_t", _micros("when")).where(F.col("_t").isNotNull()).withColumn("_bucket", F.floor(F.col("_t") / size))
    right = cells.packed(rows, keys, more=("_t",))
    left = right.withColumn("_bucket", F.explode(F.array(F.col("_bucket"), F.col("_bucket") - 1)))
    met = cells.meet(left, right, keys, lambda own, same: Windows(own, size, least, of_later, mean), "id long, n long, total double")
    return met.groupBy("id").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("m"))


def proactive(episodes: DataFrame, hours: float = 6.0, least: float = 0.7, by: list[str] | None = None, each: float = 0.05, most: float = 0.3) -> DataFrame:
    """id, n, magnitude: earlier similar episodes within the window interfere, min(.05 n, .3)."""
    return _interference(episodes, hours, least, by, True, False).select("id", "n", F.least(each * F.col("n"), F.lit(most)).alias("magnitude"))


def retroactive(episodes: DataFrame, hours: float = 24.0, least: float = 0.6, by: list[str] | None = None, most: float = 0.25) -> DataFrame:
    """id, n, magnitude of the later similar episodes' interference: min(.15 * mean((s - .6)/.4) * sqrt n, .25)."""
    return _interference(episodes, hours, least, by, False, True).select("id", "n", F.least(0.15 * F.col("m") * F.sqrt("n"), F.lit(most)).alias("magnitude"))


def apply_interference(confidence, magnitude) -> Column:
    return clamp(_c(confidence) * (1 - _c(magnitude)))


def temporal_neighbours(anchors: DataFrame, episodes: DataFrame, hours: float, by: list[str] | None = None) -> DataFrame:
    """anchor_id, id, hours_apart, on either side of the anchor."""
    before = within(anchors, episodes, hours, by).select(F.col("l.id").alias("anchor_id"), F.col("r.id").alias("id"), F.col("hours").alias("hours_apart"))
    after = within(episodes, anchors, hours, by).select(F.col("r.id").alias("anchor_id"), F.col("l.id").alias("id"), F.col("hours").alias("hours_apart"))
    return before.unionByName(after).where("anchor_id <> id")


def prime(edges: DataFrame, recalled: DataFrame, links: DataFrame) -> DataFrame:
    """id, boost: neighbours by one or two edges of recalled rows, by similarity: (s - .6)/.4 * .15, half at two hops."""
    one = recalled.select(F.col("id").alias("src")).join(edges.select("src", F.col("dst")), "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w"))
    two = one.join(edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").select("a", F.col("c").alias("b"), F.lit(0.5).alias("w")).where("a <> b")
    best = one.unionByName(two).groupBy("a", "b").agg(F.max("w").alias("w"))
    met = best.join(links, ["a", "b"]).where("score >= 0.6")
    return met.groupBy(F.col("b").alias("id")).agg(F.max((F.col("score") - 0.6) / 0.4 * 0.15 * F.col("w")).alias("boost"))


def priming_boost(base, ms, n, half_life: float = 300.0, refractory: float = 50.0, saturation: float = 0.5, others=0.0, inhibition: float = 0.3) -> Column:
    """A prime's boost after ms: halves each half-life, grows with repetition, loses to stronger rivals, saturates; none at first."""
    decayed = _c(base) * F.pow(F.lit(0.5), _c(ms) / half_life) * (1 + 0.1 * (_c(n) - 1))
    left = F.greatest(decayed - inhibition * F.greatest(_c(others) - decayed, F.lit(0.0)), F.lit(0.0))
    return F.when(_c(ms) < refractory, 0.0).otherwise(saturation * F.tanh(left / saturation))


def associations(events: DataFrame, group: str, item: str, seconds: float = 30.0, least: int = 2) -> DataFrame:
    """prime, target, n, strength: how often target follows or precedes prime in a group within the time, by prime's count."""
    own = events.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col("id"), F.col("when"))
    pairs = within(own, own, seconds / 3600, ["group"]).select(F.col("l.item").alias("x"), F.col("r.item").alias("y")).where("x <> y")
    both = pairs.union(pairs.select("y", "x")).groupBy(F.col("x").alias("prime"), F.col("y").alias("target")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    total = own.groupBy(F.col("item").alias("prime")).agg(F.count(F.lit(1)).alias("total"))
    return both.join(total, "prime").select("prime", "target", "n", F.least(F.col("n") / F.col("total"), F.lit(1.0)).alias("strength"))


#: Pairs of items that a partition is to hold, so that what a task counts in memory does not grow with the table.
PAIRS = 500_000


def basket_associations(rows: DataFrame, basket: str, item: str, least: int = 2) -> DataFrame:
    """src, dst, n, weight: items of the same basket, by the source's baskets. Baskets are small; items may be hot.

    A pair is made once, whichever way round, and counted where its likes are: pairs are too rarely the same to be summed up before they
    travel. Rows and baskets are counted first; they say how many partitions there are to be."""
    n, baskets = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(basket)).first()
    partitions = max(1, -(-int(n * n / max(baskets, 1) / 2) // PAIRS))
    sets = rows.select(F.col(basket).alias("k"), F.col(item).alias("src")).repartition(partitions, "k").groupBy("k").agg(F.sort_array(F.collect_set("src")).alias("_s"))
    firsts = sets.where("k is not null").select("_s", F.posexplode("_s").alias("_i", "x"))
    pairs = firsts.select("x", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("y"))
    often = pairs.repartition(partitions, "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    both = often.select(F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))).alias("e"), "n").select("e.src", "e.dst", "n")
    total = sets.select(F.explode("_s").alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("total"))
    return both.join(total, "src").select("src", "dst", "n", (F.col("n") / F.col("total")).alias("weight"))


def repetition_boost(n) -> Column:
    return F.least(0.05 * _c(n), F.lit(0.3))


def total_boost(*boosts) -> Column:
    s = F.lit(0.0)
    for b in boosts:
        s = s + _c(b)
    return 1 - F.exp(-s)


def plasticity(position) -> Column:
    p = _c(position)
    return 0.5 * 4 * p * (1 - p)


def window_position(hours_since_recall) -> Column:
    """Place in the reconsolidation window of 1 to 6 hours; null outside."""
    h = _c(hours_since_recall)
    return F.when(h.between(1, 6), (h - 1) / 5)


def modified_confidence(kind: Column, confidence, extent, plastic) -> Column:
    c, e, p = _c(confidence), _c(extent), _c(plastic)
    return clamp(F.when(kind == "update", c + 0.1 * p).when(kind == "corruption", F.greatest(c - e * p * 0.2, F.lit(0.1))).otherwise(F.least(F.greatest(e, F.lit(0.3)), F.lit(0.8))))


def reconsolidate(recalls: DataFrame, changes: DataFrame) -> DataFrame:
    """recalls(id, born, recalled, active), changes(id, at, kind, extent, confidence): the changes that fall 1 to 6 hours after an
    active recall of a memory between a day and a year old, with plasticity and new confidence; a change counts once, by the
    latest such recall."""
    h = (_micros("at") - _micros("recalled")) / 3.6e9
    age = (_micros("recalled") - _micros("born")) / 8.64e10
    met = changes.join(recalls.where("active"), "id").withColumns({"hours": h, "age_days": age}).where(F.col("hours").between(1, 6) & F.col("age_days").between(1, 365))
    once = met.groupBy("id", "at", "kind", "extent", "confidence").agg(F.min("hours").alias("hours"))
    p = plasticity(window_position(F.col("hours")))
    return once.select("id", "at", "kind", "hours", p.alias("plasticity"), modified_confidence(F.col("kind"), F.col("confidence"), F.col("extent"), p).alias("confidence"))


def reconsolidation_cycles(events: DataFrame, most: int = 10) -> DataFrame:
    return events.groupBy("id").agg(F.count(F.lit(1)).alias("cycles")).withColumn("exceeded", F.col("cycles") > 2 * most)
