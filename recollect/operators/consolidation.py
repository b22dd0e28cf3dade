"""Consolidation: clusters, patterns, concepts, dreams, compaction."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..store import keep, ship
from .cues import at, hours_between

STAGES = {"rem": 1.5, "nrem2": 1.0, "nrem3": 1.2, "wake": 0.5}


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _merged_by_centroid(m: np.ndarray, threshold: float, tile: int = 512, most: int = 65_536) -> np.ndarray:
    """For each row the first row of its cluster: the closest pair of means merges while its cosine reaches the threshold, ties go to the
    first pair. Each cluster knows the best one after it. Products in single precision tell which pairs can be best; only those are worked
    out in double precision, rounded to 12 digits. Rows of clusters that went are dropped when they are half of all."""
    n, off = len(m), (m.shape[1] + 16) * 2.0**-22
    owner = np.arange(n)
    first, total, size, center = np.arange(n), m.copy(), np.ones(n), _unit(m)
    single, alive = center.astype(np.float32), np.ones(n, bool)
    best, where = np.full(n, -2.0), np.zeros(n, np.int64)

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.round((center[i[at : at + most]] * center[j[at : at + most]]).sum(axis=1), 12) for at in range(0, len(i), most)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def refresh(i: int) -> None:
        """The best cluster after i; of equals the first."""
        s = np.where(alive[i + 1 :], single[i + 1 :] @ single[i], np.float32(-3))
        top = s.max(initial=-3)
        if top < -2:
            best[i] = -2.0
            return
        near = np.flatnonzero(s >= top - off) + i + 1
        sure = exact(np.full(len(near), i), near)
        best[i], where[i] = sure.max(), near[sure.argmax()]

    for at in range(0, n, tile):
        s = single[at : at + tile] @ single[at:].T
        s[np.arange(s.shape[1])[None, :] <= np.arange(len(s))[:, None]] = -3
        row, col = np.divmod(np.flatnonzero((s >= s.max(axis=1, keepdims=True) - off) & (s > -3)), s.shape[1])
        sure = exact(at + row, at + col)
        order = np.lexsort((col, -sure, row))
        u, place = np.unique(row[order], return_index=True)
        best[at + u], where[at + u] = sure[order][place], at + col[order][place]
    while n > 1 and best[i := int(best.argmax())] >= threshold:
        j = int(where[i])
        owner[first[j]] = first[i]
        total[i] += total[j]
        size[i] += size[j]
        center[i] = _unit((total[i] / size[i])[None, :])[0]
        single[i] = center[i]
        alive[j], best[j] = False, -2.0
        stale = np.flatnonzero(((where == i) | (where == j)) & (best > -2))
        refresh(i)
        for k in stale:
            if k != i:
                refresh(int(k))
        could = alive[:i] & (single[:i] @ single[i] >= best[:i] - off)
        could[stale[stale < i]] = False
        k = np.flatnonzero(could)
        sure = exact(k, np.full(len(k), i))
        better = (sure > best[k]) | ((sure == best[k]) & (i < where[k]))
        best[k[better]], where[k[better]] = sure[better], i
        if 2 * np.count_nonzero(alive) < len(alive):
            kept, at = np.flatnonzero(alive), np.cumsum(alive) - 1
            first, total, size, center, single, best, where, alive = first[kept], total[kept], size[kept], center[kept], single[kept], best[kept], at[where[kept]], alive[kept]
    while (owner != owner[owner]).any():
        owner = owner[owner]
    return owner


def agglomerate(ids: np.ndarray, m: np.ndarray, threshold: float, linkage: str = "centroid", hours: np.ndarray | None = None) -> np.ndarray:
    """Labels (index of the first member in id order). The closest pair merges while its similarity reaches the threshold; ties go
    to the first pair. centroid: cosine of means; average: mean neural similarity of members."""
    order = np.argsort(ids, kind="stable")
    m = m[order]
    if linkage == "centroid":
        label = np.empty(len(m), np.int64)
        label[order] = order[_merged_by_centroid(m, threshold)]
        return label
    n, u = len(m), _unit(m)
    h = hours[order] if hours is not None else None
    groups = {i: [i] for i in range(n)}  # by first member
    owner = np.arange(n)

    def similarities(i: int) -> np.ndarray:
        """Of cluster i to the clusters after it (by their first members), and -2 elsewhere."""
        out = np.full(n, -2.0)
        later = live[np.searchsorted(live, i + 1) :]
        out[later] = against(i, later)
        return out

    def against(i: int, others: np.ndarray) -> np.ndarray:
        total = np.zeros(n)
        for a in groups[i]:
            cos = u @ u[a]
            if h is not None:
                cos = cos * np.exp(-np.abs(h - h[a]) / 24)
            total += np.bincount(owner, weights=1 / (1 + np.exp(-10 * (cos - 0.5))), minlength=n)
        return np.round(total[others] / (len(groups[i]) * np.bincount(owner, minlength=n)[others]), 12)

    # For each cluster the best one after it: memory grows with the members and not with their pairs.
    live = np.arange(n)
    best, where = np.full(n, -2.0), np.full(n, -1)

    def refresh(i: int) -> None:
        s = similarities(i)
        where[i] = s.argmax()
        best[i] = s[where[i]]

    for i in range(n):
        refresh(i)
    while len(live) > 1:
        i = int(best.argmax())
        if best[i] < threshold:
            break
        j = int(where[i])
        groups[i] = sorted(groups[i] + groups.pop(j))
        owner[groups[i]] = i
        live = live[live != j]
        best[j] = -2.0
        refresh(i)
        stale = live[np.isin(where[live], (i, j)) & (live < j) & (live != i) & (best[live] > -2)]
        for k in stale:
            refresh(int(k))
        earlier = np.setdiff1d(live[live < i], stale)
        s = against(i, earlier)
        better = (s > best[earlier]) | ((s == best[earlier]) & (i < where[earlier]))
        best[earlier[better]], where[earlier[better]] = s[better], i
    label = np.empty(n, np.int64)
    for g in groups.values():
        label[order[g]] = order[g[0]]
    return label


def cluster(episodes: DataFrame, by: list[str], threshold: float = 0.8, linkage: str = "centroid", least_size: int = 1, least_coherence: float = 0.0) -> DataFrame:
    """by..., id, cluster (its smallest id), size, coherence. A group of `by` is clustered whole, in one task: its memory grows with
    the group's rows, its time with their square at least."""
    ship(episodes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = pdf["id"].to_numpy(), V.matrix(pdf["embedding"])
        hours = pdf["when"].astype("int64").to_numpy() / 3.6e12 if "when" in pdf and linkage == "average" else None
        label = agglomerate(ids, m, threshold, linkage, hours)
        out = []
        u = _unit(m)
        rows = np.argsort(label, kind="stable")
        for own in np.split(rows, np.flatnonzero(np.diff(label[rows])) + 1):
            step = max(1, 2**22 // len(own))
            total = sum(float((1 / (1 + np.exp(-10 * (u[own[at : at + step]] @ u[own].T - 0.5)))).sum()) for at in range(0, len(own), step))
            itself = float((1 / (1 + np.exp(-10 * ((u[own] ** 2).sum(axis=1) - 0.5)))).sum())
            coherence = (total - itself) / (len(own) * (len(own) - 1)) if len(own) > 1 else 1.0
            if len(own) >= least_size and coherence >= least_coherence:
                out.append(pd.DataFrame({c: pdf[c].iloc[own].to_numpy() for c in by} | {"id": ids[own], "cluster": ids[own].min(), "size": len(own), "coherence": coherence}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*by, "id", "cluster", "size", "coherence"]})

    kinds = ", ".join(f"{c} {episodes.schema[c].dataType.simpleString()}" for c in by)
    kind = episodes.schema["id"].dataType.simpleString()
    needed = [*by, "id", "embedding", *(["when"] if linkage == "average" and "when" in episodes.columns else [])]
    return episodes.select(*needed).groupBy(*by).applyInPandas(run, f"{kinds + ', ' if kinds else ''}id {kind}, cluster {kind}, size long, coherence double")


def centroids(members: DataFrame, key: str = "cluster") -> DataFrame:
    return V.mean_vector(members, [key])


def replay_weights(members: DataFrame, as_of: datetime, stage: str = "rem", key: str = "cluster") -> DataFrame:
    """members with weight: recency (exp of -hours/24) x stage x confidence, summing to 1 in a cluster (equal where all are 0)."""
    raw = F.exp(-F.greatest(hours_between(at(as_of), F.col("when")), F.lit(0.0)) / 24) * STAGES[stage] * F.col("confidence")
    w = Window.partitionBy(key)
    total = F.sum("_r").over(w)
    return members.withColumn("_r", raw).withColumn("weight", F.when(total > 0, F.col("_r") / total).otherwise(1 / F.count(F.lit(1)).over(w))).drop("_r")


def pattern_strength(members: DataFrame, key: str = "cluster") -> DataFrame:
    """key, strength (mean cosine to the centroid), n, first, last, centroid."""
    c = centroids(members, key)
    met = members.join(c, key)
    return met.groupBy(key).agg(F.avg(V.cosine(F.col("embedding"), F.col("centroid"))).alias("strength"), F.count(F.lit(1)).alias("n"), F.min("when").alias("first"), F.max("when").alias("last"), F.first("centroid").alias("centroid"), F.array_sort(F.collect_set("id")).alias("source_episodes"))


def coherence(members: DataFrame, key: str = "cluster", vector: str = "embedding", rows: int = 2048) -> DataFrame:
    """key, coherence: mean neural similarity of all ordered pairs at no distance in time, by blocks of the group of about `rows` members."""
    ship(members.sparkSession)
    kind = members.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _unit(V.matrix(pdf["v"]))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(m)], "vectors": [m.tobytes()], "width": [m.shape[1]]})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, y = np.frombuffer(r.va).reshape(-1, r.width), np.frombuffer(r.vb).reshape(-1, r.width)
                out.append((getattr(r, key), float((1 / (1 + np.exp(-10 * (x @ y.T - 0.5)))).sum()), len(x) if r.sa == r.sb else 0))
            yield pd.DataFrame(out, columns=[key, "total", "own"])

    largest = members.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    parts = -(-largest // rows)
    salted = members.select(key, F.col(vector).alias("v"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_salt"))
    packed = salted.groupBy(key, "_salt").applyInPandas(lambda k, pdf: pack(pdf).assign(salt=k[1]), f"{key} {kind}, n long, vectors binary, width int, salt int")
    a = packed.select(key, F.col("vectors").alias("va"), F.col("salt").alias("sa"), "width")
    b = packed.select(key, F.col("vectors").alias("vb"), F.col("salt").alias("sb"))
    sums_ = a.join(b, key).mapInPandas(sums, f"{key} {kind}, total double, own long")
    same = 1 / (1 + np.exp(-5.0))  # a vector with itself
    all_ = sums_.groupBy(key).agg(F.sum("total").alias("t"), F.sum("own").alias("n"))
    return all_.select(key, F.when(F.col("n") > 1, (F.col("t") - F.col("n") * same) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("coherence"), "n")


def chi_square_p(n: Column, strength: Column) -> Column:
    expected = 2 / F.greatest(strength, F.lit(1e-6))
    chi = F.pow(n - expected, 2) / expected
    return F.exp(-chi / 2)


def significant(patterns: DataFrame, alpha: float = 0.01) -> DataFrame:
    return patterns.withColumn("p", chi_square_p(F.col("n"), F.col("strength"))).where(F.col("p") < alpha)


def mutual_information(strength: Column, n_features: Column) -> Column:
    return strength * F.log1p(n_features / 10)


def likelihood_ratio(strength: Column, n: Column) -> Column:
    return F.ln(strength) + F.ln(n)


def merge_patterns(patterns: DataFrame, links: DataFrame) -> DataFrame:
    """patterns of linked pairs (a into b): count-weighted strength and centroid."""
    named = patterns.join(links.select(F.col("a").alias("cluster"), F.col("b").alias("into")), "cluster", "left").withColumn("into", F.coalesce("into", "cluster"))
    mean = V.mean_vector(named.select("into", F.col("centroid").alias("embedding"), "n"), ["into"], weight=F.col("n"))
    return named.groupBy("into").agg((F.sum(F.col("strength") * F.col("n")) / F.sum("n")).alias("strength"), F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_episodes")))).alias("source_episodes")).join(mean, "into").withColumnRenamed("into", "cluster")


def detect_patterns(episodes: DataFrame, by: list[str], threshold: float = 0.8, least: int = 3, most: int = 100) -> DataFrame:
    """Clusters of `least` or more as patterns, the strongest `most`."""
    members = keep(episodes.join(cluster(episodes, by, threshold, least_size=least).select("id", "cluster"), "id"))
    return pattern_strength(members).orderBy(F.desc("strength"), "cluster").limit(most)


def signature(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), "|"), 256)


def upsert_protos(pool: DataFrame, seen: DataFrame, cycle: int) -> DataFrame:
    """pool and seen: signature, coherence, strength, replay_count, episodes, last_cycle[, ...]. One that is seen again: a replay
    more, strength + .02 (at most 1), running mean of coherence, union of episodes."""
    a, b = pool.alias("a"), seen.alias("b")
    met = a.join(b, F.col("a.signature") == F.col("b.signature"), "full")
    n = F.col("a.replay_count")
    again = F.col("a.signature").isNotNull() & F.col("b.signature").isNotNull()
    return met.select(
        F.coalesce("a.signature", "b.signature").alias("signature"),
        F.when(again, (F.col("a.coherence") * n + F.col("b.coherence")) / (n + 1)).otherwise(F.coalesce("a.coherence", "b.coherence")).alias("coherence"),
        F.when(again, F.least(F.col("a.strength") + 0.02, F.lit(1.0))).otherwise(F.coalesce("a.strength", "b.strength")).alias("strength"),
        F.when(again, n + 1).otherwise(F.coalesce("a.replay_count", "b.replay_count")).alias("replay_count"),
        F.when(again, F.array_union("a.episodes", "b.episodes")).otherwise(F.coalesce("a.episodes", "b.episodes")).alias("episodes"),
        F.when(F.col("b.signature").isNotNull(), F.lit(cycle)).otherwise(F.col("a.last_cycle")).alias("last_cycle"),
    )


def ready_for_promotion() -> Column:
    return (F.col("strength") > 0.1) & (F.col("replay_count") >= 3) & (F.col("coherence") > 0.65)


def proto_garbage(cycle: int) -> Column:
    idle = F.lit(cycle) - F.col("last_cycle")
    return (idle > 50) | ((F.col("strength") < 0.05) & (idle > 20))


def should_form(cycles: int, episodes: int, minutes_since: float, least_cycles: int = 3, least_episodes: int = 10, spacing: float = 30.0) -> tuple[bool, str | None]:
    for short, why in ((cycles < least_cycles, "cycles"), (episodes < least_episodes, "episodes"), (minutes_since < spacing, "spacing")):
        if short:
            return False, why
    return True, None


def formations_last_hour(events: DataFrame, key: str, when: str = "when") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("_s")).rangeBetween(-3600, 0)
    return events.withColumn("_s", F.unix_seconds(F.col(when).cast("timestamp"))).withColumn("formations", F.count(F.lit(1)).over(w)).drop("_s")


def eligible_for_compaction(as_of: datetime, least_days: float = 7.0, most_confidence: float = 0.95) -> Column:
    return (hours_between(at(as_of), F.col("when")) / 24 >= least_days) & (F.col("confidence") < most_confidence)


def compactable(members: DataFrame, patterns: DataFrame, least: float = 0.8, key: str = "cluster") -> DataFrame:
    """key, lowest, ok: a pattern may stand for its members if each is close enough."""
    met = members.join(patterns.select(key, "centroid"), key)
    return met.groupBy(key).agg(F.min(V.cosine(F.col("embedding"), F.col("centroid"))).alias("lowest"), F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("lowest") >= least)


def select_dream(episodes: DataFrame, as_of: datetime, least_hours: float = 24.0, most: int = 250) -> DataFrame:
    old = episodes.where(hours_between(at(as_of), F.col("when")) > least_hours)
    return old.orderBy(F.desc("confidence"), "id").limit(most)


def dream(episodes: DataFrame, as_of: datetime, by: list[str], threshold: float = 0.8) -> DataFrame:
    """Select, cluster, keep significant patterns, say which may be compacted: cluster, n, strength, lowest, compact."""
    chosen = keep(select_dream(episodes, as_of))
    members = keep(chosen.join(cluster(chosen, by, threshold, least_size=2).select("id", "cluster"), "id"))
    patterns = keep(pattern_strength(members))
    return patterns.join(compactable(members, patterns).select("cluster", "lowest", "ok"), "cluster").select("cluster", "n", "strength", "lowest", F.col("ok").alias("compact"))


def replay_selection(episodes: DataFrame, most: int = 5) -> DataFrame:
    return episodes.orderBy(F.desc(F.col("prediction_error") * F.col("confidence")), "id").limit(most)


def systems_consolidation(episodes: DataFrame, as_of: datetime, delay_hours: float) -> DataFrame:
    h = hours_between(at(as_of), F.col("when"))
    return episodes.where(h > delay_hours).select(F.concat(F.lit("semantic_"), F.col("id").cast("string")).alias("id"), (F.col("confidence") * F.exp(-h / 24)).alias("confidence"))


def consolidation_progress(episodes: DataFrame, patterns: DataFrame) -> DataFrame:
    n = patterns.select(F.explode("source_episodes").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return episodes.select("id").join(n, "id", "left").select("id", F.least(F.coalesce("n", F.lit(0)) / 5, F.lit(1.0)).alias("progress"))


def prediction_error(episodes: DataFrame, patterns: DataFrame, dim: int, least: float = 0.7) -> DataFrame:
    """Distance to the best pattern (cosine above `least`) by the dimension, else 1. All patterns given are met; a detector bounds them."""
    p = patterns.select(F.col("centroid").alias("c"), F.col("cluster").alias("pattern"))
    met = episodes.join(F.broadcast(p) if patterns.count() <= 10_000 else p).select("id", V.cosine(F.col("embedding"), F.col("c")).alias("s"), V.euclidean(F.col("embedding"), F.col("c")).alias("d"), "pattern")
    best = met.groupBy("id").agg(F.max(F.struct("s", F.negative("d").alias("nd"))).alias("b"))
    return best.select("id", F.when(F.col("b.s") > least, -F.col("b.nd") / dim).otherwise(1.0).alias("prediction_error"))
