"""Spreading activation and traversal over edges(src, dst, weight[, edge_type]), level by level.

Each level is a join of the frontier with the edges and an aggregate by target; what a level leaves is written to the shared
folder, so that plans stay short and lost executors cost no earlier level."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import keep

# Tiers by depth (hot 0, warm 1-2, cold from 3 on), their thresholds and confidence factors, the cycle penalty.
THRESHOLDS, FACTORS, CYCLE_PENALTY = (0.01, 0.05, 0.1), (1.0, 0.95, 0.9), 0.93
RATE = 0.7
#: Direction strengths of the two-level graph.
UPWARD, DOWNWARD, LATERAL, EPISODE_TO_EPISODE, DEPTH_DECAY = 0.8, 0.6, 0.4, 0.3, 0.8


def tier_of(depth: Column) -> Column:
    return F.when(depth == 0, "hot").when(depth <= 2, "warm").otherwise("cold")


def _by_tier(depth: Column, values: tuple[float, ...]) -> Column:
    return F.when(depth == 0, values[0]).when(depth <= 2, values[1]).otherwise(values[2])


def exponential(rate: float = RATE) -> Callable[[int], float]:
    return lambda depth: math.exp(-rate * depth)


def power_law(exponent: float) -> Callable[[int], float]:
    return lambda depth: (1 + depth) ** -exponent


def decay_to_rate(decay: float) -> float | None:
    """A query's DECAY as a rate: -ln(1 - decay); 0 from below; None (no change) from 1 on."""
    return None if decay >= 1 else 0.0 if decay <= 0 else -math.log(1 - decay)


def signed(activation: Column, edge_type: Column) -> Column:
    """Excitatory at least 0, inhibitory negative, modulatory halved."""
    return F.when(edge_type == "inhibitory", -F.abs(activation)).when(edge_type == "modulatory", activation * 0.5).otherwise(F.greatest(activation, F.lit(0.0)))


def spread(edges: DataFrame, seeds: DataFrame, max_depth: int, decay: Callable[[int], float] | None = None, typed: bool = False) -> DataFrame:
    """id, activation, confidence, tier, depth of all nodes met.

    A level hands on what it has received, times weight and decay(depth): the decays of a path multiply. A node's activation is
    the sum of what it receives, at most 1. It hands on only while that sum reaches the threshold of its tier, and is listed with 0
    otherwise. Nodes that activation comes back to are cut by the cycle penalty, once. typed: edge_type decides the sign."""
    decay = decay or exponential()
    links = edges.select("src", "dst", "weight", *(["edge_type"] if typed else []))
    total = keep(seeds.select(F.col("id"), F.col("activation").cast("double").alias("total"), F.lit(0).alias("depth"), F.lit(False).alias("again")))
    frontier = total.select("id", F.col("total").alias("level"))
    for depth in range(1, max_depth + 1):
        sent = F.col("level") * F.col("weight") * F.lit(decay(depth))
        if typed:
            sent = signed(sent, F.col("edge_type"))
        got = frontier.join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(sent).alias("level"))
        met = total.join(got, "id", "full").select(
            "id",
            F.least(F.coalesce("total", F.lit(0.0)) + F.coalesce("level", F.lit(0.0)), F.lit(1.0)).alias("total"),
            F.coalesce("depth", F.lit(depth)).alias("depth"),
            (F.coalesce("again", F.lit(False)) | (F.col("total").isNotNull() & F.col("level").isNotNull())).alias("again"),
            "level",
        )
        met = keep(met)
        total = met.drop("level")
        frontier = met.where(F.col("level").isNotNull() & (F.col("total") >= _by_tier(F.col("depth"), THRESHOLDS))).select("id", "level")
        if frontier.isEmpty():
            break
    kept = F.when(F.col("total") >= _by_tier(F.col("depth"), THRESHOLDS), F.col("total")).otherwise(0.0)
    activation = kept * F.when(F.col("again"), CYCLE_PENALTY).otherwise(1.0)
    return total.select("id", activation.alias("activation"), (activation * _by_tier(F.col("depth"), FACTORS)).alias("confidence"), tier_of(F.col("depth")).alias("tier"), "depth")


def spread_one_step(edges: DataFrame, activations: DataFrame, decay: float, default: float = 0.5) -> DataFrame:
    """Each neighbour of an activated node: min(own + sum(source * weight * decay), 1); a source without a value has the default."""
    own = F.coalesce("activation", F.lit(default))
    got = activations.select("id", own.alias("a")).join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("a") * F.col("weight") * decay).alias("got"))
    had = activations.select("id", F.coalesce("activation", F.lit(0.0)).alias("had"))
    return got.join(had, "id", "left").select("id", F.least(F.coalesce("had", F.lit(0.0)) + F.col("got"), F.lit(1.0)).alias("activation"))


def spread_through_bindings(bindings: DataFrame, sources: DataFrame, decay: float, to_concepts: bool = True) -> DataFrame:
    a, b = ("episode_id", "concept_id") if to_concepts else ("concept_id", "episode_id")
    met = sources.select("id", "activation").join(bindings, F.col("id") == F.col(a))
    return met.groupBy(F.col(b).alias("id")).agg(F.least(F.sum(F.col("activation") * F.col("strength") * decay), F.lit(1.0)).alias("activation"))


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """id, depth: each node within max_depth of a start, once, at its least depth."""
    seen = keep(starts.select("id", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = keep(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def bfs_activation(edges: DataFrame, seeds: DataFrame, max_depth: int, decay: Callable[[int], float] | None = None, prune: float = 0.01) -> DataFrame:
    """id, activation, depth: nodes at their least depth with the strongest activation that reaches them there, above `prune`."""
    decay = decay or exponential()
    seen = keep(seeds.select("id", F.col("activation").cast("double").alias("activation"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("activation") * F.col("weight") * decay(depth)).alias("activation"))
        frontier = keep(step.where(F.col("activation") > prune).join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def dfs(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """id, depth, visit: what bfs reaches, in the order of a depth-first walk over shortest paths (paths sorted as text)."""
    seen = keep(starts.select(F.col("id"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("path")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.concat_ws("/", "path", F.col("dst").cast("string"))).alias("path"))
        frontier = keep(step.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.orderBy("path").select("id", "depth", "path")


def spread_csr(edges: DataFrame, activations: DataFrame, iterations: int) -> DataFrame:
    """Repeatedly target += source * weight over all nodes, scaled down where the largest passes 1."""
    state = activations.select("id", F.col("activation").cast("double").alias("activation"))
    for _ in range(iterations):
        got = state.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("activation") * F.col("weight")).alias("got"))
        new = keep(state.join(got, "id", "full").select("id", (F.coalesce("activation", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("activation")))
        top = new.agg(F.max("activation")).first()[0] or 0.0
        state = new.withColumn("activation", F.col("activation") / F.lit(max(top, 1.0)))
    return state


def spread_strength(direction: Column, weight: Column, depth) -> Column:
    base = F.when(direction == "up", UPWARD).when(direction == "down", DOWNWARD).when(direction == "episode", EPISODE_TO_EPISODE).otherwise(LATERAL)
    return base * weight * F.pow(F.lit(DEPTH_DECAY), F.lit(depth))


def spread_hierarchical(edges: DataFrame, seeds: DataFrame, max_depth: int = 6, least: float = 0.01) -> DataFrame:
    """id, activation, depth, path: edges have a direction (up, down, lateral, episode); activations combine by the largest, and
    the shortest path (then the first as text) is kept."""
    best = keep(seeds.select("id", F.col("activation").cast("double").alias("activation"), F.lit(0).alias("depth"), F.array(F.col("id").cast("string")).alias("path")))
    frontier = best
    for depth in range(1, max_depth + 1):
        sent = F.col("activation") * spread_strength(F.col("direction"), F.col("weight"), depth - 1)
        step = frontier.join(edges, F.col("id") == F.col("src")).where(~F.array_contains("path", F.col("dst").cast("string")))
        step = step.select(F.col("dst").alias("id"), sent.alias("activation"), F.concat("path", F.array(F.col("dst").cast("string"))).alias("path")).where(F.col("activation") >= least)
        step = step.groupBy("id").agg(F.max("activation").alias("activation"), F.min("path").alias("path"))
        old = best.select("id", F.col("activation").alias("had"))
        frontier = keep(step.join(old, "id", "left").where(F.col("had").isNull() | (F.col("activation") > F.col("had"))).select("id", "activation", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        both = best.unionByName(frontier)
        best = keep(both.groupBy("id").agg(F.max("activation").alias("activation"), F.min("depth").alias("depth"), F.min_by("path", F.struct(F.size("path"), "path")).alias("path")))
    return best


def fan(edges: DataFrame) -> DataFrame:
    """id, fan: out-degree, at least 1 for every node. Edges are gone through once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("n")))).alias("e")).select("e.id", "e.n")
    return ends.groupBy("id").agg(F.greatest(F.sum("n"), F.lit(1)).cast("long").alias("fan"))


def fan_effect(edges: DataFrame, base_ms: float = 1150.0, step_ms: float = 70.0) -> DataFrame:
    f = F.col("fan")
    return fan(edges).select("id", "fan", (base_ms + step_ms * (f - 1)).alias("retrieval_ms"), (1.0 / f).alias("linear_share"), (1.0 / F.sqrt(f)).alias("root_share"))


def fan_statistics(edges: DataFrame, high: int = 3) -> DataFrame:
    """One row: nodes, mean, largest, upper median, nodes above `high`."""
    f = fan(edges).groupBy("fan").agg(F.count(F.lit(1)).alias("n"))
    all_ = f.agg(F.sum("n").alias("nodes"), (F.sum(F.col("fan") * F.col("n")) / F.sum("n")).alias("mean"), F.max("fan").alias("largest"), F.sum(F.when(F.col("fan") > high, F.col("n")).otherwise(0)).alias("high"), F.array_sort(F.collect_list(F.struct("fan", "n"))).alias("d"))
    middle = F.aggregate("d", F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("m")), lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.when(s["m"].isNull() & (s["at"] + x["n"] > F.floor(F.col("nodes") / 2)), x["fan"]).otherwise(s["m"]).alias("m")), lambda s: s["m"])
    return all_.select("nodes", "mean", "largest", middle.alias("median"), "high")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more, allowMissingColumns=True)


def remove_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges without those that touch a node of ids."""
    gone = ids.select(F.col("id").alias("_id"))
    return edges.join(gone, edges["src"] == gone["_id"], "left_anti").join(gone, edges["dst"] == gone["_id"], "left_anti")


def binding_decay(bindings: DataFrame, factor: float) -> DataFrame:
    return bindings.withColumn("strength", F.least(F.greatest(F.col("strength") * factor, F.lit(0.0)), F.lit(1.0)))


def binding_gc(bindings: DataFrame, least: float) -> DataFrame:
    return bindings.where(F.col("strength") >= least)


def dependency_cycles(edges: DataFrame) -> DataFrame:
    """id of each node on a cycle: nodes that neither peeling from the sources nor from the sinks removes, and that reach themselves."""
    core = keep(edges.select("src", "dst").distinct())
    while True:
        n = core.count()
        ins, outs = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        core = keep(core.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        if core.count() == n:
            break
    reach = keep(core)
    while True:  # paths double in length each round
        n = reach.count()
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        reach = keep(reach.union(longer).distinct())
        if reach.count() == n:
            break
    return reach.where("src = dst").select(F.col("src").alias("id")).distinct()


def topological_levels(edges: DataFrame) -> DataFrame:
    """id, level: the longest path to a node from the sources; nodes on or behind a cycle are left out."""
    links = keep(edges.select("src", "dst").distinct())
    nodes = keep(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct())
    done = None
    level = 0
    while True:
        blocked = links.select(F.col("dst").alias("id")).distinct()
        ready = keep(nodes.join(blocked, "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        nodes = keep(nodes.join(ready, "id", "left_anti"))
        links = keep(links.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return done if done is not None else nodes.withColumn("level", F.lit(0)).limit(0)


def fatigue_fold(contributions: DataFrame, refractory_ms: float = 1.0, fatigue: float = 0.9, least: float = 0.1) -> DataFrame:
    """id, activation: contributions (id, at_ms, amount) in time order; one within the refractory time is lost, each that counts
    tires the node."""

    def step(s: Column, e: Column) -> Column:
        ok = s["last"].isNull() | (e["at_ms"] - s["last"] >= refractory_ms)
        return F.struct(
            F.when(ok, F.least(s["a"] + e["amount"] * s["f"], F.lit(1.0))).otherwise(s["a"]).alias("a"),
            F.when(ok, F.greatest(s["f"] * fatigue, F.lit(least))).otherwise(s["f"]).alias("f"),
            F.when(ok, e["at_ms"]).otherwise(s["last"]).alias("last"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("f"), F.lit(None).cast("double").alias("last"))
    rows = contributions.select("id", F.col("at_ms").cast("double").alias("at_ms"), F.col("amount").cast("double").alias("amount"))
    return rows.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at_ms", "amount"))), zero, step, lambda s: s["a"]).alias("activation"))


def dot_lines(result: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphviz text of a spread, one line a row, ready for write.text."""
    nodes = result.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [label="'), F.col("id").cast("string"), F.lit(" "), F.format_number("activation", 3), F.lit('"];')).alias("value"))
    links = edges.join(result.select(F.col("id").alias("src")), "src", "left_semi").select(F.lit(2).alias("part"), F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("value"))
    spark = result.sparkSession
    ends = spark.createDataFrame([(0, "digraph spread {"), (3, "}")], "part int, value string")
    return ends.unionByName(nodes).unionByName(links).orderBy("part", "value").select("value")
