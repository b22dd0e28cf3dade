"""Spreading activation: golden values of small graphs, and laws."""

import os

import numpy as np
import pytest

from recollect import catalog
from recollect.operators import cues, nearest, recall, results
from recollect.operators import graph as G
from recollect.queries.relational import _QUERY
from recollect.sources import tables


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


def seeds(spark, *names):
    return spark.createDataFrame([(n, 1.0) for n in names], "id string, activation double")


def spread(spark, rows, start, depth, decay=None):
    return {r["id"]: round(r["activation"], 3) for r in G.spread(edges(spark, rows), seeds(spark, start), depth, decay).collect()}


def test_chain_and_cycle(spark):
    chain = [(f"c{i}", f"c{i + 1}", 0.9) for i in range(4)]
    assert spread(spark, chain, "c0", 5) == {"c0": 1, "c1": 0.447, "c2": 0.099, "c3": 0}
    ring = [(f"n{i}", f"n{(i + 1) % 5}", 0.85) for i in range(5)]
    assert spread(spark, ring, "n0", 7) == {"n0": 1, "n1": 0.422, "n2": 0.088, "n3": 0}


def test_fan_tree_clique_power(spark):
    assert spread(spark, [("x", f"s{i}", 0.25) for i in range(4)], "x", 2) == {"x": 1} | {f"s{i}": 0.124 for i in range(4)}
    tree = [("r", "a", 0.8), ("r", "b", 0.8), ("a", "c", 0.8), ("a", "d", 0.8), ("b", "e", 0.8), ("b", "f", 0.8)]
    assert spread(spark, tree, "r", 3) == {"r": 1, "a": 0.397, "b": 0.397, "c": 0.078, "d": 0.078, "e": 0.078, "f": 0.078}
    clique = [(f"k{i}", f"k{j}", 1 / 3) for i in range(4) for j in range(4) if i != j]
    assert spread(spark, clique, "k0", 2) == {"k0": 0.93, "k1": 0.179, "k2": 0.179, "k3": 0.179}
    ring = [(f"n{i}", f"n{(i + 1) % 5}", 0.75) for i in range(5)]
    assert spread(spark, ring, "n0", 8, G.power_law(0.3)) == {"n0": 1, "n1": 0.609, "n2": 0.329, "n3": 0.163, "n4": 0}


def test_confidence_and_tier(spark):
    got = {r["id"]: (round(r["confidence"], 3), r["tier"]) for r in G.spread(edges(spark, [("a", "b", 0.9)]), seeds(spark, "a"), 1).collect()}
    assert got == {"a": (1.0, "hot"), "b": (0.425, "warm")}


def test_traversals(spark):
    e = edges(spark, [("a", "b", 1), ("a", "c", 1), ("b", "d", 1), ("d", "a", 1), ("d", "e", 1)])
    assert {r["id"]: r["depth"] for r in G.bfs(e, seeds(spark, "a"), 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [r["id"] for r in G.dfs(e, seeds(spark, "a"), 3).collect()] == ["a", "b", "d", "e", "c"]
    assert {r["id"] for r in G.dependency_cycles(e).collect()} == {"a", "b", "d"}
    dag = edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1)])
    assert {r["id"]: r["level"] for r in G.topological_levels(dag).collect()} == {"a": 0, "b": 1, "c": 2}
    assert G.dependency_cycles(dag).isEmpty()
    assert {(r["src"], r["dst"]) for r in G.remove_nodes(dag, seeds(spark, "b")).collect()} == {("a", "c")}
    assert any("digraph" in r["value"] for r in G.dot_lines(G.spread(dag, seeds(spark, "a"), 1), dag).collect())


def test_fatigue(spark):
    rows = [("a", 0.0, 0.1), ("a", 0.5, 0.9), ("a", 2.0, 0.1)]
    out = G.fatigue_fold(spark.createDataFrame(rows, "id string, at_ms double, amount double")).first()
    assert out["activation"] == pytest.approx(0.1 + 0.09)


def test_approximate_neighbours_reach_nine_tenths(spark):
    m = tables.memories(spark, "/root/testdata/sf0.01")
    q = m.where("id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in nearest.knn_join(q, m, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in nearest.ivf_join(q, m, 10, lists=32, probes=24).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_result_laws(spark):
    a = results.Result.of(spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, confidence double"))
    b = results.Result.of(spark.createDataFrame([(2, 0.4), (3, 0.7)], "id long, confidence double"))
    get = lambda r: sorted((x["id"], x["confidence"]) for x in r.episodes.collect())
    assert get(a.and_(b)) == [(2, 0.5)]
    assert get(a.or_(b)) == [(1, 0.9), (2, 0.5), (3, 0.7)] == get(a.combine(b))
    i = a.not_().not_().interval.first()
    j = a.interval.first()
    assert all(i[c] == pytest.approx(j[c]) for c in ("lower", "point", "upper", "width"))


def test_empty_tables(spark):
    none = edges(spark, [])
    assert [r["id"] for r in G.spread(none, seeds(spark, "a"), 3).collect()] == ["a"]
    assert results.interval_of(spark.createDataFrame([], "id long, confidence double")).first()["point"] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the supplied tables are not here")
def test_recall_pipeline_spreads_over_the_links_of_all_memories(spark):
    """Against links from the full table of cosines."""
    d = "/root/testdata/sf0.001"
    m = tables.vector_episodes(spark, d)
    local = m.select("id", "embedding").orderBy("id").toPandas()
    ids, v = local["id"].to_numpy(), np.stack([np.asarray(x, float) for x in local["embedding"]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -2)
    links = {}
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5]:
            if s[i, j] >= 0.1:
                links[int(ids[i]), int(ids[j])] = links[int(ids[j]), int(ids[i])] = float(s[i, j])
    e = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, weight double")
    want = recall.recall(m, e, cues.EmbeddingCue(_QUERY, 0.1, 50), tables.AS_OF, 2, 50).collect()
    got = catalog.queries()["recall_pipeline"](spark, d).collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in want)
    assert {r["id"]: r["score"] for r in got} == pytest.approx({r["id"]: r["score"] for r in want}, abs=2e-6)
