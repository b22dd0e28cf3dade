"""Queries that SQL does not express, whole, against plain loops."""

import os
from datetime import timedelta

import numpy as np
import pytest

from recollect import catalog
from recollect.operators import nearest
from recollect.sources import tables as T

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


def cosine(a, b):
    n = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a @ b) / n if n else 0.0


def neural(s):
    return 1 / (1 + np.exp(-10 * (s - 0.5)))


def clusters(vectors, threshold):
    """vectors by id: the two clusters of the most alike means become one, again and again. A cluster is named by its least id."""
    groups = {i: [i] for i in vectors}
    while True:
        best = None
        names = sorted(groups)
        mean = {g: np.mean([vectors[i] for i in groups[g]], axis=0) for g in names}
        for x, g in enumerate(names):
            for h in names[x + 1 :]:
                s = round(cosine(mean[g], mean[h]), 12)
                if s >= threshold and (best is None or s > best[0]):
                    best = (s, g, h)
        if best is None:
            return groups
        groups[best[1]] += groups.pop(best[2])


@pytest.fixture(scope="module")
def episodes(spark):
    rows = T.vector_episodes(spark, SF).collect()
    return {r["id"]: (r["concept"], np.array(r["embedding"], float), r["when"], r["confidence"]) for r in rows}


def by_concept(episodes, threshold):
    out = []
    for c in sorted({e[0] for e in episodes.values()}):
        found = clusters({i: e[1] for i, e in episodes.items() if e[0] == c}, threshold)
        out += [(c, g, sorted(own)) for g, own in found.items()]
    return out


def test_cluster_patterns(spark, episodes):
    got = {r["id"]: r for r in catalog.queries()["cluster_patterns"](spark, SF).collect()}
    assert set(got) == set(episodes)
    for concept, name, own in by_concept(episodes, 0.35):
        pairs = [neural(cosine(episodes[a][1], episodes[b][1])) for a in own for b in own if a != b]
        for i in own:
            assert (got[i]["concept"], got[i]["cluster"], got[i]["size"]) == (concept, name, len(own))
            assert got[i]["coherence"] == pytest.approx(np.mean(pairs) if pairs else 1.0, abs=2e-6)


def test_dream_cycle(spark, episodes):
    old = {i: e for i, e in episodes.items() if T.AS_OF - e[2] > timedelta(hours=24)}
    chosen = dict(sorted(old.items(), key=lambda x: (-x[1][3], x[0]))[:250])
    want = {}
    for _, name, own in by_concept(chosen, 0.3):
        if len(own) > 1:
            mean = np.mean([chosen[i][1] for i in own], axis=0)
            s = [cosine(chosen[i][1], mean) for i in own]
            want[name] = (len(own), pytest.approx(np.mean(s), abs=2e-6), pytest.approx(min(s), abs=2e-6), min(s) >= 0.8)
    got = {r["cluster"]: (r["n"], r["strength"], r["lowest"], r["compact"]) for r in catalog.queries()["dream_cycle"](spark, SF).collect()}
    assert got == want


def test_attractor_completion(spark):
    memories = {r["id"]: np.array(r["embedding"], float) for r in T.memories(spark, SF).collect()}
    n = 64

    def winners(x, share):
        k = max(1, int(len(x) * share))
        keep = sorted(range(len(x)), key=lambda i: (-x[i], i))[:k]
        return np.array([x[i] if i in set(keep) else 0.0 for i in range(len(x))])

    w = np.zeros((n, n))
    for v in memories.values():
        w += np.outer(v, v) / n
    for i in range(n):
        w[i, i] = 0
    want = {}
    for i, v in memories.items():
        if i % 20 == 0:
            known = np.array([0.0 if k / n < 0.5 else v[k] for k in range(n)])
            high = np.array([max(0.0, sum(np.sin((r + 1) * (k + 1) * 0.1) / 8 * known[k] for k in range(n))) for r in range(10 * n)])
            high = winners(high, 0.05)
            x = np.array([sum(high[r * n + k] for r in range(10)) for k in range(n)])
            for step in range(1, 8):
                new = winners(1 / (1 + np.exp(-(w @ x))), 0.25)
                moved = float(np.sqrt(((new - x) ** 2).sum()))
                if moved < 0.01:
                    x = new
                    break
                x = new
            done = moved < 0.01
            want[i] = (step, done, pytest.approx(0.9 * (1 - step / 7) if done else 0.27, abs=2e-6))
    got = {r["id"]: (r["iterations"], r["converged"], r["confidence"]) for r in catalog.queries()["attractor_completion"](spark, SF).collect()}
    assert got == want


def test_knn_approximate_finds_nine_of_ten(spark):
    m = T.memories(spark, "/root/testdata/sf0.01")
    exact = {(r["query_id"], r["id"]) for r in nearest.knn_join(m.where("id % 20 = 0"), m, 5).collect()}
    found = {(r["query_id"], r["id"]) for r in catalog.queries()["knn_approximate"](spark, "/root/testdata/sf0.01").collect()}
    assert len(found & exact) >= 0.9 * len(exact)
