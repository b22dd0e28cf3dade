"""Many rows of few texts, vectors or keys: results stay those of plain loops, and work stays near the rows."""

import re
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import catalog
from recollect.functions import text
from recollect.operators import cells, cognition, consolidation, context, cues, graph, nearest
from recollect.queries.relational import _QUERY


def test_equal_texts_meet_others_once(spark):
    """12,000 rows of three texts: pairs of rows would be 10^8."""
    texts = ["red bolt", "big red bolt", "ring"]
    df = spark.range(12_000).select("id", F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")).alias("what"))
    began = time.time()
    got = context.containing(df, df.withColumn("o", F.col("id")), "what", 5, "o").where("anchor_id in (0, 1, 2, 11998, 11999)").collect()
    assert time.time() - began < 45
    hold = lambda a, b: texts[a % 3] in texts[b % 3] or texts[b % 3] in texts[a % 3]
    want = {(a, i, n + 1) for a in (0, 1, 2, 11998, 11999) for n, i in enumerate([i for i in range(11_999, 11_900, -1) if i != a and hold(a, i)][:5])}
    assert {(r["anchor_id"], r["id"], r["rank"]) for r in got} == want


def test_texts_without_a_word_are_in_all(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "c d e f")], "id long, what string").withColumn("o", F.col("id"))
    got = {(r["anchor_id"], r["id"], r["rank"]) for r in context.containing(rows, rows, "what", 5, "o").collect()}
    assert got == {(1, 2, 1), (2, 4, 1), (2, 1, 2), (4, 2, 1)}


def test_contained_texts_asks_for_every_part(spark, tmp_path):
    spark.range(45).select(F.col("id").alias("p_partkey"), F.concat(F.lit("old "), F.element_at(F.array(F.lit("nut"), F.lit("bolt")), (F.col("id") % 2 + 1).cast("int"))).alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.queries()["contained_texts"](spark, str(tmp_path)).collect()
    assert {r["anchor_id"] for r in got} == set(range(45)) and len(got) == 45 * 5


def test_cold_content_has_all_parts_that_match(spark, tmp_path):
    """More than the 100,000 rows that the query once stopped at."""
    spark.range(100_200).select(F.col("id").alias("p_partkey"), F.when(F.col("id") < 100_100, "blue ring").otherwise("old nut").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    duckdb.execute(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = duckdb.execute(f"SELECT count(*), sum(id) FROM ({catalog.oracle_sql()['cold_content']})").fetchall()[0]
    assert catalog.queries()["cold_content"](spark, str(tmp_path)).agg(F.count("id"), F.sum("id")).first()[:] == want == (100_100, 100_099 * 100_100 // 2)


def test_a_cue_without_a_limit_has_all(spark):
    e = spark.range(300).select("id", F.lit("blue").alias("what"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    assert cues.by_content_cold(e, cues.SemanticCue("blue", 0.2, None)).count() == 300
    assert cues.by_content(e, cues.SemanticCue("blue", 0.2, None)).count() == 300
    assert cues.by_embedding(e, cues.EmbeddingCue((1.0, 0.0), 0.2, None)).count() == 300
    assert cues.by_content_cold(e, cues.SemanticCue("blue")).count() == 75


def test_seeds_are_all_that_reach_the_threshold(spark, tmp_path):
    """More than the 10,000 rows that the query once stopped at."""
    v = F.array(*(F.lit(x).cast("float") for x in _QUERY))
    spark.range(10_050).select(F.col("id").alias("vec_id"), v.alias("embedding"), F.lit(0).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalog.queries()["seeds"](spark, str(tmp_path)).count() == 10_050


def vectors(spark, ids, v, **more):
    names = ["id", "embedding", *more]
    rows = list(zip(ids.tolist(), v.tolist(), *(x.tolist() for x in more.values()), strict=True))
    return spark.createDataFrame(rows, ", ".join(["id long", "embedding array<double>", *(f"{c} long" for c in more)]))


def nearest_by_hand(ids, s, k, least):
    """(query, id): score, rank of a whole table of scores."""
    out = {}
    for i in range(len(ids)):
        own = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= least)[:k]
        out |= {(int(ids[i]), int(j)): (round(-x, 6), n + 1) for n, (x, j) in enumerate(own)}
    return out


@pytest.fixture
def small_cells(monkeypatch):
    """Parts, chunks and tiles of a few rows, so that few rows make many cells."""
    for name, n in {"BLOCK": 16, "MOST": 64, "LEAST": 16, "CHUNK": 24, "TILE": 8}.items():
        monkeypatch.setattr(cells, name, n)


def test_neighbours_over_many_cells_with_ties(spark, small_cells):
    """Vectors of few values, so that many scores are equal, against a plain loop; zero and incomplete vectors among them."""
    r = np.random.default_rng(5)
    ids, v = r.permutation(400)[:300].astype(np.int64), r.integers(-1, 2, (300, 4)).astype(float)
    u = v / np.where(n := np.linalg.norm(v, axis=1, keepdims=True), n, 1)
    s = np.round(u @ u.T, 6) + 0.0
    df = vectors(spark, ids, v)
    got = {(x["query_id"], x["id"]): (x["score"], x["rank"]) for x in nearest.knn_join(df, df, 6, 0.1).collect()}
    assert got == nearest_by_hand(ids, s, 6, 0.1)
    g = ids % 3
    links = {(x["a"], x["b"]): x["score"] for x in nearest.similarity_links(vectors(spark, ids, v, g=g), 0.6, by=["g"]).collect()}
    assert links == {(int(ids[i]), int(ids[j])): s[i, j] for i in range(300) for j in range(300) if g[i] == g[j] and ids[i] < ids[j] and s[i, j] >= 0.6}
    assert len(nearest.similarity_links(df, 0.6).collect()) == sum(s[i, j] >= 0.6 for i in range(300) for j in range(i))


def test_a_cell_is_bounded_by_its_part():
    """16,384 rows against 4,096: a table of all scores would be 537 MB."""
    r = np.random.default_rng(6)
    side = lambda n: cells.Side([(np.arange(n), r.normal(size=(n, 64)).astype(np.float32), [])])
    worker = cells.Best(side(16_384), 5, 0.0, 6, ["query_id", "id", "score"])
    links = cells.Links(side(16_384), False, 0.3, 6)
    right = side(4096)
    tracemalloc.start()
    list(worker.add(right))
    assert sum(b.num_rows for b in links.add(side(4096))) > 0
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 and len(next(worker.done())) == 16_384 * 5


@pytest.mark.parametrize("later", [True, False])
def test_interference_over_many_cells(spark, small_cells, later):
    """All of one time bucket, or of two, against a plain loop; a bucket is many tasks'."""
    r = np.random.default_rng(7)
    ids, hours, v = np.arange(240), r.integers(0, 14, 240), r.normal(size=(240, 6))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    df = vectors(spark, ids, v, h=hours).withColumn("when", F.timestamp_seconds(1_704_067_200 + 3600 * F.col("h")))
    hit = (hours[None, :] < hours[:, None]) & (hours[None, :] >= hours[:, None] - 10) & (s >= 0.2)
    axis = 1 if later else 0
    n, m = hit.sum(axis=axis), np.where(hit, (s - 0.6) / 0.4, 0).sum(axis=axis)
    if later:
        found = cognition.proactive(df, 10.0, 0.2, each=0.001, most=1.0)
        want = {int(i): (n[i], min(0.001 * n[i], 1.0)) for i in ids if n[i]}
    else:
        found = cognition.retroactive(df, 10.0, 0.2)
        want = {int(i): (n[i], min(0.15 * m[i] / n[i] * n[i] ** 0.5, 0.25)) for i in ids if n[i]}
    got = {x["id"]: (x["n"], x["magnitude"]) for x in found.collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert {i: x[1] for i, x in got.items()} == pytest.approx({i: x[1] for i, x in want.items()})
    one = df.where("h < 8")
    packed = cells.packed(one.withColumn("_b", F.lit(0)), ["_b"])
    assert cells.meet(packed, packed, ["_b"], lambda own, same: cells.Links(own, same, 0.9, 6), "a long, b long, score double").rdd.getNumPartitions() > 20


def test_hash_embedding_works_out_its_codes_once(spark):
    df = spark.createDataFrame([("large blue ring",), ("",), (None,)], "t string").select(text.hash_embedding(F.col("t"), 8).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ascii(") == 1
    codes = [sum(map(ord, "large bl")), sum(map(ord, "ue ring"))]
    raw = np.array([codes[j % 2] * (j + 1) % 1000 / 1000 for j in range(8)])
    got = [r["v"] for r in df.collect()]
    assert got[0] == pytest.approx(list(raw / np.linalg.norm(raw))) and got[1] == got[2] == [0.0] * 8


def test_baskets_are_dealt_out_by_their_pairs(spark, monkeypatch):
    """Against a plain loop, with items that stand twice in a basket, and null ones; more pairs make more partitions."""
    r = np.random.default_rng(8)
    rows = [(int(b), int(i)) for b, i in zip(r.integers(0, 200, 1500), r.integers(0, 30, 1500) ** 2 // 30, strict=True)] + [(5, None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "b long, i long")
    sets = {b: {i for c, i in rows if c == b and i is not None} for b, _ in rows}
    total = Counter(i for s in sets.values() for i in s)
    n = Counter((x, y) for b, s in sets.items() if b is not None for x in s for y in s if x != y)
    want = {p: (c, c / total[p[0]]) for p, c in n.items() if c >= 2}
    monkeypatch.setattr(cognition, "PAIRS", 200)
    df_edges = cognition.basket_associations(df, "b", "i")
    assert {(x["src"], x["dst"]): (x["n"], x["weight"]) for x in df_edges.collect()} == want
    said = df_edges._jdf.queryExecution().executedPlan().toString()
    assert len({k for k in re.findall(r"hashpartitioning\([xy]#\d+L?, [xy]#\d+L?, (\d+)\)", said) if int(k) > 10}) == 1
    fans = {x["id"]: x["fan"] for x in graph.fan(df_edges).collect()}
    assert fans == {i: max(1, sum(1 for p in want if p[0] == i)) for p in want for i in p}


def test_clusters_by_centroid_against_a_plain_loop():
    """Vectors of few values, so that many pairs are as close, equal ones and zeros among them."""
    r = np.random.default_rng(9)
    for n, dim, least in ((90, 3, 0.7), (120, 8, 0.4), (60, 2, 0.999999)):
        ids, m = r.permutation(1000)[:n], r.integers(-1, 2, (n, dim)).astype(float)
        order = np.argsort(ids)
        groups = {i: [i] for i in range(n)}
        unit = lambda x: x / (np.linalg.norm(x) or 1)
        while len(groups) > 1:
            c = np.array([unit(np.mean([m[order[x]] for x in g], axis=0)) for g in groups.values()])
            s, at = np.round(c @ c.T, 12), list(groups)
            s[np.tril_indices(len(at))] = -2
            if s.max() < least:
                break
            i, j = (at[x] for x in np.unravel_index(s.argmax(), s.shape))
            groups[i] = sorted(groups[i] + groups.pop(j))
        want = np.empty(n, int)
        for g in groups.values():
            want[order[g]] = order[g[0]]
        assert (consolidation.agglomerate(ids, m, least) == want).all()


def test_clusters_of_many_rows_take_seconds():
    m = np.random.default_rng(10).normal(size=(12_000, 64)) + np.repeat(np.random.default_rng(11).normal(size=(12, 64)) / 2, 1000, axis=0)
    began = time.time()
    labels = consolidation.agglomerate(np.arange(len(m)), m, 0.35)
    assert time.time() - began < 15 and len(np.unique(labels)) > 1
