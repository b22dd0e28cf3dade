"""Context, hypotheses, batches, clocks, plug-ins; laws of confidence and decay."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import confidence as C
from recollect.functions import decay as D
from recollect.functions import text as X
from recollect.functions import vectors as V
from recollect.operators import completion, consolidation, context, recall


@pytest.fixture(scope="module")
def memories(spark):
    rows = [(i, [float(np.cos(i / 3)), float(np.sin(i / 3))], 0.5 + i / 20, "abc"[i % 3], datetime(2024, 1, 1) + timedelta(hours=i), f"word{i % 4} tail") for i in range(9)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, confidence double, `where` string, `when` timestamp_ntz, what string")


def test_around(spark, memories):
    one = memories.where("id = 3").withColumn("g", F.lit(1))
    near = context.nearest_in_time(one, memories.withColumn("g", F.lit(1)), 2, ["g"])
    assert sorted(r["id"] for r in near.collect()) == [2, 4]
    assert sorted(r["id"] for r in context.spatial_neighbours(one, memories).collect()) == [0, 6]
    assert [r["id"] for r in context.containing(one, memories, "what", 5, "confidence").collect()] == [7]
    links = context.neighbour_graph(memories, 2, 0.5)
    met = {r["id"]: r["depth"] for r in context.spread_neighbours(links, spark.createDataFrame([(4, 1.0)], "id long, activation double"), 2).collect()}
    assert met[4] == 0 and met[3] == met[5] == 1 and met[2] == 2
    assert context.activate(memories, (1, 0), 1).first()["id"] == 0
    sim = context.concept_similarity(memories, spark.createDataFrame([(0, [1.0, 0.0])], "concept int, centroid array<double>"))
    assert {r["id"]: r["similarity"] for r in sim.collect()}[0] == 1.0 and sim.count() == 9


def test_hypotheses_and_patterns(spark, memories):
    p = spark.createDataFrame([(1, {"where": "a"})], "id long, known_fields map<string,string>")
    rules = spark.createDataFrame([("where", "a", "x", 0.6)], "field string, given string, value string, confidence double")
    n = spark.createDataFrame([(1, "x", 0.4), (1, "y", 0.7)], "partial_id long, value string, similarity double")
    got = [(r["value"], r["confidence"], r["origin"]) for r in context.hypotheses(p, rules, n).orderBy("rank").collect()]
    assert got == [("y", 0.7, "pattern"), ("x", 0.6, "rule")]
    pat = spark.createDataFrame([("p", [0, 3, 1])], "cluster string, source_episodes array<long>")
    m = spark.createDataFrame([(1, "p", 0.8)], "partial_id long, cluster string, relevance double")
    r = context.pattern_values(m, pat, memories, "where").first()
    assert r["value"] == "a" and r["confidence"] == pytest.approx(2 / 3)


def test_batches_clocks_plugins(spark, memories):
    ops = spark.createDataFrame([(1, "store", 99, [1.0, 0.1], 0.9), (2, "recall", None, [1.0, 0.1], None)], "op_id long, op string, id long, embedding array<double>, confidence double")
    after, found = context.run_batch(ops, memories, 1)
    assert after.count() == 10 and [(r["op_id"], r["id"]) for r in found.collect()] == [(2, 99)]
    c = spark.createDataFrame([({"a": 1}, {"a": 1}), ({"a": 1}, {"a": 2}), ({"a": 1, "b": 1}, {"a": 1}), ({"a": 1}, {"b": 1})], "x map<string,int>, y map<string,int>")
    assert [r[0] for r in c.select(context.compare_clocks(F.col("x"), F.col("y"))).collect()] == ["equal", "before", "after", "concurrent"]
    t = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [r["embedding"] for r in context.embed_with(t, lambda xs: [[float(len(x))] for x in xs]).collect()] == [[2.0], None]
    e, k = context.split_kinds(memories, F.col("id") < 4)
    assert context.count_kinds(e, k).first()[:] == (4, 5)
    assert context.breaker_tripped(101, 0, 10) == "rate" and context.breaker_tripped(1, 5, 10) == "share" and context.breaker_tripped(1, 1, 10) is None


def test_clusters_and_diversity(spark):
    rows = [(i, 0, [1.0, 0.01 * i], 0.9 - i / 100) for i in range(4)] + [(10 + i, 0, [0.01 * i, 1.0], 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, g int, embedding array<double>, confidence double")
    got = {r["id"]: (r["cluster"], r["size"]) for r in consolidation.cluster(df, ["g"], 0.9).collect()}
    assert got == {i: (0, 4) for i in range(4)} | {10 + i: (10, 3) for i in range(3)}
    assert [r["id"] for r in completion.diverse(df, "g").collect()] == [0, 10]
    avg = {r["id"]: r["cluster"] for r in consolidation.cluster(df, ["g"], 0.55, "average").collect()}
    assert len(set(avg.values())) == 2


def test_large_groups_are_clustered_whole(spark):
    """2,100 rows in three directions, with signs of small dimensions at random: three clusters, as of few rows."""
    r = np.random.default_rng(4)
    v = np.hstack([r.normal(0, 0.01, (2100, 8)), np.eye(3)[np.arange(2100) % 3]])
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(v.tolist())], "id long, g int, embedding array<double>")
    got = consolidation.cluster(df, ["g"], 0.8).collect()
    assert {x["id"]: (x["cluster"], x["size"]) for x in got} == {i: (i % 3, 700) for i in range(2100)}


def test_every_partial_meets_the_episodes(spark):
    partials = spark.createDataFrame([(10_000 + i, [1.0, i % 2 / 10]) for i in range(1200)], "id long, embedding array<double>")
    episodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    got = completion.masked_neighbours(partials, episodes, k=1).collect()
    assert sorted((r["partial_id"], r["id"]) for r in got) == [(10_000 + i, 1) for i in range(1200)]


def test_attractor():
    p = np.array([[1.0, 0, 1, 0, 1, 0, 0, 0], [0, 1.0, 0, 1, 0, 1, 0, 0]])
    w = completion.hebbian(p)
    assert (np.diag(w) == 0).all() and (w == w.T).all()
    x, it, ok = completion.converge(w, p[0], share=0.375)
    assert it <= 7 and set(np.flatnonzero(x)) == {0, 2, 4}
    assert completion.energy(w, p[0]) < completion.energy(w, np.ones(8) / 8)
    assert (completion.k_winners(np.array([3.0, 1, 2, 3]), 0.5) == [3, 0, 0, 3]).all()


def test_text_functions(spark):
    q = spark.createDataFrame([("time flies like an arrow",), ("plain",)], "q string")
    parts = [r[0] for r in q.select(X.analogy_parts(F.col("q"))).collect()]
    assert parts[0][:] == ("time flies", "like", "an arrow") and parts[1] is None
    assert q.select(X.levenshtein_suggestion(F.lit("recal"), ["RECALL", "SPREAD"])).first()[0] == "RECALL"
    assert q.select(X.word_similarity(F.lit("red fox"), F.lit("reds"))).first()[0] == 0.5
    v = q.select(V.normalise(F.array(F.lit(3.0), F.lit(4.0))), V.normalise(F.array(F.lit(0.0)))).first()
    assert v[0] == [0.6, 0.8] and v[1] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.floats(0, 5000)), min_size=1, max_size=20))
def test_laws(spark, xs):
    df = spark.createDataFrame(xs, "a double, b double, h double")
    a, b, h = F.col("a"), F.col("b"), F.col("h")
    ops = [C.and_(a, b), C.or_(a, b), C.not_(a), C.combine_weighted(a, b, 1.0, 3.0), C.update_with_base_rate(a, b), C.blend(a, b, 0.7, 0.3), D.exponential(a, h), D.power_law(a, h), D.hybrid(a, h), D.lazy(a, h, 2), D.neocortical(a, h / 24)]
    for r in df.select(*(o.alias(f"o{i}") for i, o in enumerate(ops))).collect():
        assert all(0 <= x <= 1 for x in r)
    same = df.select(F.abs(C.and_(a, b) - C.and_(b, a)), F.abs(C.not_(C.and_(a, b)) - C.or_(C.not_(a), C.not_(b))), C.and_(a, b) <= F.least(a, b) + 1e-12, D.exponential(a, h + 1) <= D.exponential(a, h))
    assert all(r[0] == 0 and r[1] < 1e-9 and r[2] and r[3] for r in same.collect())


def test_blended_recall(spark):
    e = spark.createDataFrame([(1, 0.8), (2, 0.6)], "id long, confidence double")
    s = spark.createDataFrame([(2, 0.7, 0.9), (3, 0.5, 0.2)], "id long, confidence double, coherence double")
    got = {r["id"]: (round(r["confidence"], 3), r["source"]) for r in recall.blended(e, s).collect()}
    assert got[1] == (0.8, "episodic") and got[2][1] == "both" and got[2][0] > 0.7 and got[3] == (0.45, "semantic")
