"""Graphs, consolidation, completion, effects on memory, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decay as D
from ..functions import vectors as V
from ..operators import cognition as G
from ..operators import completion as M
from ..operators import consolidation as K
from ..operators import cues as Q
from ..operators import graph
from ..operators import recall as P
from ..sources import tables as T
from ..store import keep
from ..streaming import observe as S
from .relational import _QUERY, _SQL_C, _SQL_M, _SQL_Q
from .scalar import EPISODES, _r

# Parts bought together: an edge's weight is the pair's orders by the source's.
_SQL_EDGES = """b AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), n AS (SELECT x.p AS src, y.p AS dst, count(*) AS n FROM b x JOIN b y ON x.k = y.k AND x.p <> y.p GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT p AS src, count(*) AS t FROM b GROUP BY 1), g AS (SELECT src, dst, n, n / t AS weight FROM n JOIN t USING (src))"""


def edges(spark, d) -> DataFrame:
    return G.basket_associations(T.purchases(spark, d), "basket", "item")


def associative_edges(spark, d):
    return edges(spark, d).select("src", "dst", "n", _r(F.col("weight"), "weight"))


EDGES = f"WITH {_SQL_EDGES} SELECT src, dst, n, round(weight, 6) AS weight FROM g"


def _seeds(spark, d) -> DataFrame:
    return T.read(spark, d, "part").where("p_partkey <= 5").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("activation"))


def spread_one_step(spark, d):
    return graph.spread_one_step(edges(spark, d), _seeds(spark, d), 0.8).select("id", _r(F.col("activation"), "activation"))


ONE_STEP = f"""WITH {_SQL_EDGES} SELECT dst AS id, round(least(CASE WHEN dst <= 5 THEN 1.0 ELSE 0.0 END + sum(weight * 0.8), 1), 6) AS activation FROM g WHERE src <= 5 GROUP BY dst"""


def spread_two_hops(spark, d):
    out = graph.spread(keep(edges(spark, d)), _seeds(spark, d), 2)
    return out.select("id", _r(F.col("activation"), "activation"), _r(F.col("confidence"), "confidence"), "tier", "depth")


TWO_HOPS = f"""WITH {_SQL_EDGES}, s AS (SELECT p_partkey AS id FROM part WHERE p_partkey <= 5),
l1 AS (SELECT dst AS id, sum(weight * exp(-0.7)) AS a FROM g WHERE src IN (SELECT id FROM s) GROUP BY 1),
t1 AS (SELECT coalesce(s.id, l1.id) AS id, least(CASE WHEN s.id IS NULL THEN 0 ELSE 1 END + coalesce(a, 0), 1) AS total, CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS depth, s.id IS NOT NULL AND l1.id IS NOT NULL AS again, a FROM s FULL JOIN l1 ON s.id = l1.id),
l2 AS (SELECT dst AS id, sum(a * weight * exp(-1.4)) AS b FROM t1 JOIN g ON src = t1.id WHERE a IS NOT NULL AND total >= CASE depth WHEN 0 THEN 0.01 ELSE 0.05 END GROUP BY 1),
t2 AS (SELECT coalesce(t1.id, l2.id) AS id, least(coalesce(total, 0) + coalesce(b, 0), 1) AS total, coalesce(depth, 2) AS depth, coalesce(again, false) OR (t1.id IS NOT NULL AND l2.id IS NOT NULL) AS again FROM t1 FULL JOIN l2 ON t1.id = l2.id),
f AS (SELECT id, depth, CASE WHEN total >= CASE depth WHEN 0 THEN 0.01 ELSE 0.05 END THEN total ELSE 0 END * CASE WHEN again THEN 0.93 ELSE 1 END AS a FROM t2)
SELECT id, round(a, 6) AS activation, round(a * CASE depth WHEN 0 THEN 1 ELSE 0.95 END, 6) AS confidence, CASE depth WHEN 0 THEN 'hot' ELSE 'warm' END AS tier, depth FROM f"""


def bfs_depth(spark, d):
    return graph.bfs(keep(edges(spark, d)), _seeds(spark, d), 2).select("id", "depth")


BFS = f"""WITH {_SQL_EDGES}, s AS (SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_partkey <= 5), a AS (SELECT DISTINCT dst AS id, 1 AS depth FROM g WHERE src IN (SELECT id FROM s)),
c AS (SELECT DISTINCT dst AS id, 2 AS depth FROM g WHERE src IN (SELECT id FROM a)) SELECT id, min(depth) AS depth FROM (SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY id"""


def spread_normalised(spark, d):
    start = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("activation"))
    return graph.spread_csr(keep(edges(spark, d)), start, 2).select("id", _r(F.col("activation"), "activation"))


NORMALISED = f"""WITH {_SQL_EDGES}, s0 AS (SELECT p_partkey AS id, p_size / 50 AS a FROM part), i1 AS (SELECT dst AS id, sum(a * weight) AS x FROM s0 JOIN g ON src = id GROUP BY 1),
r1 AS (SELECT coalesce(s0.id, i1.id) AS id, coalesce(a, 0) + coalesce(x, 0) AS a FROM s0 FULL JOIN i1 ON s0.id = i1.id), s1 AS (SELECT id, a / greatest(max(a) OVER (), 1) AS a FROM r1),
i2 AS (SELECT dst AS id, sum(a * weight) AS x FROM s1 JOIN g ON src = id GROUP BY 1), r2 AS (SELECT coalesce(s1.id, i2.id) AS id, coalesce(a, 0) + coalesce(x, 0) AS a FROM s1 FULL JOIN i2 ON s1.id = i2.id)
SELECT id, round(a / greatest(max(a) OVER (), 1), 6) AS activation FROM r2"""


def spread_hierarchical(spark, d):
    seeds = spark.createDataFrame([("r1", 1.0), ("c7", 0.9)], "id string, activation double")
    return graph.spread_hierarchical(keep(T.hierarchy(spark, d)), seeds, 2).select("id", _r(F.col("activation"), "activation"), "depth")


_SQL_H = """h0 AS (SELECT 'r' || n_regionkey AS hi, 'n' || n_nationkey AS lo, 0.9 AS w FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 0.8 FROM customer),
h AS (SELECT hi AS src, lo AS dst, w * 0.6 AS w FROM h0 UNION ALL SELECT lo, hi, w * 0.8 FROM h0)"""
HIERARCHICAL = f"""WITH {_SQL_H}, s AS (SELECT 'r1' AS id, 1.0 AS a, 0 AS depth UNION ALL SELECT 'c7', 0.9, 0), a AS (SELECT dst AS id, a * w AS a, 1 AS depth, s.id AS via FROM s JOIN h ON src = id WHERE a * w >= 0.01),
b AS (SELECT dst AS id, a * w * 0.8 AS a, 2 AS depth FROM a JOIN h ON src = id WHERE dst <> via AND a * w * 0.8 >= 0.01), u AS (SELECT id, a, depth FROM s UNION ALL SELECT id, a, depth FROM a UNION ALL SELECT * FROM b)
SELECT id, round(max(a), 6) AS activation, min(depth) AS depth FROM u GROUP BY id"""


def fan_effect(spark, d):
    return graph.fan_effect(edges(spark, d)).select("id", "fan", _r(F.col("retrieval_ms"), "retrieval_ms"), _r(F.col("root_share"), "root_share"))


FAN = f"""WITH {_SQL_EDGES}, o AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), k AS (SELECT src AS id FROM g UNION SELECT dst FROM g), f AS (SELECT id, CAST(greatest(coalesce(n, 0), 1) AS BIGINT) AS fan FROM k LEFT JOIN o USING (id))
SELECT id, fan, 1150.0 + 70.0 * (fan - 1) AS retrieval_ms, round(1 / sqrt(fan), 6) AS root_share FROM f"""


def fan_statistics(spark, d):
    return graph.fan_statistics(edges(spark, d)).select("nodes", _r(F.col("mean"), "mean"), "largest", "median", "high")


FAN_STATISTICS = f"""WITH {_SQL_EDGES}, o AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), k AS (SELECT src AS id FROM g UNION SELECT dst FROM g), f AS (SELECT CAST(greatest(coalesce(n, 0), 1) AS BIGINT) AS fan FROM k LEFT JOIN o USING (id)),
r AS (SELECT fan, row_number() OVER (ORDER BY fan) - 1 AS i, count(*) OVER () AS c FROM f)
SELECT count(*) AS nodes, round(avg(fan), 6) AS mean, max(fan) AS largest, max(CASE WHEN i = c // 2 THEN fan END) AS median, CAST(sum(CASE WHEN fan > 3 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM r"""


def _bindings(spark, d) -> DataFrame:
    m = T.memories(spark, d)
    c = V.mean_vector(m, ["concept"])
    return m.join(F.broadcast(c), "concept").select(F.col("id").alias("episode_id"), F.col("concept").alias("concept_id"), F.greatest(V.cosine(F.col("embedding"), F.col("centroid")), F.lit(0.0)).alias("strength"))


def bindings(spark, d):
    b = keep(_bindings(spark, d))
    left = graph.binding_gc(graph.binding_decay(b, 0.9), 0.1)
    sources = T.memories(spark, d).select("id", F.col("confidence").alias("activation"))
    met = graph.spread_through_bindings(left, sources, 0.1)
    return met.select("id", _r(F.col("activation"), "activation"))


BINDINGS = f"""WITH {_SQL_M}, {_SQL_C}, b AS (SELECT m.id, m.concept, m.a, 0.9 * greatest(list_cosine_similarity(m.v, c.v), 0) AS s FROM m JOIN c USING (concept))
SELECT concept AS id, round(least(sum(a * s * 0.1), 1), 6) AS activation FROM b WHERE s >= 0.1 GROUP BY 1"""


def recall_pipeline(spark, d):
    """Seed, spread along similarity links, merge, decay, rank: the 50 best (a top-k report)."""
    m = T.vector_episodes(spark, d)
    from ..operators import nearest

    links = keep(nearest.knn_join(m, m, 5, 0.1))
    e = links.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("weight"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return P.recall(m, keep(both), Q.EmbeddingCue(_QUERY, 0.1, 50), T.AS_OF, 2, 50).select("id", _r(F.col("score"), "score"), _r(F.col("confidence"), "confidence"))


def proactive(spark, d):
    return G.proactive(T.vector_episodes(spark, d).withColumn("id", F.col("id")), 48.0, 0.1).select("id", "n", _r(F.col("magnitude"), "magnitude"))


_SQL_VE = "ve AS (SELECT event_id AS id, ts, user_id AS who, label AS concept, embedding::DOUBLE[] AS v, 0.5 + 0.5 * ((event_id * 37) % 100) / 100 AS a FROM events JOIN embeddings ON vec_id = event_id)"
PROACTIVE = f"""WITH {_SQL_VE}, p AS (SELECT l.id, count(*) AS n FROM ve l JOIN ve r ON r.ts < l.ts AND r.ts >= l.ts - INTERVAL 48 HOUR WHERE round(list_cosine_similarity(l.v, r.v), 6) >= 0.1 GROUP BY 1)
SELECT id, n, round(least(0.05 * n, 0.3), 6) AS magnitude FROM p"""


def retroactive(spark, d):
    return G.retroactive(T.vector_episodes(spark, d), 24.0, 0.2, ["concept"]).select("id", "n", _r(F.col("magnitude"), "magnitude", 10))


RETROACTIVE = f"""WITH {_SQL_VE}, p AS (SELECT r.id, round(list_cosine_similarity(l.v, r.v), 6) AS s FROM ve l JOIN ve r ON l.concept = r.concept AND r.ts < l.ts AND r.ts >= l.ts - INTERVAL 24 HOUR)
SELECT id, count(*) AS n, round(least(0.15 * avg((s - 0.6) / 0.4) * sqrt(count(*)), 0.25), 10) AS magnitude FROM p WHERE s >= 0.2 GROUP BY 1"""


def temporal_neighbours(spark, d):
    e = T.episodes(spark, d)
    a = e.where("id % 20 = 0")
    out = G.temporal_neighbours(a, e, 2.0, ["who"])
    return out.select("anchor_id", "id", _r(F.col("hours_apart"), "hours_apart"), _r(M.recency_weight(F.col("hours_apart"), 2.0), "weight"))


TEMPORAL_NEIGHBOURS = """WITH p AS (SELECT a.event_id AS anchor_id, e.event_id AS id, abs(epoch_us(a.ts) - epoch_us(e.ts)) / 3.6e9 AS h FROM events a JOIN events e ON a.user_id = e.user_id AND a.event_id <> e.event_id WHERE a.event_id % 20 = 0 AND a.ts <> e.ts)
SELECT anchor_id, id, round(h, 6) AS hours_apart, round(pow(greatest(1 - h / 2, 0), 2), 6) AS weight FROM p WHERE h <= 2"""


def associations(spark, d):
    return G.associations(T.episodes(spark, d), "who", "what", 3600.0 * 6).select("prime", "target", "n", _r(F.col("strength"), "strength"))


ASSOCIATIONS = """WITH p AS (SELECT l.event_type AS x, r.event_type AS y FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts < l.ts AND r.ts >= l.ts - INTERVAL 6 HOUR WHERE l.event_type <> r.event_type),
b AS (SELECT x AS prime, y AS target, count(*) AS n FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p) GROUP BY 1, 2 HAVING count(*) >= 2), t AS (SELECT event_type AS prime, count(*) AS t FROM events GROUP BY 1)
SELECT prime, target, n, round(least(n / t, 1), 6) AS strength FROM b JOIN t USING (prime)"""


def priming(spark, d):
    n = T.episodes(spark, d).groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"))
    rep = G.repetition_boost(F.col("n") % 10)
    sem = G.priming_boost(F.col("c") * 0.15, F.col("n") * 10, F.col("n") % 4, others=0.1)
    return n.select("who", _r(rep, "repetition"), _r(sem, "semantic"), _r(G.total_boost(rep, sem), "total"), _r(G.apply_interference(F.col("c"), rep), "after"))


PRIMING = f"""WITH {EPISODES}, n AS (SELECT user_id AS who, count(*) AS n, max(a) AS c FROM e GROUP BY 1), x AS (SELECT *, least(0.05 * (n % 10), 0.3) AS rep, c * 0.15 * pow(0.5, n * 10 / 300) * (1 + 0.1 * (n % 4 - 1)) AS dec FROM n),
y AS (SELECT *, CASE WHEN n * 10 < 50 THEN 0 ELSE 0.5 * tanh(greatest(dec - 0.3 * greatest(0.1 - dec, 0), 0) / 0.5) END AS sem FROM x)
SELECT who, round(rep, 6) AS repetition, round(sem, 6) AS semantic, round(1 - exp(-(rep + sem)), 6) AS total, round(c * (1 - rep), 6) AS after FROM y"""


def reconsolidation(spark, d):
    e = T.read(spark, d, "events")
    born = e.groupBy("user_id").agg(F.min("ts").alias("born"))
    recalls = e.where("event_type = 'view'").join(born, "user_id").select(F.col("user_id").alias("id"), "born", F.col("ts").alias("recalled"), (F.col("event_id") % 2 == 0).alias("active"))
    kind = F.when(F.col("event_id") % 3 == 0, "update").when(F.col("event_id") % 3 == 1, "corruption").otherwise("replacement")
    changes = e.where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"), (F.col("value") % 1).alias("extent"), F.lit(0.6).alias("confidence"))
    out = G.reconsolidate(recalls, changes)
    return out.select("id", "kind", _r(F.col("hours"), "hours"), _r(F.col("plasticity"), "plasticity"), _r(F.col("confidence"), "confidence"))


RECONSOLIDATION = """WITH b AS (SELECT user_id, min(ts) AS born FROM events GROUP BY 1), r AS (SELECT user_id AS id, born, ts FROM events JOIN b USING (user_id) WHERE event_type = 'view' AND event_id % 2 = 0),
c AS (SELECT DISTINCT user_id AS id, ts AS chg, CASE event_id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'corruption' ELSE 'replacement' END AS kind, value % 1 AS e FROM events WHERE event_type = 'click'),
m AS (SELECT c.id, chg, kind, e, min((epoch_us(chg) - epoch_us(ts)) / 3.6e9) AS h FROM c JOIN r ON c.id = r.id WHERE (epoch_us(chg) - epoch_us(ts)) / 3.6e9 BETWEEN 1 AND 6 AND (epoch_us(ts) - epoch_us(born)) / 8.64e10 BETWEEN 1 AND 365 GROUP BY 1, 2, 3, 4),
p AS (SELECT *, 2 * ((h - 1) / 5) * (1 - (h - 1) / 5) AS p FROM m)
SELECT id, kind, round(h, 6) AS hours, round(p, 6) AS plasticity, round(CASE kind WHEN 'update' THEN 0.6 + 0.1 * p WHEN 'corruption' THEN greatest(0.6 - e * p * 0.2, 0.1) ELSE least(greatest(e, 0.3), 0.8) END, 6) AS confidence FROM p"""


def _members(spark, d) -> DataFrame:
    return T.vector_episodes(spark, d).withColumn("cluster", F.col("concept"))


def pattern_strength(spark, d):
    p = K.pattern_strength(_members(spark, d))
    return p.select("cluster", "n", _r(F.col("strength"), "strength"), _r(K.chi_square_p(F.col("n"), F.col("strength")), "p"), _r(K.mutual_information(F.col("strength"), F.col("n")), "information"), _r(K.likelihood_ratio(F.col("strength"), F.col("n")), "likelihood"))


PATTERN_STRENGTH = f"""WITH {_SQL_VE}, c AS (SELECT concept, list(x ORDER BY i) AS v FROM (SELECT concept, i, avg(v[i]) AS x FROM ve, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT concept, avg(list_cosine_similarity(ve.v, c.v)) AS s, count(*) AS n FROM ve JOIN c USING (concept) GROUP BY 1)
SELECT concept AS cluster, n, round(s, 6) AS strength, round(exp(-pow(n - 2 / s, 2) / (2 / s) / 2), 6) AS p, round(s * ln(1 + n / 10), 6) AS information, round(ln(s) + ln(n), 6) AS likelihood FROM s"""


def cluster_coherence(spark, d):
    return K.coherence(_members(spark, d)).select("cluster", "n", _r(F.col("coherence"), "coherence"))


COHERENCE = f"""WITH {_SQL_VE} SELECT x.concept AS cluster, CAST(count(DISTINCT x.id) AS BIGINT) AS n, round(sum(CASE WHEN x.id <> y.id THEN 1 / (1 + exp(-10 * (list_cosine_similarity(x.v, y.v) - 0.5))) END) / count(CASE WHEN x.id <> y.id THEN 1 END), 6) AS coherence
FROM ve x JOIN ve y ON x.concept = y.concept GROUP BY 1"""


def replay_weights(spark, d):
    return K.replay_weights(_members(spark, d), T.AS_OF).select("id", "cluster", _r(F.col("weight"), "weight"))


REPLAY_WEIGHTS = f"""WITH {_SQL_VE}, r AS (SELECT id, concept, exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9 / 24) * 1.5 * a AS r FROM ve)
SELECT id, concept AS cluster, round(r / sum(r) OVER (PARTITION BY concept), 6) AS weight FROM r"""


def compaction(spark, d):
    old = T.episodes(spark, d).where(K.eligible_for_compaction(T.AS_OF))
    return old.select("id", _r(F.col("confidence"), "confidence"))


COMPACTION = f"WITH {EPISODES} SELECT id, round(a, 6) AS confidence FROM e WHERE h / 24 >= 7 AND a < 0.95"


def compactable(spark, d):
    m = _members(spark, d)
    return K.compactable(m, K.pattern_strength(m), 0.2).select("cluster", "n", _r(F.col("lowest"), "lowest"), "ok")


COMPACTABLE = f"""WITH {_SQL_VE}, c AS (SELECT concept, list(x ORDER BY i) AS v FROM (SELECT concept, i, avg(v[i]) AS x FROM ve, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT concept, min(list_cosine_similarity(ve.v, c.v)) AS s, count(*) AS n FROM ve JOIN c USING (concept) GROUP BY 1) SELECT concept AS cluster, n, round(s, 6) AS lowest, s >= 0.2 AS ok FROM s"""


def cluster_patterns(spark, d):
    """Centroid-linkage clusters within concepts."""
    return K.cluster(_members(spark, d).drop("cluster"), ["concept"], 0.35).select("concept", "id", "cluster", "size", _r(F.col("coherence"), "coherence"))


def dream_cycle(spark, d):
    return K.dream(_members(spark, d).drop("cluster"), T.AS_OF, ["concept"], 0.3).select("cluster", "n", _r(F.col("strength"), "strength"), _r(F.col("lowest"), "lowest"), "compact")


def proto_upsert(spark, d):
    e = T.episodes(spark, d)
    proto = lambda df, n: df.groupBy(F.col("who").cast("string").alias("signature")).agg(F.avg("confidence").alias("coherence"), F.lit(0.5).alias("strength"), F.lit(n).alias("replay_count"), F.collect_set("what").alias("episodes"), F.lit(1).alias("last_cycle"))
    out = K.upsert_protos(proto(e.where("id % 2 = 0"), 3), proto(e.where("who % 3 = 0"), 1), 9)
    return out.select("signature", _r(F.col("coherence"), "coherence", 10), _r(F.col("strength"), "strength"), "replay_count", F.size("episodes").cast("long").alias("n"), "last_cycle", K.ready_for_promotion().alias("ready"), K.proto_garbage(60).alias("garbage"))


PROTO = f"""WITH {EPISODES}, p AS (SELECT user_id, avg(a) AS c, list(DISTINCT event_type) AS l FROM e WHERE id % 2 = 0 GROUP BY 1), s AS (SELECT user_id, avg(a) AS c, list(DISTINCT event_type) AS l FROM e WHERE user_id % 3 = 0 GROUP BY 1),
j AS (SELECT coalesce(p.user_id, s.user_id) AS u, p.user_id IS NOT NULL AND s.user_id IS NOT NULL AS again, p.user_id IS NULL AS new, p.c AS pc, s.c AS sc, len(list_distinct(coalesce(p.l, []) || coalesce(s.l, []))) AS n, s.user_id IS NOT NULL AS seen FROM p FULL JOIN s ON p.user_id = s.user_id),
r AS (SELECT u, CASE WHEN again THEN (pc * 3 + sc) / 4 ELSE coalesce(pc, sc) END AS c, CASE WHEN again THEN 0.52 ELSE 0.5 END AS s, CASE WHEN again THEN 4 WHEN new THEN 1 ELSE 3 END AS k, n, CASE WHEN seen THEN 9 ELSE 1 END AS l FROM j)
SELECT CAST(u AS VARCHAR) AS signature, round(c, 10) AS coherence, s AS strength, k AS replay_count, CAST(n AS BIGINT) AS n, l AS last_cycle, s > 0.1 AND k >= 3 AND c > 0.65 AS ready, 60 - l > 50 AS garbage FROM r"""


def formations(spark, d):
    return K.formations_last_hour(T.episodes(spark, d), "who").select("id", "formations")


FORMATIONS = "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS formations FROM events"


def _partials(spark, d) -> DataFrame:
    return T.memories(spark, d).where("id % 20 = 0").select("id", "concept", Q.to_partial(F.col("embedding"), 0.5).alias("embedding"))


def masked_neighbours(spark, d):
    return M.masked_neighbours(_partials(spark, d), T.memories(spark, d), 7, 0.1, ["concept"]).select("partial_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


_SQL_MASKED = f"""{_SQL_M}, mn AS (SELECT p.id AS partial_id, e.id, round(list_cosine_similarity(p.v[33:], e.v[33:]), 6) AS similarity FROM m p JOIN m e ON p.concept = e.concept AND p.id <> e.id WHERE p.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY partial_id ORDER BY similarity DESC, id) AS rank FROM mn WHERE similarity >= 0.1)"""
MASKED = f"WITH {_SQL_MASKED} SELECT * FROM r WHERE rank <= 7"


def field_votes(spark, d):
    n = keep(M.masked_neighbours(_partials(spark, d), T.memories(spark, d), 7, 0.1, ["concept"]))
    voted = n.join(T.episodes(spark, d).select("id", "what"), "id")
    v = M.vote(voted, ["partial_id"], "what", "similarity")
    return v.select("partial_id", "what", _r(F.col("confidence"), "confidence"), M.source_of(F.lit(False), F.col("confidence"), F.lit(0.8)).alias("source"))


FIELD_VOTES = f"""WITH {_SQL_MASKED}, w AS (SELECT partial_id, event_type AS what, sum(similarity) AS w FROM r JOIN events ON event_id = id WHERE rank <= 7 GROUP BY 1, 2), t AS (SELECT *, w / sum(w) OVER (PARTITION BY partial_id) AS c, row_number() OVER (PARTITION BY partial_id ORDER BY round(w, 9) DESC, what) AS n FROM w)
SELECT partial_id, what, round(c, 6) AS confidence, CASE WHEN c >= 0.7 THEN 'consolidated' WHEN c >= 0.5 THEN 'reconstructed' ELSE 'imagined' END AS source FROM t WHERE n = 1"""


def reconstruct(spark, d):
    p, m = _partials(spark, d), T.memories(spark, d)
    n = keep(M.masked_neighbours(p, m, 7, 0.1, ["concept"]))
    return M.reconstruct_embedding(p, n, m).select("id", _r(F.col("embedding")[0], "x0"), _r(F.col("embedding")[31], "x31"), _r(F.col("embedding")[63], "x63"))


RECONSTRUCT = f"""WITH {_SQL_MASKED}, a AS (SELECT partial_id AS id, avg(v[1]) AS x0, avg(v[32]) AS x31 FROM r JOIN m ON m.id = r.id WHERE rank <= 7 GROUP BY 1)
SELECT m.id, round(coalesce(x0, 0), 6) AS x0, round(coalesce(x31, 0), 6) AS x31, round(v[64], 6) AS x63 FROM m LEFT JOIN a USING (id) WHERE m.id % 20 = 0"""


def completed(spark, d):
    """The attractor network on the partial vectors."""
    w = M.hebbian_weights(T.memories(spark, d))
    return M.complete(_partials(spark, d), w).select("id", "iterations", "converged", _r(F.col("confidence"), "confidence"))


def integration(spark, d):
    e = T.episodes(spark, d)
    side = lambda df: df.groupBy(F.col("who").alias("field")).agg(F.max("what").alias("value"), F.avg("confidence").alias("confidence"))
    return M.integrate(side(e.where("id % 2 = 0")), side(e.where("id % 3 = 0"))).select("field", "value", _r(F.col("confidence"), "confidence"), "agree")


INTEGRATION = f"""WITH {EPISODES}, l AS (SELECT user_id AS f, max(event_type) AS v, avg(a) AS c FROM e WHERE id % 2 = 0 GROUP BY 1), g AS (SELECT user_id AS f, max(event_type) AS v, avg(a) AS c FROM e WHERE id % 3 = 0 GROUP BY 1)
SELECT coalesce(l.f, g.f) AS field, CASE WHEN g.v IS NULL OR coalesce(l.c, 0) >= coalesce(g.c, 0) THEN coalesce(l.v, g.v) ELSE g.v END AS value,
    round(CASE WHEN l.v = g.v THEN least(greatest(l.c, g.c) * 1.2, 1) ELSE greatest(coalesce(l.c, 0), coalesce(g.c, 0)) END, 6) AS confidence, coalesce(l.v = g.v, false) AS agree FROM l FULL JOIN g ON l.f = g.f"""


def consistency(spark, d):
    return T.episodes(spark, d).groupBy("who").agg(_r(M.consistency(F.col("confidence")), "consistency"), _r(M.plausibility(F.avg("confidence"), F.max("confidence")), "plausibility"))


CONSISTENCY = f"""WITH {EPISODES} SELECT user_id AS who, round(CASE WHEN count(*) < 2 THEN 1 ELSE 1 - least(stddev_pop(a) / avg(a), 1) END, 6) AS consistency,
    round((0.3 * avg(a) + 0.7 * max(a)) * CASE WHEN max(a) < 0.6 THEN 0.5 ELSE 1 END, 6) AS plausibility FROM e GROUP BY 1"""


def top_people(spark, d):
    e = T.episodes(spark, d).select(F.col("what"), F.array(F.col("who")).alias("who"))
    return M.top_people(e, ["what"]).select("what", "person", "n", F.col("rank").cast("long").alias("rank"))


TOP_PEOPLE = "WITH n AS (SELECT event_type AS what, user_id AS person, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY n DESC, person) AS rank FROM n) SELECT * FROM r WHERE rank <= 3"


def _observations(spark, d) -> DataFrame:
    """Events as observations: a session per user; every seventh comes with the number of the one before, every eleventh skips one."""
    from pyspark.sql.window import Window

    e = T.read(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seq = n - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0) + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), seq.cast("long").alias("seq"), n.alias("arrival"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("what"), "value")


def sequence_gaps(spark, d):
    return S.sequence_gaps(_observations(spark, d)).select("id", "seq", "status")


SEQUENCE = """WITH o AS (SELECT event_id AS id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), s AS (SELECT *, n - CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS seq FROM o),
x AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), seq - 1) + 1 AS want FROM s)
SELECT id, seq, CASE WHEN seq = want THEN 'ok' WHEN seq < want THEN 'duplicate' ELSE 'gap' END AS status FROM x"""


def _epoch(c: str, name: str):
    return F.unix_seconds(F.col(c)).alias(name)


def stream_tumbling(spark, d):
    return S.tumbling(_observations(spark, d)).select(_epoch("start", "start"), "what", "n", _r(F.col("total"), "total"))


TUMBLING = "SELECT epoch_us(ts) // 3600000000 * 3600 AS start, event_type AS what, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


def stream_sliding(spark, d):
    return S.sliding(_observations(spark, d)).select(_epoch("start", "start"), "n")


SLIDING = "SELECT (epoch_us(ts) // 1800000000 - k) * 1800 AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1"


def stream_sessions(spark, d):
    return S.sessions(_observations(spark, d), 120).select("session_id", _epoch("start", "start"), _epoch("end", "end"), "n")


SESSIONS = """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id AS session_id, epoch_us(min(ts)) // 1000000 AS start, epoch_us(max(ts)) // 1000000 + 7200 AS "end", count(*) AS n FROM s GROUP BY user_id, k"""


def backpressure(spark, d):
    n = T.read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("depth"), F.avg("value").alias("rate"))
    p = F.least(F.col("depth") / 100, F.lit(1.0))
    return n.select(F.col("user_id").alias("id"), S.pressure_state(p).alias("state"), S.batch_size(p).cast("long").alias("batch"), _r(S.retry_after_seconds(F.col("depth"), F.col("rate")), "retry"))


BACKPRESSURE = """WITH n AS (SELECT user_id AS id, count(*) AS d, avg(value) AS r, least(count(*) / 100, 1) AS p FROM events GROUP BY 1)
SELECT id, CASE WHEN p < 0.5 THEN 'normal' WHEN p < 0.8 THEN 'warning' WHEN p < 0.95 THEN 'critical' ELSE 'overloaded' END AS state, CAST(CASE WHEN p < 0.5 THEN 10 WHEN p < 0.8 THEN 100 WHEN p < 0.95 THEN 500 ELSE 1000 END AS BIGINT) AS batch,
    round(CASE WHEN r < 1 THEN 60 ELSE least((d - d // 2) / r, 300) END, 6) AS retry FROM n"""


def ssts_states(spark, d):
    e = T.episodes(spark, d)
    rows = F.array_sort(F.collect_list(F.struct("when", "id", (F.col("value") > 30).alias("success"), (1 + F.col("value") % 1).alias("effort"), "confidence")))
    f = D.ssts_fold(F.transform("e", lambda x: F.struct(x["success"].alias("success"), x["effort"].alias("effort"), x["confidence"].alias("confidence"))))
    s = e.groupBy("who").agg(rows.alias("e")).select("who", f.alias("s"))
    return s.select("who", _r(F.col("s.s"), "stability"), _r(F.col("s.r"), "retrievability"), _r(F.col("s.d"), "difficulty"))


SSTS = f"""WITH RECURSIVE {EPISODES}, x AS (SELECT user_id AS who, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n, value > 30 AS ok, 1 + value % 1 AS effort, a FROM e),
f AS (SELECT DISTINCT who, CAST(0 AS BIGINT) AS k, CAST(1.0 AS DOUBLE) AS s, CAST(0.9 AS DOUBLE) AS r, CAST(5.0 AS DOUBLE) AS d FROM x
UNION ALL SELECT f.who, k + 1, CASE WHEN ok THEN s + d * 1.1 * (1 + 0.9 * (effort - 1)) ELSE s * 0.95 END, CASE WHEN ok THEN 0.9 + 0.08 * a ELSE 0.1 END, CASE WHEN ok THEN d ELSE d * 1.15 END FROM f JOIN x ON x.who = f.who AND x.n = f.k + 1)
SELECT who, round(max_by(s, k), 6) AS stability, round(max_by(r, k), 6) AS retrievability, round(max_by(d, k), 6) AS difficulty FROM f GROUP BY who"""

_RECALL_THRESHOLD = "CASE depth WHEN 0 THEN 0.01 ELSE 0.05 END"
RECALL_PIPELINE = f"""WITH {_SQL_Q}, {_SQL_VE}, p AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS s FROM ve x JOIN ve y ON x.id <> y.id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p WHERE s >= 0.1), g AS (SELECT src, dst, max(weight) AS weight FROM (SELECT a AS src, b AS dst, s AS weight FROM k WHERE n <= 5 UNION ALL SELECT b, a, s FROM k WHERE n <= 5) GROUP BY 1, 2),
h AS (SELECT id, list_cosine_similarity(v, q) AS sim FROM ve, q WHERE list_cosine_similarity(v, q) >= 0.1 ORDER BY sim DESC, id LIMIT 50), s AS (SELECT id, sim, 1 / (1 + exp(-(sim - 0.4) / 0.5)) AS a FROM h WHERE 1 / (1 + exp(-(sim - 0.4) / 0.5)) >= 0.01),
l1 AS (SELECT dst AS id, sum(a * weight * exp(-0.7)) AS l FROM s JOIN g ON src = id GROUP BY 1),
t1 AS (SELECT coalesce(s.id, l1.id) AS id, least(coalesce(a, 0) + coalesce(l, 0), 1) AS total, CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS depth, s.id IS NOT NULL AND l1.id IS NOT NULL AS again, l FROM s FULL JOIN l1 ON s.id = l1.id),
l2 AS (SELECT dst AS id, sum(l * weight * exp(-1.4)) AS l FROM t1 JOIN g ON src = t1.id WHERE l IS NOT NULL AND total >= {_RECALL_THRESHOLD} GROUP BY 1),
t2 AS (SELECT coalesce(t1.id, l2.id) AS id, least(coalesce(total, 0) + coalesce(l2.l, 0), 1) AS total, coalesce(depth, 2) AS depth, coalesce(again, false) OR (t1.id IS NOT NULL AND l2.id IS NOT NULL) AS again FROM t1 FULL JOIN l2 ON t1.id = l2.id),
f AS (SELECT id, depth, CASE WHEN total >= {_RECALL_THRESHOLD} THEN total ELSE 0 END * CASE WHEN again THEN 0.93 ELSE 1 END AS act FROM t2),
m AS (SELECT f.id, act, sim, least(act * CASE depth WHEN 0 THEN 1 ELSE 0.95 END * CASE WHEN sim IS NULL THEN 1 ELSE 1.1 END, 1) AS base, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9, 0) AS h FROM f LEFT JOIN s USING (id) JOIN ve ON ve.id = f.id),
w AS (SELECT *, CASE WHEN id % 6 >= 3 THEN least(greatest(base * greatest(pow(1 + h / 24, -0.3 / 1.12), 0.01), 0.3), 1) ELSE base * exp(-h / 1.96) END AS two FROM m), c AS (SELECT *, least(greatest(two * CASE WHEN two > 0.7 THEN 0.965 ELSE 1.005 END, 0.1), 1) AS conf FROM w),
o AS (SELECT id, conf, CASE WHEN sim IS NULL THEN act * conf ELSE (act * conf + sim) / 2 END * CASE WHEN h <= 24 THEN 1 + 0.2 * (1 - h / 24) ELSE 1 END AS score FROM c WHERE conf >= 0.1)
SELECT id, round(score, 6) AS score, round(conf, 6) AS confidence FROM o ORDER BY o.score DESC, id LIMIT 50"""


_ALL = {
    "associative_edges": (associative_edges, EDGES), "spread_one_step": (spread_one_step, ONE_STEP), "spread_two_hops": (spread_two_hops, TWO_HOPS), "bfs_depth": (bfs_depth, BFS), "spread_normalised": (spread_normalised, NORMALISED),
    "spread_hierarchical": (spread_hierarchical, HIERARCHICAL), "fan_effect": (fan_effect, FAN), "fan_statistics": (fan_statistics, FAN_STATISTICS), "concept_bindings": (bindings, BINDINGS), "recall_pipeline": (recall_pipeline, RECALL_PIPELINE),
    "proactive_interference": (proactive, PROACTIVE), "retroactive_interference": (retroactive, RETROACTIVE), "temporal_neighbours": (temporal_neighbours, TEMPORAL_NEIGHBOURS), "associative_strength": (associations, ASSOCIATIONS),
    "priming": (priming, PRIMING), "reconsolidation": (reconsolidation, RECONSOLIDATION), "pattern_strength": (pattern_strength, PATTERN_STRENGTH), "cluster_coherence": (cluster_coherence, COHERENCE), "replay_weights": (replay_weights, REPLAY_WEIGHTS),
    "compaction_eligible": (compaction, COMPACTION), "compactable_patterns": (compactable, COMPACTABLE), "cluster_patterns": (cluster_patterns, None), "dream_cycle": (dream_cycle, None), "proto_upsert": (proto_upsert, PROTO), "formations_last_hour": (formations, FORMATIONS),
    "masked_neighbours": (masked_neighbours, MASKED), "field_votes": (field_votes, FIELD_VOTES), "reconstruct_embedding": (reconstruct, RECONSTRUCT), "attractor_completion": (completed, None), "evidence_integration": (integration, INTEGRATION),
    "completion_consistency": (consistency, CONSISTENCY), "top_people": (top_people, TOP_PEOPLE), "stream_sequence_gaps": (sequence_gaps, SEQUENCE), "stream_tumbling": (stream_tumbling, TUMBLING), "stream_sliding": (stream_sliding, SLIDING),
    "stream_sessions": (stream_sessions, SESSIONS), "backpressure": (backpressure, BACKPRESSURE), "ssts_states": (ssts_states, SSTS),
}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: s for k, (_, s) in _ALL.items() if s}

