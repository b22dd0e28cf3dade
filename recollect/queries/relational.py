"""Nearest neighbours, result algebra, evidence, calibration, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as C
from ..functions import vectors as V
from ..operators import cues as Q
from ..operators import nearest as N
from ..operators import recall as P
from ..operators import results as R
from ..operators import upkeep as U
from ..plans import engine, language
from ..sources import tables as T
from .scalar import EPISODES, _r

_QUERY = tuple(((j * 37) % 17 - 8) / 8 for j in range(64))
_SQL_Q = "q AS (SELECT list_transform(range(64), lambda j: ((j * 37) % 17 - 8) / 8.0::DOUBLE)::DOUBLE[] AS q)"
_SQL_M = "m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS concept, 0.5 + 0.5 * ((vec_id * 37) % 100) / 100 AS a FROM embeddings)"


def _vector_text() -> str:
    return "[" + ", ".join(f"{x:g}" for x in _QUERY) + "]"


def recall_knn(spark, d):
    """The language end to end: a vector, a threshold, a confidence."""
    m = engine.Memory(T.memories(spark, d), as_of=T.AS_OF)
    out = engine.execute(f"RECALL {_vector_text()} THRESHOLD 0.05 CONFIDENCE > 0.6", m, 64)
    return out.episodes.select("id", "concept", "score", _r(F.col("confidence"), "confidence"))


RECALL_KNN = f"WITH {_SQL_Q}, {_SQL_M}, s AS (SELECT id, concept, round(greatest(list_cosine_similarity(v, q), 0), 6) AS score, a FROM m, q) SELECT id, concept, score, round(a, 6) AS confidence FROM s WHERE score >= 0.05 AND a > 0.6"


def recall_interval(spark, d):
    m = engine.Memory(T.memories(spark, d), as_of=T.AS_OF)
    out = engine.execute(f"RECALL {_vector_text()} THRESHOLD 0.0 WHERE confidence > 0.55 confidence < 0.95 CONFIDENCE > 0.6 BASE_RATE 0.4", m, 64)
    return out.interval.select("n", *(_r(F.col(c), c) for c in ("point", "lower", "upper", "width", "deviation")))


RECALL_INTERVAL = f"""WITH {_SQL_Q}, {_SQL_M}, s AS (SELECT a * 0.4 / (a * 0.4 + (1 - a) * 0.6) AS c FROM m, q WHERE a > 0.55 AND a < 0.95 AND round(greatest(list_cosine_similarity(v, q), 0), 6) >= 0),
i AS (SELECT count(*) AS n, coalesce(avg(c), 0) AS p, coalesce(stddev_pop(c), 0) AS d FROM s WHERE c > 0.6)
SELECT n, round(p, 6) AS point, round(greatest(p - d, 0), 6) AS lower, round(least(p + d, 1), 6) AS upper, round(least(p + d, 1) - greatest(p - d, 0), 6) AS width, round(d, 6) AS deviation FROM i"""


def knn_join(spark, d):
    """Every twentieth memory against all."""
    m = T.memories(spark, d)
    return N.knn_join(m.where("id % 20 = 0"), m, 5).select("query_id", "id", F.col("score"), F.col("rank").cast("long").alias("rank"))


KNN_JOIN = f"""WITH {_SQL_M}, s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score FROM m a JOIN m b ON a.id <> b.id WHERE a.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 5"""


def knn_approximate(spark, d):
    """By inverted lists; recall against knn_join is measured by a test."""
    m = T.memories(spark, d)
    return N.ivf_join(m.where("id % 20 = 0"), m, 5, lists=32, probes=24).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def similarity_links(spark, d):
    return N.similarity_links(T.memories(spark, d), 0.3, by=["concept"]).select("a", "b", "score")


SIMILARITY_LINKS = f"WITH {_SQL_M}, s AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) + 0.0 AS score FROM m x JOIN m y ON x.concept = y.concept AND x.id < y.id) SELECT * FROM s WHERE score >= 0.3"


def _concepts(spark, d) -> DataFrame:
    return V.mean_vector(T.memories(spark, d), ["concept"])


def centroid_by_concept(spark, d):
    c = _concepts(spark, d)
    return c.select("concept", *(_r(F.col("centroid")[i], f"x{i}") for i in (0, 31, 63)))


CENTROIDS = "SELECT label AS concept, round(avg(embedding[1]::DOUBLE), 6) AS x0, round(avg(embedding[32]::DOUBLE), 6) AS x31, round(avg(embedding[64]::DOUBLE), 6) AS x63 FROM embeddings GROUP BY 1"


def dual_search(spark, d):
    """The 20 best of memories and concepts."""
    concepts = _concepts(spark, d).select(F.col("concept").alias("id"), F.col("centroid").alias("embedding"))
    return P.dual_search(T.memories(spark, d), concepts, _QUERY, 20)


_SQL_C = "c AS (SELECT concept, list(x ORDER BY i) AS v FROM (SELECT label AS concept, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)"
DUAL_SEARCH = f"""WITH {_SQL_Q}, {_SQL_M}, {_SQL_C}, s AS (SELECT 'episode' AS kind, id, round(list_cosine_similarity(v, q), 6) AS score FROM m, q
UNION ALL SELECT 'concept', concept, round(list_cosine_similarity(v, q), 6) FROM c, q) SELECT * FROM s ORDER BY score DESC, kind, id LIMIT 20"""


def analogy_search(spark, d):
    """t + (s2 - s1) for concepts 0, 1, 2, and the ten memories nearest to it."""
    c = _concepts(spark, d)
    one = lambda i: c.where(F.col("concept") == i).select(F.col("centroid").alias(f"c{i}"))
    target = one(2).join(one(0)).join(one(1)).select(V.analogy(F.col("c2"), F.col("c0"), F.col("c1")).alias("t"))
    met = T.memories(spark, d).join(F.broadcast(target))
    return met.select("id", _r(V.cosine(F.col("embedding"), F.col("t")), "score")).orderBy(F.desc("score"), "id").limit(10)


ANALOGY = f"""WITH {_SQL_M}, {_SQL_C}, t AS (SELECT list_transform(range(1, 65), lambda i: c2.v[i] + c1.v[i] - c0.v[i])::DOUBLE[] AS t FROM c c0, c c1, c c2 WHERE c0.concept = 0 AND c1.concept = 1 AND c2.concept = 2)
SELECT id, round(list_cosine_similarity(v, t), 6) AS score FROM m, t ORDER BY score DESC, id LIMIT 10"""


def multi_cue(spark, d):
    cues = T.memories(spark, d).withColumn("g", F.floor(F.col("id") / 10)).select("g", F.col("id").alias("cue_id"), "embedding", "confidence")
    out = None
    for how in ("average", "confidence", "attention"):
        x = P.combine_cues(cues, how, ["g"]).select("g", F.lit(how).alias("how"), _r(F.col("centroid")[0], "x0"), _r(F.col("centroid")[63], "x63"))
        out = x if out is None else out.unionByName(x)
    return out


MULTI_CUE = f"""WITH {_SQL_M}, k AS (SELECT id // 10 AS g, a, v[1] AS x, v[64] AS y FROM m)
SELECT g, 'average' AS how, round(avg(x), 6) AS x0, round(avg(y), 6) AS x63 FROM k GROUP BY g UNION ALL SELECT g, 'confidence', round(sum(x * a) / sum(a), 6), round(sum(y * a) / sum(a), 6) FROM k GROUP BY g
UNION ALL SELECT g, 'attention', round(sum(x * exp(a)) / sum(exp(a)), 6), round(sum(y * exp(a)) / sum(exp(a)), 6) FROM k GROUP BY g"""


def _two(spark, d):
    e = T.episodes(spark, d).select("id", "confidence")
    return e.where("id % 3 = 0"), e.where("id % 2 = 0").withColumn("confidence", F.col("confidence") / 2)


def result_algebra(spark, d):
    a, b = _two(spark, d)
    parts = {"and": R.intersect(a, b), "or": R.union(a, b), "minus": R.minus(a, b), "combine": R.combine(a, b)}
    out = None
    for name, x in parts.items():
        y = x.select(F.lit(name).alias("op"), "id", _r(F.col("confidence"), "confidence"))
        out = y if out is None else out.unionByName(y)
    return out


RESULT_ALGEBRA = f"""WITH {EPISODES}, x AS (SELECT id, a AS c FROM e WHERE id % 3 = 0), y AS (SELECT id, a / 2 AS c FROM e WHERE id % 2 = 0),
o AS (SELECT id, c FROM x UNION ALL SELECT id, c FROM y WHERE id NOT IN (SELECT id FROM x))
SELECT 'and' AS op, id, round(c, 6) AS confidence FROM x WHERE id IN (SELECT id FROM y) UNION ALL SELECT 'or', id, round(c, 6) FROM o
UNION ALL SELECT 'minus', id, round(c, 6) FROM x WHERE id NOT IN (SELECT id FROM y) UNION ALL SELECT 'combine', id, round(c, 6) FROM o"""


def result_intervals(spark, d):
    a, b = _two(spark, d)
    x, y = R.Result.of(a), R.Result.of(b)
    out = None
    for name, r in {"left": x, "and": x.and_(y), "or": x.or_(y), "not": x.not_(), "above": x.above(0.7)}.items():
        z = r.interval.select(F.lit(name).alias("op"), *(_r(F.col(c), c) for c in ("lower", "point", "upper", "width")))
        out = z if out is None else out.unionByName(z)
    return out


RESULT_INTERVALS = f"""WITH {EPISODES}, f AS (SELECT 'x' AS k, a AS c FROM e WHERE id % 3 = 0 UNION ALL SELECT 'y', a / 2 FROM e WHERE id % 2 = 0 UNION ALL SELECT 'z', a FROM e WHERE id % 3 = 0 AND a >= 0.7),
s AS (SELECT k, avg(c) AS p, greatest(avg(c) - stddev_pop(c), 0) AS l, least(avg(c) + stddev_pop(c), 1) AS u FROM f GROUP BY k),
r AS (SELECT 'left' AS op, l, p, u, u - l AS w FROM s WHERE k = 'x' UNION ALL SELECT 'and', x.l * y.l, x.p * y.p, x.u * y.u, x.u * y.u - x.l * y.l FROM s x, s y WHERE x.k = 'x' AND y.k = 'y'
UNION ALL SELECT 'or', x.l + y.l - x.l * y.l, x.p + y.p - x.p * y.p, x.u + y.u - x.u * y.u, (x.u + y.u - x.u * y.u) - (x.l + y.l - x.l * y.l) FROM s x, s y WHERE x.k = 'x' AND y.k = 'y'
UNION ALL SELECT 'not', 1 - u, 1 - p, 1 - l, u - l FROM s WHERE k = 'x' UNION ALL SELECT 'above', l, p, u, greatest(u - l, 0.05) FROM s WHERE k = 'z')
SELECT op, round(l, 6) AS lower, round(p, 6) AS point, round(u, 6) AS upper, round(w, 6) AS width FROM r"""


def noisy_or(spark, d):
    e = T.episodes(spark, d)
    paths = e.select("who", F.col("id").alias("path_id"), "confidence", (F.col("value") % 10 / 10).alias("weight"), F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 0.95).otherwise(0.9).alias("tier_factor"), (F.col("id") % 5).alias("hops"))
    return R.noisy_or_paths(paths, "who").select("who", _r(F.col("confidence"), "confidence"), "n_paths", _r(F.col("diversity"), "diversity"))


NOISY_OR = f"""WITH {EPISODES}, p AS (SELECT user_id AS who, id, least(greatest(a * (value % 10 / 10) * CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.9 END * exp(-0.35 * (id % 5)), 0), 1) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY p DESC, id) AS n FROM p WHERE p >= 0.001)
SELECT who, round(1 - exp(sum(ln(greatest(1 - p, 1e-300)))), 6) AS confidence, count(*) AS n_paths, round(least(stddev_pop(p), 0.3), 6) AS diversity FROM r WHERE n <= 8 GROUP BY who"""


def _evidence(spark, d):
    e = T.episodes(spark, d)
    deps = F.when(F.col("id") % 4 == 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<bigint>"))
    return e.select("who", F.col("id").alias("evidence_id"), F.col("when").alias("ts"), (F.col("confidence") * 0.5).alias("strength"), deps.alias("dependencies"))


def evidence(spark, d):
    return R.aggregate_evidence(_evidence(spark, d), "who").select("who", _r(F.col("confidence"), "confidence"), "n_used")


EVIDENCE = f"""WITH {EPISODES}, s AS (SELECT user_id AS who, id, a / 2 AS s, id % 4 <> 0 AS free FROM e), f AS (SELECT *, max(CASE WHEN free THEN 1 ELSE 0 END) OVER (PARTITION BY who) AS any_free FROM s WHERE s >= 0.01),
r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY s DESC, id) AS n FROM f WHERE any_free = 0 OR free) SELECT who, round(1 - exp(sum(ln(1 - s))), 6) AS confidence, count(*) AS n_used FROM r WHERE n <= 10 GROUP BY who"""


def odds_fold(spark, d):
    own = _evidence(spark, d).withColumn("strength", F.col("strength") + 0.2)
    return R.odds_fold(own, "who").select("who", _r(F.col("confidence"), "confidence", 9), F.col("n").cast("long").alias("n"))


ODDS_FOLD = f"""WITH {EPISODES}, s AS (SELECT user_id AS who, a / 2 + 0.2 AS s FROM e), o AS (SELECT who, exp(sum(ln(s / (1 - s)))) AS o, count(*) AS n FROM s GROUP BY 1)
SELECT who, round(o / (1 + o), 9) AS confidence, n FROM o"""


def _uncertainty(spark, d):
    return T.episodes(spark, d).select("who", F.col("what").alias("kind"), (F.col("confidence") / 50).alias("impact"))


def uncertainty(spark, d):
    t = R.uncertainty_total(_uncertainty(spark, d), ["who"])
    return t.select("who", _r(F.col("uncertainty"), "uncertainty"), _r(F.col("largest"), "largest"), "n", _r(R.apply_uncertainty(0.8, F.col("uncertainty")), "left"))


UNCERTAINTY = f"""WITH {EPISODES}, u AS (SELECT user_id AS who, 1 - exp(sum(ln(1 - a / 50))) AS u, max(a / 50) AS m, count(*) AS n FROM e GROUP BY 1)
SELECT who, round(u, 6) AS uncertainty, round(m, 6) AS largest, n, round(0.8 * (1 - u), 6) AS "left" FROM u"""


def uncertainty_summary(spark, d):
    return R.uncertainty_summary(_uncertainty(spark, d)).select("kind", "n", _r(F.col("impact"), "impact"))


UNCERTAINTY_SUMMARY = f"WITH {EPISODES} SELECT event_type AS kind, count(*) AS n, round(sum(a / 50), 6) AS impact FROM e GROUP BY 1"


def _samples(spark, d):
    return T.read(spark, d, "lineitem").select(F.round(F.col("l_discount") * 10, 6).alias("predicted"), (F.col("l_returnflag") == "R").alias("correct"))


def calibration(spark, d):
    return R.calibration_bins(_samples(spark, d)).select("bin", "n", _r(F.col("confidence"), "confidence"), _r(F.col("accuracy"), "accuracy"))


_SQL_S = "s AS (SELECT round(l_discount * 10, 6) AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS y FROM s GROUP BY 1)"
CALIBRATION = f"WITH {_SQL_S} SELECT bin, n, round(c, 6) AS confidence, round(y, 6) AS accuracy FROM b"


def calibration_errors(spark, d):
    return R.calibration_errors(_samples(spark, d)).select(*(_r(F.col(c), c) for c in ("ece", "mce", "spearman", "brier")))


CALIBRATION_ERRORS = f"""WITH {_SQL_S}, t AS (SELECT *, round(c, 9) AS ct, round(y, 9) AS yt FROM b),
r AS (SELECT *, rank() OVER (ORDER BY ct) + (count(*) OVER (PARTITION BY ct) - 1) / 2 AS rc, rank() OVER (ORDER BY yt) + (count(*) OVER (PARTITION BY yt) - 1) / 2 AS ry FROM t)
SELECT round(sum(n * abs(c - y)) / sum(n), 6) AS ece, round(max(abs(c - y)), 6) AS mce, round(corr(rc, ry), 6) AS spearman, (SELECT round(avg(pow(p - y, 2)), 6) FROM s) AS brier FROM r"""


def calibrated(spark, d):
    f = R.calibration_factors(_samples(spark, d))
    return R.calibrated(T.episodes(spark, d).select("id", "confidence"), f).select("id", _r(F.col("confidence"), "confidence"))


CALIBRATED = f"""WITH {EPISODES}, {_SQL_S}, f AS (SELECT bin, CASE WHEN c > 0 THEN least(greatest(y / c, 0.5), 1.5) ELSE 1 END AS f FROM b)
SELECT id, round(least(a * coalesce(f, 1), 1), 6) AS confidence FROM e LEFT JOIN f ON f.bin = least(floor(a * 10), 9)"""


def _access(spark, d):
    return T.episodes(spark, d).select(F.col("who").alias("id"), F.col("id").alias("access_id"), "when", (F.col("value") % 1).alias("activation"))


def access_windows(spark, d):
    return U.access_windows(_access(spark, d)).select("access_id", _r(F.col("average"), "average"), _r(F.col("trend"), "trend"))


ACCESS = """WITH w AS (SELECT event_id AS access_id, list(value % 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM events)
SELECT access_id, round(list_avg(l), 6) AS average, round(CASE WHEN len(l) < 2 THEN 0 ELSE list_avg(l[len(l) // 2 + 1:]) - list_avg(l[:len(l) // 2]) END, 6) AS trend FROM w"""


def access_frequency(spark, d):
    return U.access_frequency(_access(spark, d)).select("id", _r(F.col("frequency"), "frequency"))


ACCESS_FREQUENCY = """WITH t AS (SELECT user_id AS id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), g AS (SELECT id, ts, (epoch_us(ts) - epoch_us(was)) / 1e6 AS g FROM t WHERE ts > was),
r AS (SELECT id, 3600 / g AS f, row_number() OVER (PARTITION BY id ORDER BY ts) AS k, count(*) OVER (PARTITION BY id) AS n FROM g), f AS (SELECT id, sum(f * pow(0.7, n - k) * CASE WHEN k = 1 THEN 1 ELSE 0.3 END) AS f FROM r GROUP BY 1)
SELECT DISTINCT user_id AS id, round(coalesce(f, 0), 6) AS frequency FROM events LEFT JOIN f ON f.id = user_id"""


def tiers(spark, d):
    m = T.episodes(spark, d).withColumn("activation", F.col("value") % 1).withColumn("tier", U.tier_for(F.col("activation")))
    return U.tier_statistics(m).select("tier", "n", _r(F.col("confidence"), "confidence"), _r(F.col("activation"), "activation"))


TIERS = f"WITH {EPISODES} SELECT CASE WHEN value % 1 >= 0.7 THEN 'hot' ELSE 'warm' END AS tier, count(*) AS n, round(avg(a), 6) AS confidence, round(avg(value % 1), 6) AS activation FROM e GROUP BY 1"


def migration(spark, d):
    """The 100 weakest hot memories that should move (a top-k report)."""
    m = T.episodes(spark, d).select("id", F.col("when").alias("last_access"), (F.col("value") % 1).alias("activation"), (F.col("confidence") - 0.8).alias("trend"))
    return U.migration_candidates(m, T.AS_OF).select("id", _r(F.col("activation"), "activation"))


MIGRATION = f"WITH {EPISODES} SELECT id, round(value % 1, 6) AS activation FROM e WHERE value % 1 < 0.3 OR h * 3600 > 300 OR a - 0.8 < -0.2 ORDER BY value % 1, id LIMIT 100"


def dedup_actions(spark, d):
    """Every twentieth memory as a new one, against all others."""
    m = T.memories(spark, d)
    top = N.knn_join(m.where("id % 20 = 0"), m, 1).select(F.col("query_id"), F.col("id"), "score")
    both = top.join(m.select(F.col("id").alias("query_id"), F.col("confidence").alias("new")), "query_id").join(m.select("id", F.col("confidence").alias("old")), "id")
    return both.select("query_id", "id", *(U.duplicate_action(F.col("score"), F.col("new"), F.col("old"), s, 0.4).alias(s) for s in ("skip", "keep_highest", "composite")))


DEDUP_ACTIONS = f"""WITH {_SQL_M}, s AS (SELECT x.id AS query_id, y.id, x.a AS n, y.a AS o, round(list_cosine_similarity(x.v, y.v), 6) AS s FROM m x JOIN m y ON x.id <> y.id WHERE x.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM s)
SELECT query_id, id, CASE WHEN s < 0.4 THEN 'keep_both' ELSE 'skip' END AS skip, CASE WHEN s < 0.4 THEN 'keep_both' WHEN n > o THEN 'replace' ELSE 'skip' END AS keep_highest,
    CASE WHEN s < 0.4 THEN 'keep_both' WHEN s >= 0.99 THEN 'skip' ELSE 'merge' END AS composite FROM r WHERE k = 1"""


def log_replay(spark, d):
    log = T.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("store").alias("op"), "value")
    return T.replay(log).select("id", "seq", _r(F.col("value"), "value"))


LOG_REPLAY = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id AS id, event_id AS seq, round(value, 6) AS value FROM r WHERE n = 1 AND event_type <> 'error'"


def space_list(spark, d):
    return T.spaces(T.texts(spark, d)).select("space_id", "n", _r(F.col("confidence"), "confidence"))


SPACES = """WITH q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT lang AS space_id, count(*) AS n, round(avg(CASE q WHEN 1 THEN 0.9 WHEN 0 THEN 0.3 ELSE 0.5 END), 6) AS confidence FROM documents LEFT JOIN q USING (doc_id) GROUP BY 1"""


def forgotten(spark, d):
    m = T.episodes(spark, d)
    return T.forget(m, m.where("value > 50")).select("id", _r(F.col("confidence"), "confidence"))


FORGOTTEN = f"WITH {EPISODES} SELECT id, round(a, 6) AS confidence FROM e WHERE value <= 50"


def query_costs(spark, d):
    """What the language says a query costs, and whether it is let in."""
    rows = []
    for text in ("RECALL a", "RECALL a WHERE confidence > 0.5 content CONTAINS \"x\"", "SPREAD FROM a MAX_HOPS 6", "SPREAD FROM a MAX_HOPS 7", "PREDICT a GIVEN b, c", "IMAGINE a BASED ON b", "CONSOLIDATE a INTO b"):
        q = language.parse(text)
        rows.append((text, q.cost(), q.cost() <= language.MAX_COST, q.read_only))
    return spark.createDataFrame(rows, "query string, cost long, admitted boolean, read_only boolean")


QUERY_COSTS = """SELECT * FROM (VALUES ('RECALL a', 1000::BIGINT, true, true), ('RECALL a WHERE confidence > 0.5 content CONTAINS "x"', 1200, true, true), ('SPREAD FROM a MAX_HOPS 6', 64000, true, true),
('SPREAD FROM a MAX_HOPS 7', 128000, false, true), ('PREDICT a GIVEN b, c', 3000, true, true), ('IMAGINE a BASED ON b', 6000, true, false), ('CONSOLIDATE a INTO b', 10000, true, false)) t(query, cost, admitted, read_only)"""


def recognise(spark, d):
    return Q.recognise(T.memories(spark, d), _QUERY, 0.3).select(_r(F.col("similarity"), "similarity"), "familiar")


RECOGNISE = f"WITH {_SQL_Q}, {_SQL_M} SELECT round(max(list_cosine_similarity(v, q)), 6) AS similarity, max(list_cosine_similarity(v, q)) >= 0.3 AS familiar FROM m, q"


def concept_confidence(spark, d):
    m = T.memories(spark, d)
    return m.groupBy("concept").agg(_r(C.concept_confidence(F.col("confidence"), F.lit(0.6), F.lit(0.8), F.lit(0.9)), "confidence"))


CONCEPT_CONFIDENCE = f"WITH {_SQL_M} SELECT concept, round(avg((a + 1.4) / 3) * 0.81, 6) AS confidence FROM m GROUP BY 1"

_ALL = {
    "recall_knn": (recall_knn, RECALL_KNN), "recall_interval": (recall_interval, RECALL_INTERVAL), "knn_join": (knn_join, KNN_JOIN), "knn_approximate": (knn_approximate, None),
    "similarity_links": (similarity_links, SIMILARITY_LINKS), "centroid_by_concept": (centroid_by_concept, CENTROIDS), "dual_search": (dual_search, DUAL_SEARCH), "analogy_search": (analogy_search, ANALOGY),
    "multi_cue": (multi_cue, MULTI_CUE), "result_algebra": (result_algebra, RESULT_ALGEBRA), "result_intervals": (result_intervals, RESULT_INTERVALS), "noisy_or_paths": (noisy_or, NOISY_OR),
    "evidence_aggregate": (evidence, EVIDENCE), "evidence_odds": (odds_fold, ODDS_FOLD), "uncertainty_total": (uncertainty, UNCERTAINTY), "uncertainty_summary": (uncertainty_summary, UNCERTAINTY_SUMMARY),
    "calibration_bins": (calibration, CALIBRATION), "calibration_errors": (calibration_errors, CALIBRATION_ERRORS), "calibrated_confidence": (calibrated, CALIBRATED), "access_windows": (access_windows, ACCESS),
    "access_frequency": (access_frequency, ACCESS_FREQUENCY), "tier_statistics": (tiers, TIERS), "tier_migration": (migration, MIGRATION), "dedup_actions": (dedup_actions, DEDUP_ACTIONS), "log_replay": (log_replay, LOG_REPLAY),
    "space_list": (space_list, SPACES), "forget": (forgotten, FORGOTTEN), "query_costs": (query_costs, QUERY_COSTS), "recognise": (recognise, RECOGNISE), "concept_confidence": (concept_confidence, CONCEPT_CONFIDENCE),
}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: s for k, (_, s) in _ALL.items() if s}
