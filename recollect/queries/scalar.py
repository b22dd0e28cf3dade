"""Confidence, decay, cues: one row in, one row out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import confidence as C
from ..functions import decay as D
from ..functions import text as X
from ..functions import vectors as V
from ..operators import cues as Q
from ..sources import tables as T


def _a():
    return F.col("confidence")


def _b():
    return ((F.col("id") * 53) % 100) / 100


def _hours():
    return Q.hours_between(Q.at(T.AS_OF), F.col("when"))


# The same in SQL: episodes with a (confidence), b and hours.
EPISODES = """e AS (SELECT event_id AS id, ts, user_id, event_type, value, 0.5 + 0.5 * ((event_id * 37) % 100) / 100 AS a, ((event_id * 53) % 100) / 100 AS b,
    event_id % 6 AS recalls, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9 AS h FROM events)"""
CLAMP = "least(greatest({}, 0), 1)"


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def _r_scaled(c, name: str, digits: int = 6):
    """As DuckDB rounds doubles: the product with the power of ten, halves away from zero. Spark rounds the shortest decimal form."""
    return (F.round(c * 10.0**digits) / 10.0**digits).alias(name)


def conf_algebra(spark, d):
    return T.episodes(spark, d).select(
        "id", _r(C.and_(_a(), _b()), "c_and"), _r(C.or_(_a(), _b()), "c_or"), _r(C.not_(_a()), "c_not"), _r(C.combine_weighted(_a(), _b(), 2.0, 1.0), "c_mix"),
        _r(C.decayed(_a(), 0.35, 2), "c_hops"), _r(C.scaled(_a(), _b()), "c_scaled"), _r(C.calibrate_overconfidence(_a()), "c_sober"), _r(C.update_with_base_rate(_a(), _b()), "c_base"),
        C.bucket(_a()).alias("bucket"), C.seems_legitimate(_a()).alias("legit"), C.seems_questionable(_b()).alias("questionable"), _r(C.from_successes(F.col("id") % 7, F.col("id") % 9), "c_success"),
    )


CONF_ALGEBRA = f"""WITH {EPISODES} SELECT id, round(a * b, 6) AS c_and, round(a + b - a * b, 6) AS c_or, round(1 - a, 6) AS c_not, round((2 * a + b) / 3, 6) AS c_mix,
    round(a * exp(-0.7), 6) AS c_hops, round(a * b, 6) AS c_scaled, round(CASE WHEN a > 0.8 THEN a * 0.85 WHEN a > 0.6 THEN a * 0.9 ELSE a END, 6) AS c_sober,
    round(CASE WHEN a * b + (1 - a) * (1 - b) = 0 THEN a ELSE a * b / (a * b + (1 - a) * (1 - b)) END, 6) AS c_base,
    CASE WHEN a >= 0.7 THEN 'high' WHEN a <= 0.3 THEN 'low' ELSE 'medium' END AS bucket, a >= 0.6 AS legit, b <= 0.4 AS questionable,
    round(CASE WHEN id % 9 = 0 THEN 0.0 ELSE least((id % 7) / (id % 9), 1.0) END, 6) AS c_success FROM e"""


def conf_interval(spark, d):
    e = T.episodes(spark, d).withColumns({"i": C.interval(_a(), 0.2), "j": C.interval(_b(), 0.4)})
    i, j = F.col("i"), F.col("j")
    return e.select(
        "id", _r(i["lower"], "lower"), _r(i["upper"], "upper"), _r(i["width"], "width"), _r(C.interval_and(i, j)["lower"], "and_lower"), _r(C.interval_or(i, j)["upper"], "or_upper"),
        _r(C.interval_not(i)["lower"], "not_lower"), C.interval_contains(i, 0.7).alias("holds"), C.interval_overlaps(i, j).alias("overlaps"), C.category(i["point"], i["width"]).alias("category"),
    )


CONF_INTERVAL = f"""WITH {EPISODES}, x AS (SELECT *, least(0.2 * a, a, 1 - a) AS ha, least(0.4 * b, b, 1 - b) AS hb FROM e)
SELECT id, round(a - ha, 6) AS lower, round(a + ha, 6) AS upper, round(2 * ha, 6) AS width, round((a - ha) * (b - hb), 6) AS and_lower,
    round((a + ha) + (b + hb) - (a + ha) * (b + hb), 6) AS or_upper, round(1 - (a + ha), 6) AS not_lower, 0.7 BETWEEN a - ha AND a + ha AS holds,
    a - ha <= b + hb AND b - hb <= a + ha AS overlaps,
    CASE WHEN a >= 0.8 AND 2 * ha < 0.1 THEN 'high' WHEN a >= 0.6 AND 2 * ha < 0.2 THEN 'medium' WHEN a >= 0.3 AND 2 * ha < 0.3 THEN 'low' ELSE 'very_uncertain' END AS category FROM x"""


def conf_memory(spark, d):
    tier = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm").otherwise("cold")
    return T.episodes(spark, d).select(
        "id", _r(C.weighted_distance(2.0, _a(), _b()), "distance"), _r(C.temporal_boost(_a(), _hours() * 3600, 0.5), "boosted"), _r(C.adjust_for_tier(_a(), tier, _hours() / 24), "tiered"),
        _r(C.episode_confidence(_a(), _b(), 0.5, 0.1), "episode"), _r(C.through_binding(_a(), _b()), "bound", 8), _r(C.blend(_a(), _b(), 0.7, 0.3), "blended"), _r(Q.adaptive_threshold(_a(), _b()), "adaptive"),
    )


CONF_MEMORY = f"""WITH {EPISODES}, x AS (SELECT *, (0.7 * a + 0.3 * b) / (0.7 + 0.3) AS m FROM e)
SELECT id, round(2 * (1 - a * b), 6) AS distance, round(least(a * (1 + 0.5 * exp(-h)), 1), 6) AS boosted,
    round(least(greatest(a * CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.9 END * pow(0.5, h / 24 / 3650), 0.01), 1), 6) AS tiered,
    round((0.5 * a + 0.3 * b + 0.1) * 0.9 * 0.9, 6) AS episode, round(a * b * 0.95, 8) AS bound,
    round(least(CASE WHEN a > 0.5 AND b > 0.5 THEN least(m * 1.1, greatest(a, b) * 1.1) ELSE m END, 1), 6) AS blended, round(0.7 * a + 0.3 * b, 6) AS adaptive FROM x"""


def diversity_weighted(spark, d):
    return T.episodes(spark, d).groupBy("what").agg(_r(C.diversity_weighted(_a(), _b()), "confidence"))


DIVERSITY = f"WITH {EPISODES} SELECT event_type AS what, round(sum(a * greatest(b, 0.1)) / sum(greatest(b, 0.1)), 6) AS confidence FROM e GROUP BY 1"


def decay_curves(spark, d):
    return T.episodes(spark, d).select(
        "id", _r(D.exponential(_a(), _hours() / 100), "exponential"), _r(D.power_law(_a(), _hours()), "power"), _r(D.hybrid(_a(), _hours() / 20), "hybrid"),
        _r(D.two_component(_a(), _hours() / 100, F.col("recall_count")), "two_component"), _r(D.neocortical(_a(), _hours() / 24), "neocortical"), _r(D.lazy(_a(), _hours() / 100, F.col("recall_count")), "lazy"),
    )


DECAY_CURVES = f"""WITH {EPISODES}, x AS (SELECT *, greatest(a * greatest(pow(1 + h / 24, -0.3 / 1.12), 0.01), 0.3) AS neo, greatest(a * greatest(pow(1 + h / 100 / 24, -0.3 / 1.12), 0.01), 0.3) AS neo100 FROM e),
y AS (SELECT *, CASE WHEN recalls >= 3 THEN least(neo100, 1) ELSE a * exp(-h / 100 / 1.96) END AS two FROM x)
SELECT id, round(a * exp(-h / 100 / 1.96), 6) AS exponential, round(a * pow(1 + h, -0.18), 6) AS power,
    round(CASE WHEN h / 20 < 24 THEN a * exp(-h / 20 / 0.8) ELSE a * pow(1 + h / 20, -0.25) END, 6) AS hybrid, round(two, 6) AS two_component,
    round(least(neo, 1), 6) AS neocortical, round(least(greatest(two * CASE WHEN two > 0.7 THEN 0.965 ELSE 1.005 END, 0.1), 1), 6) AS lazy FROM y"""


def decay_blends(spark, d):
    age = _hours() / 24
    enc, viv, rel = D.episode_forgetting(_a(), _b(), 0.7, _hours() / 24)
    return T.episodes(spark, d).select(
        "id", _r(D.predicted_retention(_hours() / 50, age), "predicted"), _r(D.memory_blend(_a(), _hours() / 50, age, F.col("what") == "view"), "memory"), _r(D.episode_blend(_a(), _hours() / 50, age, _b()), "episode"),
        _r(enc, "encoding"), _r(viv, "vividness"), _r(rel, "reliability"), _r(D.remerge(_a(), _b(), age), "remerge"), _r(D.ssts_retention(_a(), 5.0, age), "ssts"),
        _r(D.optimal_interval_days(5.0, F.lit(0.8)), "interval"), _r(D.spacing_interval(3.0, F.col("value") > 50), "spacing"), _r(D.testing_effect(_a(), F.col("value") > 50), "testing"),
        _r(D.theta_modulation(_b()), "theta"), _r(D.half_life_days(0.3), "half_life"), _r(D.interference_strength(_a()), "interference"), _r(D.hippocampal_tau(1.96, _a(), _b(), 1.0, 1.0, 1.0), "hip_tau"),
        _r(D.neocortical_tau(10.0, _a(), _b(), 1.0, 1.0, 1.0), "neo_tau"), _r(D.record_recalls(_a(), F.col("recall_count").cast("int")), "recalled"),
    )


DECAY_BLENDS = f"""WITH {EPISODES}, x AS (SELECT *, h / 24 AS age, exp(-h / 50 / 1.96) AS hip, least(h / 24 / 365, 1) AS w, least(h / 24 / 1095, 1) AS w3, 1 + h / 50 / 24 AS dd FROM e)
SELECT id, round(hip * (1 - w) + greatest(pow(dd, -0.3), 0.01) * w, 6) AS predicted,
    round(a * (hip * (1 - w) + greatest(pow(dd, -0.3 / (1 + 0.2 * CASE WHEN event_type = 'view' THEN 0.7 ELSE 0.3 END)), 0.01) * w), 6) AS memory,
    round(a * (hip * (1 - w3) + greatest(pow(dd, -0.3 / (1 + 0.2 * CASE WHEN b > 0.7 THEN 0.8 ELSE 0.2 END)), 0.01) * w3), 6) AS episode,
    round(a * exp(-h / 24 * 0.05), 6) AS encoding, round(b * exp(-h / 24 * 0.05) * 0.8, 6) AS vividness, round(0.7 * exp(-h / 24 * 0.05) * 0.9, 6) AS reliability,
    round(a * (1 - w3) + b * w3, 6) AS remerge, round(least(greatest(pow(a, age / 5), 0.01), 0.99), 6) AS ssts, round(5 * abs(ln(0.9) / ln(0.8)), 6) AS interval,
    CASE WHEN value > 50 THEN 7.5 ELSE 1.0 END AS spacing, round(least(CASE WHEN value > 50 THEN a * 1.3 ELSE a * 0.8 END, 1), 6) AS testing,
    round(1 + 0.1 * sin(2 * pi() * b), 6) AS theta, round(pow(2, 1 / 0.3) - 1, 6) AS half_life, round(a, 6) AS interference, round(1.96 * (0.3 * a + 0.2 * b + 0.5), 6) AS hip_tau,
    round(10 * (0.25 * a + 0.2 * b + 0.55), 6) AS neo_tau, round(CASE WHEN recalls >= 3 THEN 0.95 * a + 0.0025 ELSE a END, 6) AS recalled FROM x"""


def ripples(spark, d):
    v = F.col("value") / 100
    return T.episodes(spark, d).groupBy("who").agg(F.count(F.lit(1)).alias("n"), D.ripple(v, 0.0).alias("ripple"), D.should_consolidate(v, 0.1).alias("consolidate"))


RIPPLES = """SELECT user_id AS who, count(*) AS n, count(*) >= 5 AND avg(value / 100) > 0 AND avg(value / 100) < 0.7 AND var_pop(value / 100) > 0.1 AS ripple,
    count(*) >= 10 AND avg(value / 100) > 0.1 AND avg(value / 100) < 0.7 AND var_pop(value / 100) > 0.1 AS consolidate FROM events GROUP BY 1"""


def recall_temporal(spark, d):
    e = T.episodes(spark, d)
    cue = Q.TemporalCue("recent", hours=24.0 * 14)
    two = Q.TemporalCue("between", at=datetime(2024, 1, 5), end=datetime(2024, 1, 9))
    return e.select("id", _r(Q.temporal_score(F.col("when"), cue, T.AS_OF), "recent"), _r(Q.temporal_score(F.col("when"), two, T.AS_OF), "between"))


RECALL_TEMPORAL = f"WITH {EPISODES} SELECT id, round(CASE WHEN h >= 0 AND h <= 336 THEN 1 - h / 336 ELSE 0 END, 6) AS recent, CASE WHEN ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' THEN 1.0 ELSE 0.0 END AS between FROM e"


def recall_context(spark, d):
    e = T.episodes(spark, d).withColumn("where", F.col("what"))
    cue = Q.ContextCue(datetime(2024, 1, 1), datetime(2024, 1, 15), "click", threshold=0.4, limit=None)
    return Q.by_context(e, cue).select("id", _r(F.col("score"), "score"))


RECALL_CONTEXT = """WITH s AS (SELECT event_id AS id, (CASE WHEN ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-15' THEN 1.0 ELSE 0.0 END + CASE WHEN event_type = 'click' THEN 1.0
    WHEN contains(event_type, 'click') OR contains('click', event_type) THEN 0.7 ELSE 0.0 END) / 2 AS score FROM events) SELECT id, round(score, 6) AS score FROM s WHERE score > 0.4"""


def recall_semantic(spark, d):
    """The 75 best texts (a top-k report)."""
    return Q.by_content(T.texts(spark, d), Q.SemanticCue("the and of to in that is", threshold=0.0)).select("id", _r(F.col("score"), "score"))


RECALL_SEMANTIC = r"""WITH c AS (SELECT ['the', 'and', 'of', 'to', 'in', 'that', 'is'] AS q), t AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS t, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w FROM documents),
s AS (SELECT id, least(CASE WHEN len(list_distinct(w || q)) = 0 THEN 0 ELSE len(list_intersect(w, q)) / len(list_distinct(w || q)) END + CASE WHEN contains(t, 'the and of to in that is') THEN 0.3 ELSE 0 END, 1) AS score FROM t, c)
SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 75"""


def recall_constraints(spark, d):
    e = T.episodes(spark, d)
    own = e.where(Q.confidence_above(0.6) & Q.created_after(datetime(2024, 1, 10)) & Q.created_before(datetime(2024, 1, 20)) & Q.content_contains("CL"))
    return own.select("id", _r(_a(), "confidence"))


RECALL_CONSTRAINTS = f"WITH {EPISODES} SELECT id, round(a, 6) AS confidence FROM e WHERE a > 0.6 AND ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND contains(event_type, 'cl')"


def completeness(spark, d):
    m = T.memories(spark, d).withColumns({"what": F.when(F.col("id") % 2 == 0, "x"), "where": F.when(F.col("id") % 3 == 0, "y"), "who": F.when(F.col("id") % 5 == 0, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>"))})
    part = Q.to_partial(F.col("embedding"), 0.3)
    return m.select("id", _r(Q.completeness(F.col("what"), F.col("where"), F.col("who"), F.col("embedding")), "completeness"), F.size(F.filter(part, lambda x: x.isNull())).cast("long").alias("masked"))


COMPLETENESS = """SELECT vec_id AS id, round((CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END
    + len(list_filter(embedding, lambda x: x <> 0)) / len(embedding)) / 4, 6) AS completeness, CAST(ceil(0.3 * len(embedding)) AS BIGINT) AS masked FROM embeddings"""


def vector_functions(spark, d):
    """Each vector against that of concept 0's first member, a fixed row."""
    e = T.memories(spark, d)
    q = [((j * 37) % 17 - 8) / 8 for j in range(64)]
    v, lit = F.col("embedding"), V.literal(q)
    cos = V.cosine(v, lit)
    return e.select("id", _r(cos, "cosine"), _r(V.dot(v, lit), "dot"), _r(V.norm(v), "norm"), _r(V.euclidean(v, lit), "distance"), _r(V.sigmoid_activation(cos, 0.4), "sigmoid"), _r(V.fan_activation(cos, F.col("id") % 5, 0.4), "fan"), _r(V.neural_similarity(cos, 12.0), "neural"), _r(V.masked_cosine(Q.to_partial(lit, 0.5), v), "masked"))


VECTOR_FUNCTIONS = """WITH q AS (SELECT list_transform(range(64), lambda j: ((j * 37) % 17 - 8) / 8.0::DOUBLE)::DOUBLE[] AS q), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, q FROM embeddings, q),
c AS (SELECT *, list_cosine_similarity(v, q) AS c FROM v)
SELECT id, round(c, 6) AS cosine, round(list_dot_product(v, q), 6) AS dot, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_distance(v, q), 6) AS distance,
    round(1 / (1 + exp(-(c - 0.4) / 0.5)), 6) AS sigmoid, round(1 / (1 + exp(-(c - 0.4) / 0.5)) / sqrt(greatest(id % 5, 1)), 6) AS fan, round(1 / (1 + exp(-10 * (c * exp(-0.5) - 0.5))), 6) AS neural,
    round(list_cosine_similarity(v[33:], q[33:]), 6) AS masked FROM c"""


def lsh_quantise(spark, d):
    e = T.memories(spark, d).withColumn("bucket", V.lsh_bucket(F.col("embedding"), 64, 16))
    return e.select("id", "bucket", V.hamming(F.col("bucket"), F.lit(0b1010101010101010).cast("long")).cast("long").alias("hamming"), F.aggregate(V.quantise(F.col("embedding")), F.lit(0).cast("long"), lambda s, x: s + x).alias("bytes"))


LSH_QUANTISE = """WITH p AS (SELECT i, list_transform(range(64), lambda j: cos((i + 1) * (j + 1)))::DOUBLE[] AS p FROM range(16) t(i)),
b AS (SELECT vec_id AS id, any_value(embedding) AS v, CAST(sum(CASE WHEN list_dot_product(embedding::DOUBLE[], p) >= 0 THEN 1 << i ELSE 0 END) AS BIGINT) AS bucket FROM embeddings, p GROUP BY vec_id)
SELECT id, bucket, CAST(bit_count(xor(bucket, 43690)) AS BIGINT) AS hamming, CAST(list_sum(list_transform(v, lambda x: round((least(greatest(x::DOUBLE, -1), 1) + 1) * 127.5))) AS BIGINT) AS bytes FROM b"""


def grid_codes(spark, d):
    e = T.episodes(spark, d).withColumn("g", V.grid_code(_a(), _b()))
    return e.select("id", *(_r(F.col("g")[i], f"g{i}") for i in range(4)))


def _grid(i: int, scale: float) -> str:
    k = f"4 * pi() / (sqrt(3) * {scale})"
    return f"round(greatest((cos({k} * a) + cos({k} * (a * cos(pi() / 3) + b * sin(pi() / 3))) + cos({k} * (a * cos(2 * pi() / 3) + b * sin(2 * pi() / 3)))) / 3, 0), 6) AS g{i}"


GRID = f"WITH {EPISODES} SELECT id, {', '.join(_grid(i, s) for i, s in enumerate((0.3, 0.5, 0.7, 1.0)))} FROM e"


def hash_embedding(spark, d):
    e = T.read(spark, d, "benchmark").withColumn("v", X.hash_embedding(F.col("text"), 16))
    return e.select(F.col("item_id").alias("id"), *(_r(F.col("v")[i], f"v{i}") for i in (0, 5, 15)))


HASH_EMBEDDING = """WITH p AS (SELECT item_id AS id, text AS t, greatest(CAST(ceil(length(text) / 8.0) AS INTEGER), 1) AS n FROM benchmark),
c AS (SELECT *, list_transform(range(n), lambda c: CAST(coalesce(list_sum(list_transform(string_split(substr(t, CAST(c * 8 + 1 AS BIGINT), 8), ''), lambda x: ascii(x))), 0) AS BIGINT)) AS codes FROM p),
r AS (SELECT id, list_transform(range(16), lambda j: ((codes[j % n + 1] * (j + 1)) % 1000) / 1000.0::DOUBLE) AS v FROM c), s AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM r)
SELECT id, round(v[1] / l, 6) AS v0, round(v[6] / l, 6) AS v5, round(v[16] / l, 6) AS v15 FROM s"""


def query_expansion(spark, d):
    words = T.read(spark, d, "part").select(F.lower("p_type").alias("query")).distinct()
    lex = T.read(spark, d, "part").select(F.col("p_type").alias("term"), F.col("p_brand").alias("variant"), (0.2 + 0.6 * (F.col("p_size") / 50)).alias("confidence"))
    return X.expand_query(words, [lex]).select("query", "variant", _r(F.col("confidence"), "confidence"), F.col("rank").cast("long").alias("rank"))


QUERY_EXPANSION = """WITH q AS (SELECT DISTINCT lower(p_type) AS query FROM part), v AS (SELECT query, query AS variant, 1.0 AS confidence FROM q
    UNION ALL SELECT query, p_brand, 0.2 + 0.6 * (p_size / 50) FROM q JOIN part ON lower(p_type) = query), m AS (SELECT query, variant, max(confidence) AS c FROM v WHERE confidence >= 0.3 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, variant) AS rank FROM m) SELECT query, variant, round(c, 6) AS confidence, rank FROM r WHERE rank <= 10"""

QUERIES = {
    "conf_algebra": conf_algebra, "conf_interval": conf_interval, "conf_memory": conf_memory, "conf_diversity_weighted": diversity_weighted, "decay_curves": decay_curves, "decay_blends": decay_blends,
    "ripple_detection": ripples, "recall_temporal": recall_temporal, "recall_context": recall_context, "recall_semantic": recall_semantic, "recall_constraints": recall_constraints,
    "memory_completeness": completeness, "vector_functions": vector_functions, "lsh_quantise": lsh_quantise, "grid_codes": grid_codes, "hash_embedding": hash_embedding, "query_expansion": query_expansion,
}
ORACLES = {
    "conf_algebra": CONF_ALGEBRA, "conf_interval": CONF_INTERVAL, "conf_memory": CONF_MEMORY, "conf_diversity_weighted": DIVERSITY, "decay_curves": DECAY_CURVES, "decay_blends": DECAY_BLENDS,
    "ripple_detection": RIPPLES, "recall_temporal": RECALL_TEMPORAL, "recall_context": RECALL_CONTEXT, "recall_semantic": RECALL_SEMANTIC, "recall_constraints": RECALL_CONSTRAINTS,
    "memory_completeness": COMPLETENESS, "vector_functions": VECTOR_FUNCTIONS, "lsh_quantise": LSH_QUANTISE, "grid_codes": GRID, "query_expansion": QUERY_EXPANSION, "hash_embedding": HASH_EMBEDDING,
}
