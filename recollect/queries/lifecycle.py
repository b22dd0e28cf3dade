"""The life of memories: tiers, logs, edges, lexicons, seeds, contexts, concepts, completion, batches. Each with DuckDB SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import confidence as C
from ..functions import decay as D
from ..functions import text as X
from ..functions import vectors as V
from ..operators import cognition as G
from ..operators import completion as M
from ..operators import consolidation as K
from ..operators import context as O
from ..operators import cues as Q
from ..operators import graph
from ..operators import recall as P
from ..operators import results as R
from ..operators import upkeep as U
from ..sources import tables as T
from ..store import keep, shared_dir
from ..streaming import observe as S
from .graphs import _SQL_VE
from .relational import _QUERY, _SQL_M, _SQL_Q
from .scalar import EPISODES, _r, _r_scaled

# Fixed values of the queries' own: a small lexicon, idioms, rules.
_LEXICON = [("view", "look", 0.9), ("view", "see", 0.6), ("view", "gaze", 0.2), ("click", "press", 0.8), ("purchase", "buy", 0.95), ("purchase", "order", 0.7)]
_SQL_LEXICON = "lx(term, variant, confidence) AS (VALUES " + ", ".join(f"('{t}', '{v}', {c}::DOUBLE)" for t, v, c in _LEXICON) + ")"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/recollect-{uuid.uuid4().hex}"


# Tiers and logs ---------------------------------------------------------------------------------------------------------


def _tiered(spark, d) -> DataFrame:
    m = T.memories(spark, d).withColumn("activation", F.col("confidence"))
    return m.withColumn("tier", F.when(F.col("id") % 5 == 0, "cold"))


def tier_scan(spark, d):
    """Written by tiers, each tier read again alone."""
    at = _folder(spark)
    T.write_tiered(_tiered(spark, d), at)
    return T.read_tier(spark, at, "hot").select("id", "tier").unionByName(T.read_tier(spark, at, "warm").select("id", "tier")).unionByName(T.read_tier(spark, at, "cold").select("id", "tier"))


TIER_SCAN = f"WITH {_SQL_M} SELECT id, CASE WHEN id % 5 = 0 THEN 'cold' WHEN a >= 0.7 THEN 'hot' ELSE 'warm' END AS tier FROM m"


def tier_recall(spark, d):
    at = _folder(spark)
    T.write_tiered(_tiered(spark, d), at)
    return T.tiered_recall(T.read_tier(spark, at), _QUERY, 0.05, 40).select("id", "tier", _r(F.col("score"), "score"))


TIER_RECALL = f"""WITH {_SQL_Q}, {_SQL_M}, t AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'cold' WHEN a >= 0.7 THEN 'hot' ELSE 'warm' END AS tier, list_cosine_similarity(v, q) AS s FROM m, q)
SELECT id, tier, round(s, 6) AS score FROM t WHERE s >= 0.05 ORDER BY s DESC, CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, id LIMIT 40"""


def cold_scan(spark, d):
    """The cold tier alone, by similarity."""
    cold = _tiered(spark, d).where("tier = 'cold'")
    return Q.by_embedding(cold, Q.EmbeddingCue(_QUERY, 0.05, 1000)).select("id", _r(F.col("score"), "score"))


COLD_SCAN = f"WITH {_SQL_Q}, {_SQL_M} SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM m, q WHERE id % 5 = 0 AND list_cosine_similarity(v, q) >= 0.05 ORDER BY score DESC, id LIMIT 1000"


def _log(spark, d) -> DataFrame:
    o = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("store")
    return T.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), o.alias("op"), "value")


def log_compaction(spark, d):
    """The live state written as a new log, and read back."""
    at = _folder(spark)
    T.compact(_log(spark, d), at)
    return spark.read.parquet(at).select("id", "seq", "value")


LOG_COMPACTION = "WITH l AS (SELECT user_id AS id, event_id AS seq, event_id % 7 = 0 AS gone, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT id, seq, value FROM l WHERE n = 1 AND NOT gone"


def backup_restore(spark, d):
    """A full backup up to a time, an increment after it, restored up to a later time."""
    full, more = _folder(spark), _folder(spark)
    e = T.episodes(spark, d).select("id", "when", "confidence")
    middle = datetime(2024, 1, 15)
    T.backup(e.where(F.col("when") <= Q.at(middle)), full)
    T.backup(e, more, since=middle)
    return T.restore(spark, [full, more], until=datetime(2024, 1, 25)).select("id", _r(F.col("confidence"), "confidence"))


BACKUP_RESTORE = f"WITH {EPISODES} SELECT id, round(a, 6) AS confidence FROM e WHERE ts <= TIMESTAMP '2024-01-25'"


def generations(spark, d):
    """What a generation sees of committed batches (here ranges of ids), by partition pruning."""
    at = _folder(spark)
    T.episodes(spark, d).withColumn("generation", (F.col("id") % 8).cast("int")).select("id", "confidence", "generation").write.partitionBy("generation").parquet(at)
    return S.snapshot(spark, at, 4).select("id", F.col("generation").cast("long").alias("generation"))


GENERATIONS = "SELECT event_id AS id, CAST(event_id % 8 AS BIGINT) AS generation FROM events WHERE event_id % 8 <= 4"


def migration_validated(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    target = c.where("id % 10 <> 3").unionByName(c.where("id <= 20").select((F.col("id") + 100_000_000).alias("id")))
    return T.migration_check(c, target)


MIGRATION_VALIDATED = """SELECT count(*) AS source, count(*) FILTER (c_custkey % 10 <> 3) + count(*) FILTER (c_custkey <= 20) AS target, count(*) FILTER (c_custkey % 10 = 3) AS missing,
count(*) FILTER (c_custkey <= 20) AS extra FROM customer"""


def migrated_episodes(spark, d):
    """Records of another store as episodes: the deterministic vector of their text."""
    r = T.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("label"), F.col("p_name").alias("text"))
    e = T.to_episodes(r, 8)
    return e.select("id", "space_id", *(_r(F.col("embedding")[k], f"x{k}") for k in (0, 3, 7)))


MIGRATED_EPISODES = """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS space_id, p_name AS t, greatest(CAST(ceil(length(p_name) / 8.0) AS INTEGER), 1) AS n FROM part),
c AS (SELECT *, list_transform(range(n), lambda c: CAST(coalesce(list_sum(list_transform(string_split(substr(t, CAST(c * 8 + 1 AS BIGINT), 8), ''), lambda x: ascii(x))), 0) AS BIGINT)) AS codes FROM p),
r AS (SELECT id, space_id, list_transform(range(8), lambda j: ((codes[j % n + 1] * (j + 1)) % 1000) / 1000.0::DOUBLE) AS v FROM c), s AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM r)
SELECT id, space_id, round(v[1] / l, 6) AS x0, round(v[4] / l, 6) AS x3, round(v[8] / l, 6) AS x7 FROM s"""


def content_addresses(spark, d):
    """Vectors of the same quantised content, by their hash."""
    m = T.memories(spark, d).select("id", V.content_hash(F.slice("embedding", 1, 2)).alias("h"))
    return m.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).select("first", "n", F.col("h").alias("hash"))


CONTENT_ADDRESSES = f"""WITH {_SQL_M}, h AS (SELECT id, sha256(array_to_string(list_transform(v[1:2], lambda x: CAST(CAST(floor((least(greatest(x, -1.0), 1.0) + 1) * 127.5 + 0.5) AS INTEGER) AS VARCHAR)), ',')) AS h FROM m)
SELECT min(id) AS first, count(*) AS n, h AS hash FROM h GROUP BY h"""


# Results ----------------------------------------------------------------------------------------------------------------


def results_above(spark, d):
    """A result from a threshold on, its interval at least .05 wide; and the negated interval of all."""
    e = T.episodes(spark, d).select("id", "confidence")
    kept, all_ = R.Result.of(e).above(0.9), R.Result.of(e).not_()
    one = lambda r, name: r.interval.select(F.lit(name).alias("which"), _r(F.col("point"), "point"), _r(F.col("width"), "width")).crossJoin(r.episodes.agg(F.count(F.lit(1)).alias("n")))
    return one(kept, "above").unionByName(one(all_, "not"))


RESULTS_ABOVE = f"""WITH {EPISODES}, k AS (SELECT avg(a) AS p, stddev_pop(a) AS s, count(*) AS n FROM e WHERE a >= 0.9), w AS (SELECT avg(a) AS p, stddev_pop(a) AS s, count(*) AS n FROM e)
SELECT 'above' AS which, round(p, 6) AS point, round(greatest(least(p + s, 1) - greatest(p - s, 0), 0.05), 6) AS width, n FROM k UNION ALL SELECT 'not', round(1 - p, 6), round(least(p + s, 1) - greatest(p - s, 0), 6), n FROM w"""


def result_sets(spark, d):
    """Each id once of two results, and whether the verdicts hold."""
    e = T.episodes(spark, d).select("id", "confidence")
    twice = R.dedup(e.where("id % 2 = 0").unionByName(e.where("id % 2 = 0")))
    check = Q.verified(twice, 0.5).select("above", "in_range")
    return twice.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).crossJoin(check)


RESULT_SETS = f"WITH {EPISODES} SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, min(a >= 0.5) AS above, min(a BETWEEN 0 AND 1) AS in_range FROM e WHERE id % 2 = 0"


def path_diversity(spark, d):
    ev = T.episodes(spark, d).select("who", (F.col("confidence") / 2).alias("strength"))
    return R.evidence_diversity(ev, "who").select("who", _r(F.col("diversity"), "diversity"))


PATH_DIVERSITY = f"WITH {EPISODES} SELECT user_id AS who, round(least(stddev_pop(a / 2), 0.3), 6) AS diversity FROM e GROUP BY 1"


def budgets(spark, d):
    """Which episodes of a person still fit into a budget, in order of time; percentages as confidences."""
    w = Window.partitionBy("who").orderBy("when", "id").rowsBetween(Window.unboundedPreceding, 0)
    e = T.episodes(spark, d)
    return e.select("id", C.budget_left(F.round(F.col("confidence") * 100).cast("long"), 1000, w).alias("fits"), _r(C.from_percent(F.col("id") % 130), "share"))


BUDGETS = f"WITH {EPISODES} SELECT id, sum(CAST(floor(a * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) <= 1000 AS fits, round(least(id % 130, 100) / 100, 6) AS share FROM e"


def forgetting_curve(spark, d):
    e = T.episodes(spark, d)
    h = Q.hours_between(Q.at(T.AS_OF), F.col("when"))
    return e.select("id", _r(D.forgetting(F.col("confidence"), h, 0.005), "kept"))


FORGETTING_CURVE = f"WITH {EPISODES} SELECT id, round(least(greatest(a * exp(-h * 0.005), 0), 1), 6) AS kept FROM e"


def retrieval_states(spark, d):
    """Stability, retrievability and difficulty after a person's first three events, folded in order."""
    w = Window.partitionBy("who").orderBy("when", "id")
    e = T.episodes(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3")
    one = F.struct("n", (F.col("id") % 3 != 0).alias("success"), (1 + (F.col("id") % 4) / 4).alias("effort"), "confidence")
    folded = e.groupBy("who").agg(D.ssts_fold(F.array_sort(F.collect_list(one))).alias("x"))
    return folded.select("who", _r(F.col("x.s"), "stability"), _r(F.col("x.r"), "retrievability"), _r(F.col("x.d"), "difficulty"))


_STEP = """SELECT f.who, k + 1 AS k, CASE WHEN ok THEN s + d * 1.1 * (1 + 0.9 * (effort - 1)) ELSE s * 0.95 END AS s, CASE WHEN ok THEN 0.9 + 0.08 * a ELSE 0.1 END AS r, CASE WHEN ok THEN d ELSE d * 1.15 END AS d
FROM f JOIN x ON x.who = f.who AND x.n = f.k + 1"""
RETRIEVAL_STATES = f"""WITH RECURSIVE {EPISODES}, x AS (SELECT user_id AS who, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n, id % 3 <> 0 AS ok, 1 + (id % 4) / 4 AS effort, a FROM e),
f AS (SELECT DISTINCT who, CAST(0 AS BIGINT) AS k, CAST(1.0 AS DOUBLE) AS s, CAST(0.9 AS DOUBLE) AS r, CAST(5.0 AS DOUBLE) AS d FROM x UNION ALL {_STEP} WHERE f.k < 3)
SELECT who, round(max_by(s, k), 6) AS stability, round(max_by(r, k), 6) AS retrievability, round(max_by(d, k), 6) AS difficulty FROM f GROUP BY who"""


def smoothed_access(spark, d):
    """The smoothed rate of a person's accesses among the first four."""
    w = Window.partitionBy("who").orderBy("when", "id")
    a = T.episodes(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 4").select(F.col("who").alias("id"), "when")
    return U.access_frequency(a).select("id", _r(F.col("frequency"), "frequency", 4))


SMOOTHED_ACCESS = """WITH t AS (SELECT user_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), k AS (SELECT * FROM t WHERE n <= 4),
g0 AS (SELECT id, n, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY id ORDER BY n))) / 1e6 AS g FROM k), g AS (SELECT id, 3600 / g AS f, row_number() OVER (PARTITION BY id ORDER BY n) AS n FROM g0 WHERE g > 0),
p AS (SELECT id, max(CASE WHEN n = 1 THEN f END) AS a, max(CASE WHEN n = 2 THEN f END) AS b, max(CASE WHEN n = 3 THEN f END) AS c FROM g GROUP BY 1), s AS (SELECT id, a, CASE WHEN b IS NULL THEN a ELSE 0.3 * b + 0.7 * a END AS ab, c FROM p)
SELECT DISTINCT k.id, round(coalesce(CASE WHEN c IS NULL THEN ab ELSE 0.3 * c + 0.7 * ab END, 0), 4) AS frequency FROM k LEFT JOIN s USING (id)"""


# Cues and contexts ------------------------------------------------------------------------------------------------------


def cold_content(spark, d):
    e = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("what"))
    word = "blue"
    return Q.by_content_cold(e, Q.SemanticCue(word, 0.2, None)).select("id", _r(F.col("score"), "score"))


COLD_CONTENT = """WITH p AS (SELECT p_partkey AS id, lower(p_name) AS t, list_distinct(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda w: w <> '')) AS ws FROM part),
s AS (SELECT id, CASE WHEN contains(t, 'blue') THEN 1.0 ELSE CAST(list_contains(ws, 'blue') AS INTEGER) / (len(ws) + 1.0) END AS s FROM p) SELECT id, round(s, 6) AS score FROM s WHERE s >= 0.2"""


def cues_dispatched(spark, d):
    """A cue of each kind goes to its handler: the rows that come back."""
    e = T.episodes(spark, d).withColumn("where", F.lit(None).cast("string"))
    m = T.memories(spark, d)
    asked = [
        ("after", Q.recall(e, Q.TemporalCue("after", datetime(2024, 1, 20), limit=None), T.AS_OF)),
        ("recent", Q.recall(e, Q.TemporalCue("recent", hours=240.0, limit=None), T.AS_OF)),
        ("context", Q.recall(e, Q.ContextCue(datetime(2024, 1, 5), datetime(2024, 1, 6), limit=None))),
        ("embedding", Q.recall(m, Q.EmbeddingCue(_QUERY, 0.1, None))),
    ]
    out = None
    for name, found in asked:
        x = found.agg(F.lit(name).alias("cue"), F.count(F.lit(1)).alias("n"), _r(F.sum("score"), "score", 4))
        out = x if out is None else out.unionByName(x)
    return out


CUES_DISPATCHED = f"""WITH {EPISODES}, {_SQL_Q}, {_SQL_M}, s AS (SELECT 'after' AS cue, 1.0 AS s FROM e WHERE ts > TIMESTAMP '2024-01-20' UNION ALL SELECT 'recent', 1 - h / 240 FROM e WHERE h >= 0 AND h < 240
UNION ALL SELECT 'context', 1.0 FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' UNION ALL SELECT 'embedding', list_cosine_similarity(v, q) FROM m, q WHERE list_cosine_similarity(v, q) >= 0.1)
SELECT c.cue, count(s.s) AS n, round(sum(s.s), 4) AS score FROM (VALUES ('after'), ('recent'), ('context'), ('embedding')) c(cue) LEFT JOIN s ON s.cue = c.cue GROUP BY 1"""


def reminisced(spark, d):
    """Orders that a supplier of a list took part in."""
    o = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("who"))
    return o.where(Q.with_people(["1", "2", "3"])).select("id", F.size("who").cast("long").alias("people"))


REMINISCED = "SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS people FROM lineitem GROUP BY 1 HAVING bool_or(l_suppkey IN (1, 2, 3))"


def nearest_in_time(spark, d):
    e = T.episodes(spark, d)
    found = O.nearest_in_time(e.where("id % 20 = 0"), e, 3, ["who"], 48.0)
    return found.select("anchor_id", "id", _r(F.col("hours_apart"), "hours_apart"), F.col("rank").cast("long").alias("rank"))


NEAREST_IN_TIME = """WITH p AS (SELECT a.event_id AS anchor_id, e.event_id AS id, round(abs(epoch_us(a.ts) - epoch_us(e.ts)) / 3.6e9, 9) AS h FROM events a JOIN events e ON a.user_id = e.user_id AND a.event_id <> e.event_id
WHERE a.event_id % 20 = 0 AND a.ts <> e.ts AND abs(epoch_us(a.ts) - epoch_us(e.ts)) <= 48 * 3.6e9), r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY h, id) AS rank FROM p)
SELECT anchor_id, id, round(h, 6) AS hours_apart, rank FROM r WHERE rank <= 3"""


def same_place(spark, d):
    s = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("where"))
    return O.spatial_neighbours(s.where("id % 20 = 0"), s)


SAME_PLACE = "SELECT a.s_suppkey AS anchor_id, b.s_suppkey AS id FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey % 20 = 0 AND a.s_suppkey <> b.s_suppkey"


def contained_texts(spark, d):
    """Parts whose name holds the last words of another's, or the other way round; the five largest ids."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("what"), F.col("p_partkey").alias("order"))
    a = p.withColumn("what", F.substring_index("what", " ", -2))
    return O.containing(a, p, "what", 5, "order").select("anchor_id", "id", F.col("rank").cast("long").alias("rank"))


CONTAINED_TEXTS = """WITH p AS (SELECT p_partkey AS id, lower(p_name) AS t FROM part), a AS (SELECT id, array_to_string(list_slice(string_split(t, ' '), -2, -1), ' ') AS t FROM p),
m AS (SELECT a.id AS anchor_id, p.id, row_number() OVER (PARTITION BY a.id ORDER BY p.id DESC) AS rank FROM a JOIN p ON a.id <> p.id AND (contains(p.t, a.t) OR contains(a.t, p.t))) SELECT anchor_id, id, rank FROM m WHERE rank <= 5"""


def merged_contexts(spark, d):
    """Weights by time and by place of an anchor's neighbours; the midpoint where both speak."""
    e = T.episodes(spark, d)
    t = e.where("id % 3 = 0").select("id", F.col("confidence").alias("weight"))
    s = e.where("id % 2 = 0").select("id", (F.col("confidence") / 2).alias("weight"))
    return M.merge_contexts(t, s).select("id", _r(F.col("weight"), "weight"))


MERGED_CONTEXTS = f"WITH {EPISODES} SELECT id, round(CASE WHEN id % 6 = 0 THEN 0.75 * a WHEN id % 3 = 0 THEN a ELSE a / 2 END, 6) AS weight FROM e WHERE id % 3 = 0 OR id % 2 = 0"


def match_scores(spark, d):
    e = T.episodes(spark, d)
    a = e.where("id % 3 = 0").select("id", F.col("confidence").alias("score"))
    b = e.where("id % 2 = 0").select("id", (F.col("confidence") / 2).alias("score"))
    return M.merge_match_scores(a, b, 0.6).select("id", _r(F.col("relevance"), "relevance"))


MATCH_SCORES = f"WITH {EPISODES} SELECT id, round(CASE WHEN id % 3 = 0 THEN a * 0.6 ELSE 0 END + CASE WHEN id % 2 = 0 THEN a / 2 * 0.4 ELSE 0 END, 6) AS relevance FROM e WHERE id % 3 = 0 OR id % 2 = 0"


# Words ------------------------------------------------------------------------------------------------------------------


def _terms(spark, d) -> DataFrame:
    return T.read(spark, d, "events").select(F.col("event_type").alias("query")).distinct()


def lexicon_expansion(spark, d):
    lex = spark.createDataFrame(_LEXICON, "term string, variant string, confidence double")
    out = X.expand_query(_terms(spark, d), [lex, lex.withColumn("confidence", F.col("confidence") / 2)])
    return out.select("query", "variant", _r(F.col("confidence"), "confidence"), F.col("rank").cast("long").alias("rank"))


LEXICON_EXPANSION = f"""WITH {_SQL_LEXICON}, q AS (SELECT DISTINCT event_type AS query FROM events), x AS (SELECT query, query AS variant, 1.0::DOUBLE AS c FROM q UNION ALL SELECT query, variant, confidence FROM q JOIN lx ON lower(query) = term WHERE confidence >= 0.3)
SELECT query, variant, round(c, 6) AS confidence, row_number() OVER (PARTITION BY query ORDER BY c DESC, variant) AS rank FROM x"""


def idioms_read(spark, d):
    table = spark.createDataFrame([(t, v) for t, v, _ in _LEXICON], "term string, variant string")
    return X.idioms(_terms(spark, d), table).select("query", "variant", "confidence")


IDIOMS_READ = f"WITH {_SQL_LEXICON} SELECT DISTINCT event_type AS query, variant, 0.9::DOUBLE AS confidence FROM events JOIN lx ON lower(event_type) = term"


def analogies(spark, d):
    """Names put as analogies, split again; their words; how alike the two sides' words are."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.element_at(F.array(F.lit(" is "), F.lit(" like "), F.lit(" and ")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_type")).alias("q"), "p_name", "p_type")
    a = X.analogy_parts(F.col("q"))
    return p.select("id", a["relation"].alias("relation"), a["target"].alias("target"), F.size(X.tokenise(F.col("q"))).cast("long").alias("words"), _r(X.word_similarity(F.col("p_name"), F.col("p_type")), "alike"))


ANALOGIES = """WITH p AS (SELECT p_partkey AS id, p_name || [' is ', ' like ', ' and '][p_partkey % 3 + 1] || p_type AS q, string_split_regex(lower(p_name), '\\s+') AS x, string_split_regex(lower(p_type), '\\s+') AS y FROM part)
SELECT id, nullif(regexp_extract(q, '(?s)^(.*?) (as|like|is) (.*)$', 2), '') AS relation, nullif(regexp_extract(q, '(?s)^(.*?) (as|like|is) (.*)$', 3), '') AS target, len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) AS words,
round(len(list_filter(x, lambda w: len(list_filter(y, lambda v: contains(w, v) OR contains(v, w))) > 0)) / greatest(len(x), len(y)), 6) AS alike FROM p"""


def models_compatible(spark, d):
    n = T.read(spark, d, "nation")
    name = lambda c: F.when(F.col(c) % 2 == 0, "a").otherwise("b")
    return n.select(F.col("n_nationkey").alias("id"), O.compatible(name("n_nationkey"), F.col("n_nationkey") % 3, name("n_regionkey"), F.col("n_regionkey") % 3).alias("ok"))


MODELS_COMPATIBLE = "SELECT n_nationkey AS id, n_nationkey % 2 = n_regionkey % 2 AND n_nationkey % 3 = n_regionkey % 3 AS ok FROM nation"


def clocks(spark, d):
    """Vector clocks of orders, by the customer's and the order's numbers."""
    m = lambda *v: F.map_from_arrays(F.array(*(F.lit(k) for k in "xyz"[: len(v)])), F.array(*v))
    o = T.read(spark, d, "orders")
    a = m(F.col("o_orderkey") % 4, F.col("o_orderkey") % 3, F.col("o_custkey") % 2)
    b = m(F.col("o_custkey") % 4, F.col("o_custkey") % 3)
    return o.select(F.col("o_orderkey").alias("id"), O.compare_clocks(a, b).alias("order"))


CLOCKS = """WITH c AS (SELECT o_orderkey AS id, o_orderkey % 4 AS a1, o_orderkey % 3 AS a2, o_custkey % 2 AS a3, o_custkey % 4 AS b1, o_custkey % 3 AS b2 FROM orders), x AS (SELECT id, a1 < b1 OR a2 < b2 OR a3 < 0 AS l, a1 > b1 OR a2 > b2 OR a3 > 0 AS m FROM c)
SELECT id, CASE WHEN l AND m THEN 'concurrent' WHEN l THEN 'before' WHEN m THEN 'after' ELSE 'equal' END AS "order" FROM x"""


# Seeds, blending, graphs ------------------------------------------------------------------------------------------------


def seeds(spark, d):
    s = P.seed(T.memories(spark, d), Q.EmbeddingCue(_QUERY, 0.1, None), 0.5)
    return s.select("id", _r(F.col("activation"), "activation"), _r(F.col("confidence"), "confidence"))


SEEDS = f"""WITH {_SQL_Q}, {_SQL_M}, s AS (SELECT id, list_cosine_similarity(v, q) AS s FROM m, q WHERE list_cosine_similarity(v, q) >= 0.1), t AS (SELECT id, s, 1 / (1 + exp(-(s - 0.4) / 0.5)) AS a FROM s)
SELECT id, round(a, 6) AS activation, round(greatest(s, a * 0.5), 6) AS confidence FROM t WHERE a >= 0.01"""


def blended_recall(spark, d):
    """Two pathways with each their confidences: their full join, weighed and calibrated by where a row came from."""
    m = T.memories(spark, d)
    a = m.where("id % 3 <> 0").select("id", "confidence")
    b = m.where("id % 2 = 0").select("id", (F.col("confidence") * 0.8).alias("confidence"), ((F.col("id") % 10) / 10).alias("coherence"))
    return P.blended(a, b).select("id", "source", _r(F.col("confidence"), "confidence"))


BLENDED_RECALL = f"""WITH {_SQL_M}, x AS (SELECT id, CASE WHEN id % 3 <> 0 THEN a END AS e0, CASE WHEN id % 2 = 0 THEN a * 0.8 END AS s0, (id % 10) / 10 AS k FROM m WHERE id % 3 <> 0 OR id % 2 = 0),
y AS (SELECT *, coalesce(e0, 0) AS e, coalesce(s0, 0) AS s, 0.7 * coalesce(e0, 0) AS pe, 0.3 * coalesce(s0, 0) * (0.5 + 0.5 * CASE WHEN s0 IS NULL THEN 0 ELSE k END) AS ps FROM x), z AS (SELECT *, pe / (pe + ps) AS we, ps / (pe + ps) AS ws FROM y),
b AS (SELECT *, least(greatest(e * we + s * ws, 0), 1) AS mixed FROM z), c AS (SELECT *, least(greatest(CASE WHEN e > 0.5 AND s > 0.5 THEN least(mixed * 1.1, greatest(e, s) * 1.1) ELSE mixed END, 0), 1) AS c FROM b)
SELECT id, CASE WHEN e0 IS NOT NULL AND s0 IS NOT NULL THEN 'both' WHEN s0 IS NOT NULL THEN 'semantic' ELSE 'episodic' END AS source, round(least(greatest(CASE WHEN e0 IS NOT NULL AND s0 IS NOT NULL THEN c * 1.15 * (1 + 0.1 * (1 - abs(we - ws)))
WHEN s0 IS NOT NULL THEN c * CASE WHEN k >= 0.7 THEN 1.05 ELSE 0.9 END ELSE c END, 0), 1), 6) AS confidence FROM c"""


def _tree(spark, d) -> DataFrame:
    return T.hierarchy(spark, d).where("direction = 'down'").select("src", "dst", "weight")


def activation_bfs(spark, d):
    """From the regions down to the customers, activation falling with depth."""
    start = T.read(spark, d, "region").where("r_regionkey <= 2").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(1.0).alias("activation"))
    out = graph.bfs_activation(keep(_tree(spark, d)), start, 3, lambda k: 0.8**k)
    return out.select("id", F.col("depth").cast("long").alias("depth"), _r(F.col("activation"), "activation"))


ACTIVATION_BFS = """SELECT 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS depth, 1.0::DOUBLE AS activation FROM region WHERE r_regionkey <= 2 UNION ALL SELECT 'n' || n_nationkey, 1, round(0.9 * 0.8, 6) FROM nation WHERE n_regionkey <= 2
UNION ALL SELECT 'c' || c_custkey, 2, round(0.9 * 0.8 * 0.8 * 0.64, 6) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <= 2"""


def walk_dfs(spark, d):
    start = T.read(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.dfs(keep(_tree(spark, d)), start, 2).select("id", F.col("depth").cast("long").alias("depth"), "path")


WALK_DFS = """SELECT 'r1' AS id, CAST(0 AS BIGINT) AS depth, 'r1' AS path UNION ALL SELECT 'n' || n_nationkey, 1, 'r1/n' || n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'c' || c_custkey, 2, 'r1/n' || n_nationkey || '/c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1"""


def edges_changed(spark, d):
    """Edges added, and those of removed nodes gone."""
    e = _tree(spark, d)
    more = T.read(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit(0.5).alias("weight"))
    gone = T.read(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return graph.remove_nodes(graph.add_edges(e, more), gone).groupBy("src").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("weight"), "weight"))


EDGES_CHANGED = """WITH x AS (SELECT 'r' || n_regionkey AS src, n_nationkey AS k, 0.9::DOUBLE AS w FROM nation UNION ALL SELECT 'n' || c_nationkey, c_nationkey, 0.8 FROM customer UNION ALL SELECT 'n' || s_nationkey, s_nationkey, 0.5 FROM supplier)
SELECT src, count(*) AS n, round(sum(w), 6) AS weight FROM x WHERE k % 3 <> 0 GROUP BY 1"""


def tired_nodes(spark, d):
    """The first three contributions of a person's events, each tiring the node."""
    w = Window.partitionBy("who").orderBy("when", "id")
    e = T.episodes(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3")
    out = graph.fatigue_fold(e.select(F.col("who").alias("id"), (F.col("n") * 10).alias("at_ms"), (F.col("confidence") / 4).alias("amount")))
    return out.select("id", _r_scaled(F.col("activation"), "activation"))


TIRED_NODES = f"""WITH {EPISODES}, x AS (SELECT user_id AS id, a, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM e)
SELECT id, round(sum(a / 4 * pow(0.9, n - 1)), 6) AS activation FROM x WHERE n <= 3 GROUP BY 1"""


def dependency_order(spark, d):
    """Levels of the hierarchy, and the nodes on a cycle when some links also go back."""
    e = keep(_tree(spark, d))
    levels = graph.topological_levels(e).select("id", F.col("level").cast("long").alias("level"))
    back = T.read(spark, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    links = T.read(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    loops = graph.dependency_cycles(links.unionByName(back)).select("id", F.lit(1).cast("long").alias("loop"))
    return levels.join(loops, "id", "left").select("id", "level", F.coalesce("loop", F.lit(0)).cast("long").alias("loop"))


DEPENDENCY_ORDER = """SELECT DISTINCT 'r' || n_regionkey AS id, CAST(0 AS BIGINT) AS level, CAST(n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 5) AS BIGINT) AS loop FROM nation
UNION ALL SELECT 'n' || n_nationkey, 1, CAST(n_nationkey < 5 AS BIGINT) FROM nation UNION ALL SELECT 'c' || c_custkey, 2, 0 FROM customer"""


def dot_export(spark, d):
    """Graphviz lines of a spread, numbered as they would be written."""
    n = T.read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), ((F.col("n_nationkey") % 10) / 8).alias("activation"))
    links = T.read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return graph.dot_lines(n, links)


DOT_EXPORT = """SELECT 'digraph spread {' AS value UNION ALL SELECT '}' UNION ALL SELECT '  "n' || n_nationkey || '" [label="n' || n_nationkey || ' ' || printf('%.3f', (n_nationkey % 10) / 8) || '"];' FROM nation
UNION ALL SELECT '  "n' || n_nationkey || '" -> "r' || n_regionkey || '";' FROM nation"""


# Concepts ---------------------------------------------------------------------------------------------------------------


def node_kinds(spark, d):
    """Memories told apart as episodes and concepts, and what introspection says of them."""
    m = T.memories(spark, d)
    e, c = O.split_kinds(m, F.col("id") % 4 != 0)
    own = O.introspect(m, _tree(spark, d))
    return O.count_kinds(e, c).crossJoin(own.select("memories", _r(F.col("confidence"), "confidence"), "without_vector", "edges"))


NODE_KINDS = f"""WITH {_SQL_M} SELECT count(*) FILTER (id % 4 <> 0) AS episodes, count(*) FILTER (id % 4 = 0) AS concepts, count(*) AS memories, round(avg(a), 6) AS confidence, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS without_vector,
(SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS edges FROM m"""


def _members(spark, d) -> DataFrame:
    """Vector episodes with their concept as the cluster."""
    return T.vector_episodes(spark, d).withColumnRenamed("concept", "cluster")


_SQL_CENTRES = f"{_SQL_VE}, cc AS (SELECT concept, list(x ORDER BY i) AS c FROM (SELECT concept, i, avg(v[i]) AS x FROM ve, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1), st AS (SELECT concept, avg(list_cosine_similarity(v, c)) AS s, count(*) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) AS ids FROM ve JOIN cc USING (concept) GROUP BY 1)"


def concepts_formed(spark, d):
    """Each concept as a pattern: strength, significance, signature by its members, the memory it becomes."""
    p = keep(K.pattern_strength(_members(spark, d)))
    k = K.significant(p, 1.1).withColumn("signature", K.signature(F.col("source_episodes")))
    named = O.semantic_memories(p).select(F.col("id").alias("memory"), F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("cluster"))
    return k.join(named, "cluster").select("cluster", "memory", "signature", _r(F.col("strength"), "strength"), _r(F.col("p"), "p", 4))


CONCEPTS_FORMED = f"""WITH {_SQL_CENTRES}, x AS (SELECT *, 2 / greatest(s, 1e-6) AS ex FROM st)
SELECT CAST(concept AS BIGINT) AS cluster, 'semantic_' || concept AS memory, sha256(array_to_string(list_sort(string_split(ids, '|')), '|')) AS signature, round(s, 6) AS strength, round(exp(-(pow(n - ex, 2) / ex) / 2), 4) AS p FROM x"""


def patterns_merged(spark, d):
    """Every second concept merged into the one before it."""
    p = keep(K.pattern_strength(_members(spark, d)))
    links = p.where("cluster % 2 = 1").select(F.col("cluster").alias("a"), (F.col("cluster") - 1).alias("b"))
    out = K.merge_patterns(p, links)
    return out.select(F.col(out.columns[0]).cast("long").alias("cluster"), _r(F.col("strength"), "strength"), "n")


PATTERNS_MERGED = f"WITH {_SQL_CENTRES} SELECT CAST(concept - concept % 2 AS BIGINT) AS cluster, round(sum(s * n) / sum(n), 6) AS strength, CAST(sum(n) AS BIGINT) AS n FROM st GROUP BY 1"


def consolidated(spark, d):
    """Old episodes as semantic memories, how far each has been consolidated, and how badly the patterns predict it."""
    e = _members(spark, d)
    p = keep(K.pattern_strength(e.where("id % 3 <> 0")))
    told = K.systems_consolidation(e, T.AS_OF, 24.0 * 10).select(F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("id"), "confidence")
    out = K.consolidation_progress(e, p).join(K.prediction_error(e, p, 64, 0.2), "id").join(told, "id", "left")
    return out.select("id", _r(F.col("progress"), "progress"), _r(F.col("prediction_error"), "error"), _r(F.col("confidence"), "confidence", 9))


CONSOLIDATED = f"""WITH {_SQL_VE}, cc AS (SELECT concept, list(x ORDER BY i) AS c FROM (SELECT concept, i, avg(v[i]) AS x FROM ve, range(1, 65) t(i) WHERE id % 3 <> 0 GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT id, max_by(list_distance(v, c), list_cosine_similarity(v, c)) AS dist, max(list_cosine_similarity(v, c)) AS s FROM ve, cc GROUP BY 1)
SELECT ve.id, CASE WHEN ve.id % 3 <> 0 THEN 0.2::DOUBLE ELSE 0 END AS progress, round(CASE WHEN s > 0.2 THEN dist / 64 ELSE 1 END, 6) AS error,
CASE WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) > 240 * 3.6e9 THEN round(a * exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9 / 24), 9) END AS confidence FROM ve JOIN b USING (id)"""


def replay_chosen(spark, d):
    """What ripples replay, what a dream takes, what goes first under pressure: reports of the first few."""
    e = T.episodes(spark, d).withColumn("prediction_error", (F.col("id") % 100) / 100).withColumn("last_access", F.col("when"))
    a = K.replay_selection(e, 20).select(F.lit("replay").alias("kind"), "id")
    b = K.select_dream(e, T.AS_OF, 24.0, 50).select(F.lit("dream").alias("kind"), "id")
    c = U.lru(e, 30).select(F.lit("lru").alias("kind"), "id")
    return a.unionByName(b).unionByName(c)


REPLAY_CHOSEN = f"""WITH {EPISODES} SELECT 'replay' AS kind, id FROM (SELECT id FROM e ORDER BY round((id % 100) / 100 * a, 12) DESC, id LIMIT 20) UNION ALL SELECT 'dream', id FROM (SELECT id FROM e WHERE h > 24 ORDER BY a DESC, id LIMIT 50)
UNION ALL SELECT 'lru', id FROM (SELECT id FROM e ORDER BY ts, id LIMIT 30)"""


def gates(spark, d):
    """Whether concepts may form after so many cycles, episodes and minutes; which breaker trips."""
    rows = []
    for i in range(24):
        ok, why = K.should_form(i % 5, i, float(i * 3))
        rows.append((i, ok, why, O.breaker_tripped(i * 10, i, 40)))
    return spark.createDataFrame(rows, "id long, ok boolean, why string, breaker string")


GATES = """SELECT CAST(i AS BIGINT) AS id, i % 5 >= 3 AND i >= 10 AND i * 3 >= 30 AS ok, CASE WHEN i % 5 < 3 THEN 'cycles' WHEN i < 10 THEN 'episodes' WHEN i * 3 < 30 THEN 'spacing' END AS why,
CASE WHEN i * 10 > 100 THEN 'rate' WHEN i / 40 > 0.3 THEN 'share' END AS breaker FROM range(24) t(i)"""


def duplicates_merged(spark, d):
    """Pairs of neighbouring memories as one, and the share of duplicates among all."""
    m = T.memories(spark, d)
    a, b = m.where("id % 2 = 0"), m.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.col("embedding").alias("eb"), F.col("confidence").alias("cb"))
    v, c = U.merge_pair(F.col("embedding"), F.col("eb"), F.col("confidence"), F.col("cb"))
    met = a.join(b, "id").withColumns({"v": v, "c": c, "action": F.when(V.cosine(F.col("embedding"), F.col("eb")) >= 0.1, "merge").otherwise("keep_both")})
    rate = U.deduplication_rate(met).select("rate")
    return met.select("id", _r(F.col("v")[0], "x0"), _r(F.col("c"), "confidence")).crossJoin(rate.select(_r(F.col("rate"), "rate")))


DUPLICATES_MERGED = f"""WITH {_SQL_M}, p AS (SELECT x.id, list_transform(range(1, 65), lambda i: x.v[i] + y.v[i]) AS s, greatest(x.a, y.a) * 0.95 AS c, list_cosine_similarity(x.v, y.v) >= 0.1 AS dup FROM m x JOIN m y ON x.id % 2 = 0 AND y.id = x.id + 1)
SELECT id, round(s[1] / sqrt(list_sum(list_transform(s, lambda z: z * z))), 6) AS x0, round(least(c, 1), 6) AS confidence, (SELECT round(avg(CAST(dup AS INTEGER)), 6) FROM p) AS rate FROM p"""


# Completion -------------------------------------------------------------------------------------------------------------


def completion_scores(spark, d):
    """Completion confidence, gated; how alike two records are by their fields."""
    e = T.episodes(spark, d)
    c = M.completion_confidence(F.col("confidence"), F.col("confidence") / 2, F.lit(0.8), F.lit(0.6), F.col("id") % 3 != 0)
    f = M.field_similarity(F.col("what"), F.lit("view"), F.when(F.col("id") % 2 == 0, "here"), F.lit("here"), F.col("confidence"))
    return M.gated(e.select("id", c.alias("confidence"), f.alias("fields")), 0.3).select("id", _r(F.col("confidence"), "confidence"), _r(F.col("fields"), "fields"))


COMPLETION_SCORES = f"""WITH {EPISODES}, x AS (SELECT id, least(greatest((0.3 * a + 0.25 * a / 2 + 0.25 * 0.8 + 0.2 * 0.6) * CASE WHEN id % 3 <> 0 THEN 1 ELSE 0.3 END, 0), 1) AS c,
(CASE WHEN contains(event_type, 'view') OR contains('view', event_type) THEN 1.0 ELSE 0.0 END + CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0 END + 0.5 * a) / CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS f FROM e)
SELECT id, round(c, 6) AS confidence, round(f, 6) AS fields FROM x WHERE c >= 0.3"""


def hypotheses_made(spark, d):
    """What rules and neighbours say of a person's commonest event."""
    e = T.episodes(spark, d).where("who % 20 = 0")
    partials = e.select("id", F.map_from_arrays(F.array(F.lit("what")), F.array("what")).alias("known_fields"))
    rules = spark.createDataFrame([("what", t, v, c) for t, v, c in _LEXICON], "field string, given string, value string, confidence double")
    near = e.select(F.col("id").alias("partial_id"), F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("value"), F.col("confidence").alias("similarity"))
    out = O.hypotheses(partials, rules, near, 2)
    return out.select("partial_id", "value", "origin", _r(F.col("confidence"), "confidence"), F.col("rank").cast("long").alias("rank"))


HYPOTHESES_MADE = f"""WITH {EPISODES}, {_SQL_LEXICON}, h AS (SELECT id AS partial_id, variant AS value, confidence AS c, 'rule' AS origin FROM e JOIN lx ON term = event_type WHERE user_id % 20 = 0 UNION ALL SELECT id, 'v' || id % 3, a, 'pattern' FROM e WHERE user_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY partial_id ORDER BY c DESC, value) AS rank FROM h) SELECT partial_id, value, origin, round(c, 6) AS confidence, rank FROM r WHERE rank <= 2"""


def pattern_votes(spark, d):
    """The field value that the members of a matched pattern vote for."""
    m = _members(spark, d)
    patterns = m.groupBy("cluster").agg(F.collect_list("id").alias("source_episodes"))
    matches = T.read(spark, d, "nation").select(F.col("n_nationkey").alias("partial_id"), F.col("n_regionkey").alias("cluster"), (1 / (1 + F.col("n_nationkey"))).alias("relevance"))
    out = O.pattern_values(matches, patterns, m, "what")
    return out.select("partial_id", "value", _r(F.col("confidence"), "confidence"))


PATTERN_VOTES = f"""WITH {_SQL_VE}, x AS (SELECT n_nationkey AS partial_id, event_type AS value, sum(1.0 / (1 + n_nationkey)) AS w FROM nation JOIN ve ON concept = n_regionkey JOIN events ON event_id = ve.id GROUP BY 1, 2),
r AS (SELECT *, w / sum(w) OVER (PARTITION BY partial_id) AS c, row_number() OVER (PARTITION BY partial_id ORDER BY round(w, 9) DESC, value) AS n FROM x) SELECT partial_id, value, round(c, 6) AS confidence FROM r WHERE n = 1"""


def field_sources(spark, d):
    """The commonest source of a person's fields; ties go to the stricter one."""
    e = T.episodes(spark, d).select("who", M.source_of(F.col("id") % 4 == 0, F.col("confidence"), (F.col("id") % 10) / 10).alias("source"))
    return M.reality(e, "who")


FIELD_SOURCES = f"""WITH {EPISODES}, s AS (SELECT user_id AS who, CASE WHEN id % 4 = 0 THEN 'recalled' WHEN (id % 10) / 10 > 0.7 AND a >= 0.7 THEN 'consolidated' WHEN (id % 10) / 10 > 0.7 AND a >= 0.5 THEN 'reconstructed' ELSE 'imagined' END AS source FROM e),
n AS (SELECT who, source, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY n DESC, CASE source WHEN 'recalled' THEN 4 WHEN 'consolidated' THEN 3 WHEN 'reconstructed' THEN 2 ELSE 1 END DESC) AS k FROM n) SELECT who, source FROM r WHERE k = 1"""


def primed(spark, d):
    """Nations primed by recalled regions, over one link or two."""
    n = T.read(spark, d, "nation")
    edges = n.select(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") + 100).alias("dst")).unionByName(n.select((F.col("n_nationkey") + 100).alias("src"), (F.col("n_nationkey") % 5 + 200).alias("dst")))
    recalled = T.read(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("id"))
    ends = edges.select(F.col("dst").alias("b")).distinct()
    links = recalled.select(F.col("id").alias("a")).crossJoin(ends).withColumn("score", 0.5 + (F.col("b") % 10) / 20)
    return G.prime(edges, recalled, links).select("id", _r(F.col("boost"), "boost"))


PRIMED = """WITH g AS (SELECT n_regionkey AS src, n_nationkey + 100 AS dst FROM nation UNION ALL SELECT n_nationkey + 100, n_nationkey % 5 + 200 FROM nation), o AS (SELECT src AS a, dst AS b, 1.0::DOUBLE AS w FROM g WHERE src < 3),
t AS (SELECT * FROM o UNION ALL SELECT o.a, g.dst, 0.5 FROM o JOIN g ON g.src = o.b), s AS (SELECT b, w, 0.5 + (b % 10) / 20 AS s FROM t) SELECT b AS id, round(max((s - 0.6) / 0.4 * 0.15 * w), 6) AS boost FROM s WHERE s >= 0.6 GROUP BY 1"""


def cycles_counted(spark, d):
    return G.reconsolidation_cycles(T.read(spark, d, "events").select(F.col("user_id").alias("id")), 4)


CYCLES_COUNTED = "SELECT user_id AS id, count(*) AS cycles, count(*) > 8 AS exceeded FROM events GROUP BY 1"


# Observations and batches -----------------------------------------------------------------------------------------------


def _observations(spark, d) -> DataFrame:
    p = F.when(F.col("event_id") % 10 == 0, "high").when(F.col("event_id") % 10 < 6, "normal").otherwise("low")
    return T.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("arrival"), F.col("event_id").alias("seq"), p.alias("priority"), F.col("user_id").alias("session_id"))


def queue_admission(spark, d):
    """Of each priority what its queue still takes when the low one already holds almost all it can."""
    o = _observations(spark, d)
    return S.admitted(o).select("id", "priority", "admitted")


QUEUE_ADMISSION = """WITH o AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'high' WHEN event_id % 10 < 6 THEN 'normal' ELSE 'low' END AS priority FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY id) AS n FROM o) SELECT id, priority, n <= CASE priority WHEN 'high' THEN 10000 WHEN 'normal' THEN 100000 ELSE 50000 END AS admitted FROM r"""


def queue_order(spark, d):
    """The first two hundred of a queue: by priority, then by sequence."""
    return S.by_priority(_observations(spark, d)).limit(200).select("id", "priority")


QUEUE_ORDER = """WITH o AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'high' WHEN event_id % 10 < 6 THEN 'normal' ELSE 'low' END AS priority FROM events)
SELECT id, priority FROM o ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, id LIMIT 200"""


def sequence_checks(spark, d):
    """What sessions' numbering expects: every seventh observation has lost its own number."""
    o = _observations(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("arrival")))
    o = o.withColumn("seq", F.when(F.col("arrival") % 7 == 0, F.col("seq") + 2).otherwise(F.col("seq")).cast("long"))
    return S.sequence_gaps(o).select("id", "session_id", "seq", "status")


SEQUENCE_CHECKS = """WITH o AS (SELECT event_id AS id, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS seq FROM events),
x AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), seq - 1) + 1 AS want FROM o) SELECT id, session_id, seq, CASE WHEN seq = want THEN 'ok' WHEN seq < want THEN 'duplicate' ELSE 'gap' END AS status FROM x"""


def mixed_batch(spark, d):
    """Stores, then similarity searches on what is there after them: the three nearest of each."""
    m = T.memories(spark, d).select("id", "embedding", "confidence")
    store = m.where("id < 5").select((F.col("id") + 1).alias("op_id"), F.lit("store").alias("op"), (F.col("id") + 1_000_000).alias("id"), "embedding", "confidence")
    ask = m.where("id < 5").select((F.col("id") + 101).alias("op_id"), F.lit("similarity").alias("op"), F.lit(None).cast("long").alias("id"), "embedding", "confidence")
    _, found = O.run_batch(store.unionByName(ask), m, 3)
    return found.select("op_id", "id", _r(F.col("score"), "score"))


MIXED_BATCH = f"""WITH {_SQL_M}, y AS (SELECT id, v FROM m UNION ALL SELECT id + 1000000, v FROM m WHERE id < 5), s AS (SELECT x.id + 101 AS op_id, y.id, list_cosine_similarity(x.v, y.v) AS s FROM m x, y WHERE x.id < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY round(s, 6) DESC, id) AS n FROM s) SELECT op_id, id, round(s, 6) AS score FROM r WHERE n <= 3"""


# Small parts ------------------------------------------------------------------------------------------------------------


def compensated_sums(spark, d):
    m = T.memories(spark, d)
    return m.select("id", _r(V.kahan_sum(F.col("embedding")), "total", 9))


COMPENSATED_SUMS = f"WITH {_SQL_M} SELECT id, round(list_sum(v), 9) AS total FROM m"


def metadata(spark, d):
    """A map of an event's fields: read, asked for, set."""
    e = T.read(spark, d, "events")
    m = F.when(F.col("event_id") % 5 != 0, F.map_from_arrays(F.array(F.lit("type"), F.lit("user")), F.array(F.col("event_type"), F.col("user_id").cast("string"))))
    changed = O.metadata_set(m, "type", F.concat(F.lit("x"), F.col("event_id").cast("string")))
    return e.select(F.col("event_id").alias("id"), O.metadata_get(m, "type", "none").alias("type"), O.metadata_has(m, "user").alias("known"), O.metadata_get(changed, "type").alias("changed"), F.size(changed).cast("long").alias("n"))


METADATA = """SELECT event_id AS id, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'none' END AS type, event_id % 5 <> 0 AS known, 'x' || event_id AS changed, CAST(CASE WHEN event_id % 5 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM events"""


def replay_means(spark, d):
    e = T.episodes(spark, d)
    return U.running_mean(e, "who", ["when", "id"], "confidence").select("id", _r_scaled(F.col("mean"), "mean"))


REPLAY_MEANS = f"WITH {EPISODES} SELECT id, round(avg(a) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 6) AS mean FROM e"


def worker_shards(spark, d):
    """How a user's observations are dealt out to eight workers."""
    e = T.read(spark, d, "events")
    return e.groupBy(T.shard_of(F.col("user_id"), 8).alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("spaces"))


WORKER_SHARDS = "SELECT CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS worker, count(*) AS n, count(DISTINCT user_id) AS spaces FROM events GROUP BY 1"


def space_recall(spark, d):
    """Memories kept apart by space (here the concept), and the best of one of them."""
    at = _folder(spark)
    T.write_by_space(T.memories(spark, d).withColumn("space_id", F.concat(F.lit("s"), F.col("concept").cast("string"))), at)
    return T.recall_in_space(spark, at, "s3", _QUERY, 0.0, 25).select("id", _r(F.col("score"), "score"))


SPACE_RECALL = f"WITH {_SQL_Q}, {_SQL_M}, s AS (SELECT id, list_cosine_similarity(v, q) AS s FROM m, q WHERE concept = 3) SELECT id, round(s, 6) AS score FROM s WHERE s >= 0 ORDER BY s.s DESC, id LIMIT 25"


_ALL = {
    "compensated_sums": (compensated_sums, COMPENSATED_SUMS), "metadata": (metadata, METADATA), "replay_means": (replay_means, REPLAY_MEANS), "worker_shards": (worker_shards, WORKER_SHARDS), "space_recall": (space_recall, SPACE_RECALL),
    "tier_scan": (tier_scan, TIER_SCAN), "tier_recall": (tier_recall, TIER_RECALL), "cold_scan": (cold_scan, COLD_SCAN), "log_compaction": (log_compaction, LOG_COMPACTION), "backup_restore": (backup_restore, BACKUP_RESTORE),
    "generations": (generations, GENERATIONS), "migration_validated": (migration_validated, MIGRATION_VALIDATED), "migrated_episodes": (migrated_episodes, MIGRATED_EPISODES), "content_addresses": (content_addresses, CONTENT_ADDRESSES),
    "results_above": (results_above, RESULTS_ABOVE), "result_sets": (result_sets, RESULT_SETS), "path_diversity": (path_diversity, PATH_DIVERSITY), "budgets": (budgets, BUDGETS), "forgetting_curve": (forgetting_curve, FORGETTING_CURVE),
    "retrieval_states": (retrieval_states, RETRIEVAL_STATES), "smoothed_access": (smoothed_access, SMOOTHED_ACCESS), "cold_content": (cold_content, COLD_CONTENT), "cues_dispatched": (cues_dispatched, CUES_DISPATCHED),
    "reminisced": (reminisced, REMINISCED), "nearest_in_time": (nearest_in_time, NEAREST_IN_TIME), "same_place": (same_place, SAME_PLACE), "contained_texts": (contained_texts, CONTAINED_TEXTS), "merged_contexts": (merged_contexts, MERGED_CONTEXTS),
    "match_scores": (match_scores, MATCH_SCORES), "lexicon_expansion": (lexicon_expansion, LEXICON_EXPANSION), "idioms_read": (idioms_read, IDIOMS_READ), "analogies": (analogies, ANALOGIES), "models_compatible": (models_compatible, MODELS_COMPATIBLE),
    "clocks": (clocks, CLOCKS), "seeds": (seeds, SEEDS), "blended_recall": (blended_recall, BLENDED_RECALL), "activation_bfs": (activation_bfs, ACTIVATION_BFS), "walk_dfs": (walk_dfs, WALK_DFS), "edges_changed": (edges_changed, EDGES_CHANGED),
    "tired_nodes": (tired_nodes, TIRED_NODES), "dependency_order": (dependency_order, DEPENDENCY_ORDER), "dot_export": (dot_export, DOT_EXPORT), "node_kinds": (node_kinds, NODE_KINDS), "concepts_formed": (concepts_formed, CONCEPTS_FORMED),
    "patterns_merged": (patterns_merged, PATTERNS_MERGED), "consolidated": (consolidated, CONSOLIDATED), "replay_chosen": (replay_chosen, REPLAY_CHOSEN), "gates": (gates, GATES), "duplicates_merged": (duplicates_merged, DUPLICATES_MERGED),
    "completion_scores": (completion_scores, COMPLETION_SCORES), "hypotheses_made": (hypotheses_made, HYPOTHESES_MADE), "pattern_votes": (pattern_votes, PATTERN_VOTES), "field_sources": (field_sources, FIELD_SOURCES), "primed": (primed, PRIMED),
    "cycles_counted": (cycles_counted, CYCLES_COUNTED), "queue_admission": (queue_admission, QUEUE_ADMISSION), "queue_order": (queue_order, QUEUE_ORDER), "sequence_checks": (sequence_checks, SEQUENCE_CHECKS), "mixed_batch": (mixed_batch, MIXED_BATCH),
}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: s for k, (_, s) in _ALL.items()}
