"""Text similarity, lexicons and figures of speech as Column expressions and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .confidence import _c


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; 0 if both are empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, 0.0).otherwise(both / F.when(any_ == 0, 1).otherwise(any_))


def semantic_similarity(cue, content: Column) -> Column:
    """Jaccard of word sets, plus .3 if the cue stands in the content; at most 1."""
    cue = cue if isinstance(cue, Column) else F.lit(cue)
    inside = F.contains(F.lower(F.coalesce(content, F.lit(""))), F.lower(cue))
    return F.least(jaccard(words(cue), words(content)) + F.when(inside, 0.3).otherwise(0.0), F.lit(1.0))


def location_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return F.when(a.isNull() | b.isNull(), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.7).otherwise(0.0)


def word_similarity(a: Column, b: Column) -> Column:
    """Words of a equal to, in, or holding a word of b, against the longer list."""
    x, y = words(a), words(b)
    hit = F.size(F.filter(x, lambda w: F.exists(y, lambda v: (w == v) | F.contains(w, v) | F.contains(v, w))))
    n = F.greatest(F.size(x), F.size(y))
    return F.when(n == 0, 0.0).otherwise(hit / F.when(n == 0, 1).otherwise(n))


def analogy_parts(query: Column) -> Column:
    """struct<source, relation, target> split at the first " as ", " like " or " is "; null if there is none."""
    p = r"(?s)^(.*?) (as|like|is) (.*)$"
    return F.when(query.rlike(p), F.struct(*(F.regexp_extract(query, p, i + 1).alias(n) for i, n in enumerate(("source", "relation", "target")))))


def lexicon_lookup(queries: DataFrame, lexicon: DataFrame, term: str = "query", upper: bool = False) -> DataFrame:
    """queries joined with (term, variant, confidence) rows, by the lower- or upper-cased query."""
    key = (F.upper if upper else F.lower)(F.col(term))
    lex = lexicon.select((F.upper if upper else F.lower)("term").alias("_term"), "variant", "confidence")
    return queries.join(lex, key == F.col("_term")).drop("_term")


def composite_lookup(queries: DataFrame, lexicons: list[DataFrame], term: str = "query") -> DataFrame:
    """Of all lexicons, the best confidence for each variant."""
    found = None
    for lex in lexicons:
        own = lexicon_lookup(queries, lex, term)
        found = own if found is None else found.unionByName(own)
    return found.groupBy(term, "variant").agg(F.max("confidence").alias("confidence"))


def expand_query(queries: DataFrame, lexicons: list[DataFrame], term: str = "query", least: float = 0.3, most: int = 10) -> DataFrame:
    """The query itself (confidence 1) and its variants of confidence `least` or more, each text once, the best `most`."""
    own = queries.select(term, F.col(term).alias("variant"), F.lit(1.0).alias("confidence"))
    all_ = own.unionByName(composite_lookup(queries, lexicons, term)).where(F.col("confidence") >= least)
    once = all_.groupBy(term, "variant").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy(term).orderBy(F.desc("confidence"), "variant")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def idioms(queries: DataFrame, table: DataFrame, term: str = "query") -> DataFrame:
    return lexicon_lookup(queries, table.select("term", "variant", F.lit(0.9).alias("confidence")), term)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it stands in there: an expression that is named twice is run twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic vector: for dimension j, chunk c = j mod chunks of eight characters: (sum of its codes * (j + 1) mod 1000) / 1000; unit length."""

    def codes(t: Column) -> Column:
        chunks = F.greatest(F.ceil(F.char_length(t) / 8), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.aggregate(F.split(F.substring(t, c * 8 + 1, F.lit(8)), ""), F.lit(0).cast("long"), lambda s, x: s + F.ascii(x)))

    def raw(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: ((F.element_at(codes, (j % F.size(codes) + 1).cast("int")) * (j + 1)) % 1000) / 1000.0)

    def unit(raw: Column) -> Column:
        return _once(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 0, F.transform(raw, lambda x: x / n)).otherwise(raw))

    return _once(F.coalesce(text, F.lit("")), lambda t: _once(codes(t), lambda c: _once(raw(c), unit)))


def levenshtein_suggestion(word: Column, keywords: list[str], most: int = 2) -> Column:
    """The nearest keyword within `most` edits and that difference in length, else null."""
    near = F.array(*(F.struct(F.levenshtein(F.upper(word), F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in keywords))
    fit = F.filter(near, lambda s: (s["d"] <= most) & (F.abs(F.length(s["k"]) - F.length(word)) <= most))
    return F.when(F.size(fit) > 0, F.array_min(fit)["k"])


def tokenise(text: Column) -> Column:
    return words(text)


def weighted(a, wa, b, wb) -> Column:
    return _c(a) * wa + _c(b) * wb
