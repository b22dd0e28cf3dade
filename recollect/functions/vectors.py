"""Vector arithmetic on array columns. Sums run in double precision."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .confidence import _c


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either vector is zero. Norms worked out before can be given."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def scale(a: Column, factor) -> Column:
    return F.transform(a, lambda x: x.cast("double") * _c(factor))


def normalise(a: Column) -> Column:
    """Null for the zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def euclidean(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def masked_cosine(partial: Column, full: Column) -> Column:
    """Over the dimensions that partial knows."""
    own = F.zip_with(partial, full, lambda p, f: F.when(p.isNotNull(), f.cast("double")).otherwise(0.0))
    known = F.transform(partial, lambda p: F.coalesce(p.cast("double"), F.lit(0.0)))
    return cosine(known, own)


def analogy(target: Column, source1: Column, source2: Column) -> Column:
    return normalise(add(target, subtract(source2, source1)))


def sigmoid_activation(similarity, threshold=0.4, temperature: float = 0.5) -> Column:
    t = min(2.0, max(0.05, temperature))
    return 1 / (1 + F.exp(-(_c(similarity) - _c(threshold)) / t))


def fan_activation(similarity, fan, threshold=0.4, temperature: float = 0.5) -> Column:
    return sigmoid_activation(similarity, threshold, temperature) / F.sqrt(F.greatest(_c(fan), F.lit(1.0)))


def neural_similarity(cos, hours_apart) -> Column:
    return 1 / (1 + F.exp(-10 * (_c(cos) * F.exp(-_c(hours_apart) / 24) - 0.5)))


def softmax(x: Column, window) -> Column:
    e = F.exp(x - F.max(x).over(window))
    return e / F.sum(e).over(window)


def projections(dim: int, bits: int = 32) -> list[list[float]]:
    """Hyperplanes by a rule: plane i, dimension j is cos((i + 1) * (j + 1))."""
    return [[math.cos((i + 1) * (j + 1)) for j in range(dim)] for i in range(bits)]


def lsh_bucket(a: Column, dim: int, bits: int = 32) -> Column:
    """Sign bits against the hyperplanes, as a number."""
    out = F.lit(0).cast("long")
    for i, plane in enumerate(projections(dim, bits)):
        out = out + F.when(dot(a, literal(plane)) >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def quantise(a: Column) -> Column:
    """Bytes: round((clamped x + 1) * 127.5)."""
    return F.transform(a, lambda x: F.round((F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) + 1) * 127.5).cast("int"))


def content_hash(a: Column) -> Column:
    return F.sha2(F.array_join(F.transform(quantise(a), lambda x: x.cast("string")), ","), 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grid_code(x, y, scales=(0.3, 0.5, 0.7, 1.0)) -> Column:
    """A grid cell's activation at (x, y) for each scale: the mean of three plane waves 60 degrees apart, in [0, 1]."""

    def at(scale: float) -> Column:
        k = 4 * math.pi / (math.sqrt(3) * scale)
        waves = [F.cos(k * (_c(x) * math.cos(a) + _c(y) * math.sin(a))) for a in (0.0, math.pi / 3, 2 * math.pi / 3)]
        return F.greatest((waves[0] + waves[1] + waves[2]) / 3, F.lit(0.0))

    return F.array(*(at(s) for s in scales))


def mean_vector(df, keys: list[str], vector: str = "embedding", weight: Column | None = None, into: str = "centroid"):
    """Element-wise (weighted) mean by keys: partial sums by position, then put together."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(into))


def kahan_sum(a: Column) -> Column:
    """The sum of an array of doubles, with what each addition loses carried on."""

    def step(s: Column, x: Column) -> Column:
        y = x.cast("double") - s["lost"]
        t = s["sum"] + y
        return F.struct(t.alias("sum"), ((t - s["sum"]) - y).alias("lost"))

    return F.aggregate(a, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost")), step, lambda s: s["sum"])


def matrix(series) -> np.ndarray:
    """A pandas column of vectors as rows of doubles."""
    return np.stack([np.asarray(v, np.float64) for v in series]) if len(series) else np.zeros((0, 1))
