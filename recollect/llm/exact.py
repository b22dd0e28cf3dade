"""Exact de-duplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters. All distinct blocks of the corpus are sorted and named
by integers; then adjacent names are paired, distinct pairs are sorted and named, and so on until each document has one name.
Two documents have the same name exactly if their normalised texts are the same: no step relies on a hash being free of
collisions. Names travel to their blocks along a 64-bit key, and every round counts that no two distinct blocks share a key
(else the round is done again with another seed), so that the key is a one-to-one stand-in for the block.

Everything is DataFrame operations. A key held by a third of all rows costs nothing: blocks and pairs are reduced to distinct
ones before the shuffle, and names come back by joins of written tables, whose hot partitions Spark can split.

Defined cases: null text equals empty text; of the rows of a group the one of the smallest doc_id is kept (a null doc_id after all
others), and of several such rows any one, as they are alike in doc_id and text but for white space; an empty table gives an empty
table; other columns pass through `keep_first`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, only, text_of

BLOCK = 4096


def normalised(text: str = "text") -> Column:
    """White space (space, \\t, \\n, \\v, \\f, \\r) runs become one space."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def blocks_of(text: Column, size: int) -> Column:
    """The text in pieces of `size` characters; an empty text is one empty piece."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(cut)


def named(values: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows of `by` with an integer each: equal ones meet in one partition, which is sorted and numbered on from
    an offset of its own. Copies go before the shuffle (map-side), and one shuffle does for both steps."""
    distinct = values.select(*by).distinct()
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int, seed: int) -> tuple[DataFrame, int]:
    """(key, name) of the distinct blocks, and the seed whose keys are one-to-one."""
    while True:
        blocks = texts.select(F.explode(blocks_of(F.col("t"), size)).alias("block"))
        names = keep(named(blocks, ["block"]).select(F.xxhash64(F.lit(seed), "block").alias("key"), "name"))
        if names.groupBy("key").count().where("count > 1").isEmpty():
            return names, seed
        seed += 1


def identities(docs: DataFrame, text: str = "text", block: int = BLOCK, seed: int = 1) -> DataFrame:
    """row (a number made here), doc_id, raw (xxhash64 of the text as it is), sha (of the normalised text), depth, name for each row of
    docs, where docs has a doc_id. Names of different depths stand for texts of different block counts: depth and name together are
    the identity of the normalised text."""
    texts = docs.select("doc_id", F.xxhash64(text_of(text)).alias("raw"), normalised(text).alias("t"))
    names, seed = _block_names(texts, block, seed)
    sha = F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha")
    keys = F.transform(blocks_of(F.col("t"), block), lambda b: F.xxhash64(F.lit(seed), b)).alias("keys")
    rows = keep(texts.select("doc_id", "raw", sha, keys).withColumn("row", F.monotonically_increasing_id()))
    parts = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    level = keep(parts.join(names, "key").select("row", "n", "pos", "name"))
    depth, levels = 0, [level]
    done = level.where("n = 1").select("row", F.lit(0).alias("depth"), "name")
    level = level.where("n > 1")
    while not level.isEmpty():
        depth += 1
        left, right = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = level.groupBy("row", "n", F.expr("pos div 2").alias("pos")).agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        pairs = keep(pairs.select("row", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "a", "b"))
        again = keep(named(pairs, ["a", "b"]))
        levels.append(keep(pairs.join(again, ["a", "b"]).select("row", "n", "pos", "name")))
        forget(pairs, again)
        level = levels[-1]
        done = done.unionByName(level.where("n = 1").select("row", F.lit(depth).alias("depth"), "name"))
        level = level.where("n > 1")
    out = keep(rows.select("row", "doc_id", "raw", "sha").join(done, "row"))
    forget(names, rows, *levels)
    return out


def judged(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, raw, keep_id, group_size, kept, text_sha256."""
    rows = identities(docs, text, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    # Written, so that the join has a scan on either side and Spark can split a hot name.
    sizes = keep(rows.groupBy("depth", "name").agg(first, F.count(F.lit(1)).alias("group_size")))
    out = rows.join(sizes, ["depth", "name"])
    return out.select("doc_id", "raw", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def groups(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return judged(docs, text, block).drop("raw")


def keep_first(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of equal texts, with its own columns: that of the smallest doc_id."""
    return only(docs, judged(docs.select("doc_id", F.col(text).alias("text")), "text", block), text)


def op10_exact_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest: `groups` as it is."""
    return groups(docs)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
