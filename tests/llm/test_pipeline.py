"""The pipeline stage by stage against plain versions, and whole."""

import re

import numpy as np
import pytest

import corpus_pipeline
from recollect.llm import near, pii, quality
from recollect.llm.registry import oracle_sql, queries

from .test_corpus import ODD, near_rows

WS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in near_rows()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = dict(near_rows())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i == 4:
            got = out.collect()
            assert {r["doc_id"] for r in got} == set(left)
            break
        assert out.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if i == 0:
            plan = quality.Cascade(quality.production_rules())
            left = {k: t for k, t in left.items() if plan.verdict(quality.Text(t)) is None}
        elif i == 1:
            first = {}
            for k in sorted(left):
                first.setdefault(WS.sub(" ", left[k]), k)
            left = {k: left[k] for k in first.values()}
        elif i == 2:
            h = {k: near.word_hashes(t.encode().split()).astype(np.uint32).astype(np.int64) for k, t in left.items()}
            up = {k: k for k in h}

            def top(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a in sorted(h):
                for b in sorted(h):
                    if a < b and near.similar(h[a], h[b]):
                        x, y = sorted((top(a), top(b)))
                        up[y] = x
            left = {k: t for k, t in left.items() if top(k) == k}
        assert got == left, name
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_run_is_whole(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "MinHash near-dedup", "PII", "best-fit packing"]


def test_registry():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries()}) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    assert ODD and pii.KINDS == ("email", "ip", "card", "phone")
