"""The query language: what it takes, what it refuses and why."""

from datetime import datetime

import pytest

from recollect.plans import language as L
from recollect.plans.engine import Memory, execute

VALID = [
    ("RECALL ep_1", L.Recall(L.NodeId("ep_1"))),
    ("recall [0.1, -2, 3e-1] threshold 0.7", L.Recall(L.Vector((0.1, -2.0, 0.3), 0.7))),
    ('RECALL "a \\"b\\" c" CONFIDENCE > 0.5', L.Recall(L.Content('a "b" c'), confidence=L.Threshold(">", 0.5))),
    ("RECALL ANY WHERE confidence > 0.2 CONFIDENCE < 0.9", L.Recall(L.AnyPattern(), (L.Constraint("confidence", ">", 0.2),), L.Threshold("<", 0.9))),
    ("RECALL a WHERE confidence > 0.2 confidence < 0.9", L.Recall(L.NodeId("a"), (L.Constraint("confidence", ">", 0.2),), L.Threshold("<", 0.9))),
    ('RECALL a WHERE content CONTAINS "x" created BEFORE "2024-01-02T03:04:05Z" LIMIT 5', L.Recall(L.NodeId("a"), (L.Constraint("content", "contains", "x"), L.Constraint("created", "before", datetime(2024, 1, 2, 3, 4, 5))), limit=5)),
    ("SPREAD FROM n DECAY 0.2 MAX_HOPS 4 # on\n THRESHOLD 0.05", L.Spread("n", 4, 0.2, 0.05)),
    ("PREDICT a GIVEN b, c HORIZON 3600", L.Predict(L.NodeId("a"), ("b", "c"), 3600.0)),
    ("IMAGINE a BASED ON b, c NOVELTY 0.3", L.Imagine(L.NodeId("a"), ("b", "c"), 0.3)),
    ("CONSOLIDATE a INTO b", L.Consolidate("b", L.NodeId("a"))),
    ("CONSOLIDATE WHERE created AFTER 86400 INTO b", L.Consolidate("b", None, (L.Constraint("created", "after", datetime(1970, 1, 2)),))),
]
INVALID = [
    ("", L.SyntaxQueryError, "empty", None), ("RECAL a", L.SyntaxQueryError, "begins with", "RECALL"), ("SPRED FROM a", L.SyntaxQueryError, "begins with", "SPREAD"), ("RECALL", L.SyntaxQueryError, "pattern", None),
    ("RECALL a WHER confidence > 1", L.SyntaxQueryError, "unexpected", "WHERE"), ("RECALL a CONFIDENCE > 1.5", L.ValidationError, "[0, 1]", None), ("SPREAD FROM a MAX_HOPS 0", L.ValidationError, "MAX_HOPS", None), ("SPREAD FROM a MAX_HOPS 1.5", L.ValidationError, "whole", None),
    ("SPREAD FROM a DECAY 0.1 DECAY 0.2", L.SyntaxQueryError, "twice", None), ('RECALL "open', L.TokenizeError, "unterminated", None), ("RECALL a ; b", L.TokenizeError, "unexpected character", None), ("RECALL [0, 0]", L.ValidationError, "zeros", None),
    ("RECALL a WHERE mood > 1", L.SyntaxQueryError, "unknown field", None), ('RECALL a WHERE created BEFORE "soon"', L.ValidationError, "ISO 8601", None), ("PREDICT a", L.SyntaxQueryError, "GIVEN", None), ("CONSOLIDATE a", L.SyntaxQueryError, "INTO", None), (f"RECALL {'x' * 300}", L.ValidationError, "256", None),
]


@pytest.mark.parametrize("text,tree", VALID)
def test_valid(text, tree):
    assert L.parse(text) == tree


@pytest.mark.parametrize("text,kind,says,suggests", INVALID)
def test_invalid(text, kind, says, suggests):
    with pytest.raises(kind) as e:
        L.parse(text)
    assert says in str(e.value) and e.value.suggestion == suggests


def test_position_dimension_and_cost():
    with pytest.raises(L.QueryError) as e:
        L.parse("RECALL a\n  CONFIDENCE > 7")
    assert (e.value.line, e.value.column) == (2, 16)
    with pytest.raises(L.ValidationError):
        L.parse("RECALL [1, 2]", dimension=3)
    assert L.admit(L.parse("SPREAD FROM a MAX_HOPS 6")).cost() == 64_000
    with pytest.raises(L.CostError):
        L.admit(L.parse("SPREAD FROM a MAX_HOPS 7"))
    assert L.closest_keyword("confidance") == "CONFIDENCE" and L.closest_keyword("banana") is None


@pytest.fixture(scope="module")
def memory(spark):
    rows = [("a", [1.0, 0.0], 0.9, "red fox"), ("b", [0.9, 0.1], 0.6, "red hen"), ("c", [0.0, 1.0], 0.8, "blue jay"), ("d", [0.95, 0.05], 0.3, "RED ant")]
    m = spark.createDataFrame(rows, "id string, embedding array<double>, confidence double, what string")
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.9)], "src string, dst string, weight double")
    p = spark.createDataFrame([("p1", 0.8, 3, ["a", "b"]), ("p2", 0.6, 4, ["c"])], "cluster string, strength double, n long, source_episodes array<string>")
    return Memory(m, e, p)


def ids(result):
    return sorted(r["id"] for r in result.episodes.collect())


def test_verbs(memory):
    assert ids(execute("RECALL [1, 0] THRESHOLD 0.9 CONFIDENCE > 0.5", memory)) == ["a", "b"]
    assert ids(execute('RECALL "red" LIMIT 2', memory)) == ["a", "b"]
    assert ids(execute('RECALL ANY WHERE content SIMILAR TO [0, 1] THRESHOLD 0.5', memory)) == ["c"]
    spread = execute("SPREAD FROM a MAX_HOPS 2 DECAY 0.5034", memory).episodes.collect()
    assert sorted((r["id"], round(r["activation"], 3)) for r in spread) == [("b", 0.447), ("c", 0.099)]
    assert execute("IMAGINE [1, 0] THRESHOLD 0.5", memory).episodes.first()["confidence"] > 0.2
    assert ids(execute("CONSOLIDATE ANY INTO p1", memory)) == ["p1:p1"]
    with pytest.raises(NotImplementedError):
        execute("PREDICT a GIVEN b", memory)
