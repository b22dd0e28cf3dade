"""Quality rules as a short-circuit cascade.

Each rule is a cheap predicate over one text. A sample tells what a rule costs and what share of documents it rejects; the
rules then run in the order that rejects most per unit of cost, and a document stops at the first rule that rejects it. A
document is kept if no rule rejects it, so the order changes the cost alone, never a verdict.

Defined cases: a null text is an empty text (0 words, so it fails the word count); an empty table gives an empty table;
repeated rows are judged one by one and alike; other columns, whatever their names, pass through `keep_good` untouched.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, text_of
from .words import runs

#: Text that the sample brings to the driver at most, but for its last text.
SAMPLE_BYTES = 16_000_000
# What counts as white space and as a symbol.
SYMBOLS = b"#*$%&|<>"

METRICS = T.StructType([T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


class Text:
    """One text; each figure is worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "replace")
        self._words: list[bytes] | None = None
        self._repeat: int | None = None
        self._lines: tuple[int, int] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()  # for bytes: space, \t, \n, \v, \f, \r
        return self._words

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - t.count(" ") - t.count("\n") - t.count("\t") - t.count("\r") - t.count("\x0b") - t.count("\x0c")

    @property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @property
    def lines(self) -> tuple[int, int]:
        """Lines with a word; those of them equal to an earlier line."""
        if self._lines is None:
            own = [x for x in self.raw.split(b"\n") if x.split(None, 1)]
            self._lines = len(own), len(own) - len(set(own))
        return self._lines

    @property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur twice or more."""
        if self._repeat is None:
            w = self.words
            windows = list(zip(w, w[1:], w[2:], strict=False))
            seen = Counter(windows)
            n, upto = 0, 0
            if len(seen) < len(windows):
                for i, x in enumerate(windows):
                    if seen[x] > 1:
                        n += i + 3 - max(i, upto)
                        upto = i + 3
            self._repeat = n
        return self._repeat

    @property
    def alphabetic(self) -> int:
        return sum(any(c.isalpha() for c in w) for w in self.text.split())

    @property
    def upper(self) -> tuple[int, int]:
        """Capital letters, and letters that have a case."""
        up = sum(map(str.isupper, self.text))
        return up, up + sum(map(str.islower, self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def too_few_words(least: int = 50) -> Rule:
    return Rule("too_few_words", lambda t: t.n_words < least)


def repeats_itself(percent: int = 50) -> Rule:
    return Rule("repeats_itself", lambda t: 100 * t.n_repeat_words > percent * t.n_words)


def many_symbols(percent: int = 50) -> Rule:
    """Symbols in a hundred words."""
    return Rule("many_symbols", lambda t: 100 * t.n_symbols > percent * t.n_words)


def duplicate_lines(percent: int = 50) -> Rule:
    return Rule("duplicate_lines", lambda t: 100 * t.lines[1] > percent * t.lines[0])


def odd_word_length(least: int = 2, most: int = 20) -> Rule:
    return Rule("odd_word_length", lambda t: not least * t.n_words <= t.word_chars <= most * t.n_words)


def few_letters(percent: int = 60) -> Rule:
    """Words without any letter."""
    return Rule("few_letters", lambda t: 100 * t.alphabetic < percent * t.n_words)


def shouting(percent: int = 50) -> Rule:
    return Rule("shouting", lambda t: 100 * t.upper[0] > percent * t.upper[1])


def base_rules() -> list[Rule]:
    return [too_few_words(), repeats_itself()]


def production_rules() -> list[Rule]:
    return [*base_rules(), many_symbols(), duplicate_lines(), odd_word_length(), few_letters(), shouting()]


@dataclass
class Cascade:
    """Rules in the order in which they run, and what the sample said of each: seconds a text, share rejected."""

    rules: Sequence[Rule]
    figures: dict[str, tuple[float, float]] = field(default_factory=dict)

    def verdict(self, t: Text) -> str | None:
        """The first rule that rejects t, or None."""
        return next((r.name for r in self.rules if r.rejects(t)), None)

    def order(self) -> list[str]:
        return [r.name for r in self.rules]


def plan_cascade(texts: Sequence[str | None], rules: Sequence[Rule], clock: Callable[[], float] = time.perf_counter) -> Cascade:
    """Order rules by the share of texts that each rejects per second of its own cost. Ties keep the given order."""
    figures = {}
    for rule in rules:
        own, hit, began = [Text(x) for x in texts], 0, clock()
        for t in own:
            hit += rule.rejects(t)
        n = max(1, len(own))
        figures[rule.name] = (max(clock() - began, 1e-9) / n, hit / n)
    rank = sorted(range(len(rules)), key=lambda i: (-figures[rules[i].name][1] / figures[rules[i].name][0], figures[rules[i].name][0], i))
    return Cascade([rules[i] for i in rank], figures)


def fit_cascade(docs: DataFrame, rules: Callable[[], Sequence[Rule]] = production_rules, text: str = "text", sample: int = 256) -> list[str]:
    """The order of the rules' names, from a random sample of about `sample` texts (twice as many at most) over the whole table, of
    SAMPLE_BYTES at most. It decides the cost of a run only."""
    own = docs.select(F.col(text).alias("t"))
    share = min(1.0, sample / max(1, own.count()))
    texts, size = [], 0
    for r in (own.sample(False, share, seed=1) if share < 1 else own).limit(2 * sample).toLocalIterator():
        texts.append(r[0])
        size += len(r[0] or "")
        if size > SAMPLE_BYTES:
            break
    return plan_cascade(texts, rules()).order()


def _in_order(rules: Callable[[], Sequence[Rule]], order: Sequence[str]) -> Cascade:
    by = {r.name: r for r in rules()}
    return Cascade([by[n] for n in order])


def judge_udf(rules: Callable[[], Sequence[Rule]], order: Sequence[str], metrics: bool):
    """An Arrow UDF: rejected_by, and with metrics the five base figures too."""
    kind = T.StructType([T.StructField("rejected_by", T.StringType(), True), *(METRICS.fields if metrics else [])])

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cascade = _in_order(rules, order)
        kinds = [pa.string(), *[pa.int64()] * (len(kind) - 1)]
        for texts in batches:
            columns: list[list] = [[] for _ in kinds]
            for lo, hi in runs(texts):
                for x in texts.slice(lo, hi - lo).to_pylist():
                    t = Text(x)
                    row = (cascade.verdict(t),)
                    for c, v in zip(columns, (*row, t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words) if metrics else row, strict=True):
                        c.append(v)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=kind.names)

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judge, kind)


def judge(docs: DataFrame, rules: Callable[[], Sequence[Rule]] = production_rules, text: str = "text", metrics: bool = False, sample: int = 256, into: str = "quality") -> DataFrame:
    """docs with a struct column `into` (a free name is made if docs has it): rejected_by (null: kept) and, asked for, the base figures."""
    ship(docs.sparkSession)
    (into,) = fresh(docs, into)
    return docs.withColumn(into, judge_udf(rules, fit_cascade(docs, rules, text, sample), metrics)(text_of(text)))


def keep_good(docs: DataFrame, rules: Callable[[], Sequence[Rule]] = production_rules, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    own = docs.columns
    (into,) = fresh(docs, "quality")
    return judge(docs, rules, text, into=into).where(F.col(f"{into}.rejected_by").isNull()).select(*(F.col(f"`{c}`") for c in own))


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's digest of `judge` with the production rules."""
    q = judge(docs.select("doc_id", "text"), metrics=True).select("doc_id", "quality.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return q.select("doc_id", *METRICS.names, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


# What DuckDB can say of the digest: every rule of production_rules as SQL over whole texts.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha,
             len(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_up, len(regexp_replace(text, '[^\p{Lu}\p{Ll}]', '', 'g')) AS n_case,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_alpha < 60 * n_words OR 100 * n_up > 50 * n_case) AS kept
FROM m
"""
