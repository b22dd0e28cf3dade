"""Personal data by candidate gradient boosting, in DataFrame operations alone.

1. Generators. Patterns of high recall propose spans: the four base kinds whatever their check digits say, and looser shapes.
2. Boosted trees. Each candidate has format features (generator, digits, separators, first character) and context features (the
   characters beside it, telling words before it), all small integers. The corpus' candidates are counted by feature vector and
   weak label (does the value pass its kind's own check); that table, whose size is bounded by the number of feature vectors and
   not by the corpus, is what the driver boosts shallow regression trees on.
3. Calibration. The trees' margin is calibrated against the same counts; a span is selected where its calibrated probability
   reaches its threshold. Base spans that pass their check always stay.
The trees become one SQL expression, so that scoring too runs inside the JVM.

Positions are in code points. The text is cut at the matches by a private-use character that no pattern can match (such
characters in a text are first replaced, one for one). Patterns are possessive, so that they take time in proportion to the text;
positions, overlaps and the redacted text come from scans in blocks, so that a text of n matches takes n * STRIDE steps and not n * n.

Defined cases: a null text is an empty text without spans; equal rows are treated alike; a corpus without candidates selects
nothing; an empty table gives an empty table; other columns pass through `redact`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, text_of

KINDS = ("email", "ip", "card", "phone")
_CUT, _NOT_CUT = "", ""

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: (kind, needs: a cheap test that a text can match, pattern). The first four are the base patterns; after a match the next may
#: begin at once, which \G allows where a look-behind would not.
GENERATORS = (
    ("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", None, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", "at", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?[\[(]at[\])]\x20?{_LABEL}++(?:\x20?(?:\.|[\[(]dot[\])])\x20?{_LABEL}++)++"),
    ("ip", "[.]", r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])"),
    ("card", None, r"(?<![0-9])[0-9]{4}(?:[.\x20/-]{1,2}[0-9]{4}){3}(?![0-9])"),
    ("phone", None, r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
N_BASE = 4
#: Words before a span that speak for a kind.
CONTEXT = ("mail|contact|write to", "host|server|address|ip", "card|visa|credit|pay", "tel|phone|call|fax|mobile")

#: Elements that a scan takes together, and characters of a block of a text that is cut.
STRIDE, CHARS = 128, 4096
_FAR = 2**31 - 1

FEATURES = ("generator", "digits", "separators", "first", "before", "after", "told")
#: A candidate is selected from this calibrated probability on.
THRESHOLD = 0.95


def clean_text(text: str = "text") -> Column:
    return F.translate(text_of(text), _CUT, _NOT_CUT)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def passes(kind: Column, m: Column) -> Column:
    """Whether a value passes its kind's own check."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    d = _digits(m)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.regexp_replace(m, r"[\[\]]", "").rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
        .otherwise(F.length(d).between(9, 15))
    )


def _side(c: Column) -> Column:
    """A neighbouring character's class."""
    return F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^\p{L}$"), 3).otherwise(4)


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once, however often body names it (a lambda works out what it names from outside anew for
    each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(numbers: Column, of, none: int) -> Column:
    """For each element of an array of numbers what `of` (a function of an array) says of all elements before it; `none` before the first.
    In blocks of STRIDE, so that the work does not grow with the square of the array. `of` is associative: sum, greatest."""
    n = lambda x: F.size(x)
    return F.when(n(numbers) == 0, F.expr("CAST(array() AS ARRAY<INT>)")).otherwise(
        let(
            numbers,
            lambda x: let(
                F.transform(F.sequence(F.lit(0), F.floor((n(x) - 1) / STRIDE).cast("int")), lambda b: of(F.slice(x, b * STRIDE + 1, STRIDE))),
                lambda blocks: let(
                    F.transform(blocks, lambda _, b: F.when(b > 0, of(F.slice(blocks, F.lit(1), F.greatest(b, F.lit(1))))).otherwise(none)),
                    lambda past: F.transform(
                        x,
                        lambda _, i: F.when(
                            i % STRIDE > 0, of(F.array(F.element_at(past, F.floor(i / STRIDE).cast("int") + 1), of(F.slice(x, F.floor(i / STRIDE).cast("int") * STRIDE + 1, F.greatest(i % STRIDE, F.lit(1))))))
                        ).otherwise(F.element_at(past, F.floor(i / STRIDE).cast("int") + 1)),
                    ),
                ),
            ),
        )
    )


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _spans(t: Column, number: int) -> Column:
    """Candidates of one generator: an array of (generator, kind, start, end, base, weak, and the features)."""
    kind, needs, pattern = GENERATORS[number]

    def feature(m: Column, gap: Column, after: Column) -> list[Column]:
        told = F.lower(F.substring(gap, -24, 24))
        marks = F.lit(0)
        for i, words in enumerate(CONTEXT):
            marks = F.when(told.rlike(rf"\b(?:{words})\b"), i + 1).otherwise(marks)
        return [
            F.lit(number).alias("generator"),
            F.least(F.length(_digits(m)), F.lit(20)).alias("digits"),
            F.least(F.length(F.regexp_replace(m, r"[0-9A-Za-z]", "")), F.lit(8)).alias("separators"),
            F.when(m.rlike("^[0-9]"), F.substring(m, 1, 1).cast("int")).when(m.rlike("^[A-Za-z]"), 10).otherwise(11).alias("first"),
            _side(F.substring(gap, -1, 1)).alias("before"),
            _side(after).alias("after"),
            marks.alias("told"),
        ]

    def one(r: Column) -> Column:
        ok = passes(F.lit(kind), r["m"])
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), r["start"].alias("start"), (r["start"] + F.char_length(r["m"])).alias("end"), (ok & F.lit(number < N_BASE)).alias("base"),
            ok.cast("int").alias("weak"), *feature(r["m"], r["gap"], r["next"]),
        )

    def all_of(cut: Column) -> Column:
        placed = F.zip_with(cut, before_each(F.transform(cut, F.char_length), total, 0), lambda p, s: F.struct(p.alias("p"), s.alias("s")))
        found, gaps = F.filter(placed, lambda _, i: i % 2 == 1), F.filter(placed, lambda _, i: i % 2 == 0)
        n = F.floor(F.size(cut) / 2).cast("int")
        rows = F.zip_with(found, F.slice(gaps, F.lit(1), n), lambda m, g: F.struct(m["p"].alias("m"), m["s"].alias("start"), g["p"].alias("gap")))
        rows = F.zip_with(rows, F.slice(gaps, F.lit(2), n), lambda r, g: F.struct(r["m"].alias("m"), r["start"].alias("start"), r["gap"].alias("gap"), F.substring(g["p"], 1, 1).alias("next")))
        return F.transform(rows, one)

    out = let(F.split(F.regexp_replace(t, f"({pattern})", f"{_CUT}$1{_CUT}"), _CUT, -1), all_of)
    empty = F.expr(f"CAST(array() AS ARRAY<STRUCT<{_SPAN}>>)")
    may = t.rlike(pattern) if needs is None else F.contains(t, F.lit(needs)) & t.rlike(pattern)
    return F.when(may, out).otherwise(empty)


_SPAN = "kind: INT, start: INT, end: INT, base: BOOLEAN, weak: INT, generator: INT, digits: INT, separators: INT, first: INT, before: INT, after: INT, told: INT"


def with_candidates(docs: DataFrame, text: str = "text", into: str = "candidates") -> DataFrame:
    """docs with the array of all candidates of the whole text. Texts without a digit or an at sign skip all generators."""
    (t,) = fresh(docs, "clean")
    marked = docs.withColumn(t, clean_text(text))
    none = F.expr(f"CAST(array() AS ARRAY<STRUCT<{_SPAN}>>)")
    found = F.concat(*(_spans(F.col(t), i) for i in range(len(GENERATORS))))
    return marked.withColumn(into, F.when(F.col(t).rlike(r"[0-9]|@|[\[(]at[\])]"), found).otherwise(none)).drop(t)


# The boosted trees: depth two, on counted feature vectors ------------------------------------------------------------


@dataclass
class Trees:
    """Margin: prior + sum of leaves. A tree is (feature, cut, left, right): left if the feature is at most cut."""

    prior: float
    trees: list[tuple]
    scale: tuple[float, float]  # calibration: p = 1 / (1 + exp(-(a * margin + b)))

    def expression(self, of) -> Column:
        """The calibrated probability as a column; `of` gives a feature's column."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, cut, left, right = node
            return F.when(of(feature) <= cut, walk(left)).otherwise(walk(right))

        margin = F.lit(self.prior)
        for tree in self.trees:
            margin = margin + walk(tree)
        a, b = self.scale
        return 1 / (1 + F.exp(-(margin * a + b)))

    def margin(self, x: dict[str, int]) -> float:
        def walk(node):
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            return node

        return self.prior + sum(map(walk, self.trees))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def boost(table: list[tuple[dict[str, int], float, float]], rounds: int = 12, depth: int = 2, rate: float = 0.4, ridge: float = 4.0) -> Trees:
    """Gradient boosting for log loss on (features, passing count, failing count) rows, with Newton leaves; then Platt scaling."""
    good, bad = sum(r[1] for r in table), sum(r[2] for r in table)
    model = Trees(math.log((good + 1) / (bad + 1)), [], (1.0, 0.0))
    if not table:
        return Trees(-10.0, [], (1.0, 0.0))
    margins = [model.prior] * len(table)

    def leaf(rows: list[int], g: list[float], h: list[float]) -> float:
        return rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)

    def grow(rows: list[int], left: int, g: list[float], h: list[float]):
        best = None
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for f in FEATURES if left else ():
            by: dict[int, list[float]] = {}
            for i in rows:
                own = by.setdefault(table[i][0][f], [0.0, 0.0])
                own[0] += g[i]
                own[1] += h[i]
            a = b = 0.0
            for cut in sorted(by)[:-1]:
                a, b = a + by[cut][0], b + by[cut][1]
                gain = a * a / (b + ridge) + (G - a) ** 2 / (H - b + ridge) - G * G / (H + ridge)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cut)
        if best is None:
            return leaf(rows, g, h)
        _, f, cut = best
        low = [i for i in rows if table[i][0][f] <= cut]
        return (f, cut, grow(low, left - 1, g, h), grow([i for i in rows if table[i][0][f] > cut], left - 1, g, h))

    for _ in range(rounds):
        p = [_sigmoid(m) for m in margins]
        g = [r[1] * (1 - q) - r[2] * q for r, q in zip(table, p, strict=True)]
        h = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(table, p, strict=True)]
        tree = grow(list(range(len(table))), depth, g, h)
        model.trees.append(tree)
        step = Trees(0.0, [tree], (1.0, 0.0))
        margins = [m + step.margin(r[0]) for m, r in zip(margins, table, strict=True)]
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling with one pseudo-count on either side
        ga = gb = haa = hab = hbb = 0.0
        for m, r in zip(margins, table, strict=True):
            n, q = r[1] + r[2], _sigmoid(a * m + b)
            target = (r[1] + n / (good + bad + 2)) / (n + 2 * n / (good + bad + 2))
            d, w = n * (q - target), n * q * (1 - q)
            ga, gb, haa, hab, hbb = ga + d * m, gb + d, haa + w * m * m, hab + w * m, hbb + w
        haa, hbb = haa + 1, hbb + 1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-1, min(1, da)), b - max(-1, min(1, db))
    model.scale = (max(a, 0.0), b)
    return model


def fit(candidates: DataFrame, column: str = "candidates") -> Trees:
    """Boost on all candidates of the corpus, counted by feature vector: the table that comes to the driver has at most
    generators x 21 digit counts x 9 separator counts x 12 x 5 x 5 x 5 rows, however large the corpus."""
    rows = candidates.select(F.explode(column).alias("c")).groupBy(*(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(F.sum("c.weak").alias("good"), F.count(F.lit(1)).alias("n"))
    table = [({f: r[f] for f in FEATURES}, float(r["good"]), float(r["n"] - r["good"])) for r in rows.collect()]
    return boost(sorted(table, key=lambda x: tuple(x[0].values())))


def selected(model: Trees, candidates: Column, threshold: float = THRESHOLD) -> Column:
    """Base spans, and candidates whose probability reaches the threshold and that overlap no base span of their kind."""
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    chosen = F.filter(candidates, lambda c: c["base"] | (model.expression(lambda f: c[f]) >= threshold))

    def free(own: Column) -> Column:
        """Of one kind's spans in the order of their starts: those that are base, or that no base span reaches into from either side."""
        until = before_each(F.transform(own, lambda c: F.when(c["base"], c["end"]).otherwise(-1)), F.array_max, -1)
        back = F.transform(F.reverse(own), lambda c: F.when(c["base"], -c["start"]).otherwise(-_FAR))
        since = F.reverse(F.transform(before_each(back, F.array_max, -_FAR), lambda x: -x))
        marked = F.zip_with(F.zip_with(own, until, lambda c, u: F.struct(c.alias("c"), u.alias("u"))), since, lambda r, v: F.struct(r["c"].alias("c"), r["u"].alias("u"), v.alias("v")))
        return F.transform(F.filter(marked, lambda r: r["c"]["base"] | ((r["u"] <= r["c"]["start"]) & (r["v"] >= r["c"]["end"]))), lambda r: place(r["c"]))

    def of_kind(found: Column, kind: int) -> Column:
        rows = F.filter(found, lambda c: c["kind"] == kind)
        # Of spans that start together, extras stand before base ones and are reached by them from behind.
        ordered = F.array_sort(F.transform(rows, lambda c: F.struct(c["start"].alias("start"), c["base"].alias("base"), c["end"].alias("end"), c["kind"].alias("kind"))))
        return F.when(F.size(rows) > 0, let(ordered, free)).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<kind: INT, start: INT, end: INT>>)"))

    return let(chosen, lambda found: F.array_sort(F.array_distinct(F.concat(*(of_kind(found, k) for k in range(len(KINDS)))))))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text that is cut into blocks of CHARS."""
    first, last = F.floor(start / CHARS).cast("int"), F.floor(end / CHARS).cast("int")
    at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    several = F.concat(F.substring(at(first), start % CHARS + 1, F.lit(CHARS)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), end % CHARS))
    return F.when(first == last, F.substring(at(first), start % CHARS + 1, end - start)).otherwise(several)


def replaced(text: Column, spans: Column) -> Column:
    """text with each span (kind, start, end) replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def written(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda x: x["end"])
        rows = F.zip_with(ordered, before_each(ends, F.array_max, 0), lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at"), F.lit(False).alias("last")))
        return let(
            F.when(F.char_length(text) <= CHARS, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))),
            lambda blocks: F.concat(
                F.array_join(F.transform(F.filter(rows, lambda r: r["start"] >= r["at"]), lambda r: F.concat(_piece(blocks, r["at"], r["start"]), F.element_at(names, r["kind"] + 1))), ""),
                _piece(blocks, F.array_max(ends), F.char_length(text)),
            ),
        )

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return let(ordered, lambda o: F.when(F.size(o) > 0, written(o)).otherwise(text))


def redact(docs: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """docs with each selected span replaced by its kind in angle brackets; overlapping spans become one, named by the first.
    A null text stays null. Candidates are found once and written beside the documents, the model is fitted on them and applied."""
    own = docs.columns
    (c,) = fresh(docs, "candidates")
    found = with_candidates(docs, text, c)
    if model is None:
        found = keep(found)
        model = fit(found, c)
    t = F.col(f"`{text}`")
    out = F.when(F.size(c) > 0, replaced(t, selected(model, F.col(c)))).otherwise(t)
    return found.withColumn(text, out).select(*(F.col(f"`{x}`") for x in own))


def op5_pii(docs: DataFrame) -> DataFrame:
    """The contract's digest: one pass finds the candidates, which alone are kept; the model is fitted and applied on them."""
    found = keep(with_candidates(docs.select("doc_id", "text")).select("doc_id", "candidates"))
    model = fit(found)
    base = F.transform(F.filter("candidates", lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", F.array_sort(base).alias("base"), selected(model, F.col("candidates")).alias("all")).select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
    )
