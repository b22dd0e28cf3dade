"""Toxicity by weak supervision.

1. Voters. From labelled training rows: a lexicon voter for each word, and each word start of four or five letters, that stands
   (almost) only in toxic texts; pattern voters over the form of a text; a voter for clean that speaks where no lexicon voter does.
2. Label model. A generative model of the votes given a hidden label: EM estimates the class share and each voter's rates of
   voting per label, starting from the labels, which stay in as a voter of known accuracy; correlations of voters given the label are estimated from the posteriors, and a
   voter counts less the more it says what others say.
3. Classifier. A logistic regression is trained on the posteriors, and scores every whole text by its own features.

The fit takes at most MAX_TRAIN labelled rows of MAX_TRAIN_CHARS characters (documented bounds; the ones whose hashed doc_id comes
first); scoring reads all.

Defined cases: a null text is an empty text and gets the score of a text without any sign; labels that are null or not 0 or 1 are
left out of the fit; of rows that share a doc_id one text is fitted on; only doc_id, text and toxic are read, whatever other columns
there are; without any toxic row to learn from all scores are the (smoothed) share of toxic rows; equal texts score alike;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, text_of
from .words import runs

#: The fit takes so many labelled rows and so many characters of them at most.
MAX_TRAIN, MAX_TRAIN_CHARS = 8000, 64_000_000
#: A size of the model: so many signs have a voter of their own at most, those that stand in the most toxic texts.
MAX_LEXICON = 400
#: How often a training label is taken to be right.
LABEL_ACCURACY = 0.95
_WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5)


def signs(text: str) -> set[str]:
    """Words (lower case) of a text, and their starts, marked by a trailing hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in STARTS))


# Pattern voters: the form of a text, whatever its words.
def _form(text: str) -> dict[str, bool]:
    n = max(1, len(text))
    return {
        "exclaims": text.count("!") * 200 > n,
        "shouts": 2 * sum(map(str.isupper, text)) > n,
        "symbols": 5 * sum(map(text.count, "#*$%&@")) > n,
        "stretched": re.search(r"([^\W\d_])\1{3}", text) is not None,
    }


PATTERNS = ("exclaims", "shouts", "symbols", "stretched")


def mine_lexicon(texts: Sequence[set[str]], toxic: Sequence[int], most: int = MAX_LEXICON, precision: float = 0.95) -> list[str]:
    """Signs that stand in toxic texts and hardly in others; the more toxic texts a sign adds, the earlier it comes."""
    bad, good, n_bad = Counter(), Counter(), sum(toxic)
    for own, y in zip(texts, toxic, strict=True):
        (bad if y else good).update(own)
    least = max(4, n_bad // 50)  # a sign that stands in fewer toxic texts may do so by chance
    found = [(c, s) for s, c in bad.items() if c >= least and c >= precision * (c + good[s])]
    return [s for _, s in sorted(found, key=lambda x: (-x[0], x[1]))[:most]]


@dataclass
class LabelModel:
    """P(label), P(voter speaks and says toxic | label) ..., fitted by EM; weights discount correlated voters."""

    share: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # [voter, label]: P(the voter fires | label)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def posterior(self, fires: np.ndarray, said: np.ndarray | float = 0.0) -> np.ndarray:
        """P(toxic | votes) for rows of 0/1: voters that do not fire speak too, as evidence of absence. said: log odds of another, better
        known voter, as the rows' own labels are."""
        if not self.rates.size:
            return 1 / (1 + np.exp(-(math.log(self.share / (1 - self.share)) + np.zeros(len(fires)) + said)))
        on = np.log(self.rates[:, 1] / self.rates[:, 0]) * self.weights
        off = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0])) * self.weights
        z = math.log(self.share / (1 - self.share)) + fires @ on + (1 - fires) @ off + said
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def accuracy(self) -> np.ndarray:
        """P(toxic | the voter alone fires)."""
        p = self.rates * np.array([1 - self.share, self.share])
        return p[:, 1] / p.sum(axis=1)


def fit_label_model(fires: np.ndarray, first: np.ndarray, rounds: int = 20, said: np.ndarray | float = 0.0) -> LabelModel:
    """EM from the posteriors `first`. fires: rows by voters, 0 or 1; said: as in LabelModel.posterior."""
    n, m = fires.shape
    model, p = LabelModel(), first.astype(float)
    model.weights = np.ones(m)
    for _ in range(rounds):
        w = np.stack([1 - p, p])
        model.share = float(np.clip(p.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        model.rates = ((w @ fires + 0.05) / (w.sum(axis=1, keepdims=True) + 0.1)).T.clip(1e-5, 1 - 1e-5)
        if m:
            # Correlations of voters given the label: of what is left of the votes after their expectation.
            rest = fires - (w.T @ model.rates.T)
            cov = rest.T @ rest / max(1, n)
            sd = np.sqrt(np.diag(cov)).clip(1e-9)
            model.correlations = cov / np.outer(sd, sd)
            own = np.where(np.abs(model.correlations) > 0.2, np.abs(model.correlations), 0)
            model.weights = 1 / own.sum(axis=1).clip(1)
        new = model.posterior(fires, said)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


def fit_logistic(x: np.ndarray, p: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps on soft labels p."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (q - p) / max(1, len(x)) + penalty * w
        h = (x.T * (q * (1 - q))) @ x / max(1, len(x)) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Toxicity:
    lexicon: list[str]
    model: LabelModel
    weights: np.ndarray

    def features(self, own: set[str], form: dict[str, bool]) -> list[float]:
        hits = [s for s in own if s in self._known]
        kinds = sum(1 for s in hits if not s.endswith("-")), sum(1 for s in hits if s.endswith("-"))
        return [float(bool(hits)), math.log1p(kinds[0]), math.log1p(kinds[1]), max((self._sure[s] for s in hits), default=0.0), *(float(form[k]) for k in PATTERNS)]

    def __post_init__(self):
        self._known = set(self.lexicon)
        sure = self.model.accuracy() if len(self.model.rates) else ()
        self._sure = dict(zip(self.lexicon, map(float, sure), strict=False))

    def score(self, text: str | None) -> float:
        text = text or ""
        x = self.features(signs(text) & self._known, _form(text))
        z = sum(a * b for a, b in zip(x, self.weights, strict=False)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: Sequence[tuple[str | None, int]]) -> Toxicity:
    """Fit on (text, label) rows."""
    texts, toxic = [t or "" for t, _ in rows], np.array([int(y) for _, y in rows], float)
    own, forms = [signs(t) for t in texts], [_form(t) for t in texts]
    lexicon = mine_lexicon(own, toxic.astype(int).tolist())
    fires = np.zeros((len(rows), len(lexicon) + len(PATTERNS) + 1))
    at = {s: i for i, s in enumerate(lexicon)}
    for i, (o, f) in enumerate(zip(own, forms, strict=True)):
        hits = [at[s] for s in o if s in at]
        fires[i, hits] = 1
        fires[i, len(lexicon) : -1] = [f[k] for k in PATTERNS]
        fires[i, -1] = not hits
    # The labels themselves are a voter of known accuracy: without it, EM may settle on another pair of classes than the labels'.
    said = (2 * toxic - 1) * math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    model = fit_label_model(fires, (toxic * len(rows) + 0.5) / (len(rows) + 1) if len(rows) else toxic, said=said)
    out = Toxicity(lexicon, model, np.zeros(len(PATTERNS) + 5))
    share = (toxic.sum() + 0.5) / (len(rows) + 1)
    out.weights[-1] = math.log(share / (1 - share))
    if len(rows) and 0 < toxic.sum() < len(rows):
        x = np.array([out.features(o & out._known, f) for o, f in zip(own, forms, strict=True)])
        out.weights = fit_logistic(x, model.posterior(fires, said))
    return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_chars: int = MAX_TRAIN_CHARS) -> list[tuple[str | None, int]]:
    """At most `most` labelled rows that are not held out, of `most_chars` characters together; which ones is told by doc_id alone. Of
    rows that share a doc_id one text is taken, the least, and the larger label."""
    wanted = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    wanted = wanted.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    own = docs.select(F.col("doc_id").alias("own_id"), F.col("text").alias("t"))
    rows = own.join(F.broadcast(wanted), F.col("own_id") == F.col("id")).groupBy("id", "y").agg(F.min("t").alias("t"))
    so_far = F.sum(F.length(F.coalesce("t", F.lit("")))).over(Window.orderBy(F.xxhash64("id"), "id"))  # over `most` rows
    rows = rows.withColumn("chars", so_far).where(F.col("chars") <= most_chars)
    return [(r["t"], r["y"]) for r in sorted(rows.toLocalIterator(), key=lambda r: r["id"])]


def score_documents(docs: DataFrame, model: Toxicity, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with the score of each whole text."""
    ship(docs.sparkSession)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([model.score(t) for lo, hi in runs(b) for t in b.slice(lo, hi - lo).to_pylist()], pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(score, "double")(text_of(text)))


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: fit on the training rows, score all."""
    model = fit(training_rows(docs, labels))
    scored = score_documents(docs.select("doc_id", "text"), model, into="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
