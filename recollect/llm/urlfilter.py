"""URL filters by a bit-parallel wildcard automaton.

Glob rules (`*` stands for any characters) are packed one after the other into the bits of several 64-bit words, as in Shift-And:
a step shifts all words by one, masks them by the character read, and keeps the states that a `*` loops on. All patterns run at
once over a URL, and all URLs of a batch run side by side as rows of a numpy array. A URL is canonical: "." + host in lower
case + "\\x01" + path, so that a pattern can tell hosts from paths and a host from its subdomains; that character in a URL counts as
"\\x02", which no pattern holds.

Defined cases: a null URL or one without "://" has an empty host and path and fits no list rule; a path may be empty, which no
rule with a path fits; an empty table gives an empty table; equal rows are judged alike; other columns pass through `keep_allowed`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship

# The contract's rules. A rule names a host (with all its subdomains) and the start of a path.
LIST_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Globs over canonical URLs that block what no list rule fits: advertising and tracking hosts, log-in and shop pages, files.
BLOCK_GLOBS = (
    "*.ads-*\x01*", "*.ads.*\x01*", "*.adserver.*\x01*", "*.track.*\x01*", "*.tracker.*\x01*", "*-track.*\x01*", "*.doubleclick.*\x01*", "*.click.*\x01*",
    "*\x01*/login*", "*\x01*/signin*", "*\x01*/wp-admin*", "*\x01*/cart*", "*\x01*/checkout*",
    "*\x01*.exe", "*\x01*.zip", "*\x01*.apk", "*\x01*.jpg", "*\x01*.png", "*\x01*.mp4",
)


#: Bytes of a table of characters; a text of more than LONG characters goes by itself.
TABLE, LONG = 4_000_000, 4096


@dataclass(frozen=True)
class Automaton:
    """Masks of W words for all patterns: see `compile_globs`."""

    step: np.ndarray  # [256, W] states that may be entered by a byte
    loop: np.ndarray  # [W] states that stay whatever is read
    start: np.ndarray  # [W]
    accept: np.ndarray  # [patterns] number of each pattern's last state
    words: int

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """[texts, patterns]: whether a whole text fits a pattern. Texts of about the same length go together, so that a table of
        characters has TABLE bytes at most; texts longer than LONG go by themselves."""
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-size, kind="stable")
        state = np.empty((n, self.words), np.uint64)
        at = 0
        while at < n:
            longest = int(size[order[at]])
            upto = at + 1 if longest > LONG else min(n, at + max(1, TABLE // max(1, longest)))
            own = order[at:upto]
            state[own] = self._alone(texts[own[0]]) if longest > LONG else self._together([texts[i] for i in own], size[own])
            at = upto
        return ((state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def _together(self, texts: Sequence[bytes], size: np.ndarray) -> np.ndarray:
        """States after texts, the longest first, all side by side."""
        n, longest = len(texts), int(size.max(initial=0))
        chars = np.zeros((n, longest), np.uint8)
        for row, t in enumerate(texts):
            chars[row, : size[row]] = np.frombuffer(t, np.uint8)
        state = np.tile(self.start, (n, 1))
        live = n - np.searchsorted(size[::-1], np.arange(longest), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for at in range(longest):
            k = live[at]
            old = state[:k]
            new = old << one
            new[:, 1:] |= old[:, :-1] >> top  # a bit that leaves a word enters the next
            new &= self.step[chars[:k, at]]
            new |= old & self.loop
            state[:k] = new
        return state

    def _alone(self, text: bytes) -> np.ndarray:
        """The state after one text, with all words as one number."""
        number = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        step, loop, state = [number(w) for w in self.step], number(self.loop), number(self.start)
        for c in text:
            state = state << 1 & step[c] | state & loop
        return np.frombuffer(state.to_bytes(8 * self.words, "little"), "<u8")


def compile_globs(globs: Sequence[str]) -> Automaton:
    """Pack globs into multiword masks. Each has a state for its start and one for each literal byte."""
    first, letters, loops, accept = [], [], [], []
    for glob in globs:
        first.append(len(letters))
        letters.append(None)
        for c in glob.encode():
            if c == ord("*"):
                if not loops or loops[-1] != len(letters) - 1:
                    loops.append(len(letters) - 1)
            else:
                letters.append(c)
        accept.append(len(letters) - 1)
    words = max(1, -(-len(letters) // 64))
    step, loop, start = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    bit = [np.uint64(1 << (i % 64)) for i in range(len(letters))]
    for i, c in enumerate(letters):
        if c is not None:
            step[c, i // 64] |= bit[i]
    for i in loops:
        loop[i // 64] |= bit[i]
    for i in first:
        start[i // 64] |= bit[i]
    return Automaton(step, loop, start, np.array(accept, np.int64), words)


def host_of(url: str = "url") -> Column:
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_glob(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"*.{host}\x01{slash}{path}*"


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = LIST_RULES, block: Sequence[str] = BLOCK_GLOBS, url: str = "url", into: str = "url_filter") -> DataFrame:
    """pages with a struct `into`: host, path, rule (the longest list rule that fits, or null), verdict, glob (the first that blocks)."""
    ship(pages.sparkSession)
    (into,) = fresh(pages, into)
    ranked = sorted(rules, key=lambda r: len(r[1]))
    globs = list(block)
    patterns = [rule_glob(r) for _, r in ranked] + globs

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        plain = lambda x: x.replace("\x01", "\x02")
        auto = compile_globs(patterns)
        n_rules = len(ranked)
        for host, path in batches:
            rule = np.full(len(host), None, object)
            verdict = np.full(len(host), "allow", object)
            glob = np.full(len(host), None, object)
            texts = [f".{plain(h)}\x01{plain(p)}".encode("utf-8", "replace") for h, p in zip(host, path, strict=True)]
            for i in range(0, len(texts), 4096):
                hit = auto.run(texts[i : i + 4096])
                part = slice(i, i + 4096)
                for k in range(len(globs) - 1, -1, -1):
                    glob[part][hit[:, n_rules + k]] = globs[k]
                verdict[part][hit[:, n_rules:].any(axis=1)] = "block"
                for k, (say, name) in enumerate(ranked):  # longer rules later
                    rule[part][hit[:, k]] = name
                    verdict[part][hit[:, k]] = say
            yield pd.DataFrame({"rule": rule, "verdict": verdict, "glob": glob})

    judged = F.pandas_udf(judge, "rule string, verdict string, glob string")
    host, path = host_of(url), path_of(url)
    made = judged(host, path)
    (j,) = fresh(pages, "judged")
    out = pages.withColumn(j, made)
    return out.withColumn(into, F.struct(host.alias("host"), path.alias("path"), f"{j}.rule", f"{j}.verdict", f"{j}.glob")).drop(j)


def keep_allowed(pages: DataFrame, url: str = "url") -> DataFrame:
    own = pages.columns
    (into,) = fresh(pages, "url_filter")
    return verdicts(pages, url=url, into=into).where(F.col(f"{into}.verdict") == "allow").select(*(F.col(f"`{c}`") for c in own))


def op7_url_filters(pages: DataFrame) -> DataFrame:
    """The contract's digest of `verdicts`."""
    return verdicts(pages.select("page_id", "url")).select("page_id", *(f"url_filter.{c}" for c in ("host", "path", "rule", "verdict")))


def _sql_glob(glob: str) -> str:
    parts = glob.replace("%", "\\%").replace("_", "\\_").split("*")
    said = "%".join(parts).replace("\x01", "|")
    return f"u LIKE '{said}' ESCAPE '\\'"


ORACLE = rf"""
WITH p AS (SELECT page_id,
                  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in LIST_RULES)}),
x AS (SELECT page_id, host, path, '.' || replace(host, '|', '!') || '|' || replace(path, '|', '!') AS u,
             (SELECT max_by(r.rule, length(r.rule)) FROM r
              WHERE ('.' || host) LIKE '%.' || split_part(r.rule, '/', 1) AND starts_with(path, substr(r.rule, instr(r.rule, '/')))) AS rule FROM p)
SELECT page_id, host, path, x.rule, coalesce(r.verdict, CASE WHEN {" OR ".join(map(_sql_glob, BLOCK_GLOBS))} THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN r ON r.rule = x.rule
"""
