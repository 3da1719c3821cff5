"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed, one bit for each state, into the 64-bit words of one Shift-And machine, and all are simulated
at once over each canonical URL, `.` + host + path. `*` stands for any run of characters without a slash, `**` for any
run at all. A worker steps some URLs side by side, one character position at a time, and the few very long ones alone.

A host rule (`example.com/en/7`: a host, and the start of a path) is the glob `*.example.com/en/7**`: the leading dot of the
canonical URL makes it fit the host itself and every subdomain, and the first slash ends the host.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """A verdict for the canonical URLs that a glob fits; name is shown, and the longest name wins."""

    verdict: str
    name: str
    glob: str = field(default="")

    def pattern(self) -> str:
        return self.glob or f"*.{self.name}**"


#: The rules of the query, host and path in one.
RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]
#: What the method itself blocks where no rule speaks; the query has no such globs, so it allows.
METHOD: list[Rule] = []
#: Words of automaton states that are held at once, and how many URLs must reach a position to be stepped side by side there.
CELLS, ABREAST = 2_000_000, 16


class Automaton:
    """Shift-And over several words: bit i of a glob's run is set when its first i items have been read."""

    def __init__(self, globs: list[str]) -> None:
        items: list[list[str]] = []
        for glob in globs:
            own, i = [], 0
            while i < len(glob):
                wide = glob[i : i + 2] == "**"
                own.append("**" if wide else glob[i])
                i += 1 + wide
            items.append(own)
        size = sum(len(own) + 1 for own in items)  # a state before each item, and the last one
        self.words = max(1, -(-size // 64))
        zeros = lambda: np.zeros(self.words, np.uint64)
        self.start, self.stay, self.wide, self.skip, self.accept = zeros(), zeros(), zeros(), zeros(), []
        self.step = {}

        def put(mask: np.ndarray, at: int) -> None:
            mask[at // 64] |= np.uint64(1 << at % 64)

        at, self.chain = 0, 0
        for own in items:
            put(self.start, at)
            chain = 0
            for k, item in enumerate(own):
                if item in ("*", "**"):
                    put(self.wide if item == "**" else self.stay, at + k)  # may read and remain
                    put(self.skip, at + k)  # may pass on without reading
                    chain += 1
                    self.chain = max(self.chain, chain)
                else:
                    chain = 0
                    put(self.step.setdefault(ord(item), zeros()), at + k + 1)
            at += len(own)
            self.accept.append(at)
            at += 1
        self._at, self._bit = np.array(self.accept, np.int64) // 64, (np.array(self.accept, np.int64) % 64).astype(np.uint64)
        self._masks = None
        self.table = np.zeros((257, self.words), np.uint64)  # the last: characters beyond Latin-1
        for c, mask in self.step.items():
            self.table[min(c, 256)] |= mask

    def shift(self, d: np.ndarray) -> np.ndarray:
        out = d << np.uint64(1)
        out[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return out

    def close(self, d: np.ndarray) -> np.ndarray:
        for _ in range(self.chain):
            d = d | self.shift(d & self.skip)
        return d

    def fits(self, texts: list[str]) -> np.ndarray:
        """For each text and glob, whether the glob fits the whole text."""
        out = np.zeros((len(texts), len(self.accept)), bool)
        for rows, states in self._run(texts):
            out[rows] = (states[:, self._at] >> self._bit) & np.uint64(1)
        return out

    def first(self, texts: list[str], groups: list[int]) -> np.ndarray:
        """For each text and each of some ranges of globs (0 to groups[0], on to groups[1], ...), the first glob that fits, or -1."""
        out = np.full((len(texts), len(groups)), -1, np.int64)
        for rows, states in self._run(texts):
            hit = (states[:, self._at] >> self._bit) & np.uint64(1)
            for g, (a, b) in enumerate(zip([0, *groups[:-1]], groups, strict=True)):
                if b > a:
                    some = hit[:, a:b].any(axis=1)
                    out[rows[some], g] = a + hit[some, a:b].argmax(axis=1)
        return out

    def _run(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The last states of the texts, some texts at a time."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        step = max(1, CELLS // max(self.words, len(self.accept)))
        for low in range(0, len(order), step):
            rows = order[low : low + step]
            yield rows, self._states([texts[k] for k in rows.tolist()])

    def _states(self, texts: list[str]) -> np.ndarray:
        """From the longest text to the shortest: side by side as long as many reach a position, then one by one as whole numbers."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), 256)
        begin = np.cumsum(size) - size
        d = self.close(np.repeat(self.start[None, :], len(texts), axis=0))
        slash = ord("/")
        j, last = 0, int(size[0]) if len(size) else 0
        while j < last:
            n = int(np.searchsorted(-size, -j, "left"))
            if n < ABREAST:
                break
            c = points[begin[:n] + j]
            here = d[:n]
            stay = here & (self.wide | np.where((c != slash)[:, None], self.stay, np.uint64(0)))
            d[:n] = self.close((self.shift(here) & self.table[c]) | stay)
            j += 1
        for k in range(int(np.searchsorted(-size, -j, "left")) if j < last else 0):
            d[k] = np.frombuffer(self._alone(int.from_bytes(d[k].tobytes(), "little"), points[begin[k] + j : begin[k] + size[k]].tolist()).to_bytes(8 * self.words, "little"), np.uint64)
        return d

    def _alone(self, state: int, points: list[int]) -> int:
        """The state after some characters, as one number; equal steps are taken once."""
        number = lambda mask: int.from_bytes(mask.tobytes(), "little")
        if self._masks is None:
            self._masks = [number(m) for m in self.table], number(self.wide), number(self.stay), number(self.skip), (1 << 64 * self.words) - 1
        table, wide, stay, skip, full = self._masks
        known: dict[tuple[int, int], int] = {}
        for c in points:
            new = known.get((state, c))
            if new is None:
                new = (state << 1) & table[c] | state & wide | (state & stay if c != 47 else 0)
                for _ in range(self.chain):
                    new |= (new & skip) << 1
                new &= full
                if len(known) < 10_000:
                    known[state, c] = new
            state = new
        return state


@functools.lru_cache(4)
def automaton(globs: tuple[str, ...]) -> Automaton:
    return Automaton(list(globs))


def read_rules(path: str) -> list[Rule]:
    """Rules from a text file: `block` or `allow`, a blank, and a host rule (`example.com/en/7`) or a glob (with a star in it); # starts a comment."""
    out = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            verdict, _, rule = line.partition("#")[0].strip().partition(" ")
            rule = rule.strip()
            if verdict:
                if verdict not in ("block", "allow") or not rule:
                    raise ValueError(f"not a rule: {line.strip()}")
                out.append(Rule(verdict, rule, rule if "*" in rule else ""))
    return out


def host_and_path(url: str):
    """The columns host and path of a url column's name; both empty if it is null or has no `://`."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def url_filter(df: DataFrame, rules: list[Rule] = RULES, method: list[Rule] = METHOD, url: str = "url") -> DataFrame:
    """df with host, path, rule and verdict.

    The rule that fits with the longest name decides (of equally long ones the first in the list); where none fits, rule is
    null and the verdict is block if one of the method's globs fits, else allow. A null url, or one without `://`, has an
    empty host and path, fits no rule and is allowed. Repeated rows get equal results; an empty table gives an
    empty one. The four new columns replace columns of those names. Only host and path go through Python, in batches; rules may be thousands.
    """
    host, path = host_and_path(url)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = tuple(r.pattern() for r in [*ranked, *method])
    names, verdicts = [*(r.name for r in ranked), None], [*(r.verdict for r in ranked), "allow"]

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        first = automaton(globs).first([f".{h}{p}" for h, p in zip(host, path, strict=True)], [len(ranked), len(globs)])
        return pd.DataFrame({"rule": [names[k] for k in first[:, 0].tolist()], "verdict": ["block" if k < 0 <= m else verdicts[k] for k, m in first.tolist()]})

    judged = df.withColumn("_ow_host", host).withColumn("_ow_path", path).withColumn("_ow_said", judge("_ow_host", "_ow_path"))
    return judged.select(*rest, F.col("_ow_host").alias("host"), F.col("_ow_path").alias("path"), F.col("_ow_said.rule").alias("rule"), F.col("_ow_said.verdict").alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
"""
