"""URL filters: glob rules packed into Shift-And masks, all rules simulated at once over each URL.

A glob is matched against the canonical URL, which is the lower-cased host followed by the path.
`?` is one character other than a slash, `*` any run of those, `**` any run at all. Every pattern gets
one bit for its start and one for each of its characters; stars are self-loops of the bit before them.
Patterns lie side by side in as many 64-bit words as they need. One step reads one byte of every URL of
an Arrow batch, so Python's share is one array operation for each position and not for each URL.

Work is a projection: there is no shuffle, so a host that owns a third of all pages costs nothing extra.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and gets the
default verdict. Very long URLs are read to their end. Repeated rows are judged each, an empty table stays empty; of rules
that fit the same URL the longest wins, of globs the first. All columns stay, whatever their names, but for those of the result, which are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import LOWER, UPPER


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


class GlobRule(NamedTuple):
    verdict: str
    glob: str


#: Rules of the contract: the longest that fits decides.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

#: Topics judged by the host where no host rule fits; the first that fits decides.
TOPICS = ("casino", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult", "porn", "xxx", "viagra", "torrent")
GLOB_RULES = tuple(GlobRule("block", g) for t in TOPICS for g in (f"{t}*.*/**", f"*.{t}*.*/**", f"{t}*.*", f"*.{t}*.*"))
DEFAULT = "allow"


class Automaton:
    """Bit-parallel simulation of many globs. step is [256, words]: which bits a byte may enter; stay: which loop."""

    def __init__(self, globs: list[str]):
        parsed = [self._states(g) for g in globs]
        total = sum(len(p) for p in parsed)
        self.words = max(1, -(-total // 64))
        step, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        start = np.zeros(self.words * 64, bool)
        any_byte, no_slash = np.ones(256, bool), np.arange(256) != ord("/")
        self.last, at = [], 0
        for states in parsed:
            start[at] = True
            for k, (char, loop) in enumerate(states):
                if k:
                    step[:, at + k] = no_slash if char is None else np.arange(256) == char
                if loop:
                    stay[:, at + k] = any_byte if loop == "**" else no_slash
            at += len(states)
            self.last.append(at - 1)
        self.step, self.stay, self.start = self._pack(step), self._pack(stay), self._pack(start[None])[0]

    @staticmethod
    def _states(glob: str) -> list[tuple[int | None, str]]:
        """(byte that enters, or None for `?`; "", "*" or "**": the self-loop) of each state, the start first."""
        states: list[tuple[int | None, str]] = [(None, "")]
        body, i = glob.encode(), 0
        while i < len(body):
            if body[i : i + 1] == b"*":
                wide = body[i : i + 2] == b"**"
                states[-1] = (states[-1][0], "**" if wide or states[-1][1] == "**" else "*")
                i += 1 + wide
            else:
                states.append((None if body[i : i + 1] == b"?" else body[i], ""))
                i += 1
        return states

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def match(self, texts: list[bytes]) -> np.ndarray:
        """[texts, globs] of booleans."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes, starts = lengths[order], np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        state = np.repeat(self.start[None], len(texts), axis=0)
        live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for j, n in enumerate(live):
            byte, now = data[starts[:n] + j], state[:n]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:n] = (shifted & self.step[byte]) | (now & self.stay[byte])
        last = np.array(self.last)
        hit = (state[:, last // 64] >> (last % 64).astype(np.uint64)) & one
        out = np.zeros((len(texts), len(self.last)), bool)
        out[order] = hit.astype(bool)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    glob_rules: tuple[GlobRule, ...] = GLOB_RULES,
    default: str = DEFAULT,
) -> DataFrame:
    """pages with host, path, rule (the host rule that decided, else null), glob (the glob that decided, else null), verdict."""
    ranked = sorted(host_rules, key=lambda r: -len(r.host + r.path))
    globs = [g for r in ranked for g in (f"{r.host}{r.path}**", f"*.{r.host}{r.path}**")] + [r.glob for r in glob_rules]
    n = len(ranked)
    names = np.array([r.host + r.path for r in ranked] + [r.glob for r in glob_rules] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [r.verdict for r in glob_rules] + [default], object)
    automaton = Automaton(globs)

    @F.pandas_udf("rule string, glob string, verdict string")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            hit = automaton.match([u.encode() for u in urls])
            fits = np.concatenate([hit[:, : 2 * n].reshape(len(urls), n, 2).any(2), hit[:, 2 * n :], np.ones((len(urls), 1), bool)], axis=1)
            first = fits.argmax(1)
            yield pd.DataFrame({"rule": np.where(first < n, names[first], None), "glob": np.where(first >= n, names[first], None), "verdict": verdicts[first]})

    host, path = host_and_path(pages[url])
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "glob", "verdict")]
    # The row is nested, so no name of it meets one of ours.
    parts = pages.select(F.struct(F.lit(True).alias("is_row"), *[pages[c] for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("judged", decide(F.concat("host", "path")))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", *[F.col("judged").getField(c).alias(c) for c in ("rule", "glob", "verdict")])
