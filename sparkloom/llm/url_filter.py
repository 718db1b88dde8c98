"""URL filters: a weighted vocabulary matched by an Aho-Corasick automaton, and host/path rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The default vocabulary. A strict term rejects alone, soft terms reject together.
STRICT = (
    "camgirls", "casino", "cialis", "escorts", "hentai", "milf", "phishing", "porn", "porno", "pornhub", "sexcam",
    "sexchat", "viagra", "warez", "xvideos", "xxx",
)
SOFT = (
    "ads", "adult", "babes", "bet", "bets", "betting", "bonus", "cam", "cheap", "crack", "dating", "erotic", "farm",
    "free", "gambling", "girls", "hot", "keygen", "loan", "nude", "pharmacy", "pills", "poker", "replica", "sex",
    "slots", "spam", "teen", "torrent", "track", "tracker", "webcam", "win", "x",
)


@dataclass(frozen=True)
class Vocabulary:
    """strict terms weigh enough to reject alone; soft terms weigh 1 each, and soft_limit distinct ones reject."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_limit: int = 2


@dataclass(frozen=True)
class Rule:
    """Holds for host and its subdomains where the path starts with path."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


_FOLD = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_FOLD), rest[end:]
    if not rest.startswith("/"):
        return host, ""
    return host, rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


class RuleBook:
    """Finds the longest fitting rule by looking up each suffix of the host."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: -len(r.text)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> Rule | None:
        best, suffix = None, host
        while suffix:
            for rule in self.by_host.get(suffix, ()):
                if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                    best = rule
                    break
            suffix = suffix.partition(".")[2]
        return best


class TermCounter:
    """Distinct strict and soft terms of a text, each bounded by what is no letter or digit (A-Z, 0-9)."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for kind, terms in ((1, vocabulary.soft), (0, vocabulary.strict)):
            for term in terms:
                self.automaton.add_word(term.translate(_FOLD), (kind, term))
        self.automaton.make_automaton()

    def count(self, text: str) -> tuple[int, int]:
        found: tuple[set[str], set[str]] = (set(), set())
        text = text.translate(_FOLD)
        for last, (kind, term) in self.automaton.iter(text):
            first = last - len(term)
            if not (first >= 0 and _joins(text[first])) and not (last + 1 < len(text) and _joins(text[last + 1])):
                found[kind].add(term)
        return len(found[0]), len(found[1])


def _joins(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def filter_urls(
    df: DataFrame, rules: tuple[Rule, ...] = (), vocabulary: Vocabulary = Vocabulary(), *, url: str = "url", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Judges each row's URL: the columns in keep, then host, path, rule, verdict, n_strict, n_soft.

    The longest rule that fits decides; without one, a URL is blocked if it has a strict term or
    soft_limit distinct soft terms, counted over the whole URL. Rows are only mapped: there is no
    shuffle, and the vocabulary and the rules travel with the task.

    A null URL or one without '://' has an empty host and path and no rule; the null URL has no
    term, so it is allowed. Repeated rows are judged alike, an empty table gives an empty one, and
    columns not in keep are ignored. keep must not hold the names of the columns added.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, terms = RuleBook(rules), TermCounter(vocabulary)
        for batch in batches:
            rows = []
            for link in batch[url]:
                link = link if isinstance(link, str) else ""
                host, path = split_url(link)
                rule = book.find(host, path)
                strict, soft = terms.count(link)
                verdict = rule.action if rule else "block" if strict or soft >= vocabulary.soft_limit else "allow"
                rows.append((host, path, rule.text if rule else None, verdict, strict, soft))
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "n_strict", "n_soft"])
            yield pd.concat([batch[list(keep)].reset_index(drop=True), out], axis=1)

    kept = [df.schema[c] for c in keep]
    added = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    added += [T.StructField(c, T.LongType()) for c in ("n_strict", "n_soft")]
    return df.select(*dict.fromkeys((*keep, url))).mapInPandas(judge, T.StructType([*kept, *added]))
