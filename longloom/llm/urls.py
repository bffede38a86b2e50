"""Filtering URLs by a weighted vocabulary and by rules for hosts and paths.

The vocabulary is searched with an Aho-Corasick automaton, one pass over a URL however many terms there are, in Arrow
batches. The rules are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker import kept

# Terms for which a URL goes at once, and terms of which one alone says little.
STRICT = ("porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirls", "sexcam", "milf", "gangbang", "blowjob",
          "bukkake", "creampie", "hardcoresex", "onlinecasino", "freeviagra", "warez", "crackz", "keygen")
SOFT = {"sex": 2, "sexy": 1, "adult": 1, "nude": 1, "erotic": 1, "escort": 1, "fetish": 1, "dating": 1, "casino": 1,
        "poker": 1, "betting": 1, "jackpot": 1, "slots": 1, "viagra": 2, "cialis": 2, "payday": 1, "torrent": 1,
        "crack": 1, "replica": 1, "pills": 1}
SOFT_HITS = 2  # so many different soft terms reject a URL

RESULT = "strict array<string>, soft array<string>, weight long, rejected boolean"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


class Vocabulary:
    """Terms found in lower-cased text where neither neighbour is a letter a-z or a digit."""

    def __init__(self, strict: tuple[str, ...], soft: dict[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def counts(self, text: str) -> dict[str, int]:
        found: dict[str, int] = {}
        for end, term in self.automaton.iter(text):
            before, after = text[end - len(term):end - len(term) + 1], text[end + 1:end + 2]
            if end >= len(term) and _inside(before) or _inside(after):
                continue
            found[term] = found.get(term, 0) + 1
        return found


def _inside(c: str) -> bool:
    return c.isascii() and c.isalnum()


def url_terms(url: Column, strict: Iterable[str] = STRICT, soft: dict[str, int] = SOFT,
              soft_hits: int = SOFT_HITS) -> Column:
    """What the vocabulary says of a URL: ``strict`` and ``soft`` terms found, in order, the ``weight`` of the soft ones
    (each times its number of places), and whether it is ``rejected``: for one strict or ``soft_hits`` different soft
    terms. A NULL URL has no terms and is not rejected. Upper case A-Z counts as lower case.
    """
    strict, soft = tuple(sorted(strict)), dict(soft)

    @F.pandas_udf(RESULT)
    def judge(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = kept(f"urls:{strict}:{sorted(soft)}", lambda: Vocabulary(strict, soft))
        hard = set(strict)
        for part in urls:
            rows = []
            for text in part:
                found = terms.counts(text) if text else {}
                bad = sorted(t for t in found if t in hard)
                mild = sorted(t for t in found if t in soft)
                rows.append((bad, mild, sum(soft[t] * found[t] for t in mild), bool(bad) or len(mild) >= soft_hits))
            yield pd.DataFrame(rows, columns=["strict", "soft", "weight", "rejected"])

    return judge(lower_ascii(url))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty for NULL or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), path


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, NULL if none does.

    A rule is ``host/path``; it fits the host and its subdomains where the path begins with the rule's.
    """
    fits = rule = verdict = None
    for text, said in sorted(rules.items(), key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def judge_urls(df: DataFrame, rules: dict[str, str], url_col: str = "url", strict: Iterable[str] = STRICT,
               soft: dict[str, int] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """The rows with one more column ``judged``: ``host, path, rule, verdict, strict, soft, weight``.

    ``verdict`` is the longest fitting rule's, else ``block`` or ``allow`` by the vocabulary. A NULL or empty URL has an
    empty host and path, no rule and is allowed. Repeated rows, NULL in other columns and any other column names but
    ``judged`` itself, which is replaced, make no difference; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url_col))
    seen = df.withColumn("judged", F.struct(host.alias("host"), path.alias("path"),
                                            url_terms(F.col(url_col), strict, soft, soft_hits).alias("terms")))
    own = F.col("judged")
    rule, verdict = longest_rule(own["host"], own["path"], rules)
    words = F.when(own["terms"]["rejected"], "block").otherwise("allow")
    return seen.withColumn("judged", F.struct(
        own["host"].alias("host"), own["path"].alias("path"), rule.alias("rule"),
        F.coalesce(verdict, words).alias("verdict"), own["terms"]["strict"].alias("strict"),
        own["terms"]["soft"].alias("soft"), own["terms"]["weight"].alias("weight")))
