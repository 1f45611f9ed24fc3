"""URL verdicts from host and path rules, else from weighted vocabularies found by Aho-Corasick.

One strict term rejects. Soft terms weigh 1 or 2, each different one once, and reject
from a sum of 3, so by two or three different ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import column_of, ship

#: Terms that reject alone, in four languages.
STRICT = tuple(
    "porn porno pornos xxx xvideos hentai milf camgirl camgirls escort escorts bestiality casino casinos sportsbook warez keygen keygens malware phishing "
    "escorte prostituee sodomie putes hure huren sexkontakte nutten spielhalle putas prostitutas pornografia casas-de-apuestas".split()
)
#: Terms that say much (weight 2) and little (weight 1) when several different ones are met, in four languages.
STRONG = tuple(
    "adult sex nude nudes betting poker jackpot slots payday viagra cialis torrent torrents crack cracked "
    "nue nues paris-sportifs sexe erotique nackt erotik wetten gluecksspiel desnuda desnudas sexo apuestas tragaperras".split()
)
WEAK = tuple(
    "dating bet loan loans pills replica free cheap hot girls live cam cams bonus win "
    "rencontre gratuit filles pas-cher credit kostenlos billig kredit maedchen kontakte gratis barato chicas prestamo citas".split()
)
SOFT = dict.fromkeys(WEAK, 1) | dict.fromkeys(STRONG, 2)


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    rule: str  # host/path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


@dataclass(frozen=True)
class UrlPolicy:
    rules: tuple[Rule, ...] = ()
    strict: tuple[str, ...] = STRICT
    soft: dict[str, int] = field(default_factory=lambda: dict(SOFT), hash=False)
    soft_needed: int = 3  # more than any one soft term weighs
    by_host: dict[str, list[Rule]] = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self) -> None:
        for r in sorted(self.rules, key=lambda r: (-len(r.rule), r.rule)):
            self.by_host.setdefault(r.host, []).append(r)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and for what has no ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = next((k for k, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:stop]


class UrlFilter:
    def __init__(self, policy: UrlPolicy) -> None:
        import ahocorasick

        self.policy = policy
        self.automaton = ahocorasick.Automaton()
        for soft, terms in ((True, policy.soft), (False, policy.strict)):
            for t in terms:
                self.automaton.add_word(t, (soft, t))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest rule for the host or a domain above it whose path begins the url's."""
        best, parts = None, host.split(".")
        for k in range(len(parts)):
            for r in self.policy.by_host.get(".".join(parts[k:]), ()):
                if path.startswith(r.path) and (best is None or len(r.rule) > len(best.rule)):
                    best = r
        return best

    def terms(self, url: str) -> tuple[list[str], list[str]]:
        """The different strict and soft terms that stand in the url with no letter or digit at either side."""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
        strict, soft = set(), set()
        if len(self.automaton):
            for end, (is_soft, t) in self.automaton.iter(text):
                start = end - len(t) + 1
                if not (start and text[start - 1].isalnum()) and not (end + 1 < len(text) and text[end + 1].isalnum()):
                    (soft if is_soft else strict).add(t)
        return sorted(strict), sorted(soft)

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str, list[str], list[str]]:
        host, path = split_url(url)
        rule = self.rule(host, path)
        strict, soft = self.terms(url or "")
        bad = bool(strict) or sum(self.policy.soft[t] for t in soft) >= self.policy.soft_needed
        return host, path, rule.rule if rule else None, rule.verdict if rule else "block" if bad else "allow", strict, soft


def _judge(policy: UrlPolicy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlFilter(policy)
        for batch in batches:
            rows = [judge(u) for u in column_of(batch, "url").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([column_of(batch, "page_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    return run


def url_filter(pages: DataFrame, policy: UrlPolicy) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), strict_terms, soft_terms of every row.

    A url that is null or has no :// has an empty host and path and fits no rule;
    its text is still searched for terms, however long it is. Equal rows are judged each, and so are rows with a null page_id; only page_id
    and url are read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(_judge(policy), "page_id long, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>")
