"""URL filter: allow/block rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds every vocabulary term of the lower-cased host and
path in one pass. A hit counts only between boundaries (no letter or digit on
either side). One strict term, or ``soft_needed`` distinct soft terms, block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import column_of

#: The vocabulary's strict terms, each of which blocks by itself.
STRICT_TERMS = ("adult", "porn", "xxx", "hentai", "escort", "camgirls", "casino", "malware", "phishing", "warez", "spam")
#: The vocabulary's soft terms; several distinct ones block.
SOFT_TERMS = ("ads", "track", "tracker", "bet", "bets", "betting", "free", "win", "winner", "jackpot", "poker", "slots", "cheap", "pills", "viagra", "loan", "loans", "farm", "dating", "nude", "sex", "sexy", "hot", "click", "popup", "crack", "keygen", "torrent")


@dataclass(frozen=True)
class Rule:
    """``target`` is host/path; it fits the host and its subdomains where the path starts with the rule's."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


@dataclass(frozen=True)
class UrlPolicy:
    rules: Sequence[Rule] = ()
    strict: Sequence[str] = STRICT_TERMS
    soft: Sequence[str] = SOFT_TERMS
    soft_needed: int = 2
    _index: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        if self.soft_needed < 1:
            raise ValueError("soft_needed is at least 1")
        for rule in self.rules:
            if rule.verdict not in ("allow", "block") or not rule.host:
                raise ValueError(f"not a rule: {rule}")
            self._index.setdefault(rule.host, []).append(rule)
        for rules in self._index.values():
            rules.sort(key=lambda r: (-len(r.path), r.verdict))

    def rule_for(self, host: str, path: str) -> Rule | None:
        """The longest fitting rule, by its whole target; allow before block at a tie."""
        best, at = None, host
        while at:
            for rule in self._index.get(at, ()):
                if path.startswith(rule.path) and (best is None or (len(rule.target), best.verdict) > (len(best.target), rule.verdict)):
                    best = rule
            at = at.partition(".")[2]
        return best


def load_policy(spark: SparkSession, path: str, rules: Sequence[Rule] = (), soft_needed: int = 2) -> UrlPolicy:
    """A policy whose vocabulary is read from text files: a line is ``strict`` or ``soft``, white space, and a term.

    Empty lines and lines that begin with ``#`` are passed over; a term told twice is
    one; a term told both ways is strict; any other line is an error. The vocabulary
    goes to the driver and to every task, so it is the one thing here that must fit there.
    """
    terms: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for row in spark.read.text(path).collect():
        line = row.value.strip()
        if not line or line.startswith("#"):
            continue
        kind, _, term = line.partition(" " if "\t" not in line else "\t")
        if kind not in terms or not term.strip():
            raise ValueError(f"not a term of the vocabulary: {line!r}")
        terms[kind].add(term.strip().lower())
    return UrlPolicy(rules, tuple(sorted(terms["strict"])), tuple(sorted(terms["soft"] - terms["strict"])), soft_needed)


class TermCounter:
    """Counts the distinct strict and soft terms that stand between boundaries."""

    def __init__(self, policy: UrlPolicy):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in policy.soft:
            self.automaton.add_word(term.lower(), (term.lower(), False))
        for term in policy.strict:
            self.automaton.add_word(term.lower(), (term.lower(), True))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[list[str], list[str]]:
        strict, soft = set(), set()
        if not self.empty:
            for end, (term, is_strict) in self.automaton.iter(text):
                start = end - len(term) + 1
                if (start and _wordy(text[start - 1])) or (end + 1 < len(text) and _wordy(text[end + 1])):
                    continue
                (strict if is_strict else soft).add(term)
        return sorted(strict), sorted(soft)


def _wordy(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``. The host keeps a port and user, A-Z lower-cased."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    host_end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    tail = rest[host_end:]
    path_end = min((i for i in (tail.find("?"), tail.find("#")) if i >= 0), default=len(tail))
    return rest[:host_end].translate(_ASCII_LOWER), tail[:path_end]


SCHEMA = "host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>"
_ARROW = pa.schema(
    [("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string()))]
)


def verdict_of(policy: UrlPolicy, count: TermCounter, url: str | None) -> tuple[str, str, str | None, str, list[str], list[str]]:
    """(host, path, rule, verdict, strict terms, soft terms) of one url."""
    host, path = split_url(url)
    rule = policy.rule_for(host, path)
    strict, soft = count(host + path.translate(_ASCII_LOWER))
    block = rule.verdict == "block" if rule else bool(strict) or len(soft) >= policy.soft_needed
    return host, path, rule.target if rule else None, "block" if block else "allow", strict, soft


def judge_urls(df: DataFrame, policy: UrlPolicy, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, strict_terms, soft_terms.

    Null urls, and urls without ``://``, have an empty host and path, fit no rule
    and hold no term: they are allowed. Repeated rows are judged each; an empty
    table gives no rows; other columns are not looked at. Terms are sought in host
    and path, lower-cased (A-Z).
    """

    def judge(batches: Iterable[pa.RecordBatch]):
        count = TermCounter(policy)
        for batch in batches:
            out = {n: [] for n in _ARROW.names}
            for url in batch.column(1).to_pylist():
                for name, value in zip(_ARROW.names, verdict_of(policy, count, url), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], f.type) for n, f in zip(_ARROW.names, _ARROW, strict=True))], names=["_id", *_ARROW.names])

    rows = df.select(column_of(df, id_col).cast("long").alias("_id"), column_of(df, url_col).cast("string").alias("_url"))
    return rows.mapInArrow(judge, f"_id long, {SCHEMA}").withColumnRenamed("_id", id_col)


def allowed_pages(df: DataFrame, policy: UrlPolicy, url_col: str = "url") -> DataFrame:
    """The rows of ``df`` whose url is allowed, with all their columns.

    Null urls and urls without ``://`` are allowed; repeated rows are judged each; an
    empty table gives no rows. One pass over the urls alone, with no shuffle.
    """

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = TermCounter(policy)
        for urls in batches:
            yield pa.array([verdict_of(policy, count, url)[3] == "allow" for url in urls.to_pylist()], pa.bool_())

    return df.filter(passes(column_of(df, url_col).cast("string")))
