"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rules are a parameter; the index of more than this would not be sent to every executor.
MAX_RULES = 1_000_000

_TOKEN = re.compile(r"[A-Za-z0-9]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        """Regular expressions over whole hosts and over paths, which may hold any character."""
        return rf"(?s)(?:.*\.)?{re.escape(self.host)}\Z", re.escape(self.path)

    def literals(self) -> set[str]:
        """Tokens that every fitting URL holds whole: a path may go on after the rule's last token."""
        path = re.sub(r"[A-Za-z0-9]+\Z", "", self.path)
        return set(_TOKEN.findall(self.host)) | set(_TOKEN.findall(path))


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path; both empty without ``://``."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def _tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host)) | set(_TOKEN.findall(path))


def token_counts(pages: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """URLs that hold each of some tokens, over the whole table; tasks send sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for u in batch.column(0).to_pylist():
                seen.update(_tokens(*split_url(u)) & tokens)
        yield pa.RecordBatch.from_pydict(
            {"token": list(seen), "n": list(seen.values())}, pa.schema([("token", pa.string()), ("n", pa.int64())])
        )

    sums = pages.select(url).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in sums.collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest literal token (ties: the smaller token), and the rules without any."""
    by_token: dict[str, list[int]] = defaultdict(list)
    always = []
    for i, rule in enumerate(rules):
        literals = rule.literals()
        if literals:
            by_token[min(literals, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(by_token), always


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """The rule that decides each URL: ``key, host, path, rule, verdict, n_candidates``, one row per row.

    Every rule is filed under the one of its literal tokens that fewest URLs hold. A URL's tokens fetch
    the rules filed under them, and only these run their regular expressions (``n_candidates`` of them).
    Of the rules that fit, the one with the longest host and path wins; ties go to the longer host, then
    to the rule given first. URLs that no rule fits have a NULL rule and the verdict ``default``.

    A NULL URL, or one without ``://``, has an empty host and path. Rows are judged one by one where
    they are, without a shuffle, so hot hosts and repeated rows change nothing; NULL keys are kept and
    other columns ignored.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    wanted = set().union(*(r.literals() for r in rules)) if rules else set()
    by_token, always = build_index(rules, token_counts(pages, wanted, url) if wanted else {})
    rank = [(len(r.name), len(r.host), -i) for i, r in enumerate(rules)]
    shared = pages.sparkSession.sparkContext.broadcast((rules, by_token, always, rank))
    types = dict((f.name, f.dataType.simpleString()) for f in pages.select(key).schema)
    schema = f"key {types[key]}, host string, path string, rule string, verdict string, n_candidates int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, by_token, always, rank = shared.value
        compiled: dict[int, list[re.Pattern]] = {}

        def fits(i: int, host: str, path: str) -> bool:
            if i not in compiled:
                compiled[i] = [re.compile(p) for p in rules[i].patterns]
            return all(p.match(v) for p, v in zip(compiled[i], (host, path), strict=True))

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for u in batch.column(1).to_pylist():
                host, path = split_url(u)
                found = [i for t in _tokens(host, path) if t in by_token for i in by_token[t]] + always
                best = max((i for i in found if fits(i, host, path)), key=rank.__getitem__, default=None)
                row = (host, path, None if best is None else rules[best].name)
                row += (default if best is None else rules[best].verdict, len(found))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            columns = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["key", "host", "path", "rule", "verdict", "n_candidates"]
            )

    judged = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).mapInArrow(judge, schema)
    return judged.withColumnRenamed("key", key)
