"""URL filters: host and path rules, and a weighted vocabulary counted by an Aho-Corasick automaton (operator 12).

A url that a rule fits has that rule's verdict. Any other is judged by the terms in it: one strict term, or several different
soft terms, block it. A term counts only where it stands between characters that are no letters or digits, so "win" is not met in
"window". All terms are found in one pass over the bytes of a batch of urls. Everything happens within a row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and
from quire.llm.textbuf import LOWER, release, runs
from quire.operators.automaton import Automaton

#: Rules and terms go to every task: the most bytes of each.
MOST_BYTES = 64 << 20
#: Two soft terms are enough.
SOFT_HITS = 2
STRICT = ["casino", "porn", "porno", "xxx", "viagra", "cialis", "escorts", "camgirls", "sexcam", "hentai", "malware", "phishing", "warez"]
SOFT = [
    "ad", "ads", "track", "tracker", "bet", "bets", "betting", "poker", "jackpot", "bonus", "free", "win", "cheap", "pills", "pharmacy", "replica", "loan", "loans", "spam", "farm",
    "adult", "sex", "nude", "dating", "crack", "keygen", "torrent", "click-bait", "free-money",
]

UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for the host, all its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]

#: Bytes that make up words: ASCII letters and digits, and all of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def whole_hits(automaton: Automaton, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every occurrence between bytes that are no word bytes, or the text's ends."""
    text, end, term = automaton.scan(data, at)
    start = end - automaton.size[term]
    inner = WORD[data]
    before = (start > at[text]) & inner[np.maximum(start - 1, 0)]
    after = (end < at[text + 1]) & inner[np.minimum(end, len(data) - 1)]
    good = ~(before | after)
    return text[good], term[good]


class Rules:
    """The longest rule (host and path together; of equal ones that with the longer host) for a host and path."""

    def __init__(self, rules: Sequence[Rule]):
        self.of: dict[str, list[tuple[str, int]]] = {}
        self.rules = list(rules)
        for i, r in enumerate(self.rules):
            self.of.setdefault(r.host, []).append((r.path, i))

    def best(self, host: str, path: str) -> Rule | None:
        found, rank = None, (-1, -1)
        at = 0
        while True:
            suffix = host[at:]
            for start, i in self.of.get(suffix, ()):
                if path.startswith(start) and (len(suffix) + len(start), len(suffix)) > rank:
                    found, rank = self.rules[i], (len(suffix) + len(start), len(suffix))
            dot = host.find(".", at)
            if dot < 0:
                return found
            at = dot + 1


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES), strict: Sequence[str] = tuple(STRICT), soft: Sequence[str] = tuple(SOFT), soft_hits: int = SOFT_HITS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, strict_terms, soft_terms) of every url.

    ``host``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; ``path``: from there up to ``?``, ``#`` or the end.
    ``rule`` is the longest that fits (its name, host and path), else null; its verdict holds. Without one, a strict term or
    ``soft_hits`` different soft terms anywhere in the url (A-Z lower-cased) block it. The hits are counts of occurrences, the terms are the
    different ones in order of the vocabulary; both are given for urls with a rule as well. A term of both lists is strict.

    Null urls and urls without ``://``: host and path are empty, so only a rule for the empty host fits; terms are looked for in the whole url (null
    has none). Very long urls are read whole. Null and repeated page_ids give a row each. No other column is looked at. Empty table: no
    rows. Rules and terms are sent to all tasks and may have 64 MB each at most.
    """
    strict = list(dict.fromkeys(t.translate(str.maketrans(UPPER_LETTERS, LOWER_LETTERS)) for t in strict))
    soft = [t for t in dict.fromkeys(t.translate(str.maketrans(UPPER_LETTERS, LOWER_LETTERS)) for t in soft) if t not in set(strict)]
    if max(sum(len(r.name) for r in rules), sum(map(len, strict + soft))) > MOST_BYTES:
        raise ValueError("rules or terms are too many to send to every task: split them")
    spark = pages.sparkSession
    tools = spark.sparkContext.broadcast((Rules(rules), Automaton([t.encode("utf-8") for t in strict + soft])))
    n_strict, terms = len(strict), pa.array(strict + soft, pa.string())

    def distinct(text: np.ndarray, term: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        pairs = np.unique(text * len(terms) + term)
        of = np.searchsorted(pairs, np.arange(n + 1) * len(terms))
        return pa.ListArray.from_arrays(pa.array(of, pa.int32()), terms.take(pa.array(pairs % len(terms)))), np.diff(of)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, automaton = tools.value
        for batch in batches:
            for part, texts in runs(batch, "url"):
                text, term = whole_hits(automaton, LOWER[texts.data], texts.at)
                hard = term < n_strict
                strict_terms, n_hard = distinct(text[hard], term[hard], texts.n)
                soft_terms, n_soft = distinct(text[~hard], term[~hard], texts.n)
                found = [by_host.best(h, p) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                judged = np.where((n_hard >= 1) | (n_soft >= soft_hits), "block", "allow").tolist()
                count = lambda which: pa.array(np.bincount(text[which], minlength=texts.n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array([r and r.name for r in found], pa.string()), pa.array([r.verdict if r else j for r, j in zip(found, judged, strict=True)], pa.string()), count(hard), count(~hard), strict_terms, soft_terms],
                    names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "strict_terms", "soft_terms"],
                )
        release()

    part = lambda nth: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", nth), F.lit(""))
    cut = id_and(pages, key, F.col(url).alias("url"), F.translate(part(1), UPPER_LETTERS, LOWER_LETTERS).alias("host"), part(2).alias("path"))
    schema = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, strict_terms array<string>, soft_terms array<string>"
    return cut.mapInArrow(each, schema)


def op12_urls(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page of ``pages``."""
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("strict_terms", ",").alias("strict_terms"), F.array_join("soft_terms", ",").alias("soft_terms"))


def _sql() -> str:
    """The rules and the vocabulary as SQL: terms by one regular expression each, rules by their lengths."""
    edge = r"[^a-z0-9\x{80}-\x{10FFFF}]"
    listed = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    met = lambda terms: f"list_filter({listed(terms)}, lambda t: regexp_matches(low, '(^|{edge})' || t || '({edge}|$)'))"
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    low = f"translate(coalesce(url, ''), '{UPPER_LETTERS}', '{LOWER_LETTERS}')"
    return rf"""WITH r(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id, {low} AS low, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER_LETTERS}', '{LOWER_LETTERS}') AS host,
      regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (SELECT *, {met(STRICT)} AS hard, {met(SOFT)} AS soft, row_number() OVER () AS k FROM u),
f AS (SELECT k, first(h || p ORDER BY length(h || p) DESC, length(h) DESC) AS rule, first(v ORDER BY length(h || p) DESC, length(h) DESC) AS v
      FROM t, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN len(hard) >= 1 OR len(soft) >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(hard, ',') AS strict_terms, array_to_string(soft, ',') AS soft_terms
FROM t LEFT JOIN f USING (k)"""


SQL = _sql()
