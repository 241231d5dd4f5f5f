"""Glossary mining, matching and merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import ranking
from quire.sources.tables import released

# Characters and words that mark code.
INVALID_CHARS = list("=()[]{}<>/\\:%*©’_−ˉ+±×÷√∫∑∏∂Δ∇≈≠≤≥“”—–")
CODE_KEYWORDS = (
    "import from def class return plt pd np os sys re sklearn tensorflow torch keras django flask request response self true false none try except "
    "finally with as if else elif for while in is not and or lambda print fig ax axes url http https com org net io"
).split()
MIN_WORDS, MAX_WORDS, TOP = 2, 5, 200


def is_valid_term(term: Column, forbidden: list[str]) -> Column:
    """Two to five words, no code, letters or digits at both ends, and not of forbidden words alone."""
    words = F.split(F.lower(term), " ")
    return (
        F.size(words).between(MIN_WORDS, MAX_WORDS)
        & ~term.rlike("[" + "".join("\\" + c if c.isascii() else c for c in INVALID_CHARS) + "]")
        & ~F.exists(words, lambda w: w.isin(CODE_KEYWORDS))
        & term.rlike(r"\p{L}")
        & term.rlike(r"^[\p{L}\p{N}]")
        & term.rlike(r"[\p{L}\p{N}]$")
        & F.exists(words, lambda w: ~w.isin(list(forbidden)))
    )


def title_case(term: Column) -> Column:
    """A capital after every character that is no letter, small letters elsewhere."""
    parts = F.regexp_extract_all(F.lower(term), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), F.substring(p, 2, 1 << 30))), "")


def matching(text: Column, terms: list[str]) -> Column:
    """array<string>: the terms a text contains, longest first, then by term; a term is met anywhere, not at word bounds only.

    The glossary is a user's term list (mined: TOP terms at most), so it goes into the plan as literals and needs no join.
    """
    low = F.lower(text)
    order = sorted(set(terms), key=lambda t: (-len(t), t))
    return F.filter(F.array(*map(F.lit, order)), lambda t: F.contains(low, F.lower(t))) if order else F.array().cast("array<string>")


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(words): lower-cased words of each sentence; documents under 100 characters are left out."""
    pure = docs.select(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("t")).where("length(t) > 100")
    each = pure.select(F.explode(F.split("t", r"[.!?]+")).alias("s"))
    words = F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return each.select(words.alias("words")).where("size(words) > 0")


def tfidf(sents: DataFrame, stop: list[str], persist: Callable[[DataFrame], DataFrame], top: int = TOP) -> DataFrame:
    """(term, score): the ``top`` runs of two to five words without a stop word, by mean tf-idf over all sentences (words); ties by term."""
    line = F.array_join(F.transform("words", lambda w: F.when(w.isin(stop), "\n").otherwise(w)), " ")
    units = ranking.distinct_units(sents.select(F.regexp_replace(line, " *\n[ \n]*", "\n").alias("unit")), persist)
    n = units.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    out = ranking.ranked(units, n, persist, top, MAX_WORDS)
    released(units)
    return out


def merged(new_terms: DataFrame, existing: DataFrame) -> DataFrame:
    """(term, translation, state): new terms with the translations there already are; ``state`` is added, kept or removed."""
    old = existing.select(title_case(F.col("term")).alias("term"), F.col("translation").alias("old")).groupBy("term").agg(F.max("old").alias("old"))
    met = new_terms.select("term", F.lit(True).alias("new")).distinct().join(old, "term", "full")
    state = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("kept")
    return met.select("term", F.when(F.col("new").isNotNull(), F.coalesce("old", F.lit(""))).alias("translation"), state.alias("state"))
