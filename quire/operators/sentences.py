"""Sentences by unsupervised abbreviation and collocation statistics (Kiss and Strunk's method), counted by Spark.

One pass over the corpus counts, for every word, its type, case and whether a period follows, together with what stands before it: one
aggregated table, from which everything else comes by small joins. Whether a period ends a sentence depends on the types on both of its sides
only, so the model is the table of pairs that a period doesn't part; texts are cut at every mark but where the table says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import bound

#: What may stand before a word, and after a mark.
OPENING, CLOSING = "\"'([{“‘«", "\"')]}”’»"
MARKS = ".?!,;:…"
NUMBER = "##number##"
# The method's thresholds for abbreviations, collocations and sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST = 1_000_000
_CUT, _SEP = "\u001e", "\u001f"
#: Texts that are cut together.
ROWS = 500


def pure(text: Column) -> Column:
    """White space (and the separators U+001C to U+001F) as one space each, none at the ends; a space that stands alone is no match, as nearly all are."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F&&[^ ]][\s\x1C-\x1F]*| [\s\x1C-\x1F]+", " "))


def word_facts(word: Column) -> Column:
    """struct<type, mark, case>: a word without what encloses it, small, numbers as one; how it ends (period, ellipsis, stop or nothing); upper, lower or no case."""
    core = F.rtrim(F.ltrim(word, F.lit(OPENING)), F.lit(CLOSING))
    body = F.rtrim(core, F.lit(MARKS))
    mark = F.when(core.endswith("?") | core.endswith("!"), "stop").when(core.endswith("..") | core.endswith("…"), "ellipsis").when(core.endswith("."), "period").otherwise("")
    first = F.substring(body, 1, 1)
    case = F.when(first != F.lower(first), "upper").when(first != F.upper(first), "lower").otherwise("")
    kind = F.when(body.rlike(r"^[0-9][0-9.,:/-]*$"), NUMBER).otherwise(F.lower(body))
    return F.struct(kind.alias("type"), mark.alias("mark"), case.alias("case"))


def is_initial(kind: Column) -> Column:
    return kind.rlike(r"^\p{L}$")


def worded(text: Column) -> Column:
    """Whether a text isn't blank: a cheap test, so that a filter on it repeats nothing."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1C-\x1F]"), F.lit(False))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(before, before_type, type, case, period, n): how often each word stands after each kind of word; ``before_type`` after periods only, where it matters.

    Words are counted as they stand, with the word before only if it ends in a mark; what they are is worked out for different ones.
    """
    pairs = bound(F.split(pure(F.col(text)), " "), lambda w: F.zip_with(F.concat(F.array(F.lit(_CUT)), F.slice(w, 1, F.size(w) - 1)), w, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    each = docs.where(worded(F.col(text))).select(F.explode(pairs).alias("x")).select("x.a", "x.b")
    ends = F.substring("a", -1, 1).isin(*_CUT, *".?!…", *CLOSING)
    raw = each.groupBy(F.when(ends, F.col("a")).otherwise(F.lit("")).alias("a"), "b").agg(F.count(F.lit(1)).alias("m"))
    facts = raw.select(F.col("a").alias("raw"), word_facts(F.col("a")).alias("a"), word_facts(F.col("b")).alias("b"), "m")
    before = F.when(F.col("raw") == _CUT, "start").otherwise(F.col("a.mark"))
    told = facts.select(before.alias("before"), F.when(before == "period", F.col("a.type")).alias("before_type"), F.col("b.type").alias("type"), F.col("b.case").alias("case"), (F.col("b.mark") == "period").alias("period"), "m")
    return told.groupBy("before", "before_type", "type", "case", "period").agg(F.sum("m").alias("n"))


def fitted(table: DataFrame) -> DataFrame:
    """The table, marked for a broadcast if it is small enough for one."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _log(p: Column) -> Column:
    return F.log(F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12)))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    return k * _log(p) + (n - k) * _log(1 - p)


def abbreviation_score(with_period: Column, without: Column, kind: Column, periods: Column, n: Column) -> Column:
    """How much more often a type has its period than words have one, less for long types and those that stand without it too."""
    k, whole = with_period.cast("double"), (with_period + without).cast("double")
    ratio = 2 * (_likelihood(k, whole, F.lit(0.99)) - _likelihood(k, whole, periods / n))
    inner = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    letters = (F.length(kind) - inner).cast("double")
    return ratio * F.exp(-letters) * (1 + inner) * F.pow(letters, -without.cast("double"))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio: that ``b`` depends on ``a``, of which there are a and b, together ``both``, in n words."""
    a, b, both, n = (c.cast("double") for c in (a, b, both, n))
    free = _likelihood(both, a, b / n) + _likelihood(b - both, n - a, b / n)
    tied = _likelihood(both, a, both / a) + _likelihood(b - both, n - a, (b - both) / (n - a))
    return 2 * (tied - free)


def is_loose(before_type: Column) -> Column:
    return (before_type == NUMBER) | is_initial(before_type)


@dataclass(frozen=True)
class Model:
    """abbreviations (type, score), starters (type, score), collocations (type, next, score), habits (type, and the cases it was met in), and ``joined``
    (before, before_type, type, case): where a mark ends no sentence, for the pairs of the texts it was trained on."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    habits: DataFrame
    joined: DataFrame

    def joins(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``joined`` for the pairs of other texts."""
        short = fitted(self.abbreviations.select(F.col("type").alias("before_type"), F.lit(True).alias("short")))
        pairs = word_counts(docs, text).where("before IN ('period', 'ellipsis')").join(short, "before_type", "left").withColumn("short", F.coalesce("short", F.lit(False)))
        return unparted(pairs, self.habits, self.starters, self.collocations)


def unparted(pairs: DataFrame, habits: DataFrame, starters: DataFrame, collocations: DataFrame) -> DataFrame:
    """(before, before_type, type, case) of those pairs (and ``short``: before_type is an abbreviation) that their mark doesn't part.

    After an abbreviation or an ellipsis a sentence begins with a word that is upper here and lower elsewhere, or a known starter in upper case. After a number or an initial none
    begins with a word that goes on in lower case, and after an initial none with a name. Collocations stay together.
    """
    loose = F.coalesce(is_loose(F.col("before_type")), F.lit(False))
    open_ = pairs.where(F.col("short") | loose | (F.col("before") == "ellipsis")).select("before", "before_type", "type", "case", "short").distinct()
    met = open_.join(habits, "type", "left").join(starters.select("type", F.lit(True).alias("starts")), "type", "left")
    met = met.join(collocations.select(F.col("type").alias("before_type"), F.col("next").alias("type"), F.lit(True).alias("tied")), ["before_type", "type"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    upper, lower, initial = F.col("case") == "upper", F.col("case") == "lower", F.coalesce(is_initial(F.col("before_type")), F.lit(False))
    begins = (F.col("type") != "") & upper & yes("any_lower") & ~yes("middle_upper")
    goes_on = (F.col("type") == "") | (~begins & lower & (yes("any_upper") | ~yes("begin_lower")))
    after_short = ~(begins | (upper & yes("starts")))
    after_loose = F.col("short") | goes_on | (~begins & initial & upper & ~yes("any_lower"))
    joins = yes("tied") | F.when((F.col("short") | (F.col("before") == "ellipsis")) & ~initial, after_short).otherwise(after_loose)
    return met.where(joins).select("before", F.coalesce("before_type", F.lit("")).alias("before_type"), "type", "case").distinct()


def train(docs: DataFrame, persist: Callable[[DataFrame], DataFrame], text: str = "text") -> Model:
    """The model of all texts; ``persist`` writes a table once (its size goes with the different words and pairs around periods, not with the texts).

    Null and blank texts count for nothing. Texts of several languages are one corpus: a type is an abbreviation in all of them or in none.
    """
    counts = persist(word_counts(docs, text))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("period"), F.col("n"))), F.lit(0)).alias("p")).first()  # two numbers
    n = F.lit(float(max(total["n"], 1)))
    types = persist(counts.where(F.col("type") != "").groupBy("type").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("period"), F.col("n"))), F.lit(0)).alias("with_period")))
    score = abbreviation_score(F.col("with_period"), F.col("n") - F.col("with_period"), F.col("type"), F.lit(float(total["p"])), n)
    lettered = (F.col("with_period") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}")
    abbreviations = persist(types.where(lettered).select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION))
    known = fitted(abbreviations.select(F.col("type").alias("before_type"), F.lit(True).alias("short")))
    marked = counts.where(F.col("before") == "period").join(known, "before_type", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    bare = counts.where(F.col("before") != "period").withColumn("short", F.lit(False))
    loose = is_loose(F.col("before_type"))
    at_break = (F.col("before") == "stop") | ((F.col("before") == "period") & ~F.col("short"))
    context = F.when(F.col("before") == "", "middle").when((F.col("before") == "start") | (at_break & ~F.coalesce(loose, F.lit(False))), "begin").otherwise("unknown")
    every = persist(marked.unionByName(bare).withColumns({"context": context, "at_break": at_break, "loose": F.coalesce(loose, F.lit(False))}))
    flag = lambda *when: F.bool_or(F.concat_ws(" ", "context", "case").isin(*when))
    habits = persist(every.where(F.col("type") != "").groupBy("type").agg(
        flag("begin lower").alias("begin_lower"), flag("middle upper").alias("middle_upper"), F.bool_or(F.col("case") == "upper").alias("any_upper"), F.bool_or(F.col("case") == "lower").alias("any_lower"),
        F.sum(F.when(F.col("at_break") & ~F.col("loose"), F.col("n")).otherwise(0)).alias("after_break"),
    ))
    breaks = float(every.agg(F.coalesce(F.sum(F.when(F.col("at_break"), F.col("n"))), F.lit(0)).alias("n")).first()["n"])
    b = F.lit(max(breaks, 1.0))
    begun = habits.where("after_break > 0").join(types, "type").where(F.col("type").rlike(r"^\p{L}+$"))
    starters = begun.select("type", association(b, F.col("n"), F.col("after_break"), n).alias("score"), (n / b > F.col("n") / F.col("after_break")).alias("more"))
    starters = persist(starters.where((F.col("score") >= STARTER) & F.col("more")).select("type", "score"))
    pairs = every.where("before = 'period' AND NOT short AND loose AND type <> ''").groupBy("before_type", "type").agg(F.sum("n").alias("both")).where("both > 1")
    ones = types.select(F.col("type").alias("before_type"), F.col("n").alias("a"))
    pairs = pairs.join(ones, "before_type").join(types.select("type", F.col("n").alias("b")), "type")
    tied = pairs.select("before_type", "type", association(F.col("a"), F.col("b"), F.col("both"), n).alias("score"), (n / F.col("a") > F.col("b") / F.col("both")).alias("more"))
    collocations = persist(tied.where((F.col("score") >= COLLOCATION) & F.col("more")).select("before_type", "type", "score"))
    collocations = collocations.select(F.col("before_type").alias("type"), F.col("type").alias("next"), "score")
    marks = every.where("before IN ('period', 'ellipsis')")
    return Model(abbreviations, starters, collocations, habits, persist(unparted(marks, habits, starters, collocations)))


def pieces(text: Column) -> Column:
    """The text cut after every word that ends in a mark; what is pure already."""
    return F.split(F.regexp_replace(text, r"([.?!…][\"')\]}”’»]*) ", "$1" + _CUT), _CUT)


_END = re.compile(r"""[.?!…]["')\]}”’»]* """)
_DIGITS = re.compile(r"[0-9][0-9.,:/-]*")


def facts_of(word: str) -> tuple[str, str, str]:
    """(type, mark, case) of one word, as ``word_facts`` gives them."""
    core = word.lstrip(OPENING).rstrip(CLOSING)
    body = core.rstrip(MARKS)
    mark = "stop" if core.endswith(("?", "!")) else "ellipsis" if core.endswith(("..", "…")) else "period" if core.endswith(".") else ""
    first = body[:1]
    case = "upper" if first != first.lower() else "lower" if first != first.upper() else ""
    return NUMBER if _DIGITS.fullmatch(body) else body.lower(), mark, case


def cut(text: str, joined: set[str], facts: Callable[[str], tuple[str, str, str]]) -> list[str]:
    """The sentences of a pure text."""
    out, begin, piece = [], 0, 0
    for m in _END.finditer(text):
        end = m.end() - 1
        kind, mark, _ = facts(text[max(piece, text.rfind(" ", piece, end) + 1) : end])
        piece = end + 1
        if mark == "period" or mark == "ellipsis":
            stop = text.find(" ", piece)
            then, _, case = facts(text[piece:stop] if stop >= 0 else text[piece:])
            if _SEP.join((mark, kind if mark == "period" else "", then, case)) in joined:
                continue
        out.append(text[begin:end])
        begin = piece
    out.append(text[begin:])
    return out


def split_sentences(docs: DataFrame, model: Model, key: str, text: str = "text", trained: bool = False) -> DataFrame:
    """(key, sentences array<string>) of every document whose text isn't blank; white space in them is squeezed.

    ``trained``: the model was trained on these very texts, so it knows all of their pairs. Each text is cut in its own row, without a shuffle, as long as the pairs that a mark
    doesn't part are ``BROADCAST`` at most; more of them are met by a join, with one shuffle of the texts, by key, which has to be unique.
    """
    joined = model.joined if trained else model.joins(docs, text)
    known = joined.select(F.concat_ws(_SEP, "before", "before_type", "type", "case").alias("pair")).limit(BROADCAST + 1).toArrow().column(0).combine_chunks()
    if len(known) > BROADCAST:
        return _split_by_join(docs, joined, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = set(shared.value.to_pylist())
        facts = lru_cache(1 << 16)(facts_of)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([cut(t, pairs, facts) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], names=["key", "sentences"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(worded(F.col(text))).select(F.col(key).alias("key"), pure(F.col(text)).alias("text"))
    return rows.mapInArrow(each, f"key {kind}, sentences array<string>").withColumnRenamed("key", key)


def _split_by_join(docs: DataFrame, joined: DataFrame, key: str, text: str) -> DataFrame:
    """As ``split_sentences``: every piece meets its pair in ``joined``, and the pieces their document."""
    with_next = bound(pieces(pure(F.col(text))), lambda p: F.zip_with(p, F.slice(p, 2, 1 << 30), lambda a, b: F.struct(a.alias("piece"), b.alias("then"))))
    each = docs.where(worded(F.col(text))).select(key, F.posexplode(with_next).alias("pos", "x")).select(key, "pos", "x.piece", word_facts(F.substring_index("x.piece", " ", -1)).alias("a"), word_facts(F.substring_index("x.then", " ", 1)).alias("b"))
    before_type = F.when(F.col("a.mark") == "period", F.col("a.type")).otherwise("")
    keyed = each.select(key, "pos", "piece", F.col("a.mark").alias("before"), before_type.alias("before_type"), F.col("b.type").alias("type"), F.col("b.case").alias("case"))
    met = keyed.join(fitted(joined).withColumn("goes_on", F.lit(True)), ["before", "before_type", "type", "case"], "left")
    whole = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "piece", F.col("goes_on").isNotNull().alias("goes_on")))).alias("p"))
    # pieces that go on are ended by a space, others by the cut, so that one split gives the sentences
    joined = F.array_join(F.transform("p", lambda x, i: F.concat(x["piece"], F.when(i + 1 == F.size("p"), "").when(x["goes_on"], " ").otherwise(_CUT))), "")
    return whole.select(key, F.split(joined, _CUT).alias("sentences"))
