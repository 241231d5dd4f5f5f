"""Glossary mining from end to end: pure text, sentences, tagged words, noun phrases, valid terms, their ranking, and the glossary file.

A word's tag comes from a lexicon, else from its longest listed suffix; both are tables. A noun phrase is any number of adjectives
and then nouns, as many as there are. Tags don't depend on the place, so every occurrence of a candidate lies within some noun phrase: only
those are searched for terms, not the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import glossary, ranking
from quire.operators.sentences import BROADCAST, Model, fitted, pure, split_sentences, train
from quire.sources.tables import Scratch, released

# Elements whose text is no prose.
DROPPED = ["pre", "code", "figure", "figcaption", "table", "script", "style", "a", "header", "footer", "nav"]
LEAST_CHARS = 100
#: A word with inner hyphens, apostrophes and periods, or one other visible character.
WORD = r"[\p{L}\p{N}_]+(?:[-'’.][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"
ADJECTIVE, NOUN, OTHER = "J", "N", "O"
_PHRASE = re.compile(rb"J*+N++")
#: A lexicon of closed classes and of everyday verbs and adverbs; a parameter, to be replaced by a full one.
LEXICON = {
    OTHER: (
        "a an the this that these those each every some any no all both either neither i you he she it we they me him her us them my your his its our their who whom whose which what "
        "of in on at by for from to with without into onto over under between through during before after about against among as than like per via and or but nor so yet if because while "
        "although though unless until when where why how whether not very too also just only even still then there here now once again always never often "
        "be am is are was were been being do does did done have has had having can could may might must shall should will would let make made get got go went see saw use used say said"
    ).split(),
    ADJECTIVE: "new old good bad great small large big long short high low first last next other same different early late young important public able free full open".split(),
}
SUFFIXES = {
    OTHER: ["ing", "ed", "ly", "ize", "ise", "ify"],
    ADJECTIVE: ["ous", "ful", "ive", "able", "ible", "al", "ic", "ish", "less", "ary", "ant", "ent"],
    NOUN: ["tion", "sion", "ment", "ness", "ity", "ism", "ist", "er", "or", "ship", "hood", "age", "ance", "ence"],
}


def tag_tables(spark: SparkSession, lexicon: dict[str, list[str]] | None = None, suffixes: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(word, tag) and (suffix, tag), each key once."""
    rows = lambda table: [(w, tag) for tag, words in table.items() for w in words]
    return spark.createDataFrame(rows(LEXICON if lexicon is None else lexicon), "word string, tag string"), spark.createDataFrame(rows(SUFFIXES if suffixes is None else suffixes), "suffix string, tag string")


def purified(parsed: DataFrame, key: str) -> DataFrame:
    """(key, text): what a document says in prose: text nodes outside of listed elements, joined by spaces, squeezed; documents of over 100 characters.

    An element's descendants are an interval of node numbers, so one pass in document order keeps the end of the last dropped subtree.
    """
    start = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        inside = n["node_id"] <= acc["upto"]
        drops = ~inside & (n["kind"] == "element") & F.lower(n["name"]).isin(DROPPED)
        taken = ~inside & n["kind"].isin("text", "cdata")
        return F.struct(F.when(drops, n["last_desc"]).otherwise(acc["upto"]).alias("upto"), F.when(taken, F.array_append(acc["out"], n["text"])).otherwise(acc["out"]).alias("out"))

    slim = F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), n["last_desc"].alias("last_desc"), n["kind"].alias("kind"), n["name"].alias("name"), n["text"].alias("text")))
    text = F.aggregate(slim, start, step, lambda acc: F.array_join(acc["out"], " "))
    return parsed.select(key, pure(text).alias("text")).where(F.length("text") > LEAST_CHARS)


def word_tags(words: DataFrame, lexicon: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(word, tag) of different words (word): from the lexicon, else by the longest suffix that leaves two letters, else a noun; what is no word, a number, or a part of one is other."""
    longest = suffixes.agg(F.coalesce(F.max(F.length("suffix")), F.lit(0))).first()[0]
    ends = F.transform(F.sequence(F.lit(1), F.lit(max(longest, 1))), lambda k: F.when(k + 2 <= F.length("word"), F.substring("word", -k, k)))
    tails = words.select("word", F.explode(ends).alias("suffix")).where("suffix IS NOT NULL")
    best = tails.join(F.broadcast(suffixes), "suffix").groupBy("word").agg(F.max_by("tag", F.length("suffix")).alias("by_suffix"))
    met = words.join(lexicon.withColumnRenamed("tag", "by_word"), "word", "left").join(best, "word", "left")
    plain = F.col("word").rlike(r"^\p{L}")
    return met.select("word", F.when(~plain, OTHER).otherwise(F.coalesce("by_word", "by_suffix", F.lit(NOUN))).alias("tag"))


def tagger(lexicon: dict[str, str], suffixes: dict[str, str]) -> Callable[[str], str]:
    """The tag of a word, as ``word_tags`` gives it."""
    longest = max(map(len, suffixes), default=0)

    def tag(word: str) -> str:
        if not word[:1].isalpha():
            return OTHER
        if word in lexicon:
            return lexicon[word]
        for k in range(min(longest, len(word) - 2), 0, -1):
            if (found := suffixes.get(word[-k:])) is not None:
                return found
        return NOUN

    return tag


def noun_phrases(sents: DataFrame, key: str, lexicon: DataFrame, suffixes: DataFrame, persist: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, nth, phrases array<array<string>>) of every sentence of (key, sentences): adjectives and then nouns, small letters, the longest from left to right.

    Different words are tagged once a batch, in the sentences' own rows: a lexicon of up to ``BROADCAST`` words goes to every task. A larger one is met by a join with
    the different words, written by ``persist``. The grammar runs over a sentence's tags; its quantifiers give nothing back, so that long sentences take no stack.
    """
    each = sents.select(key, F.posexplode("sentences").alias("nth", "s"))
    words = each.select(key, "nth", F.regexp_extract_all(F.lower("s"), F.lit(WORD), F.lit(0)).alias("words"))
    known = lexicon.limit(BROADCAST + 1).collect()
    if len(known) > BROADCAST:
        return _phrases_by_join(persist(words), key, lexicon, suffixes, persist)
    shared = sents.sparkSession.sparkContext.broadcast((dict(map(tuple, known)), dict(map(tuple, suffixes.collect()))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = tagger(*shared.value)
        for batch in batches:
            lists = batch.column(2)
            coded = lists.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            code = coded.indices.to_numpy(zero_copy_only=False)
            tags = np.frombuffer("".join(map(tag, names)).encode(), np.uint8)[code] if len(code) else np.empty(0, np.uint8)
            of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            # a sentence ends where another begins: each has one more tag, of its end
            line = np.full(len(tags) + len(batch), ord("|"), np.uint8)
            line[np.arange(len(tags)) + of] = tags
            spans = np.array([m.span() for m in _PHRASE.finditer(line.tobytes())], np.int64).reshape(-1, 2)
            place = np.cumsum(line == ord("|"))
            row = place[spans[:, 0]]  # the sentence, by the ends before it
            low, size = spans[:, 0] - row, spans[:, 1] - spans[:, 0]
            first, count = np.unique(row, return_counts=True)
            inner = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            flat = pa.DictionaryArray.from_arrays(pa.array(code[inner], pa.int32()), coded.dictionary).cast(pa.string())
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat)
            phrases = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), runs)
            rows = batch.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), phrases], names=["key", "nth", "phrases"])

    kind = sents.schema[key].dataType.simpleString()
    out = words.withColumnRenamed(key, "key").mapInArrow(found, f"key {kind}, nth int, phrases array<array<string>>")
    return out.withColumnRenamed("key", key)


def _phrases_by_join(words: DataFrame, key: str, lexicon: DataFrame, suffixes: DataFrame, persist: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``noun_phrases``, from (key, nth, words), with tags of the different words met by a join; each word is followed by its tag."""
    listed = words.select(key, "nth", F.posexplode("words").alias("pos", "word"))
    tags = fitted(persist(word_tags(listed.select("word").distinct(), lexicon, suffixes).where(F.col("tag") != OTHER)))
    told = listed.join(tags, "word").groupBy(key, "nth").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("w"))
    # a gap in the places is a word of another tag
    gap = lambda x, i: F.when((i > 0) & (F.get(F.col("w"), i - 1)["pos"] + 1 != x["pos"]), "| ").otherwise("")
    line = F.array_join(F.transform("w", lambda x, i: F.concat(gap(x, i), x["word"], F.lit("/"), x["tag"], F.lit(" "))), "")
    found = F.regexp_extract_all(line, F.lit("(?:[^ /|]+/J )*+(?:[^ /|]+/N )++"), F.lit(0))
    return told.select(key, "nth", F.transform(found, lambda p: F.split(F.regexp_replace(F.trim(p), "/[JN]", ""), " ")).alias("phrases")).where("size(phrases) > 0")


def ranked_terms(phrases: DataFrame, key: str, n_sentences: int, forbidden: list[str], persist: Callable[[DataFrame], DataFrame], top: int = glossary.TOP) -> DataFrame:
    """(term, score): the ``top`` valid phrases by mean tf-idf over all sentences: smoothed idf, each sentence at length one, ties by term.

    Candidates are the valid phrases; they count wherever they stand within a phrase.
    """
    first, last = glossary.MIN_WORDS, glossary.MAX_WORDS
    runs = phrases.select(F.transform(F.filter("phrases", lambda p: F.size(p) >= first), lambda p: F.array_join(p, " ")).alias("p")).where("size(p) > 0")
    valid = lambda p: F.when((F.size(F.split(p, " ")) <= last) & glossary.is_valid_term(p, forbidden), "1").otherwise("0")
    units = ranking.distinct_units(runs.select(F.array_join("p", "\n").alias("unit")), persist, F.array_join(F.transform(F.split("unit", "\n"), valid), ""))
    released(phrases)  # of which the units are all that counts
    out = ranking.ranked(units, n_sentences, persist, top, last, whole_only=True)
    released(units)
    return out


def mined(docs: DataFrame, key: str, forbidden: list[str], persist: Callable[[DataFrame], DataFrame], lexicon: DataFrame | None = None, suffixes: DataFrame | None = None, model: Model | None = None, top: int = glossary.TOP) -> DataFrame:
    """(term, score): the ranked terms of documents (key, text), title-cased, of equal ones the better; the sentence model is trained on the same texts unless given.

    Null, blank and short texts (100 characters or fewer) give nothing; no documents, no terms. Keys have to be unique.
    """
    own = tag_tables(docs.sparkSession)
    # by an explode, so that conditions on the pure text don't make it again
    texts = docs.select(key, F.explode(F.filter(F.array(pure(F.col("text"))), lambda t: F.length(t) > LEAST_CHARS)).alias("text"))
    step = Scratch(persist)  # a step's tables go as soon as its result is written
    own_model = train(texts, step) if model is None else model
    sents = persist(split_sentences(texts, own_model, key, trained=model is None))
    step.clear()
    n = sents.agg(F.coalesce(F.sum(F.size("sentences")), F.lit(0))).first()[0]
    phrases = persist(noun_phrases(sents, key, own[0] if lexicon is None else lexicon, own[1] if suffixes is None else suffixes, step))
    step.clear()
    released(sents)
    terms = ranked_terms(phrases, key, n, forbidden, persist, top)
    return terms.groupBy(glossary.title_case(F.col("term")).alias("term")).agg(F.max("score").alias("score"))


def empty_glossary(terms: DataFrame) -> dict[str, str]:
    """{term: ""} of mined terms, by term; there are TOP of them at most."""
    return {t["term"]: "" for t in terms.select("term").orderBy("term").collect()}


def write_glossary(terms: DataFrame, path: str) -> DataFrame:
    """Merges mined terms (term) with the glossary at ``path``, if there is one, and puts the file in its place; the merge as ``glossary.merged``.

    The file is one JSON object by term, indented by four, small by construction (TOP terms). It is written under another name and then renamed, so a reader
    never finds half of it. A file that can't be read counts as none.
    """
    from quire.sources.files import read_text, replace_file

    spark = terms.sparkSession
    try:
        old = json.loads(read_text(spark, path) or "{}")
        old = old if isinstance(old, dict) else {}
    except ValueError:
        old = {}
    existing = spark.createDataFrame([(k, v) for k, v in old.items() if isinstance(v, str) and v] or [("", "")], "term string, translation string").where("term <> ''")
    known = spark.createDataFrame([(k, "") for k in old] or [("", "")], "term string, translation string").where("term <> ''")
    state = glossary.merged(terms.select("term"), existing.unionByName(known))
    rows = state.where("state <> 'removed'").orderBy("term").collect()
    replace_file(spark, path, json.dumps({r["term"]: r["translation"] for r in rows}, indent=4, ensure_ascii=False))
    return state
