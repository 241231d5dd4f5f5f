"""Quality rules with n-gram perplexity bands (operator 10).

The language model counts 4-grams of code points, for each language by itself, over every text; texts without a language share
one model of their own. Its tables grow with the corpus and stay in Spark: modified Kneser-Ney, from continuation
counts at the lower orders, is a few joins over the different n-grams, and gives each n-gram that occurs its bits. As every text is
counted, every n-gram that is scored is in the table.

For scoring, the table lies in sorted arrays of n-grams, one pair of arrays a language: all of them at once in every task, if
they have BROADCAST entries at most; else documents are dealt into bundles, and a bundle gets the entries
that it holds, by a join. Both ways give the same numbers. A document whose perplexity lies outside its language's band is
rejected. The band is median +- ``width`` robust deviations of the log-perplexities of all documents of the
language that the base rules pass, so clean text stays whatever its absolute perplexity is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and, written
from quire.llm.textbuf import LOWER, SPACE, U, Texts, runs, sums, window_starts, windows

#: Symbols are 16 bits wide, so that an n-gram is one 64-bit number, its context and its end are parts of it.
BITS, ORDER = 16, 4
#: The most n-grams that go to every task as arrays (12 bytes each).
BROADCAST = 2_000_000
#: Different n-grams that a task gathers before it hands them on, and bytes of text of a bundle.
GATHER, BUNDLE = 1_000_000, 24 << 20
#: The band's half width in robust deviations, and the least deviation (bits a character) it is measured in.
WIDTH, LEAST = 12.0, 0.02
#: Log-perplexities are counted in bins of this many bits.
BIN = 1 / 1024

SYMBOL = np.zeros(256, np.uint8)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1


def _symbols() -> np.ndarray:
    """Code points of the first plane: small letters for A to Z, one white space, one digit, the others as they are."""
    out = np.arange(1 << 16, dtype=np.uint16)
    out[65:91] += 32
    out[np.flatnonzero(SPACE)] = 32
    out[48:58] = 48
    return out


SYMBOLS = _symbols()


def codes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each code point (white space stands before the first), in document order, and where each document's begin.

    Code points beyond the first plane share the 2048 values that UTF-16 leaves to surrogates, by a hash.
    """
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    at = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))[texts.at]
    symbol = SYMBOLS[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    symbol[high] = 0xD800 + (points[high].astype(U) * U(0x9E3779B97F4A7C15) >> U(53))
    pad = ORDER - 1
    line = np.full(at[-1] + pad * (texts.n + 1), 32, U)
    place = np.arange(len(points)) + pad * np.repeat(np.arange(1, texts.n + 1), np.diff(at))
    line[place] = symbol
    code = line.copy()
    for k in range(1, ORDER):
        code[k:] |= line[:-k] << U(BITS * k)
    return code[place].view(np.int64), at


def _lang_ids(column: pa.Array) -> dict[str, np.ndarray]:
    """The rows of each language."""
    values = column.dictionary_encode()
    of = values.indices.to_numpy(zero_copy_only=False)
    return {name: np.flatnonzero(of == i) for i, name in enumerate(values.dictionary.to_pylist())}


def _of_rows(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places at[r] to at[r + 1] of each of the rows."""
    n = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lk, key, n): how often each 4-gram is in all texts of a language (``lk``); summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        new: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge() -> None:
            for name, pieces in new.items():
                pieces += [kept[name]] if name in kept else []
                key, back = np.unique(np.concatenate([k for k, _ in pieces]), return_inverse=True)
                kept[name] = key, np.bincount(back, np.concatenate([n for _, n in pieces]), len(key)).astype(np.int64)
            new.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for name, (key, n) in kept.items():
                for i in range(0, len(key), 50_000):
                    k = key[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k), pa.array(n[i : i + 50_000])], names=["lk", "key", "n"])
            kept.clear()

        seen = 0
        for batch in batches:
            for part, texts in runs(batch):
                code, at = codes(texts)
                for name, rows in _lang_ids(part.column(1)).items():
                    new.setdefault(name, []).append(np.unique(code[_of_rows(rows, at)], return_counts=True))
                    seen += len(new[name][-1][0])
                if seen > GATHER:
                    merge()
                    seen = 0
                    if sum(len(k) for k, _ in kept.values()) > GATHER:
                        yield from out()
        merge()
        yield from out()

    return docs.select("text", "lk").mapInArrow(count, "lk string, key long, n long").groupBy("lk", "key").agg(F.sum("n").alias("n"))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """(lk, key, bits): -log2 of each 4-gram's probability, given its first three symbols, by modified Kneser-Ney."""
    of_order = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before
        low = F.col("key").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("key")
        of_order[k] = of_order[k + 1].select("lk", low).groupBy("lk", "key").agg(F.count(F.lit(1)).alias("n"))
    found = of_order[1].groupBy("lk").agg((1 / (F.count(F.lit(1)) + 1)).alias("lower"))
    for k in range(1, ORDER + 1):
        often = [F.sum((F.col("n") == i).cast("long")).alias(f"c{i}") for i in range(1, 5)]
        y = "(c1 / greatest(1, c1 + 2 * c2))"
        cut = lambda i: f"least(greatest({i} - {i + 1} * {y} * c{i + 1} / greatest(1, c{i}), 0.05), {i - 0.05})"
        discounts = of_order[k].groupBy("lk").agg(*often).select("lk", *(F.expr(cut(i)).alias(f"d{i}") for i in (1, 2, 3)))
        mine = of_order[k].join(discounts, "lk").withColumn("cut", F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")).drop("d1", "d2", "d3")
        mine = mine.withColumn("context", F.shiftrightunsigned("key", BITS))
        context = mine.groupBy("lk", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("gone"))
        mine = mine.join(context, ["lk", "context"])
        if k > 1:
            mine = mine.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1)))
            mine = mine.join(found.withColumnRenamed("key", "low"), ["lk", "low"])
        else:
            mine = mine.join(found, "lk")
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gone") / F.col("total") * F.col("lower")
        found = mine.select("lk", "key", p.alias("lower"))
    return found.select("lk", "key", (-F.log2("lower")).alias("bits"))


def facts(texts: Texts) -> dict[str, np.ndarray]:
    """The base rules' counts for each document."""
    texts.words()
    data, at, of = texts.data, texts.at, texts.of
    word_byte = ~SPACE[data]
    head = (data & 0xC0) != 0x80
    h = texts.hashed(texts.start, texts.end)
    # words in a 3-word window that the document has twice or more
    first, per = window_starts(of, texts.n_words, 3)
    tri = windows(h, 3)[first] if len(first) else np.empty(0, U)
    doc = np.repeat(np.arange(texts.n), per)
    order = np.lexsort((tri, doc))
    same = np.zeros(len(tri) + 1, bool)
    same[1:-1] = (tri[order[1:]] == tri[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = first[order[same[:-1] | same[1:]]]
    step = np.zeros(len(texts.start) + 4, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + 3, -1)
    covered = (np.cumsum(step)[: len(texts.start)] > 0).astype(np.int64)
    # lines with a word that equal an earlier line
    cuts = np.flatnonzero(data == 10)
    line_doc = np.concatenate((np.arange(texts.n), np.searchsorted(at, cuts, side="right") - 1))
    line_begin = np.concatenate((at[:-1], cuts + 1))
    by = np.lexsort((line_begin, line_doc))
    line_doc, begin = line_doc[by], line_begin[by]
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    end[-1:] = len(data) + 1
    last = np.ones(len(begin), bool)
    last[:-1] = line_doc[1:] != line_doc[:-1]
    end = np.where(last, at[line_doc + 1], end - 1)
    has_word = np.searchsorted(texts.start, end) > np.searchsorted(texts.end - 1, begin)
    lh = texts.hashed(begin, end)
    sort = np.lexsort((begin, lh, line_doc))
    repeat = np.zeros(len(begin), np.int64)
    eq = (lh[sort[1:]] == lh[sort[:-1]]) & (line_doc[sort[1:]] == line_doc[sort[:-1]])
    repeat[sort[1:][eq]] = 1
    return {
        "n_words": texts.n_words.astype(np.int64),
        "word_chars": sums((word_byte & head).astype(np.int64), at),
        "n_symbols": sums(SYMBOL[data].astype(np.int64), at),
        "n_dup_lines": np.bincount(line_doc, repeat * has_word, texts.n).astype(np.int64),
        "n_repeat_words": sums(covered, of),
    }


FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
Model = dict[str, tuple[np.ndarray, np.ndarray]]


def sorted_arrays(table: pa.Table) -> Model:
    """The model's (lk, key, bits) as two arrays a language, in the order of the n-grams."""
    names = table.column("lk").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    of, key, bits = names.indices.to_numpy(zero_copy_only=False), table.column("key").to_numpy(), table.column("bits").to_numpy()
    order = np.lexsort((key, of))
    cut = np.searchsorted(of[order], np.arange(len(names.dictionary) + 1))
    return {n: (key[order[i:j]], bits[order[i:j]].astype(np.float32)) for n, i, j in zip(names.dictionary.to_pylist(), cut[:-1], cut[1:], strict=True)}


SCORED = f"doc_id long, lang string, {', '.join(f'{c} long' for c in FACTS)}, bits double"


def scores(part: pa.RecordBatch, texts: Texts, model: Model) -> pa.RecordBatch:
    """Base counts and mean bits of a run of (doc_id, text, lang, lk)."""
    found = facts(texts)
    code, at = codes(texts)
    bits = np.zeros(len(code))
    for name, rows in _lang_ids(part.column(3)).items():
        mine = _of_rows(rows, at)
        if len(mine):
            key, which = np.unique(code[mine], return_inverse=True)
            keys, values = model[name]
            bits[mine] = values[np.searchsorted(keys, key)][which]
    mean = sums(bits, at) / np.maximum(np.diff(at), 1)
    return pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(found[c]) for c in FACTS), pa.array(mean)], names=["doc_id", "lang", *FACTS, "bits"])


def scored_by_all(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Every document's scores, with the whole model in each task."""
    arrays = docs.sparkSession.sparkContext.broadcast(sorted_arrays(model.toArrow()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch):
                yield scores(part, texts, arrays.value)

    return docs.mapInArrow(each, SCORED)


def scored_in_bundles(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same with a model of any size: documents dealt by a hash, and each bundle with its own n-grams."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = docs.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // BUNDLE)))))

    def grams(table: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {}
        for batch in table.select(["text", "lk", "bundle"]).to_batches(max_chunksize=1000):
            for part, texts in runs(batch):
                code, at = codes(texts)
                for name, rows in _lang_ids(part.column(1)).items():
                    found.setdefault(name, []).append(np.unique(code[_of_rows(rows, at)]))
        keys = {n: np.unique(np.concatenate(k)) for n, k in found.items()}
        whole = np.concatenate([np.empty(0, np.int64), *keys.values()])
        return pa.table({"bundle": pa.array(np.full(len(whole), table.column("bundle")[0].as_py())), "lk": pa.array([n for n, k in keys.items() for _ in range(len(k))], pa.string()), "key": whole})

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        arrays, out = sorted_arrays(right), []
        for batch in left.select(["doc_id", "text", "lang", "lk"]).to_batches(max_chunksize=1000):
            out += [scores(part, texts, arrays) for part, texts in runs(batch)]
        return pa.Table.from_batches(out)

    held = dealt.groupBy("bundle").applyInArrow(grams, "bundle long, lk string, key long").join(model, ["lk", "key"])
    return dealt.groupBy("bundle").cogroup(held.groupBy("bundle")).applyInArrow(each, SCORED)


def score_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 50, max_repeat: int = 50, width: float = WIDTH) -> DataFrame:
    """The base counts, the perplexity and the verdict for every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, bits (a
    character, under the language's model), low and high (the language's band).

    Null text: no words, base_failed, not kept. Null lang: a model and a band of its own. Empty texts:
    as null. Very long texts are scored whole, each in a run of its own. Null and repeated doc_ids: a result row for each input row. Empty table: no rows. Other columns
    are not looked at. A language none of whose documents pass the base rules has no band; nothing is kept then.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")).alias("lk")
    docs = id_and(docs, key, text, lang, name).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), "lk")
    model = written(kneser_ney(written(count_ngrams(docs), "quality-counts")), "quality-model")
    scored = scored_by_all(docs, model) if model.count() <= BROADCAST else scored_in_bundles(docs, model)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    scored = written(scored.withColumn("base_failed", failed), "quality")
    # the bits a character lie between 0 and some 20, so there are few bins a language
    bins = scored.where("not base_failed").groupBy("lang", F.floor(F.col("bits") / BIN).alias("bin")).count()

    def limits(table: pa.Table) -> pa.Table:
        low, high = band(table.column("bin").to_numpy(), table.column("count").to_numpy(), width)
        return pa.table({"its": table.column("lang")[:1].combine_chunks(), "low": [low], "high": [high]})

    bands = bins.groupBy("lang").applyInArrow(limits, "its string, low double, high double")
    out = scored.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("its")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", *FACTS, "base_failed", kept.alias("kept"), "bits", "low", "high")


def weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values)
    total = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def band(bins: np.ndarray, counts: np.ndarray, width: float) -> tuple[float, float]:
    """Median -+ width robust deviations, in bits a character."""
    bits = (bins + 0.5) * BIN
    middle = weighted_median(bits, counts)
    spread = max(LEAST, 1.4826 * weighted_median(np.abs(bits - middle), counts))
    return middle - width * spread, middle + width * spread


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document of ``documents``."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *FACTS, "base_failed", "kept", "bits")
