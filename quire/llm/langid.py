"""Language identification by a linear-chain conditional random field (operator 4).

Every word of a text is labelled: its score for a language is the sum of the weights of its hashed features (affixes,
byte n-grams and the word itself as a lexicon entry), and learned transitions tie neighbours together, so stretches of a
code-switched text keep their own labels. Forward-backward over the whole text gives each word's marginals; a
document's language is the one with the largest sum of them, its score their mean.

The field is fitted in one task by gradient steps on the log-likelihood, on a bounded sample: at most PER_LANG
labelled documents of each of at most MAX_LANGS languages, drawn by a hash of the id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.tables import id_and
from quire.llm.textbuf import LOWER, Texts, U, buffer_of, mix, runs

BUCKETS = 1 << 16
PER_LANG, MAX_LANGS = 150, 64
SEGMENT, BATCH, EPOCHS, RATE = 32, 256, 4, 0.3
UNKNOWN = "und"
#: Parts in which a language's draws are ordered.
PARTS = 64


@dataclass
class Field:
    """Languages in order, feature weights [BUCKETS, K], transitions [K, K] and start weights [K]."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature of the words at start to end of ``data``; ``word``: their hashes."""
    low = LOWER[data].astype(U)
    size = end - start
    byte = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    of, left = np.repeat(np.arange(len(size)), size), np.repeat(end, size) - byte
    pad = np.concatenate((low, np.zeros(4, U)))
    who, key = [np.arange(len(size))], [word]
    gram = pad[byte]
    for n in range(2, 5):  # n-grams within the word; those at its ends once more, as affixes
        gram = gram << U(8) | pad[byte + n - 1]
        fits = left >= n
        tagged = gram[fits] | U(n << 56)
        who.append(of[fits])
        key.append(tagged)
        at_end = left[fits] == n
        who.append(of[fits][at_end])
        key.append(tagged[at_end] | U(1 << 48))
        at_start = byte[fits] == start[of[fits]]
        who.append(of[fits][at_start])
        key.append(tagged[at_start] | U(1 << 49))
    who, key = np.concatenate(who), np.concatenate(key)
    order = np.argsort(who, kind="stable")
    return who[order], (mix(key[order]) & U(BUCKETS - 1)).astype(np.int64)


def distinct(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the different words of the texts, as (word, bucket), and which of them each word is."""
    texts.words()
    h = texts.hashed(texts.start, texts.end, lower=True)
    word, one, which = np.unique(h, return_index=True, return_inverse=True)
    who, bucket = features(texts.data, texts.start[one], texts.end[one], word)
    return who, bucket, which


def emissions(who: np.ndarray, bucket: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    if not n:
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[bucket], np.searchsorted(who, np.arange(n)), axis=0)


def scaled(score: np.ndarray) -> np.ndarray:
    return np.exp(score - score.max(-1, keepdims=True))


def marginals(e: np.ndarray, first: np.ndarray, size: np.ndarray, moves: np.ndarray, start: np.ndarray, forward: np.ndarray | None = None) -> np.ndarray:
    """Each word's label marginals, by forward-backward over every sequence at once: step t handles the t-th word of all that have one.

    ``forward``, if given, takes each word's filtered distribution, from the words up to it alone."""
    longest = np.argsort(-size, kind="stable")
    first, size = first[longest], size[longest]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    a, out = np.exp(moves).astype(np.float32), np.empty_like(e)
    state = np.exp(start).astype(np.float32)[None, :]
    for t, n in enumerate(alive.tolist()):
        at = first[:n] + t
        state = e[at] * (state[:n] if t else state)
        state /= state.sum(1, keepdims=True)
        out[at] = state
        state = state @ a
    if forward is not None:
        forward[:] = out
    back = np.ones((0, e.shape[1]), np.float32)
    for t in range(len(alive) - 1, -1, -1):
        n = int(alive[t])
        if len(back) < n:  # those that end here
            back = np.concatenate((back, np.ones((n - len(back), e.shape[1]), np.float32)))
        at = first[:n] + t
        both = out[at] * back
        out[at] = both / both.sum(1, keepdims=True)
        back = (e[at] * back) @ a.T
        back /= back.sum(1, keepdims=True)
    return out


def pair_marginals(filtered: np.ndarray, after: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """[n, K, K] odds of each label and the next, from the filtered distribution of the one word and the marginals of the next."""
    a = np.exp(moves)
    pair = filtered[:, :, None] * a[None] * (after / np.maximum(filtered @ a, 1e-30))[:, None, :]
    return pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-30)


def fit(texts: list[str], labels: list[str]) -> Field:
    """The field that (nearly) maximises the likelihood of labelling each text's words with its label; AdaGrad over segments."""
    langs = sorted(set(labels))
    k = len(langs)
    weights, moves, start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    moves[np.diag_indices(k)] = 2.0
    squares = [np.full_like(x, 1e-2) for x in (weights, moves, start)]
    data, at = buffer_of(pa.array(texts, pa.large_string()))
    held = Texts(data, at)
    who, bucket, which = distinct(held)
    of = np.searchsorted(who, np.arange(int(which.max()) + 2 if len(which) else 1))
    gold = np.repeat(np.array([langs.index(x) for x in labels], np.int64), held.n_words)
    per = np.maximum(0, held.n_words) // SEGMENT  # whole segments; the rest of a text is a shorter one
    segments = [(held.of[d] + i * SEGMENT, min(SEGMENT, held.n_words[d] - i * SEGMENT)) for d in range(held.n) for i in range(per[d] + 1) if held.n_words[d] > i * SEGMENT]
    rng = np.random.default_rng(7)
    segments = np.array(segments, np.int64).reshape(-1, 2)
    for _ in range(EPOCHS):
        rng.shuffle(segments)
        for i in range(0, len(segments), BATCH):
            first, size = segments[i : i + BATCH].T
            n_all = int(size.sum())
            place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(n_all)
            words, inverse = np.unique(which[place], return_inverse=True)
            n_of = of[words + 1] - of[words]
            feature = bucket[np.repeat(of[words] - (np.cumsum(n_of) - n_of), n_of) + np.arange(n_of.sum())]
            owner = np.repeat(np.arange(len(words)), n_of)
            e = scaled(emissions(owner, feature, len(words), weights)[inverse])
            begin = np.cumsum(size) - size
            filtered = np.empty_like(e)
            p = marginals(e, begin, size, moves, start, filtered)
            want = np.zeros_like(p)
            want[np.arange(n_all), gold[place]] = 1
            gap = want - p
            inner = np.ones(n_all, bool)
            inner[begin] = False
            later = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[place[later - 1]], gold[place[later]]), 1)
            pair = pair_marginals(filtered[later - 1], p[later], moves)
            by_word = np.stack([np.bincount(inverse, gap[:, j], len(words)) for j in range(k)], 1)
            touched, slot = np.unique(feature, return_inverse=True)
            grad = np.stack([np.bincount(slot, by_word[owner, j], len(touched)) for j in range(k)], 1) / len(size)
            squares[0][touched] += grad**2
            weights[touched] += RATE * grad / np.sqrt(squares[0][touched])
            for x, s, g in ((moves, squares[1], (seen - pair.sum(0)) / len(size)), (start, squares[2], gap[begin].mean(0))):
                s += g**2
                x += 0.1 * RATE * g / np.sqrt(s)
    return Field(langs, weights, moves, start)


def sample(docs: DataFrame, learn: Column) -> DataFrame:
    """(text, lang, draw) of at most PER_LANG documents of each of the MAX_LANGS most frequent languages among those to learn from."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    drawn = labelled.select("lang", F.xxhash64("doc_id", "text").alias("draw")).distinct()
    # the smallest draws of each part of a language first, so that no task orders all of a language
    for part in (F.pmod(F.col("draw"), F.lit(PARTS)), F.lit(0)):
        nth = F.row_number().over(W.partitionBy("lang", part).orderBy("draw"))
        drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= PER_LANG).select("lang", "draw")
    top = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).select("lang")
    chosen = F.broadcast(drawn.join(F.broadcast(top), "lang"))
    return labelled.withColumn("draw", F.xxhash64("doc_id", "text")).join(chosen, ["lang", "draw"]).select("text", "lang", "draw").dropDuplicates(["lang", "draw"])


def fitted(drawn: DataFrame) -> Field:
    """The field of a sample: fitted in one task, in order of language and draw, so that the driver holds the weights alone."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, labels))], pa.binary())], names=["field"])

    held = drawn.repartition(1).sortWithinPartitions("lang", "draw").select("text", "lang").mapInArrow(train, "field binary").collect()
    return pickle.loads(held[0]["field"]) if held else fit([], [])


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4, held: int = 2, tag: str | None = None) -> DataFrame:
    """Every document's language, learned from those whose crc32(id as text) modulo ``modulus`` isn't ``held``.

    Returns doc_id, held_out, lang_pred (a learned language; ``und``, with score 0, if the text is null or has no
    letter) and score, and the long column ``tag``, if one is named. Rows without doc_id are not held out. With nothing to learn from, all are ``und``. Repeated
    doc_ids are predicted each for itself. Labels of equal mean are told apart by name (the first one). Very long texts are
    labelled whole, each in a run of its own. Empty table: no rows. Other columns are not looked at.
    """
    tagged = (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag")
    docs = id_and(docs, key, text, lang, *([tag] if tag else [])).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), tagged)
    out_of = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == held, F.lit(False))
    field = docs.sparkSession.sparkContext.broadcast(fitted(sample(docs, ~out_of)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = field.value
        names = [*model.langs, UNKNOWN]
        for batch in batches:
            for part, texts in runs(batch):
                n = texts.n
                if model.langs:
                    who, bucket, which = distinct(texts)
                    e = scaled(emissions(who, bucket, int(which.max()) + 1 if len(which) else 0, model.weights))[which]
                    full = np.flatnonzero(texts.n_words)
                    p = marginals(e, texts.of[full], texts.n_words[full], model.moves, model.start)
                    total = np.zeros((n, len(model.langs)))
                    if len(full):
                        total[full] = np.add.reduceat(p.astype(np.float64), texts.of[full], axis=0)
                    best = total.argmax(1)
                    score = total[np.arange(n), best] / np.maximum(texts.n_words, 1)
                    known = part.column(2).to_numpy(zero_copy_only=False) & (texts.n_words > 0)
                else:
                    best, score, known = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                best = np.where(known, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(np.clip(np.where(known, score, 0.0), 0.0, 1.0)), part.column(4)], names=["doc_id", "held_out", "lang_pred", "score", "tag"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select("doc_id", "text", letters.alias("letters"), out_of.alias("held_out"), "tag").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, tag long")
    return found.withColumnRenamed("tag", tag) if tag else found.drop("tag")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document of ``documents``."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
