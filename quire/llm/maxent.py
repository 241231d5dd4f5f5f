"""Language-model scoring by a hashed maximum-entropy model (operator 6).

A token's probability is factored by its class: P(class | history) * P(word | class). The first factor is a softmax over
CLASSES classes with hashed features of the history, words and classes as n-grams and with skips; the second
is closed-form: add-one shares within the class, one share for all unknown words of the class, so that the
probabilities of all words add up to one. The most frequent words and the end of a text are classes of one member; the others
are dealt by a hash of their last two bytes, which tells much about a word's grammar and language.

Counts come from all training documents through Spark. The softmax is trained by distributed gradient updates: in each of
ROUNDS rounds, tasks sum the gradient over their part of the round's training documents at the same weights, and the
driver takes one AdaGrad step with the sum over all tasks. Every training document is used in one round, drawn by its id and
text, so the model doesn't depend on how the table is dealt into tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.dictionary import code_words, codes_of, held, with_found
from quire.llm.tables import id_and, written
from quire.llm.textbuf import Texts, U, mix

#: Classes of one member (the last of them is the end) and all classes; buckets of hashed words.
ALONE, CLASSES, BUCKETS = 16, 48, 1 << 13
END, BEGIN = ALONE - 1, CLASSES
SKIPS = (2, 3, 4, 5)
PAIR = 2 * BUCKETS
SKIP = PAIR + (CLASSES + 1) ** 2
ROWS = SKIP + len(SKIPS) * (CLASSES + 1)
ROUNDS, STEP, RATE = 16, 32_768, 0.5
#: Rows of a block of weights as tasks send them.
BLOCK = 512
#: Tokens whose scores lie in a core's cache.
SOME = 1_024


def suffix_class(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class that a word's last two bytes give, and the bucket of the word."""
    raw = [w.encode("utf-8") for w in words]
    ends = np.array([int.from_bytes(w[-2:], "big") for w in raw], U)
    sizes = np.array([len(w) for w in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate(([0], np.cumsum(sizes)))
    h = Texts(data, at).hashed(at[:-1], at[1:])
    return ALONE + (mix(ends + U(1)) % U(CLASSES - ALONE)).astype(np.int64), (h >> U(51)).astype(np.int64)


def history(cls: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[features, n] rows of the weights that speak for each token, from what stands before it in its document."""
    n = np.diff(at)
    nth = np.arange(len(cls)) - np.repeat(at[:-1], n)

    def before(values: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(len(values), none, np.int64)
        out[k:] = values[:-k] if k < len(values) else []
        out[nth < k] = none
        return out

    c = {k: before(cls, k, BEGIN) for k in (1, *SKIPS)}
    w1, w2 = before(bucket, 1, BUCKETS - 1), before(bucket, 2, BUCKETS - 1)
    both = BUCKETS + ((w2 * 40_503 + w1 * 2_654_435) & (BUCKETS - 1))
    return np.stack([w1, both, PAIR + c[2] * (CLASSES + 1) + c[1], *(SKIP + i * (CLASSES + 1) + c[k] for i, k in enumerate(SKIPS))])


SIDE = CLASSES + 1


def places(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of ``tables``: the two of words, those of two pairs of classes, that of the last skip."""
    skips = rows[3:] - SKIP
    return rows[0], rows[1] - BUCKETS, rows[2] - PAIR, (skips[1] - SIDE) * SIDE + skips[2] - 2 * SIDE, skips[3] - 3 * SIDE


def tables(weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weights by ``places``: each pair's with those of its two classes, so that fewer rows are summed for a token."""
    k = weights[SKIP:].reshape(len(SKIPS), SIDE, CLASSES)
    pair = weights[PAIR:SKIP].reshape(SIDE, SIDE, CLASSES) + k[0][:, None]
    return weights[:BUCKETS], weights[BUCKETS:PAIR], pair.reshape(-1, CLASSES), (k[1][:, None] + k[2][None]).reshape(-1, CLASSES), k[3]


def scores(at: tuple[np.ndarray, ...], parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Every class's score for each token, less the largest."""
    score = parts[0].take(at[0], 0)
    for r, part in zip(at[1:], parts[1:], strict=True):
        score += part.take(r, 0)
    score -= score.max(1, keepdims=True)
    return score


def log_softmax(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The same from the weights as they are: what ``log_shares`` and ``gradient`` have to agree with."""
    score = weights[rows[0]]
    for r in rows[1:]:
        score += weights[r]
    score -= score.max(1, keepdims=True)
    score -= np.log(np.exp(score).sum(1, keepdims=True))
    return score


def log_shares(rows: np.ndarray, cls: np.ndarray, parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """The log-probability of each token's class."""
    out, at = np.empty(len(cls)), places(rows)
    for i in range(0, len(cls), SOME):
        score = scores(tuple(r[i : i + SOME] for r in at), parts)
        its = score[np.arange(len(score)), cls[i : i + SOME]]
        out[i : i + SOME] = its - np.log(np.exp(score, out=score).sum(1))
    return out


def gradient(rows: np.ndarray, cls: np.ndarray, parts: tuple[np.ndarray, ...], total: np.ndarray, n: np.ndarray) -> None:
    """Adds the gradient of some tokens' log-likelihood to ``total``, and how often each feature speaks to ``n``.

    Sums over a pair of classes hold those over each of the two, so the skips aren't summed by themselves, but for the last.
    """
    gap, at = np.empty((CLASSES, len(cls))), places(rows)
    for i in range(0, len(cls), SOME):
        share = np.exp(scores(tuple(r[i : i + SOME] for r in at), parts))
        share /= -share.sum(1, keepdims=True)
        share[np.arange(len(share)), cls[i : i + SOME]] += 1
        gap[:, i : i + SOME] = share.T

    def put(sums: Callable[[np.ndarray, int], np.ndarray], out: np.ndarray) -> None:
        w1, both, pair, second, last = (sums(r, len(part)) for r, part in zip(at, parts, strict=True))
        out[:BUCKETS] += w1
        out[BUCKETS:PAIR] += both
        out[PAIR:SKIP] += pair
        pair, second = pair.reshape(SIDE, SIDE), second.reshape(SIDE, SIDE)
        out[SKIP:] += np.concatenate((pair.sum(1), second.sum(1), second.sum(0), last))

    put(lambda r, size: np.bincount(r, minlength=size), n)
    for j in range(CLASSES):
        put(lambda r, size, j=j: np.bincount(r, gap[j], size), total[:, j])


def step(weights: np.ndarray, squares: np.ndarray, total: np.ndarray, n: np.ndarray) -> None:
    """One AdaGrad step, in place: the mean over a feature's own tokens, damped where they are few."""
    grad = total / (n[:, None] + 4)
    squares += grad**2
    weights += (RATE * grad / np.sqrt(squares)).astype(np.float32)


def unpack(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = part.column(part.schema.get_field_index("cls")).to_pylist()
    at = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
    bucket = b"".join(part.column(part.schema.get_field_index("bucket")).to_pylist())
    return np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.frombuffer(bucket, "<u2").astype(np.int64), at


def by_tokens(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``most`` tokens; a document is never cut."""
    for batch in batches:
        size = np.cumsum(batch.column(batch.schema.get_field_index("n_tokens")).to_numpy())
        row, done = 0, 0
        while row < batch.num_rows:
            upto = max(row + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(row, upto - row)
            row, done = upto, int(size[upto - 1])


def train(resolved: DataFrame) -> np.ndarray:
    """The softmax's weights after ROUNDS distributed updates."""
    spark = resolved.sparkSession
    weights, squares = np.zeros((ROWS, CLASSES), np.float32), np.full((ROWS, CLASSES), 1e-3)
    n_blocks = -(-ROWS // BLOCK)

    for nth in range(ROUNDS):
        now = spark.sparkContext.broadcast(weights)

        def summed(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((CLASSES, ROWS)).T, np.zeros(ROWS, np.int64)  # a class's sums lie together
            parts = tables(now.value)
            for part in by_tokens(batches, 8 * STEP):
                cls, bucket, at = unpack(part)
                rows = history(cls, bucket, at)
                for i in range(0, len(cls), STEP):
                    gradient(rows[:, i : i + STEP], cls[i : i + STEP], parts, total, n)
            if n.any():
                block = lambda x, b: x[b * BLOCK : (b + 1) * BLOCK].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n_blocks)), pa.array([block(total.astype(np.float32), b) for b in range(n_blocks)], pa.binary()), pa.array([block(n, b) for b in range(n_blocks)], pa.binary())], names=["block", "total", "n"]
                )

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("total").to_pylist())
            n = sum(np.frombuffer(x, np.int64) for x in table.column("n").to_pylist())
            return pa.table({"block": table.column("block")[:1], "total": [total.tobytes()], "n": [n.tobytes()]})

        schema = "block long, total binary, n binary"
        # a gradient is sent by each core, not by each split of the table
        mine = resolved.where(F.col("round") == nth).select("cls", "bucket", "n_tokens").coalesce(spark.sparkContext.defaultParallelism)
        sent = mine.mapInArrow(summed, schema)
        found = sorted(sent.groupBy("block").applyInArrow(add, schema).collect(), key=lambda r: r["block"])  # the weights' size, whatever the input
        if found:
            total = np.frombuffer(b"".join(r["total"] for r in found)).reshape(ROWS, CLASSES)
            step(weights, squares, total, np.frombuffer(b"".join(r["n"] for r in found), np.int64))
        now.unpersist()
    return weights


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, which: int = 2) -> DataFrame:
    """Every document's score, learned from those whose crc32(id as text) modulo ``modulus`` isn't ``which``.

    Returns doc_id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score (add-one unigram) and
    score (the model), both log10 of the text's probability.

    Null, empty and blank texts have the end alone. Rows without doc_id are training rows. Repeated doc_ids are
    documents each. Very long texts are scored whole. With no training document every word is unknown. Empty table: no rows. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    docs = id_and(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("flag", ~held("doc_id", modulus, which))
    # a training document's round; -1: not for training
    docs = docs.withColumn("draw", F.when(F.col("flag"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))).otherwise(-1).cast("long"))
    coded, vocabulary = code_words(docs, lambda t: t.words(), "maxent-coded", lower=True)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, bucket = suffix_class(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls.astype(np.int32)), pa.array(bucket.astype(np.int32))], names=["word", "c", "cls", "bucket"])

    counts = vocabulary.groupBy("word").agg(F.sum("n").alias("c"))
    counts = written(counts.mapInArrow(classed, "word string, c long, cls int, bucket int"), "maxent-counts")
    n_train = docs.where("flag").count()
    top = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(ALONE - 1).select("word", "cls", "c").collect()
    alone = {r["word"]: i for i, r in enumerate(top)}
    per_class = counts.where("c > 0").groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        size[r["cls"]], kinds[r["cls"]] = r["n"], r["v"]
    for r in top:  # they leave the class of their ending
        size[r["cls"]] -= r["c"]
        kinds[r["cls"]] -= 1
    n_tokens = int(sum(r["n"] for r in per_class)) + n_train
    n_kinds = int(sum(r["v"] for r in per_class)) + (n_train > 0)
    whole = size + kinds + 1
    logs = np.log10(whole)
    base_log = np.log10(n_tokens + n_kinds + 1)
    end_base = np.log10(n_train + 1) - base_log

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        """A bundle's documents as classes and buckets, with the sums of what doesn't depend on the history."""
        codes, at = codes_of(left)
        n = int(right.column("code").to_numpy().max()) + 1 if right.num_rows else 0
        c, cls, bucket = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        code = right.column("code").to_numpy()
        c[code], cls[code], bucket[code] = (right.column(x).to_numpy() for x in ("c", "cls", "bucket"))
        inner = np.where(cls < ALONE, 0.0, np.log10(c + 1) - logs[cls])
        sums = lambda v: np.concatenate(([0], np.cumsum(v[codes])))[at]
        known, base, within = np.diff(sums((c > 0).astype(np.int64))), np.diff(sums(np.log10(c + 1) - base_log)), np.diff(sums(inner))
        ends = at[1:] + np.arange(len(at) - 1)
        k, b = np.empty(len(codes) + len(ends), np.uint8), np.empty(len(codes) + len(ends), "<u2")
        word = np.ones(len(k), bool)
        word[ends] = False
        k[word], k[ends], b[word], b[ends] = cls[codes], END, bucket[codes], BUCKETS - 2
        cut = np.concatenate(([0], ends + 1)).tolist()
        kraw, braw = k.tobytes(), b.tobytes()
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": pa.array(~left.column("flag").to_numpy().astype(bool)),
                "round": left.column("draw"),
                "n_tokens": pa.array(np.diff(cut)),
                "n_known": pa.array(known + (n_train > 0)),
                "base": pa.array(base + end_base),
                "within": pa.array(within),
                "cls": pa.array([kraw[i:j] for i, j in spans], pa.binary()),
                "bucket": pa.array([braw[2 * i : 2 * j] for i, j in spans], pa.binary()),
            }
        )

    special = F.lit(None).cast("int")
    for word, i in alone.items():
        special = F.when(F.col("word") == word, i).otherwise(special)
    found = vocabulary.join(counts.withColumn("cls", F.coalesce(special, "cls")), "word").select("bundle", "code", "c", "cls", "bucket")
    resolved = with_found(coded, found, resolve, "doc_id long, held_out boolean, round long, n_tokens long, n_known long, base double, within double, cls binary, bucket binary")
    # in the order of the rounds, so that a round skips the pages of others
    resolved = written(resolved.sortWithinPartitions("round"), "maxent-resolved")
    weights = spark.sparkContext.broadcast(train(resolved))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = tables(weights.value)
        for part in by_tokens(batches, 2 * STEP):
            cls, bucket, at = unpack(part)
            rows = history(cls, bucket, at)
            each = log_shares(rows, cls, parts)
            total = np.add.reduceat(each, at[:-1]) / np.log(10) + part.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = resolved.select("doc_id", "held_out", "n_tokens", "n_known", F.col("base").alias("base_score"), "within", "cls", "bucket").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_maxent(spark, sf_dir: str) -> DataFrame:
    """The score of every text of ``documents``."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
