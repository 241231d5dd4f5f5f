"""Looking up every word of a corpus in a table that grows with it, without shuffling the words.

Documents are coded in bundles: a bundle has a vocabulary of its own, and its documents are arrays of numbers into
it. Only the vocabularies, each word once a bundle, take part in joins; what is found for a word comes back to its
bundle, where the documents are put together with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import written
from quire.llm.textbuf import LOWER, Texts, runs

#: Bytes of text, and different words, at which a bundle is closed.
BUNDLE, WORDS = 24 << 20, 400_000
SCHEMA = "kind string, bundle long, doc_id long, flag boolean, draw long, codes binary, word string, code int, n long"


def code_words(docs: DataFrame, spans: Callable[[Texts], None], name: str, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """The coded documents (bundle, doc_id, flag, draw, codes) and the vocabularies (bundle, code, word, n), both written.

    ``docs`` has doc_id, text, flag and draw; ``spans`` finds start, end, of and n_words of a run of texts; ``n`` counts a word in
    the bundle's documents with the flag set.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        words: list[bytes] = []
        rows: list[tuple[pa.Array, pa.Array, pa.Array, list[bytes]]] = []
        counts = np.zeros(1 << 16, np.int64)
        size = 0

        def out(of: str, rows: int, **given: pa.Array) -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
            fixed = {"kind": pa.array([of] * rows), "bundle": pa.array(np.full(rows, bundle))} | given
            return pa.RecordBatch.from_arrays([fixed.get(c, pa.nulls(rows, kinds[t])) for c, t in (x.split() for x in SCHEMA.split(", "))], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            for ids, flags, draws, codes in rows:
                yield out("doc", len(ids), doc_id=ids, flag=flags, draw=draws, codes=pa.array(codes, pa.binary()))
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                yield out("word", len(part), word=pa.array(part, pa.binary()).cast(pa.string()), code=pa.array(np.arange(i, i + len(part), dtype=np.int32)), n=pa.array(counts[i : i + len(part)]))

        bundle = uuid.uuid4().int >> 65
        for batch in batches:
            for part, texts in runs(batch):
                spans(texts)
                h = texts.hashed(texts.start, texts.end, lower)
                different, one, which = np.unique(h, return_index=True, return_inverse=True)
                data = (LOWER[texts.data] if lower else texts.data).tobytes()
                code = np.empty(len(different), np.int32)
                for i, (v, a, b) in enumerate(zip(different.tolist(), texts.start[one].tolist(), texts.end[one].tolist(), strict=True)):
                    at = place.get(v)
                    if at is None:
                        at = place[v] = len(words)
                        words.append(data[a:b])
                    code[i] = at
                codes = code[which]
                if len(words) > len(counts):
                    counts = np.concatenate((counts, np.zeros(2 * len(words) - len(counts), np.int64)))
                flags = np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(bool), texts.n_words)
                counts[: len(words)] += np.bincount(codes[flags], minlength=len(words))[: len(words)]
                raw = codes.astype("<i4").tobytes()
                at = (texts.of * 4).tolist()
                rows.append((part.column(0), part.column(2), part.column(3), [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]))
                size += len(texts.data)
                if size >= BUNDLE or len(words) >= WORDS:
                    yield from close()
                    place, words, rows, size = {}, [], [], 0
                    counts = np.zeros(1 << 16, np.int64)
                    bundle = uuid.uuid4().int >> 65
        yield from close()

    coded = written(docs.select("doc_id", "text", "flag", "draw").mapInArrow(each, SCHEMA), name)
    return coded.where("kind = 'doc'").select("bundle", "doc_id", "flag", "draw", "codes"), coded.where("kind = 'word'").select("bundle", "code", "word", "n")


def with_found(coded: DataFrame, found: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``use(documents, found)`` for every bundle: its coded documents and what ``found`` (bundle, code, ...) has for its words."""
    found = found.withColumn("its", F.col("bundle") + 0).drop("bundle")  # a column of its own, as both come from one table
    return coded.groupBy("bundle").cogroup(found.groupBy("its")).applyInArrow(use, schema)


def codes_of(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All codes of the documents, and where each document's begin."""
    raw = docs.column("codes").to_pylist()
    at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)))
    return np.frombuffer(b"".join(raw), "<i4"), at


def held(key: str, modulus: int, which: int) -> Column:
    """Whether crc32 of the id as text modulo ``modulus`` is ``which``; not so for rows without id."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % modulus == which, F.lit(False))
