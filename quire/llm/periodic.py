"""Periodic runs of words by power-of-two naming (operator 13).

Words get exact integer names; a name of level k stands for 2**k words from a place on, and is made from the pair of names of level
k - 1 at that place and 2**(k-1) further (Karp, Miller and Rosenberg). Only places whose both halves stand elsewhere in the same
document go into a level, so prose is through after two or three levels. How far two places agree, forwards or backwards, is read
off in one descent over the levels.

A run of period q is LEAST words long and REPEATS * q at least. On a grid as wide as the shortest such run allows, one grid
point and the word q further lie in it; the pair is extended both ways. A stretch that is met with several periods has the
least of them: the others are its multiples. All documents of a megabyte of text are named together; nothing leaves its document, so
there is no shuffle, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and
from quire.llm.textbuf import SPACE, Texts, release, runs

LEAST, REPEATS = 24, 3
#: Grid pairs that are looked at together: some 40 MB.
PAIRS = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def word_numbers(texts: Texts) -> np.ndarray:
    """A number for every word of the batch, the same for equal words only: compared by their bytes."""
    lengths = texts.end - texts.start
    at = np.concatenate(([0], np.cumsum(lengths)))
    column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(texts.data[~SPACE[texts.data]])])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def names(words: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """Names of level 0, 1, ... by place; two places of one document agree for 2**k words if they have the same name of level k,
    and -1 stands for names that no other place of the document has. Ends at the last level with any."""
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    end = np.repeat(of[1:], np.diff(of))
    _, name, often = np.unique(doc * (int(words.max(initial=0)) + 1) + words, return_inverse=True, return_counts=True)
    name = np.where(often[name] > 1, name, -1).astype(np.int64)
    levels, half = [], 1
    while (at := np.flatnonzero(name >= 0)).size:
        levels.append(name.astype(np.int32))
        at = at[at + 2 * half <= end[at]]
        at = at[name[at + half] >= 0]
        _, pair, often = np.unique(name[at] * len(words) + name[at + half], return_inverse=True, return_counts=True)
        twice = often[pair] > 1
        name = np.full(len(words), -1, np.int64)
        name[at[twice]] = pair[twice]
        half *= 2
    return levels


def agree(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray, bound: int, ahead: bool) -> np.ndarray:
    """For how many words the places low < high agree: from them on and up to ``bound``, or before them and down to it."""
    got = np.zeros(len(low), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, level = 1 << k, levels[k]
        room = high + got + width <= bound if ahead else low - got - width >= bound
        a, b = (low + got, high + got) if ahead else (low - got - width, high - got - width)
        a, b = np.where(room, a, 0), np.where(room, b, 0)
        got += width * (room & (level[a] >= 0) & (level[a] == level[b]))
    return got


def runs_of(levels: list[np.ndarray], first: int, last: int) -> np.ndarray:
    """(start, length, period) of each run in the document of the words first to last - 1, by start, then period."""
    n = last - first
    found = [np.empty((0, 3), np.int64)]
    periods = np.arange(1, n // REPEATS + 1)
    step = np.maximum(LEAST, REPEATS * periods) - periods
    many = np.maximum(0, (n - periods - 1) // step + 1)
    upto = np.cumsum(many)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        q = np.repeat(periods[at:to], many[at:to])
        nth = np.arange(len(q)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        low = first + nth * np.repeat(step[at:to], many[at:to])
        same = (levels[0][low] >= 0) & (levels[0][low] == levels[0][low + q])
        low, q = low[same], q[same]
        back = agree(levels, low, low + q, first, False)
        length = back + q + agree(levels, low, low + q, last, True)
        long = length >= np.maximum(LEAST, REPEATS * q)
        found.append(np.stack((low[long] - back[long] - first, length[long], q[long]), 1))
        at = to
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(rows: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, rows[:, 0] + rows[:, 2], 1)
    np.add.at(step, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(step)[:n] > 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the periodic runs of each document's words, and the words left when each keeps one period.

    A run is a stretch of consecutive words whose smallest period is q (words q apart are the same), of 24 words and three periods at
    least, that no neighbouring word extends with that period. ``runs`` is ordered by start, then period; overlapping runs are all
    given. ``collapsed`` holds the words that lie in no run after its first period, joined by one space, as UTF-8.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Null and repeated ids give a row each;
    a repeated row gives the same row again. Very long texts are handled whole: a document of n words takes about 4 n log2(n) bytes
    for the levels that its repeats reach. No other column is looked at. Empty table: no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch):
                texts.words()
                levels = names(word_numbers(texts), texts.of) if len(texts.start) else []
                enough = LEAST - LEAST // REPEATS  # words in a row that stand twice in any run
                top = enough.bit_length() - 1
                marked = np.concatenate(([0], np.cumsum(levels[top] >= 0))) if len(levels) > top else np.zeros(len(texts.start) + 1, np.int64)
                busy = marked[texts.of[1:]] > marked[texts.of[:-1]]
                out, kept = [], []
                for d, raw in enumerate(part.column(1).to_pylist()):
                    words = (raw or "").encode("utf-8").split()  # bytes.split() splits at exactly [\x20\x09-\x0D]+
                    rows = runs_of(levels, int(texts.of[d]), int(texts.of[d + 1])) if busy[d] else ()
                    if len(rows):
                        words = [w for w, gone in zip(words, dropped(rows, len(words)).tolist(), strict=True) if not gone]
                    out.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()] if len(rows) else [])
                    kept.append(b" ".join(words))
                struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts.n_words.astype(np.int64)), pa.array(out, pa.list_(struct)), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])
        release()

    return id_and(docs, key, text).mapInArrow(each, SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail for each document that the crc32 of its id chooses; others, and those without id or words, as they are."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.when((h % 10 == 0) & (F.size(words) > 0), periodic_tail(words, F.floor(h / 10))).otherwise(text)


def periodic_tail(words: Column, g: Column) -> Column:
    """The n words, those from a = g % n on replaced by the p words that stand there, again and again; p = 1 + (n - a) // (3 + g % 8)."""
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p)
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times.cast("int")))
    return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), F.lit(1), n.cast("int")), " ")


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    """The periodic runs of every document of ``documents``, some of which get a periodic tail first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # exact comparison of length / period by cross products; the first of equal ones is the one with the smallest start, then period
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("most.length") / F.col("most.period")).cast("long")
    return out.select("doc_id", "n_words", "n_runs", "most.start", "most.length", "most.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: CRC-32 of the ASCII string ``s`` (by its definition, bit by bit).
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32.format(s="doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS chosen, h // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN chosen THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN chosen THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
same AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
         first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS most FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, t.n::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, most.start::BIGINT AS start, most.length::BIGINT AS length, most.period::BIGINT AS period,
  (1000 * most.length // most.period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
