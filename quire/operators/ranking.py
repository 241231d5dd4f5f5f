"""Terms by mean tf-idf over very many sentences, with little to shuffle.

Equal sentences are one unit that counts several times. Most runs of words stand in one unit only, and of those everything is known in its own row: their document
frequency is the unit's count. Only runs that several units share need to be found, by a 64-bit hash of their words: those of two words first, then longer ones whose
every two words are shared, for which a filter of the shared ones goes to every task. What a unit shares then comes to it by a join, and it gives each of its terms' part of the
mean; strings are made for terms that may be among the first. Units meet what they share in slices, one after the other, so that only a slice of it is dealt out at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.tables import Scratch, released

U = np.uint64
#: Scores are rounded to six places; how near to half a step a sum may be before its rounding is open.
STEPS, NEAR = 1e6, 1e-6
#: Units of a slice, and how many slices there are at most.
SLICE, SLICES = 50_000, 4
#: Bits of a number from monotonically_increasing_id below its partition.
FILE = 33
#: Bits of the filter of shared pairs of words: sixteen for each, within these powers of two (32 MB at most). A full filter lets more runs pass, which are then found unshared.
LEAST_BITS, MOST_BITS = 20, 28


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Units:
    """A batch of units: their words, in a row, with the run and the unit of each."""

    def __init__(self, units: pa.Array, whole: pa.Array):
        lists = pc.split_pattern(units, "\n")
        self.unit_of_run = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(lists.flatten(), " ")
        self.run = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        one = b"".join(hashlib.blake2b(w.encode("utf-8"), digest_size=8).digest() for w in self.words)
        self.hash = np.frombuffer(one, U)[self.code] if len(self.code) else np.empty(0, U)
        self.size = np.bincount(self.run, minlength=len(self.unit_of_run))
        self.first = np.cumsum(self.size) - self.size
        flags = "".join(whole.to_pylist())  # one for each run, or none at all
        self.whole = np.frombuffer(flags.encode(), np.uint8) == ord("1") if flags else np.zeros(len(self.size), bool)
        self.n = len(units)

    def grams(self, least: int, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length: where its runs begin, and their hashes."""
        h, out = _mix(self.hash), {}
        left = self.first[self.run] + self.size[self.run] - np.arange(len(self.run)) if len(self.run) else np.empty(0, np.int64)
        at = np.arange(len(self.run))
        for n in range(2, most + 1):
            fits = left[at] >= n
            at, h = at[fits], h[fits]
            h = _mix(h * U(0x9E3779B97F4A7C15) + self.hash[at + n - 1])
            if n >= least:
                out[n] = at, h
        return out

    def counted(self, grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(unit, hash, tf, whole, begin, length) of the different runs of words of each unit; ``whole``: one of them is a marked run from end to end."""
        at = np.concatenate([a for a, _ in grams.values()])
        h = np.concatenate([x for _, x in grams.values()])
        length = np.repeat(np.fromiter(grams, np.int64), [len(a) for a, _ in grams.values()])
        run = self.run[at]
        unit = self.unit_of_run[run].astype(np.int64)
        whole = self.whole[run] & (self.size[run] == length)
        order = np.lexsort((h, unit))
        unit, h, whole, at, length = unit[order], h[order], whole[order], at[order], length[order]
        new = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.empty(0, np.int64)
        tf = np.diff(np.concatenate((new, [len(h)])))
        any_whole = np.logical_or.reduceat(whole, new) if len(new) else np.empty(0, bool)
        return unit[new], h[new], tf, any_whole, at[new], length[new]

    def term(self, begin: int, length: int) -> str:
        return " ".join(self.words[c] for c in self.code[begin : begin + length].tolist())


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _met(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, df) of all that the batch's units share, each hash once; null: nothing."""
    met = _column(batch, name).flatten()
    h, one = np.unique(met.field("h").to_numpy(zero_copy_only=False).view(U) if len(met) else np.empty(0, U), return_index=True)
    return h, met.field("df").to_numpy(zero_copy_only=False)[one] if len(met) else np.empty(0, np.int64)


def _among(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is one of the known (in order), and where."""
    if not len(known):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[place] == h, place


def _pairs_filter(shared: DataFrame):
    """Which 64-bit hashes (h) may be among the shared ones: a bit for each, as a broadcast array of 64-bit words, and the number of its bits as a power of two."""
    n = shared.agg(F.approx_count_distinct("h")).first()[0]
    power = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    place = F.col("h").bitwiseAND((1 << power) - 1)
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = shared.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    table = np.zeros(1 << (power - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return shared.sparkSession.sparkContext.broadcast(table), power


def _may_be_shared(h: np.ndarray, table: np.ndarray, power: int) -> np.ndarray:
    place = (h & U((1 << power) - 1)).astype(np.int64)
    return (table[place >> 6] >> (place & 63)) & 1 > 0


def _shared_rows(units: DataFrame, least: int, most: int, pairs: tuple | None = None) -> DataFrame:
    """(h, sid, df, whole): the runs of words of each unit that other units have too, by their hash, with the number of sentences that have them, and whether one of them is whole.

    ``pairs``: the filter of shared runs of two words, for longer ones.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Units(_column(batch, "unit"), _column(batch, "whole"))
            grams = held.grams(2, most)
            if pairs is not None:  # of a shared run every two words are shared
                at, two = grams[2]
                common = np.zeros(len(held.code) + most, bool)
                common[at] = _may_be_shared(two, pairs[0].value, pairs[1])
                grams = {n: (a, h) for n, (a, h) in grams.items() if n >= least}
                for n, (a, h) in grams.items():
                    keep = np.logical_and.reduce([common[a + k] for k in range(n - 1)])
                    grams[n] = a[keep], h[keep]
            unit, h, _, whole, _, _ = held.counted(grams)
            sid, m = (_column(batch, c).to_numpy()[unit] for c in ("sid", "m"))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sid), pa.array(m), pa.array(whole)], names=["h", "sid", "m", "whole"])

    rows = units.mapInArrow(each, "h long, sid long, m long, whole boolean")
    alike = W.partitionBy("h")
    told = rows.select("h", "sid", F.count(F.lit(1)).over(alike).alias("units"), F.sum("m").over(alike).alias("df"), F.bool_or("whole").over(alike).alias("whole"))
    return told.where("units > 1").drop("units")


def _by_unit(shared: DataFrame, whole_only: bool) -> DataFrame:
    """(sid, met array<struct<h, df>>) of ``_shared_rows``, with ``whole_only`` of those alone."""
    return (shared.where("whole") if whole_only else shared).groupBy("sid").agg(F.collect_list(F.struct("h", "df")).alias("met"))


def _shared(units: DataFrame, least: int, most: int, whole_only: bool) -> DataFrame:
    """What each unit shares, where nothing is to be written."""
    return _by_unit(_shared_rows(units, least, most), whole_only)


def _parts(units: DataFrame, n_sentences: int, most: int, whole_only: bool, top: int) -> DataFrame:
    """(term, part): what units give to the sum of each term, for all shared terms, and for those of one unit that may be among the first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, float] = {}  # terms of one unit: the first so far, and those whose rounding is open
        cut = (-1.0, "")  # the least of the first, as far as there are enough
        for batch in batches:
            held = Units(_column(batch, "unit"), _column(batch, "whole"))
            unit, h, tf, whole, begin, length = held.counted(held.grams(2, most))
            known, known_df = _met(batch, "met")
            m = _column(batch, "m").to_numpy()
            shared, place = _among(h, known)
            df = np.where(shared, known_df[place] if len(known) else 0, m[unit])
            if whole_only:
                keep = shared | whole
                unit, h, tf, begin, length, df, shared = (x[keep] for x in (unit, h, tf, begin, length, df, shared))
            w = tf * (np.log((1.0 + n_sentences) / (1 + df)) + 1)
            part = w / np.sqrt(np.bincount(unit, w * w, held.n))[unit] * m[unit]
            one, first, which = np.unique(h[shared], return_index=True, return_inverse=True)
            sums = np.bincount(which, part[shared], len(one))
            terms = [held.term(b, k) for b, k in zip(begin[shared][first].tolist(), length[shared][first].tolist(), strict=True)]
            # of the rest a term that comes after ``top`` others, however both are rounded, can't be among the first
            steps = part / max(1, n_sentences) * STEPS + 0.5
            low, open_ = np.floor(steps - NEAR), np.floor(steps - NEAR) != np.floor(steps + NEAR)
            early = np.array([x <= cut[1].split(" ", 1)[0] for x in held.words], bool) if cut[0] >= 0 else np.ones(len(held.words), bool)
            likely = ~shared & (open_ | (low > cut[0]) | ((low == cut[0]) & early[held.code[begin]]))
            if np.count_nonzero(likely) > top:  # nor one below the batch's own first ``top``
                likely &= open_ | (low >= np.partition(low[~shared], -top)[-top])
            ranked = []
            for b, k, p, x, is_open in zip(*(v[likely].tolist() for v in (begin, length, part, low, open_)), strict=True):
                ranked.append((-x, held.term(b, k), p, is_open))
            if ranked:
                ranked = sorted([*ranked, *((-math.floor(p / max(1, n_sentences) * STEPS + 0.5 - NEAR), t, p, False) for t, p in best.items())])
                best = {t: p for i, (_, t, p, is_open) in enumerate(ranked) if i < top or is_open}
                if len(ranked) >= top:
                    cut = (-ranked[top - 1][0], ranked[top - 1][1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(sums, pa.float64())], names=["term", "part"])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array(list(best.values()), pa.float64())], names=["term", "part"])

    return units.mapInArrow(each, "term string, part double")


def distinct_units(sentences: DataFrame, persist: Callable[[DataFrame], DataFrame], whole: Column | None = None) -> DataFrame:
    """(unit, m, whole, sid): the different sentences of (unit), how often each is there, the marks of its runs (of ``unit``; or none), and a number."""
    counted = sentences.groupBy("unit").agg(F.count(F.lit(1)).alias("m"))
    return persist(counted.select("unit", "m", (F.lit("") if whole is None else whole).alias("whole"), F.monotonically_increasing_id().alias("sid")))


def ranked(units: DataFrame, n_sentences: int, persist: Callable[[DataFrame], DataFrame], top: int, most: int, whole_only: bool = False) -> DataFrame:
    """(term, score): the ``top`` terms by mean tf-idf over ``n_sentences``: smoothed idf, each sentence at length one, ties by term.

    A unit's runs are parted by line ends, their words by spaces. Terms are two to ``most`` words of a run; with ``whole_only`` those alone that are, somewhere, a whole run
    that ``whole`` (a 0 or 1 for each run of a unit) marks.
    """
    own = Scratch(persist)
    units = units.where(F.col("unit").contains(" "))
    two = own(_shared_rows(units, 2, 2))
    longer = own(_shared_rows(units, 3, most, _pairs_filter(two)))
    shared = two.unionByName(longer)
    # units are numbered by the file they lie in, so a slice is some of the files
    size = units.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("sid"), F.lit(0)).alias("last")).first()
    files = (size["last"] >> FILE) + 1
    slices = min(SLICES, files, max(1, size["n"] // SLICE))
    found = []
    for k in range(slices):
        here = (F.col("sid") >= (k * files // slices) << FILE) & (F.col("sid") < ((k + 1) * files // slices) << FILE)
        met = _by_unit(shared.where(here), whole_only)
        parts = _parts(units.where(here).join(met, "sid", "left").select("unit", "whole", "m", "met"), n_sentences, most, whole_only, top)
        found.append(persist(parts.groupBy("term").agg(F.sum("part").alias("part"))))
    own.clear()
    scored = reduce(DataFrame.unionByName, found).groupBy("term").agg(F.round(F.sum("part") / max(1, n_sentences), 6).alias("score"))
    first = persist(scored.orderBy(F.desc("score"), "term").limit(top))
    released(*found)
    return first
