"""Packing of token sequences by minimum bin slack (operator 7).

A document's ids fill whole windows first; what remains is shorter than a window. Only how often each remaining
length occurs matters for packing, and that is a table of at most window - 1 rows, whatever the corpus. The
driver fills one window after the other from it: a bitset subset-sum over the lengths, the longest first, finds
the multiset that comes closest to the capacity, with counts backtracked; the same filling is repeated as often as the
counts allow. What slack is left is closed by cutting a remaining piece, whose rest goes back to the table. The plan
says for ranges of ranks within a length where they go; executors look their pieces up in it.
"""

from __future__ import annotations

import json
import operator
import os
import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and, ranked, salts, written
from quire.llm.textbuf import LOWER, Texts, U, packed, release, runs

WINDOW = 2048
END = 1
#: Words, and parts of words, whose ids a task remembers: some 25 MB and 50 MB of arrays and names, given back when the task ends.
CACHE, PARTS_CACHE = 400_000, 300_000
#: What the shortcut below holds for: this normal form and this way of cutting words into parts (fixed values of the tokenizer's file).
NORMAL = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of ASCII and Latin-1 letters, whose normal form is their small letters; the parts that the pattern gives of them, one to a line; what else there is.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+|\n")
ODD = re.compile("[^!-~À-ÖØ-öø-ÿ\n]")
#: Byte-level names of the bytes of those letters: bytes 127 to 160 are moved to 289 and on.
NAMES = {b: chr(b + 162) if 127 <= b <= 160 else chr(b) for b in range(33, 256) if b != 173} | {173: chr(323)}


def by_words(path: str) -> bool:
    """Whether the tokenizer of a file drops white space, never looks across it and cuts words by PATTERN."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    form, cuts = (told.get("normalizer") or {}).get("normalizers", []), (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = cuts[0] if len(cuts) == 2 else {}
    return [x["type"] for x in form] == NORMAL and split.get("pattern") == {"Regex": PATTERN} and cuts[1]["type"] == "ByteLevel" and told["model"]["type"] == "BPE"


ID = operator.attrgetter("id")


class Lists:
    """Many short lists of ids in one array; lists are only added."""

    def __init__(self) -> None:
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen lists one after the other, and their sizes."""
        n = self.size[which]
        return self.flat[np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Encoder:
    """A tokenizer that encodes each different word of a task once; it lives as long as the task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = by_words(path)
        self.forget()
        self.forget_parts()

    def forget(self) -> None:
        """No word is known: a word is known by two 64-bit hashes, sorted by the first, and ``place`` is its list."""
        self.key, self.check, self.place, self.lists = np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), Lists()

    def forget_parts(self) -> None:
        self.part_at: dict[str, int] = {"\n": 0}
        self.parts = Lists()
        self.parts.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, END after each, and where each text's begin."""
        if not self.words:
            raw, at = texts.data.tobytes(), texts.at.tolist()
            found = [e.ids for e in self.tokenizer.encode_batch([raw[i:j].decode("utf-8") for i, j in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)]
            size = np.array([len(x) + 1 for x in found], np.int64)
            return np.fromiter(chain.from_iterable(chain(x, (END,)) for x in found), np.uint32, int(size.sum())), np.concatenate(([0], np.cumsum(size)))
        texts.words()
        key = texts.hashed(texts.start, texts.end, lower=True)
        key, one, which = np.unique(key, return_index=True, return_inverse=True)
        check = texts.hashed(texts.start[one], texts.end[one], lower=True, second=True)
        flat, size = self.lists_of(texts, key, check, texts.start[one], texts.end[one])
        start = np.cumsum(size) - size
        # END is a word of its own, after all others
        flat, start, size = np.append(flat, np.uint32(END)), np.append(start, len(flat)), np.append(size, 1)
        which = np.insert(which, texts.of[1:], len(size) - 1)
        n = size[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        return flat[np.repeat(start[which] - upto[:-1], n) + np.arange(upto[-1])], upto[texts.of + np.arange(texts.n + 1)]

    def lists_of(self, texts: Texts, key: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, given by hashes and places, one word after the other, and how many each has."""
        if len(self.key) > CACHE:
            self.forget()
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        inside = np.flatnonzero(at < len(self.key))
        known[inside] = self.key[at[inside]] == key[inside]
        same = np.flatnonzero(known)
        alike = self.check[at[same]] == check[same]
        new = np.flatnonzero(~known)
        place = np.empty(len(key), np.int64)
        place[same] = self.place[at[same]]
        again = np.concatenate((new, same[~alike]))  # the latter: another word of the same first hash
        place[again] = len(self.lists.size) + np.arange(len(again))
        if len(again):
            low = LOWER[texts.data].tobytes()
            self.lists.add(*self.fresh([low[i:j] for i, j in zip(start[again].tolist(), end[again].tolist(), strict=True)]))
        if len(new):
            order = np.argsort(np.concatenate((self.key, key[new])), kind="stable")
            self.key, self.check, self.place = (np.concatenate(x)[order] for x in ((self.key, key[new]), (self.check, check[new]), (self.place, place[new])))
        return self.lists.take(place)

    def fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words not met before: of plain ones, the parts go through the tokenizer's merges, each different part once; of others, the word through all of it."""
        lines = b"\n".join(words).decode("utf-8")
        odd: list[int] = []
        if ODD.search(lines):
            each = lines.split("\n")
            odd = [i for i, w in enumerate(each) if not PLAIN.fullmatch(w)]
            whole = [self.tokenizer.encode(each[i], add_special_tokens=False).ids for i in odd]
            for i in odd:
                each[i] = ""
            lines = "\n".join(each)
        if len(self.part_at) > PARTS_CACHE:
            self.forget_parts()
        parts = PARTS.findall(lines.lower() + "\n")
        known = list(map(self.part_at.get, parts))
        if None in known:
            different = list({p for p, k in zip(parts, known, strict=True) if k is None})
            named = [p if p.isascii() else "".join(map(NAMES.__getitem__, p.encode("utf-8"))) for p in different]
            ids = [array("I", map(ID, tokens)) for tokens in map(self.tokenizer.model.tokenize, named)]  # arrays are no work for the collector
            self.part_at.update(zip(different, range(len(self.parts.size), len(self.parts.size) + len(different)), strict=True))
            self.parts.add(np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
            known = list(map(self.part_at.__getitem__, parts))
        which = np.array(known, np.int64)
        flat, n = self.parts.take(which)
        upto = np.concatenate(([0], np.cumsum(n)[which == 0]))  # place 0 ends a word
        size = np.diff(upto)
        if odd:
            pieces, done = [], 0
            for i, ids in zip(odd, whole, strict=True):
                pieces += [flat[done : upto[i]], np.array(ids, np.uint32)]
                done, size[i] = upto[i], len(ids)
            flat = np.concatenate([*pieces, flat[done:]])
        return flat, size


def fill(count: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of the available lengths whose sum is the largest that fits ``capacity``: a bitset subset-sum, copies by binary splitting."""
    reach, steps, full = 1, [], 1 << capacity
    limit = (full << 1) - 1
    for length in lengths:
        if length > capacity:
            continue
        left, take = min(count[length], capacity // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & limit
            left -= take
            take *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if total >= length * take and not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, from, to, start, size, sequence, offset): of the remainders of a length, those ranked from ``from`` to below ``to`` put ``size`` ids from ``start`` on into the sequences from ``sequence`` on, one each, at ``offset``."""
    pool: dict[int, deque] = {n: deque([(n, 0, c, 0)]) for n, c in histogram.items() if c}
    count = {n: c for n, c in histogram.items() if c}
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    sequence = 0

    def take(length: int, times: int, size: int, offset: int) -> None:
        count[length] -= times
        nth = sequence
        while times:
            of, low, high, start = pool[length].popleft()
            n = min(times, high - low)
            rows.append((of, low, low + n, start, size, nth, offset))
            if size < length:
                pool.setdefault(length - size, deque()).append((of, low, low + n, start + size))
                count[length - size] = count.get(length - size, 0) + n
            if low + n < high:
                pool[length].appendleft((of, low + n, high, start))
            nth, times = nth + n, times - n

    lengths = sorted(count, reverse=True)
    while lengths:
        first = lengths[0]
        count[first] -= 1
        used = fill(count, lengths if count[first] else lengths[1:], window - first)
        count[first] += 1
        used[first] += 1
        slack = window - sum(n * k for n, k in used.items())
        cut = next((n for n in lengths if count[n] > used.get(n, 0)), None) if slack else None
        times = min(count[n] // (k + (n == cut)) for n, k in used.items())
        if cut is not None:
            times = min(times, count[cut] // (used.get(cut, 0) + 1))
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            for _ in range(k):
                take(n, times, n, offset)
                offset += n
        if cut is not None:
            take(cut, times, slack, offset)
        sequence += times
        lengths = sorted((n for n, c in count.items() if c), reverse=True)
        for n in [n for n, c in count.items() if not c]:
            del count[n]
    return rows


def lookup(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan for searching: sorted (length, rank) cuts, and for each stretch from one cut to the next which rows hold there."""
    table = np.array(rows, np.int64).reshape(-1, 7)
    key = lambda n, r: (n << 44) | r
    low, high = key(table[:, 0], table[:, 1]), key(table[:, 0], table[:, 2])
    cuts = np.unique(np.concatenate((low, high)))
    a, b = np.searchsorted(cuts, low), np.searchsorted(cuts, high)
    stretch = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
    row = np.repeat(np.arange(len(table)), b - a)
    order = np.lexsort((table[row, 3], stretch))
    of = np.searchsorted(stretch[order], np.arange(len(cuts) + 1))
    return cuts, of, row[order], table


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Pack every document's ids into sequences of at most ``window``.

    Returns a row for each piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (the piece, as little-endian unsigned 32-bit numbers). Every sequence but the last
    is full, hence needs no padding.

    Null and empty texts have the end id alone. Null and repeated doc_ids are documents of their own. Empty table:
    no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = id_and(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    width = np.dtype("<u2" if vocabulary_size(tokenizer) <= 1 << 16 else "<u4")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part, texts in runs(batch):
                ids, at = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), packed(ids.astype(width), at)], names=["doc_id", "n", "raw"])

    coded = docs.mapInArrow(tokens, "doc_id long, n long, raw binary").withColumn("rid", F.monotonically_increasing_id())
    coded = written(coded, "packing-ids")
    thin = coded.select("rid", "n", (F.col("n") % window).alias("rest"))
    counted = thin.groupBy("rest").agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("n") / window)).alias("full")).collect()  # at most window rows
    rows = plan({r["rest"]: r["c"] for r in counted if r["rest"]}, window)
    used = max((r[5] + r[2] - r[1] for r in rows), default=0)
    full = sum(r["full"] for r in counted)
    if full:
        rows.append((window, 0, full, 0, window, used, 0))
    whole = thin.where(F.col("n") >= window).select("rid", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / window) - 1)).alias("i"))
    items = thin.where("rest > 0").select("rid", (F.col("n") - F.col("rest")).alias("base"), F.col("rest").alias("len")).unionByName(whole.select("rid", (F.col("i") * window).alias("base"), F.lit(window).cast("long").alias("len")))
    n_items = sum(r["c"] for r in counted) + full
    items = ranked(items, "len", ["rid", "base"], salts(n_items))
    found = spark.sparkContext.broadcast(lookup(rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, of, row_of, table = found.value
        for batch in batches:
            rid, base, length, rank = (batch.column(i).to_numpy() for i in range(4))
            stretch = np.searchsorted(cuts, (length << 44) | rank, side="right") - 1
            n = of[stretch + 1] - of[stretch]
            item = np.repeat(np.arange(len(rid)), n)
            row = table[row_of[np.repeat(of[stretch] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            out = [rid[item], base[item] + row[:, 3], row[:, 4], row[:, 5] + rank[item] - row[:, 1], row[:, 6]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in out], names=["rid", "start", "length", "sequence_id", "offset"])

    placed = items.select("rid", "base", "len", "rank").mapInArrow(place, "rid long, start long, length long, sequence_id long, offset long")
    placed = placed.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lists = part.column(3)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                pieces = lists.flatten()
                start, length = pieces.field(0).to_numpy(), pieces.field(1).to_numpy()
                raw = [np.frombuffer(x, width).astype("<u4") for x in part.column(2).to_pylist()]
                ids = [raw[d][s : s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                at = pa.array(doc)
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pieces.field(0), pieces.field(1), crc, part.column(1).take(at), pieces.field(2), pieces.field(3), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        release()

    met = coded.join(placed, "rid").select("doc_id", "n", "raw", "pieces")
    return met.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()).drop("ids")
