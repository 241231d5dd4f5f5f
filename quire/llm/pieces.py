"""SentencePiece encoding and decoding on a relational lattice (operator 5).

Texts are cut into units where no piece of the vocabulary reaches across: before a run of spaces, and between letters, digits
and other marks, as far as the model's pieces allow that. The corpus' different units are counted and encoded once: their
substrings of bounded length are exploded and equi-joined with the piece table, which gives the edges of the lattice; these
are grouped by unit and folded. Texts stay where they are read: every task knows the units' ids, of the KNOWN most frequent
ones; where there are more, documents are dealt by a hash into bundles of some 8 MB, and the rest reach their bundles by a join.

A unigram model's fold is Viterbi, in Spark's higher-order functions: the best score of each place, then back along the choices.
The vocabulary at hand is of the BPE kind: its scores are merge ranks, and the path that maximises their sum is not the segmentation
such a model defines. For it the fold keeps the lattice but replays the merges on it, over all lattices of an Arrow batch at once: the
state is the set of cut points (a bit for each place); each step takes the best-scored edge that joins exactly two neighbouring
segments, the leftmost of equals, until none is left. What is no piece of its own is spelled in byte pieces. Units over LONG
characters, which a bit set doesn't hold, are merged with a heap.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tables import id_and, written
from quire.llm.textbuf import Texts, buffer_of, release, runs

MARK = "▁"
#: Characters of a unit that the bit set holds.
LONG = 60
#: Bytes of text of a bundle.
BUNDLE = 8 << 20
#: Different units whose ids every task holds (some 25 bytes each); more are met by a join.
KNOWN = 4_000_000
#: Rows of a task's counts at which it hands them on.
HELD = 1 << 19
#: Classes of characters: space, letters (ASCII and U+00C0 to U+023F, whose UTF-8 begins with C3 to C8), digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[32] = SPACE


def vocabulary(path: str) -> list[tuple[str, int, float]]:
    """(piece, id, score) of the model's ordinary pieces; bounded by the model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [(model.id_to_piece(i), i, model.get_score(i)) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def byte_ids(path: str) -> list[int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def class_of(char: str) -> int:
    return SPACE if char == MARK else int(CLASS[char.encode("utf-8")[0]])


def cuts(pieces: list[str]) -> tuple[bool, bool]:
    """Whether texts may be cut between classes, and between digits: where no piece has such neighbours. None may have a space after anything else."""
    met = {(class_of(a), class_of(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    if any(b == SPACE != a for a, b in met):
        raise ValueError("pieces that go on after a space are not supported")
    return not any(a != b for a, b in met if a != SPACE), (DIGIT, DIGIT) not in met


def units(texts: Texts, by_class: bool, by_digit: bool) -> None:
    """Units as spans of bytes: ``start``, ``end``, ``of`` and ``n_words`` of the texts."""
    d = texts.data
    kind = CLASS[d]
    rest = np.flatnonzero((d & 0xC0) == 0x80)  # the bytes of a character after its first are of its class
    kind[rest] = np.where((rest > 0) & (kind[rest - 1] == LETTER) & (d[rest - 1] >= 0xC3), LETTER, OTHER)
    cut = np.zeros(len(d) + 1, bool)
    cut[texts.at] = True
    before, after = kind[:-1], kind[1:]
    cut[1:-1] |= (after == SPACE) & (before != SPACE)
    if by_class:
        cut[1:-1] |= (after != before) & (before != SPACE)
        if by_digit:
            cut[1:-1] |= (after == DIGIT) & (before == DIGIT)
    texts.start = np.flatnonzero(cut[:-1]) if len(d) else np.empty(0, np.int64)
    texts.end = np.concatenate((texts.start[1:], [len(d)])) if len(d) else texts.start
    texts.of = np.searchsorted(texts.start, texts.at)
    texts.n_words = np.diff(texts.of)


def spans(texts: Texts) -> pa.StringArray:
    """The units as strings; they follow each other without a gap."""
    ends = np.concatenate((texts.start, texts.end[-1:])).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts.start), pa.py_buffer(ends), pa.py_buffer(texts.data))


def counted(docs: DataFrame, how: tuple[bool, bool]) -> DataFrame:
    """(word, n): the units of at most LONG characters of every text, several rows a unit."""

    def total(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([x.combine_chunks() for x in (table.column("word"), table.column("n_sum"))], names=["word", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for _, texts in runs(batch):
                units(texts, *how)
                if not len(texts.start):
                    continue
                found = spans(texts).value_counts()
                part = pa.table({"word": found.field("values"), "n": found.field("counts")})
                parts.append(part.filter(pc.less_equal(pc.utf8_length(part.column("word")), LONG)))
                rows += parts[-1].num_rows
                if rows >= HELD:
                    yield total(parts)
                    parts, rows = [], 0
        if parts:
            yield total(parts)
        release()

    return docs.select("text").mapInArrow(each, "word string, n long")


def encode_units(words: DataFrame, pieces: DataFrame, longest: int, spelled: list[int], viterbi: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(word, carry, ids): each different unit's piece ids, by its lattice; words are at most LONG characters long.

    Words dealt by word stay where they are. ``viterbi``: the path of the largest sum of scores (of equal ones, that with the
    shorter last piece); a character without a piece of its own is spelled at a score below all others. Else the merges.
    """
    keys = ["word", *carry]
    cells = words.select(*keys, F.translate("word", " ", MARK).alias("chars"), F.explode(F.expr("sequence(0, length(word) - 1)")).alias("s"))
    cells = cells.select(*keys, "chars", "s", F.explode(F.expr(f"sequence(1, least({longest}, length(chars) - s))")).alias("k"))
    edges = cells.select(*keys, "s", (F.col("s") + F.col("k")).alias("e"), F.expr("substring(chars, s + 1, k)").alias("piece"), (F.col("k") == 1).alias("single"))
    edges = edges.join(F.broadcast(pieces), "piece", "left").where("id is not null or single")  # a place without a piece is spelled
    if not viterbi:
        return by_merges(edges, keys, spelled)
    table = "array(" + ", ".join(map(str, spelled)) + ")"
    raw = f"encode(substring(translate(word, ' ', '{MARK}'), x.s + 1, 1), 'UTF-8')"
    by_byte = f"transform(sequence(1, length({raw})), i -> {table}[cast(conv(hex(substring({raw}, i, 1)), 16, 10) as int)])"
    ids = F.expr(f"flatten(transform(path, x -> CASE WHEN x.id IS NOT NULL THEN array(x.id) ELSE {by_byte} END))")
    return path_of_scores(edges, keys).select(*keys, ids.alias("ids"))


def by_merges(edges: DataFrame, keys: list[str], spelled: list[int]) -> DataFrame:
    """(keys, ids): the segments that are left when the merges are replayed.

    An edge is one number, whose order is that of the merges: whether it is a single character, the piece's rank (20 bits), s and e (6 bits each), and the
    id + 1, or 0 (24 bits).
    """
    edge = F.expr("shiftleft(CAST(single AS BIGINT), 56) | shiftleft(CAST(coalesce(rank, 0) AS BIGINT), 36) | shiftleft(CAST(s AS BIGINT), 30) | shiftleft(CAST(e AS BIGINT), 24) | (coalesce(id, -1) + 1)")
    lattices = edges.select(*keys, edge.alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = replayed(batch.column(0), batch.column(len(keys)), spelled)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], ids], names=[*keys, "ids"])
        release()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lattices.schema if f.name != "edges")
    return lattices.mapInArrow(each, f"{schema}, ids array<int>")


def replayed(words: pa.Array, lattices: pa.ListArray, spelled: list[int]) -> pa.ListArray:
    """The ids of each unit, from its edges in the order of the merges."""
    edges, size = lattices.flatten().to_numpy(), lattices.value_lengths().to_numpy()
    of = np.repeat(np.arange(len(size)), size)
    low, high, one = edges >> 30 & 63, edges >> 24 & 63, np.int64(1)
    ends = one << low | one << high
    inner = (one << high) - (one << (low + 1))
    single = edges >> 56 > 0
    cut = (one << (np.bincount(of[single], minlength=len(size)) + 1)) - 1
    left = np.flatnonzero(~single)
    while len(left):
        u, gap = of[left], cut[of[left]] & inner[left]
        may = np.flatnonzero(gap & (gap - 1) == 0)  # joins two neighbouring segments
        first = may[np.diff(u[may], prepend=-1) > 0]
        cut[u[first]] &= ~inner[left[first]]
        now = cut[u]
        going = np.zeros(len(size), bool)
        going[u[first]] = True
        # cuts only go: an edge whose ends are no cuts, or whose segments are joined, is out for good
        left = left[going[u] & (now & ends[left] == ends[left]) & (now & inner[left] != 0)]
    now = cut[of]
    path = np.flatnonzero((now & ends == ends) & (now & inner == 0))
    path = path[np.argsort(of[path] << 6 | low[path])]
    ids, n = (edges[path] & 0xFFFFFF) - 1, np.ones(len(path), np.int64)
    raw = {i: words[int(of[path[i]])].as_py().replace(" ", MARK)[low[path[i]]].encode("utf-8") for i in np.flatnonzero(ids < 0).tolist()}
    for i, x in raw.items():
        n[i] = len(x)
    at = np.cumsum(n) - n
    flat = np.repeat(ids, n)
    for i, x in raw.items():
        flat[at[i] : at[i] + n[i]] = [spelled[b] for b in x]
    upto = np.concatenate(([0], np.cumsum(np.bincount(of[path], weights=n, minlength=len(size))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(flat.astype(np.int32)))


#: What a spelled character adds to a path's score.
SPELLED = -1000.0


def path_of_scores(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): the Viterbi path."""
    edge = F.struct("e", (-F.col("s")).alias("back"), "s", F.coalesce("score", F.lit(SPELLED)).alias("score"), "id")
    lattice = edges.select(*keys, edge.alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    none = "named_struct('v', CAST(NULL AS DOUBLE), 's', -1, 'id', CAST(NULL AS INT))"
    first = "named_struct('v', CAST(0 AS DOUBLE), 's', -1, 'id', CAST(NULL AS INT))"
    at_end = "transform(b, (y, i) -> CASE WHEN i = x.e AND (y.v IS NULL OR b[x.s].v + x.score > y.v) THEN named_struct('v', b[x.s].v + x.score, 's', x.s, 'id', x.id) ELSE y END)"
    best = lattice.select(*keys, F.expr(f"aggregate(edges, transform(sequence(0, length(word)), i -> CASE WHEN i = 0 THEN {first} ELSE {none} END), (b, x) -> {at_end})").alias("best"))
    # back from the end: the place reached, and the path from there on
    start = "named_struct('p', length(word), 'path', CAST(array() AS ARRAY<STRUCT<s: INT, id: INT>>))"
    back = "CASE WHEN a.p <= 0 THEN a ELSE named_struct('p', best[a.p].s, 'path', concat(array(named_struct('s', best[a.p].s, 'id', best[a.p].id)), a.path)) END"
    return best.select(*keys, F.expr(f"aggregate(sequence(1, length(word)), {start}, (a, i) -> {back}, a -> a.path)").alias("path"))


def merge_long(word: str, rank: dict[str, tuple[float, int]], spelled: list[int]) -> list[int]:
    """The same merges with a heap, for a unit of any length."""
    chars = list(word.replace(" ", MARK))
    after = [*range(1, len(chars)), -1]
    before = list(range(-1, len(chars) - 1))
    queue: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := rank.get(both := chars[i] + chars[j])):
            heapq.heappush(queue, (-found[0], i, both))

    for i in range(len(chars) - 1):
        offer(i)
    while queue:
        _, i, both = heapq.heappop(queue)
        j = after[i] if chars[i] else -1
        if j < 0 or chars[i] + chars[j] != both:
            continue
        chars[i], chars[j] = both, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out: list[int] = []
    for c in chars:
        if c:
            out.extend([rank[c][1]] if c in rank else (spelled[b] for b in c.encode("utf-8")))
    return out


def prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text): the text as the model sees it, with the space it puts before; empty texts stay empty."""
    plain = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(" "))
    docs = id_and(docs, key, text).select(F.col(key).alias("doc_id"), plain.alias("text"))
    return docs.select("doc_id", F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(" "), "text")).alias("text"))


def hashed(names: pa.Array, second: bool = False) -> np.ndarray:
    data, at = buffer_of(names)
    return Texts(data, at).hashed(at[:-1], at[1:], second=second)


def named(found: DataFrame) -> DataFrame:
    """The units' ids with two hashes of each unit."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [pa.array(hashed(batch.column(0), second).view(np.int64)) for second in (False, True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=["word", "n", "ids", "key", "key_2"])

    return found.select("word", "n", "ids").mapInArrow(each, "word string, n long, ids array<int>, key long, key_2 long")


def least_count(found: DataFrame, most: int) -> int:
    """The least count of which at most ``most`` units are: 1, if that is all."""
    left, least = most, None
    for r in found.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # a row for each different count
        if r["count"] > left:
            return least or r["n"] + 1
        left, least = left - r["count"], r["n"]
    return 1


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", viterbi: bool = False, most: int = KNOWN) -> DataFrame:
    """(doc_id, ids): every text's piece ids, as packed little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids. Null and repeated doc_ids are documents of their own. Very long texts are encoded
    whole. An empty table gives no rows. Other columns are not looked at. ``most``: units that every task holds.
    """
    spark = docs.sparkSession
    table = vocabulary(model)
    spelled = byte_ids(model)
    ranked = [(p, i, v, r) for r, (p, i, v) in enumerate(sorted(table, key=lambda x: (-x[2], x[1])))]
    pieces = spark.createDataFrame(ranked, "piece string, id int, score double, rank int")
    longest = max(len(p) for p, _, _ in table)
    how = cuts([p for p, _, _ in table])
    rank = spark.sparkContext.broadcast({p: (s, i) for p, i, s in table})
    docs = prepared(docs, key, text)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BUNDLE))
    words = counted(docs, how).repartition(int(n), "word").groupBy("word").agg(F.sum("n").alias("n"))
    found = written(named(encode_units(words, pieces, longest, spelled, viterbi, ("n",))), "pieces-units")
    units_, keys, keys_2 = found.agg(F.count(F.lit(1)), F.count_distinct("key"), F.count_distinct("key_2")).first()
    second = keys < units_  # two units of one hash: the other hash
    if second and keys_2 < units_:
        raise ValueError("units can't be told apart by hash")
    found = found.withColumn("key", F.col("key_2" if second else "key")).drop("key_2")
    least = 1 if units_ <= most else least_count(found, most)
    known = spark.sparkContext.broadcast(Known(found.where(F.col("n") >= least).select("key", "ids").toArrow()))
    schema = "doc_id long, ids binary"

    def put(batch: pa.RecordBatch, more: Known | None, long: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for some, texts in runs(batch):
            units(texts, *how)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids_of(texts, known.value, more, long, rank.value, spelled, second), pa.binary())], names=["doc_id", "ids"])

    if units_ <= most:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            long: dict[str, np.ndarray] = {}
            for batch in batches:
                yield from put(batch, None, long)

        return docs.mapInArrow(each, schema)

    # both sides read the one shuffle of the texts
    dealt = docs.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).select("bundle", "doc_id", "text").repartition(int(n), "bundle")

    def rest(table: pa.Table) -> pa.Table:
        bundle, words = table.column("bundle")[0], []
        for batch in table.to_batches(max_chunksize=1000):
            for _, texts in runs(batch):
                units(texts, *how)
                words.append(missing(texts, known.value, second))
        words = pa.chunked_array(words, pa.string()).unique()
        return pa.table({"its": pa.repeat(bundle, len(words)), "word": words})

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        more, long = Known(right.select(["key", "ids"])), {}
        rows = [x for batch in left.select(["doc_id", "text"]).to_batches(max_chunksize=1000) for x in put(batch, more, long)]
        return pa.Table.from_batches(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    wanted = dealt.groupBy("bundle").applyInArrow(rest, "its long, word string").join(found.where(F.col("n") < least), "word").select("its", "key", "ids")
    return dealt.groupBy("bundle").cogroup(wanted.groupBy("its")).applyInArrow(both, schema)


class Known:
    """Units' ids by their hashes, as sorted arrays."""

    def __init__(self, found: pa.Table):
        key = found.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        lists = found.column("ids").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
        size = lists.value_lengths().to_numpy().astype(np.int32)
        self.key, self.size = key[order], size[order]
        self.start = (np.cumsum(size, dtype=np.int64) - size)[order].astype(np.int32)
        self.flat = lists.flatten().to_numpy().astype("<u4")

    def places(self, key: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def different(texts: Texts, second: bool) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The units by their different ones, those ones' hashes, and which have a lattice."""
    coded = spans(texts).dictionary_encode()
    return coded, hashed(coded.dictionary, second), pc.less_equal(pc.utf8_length(coded.dictionary), LONG).to_numpy(zero_copy_only=False)


def missing(texts: Texts, known: Known, second: bool) -> pa.Array:
    """The different units that have a lattice and are not known."""
    if not len(texts.start):
        return pa.array([], pa.string())
    coded, key, short = different(texts, second)
    return coded.dictionary.filter(pa.array(short & (known.places(key) < 0)))


def ids_of(texts: Texts, known: Known, more: Known | None, long: dict[str, np.ndarray], rank: dict[str, tuple[float, int]], spelled: list[int], second: bool) -> list[bytes]:
    """The packed ids of each text; units over LONG are merged when they are met."""
    if not len(texts.start):
        return [b""] * texts.n
    coded, key, short = different(texts, second)
    start, size, flats, base, left = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), [], 0, short.copy()
    for held in (known, more):
        if held is not None:
            at = np.flatnonzero(left)
            place = held.places(key[at])
            at, place = at[place >= 0], place[place >= 0]
            n = held.size[place].astype(np.int64)
            flats.append(held.flat[np.repeat(held.start[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            start[at], size[at], left[at] = base + np.cumsum(n) - n, n, False
            base += int(n.sum())
    if left.any():
        raise ValueError(f"a unit without a lattice: {coded.dictionary[int(np.flatnonzero(left)[0])]}")
    for i in np.flatnonzero(~short).tolist():
        word = coded.dictionary[i].as_py()
        if word not in long:
            long[word] = np.array(merge_long(word, rank, spelled), "<u4")
        flats.append(long[word])
        start[i], size[i] = base, len(long[word])
        base += len(long[word])
    flat, which = np.concatenate(flats), coded.indices.to_numpy()
    n = size[which]
    out = flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<u4").tobytes()
    upto = (4 * np.concatenate(([0], np.cumsum(n)))[texts.of]).tolist()
    return [out[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]


def decode(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): the text that packed ids stand for: pieces joined, byte pieces read as UTF-8, marks as spaces, without the first."""
    spark: SparkSession = coded.sparkSession
    names = {i: p.replace(MARK, " ").encode("utf-8") for p, i, _ in vocabulary(model)} | {i: bytes([b]) for b, i in enumerate(byte_ids(model))}
    table = spark.sparkContext.broadcast(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = table.value
            texts = [b"".join(map(name.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace")[1:] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(each, "doc_id long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_crc32): of packed ids and of the text decoded from them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([zlib.crc32(t.encode("utf-8")) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "n_ids", "ids_crc32", "text_crc32"])

    return decoded.select("doc_id", "ids", "text").mapInArrow(each, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded, and decoded again: doc_id, n_ids, ids_crc32, text_crc32 (of what decoding gives)."""
    model = model_path()
    return digests(decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model), model))
