"""Removal of repeated passages by prefix-partitioned suffix trees (operator 8).

A window is 20 consecutive words; every window whose words also start earlier in the corpus goes. All suffixes of
the corpus would be one per word; the trees are sparse: their suffixes start at anchors. A window's anchor is the
least (by hash) of its thirteen 8-word grams, so equal windows have equal anchors at equal places, and one
suffix in seven words is enough to meet every repeat.

The 8 words of an anchor are the prefix that partitions the suffixes. Prefixes that occur once are leaves and
drop out on counts alone. Of the others, each occurrence carries the path on from its prefix: the hashes of
the windows it anchors. A prefix of up to GROUP occurrences is a subtree that one task builds by sorting: its deep
internal nodes, those of window depth with more than one suffix, are the repeats, and their first suffix by
(doc_id, start) stays. A more frequent prefix is made longer, to whole windows, whose first occurrence comes from a
partial aggregation, so a passage in a third of all documents never meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and, may_contain, membership, written
from quire.llm.textbuf import Texts, U, release, runs, window_starts, windows

WINDOW, GRAM = 20, 8
SPAN = WINDOW - GRAM + 1
#: The most occurrences of a prefix that one task takes together: some 5 MB, and 60 MB while they are sorted.
GROUP = 30_000
LAST = (1 << 63) - 1


def anchored(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the texts: its first word, its document, its anchor's first word; and all word hashes."""
    texts.words()
    h = texts.hashed(texts.start, texts.end)
    first, per = window_starts(texts.of, texts.n_words, WINDOW)
    if not len(first):
        return first, first, first, h
    grams = windows(h, GRAM)
    least = np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(1)
    return first, np.repeat(np.arange(texts.n), per), first + least[first], h


def keyed(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(k, th, uid, doc_id, text, rest): rows of one id and text are one document; documents without id come last."""
    rest = F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")
    docs = id_and(docs, key, text, rest.alias("rest")).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), "rest")
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("k"), F.xxhash64("text").alias("th"), "doc_id", "text", "rest")
    return docs.withColumn("uid", F.xxhash64("k", "th")).select("k", "th", "uid", "doc_id", "text", "rest")


def anchors(docs: DataFrame) -> DataFrame:
    """(uid, gram, at): each anchor's hash and the place of its first word in the document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch):
                first, doc, anchor, h = anchored(texts)
                if len(first):
                    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                    anchor, doc = anchor[new], doc[new]
                    grams = windows(h, GRAM)[anchor]
                    uid = part.column(0).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([uid, pa.array(grams.view(np.int64)), pa.array((anchor - texts.of[doc]).astype(np.int32))], names=["uid", "gram", "at"])

    return docs.select("uid", "text").mapInArrow(each, "uid long, gram long, at int")


def passing(docs: DataFrame, table, hit: bool = True) -> DataFrame:
    """The documents whose uid the filter may hold, or (not ``hit``) can't hold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = may_contain(table.value, batch.column(2).to_numpy()) == hit
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(each, docs.schema)


def occurrences(docs: DataFrame) -> DataFrame:
    """(gram, often, k, th, uid, low, path): each repeated anchor's windows, from ``low`` on, by their hashes.

    ``docs`` has, beside the text, ``found``: the document's repeated anchors as (at, often).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.schema.get_field_index("found")
            for part, texts in runs(batch):
                first, doc, anchor, h = anchored(texts)
                if not len(first):
                    continue
                lists = part.column(found)
                of = np.repeat(np.arange(texts.n), np.diff(lists.offsets.to_numpy()))
                inner = lists.flatten()
                often = np.zeros(len(h), bool)
                marked = np.zeros(len(h), bool)
                place = texts.of[of] + inner.field(0).to_numpy()
                marked[place], often[place] = True, inner.field(1).to_numpy(zero_copy_only=False)
                mine = np.flatnonzero(marked[anchor])
                first, doc, anchor = first[mine], doc[mine], anchor[mine]
                if not len(first):
                    continue
                new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                at = np.concatenate((new, [len(first)]))
                path = windows(h, WINDOW)[first]
                d = pa.array(doc[new])
                raw = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(path)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows(h, GRAM)[anchor[new]].view(np.int64)), pa.array(often[anchor[new]]), *(part.column(i).take(d) for i in range(3)), pa.array((first[new] - texts.of[doc[new]]).astype(np.int32)), pa.array((anchor[new] - first[new]).astype(np.int32)), raw],
                    names=["gram", "often", "k", "th", "uid", "low", "back", "path"],
                )

    return docs.select("k", "th", "uid", "text", "found").mapInArrow(each, "gram long, often boolean, k long, th long, uid long, low int, back int, path binary")


def subtree_repeats(suffixes: DataFrame) -> DataFrame:
    """(uid, low, mask): of each occurrence, which of its windows repeat an earlier one; subtrees of bounded size, sorted in tasks."""

    def repeats(t: pa.Table) -> pa.RecordBatch:
        raw = t.column("path").combine_chunks()
        sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]) // 8
        path = np.frombuffer(b"".join(raw.to_pylist()), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        nth = np.arange(len(path)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gram, k, th, low, back = (t.column(c).to_numpy() for c in ("gram", "k", "th", "low", "back"))
        shift, start = back[row] - nth, low[row] + nth
        order = np.lexsort((start, th[row], k[row], path, shift, gram[row]))
        r, p, s = row[order], path[order], shift[order]
        same = (gram[r[1:]] == gram[r[:-1]]) & (p[1:] == p[:-1]) & (s[1:] == s[:-1])
        # a node's first suffix stays, and so do rows that are that very suffix again
        head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
        f = r[head]
        itself = (k[r] == k[f]) & (th[r] == th[f]) & (start[order] == start[order][head])
        gone = order[(head != np.arange(len(order))) & ~itself]
        mask = np.zeros(len(sizes), np.int64)
        np.bitwise_or.at(mask, row[gone], np.int64(1) << nth[gone])
        hit = np.flatnonzero(mask)
        at = pa.array(hit)
        return pa.RecordBatch.from_arrays([t.column("uid").combine_chunks().take(at), t.column("low").combine_chunks().take(at), pa.array(mask[hit])], names=["uid", "low", "mask"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            gram = now.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last prefix may go on in the next batch
            rest = now.slice(cut)
            if cut:
                yield repeats(now.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield repeats(rest)
        release()

    dealt = suffixes.select("gram", "k", "th", "uid", "low", "back", "path").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(each, "uid long, low int, mask long")


def frequent_repeats(suffixes: DataFrame) -> DataFrame:
    """As ``subtree_repeats`` for prefixes of any number of occurrences: one row a window, its first occurrence by partial aggregation."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(4).to_pylist()
            sizes = np.array([len(x) // 8 for x in raw])
            row = np.repeat(np.arange(len(raw)), sizes)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = pa.array(row)
            start = batch.column(3).to_numpy()[row] + nth
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), *(batch.column(i).take(at) for i in (5, 0, 1, 2)), pa.array(start.astype(np.int32))], names=["win", "gram", "k", "th", "uid", "start"])

    each = suffixes.select("k", "th", "uid", "low", "path", "gram").mapInArrow(spread, "win long, gram long, k long, th long, uid long, start int")
    each = written(each, "substring-frequent")
    first = each.groupBy("win", "gram").agg(F.min(F.struct("k", "th", "start")).alias("f"), F.max(F.struct("k", "th", "start")).alias("most"))
    first = first.where("f <> most").select("win", "gram", "f")
    met = each.join(first, ["win", "gram"]).where(F.struct("k", "th", "start") != F.col("f"))
    return met.select("uid", F.col("start").alias("low"), F.lit(1).cast("long").alias("mask"))


def keep_rest(docs: DataFrame, removed: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, text, rest): the words that stay, joined by one space, as bytes; and the text without
    the words that go, as it stood where none did."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                n_words, n_removed, kept, left = [], [], [], []
                texts = part.column(1).to_pylist()
                holes = part.column(3).to_pylist() if removed else [None] * part.num_rows
                for text, hole in zip(texts, holes, strict=True):
                    words = (text or "").encode("utf-8").split()  # bytes.split() splits at exactly [\x20\x09-\x0D]+
                    n_words.append(len(words))
                    if hole:
                        stays = ~covered(hole, len(words))
                        words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                    left.append(kept[-1].decode("utf-8") if hole else text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(left, pa.string()), part.column(2)], names=["doc_id", "n_words", "n_removed", "kept", "text", "rest"])
        release()

    schema = f"doc_id long, n_words long, n_removed long, kept binary, text string, rest {docs.schema['rest'].dataType.simpleString()}"
    return docs.select("doc_id", "text", "rest", *(["holes"] if removed else [])).mapInArrow(each, schema)


def covered(holes: list[dict], n_words: int) -> np.ndarray:
    """Which words the windows of (low, mask) runs cover."""
    low = np.array([x["low"] for x in holes], np.int64)
    mask = np.array([x["mask"] for x in holes], np.int64)
    step = np.zeros(n_words + WINDOW + SPAN, np.int64)
    for nth in range(SPAN):
        at = low[(mask >> nth) & 1 > 0] + nth
        np.add.at(step, at, 1)
        np.add.at(step, at + WINDOW, -1)
    return np.cumsum(step)[:n_words] > 0


def removals(docs: DataFrame) -> DataFrame:
    """(uid, holes): of each document with repeats, the windows to take out, as (low, mask) runs; ``docs`` as ``keyed`` gives it."""
    found = anchors(docs)
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > GROUP).alias("often"))
    marked = found.join(often, "gram").groupBy("uid").agg(F.collect_list(F.struct("at", "often")).alias("found"))
    marked = written(marked, "substring-anchors")
    likely = passing(docs, membership(marked, "uid"))
    suffixes = written(occurrences(likely.join(marked, "uid")), "substring-suffixes")
    gone = subtree_repeats(suffixes.where("not often")).unionByName(frequent_repeats(suffixes.where("often")))
    return written(gone.groupBy("uid").agg(F.collect_list(F.struct("low", "mask")).alias("holes")), "substring-holes")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, text, rest): what stays of each document's words when repeated windows go.

    ``kept`` has the words that stay, joined by one space; ``text`` the same where something goes and else the input;
    ``rest`` the columns named in ``carry``.

    Null and blank texts have no words. Rows of one doc_id and one text are the same document and get the same
    result; different texts under one doc_id are ordered by a hash of the text; rows without doc_id come after
    all others. Documents under 20 words have no window. Empty table: no rows. Other columns are not looked at.
    """
    docs = keyed(docs, key, text, carry)
    holes = removals(docs)
    table = membership(holes, "uid")
    cut = keep_rest(passing(docs, table).join(holes, "uid", "left"), True)
    return cut.unionByName(keep_rest(passing(docs, table, False), False))


def op8_substring(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without its repeated passages, as a digest of what stays."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM f, range(20) t(k) WHERE nth > 1),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
stays AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM k ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN stays USING (doc_id)"""
