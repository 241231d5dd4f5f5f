"""Merkle manifest of a corpus: a tree of 16-ary hashes per source, ranked by radix (operator 11).

A row's leaf is the SHA-256 of its fields. A source's leaves stand in the order of doc_id; every 16 of them become a node, and so on
up to the source's subroot; the subroots, in the order of the sources, become the root in the same way.

Ranks come without a sort over a group: the order of a row is a string of digits (its doc_id, then its leaf), and counts by
ever longer prefixes of it say how many rows lie before each prefix among those that share the shorter one. Only rows of one longest prefix
are sorted together. A rank's digits to the base 16 are the path in the tree: nodes are keyed by a prefix of them, and the longest
prefixes are hashed first, two levels a shuffle. The way back down gives each leaf its siblings' hashes, and what its root is by them.
Texts are read once, where the leaf is made; after that a row is its hash and its id. All of it is Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.periodic import CRC32
from quire.llm.tables import id_and, written

FANOUT = 16
#: Nodes that one row of the block tables holds: two levels.
BLOCK = FANOUT * FANOUT
#: Lengths of the prefixes that are counted: 1 + 16 digits of doc_id, then digits of the leaf for rows of one doc_id.
ID_CUTS = (5, 9, 13, 17, 21)
#: The same for sources, in hexadecimal digits of their UTF-8 bytes.
NAME_CUTS = (5, 9, 17, 33, 65, 129)
#: Equal rows are numbered in runs of so many.
COPIES = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf_of(*fields: Column) -> Column:
    """H over each field as ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return hashed(F.concat(*map(told, fields)))


def radix_ranks(rows: DataFrame, group: str, digits: str, n: str, cuts: tuple[int, ...]) -> DataFrame:
    """``rows`` with ``start``: how many rows of the group come before, ``rows`` standing for ``n`` rows each, in the order of ``digits``.

    ``rows`` has each (group, digits) once. Counts by prefix are summed among the prefixes that share the next shorter one, from
    short to long, so that a window holds what differs in a few digits only (65,536 prefixes for ids), whatever the group holds.
    """
    prefix = lambda c: F.substring(digits, 1, c)
    finest = written(rows.groupBy(group, prefix(cuts[-1]).alias("p")).agg(F.sum(n).alias("m")), "ranks-counts")
    above, last = None, 0
    for c in cuts:
        own = finest.groupBy(group, F.substring("p", 1, c).alias("p")).agg(F.sum("m").alias("m")).withColumn("up", F.substring("p", 1, last))
        before = F.sum("m").over(W.partitionBy(group, "up").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
        own = own.withColumn("before", F.coalesce(before, F.lit(0)))
        if above is not None:
            own = own.join(above.withColumnsRenamed({"p": "up", "before": "first"}), [group, "up"]).withColumn("before", F.col("before") + F.col("first"))
        above, last = own.select(group, "p", "before"), c
    inner = F.sum(n).over(W.partitionBy(group, "p").orderBy(digits).rowsBetween(W.unboundedPreceding, -1))
    met = rows.withColumn("p", prefix(cuts[-1])).withColumn("inner", F.coalesce(inner, F.lit(0))).join(above, [group, "p"])
    return met.withColumn("start", F.col("inner") + F.col("before")).drop("p", "inner", "before")


def run_of(hashes: Column, nth: Column) -> Column:
    """The hashes of the run that place ``nth`` is in, from its first to its last."""
    return F.slice(hashes, (F.floor(nth / FANOUT) * FANOUT + 1).cast("int"), F.lit(FANOUT))


def parents(hashes: Column) -> Column:
    """H of every 16 consecutive hashes (the last run may have fewer)."""
    runs = F.sequence(F.lit(0), (F.ceil(F.size(hashes) / FANOUT) - 1).cast("int"))
    return F.transform(runs, lambda r: hashed(F.array_join(F.slice(hashes, r * FANOUT + 1, F.lit(FANOUT)), "")))


def siblings(hashes: Column, nth: Column) -> Column:
    """What stands left and right of place ``nth`` in its run, each joined."""
    run, at = run_of(hashes, nth), (nth % FANOUT).cast("int")
    return F.struct(F.array_join(F.slice(run, F.lit(1), at), "").alias("left"), F.array_join(F.slice(run, at + 2, F.lit(FANOUT)), "").alias("right"))


def blocks_of(nodes: DataFrame, group: str, *carry: str) -> DataFrame:
    """(group, block, levels, h0, h1, h2, rows): nodes (group, pos, h) in blocks of 256 by the leading digits of ``pos``.

    ``h1`` and ``h2`` are the hashes one and two levels up; ``levels`` is how many of them the group still has to go: two, or
    what is left for a group that the block holds alone. ``rows`` has what ``carry`` names, in order.
    """
    block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    whole = nodes.groupBy(group, block).agg(F.array_sort(F.collect_list(F.struct("pos", "h", *carry))).alias("rows"))
    n = F.when(F.col("block") == 0, F.size("rows")).otherwise(BLOCK)  # a group of several blocks has a full first one
    levels = F.when(n == 1, 0).when(n <= FANOUT, 1).otherwise(2)
    whole = whole.select(group, "block", levels.alias("levels"), F.transform("rows", lambda r: r["h"]).alias("h0"), "rows")
    return written(whole.withColumn("h1", parents(F.col("h0"))).withColumn("h2", parents(F.col("h1"))), "merkle-blocks")


def top_of(blocks: DataFrame) -> Column:
    """The block's own hash: of its one node, or one or two levels up."""
    return F.when(F.col("levels") == 0, F.col("h0")[0]).when(F.col("levels") == 1, F.col("h1")[0]).otherwise(F.col("h2")[0])


def path_in(nth: Column) -> Column:
    """array<struct<left, right>>: the siblings at each level of the block, for the node at place ``nth``."""
    first, second = siblings(F.col("h0"), nth), siblings(F.col("h1"), F.floor(nth / FANOUT))
    return F.when(F.col("levels") == 0, F.array().cast("array<struct<left:string,right:string>>")).when(F.col("levels") == 1, F.array(first)).otherwise(F.array(first, second))


class Trie:
    """Block tables of all levels over ``nodes`` (group, pos, h, and ``carry``); ``tops`` (group, h) has what remains of each group."""

    def __init__(self, nodes: DataFrame, group: str, totals: DataFrame, *carry: str):
        self.group, self.levels, self.ended, tops = group, [], [], []
        most = totals.agg(F.max("total")).first()[0] or 0  # one number: the largest group says how many levels there are
        while True:
            blocks = blocks_of(nodes, group, *carry)
            ended = totals.where(F.col("total") <= BLOCK).select(group)
            self.levels.append(blocks)
            self.ended.append(ended)
            tops.append(blocks.where("block = 0").join(ended, group, "left_semi").select(group, top_of(blocks).alias("h")))
            if most <= BLOCK:
                break
            totals = totals.where(F.col("total") > BLOCK).select(group, F.ceil(F.col("total") / BLOCK).cast("long").alias("total"))
            nodes = blocks.join(totals, group, "left_semi").select(group, F.col("block").alias("pos"), top_of(blocks).alias("h"))
            most, carry = -(-most // BLOCK), ()
        self.tops = reduce(DataFrame.unionByName, tops)

    def downward(self, above: DataFrame | None = None) -> DataFrame:
        """The lowest blocks with ``way``, the siblings from a block's own hash up, and ``top``; ``above`` (group, way, top) has those of each group's top, if there is anything above."""
        met = None
        for blocks, ended in zip(reversed(self.levels), reversed(self.ended), strict=True):
            ways = ended.select(self.group, F.array().cast("array<struct<left:string,right:string>>").alias("way"), F.lit(None).cast("string").alias("top")) if above is None else above.join(ended, self.group, "left_semi")
            ways = ways.select(self.group, F.lit(0).cast("long").alias("block"), "way", "top")
            if met is not None:
                ways = ways.unionByName(met.select(self.group, "top", F.explode(self.each(lambda k: F.struct(self.place(k), self.way(k)))).alias("x")).select(self.group, "x.block", "x.way", "top"))
            met = blocks.join(ways, [self.group, "block"])
        return met

    @staticmethod
    def each(make: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("h0") - 1), make)

    @staticmethod
    def place(k: Column) -> Column:
        return (F.col("block") * BLOCK + k).alias("block")

    @staticmethod
    def way(k: Column) -> Column:
        """The siblings of the block's node k from that node up to the root."""
        return F.concat(path_in(k), F.col("way")).alias("way")


def spread(rows: DataFrame) -> DataFrame:
    """A row for each of the ``n`` that a row stands for, at ``pos``; those of many equal rows are dealt over the tasks first."""
    few, many = rows.where(F.col("n") <= COPIES), rows.where(F.col("n") > COPIES)
    runs = many.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES)))).repartition("src", "digits", "run")
    runs = runs.withColumn("start", F.col("start") + F.col("run") * COPIES).withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("run") * COPIES)).drop("run")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return few.unionByName(runs).select("*", each.alias("k")).withColumn("pos", F.col("start") + F.col("k")).drop("k", "start", "n")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``proof`` is an array of (left, right): the hashes of the leaf's siblings, joined, on each side, level by level from the leaf's run over
    the subroot's to the root's. ``folded_root`` is what they and the leaf give again; ``tampered`` is another text to fold (null: the row's
    own), so that ``verified``, folded_root = root, tells whether the row is what the manifest says.

    Nulls are fields like any other (``-``); null sources are one source, before all others, and null doc_ids come first in theirs. Rows of one
    doc_id in a source are ordered by their leaves; rows equal in all fields have a place each. Empty texts are ``0:``; very long texts are hashed whole.
    A source of one row has its leaf as subroot, a corpus of one source its subroot as root. Other columns are not looked at. Empty table: no
    rows. A source, a doc_id or copies of one row may be any part of the table.
    """
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    docs = id_and(docs, "doc_id", *(F.col(c).cast(kinds[c]).alias(c) for c in FIELDS[1:]), (tampered if tampered is not None else F.lit(None).cast("string")).alias("other"))
    first = F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.lit("0" * 17))
    src = F.coalesce(F.concat(F.lit("1"), F.hex(F.encode("source", "UTF-8"))), F.lit("0"))
    bad = F.when(F.col("other") != F.col("text"), leaf_of(*(F.col("other" if c == "text" else c) for c in FIELDS)))
    leaves = docs.select(src.alias("src"), F.concat(first, leaf_of(*map(F.col, FIELDS))).alias("digits"), "doc_id", bad.alias("bad"))
    rows = written(leaves.groupBy("src", "digits", "doc_id", "bad").agg(F.count(F.lit(1)).alias("n")), "merkle-leaves")
    totals = written(rows.groupBy("src").agg(F.sum("n").alias("total")), "merkle-sources")
    nodes = spread(radix_ranks(rows, "src", "digits", "n", ID_CUTS)).select("src", "pos", F.substring("digits", 18, 64).alias("h"), "doc_id", "bad")
    trie = Trie(nodes, "src", totals, "doc_id", "bad")
    subroots = written(trie.tops, "merkle-subroots")
    ranked = radix_ranks(subroots.select(F.col("src").substr(1, 0).alias("all"), F.col("src").alias("digits"), "h", F.lit(1).cast("long").alias("n")), "all", "digits", "n", NAME_CUTS)
    upper = Trie(ranked.select("all", F.col("start").alias("pos"), "h", F.col("digits").alias("src")), "all", subroots.groupBy(F.col("src").substr(1, 0).alias("all")).agg(F.count(F.lit(1)).alias("total")), "src")
    root = upper.tops.select("h").first()
    above = upper.downward().select(F.explode(Trie.each(lambda k: F.struct(F.get(F.col("rows"), k)["src"].alias("src"), Trie.way(k), F.get(F.col("h0"), k).alias("top")))).alias("x")).select("x.*")
    above = written(above, "merkle-above")
    each = trie.downward(above).select(F.col("top").alias("subroot"), F.explode(Trie.each(lambda k: F.struct(F.get(F.col("rows"), k).alias("row"), Trie.way(k)))).alias("x"))
    folded = F.aggregate("x.way", F.coalesce("x.row.bad", "x.row.h"), lambda h, s: hashed(F.concat(s["left"], h, s["right"])))
    out = each.select("x.row.doc_id", F.col("x.row.h").alias("leaf"), "subroot", F.lit(root and root["h"]).cast("string").alias("root"), F.col("x.way").alias("proof"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its proof; where 5 divides the crc32 of the id, the text that is verified has its A-Z lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    out = manifest(docs, F.when(chosen, F.translate("text", UPPER, LOWER)))
    proof = hashed(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def _sql() -> str:
    """The manifest by definition: rows numbered by a sort, the trees level by level, a step's siblings as left@right."""
    told = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(c) for c in (*FIELDS[:-1], text)) + ")"
    up = lambda t, g: f"SELECT {g}, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM {t} WHERE n > 1 GROUP BY {g}, lvl, pos // 16, n"
    beside = lambda t, g: f"""SELECT a.{g}, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '@' || coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS step
      FROM {t} a JOIN {t} b ON a.{g} = b.{g} AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.{g}, a.lvl, a.pos"""  # noqa: E731
    return rf"""WITH RECURSIVE d AS (SELECT *, CASE WHEN {CRC32.format(s="doc_id::VARCHAR")} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents),
l AS (SELECT doc_id, coalesce('1' || source, '0') AS src, {leaf("text")} AS leaf, {leaf("other")} AS bad FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY src) AS n FROM l),
t(src, lvl, pos, h, n) AS (SELECT src, 0, rank, leaf, n FROM r UNION ALL {up("t", "src")}),
s AS (SELECT src, h AS subroot, max(lvl) OVER () AS deep, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(g, lvl, pos, h, n) AS (SELECT 0, 0, pos, subroot, n FROM s UNION ALL {up("u", "g")}),
low AS ({beside("t", "src")}),
high AS ({beside("u", "g")}),
steps AS (SELECT r.src, r.rank, low.lvl AS nth, low.step FROM r JOIN low ON r.src = low.src AND low.pos = r.rank >> (4 * low.lvl)
  UNION ALL SELECT r.src, r.rank, s.deep + high.lvl, high.step FROM r JOIN s USING (src) JOIN high ON high.pos = s.pos >> (4 * high.lvl)),
proofs AS (SELECT src, rank, list(step ORDER BY nth) AS steps FROM steps GROUP BY src, rank),
f AS (SELECT r.doc_id, r.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(steps, []), ''), '@', '')) AS proof_sha256,
  list_reduce(list_prepend(r.bad, coalesce(steps, [])), lambda h, x: sha256(split_part(x, '@', 1) || h || split_part(x, '@', 2))) AS folded_root FROM r JOIN s USING (src) LEFT JOIN proofs USING (src, rank))
SELECT *, folded_root = root AS verified FROM f"""


SQL = _sql()
