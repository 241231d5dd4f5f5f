"""Near-duplicate detection by chosen-path set similarity join (operator 1).

Documents with equal shingle sets form one class; the join runs over classes. Each of TREES trees has POOL minwise
functions of its own, so the trees are independent, and two sets agree in a token with probability equal to their Jaccard
similarity. At every node a path picks each position of its tree with probability 1 / (similarity * POOL), by a hash
of the path, and goes on to one child for each picked position, named by the token that the set has there. Which paths a
class takes thus depends on its own tokens only, and a task follows them over several levels without a shuffle.

All classes take the picks of the roots. The members of each node met there are checked against two pivots, on full
sets: linear work, which joins groups of copies of any size. Nodes that these links leave in several
components are open: those of at most SMALL members are compared exhaustively; the members of larger ones
follow their paths down by one level for each doubling of the node over SMALL, and the children are compared; what is still
large there is compared in blocks, so no pair is given up. A pair at the threshold of 0.75 is together in 12 of the
16 nodes at the roots on average, so it misses all of them with odds of 2e-10, and, if all these nodes are large
and three levels follow, with odds of some 2e-5.

A comparison first looks at all TOKENS tokens of both, and only pairs with COMMON equal ones are candidates. A node
then names a maximum spanning forest of its candidates between different components, for confirmation on full sets by
the exact sizes of intersection and union. Where these links leave components apart that have more candidates, the
members in question meet once more with their full sets, a set once a node instead of once a pair, and every candidate
between different components is confirmed in its node. Components are found by alternating large-star and small-star
steps on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and, may_contain, membership, written
from quire.llm.textbuf import U, mix, packed, release, runs, sums, window_starts, windows

SHINGLE, TREES, POOL, SMALL = 5, 12, 16, 256
TOKENS = TREES * POOL
#: A token is kept in 16 bits; the nodes at the roots are named by all 64 bits of the value.
WIDE = 2 * TOKENS
#: Tokens that a pair at the threshold has in common at least, but for odds of 7e-6 (the mean is 144 of 192, the deviation 6).
COMMON = 118
#: Members of a block of a node that stays large, in the first look and in the second, where they come with their sets.
BLOCK, BLOCK_SETS = 1024, 256


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, sorted, one document after the other, and where each document's begin."""
    texts.words()
    h = texts.hashed(texts.start, texts.end, lower=True)
    first, per = window_starts(texts.of, texts.n_words, SHINGLE)
    grams = windows(h, SHINGLE)[first] if len(first) else np.empty(0, U)
    doc = np.repeat(np.arange(texts.n), per)
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < SHINGLE))
    whole = np.empty(len(short), U)
    for n in range(1, SHINGLE):  # fewer words: the whole sequence is the one shingle
        mine = texts.n_words[short] == n
        at = texts.of[short[mine]]
        acc = np.full(len(at), n, U)
        for k in range(n):
            acc = mix(acc * U(31) + h[at + k])
        whole[mine] = acc
    doc, grams = np.concatenate((doc, short)), np.concatenate((grams, whole))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(texts.n + 1))


SEEDS = mix(np.arange(1, TOKENS + 1, dtype=U) * U(0xA24BAED4963EE407))


def picks(path: np.ndarray, used: np.ndarray, similarity: float) -> np.ndarray:
    """Which of its tree's POOL positions each path picks (rows): every one not yet ``used`` with odds 1 / (similarity * POOL), at least one."""
    draw = mix(path[:, None] ^ SEEDS[None, :POOL] * U(0xF1357AEA2E62A9C5))
    draw[used] = U((1 << 64) - 1)
    chosen = draw < U(int(2**64 / (similarity * POOL)))
    none = ~chosen.any(1)
    chosen[none, draw[none].argmin(1)] = True
    return chosen


def root_picks(similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(tree, position) of the picks of all roots."""
    return np.nonzero(picks(mix(np.arange(1, TREES + 1, dtype=U)), np.zeros((TREES, POOL), bool), similarity))


def minwise(grams: np.ndarray, of: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The TOKENS tokens of each set, and the nodes it meets at the roots (those of empty sets mean nothing)."""
    full = np.flatnonzero(np.diff(of))
    tree, position = root_picks(similarity)
    place = {k: r for r, k in enumerate((tree * POOL + position).tolist())}
    tokens, nodes = np.zeros((len(of) - 1, TOKENS), "<u2"), np.zeros((len(of) - 1, len(place)), np.int64)
    if len(full):
        for k in range(TOKENS):
            least = mix(np.minimum.reduceat((grams ^ SEEDS[k]) * U(0x9FB21C651E98DF25), of[full]))
            tokens[full, k] = least >> U(48)
            if k in place:
                nodes[full, place[k]] = mix(least + U(k * 0x8CB92BA72F3D8DD7 % (1 << 64))).view(np.int64)
    return tokens, nodes


def unpacked(tokens: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """[n, TOKENS]."""
    return np.frombuffer(b"".join(tokens.to_pylist()), "<u2").reshape(-1, TOKENS)


def digests(grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever the order of its shingles."""
    return sums(mix(grams), of).view(np.int64), sums(mix(grams * U(0xD1342543DE82EF95) + U(1)), of).view(np.int64)


def sketch(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, tokens, nodes): a set's size, a 128-bit digest of it, its minwise tokens and its nodes at the roots."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch):
                grams, of = shingle_sets(texts)
                tokens, nodes = minwise(grams, of, similarity)
                d1, d2 = digests(grams, of)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1) * nodes.shape[1], pa.int32()), pa.array(nodes.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(of)), pa.array(d1), pa.array(d2), packed(tokens.reshape(-1), np.arange(texts.n + 1) * TOKENS), lists],
                    names=["doc_id", "n_shingles", "d1", "d2", "tokens", "nodes"],
                )

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n_shingles long, d1 long, d2 long, tokens binary, nodes array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(d1, d2, shingles): a set's digest and its sorted shingle hashes, packed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in runs(batch):
                grams, of = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([*(pa.array(d) for d in digests(grams, of)), packed(grams, of)], names=["d1", "d2", "shingles"])

    return docs.select("text").mapInArrow(each, "d1 long, d2 long, shingles binary")


def branch(members: DataFrame, similarity: float) -> DataFrame:
    """(node, r, cls, root): the nodes ``levels`` below its own that each (node, r, cls, root, tokens, levels) goes down to; ``r``: the pick at the root."""
    tree_of, position_of = root_picks(similarity)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = unpacked(batch.column(0)).reshape(-1, TREES, POOL)
            path, r, levels = batch.column(1).to_numpy().view(U), batch.column(2).to_numpy(), batch.column(4).to_numpy()
            row, used = np.arange(len(path)), np.arange(POOL)[None, :] == position_of[r][:, None]
            level = 0
            while len(row):
                ends = levels[row] == level
                if ends.any():
                    at = row[ends]
                    yield pa.RecordBatch.from_arrays([pa.array(path[ends].view(np.int64)), pa.array(r[at]), *(batch.column(c).take(pa.array(at)) for c in (3, 5))], names=["node", "r", "cls", "root"])
                path, row, used = path[~ends], row[~ends], used[~ends]
                i, k = np.nonzero(picks(path, used, similarity))
                row, used = row[i], used[i]
                used[np.arange(len(k)), k] = True
                path = mix(path[i] * U(0x8CB92BA72F3D8DD7) + tokens[row, tree_of[r[row]], k].astype(U) + (k.astype(U) << U(40)))
                level += 1

    return members.select("tokens", "node", "r", "cls", "levels", "root").mapInArrow(each, "node long, r int, cls long, root long")


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sizes allow the similarity and whose tokens agree often enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (unpacked(batch.column(2)) == unpacked(batch.column(3))).sum(1) >= COMMON
            yield batch.select([0, 1]).filter(pa.array(agree))

    a = classes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("n"), F.col("tokens").alias("x"))
    b = classes.select(F.col("cls").alias("b"), F.col("n_shingles").alias("m"), F.col("tokens").alias("y"))
    met = pairs.join(a, "a").join(b, "b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return met.select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # merges the two sorted runs
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    met = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def components(links: DataFrame, name: str) -> DataFrame:
    """(cls, root): the smallest class reachable, for every class that has a link.

    Large-star, then small-star, until no link changes; both group by a vertex after a partial aggregation, and
    links of one vertex are never collected into a row.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, f"{name}-edges")
        if edges.isEmpty():
            break
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("root"))


def pairs_within(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of the same group; group g holds of[g] to of[g + 1]."""
    end = np.repeat(of[1:], np.diff(of))
    i = np.arange(of[-1])
    left = end - i - 1
    first = np.repeat(i, left)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(left) - left, left)


def forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the edges (i, j) of a maximum spanning forest over the labels of their ends: each label takes its heaviest edge out, and joined labels go on as one."""
    label, chosen = label.copy(), [np.empty(0, np.int64)]
    left = np.argsort(-weight, kind="stable")
    while True:
        a, b = label[i[left]], label[j[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return np.unique(np.concatenate(chosen))
        names, first = np.unique(np.stack((a, b), 1).reshape(-1), return_index=True)
        edge = first // 2
        chosen.append(left[edge])
        to = np.arange(label.max() + 1)
        to[names] = a[edge] + b[edge] - names
        mutual = names[(to[to[names]] == names) & (names < to[names])]
        to[mutual] = mutual
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def labels(node: np.ndarray, root: np.ndarray) -> np.ndarray:
    """A number from 0 for each different (node, root)."""
    order = np.lexsort((root, node))
    new = (node[order][1:] != node[order][:-1]) | (root[order][1:] != root[order][:-1])
    out = np.empty(len(node), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(new)))
    return out


def candidates(i: np.ndarray, j: np.ndarray, root: np.ndarray, size: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) of different components whose sizes allow the similarity and whose tokens agree often enough, and how many agree."""
    fits = (root[i] != root[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
    i, j = i[fits], j[fits]
    agree = np.concatenate([np.empty(0, np.int64), *((tokens[i[k : k + 20_000]] == tokens[j[k : k + 20_000]]).sum(1) for k in range(0, len(i), 20_000))])
    good = agree >= COMMON
    return i[good], j[good], agree[good]


def first_meeting(i: np.ndarray, j: np.ndarray, r: np.ndarray, mask: np.ndarray, tokens: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Whether this is the first of the small nodes at the roots that i and j share, or, below a large one, whether they share none."""
    shared = (tokens[i][:, roots] == tokens[j][:, roots]) & ((mask[i] & mask[j])[:, None] >> np.arange(len(roots)) & 1 > 0)
    return np.where(shared.any(1), shared.argmax(1) == r[i], True)


def linked(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the pairs have 100 * intersection >= percent * union."""
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else []:
        mine, others = sets[i[some[0]]], [sets[k] for k in j[some]]
        size = np.array([len(x) for x in others])
        flat = np.concatenate(others)
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(size) - size)
        out[some] = 100 * both >= percent * (len(mine) + size - both)
    return out


FOUND = "a long, b long, node long"


def look(table: pa.Table, i: np.ndarray, j: np.ndarray, percent: int) -> pa.Table:
    """What pairs (i, j) of the rows give, as FOUND. Without sets: (a, b) of a forest of candidates, and (a, null, node) for who has other ones. With sets: the
    links of a forest of all that are confirmed."""
    node, cls, root, size = (table.column(c).to_numpy() for c in ("node", "cls", "root", "n_shingles"))
    tokens = unpacked(table.column("tokens"))
    i, j, agree = candidates(i, j, root, size, tokens, percent)
    tree, position = root_picks(percent / 100)
    new = first_meeting(i, j, table.column("r").to_numpy(), table.column("mask").to_numpy(), tokens, tree * POOL + position)
    with_sets = "shingles" in table.column_names
    if with_sets:
        good = np.flatnonzero(new)
        good = good[linked(i[good], j[good], [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()], percent)]
        i, j, agree = i[good], j[good], agree[good]
    few = forest(i, j, agree, labels(node, root))
    more = np.empty(0, np.int64)
    if not with_sets:  # a pair is looked at again in one of its nodes
        new[few] = False
        more = np.unique(np.concatenate((i[new], j[new])))
    a, b = cls[i[few]], cls[j[few]]
    none = pa.nulls(len(few), pa.int64())
    pairs = pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "node": none})
    return pa.concat_tables([pairs, pa.table({"a": cls[more], "b": pa.nulls(len(more), pa.int64()), "node": node[more]})])


def in_small(members: DataFrame, percent: int) -> DataFrame:
    """FOUND of small nodes, each compared whole; a node's rows meet sorted in one task."""

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node = t.column("node").to_numpy()
        of = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        yield from look(t, *pairs_within(of), percent).combine_chunks().to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            node = now.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            rest = now.slice(cut)
            if cut:
                yield from whole(now.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from whole(rest)
        release()

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(each, FOUND)


def in_large(members: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """FOUND of nodes of any size. Members that the node's most frequent component holds need no look at each other:
    only the others, in parts, visit all members, in blocks; a part and a block are a task's group."""

    def compare(table: pa.Table) -> pa.Table:
        cls, visits, other = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "visits", "other"))
        visitors, home = np.flatnonzero(visits), np.flatnonzero(~visits)
        i, j = np.repeat(visitors, len(home)), np.tile(home, len(visitors))
        once = ~other[j] | (cls[j] > cls[i])  # two visitors meet twice
        return look(table, i[once], j[once], percent)

    of_root = members.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    node = of_root.groupBy("node").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("long")
    node = node.select("node", F.col("top.root").alias("main"), parts(F.col("n")).alias("blocks"), parts(F.col("n") - F.col("top.n")).alias("parts"))
    dealt = with_classes(members.join(node, "node"), classes).withColumn("other", F.col("root") != F.col("main")).withColumn("draw", F.xxhash64("cls"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = [*dict.fromkeys([*members.columns, *classes.columns]), "other"]
    home = dealt.select(*kept, F.lit(False).alias("visits"), F.pmod("draw", "blocks").alias("block"), upto("parts").alias("part"))
    away = dealt.where("other").select(*kept, F.lit(True).alias("visits"), upto("blocks").alias("block"), F.pmod("draw", "parts").alias("part"))
    return home.unionByName(away).groupBy("node", "block", "part").applyInArrow(compare, FOUND)


def rooted(rows: DataFrame, root: DataFrame) -> DataFrame:
    """The rows with each class's component as ``root``."""
    return rows.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def opened(level: DataFrame) -> DataFrame:
    """The (node, r, cls, root, ...) whose nodes hold two components or more, with the node's size."""
    of = level.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return level.join(of.select("node", "size"), "node")


def with_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members' rows with their classes' columns. A class meets its columns once, however many nodes it is in: its nodes are its picks and what they branch to."""
    row = F.struct(*(c for c in members.columns if c != "cls"))
    met = classes.join(members.groupBy("cls").agg(F.collect_list(row).alias("rows")), "cls")
    return met.select(*classes.columns, F.explode("rows").alias("row")).select(*classes.columns, "row.*")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Each document's set size and near-duplicate component.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links of similarity percent / 100
    or more between 5-word shingle sets, itself included) and kept (doc_id = component_id).

    Texts are lower-cased in A-Z only; fewer than five words are one shingle. Null, empty and blank texts have
    empty sets, are linked with nothing and kept. Very long texts are handled whole, each in a run of its own.
    Equal sets are always linked. Repeated doc_ids are separate
    rows of one id; rows without doc_id have no part in a component's id and, with no other row in theirs, a null
    component_id; they are never kept. Empty table: no rows. Other columns are not looked at.
    """
    similarity = percent / 100
    docs = id_and(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = written(sketch(docs, similarity), "neardup-sketch")
    some = rows.where("n_shingles > 0")
    first = [F.first(c).alias(c) for c in ("n_shingles", "tokens", "nodes")]
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), *first)
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "neardup-classes")
    tokens = classes.select("cls", "n_shingles", "tokens")
    # two pivots a node: one drawn by a hash, and the earliest document, as an original stands nearer to its copies than they to each other
    members = classes.select("cls", "least", F.posexplode("nodes").alias("r", "node"))
    drawn = F.min(F.struct(F.xxhash64("node", "cls").alias("draw"), "cls"))["cls"]
    earliest = F.min(F.struct(F.coalesce("least", F.lit((1 << 63) - 1)).alias("order"), "cls"))["cls"]
    pivots = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(drawn, earliest)).alias("pivots")).where("n > 1").drop("n")
    members = members.drop("least")
    tried = members.join(pivots, "node").select("cls", F.explode("pivots").alias("pivot")).where("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    likely = written(alike(tried, classes, percent), "neardup-likely")
    root = components(confirm(likely, full_sets(docs, classes, likely), percent), "neardup")
    members = rooted(classes.select("cls", "nodes"), root).select("cls", "root", F.posexplode("nodes").alias("r", "node"))
    met = written(opened(members), "neardup-met")
    levels = F.least(F.lit(POOL - 1), F.ceil(F.log2(F.col("size") / SMALL))).cast("int").alias("levels")
    below = written(branch(with_classes(met.where(F.col("size") > SMALL).select("node", "r", "cls", "root", levels), tokens), similarity), "neardup-below")
    small = met.where(F.col("size") <= SMALL)
    level = small.unionByName(opened(below))
    # in which picks of the roots a class is in a small node
    masks = small.groupBy("cls").agg(F.sum(F.expr("shiftleft(1L, r)")).alias("mask"))
    level = written(level.join(masks, "cls", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))), "neardup-open")
    first = level.select("node", "cls", "root", "size", "r", "mask")
    found = in_small(with_classes(first.where(F.col("size") <= SMALL), tokens), percent).unionByName(in_large(first.where(F.col("size") > SMALL), tokens, percent, BLOCK))
    found = written(found.distinct(), "neardup-found")
    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    joined = root.select(F.col("cls").alias("a"), F.col("root").alias("b"))
    root = components(joined.unionByName(confirm(pairs, full_sets(docs, classes, pairs), percent)), "neardup")
    # those with candidates that no link has joined meet with their sets
    more = found.where("b IS NULL").select(F.col("a").alias("cls"), "node")
    again = written(opened(rooted(level.drop("size", "root").join(more, ["node", "cls"], "left_semi"), root)), "neardup-again")
    sets = full_sets(docs, classes, again.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    second, sets = again.select("node", "cls", "root", "size", "r", "mask"), tokens.join(sets, "cls")
    links = in_small(with_classes(second.where(F.col("size") <= SMALL), sets), percent).unionByName(in_large(second.where(F.col("size") > SMALL), sets, percent, BLOCK_SETS))
    joined = root.select(F.col("cls").alias("a"), F.col("root").alias("b"))
    root = components(joined.unionByName(written(links.select("a", "b").distinct(), "neardup-links")), "neardup")
    names = classes.select("d1", "d2", "cls", "least").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = names.groupBy("root").agg(F.min("least").alias("component_id"))
    names = names.join(least, "root").select("d1", "d2", "component_id")
    out = some.select("doc_id", "n_shingles", "d1", "d2").join(names, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    # rows without words take no part in the join, however many they are
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def full_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes in ``pairs``, from one document of each."""
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    uid = lambda c: F.xxhash64(F.coalesce(c, F.lit(0)))
    named = written(classes.join(named, "cls", "left_semi").select("cls", "d1", "d2", uid("least").alias("uid")), "neardup-named")
    bearers = named.select("uid").distinct()
    table = membership(bearers, "uid")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_contain(table.value, batch.column(0).to_numpy())))

    likely = docs.select(uid("doc_id").alias("uid"), "text").mapInArrow(passing, "uid long, text string")
    sets = sets_of(likely.join(bearers, "uid", "left_semi")).join(named.select("d1", "d2", "cls"), ["d1", "d2"])
    return written(sets.groupBy("cls").agg(F.first("shingles").alias("shingles")), "neardup-sets")


def op1_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.doc_id)
SELECT doc_id, any_value(n.n)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM n JOIN r USING (doc_id) GROUP BY doc_id"""
