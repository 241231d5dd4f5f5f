"""Approximate nearest neighbours by a hash-prefix forest (operator 2).

Each tree gives a vector a string of BITS hash bits, the signs of its products with the tree's directions; a tree
is the array of its strings in order, kept with the vectors in blocks of bounded size. A query descends in every tree to the vectors
that share its longest prefix, then all trees ascend together, one bit a step, and take in what the shorter prefix
lets in, until enough candidates are met; those are scored exactly. Largest inner product is turned into
smallest angle by one more component, which brings every vector to the length of the longest.

How many candidates are enough is measured: on a bounded sample of the queries, the forest's answers over all blocks
are held against brute force, and the smallest share of a block that reaches the aimed recall is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.tables import written

TREES, BITS = 12, 32
#: Vectors a block.
BLOCK = 8192
#: Queries whose recall is measured, the recall aimed at (0.9 is asked for) and the shares of a block that are tried.
PROBES, AIM = 256, 0.95
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0)


def directions(dim: int) -> np.ndarray:
    """[TREES, dim + 1, BITS] random directions; the same in every process."""
    return np.random.default_rng(20_240_601).standard_normal((TREES, dim + 1, BITS))


def strings(x: np.ndarray, longest: float) -> np.ndarray:
    """[TREES, n] hash strings as numbers, the first bit highest."""
    gap = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
    lifted = np.concatenate((x, gap[:, None]), 1)
    place = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.stack([((lifted @ d > 0) * place).sum(1, dtype=np.uint64) for d in directions(x.shape[1])])


class Forest:
    """The trees of one block."""

    def __init__(self, x: np.ndarray, longest: float):
        self.x = x
        hashed = strings(x, longest)
        self.order = np.argsort(hashed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashed, self.order, 1)

    def ranges(self, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """[TREES, q] where in each tree those with the same first ``bits`` bits begin and end."""
        cut = np.uint64(BITS - bits)
        low = (of >> cut) << cut
        high = low + ((np.uint64(1) << cut) - np.uint64(1))
        begin = np.stack([np.searchsorted(s, v, side="left") for s, v in zip(self.sorted, low, strict=True)])
        end = np.stack([np.searchsorted(s, v, side="right") for s, v in zip(self.sorted, high, strict=True)])
        return begin, end

    def candidates(self, of: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query (columns of ``of``), the rows met on the synchronous ascent that first meets ``enough`` different ones (all rows at the root)."""
        levels = [self.ranges(of, b) for b in range(BITS, -1, -1)]
        total = np.stack([(e - b).sum(0) for b, e in levels])  # with repeats among the trees: a lower bound on where to stop
        for q in range(of.shape[1]):
            step = int(np.searchsorted(total[:, q], enough))
            seen = np.zeros(len(self.x), bool)
            while True:
                step = min(step, BITS)
                begin, end = levels[step]
                for tree in range(TREES):
                    seen[self.order[tree, begin[tree, q] : end[tree, q]]] = True
                if step == BITS or seen.sum() >= enough:
                    break
                step += 1
            yield np.flatnonzero(seen)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        few = np.flatnonzero(score >= edge)
        return few[np.lexsort((ids[few], -score[few]))[:k]]
    return np.lexsort((ids, -score))[:k]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of the components, whatever rows stand around it."""
    out = x[:, 0] * q[0]
    for i in range(1, x.shape[1]):
        out += x[:, i] * q[i]
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v as doubles) of the rows that take part; a vector of another length than most is no less a fault than a null and takes no part either."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else -1))


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, aim: float = AIM) -> DataFrame:
    """The k nearest of each query (ids divisible by ``every``) among all other rows, by largest inner product.

    Returns query_id, rank (from 1), vec_id and score. All candidates are returned if they are fewer than k; ties go to
    the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite components, and rows without
    vec_id, take no part. Rows of one vec_id count once, with the smallest vector. Equal vectors are indexed once, with their k + 1 smallest ids, which is all
    that a result can show. An empty table gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, vector).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    told = rows.select(F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("s")).agg(F.max("n"), F.max("s")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if told[0] is None:
        return empty
    longest = float(np.sqrt(told[1]))
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    copies = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    distinct = copies.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    n = distinct.count()
    n_blocks = max(1, -(-n // BLOCK))
    index = written(distinct.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int").alias("block")), "ann-index")
    asked = rows.where(F.col("vec_id") % every == 0).select("v").distinct()
    asked = written(asked.select(F.xxhash64("v").alias("qid"), "v"), "ann-queries")
    probes = asked.orderBy(F.xxhash64(F.col("qid"))).limit(PROBES)

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, told[0]))

    def answers(forest: Forest, ids: list[list[int]], q: np.ndarray, qid: np.ndarray, share: float) -> Iterator[tuple]:
        enough = max(k + 1, int(np.ceil(share * len(forest.x))))
        least = np.array([i[0] for i in ids])
        hashed = strings(q, longest)
        found = iter(forest.candidates(hashed, enough)) if share < 1 else None
        for j in range(len(q)):
            near = next(found) if found is not None else np.arange(len(forest.x))
            score = products(forest.x[near], q[j])
            # k + 1 vectors, as one may be the query's own
            for r in best(least[near], score, k + 1).tolist():
                yield qid[j], ids[near[r]], score[r]

    def run(queries: DataFrame, shares: tuple[float, ...]) -> DataFrame:
        """(qid, share, ids, score): each block's k + 1 nearest different vectors for each query."""

        def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                forest = Forest(matrix(left.column("v")), longest)
                ids = left.column("ids").to_pylist()
                q, qid = matrix(right.column("v")), right.column("qid").to_numpy()
                for share in shares:
                    out += [(a, share, b, c) for a, b, c in answers(forest, ids, q, qid, share)]
            return pa.table({"qid": pa.array([r[0] for r in out], pa.int64()), "share": pa.array([r[1] for r in out], pa.float64()), "ids": pa.array([r[2] for r in out], pa.list_(pa.int64())), "score": pa.array([r[3] for r in out], pa.float64())})

        # a stated query set against all rows, in blocks: a block meets queries by the part
        n_parts = max(1, -(-queries.count() // BLOCK))
        part = F.pmod(F.col("qid"), F.lit(n_parts)).cast("int")
        left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        right = queries.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(one, "qid long, share double, ids array<long>, score double")

    probed = run(written(probes, "ann-probes"), SHARES)
    by_rank = W.partitionBy("qid", "share").orderBy(F.desc("score"), F.col("ids")[0])
    top = probed.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k + 1).select("qid", "share", F.col("ids")[0].alias("id"))
    truth = top.where(F.col("share") == 1.0).select("qid", "id")
    hit = top.join(truth, ["qid", "id"]).groupBy("share").count().collect()
    whole = max((r["count"] for r in hit), default=1)
    share = min(r["share"] for r in hit if r["count"] >= aim * whole) if hit else 1.0
    found = run(asked, (share,))
    ask = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("qid"))
    nearest = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("r") <= k + 1)
    each = ask.join(nearest, "qid").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth row of ``embeddings`` among all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
