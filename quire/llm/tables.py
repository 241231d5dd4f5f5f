"""Session-side helpers of the corpus operators: shared scratch tables, input shaping and salted ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and everything runs on one machine."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if told:
        base = told
    elif not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    else:
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="quire-"))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{base}/checkpoints")
    return base


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the cluster's own clean-up takes the folder
        pass


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    It cuts the lineage: a lost executor costs a reread of this table, not a recomputation, and what a
    non-deterministic step gave is fixed from here on. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def id_and(df: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """Only the named columns: whatever else the input carries, also under names the operator uses itself, stays out."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias(key), *(F.col(c) if isinstance(c, str) else c for c in columns))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, so that a batch of very long texts fits a worker; a setting made by the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def salts(n_rows: int, per_salt: int = 20_000) -> int:
    """How many salts deal ``n_rows`` rows into parts of about ``per_salt``, were they all of one key."""
    return max(1, -(-n_rows // per_salt))


def ranked(df: DataFrame, key: str, order: list[str], n_salts: int, name: str = "rank") -> DataFrame:
    """Number the rows of each ``key`` gaplessly from 0 without bringing a key's rows into one task.

    A key's rows are dealt by a hash of ``order`` into ``n_salts`` parts, each part is numbered by itself, and
    the parts' sizes, summed over (key, part) only, give where each part starts. Equal rows are told apart by
    nothing but their place, which is all the same for them.
    """
    from pyspark.sql import Window as W

    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n_salts)))
    part = W.partitionBy(key, "_salt").orderBy(*order)
    dealt = dealt.withColumn("_in", F.row_number().over(part) - 1)
    sizes = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n_salts))).groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_from", F.sum("_n").over(W.partitionBy(key).orderBy("_salt")) - F.col("_n")).drop("_n")
    starts = starts.withColumnRenamed(key, "_k").withColumnRenamed("_salt", "_s")
    met = dealt.join(starts, (dealt[key] == starts["_k"]) & (dealt["_salt"] == starts["_s"]))
    return met.withColumn(name, (F.col("_in") + F.col("_from")).cast("long")).drop("_salt", "_in", "_from", "_k", "_s")


#: Bits of the membership filter below: 2 MB, whatever the number of keys.
FILTER_BITS = 1 << 24


def membership(keys: DataFrame, key: str):
    """A one-hash Bloom filter of a long column, of fixed size, as a broadcast numpy array of 64-bit words.

    It only spares rows a shuffle before an exact join: with very many keys it fills up and lets more rows pass.
    """
    import numpy as np

    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")
    words = keys.select((F.floor(place / 64)).cast("int").alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["w"].to_numpy(int)] = words["b"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(table)


def may_contain(table, keys):
    """Which of the (numpy) keys the filter may hold."""
    import numpy as np

    place = np.mod(keys, FILTER_BITS)
    return (table[place // 64] >> (place % 64)) & 1 > 0
