"""Checkpoints as a log: batches of chunks that many writers append, read as of one version, compacted now and then.

A folder holds ``data`` (a Parquet folder for each batch, under a name of its own) and ``log`` (a small JSON file for each version). A batch is written first and
becomes visible when its version's file is created; creating fails if that version is there already, and the writer then takes the next one. So a writer that was killed
leaves data that nobody reads, and of two writers at the same time both batches stay.

A version's file is moved or linked to its place, which fails if one is there: atomic on HDFS and local disks, but not on a store of objects.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.epub import TITLE, VERSION, legacy_items, same_inventory
from quire.sources.files import create_text, list_names, read_texts, remove

SCHEMA = "book string, id string, name string, original string, translated string, status string, tokens int, chunk_mode string, xpaths array<string>, n_targets int"
INVENTORY = ("preserved_pre", "preserved_code", "preserved_style")
DIGITS = 12


class Conflict(RuntimeError):
    """What a compaction was to replace isn't there any more."""


@dataclass(frozen=True)
class Snapshot:
    """What a version shows: the batches by folder with the version that each came in, oldest first."""

    version: int
    batches: dict[str, int]


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest version, or an older one that is still there. A folder without a log is version 0, without batches; another schema's log is an error."""
    files = sorted(n for n in list_names(spark, f"{path}/log") if n.endswith(".json"))
    numbers = [int(n[:DIGITS]) for n in files if version is None or int(n[:DIGITS]) <= version]
    texts = read_texts(spark, [f"{path}/log/{n:0{DIGITS}d}.json" for n in numbers])
    batches: dict[str, int] = {}
    for number, text in zip(numbers, texts, strict=True):
        entry = json.loads(text)
        if entry.get("checkpoint_schema_version", -1) != VERSION:
            raise ValueError(f"checkpoint of version {entry.get('checkpoint_schema_version', -1)}")
        for gone in entry.get("replaces", []):
            batches.pop(gone, None)
        batches[entry["batch"]] = entry.get("as_of", number)
    return Snapshot(max(numbers, default=0), batches)


def _publish(spark: SparkSession, path: str, after: int, entry: dict, replaces: list[str]) -> int:
    """Creates the next version's file; another writer's version in between is read, and is a conflict only if it took what this one replaces."""
    while True:
        after += 1
        try:
            create_text(spark, f"{path}/log/{after:0{DIGITS}d}.json", json.dumps(entry | {"checkpoint_schema_version": VERSION}))
            return after
        except FileExistsError:
            if missing := set(replaces) - set(snapshot(spark, path, after).batches):
                raise Conflict(f"replaced by another writer: {sorted(missing)}") from None


def append(chunks: DataFrame, path: str) -> int:
    """A batch of chunks (``SCHEMA``; columns that are missing are null, others are left out), appended; returns its version. Later batches win by (book, name)."""
    spark = chunks.sparkSession
    batch = uuid.uuid4().hex
    _shaped(chunks).write.parquet(f"{path}/data/{batch}")
    return _publish(spark, path, snapshot(spark, path).version, {"batch": batch}, [])


def _shaped(chunks: DataFrame) -> DataFrame:
    wanted = chunks.sparkSession.createDataFrame([], SCHEMA).schema
    return chunks.select(*((F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Every chunk as its last batch left it; of rows of one name in one batch the greatest by all columns. Batches are folders of one read, so the plan doesn't grow with them."""
    shown = snapshot(spark, path, version)
    if not shown.batches:
        return spark.createDataFrame([], SCHEMA)
    each = spark.read.schema(SCHEMA).parquet(*(f"{path}/data/{b}" for b in shown.batches))
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
    order = F.element_at(F.from_json(F.lit(json.dumps(shown.batches)), "map<string,long>"), batch)
    columns = [c for c in each.columns if c not in ("book", "name")]
    newest = each.select("book", "name", F.struct(order.alias("_version"), *columns).alias("c")).groupBy("book", "name").agg(F.max("c").alias("c"))
    return newest.select("book", "name", *(F.col(f"c.{c}") for c in columns)).select(*each.columns)


def compact(spark: SparkSession, path: str) -> int:
    """All batches of the newest version as one, which replaces them; batches that come in meanwhile stay beside it and still win. Returns the version. ``Conflict`` if another compaction was first."""
    shown = snapshot(spark, path)
    if len(shown.batches) < 2:
        return shown.version
    batch = uuid.uuid4().hex
    read(spark, path, shown.version).write.parquet(f"{path}/data/{batch}")
    replaces = list(shown.batches)
    return _publish(spark, path, shown.version, {"batch": batch, "replaces": replaces, "as_of": shown.version}, replaces)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the batches that a compaction has replaced and the log before it, which no reader of the newest version needs; versions before it can't be read any more.
    Batches that no version names stay: their writer may be about to publish them."""
    files = sorted(n for n in list_names(spark, f"{path}/log") if n.endswith(".json"))
    entries = [json.loads(t) for t in read_texts(spark, [f"{path}/log/{n}" for n in files])]
    gone = sorted({b for e in entries for b in e.get("replaces", [])} & set(list_names(spark, f"{path}/data")))
    for b in gone:
        remove(spark, f"{path}/data/{b}")
    # all that a version up to the compacted one had is in the compacted batch
    done = max((e["as_of"] for e in entries if "as_of" in e), default=0)
    for n in files:
        if int(n[:DIGITS]) <= done:
            remove(spark, f"{path}/log/{n}")
    return gone


@dataclass(frozen=True)
class Resumed:
    """``chunks`` (``SCHEMA``) to go on with, ``again`` (book, id, is_nav, kept) whose chunks have to be made anew with the finished title chunks ``kept``, ``unusable`` (book)."""

    chunks: DataFrame
    again: DataFrame
    unusable: DataFrame


def resume(stored_items: DataFrame, chunks: DataFrame, now: DataFrame, most: int = 24) -> Resumed:
    """What of a checkpoint can be used, given the books as they are now.

    ``stored_items`` (book, id, and the protected regions of ``INVENTORY``) as they were at the checkpoint, ``chunks`` as ``read`` gives them, ``now`` (book, id, ``INVENTORY``,
    is_nav, meaningful) as the same books parse today. A book of which any item has another number of protected regions, or that has an item more or less with any, is
    unusable as a whole: none of its chunks come back and all its items are cut again. Of usable books, items with outdated chunks (``legacy_items``)
    are cut again, the rest keep theirs. Books that are no longer there give nothing. Null flags count as false, null lists as empty.
    """
    verdict = same_inventory(stored_items.select("book", "id", *INVENTORY), now.select("book", "id", *INVENTORY))
    here = now.select("book").distinct()
    unusable = verdict.where("NOT usable").select("book").join(here, "book", "left_semi").join(stored_items.select("book").distinct(), "book", "left_semi")
    known = stored_items.select("book").distinct().join(unusable, "book", "left_anti")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    good = chunks.join(known, "book", "left_semi")
    fields = F.struct("name", "translated", "status", "chunk_mode", "xpaths", "n_targets", "original")
    of_item = good.groupBy("book", "id").agg(F.array_sort(F.collect_list(fields)).alias("chunks"))
    items = now.select("book", "id", flag("is_nav").alias("nav"), flag("meaningful").alias("meaningful")).join(of_item, ["book", "id"], "left").join(known, "book", "left_semi")
    old = legacy_items(items, F.col("nav"), F.col("meaningful"), most)
    fresh = now.join(known, "book", "left_anti").select("book", "id", flag("is_nav").alias("is_nav"))
    again = old.unionByName(fresh, allowMissingColumns=True)
    stays = good.join(now.select("book", "id"), ["book", "id"], "left_semi").join(old.select("book", "id"), ["book", "id"], "left_anti")
    return Resumed(stays, again, unusable)


def rechunked(resumed: Resumed, cut: DataFrame) -> DataFrame:
    """The chunks to go on with, whole again: those that stay, the finished titles of items that are cut again, and the new chunks ``cut`` (``SCHEMA``) of those items,
    pending, without the title where a finished one is kept."""
    of = resumed.again.select("book", "id", "kept")
    title = F.coalesce((F.size("xpaths") > 0) & F.forall("xpaths", lambda x: x == TITLE), F.lit(False))
    has = F.coalesce(F.size("kept") > 0, F.lit(False))
    new = cut.drop("kept").join(of, ["book", "id"]).where(~(title & has)).withColumn("status", F.lit("pending")).withColumn("translated", F.lit(None).cast("string"))
    kept = of.select("book", "id", F.explode("kept").alias("c")).select("book", "id", "c.*")
    return _shaped(resumed.chunks).unionByName(_shaped(kept)).unionByName(_shaped(new))

