"""A model's streamed answer put together from its deltas, whatever their order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS = ["content", "reasoning", "redacted"]
LATEST = ["audio", "images", "videos", "audios", "files", "citations", "usage"]
MAPS = ["extra", "provider_data"]
LISTS = ["tool_calls", "tool_executions"]
CALL = "struct<index: int, id: string, name: string, arguments: string>"


def in_order(column: str) -> Column:
    """A column's values that aren't null, by seq."""
    told = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("v")))))
    return F.transform(told, lambda x: x["v"])


def ordered_maps(column: str) -> Column:
    """Maps one after the other, a later value for a key in place of an earlier; as entries by seq, since maps have no order of their own."""
    told = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("seq", F.map_entries(column).alias("e")))))
    keyed = lambda acc, m: F.concat(F.filter(acc, lambda x: ~F.exists(m["e"], lambda y: y["key"] == x["key"])), m["e"])
    return F.aggregate(told, F.array().cast("array<struct<key: string, value: string>>"), keyed, F.map_from_entries)


def merged_deltas(deltas: DataFrame, key: str) -> DataFrame:
    """One answer a key from deltas (key, seq, role, and any of the columns named above): the first role; texts joined; the last of what a delta replaces;
    maps where a later value holds; lists one after the other. What no delta has is null.

    A delta that arrived twice (the same key and seq) counts once. Deltas without seq come first; columns that the table lacks are left out.
    """
    once = deltas.dropDuplicates([key, "seq"])
    have = lambda names: [c for c in names if c in deltas.columns]
    some = lambda c, value: F.when(F.count(c) > 0, value).alias(c)
    out = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in have(["role"])]
    out += [some(c, F.array_join(in_order(c), "")) for c in have(TEXTS)]
    out += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in have(LATEST)]
    out += [some(c, ordered_maps(c)) for c in have(MAPS)]
    out += [some(c, F.flatten(in_order(c))) for c in have(LISTS)]
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("deltas"), *out)


def whole_calls(calls: Column) -> Column:
    """The tool calls that pieces (index, id, name, arguments) make up, by index: the first id and name, the arguments joined."""
    places = F.array_sort(F.array_distinct(F.transform(calls, lambda c: c["index"])))

    def one(i: Column) -> Column:
        own = F.filter(calls, lambda c: c["index"].eqNullSafe(i))
        first = lambda f: F.get(F.filter(F.transform(own, lambda c: c[f]), lambda x: x.isNotNull()), F.lit(0))
        said = F.array_join(F.transform(own, lambda c: F.coalesce(c["arguments"], F.lit(""))), "")
        return F.struct(i.alias("index"), first("id").alias("id"), first("name").alias("name"), said.alias("arguments"))

    return F.transform(places, one)
