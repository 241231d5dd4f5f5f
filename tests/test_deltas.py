"""Deltas in any order, and the small predicates and paths."""

import random

from pyspark.sql import functions as F

from quire.functions import placeholders
from quire.operators import deltas, status
from quire.sources import epub

SCHEMA = f"k long, seq int, role string, content string, reasoning string, images array<string>, usage string, extra map<string,string>, tool_calls array<{deltas.CALL}>"


def test_deltas_in_any_order(spark):
    rows = [
        (1, 0, None, "He", None, None, "u0", {"a": "1"}, [(0, "c0", "find", '{"q"')]), (1, 1, "assistant", "llo", "because", ["i"], None, {"b": "2", "a": "3"}, [(1, "c1", "read", "{"), (0, None, None, ": 1}")]),
        (1, 2, "user", None, None, None, "u2", None, None), (1, 3, None, "!", None, ["j"], None, {"a": "9"}, [(1, None, None, "}")]), (2, 0, None, None, None, None, None, None, None),
    ]
    want = {1: (4, "assistant", "Hello!", "because", ["j"], "u2", {"a": "9", "b": "2"}, [(0, "c0", "find", '{"q": 1}'), (1, "c1", "read", "{}")]), 2: (1, None, None, None, None, None, None, None)}
    rng = random.Random(1)
    for _ in range(3):
        sent = rows + rng.sample(rows, 2)
        rng.shuffle(sent)
        out = deltas.merged_deltas(spark.createDataFrame(sent, SCHEMA).repartition(3), "k").withColumn("calls", deltas.whole_calls(F.col("tool_calls")))
        got = {r["k"]: (r["deltas"], r["role"], r["content"], r["reasoning"], r["images"], r["usage"], r["extra"], r["calls"] and [tuple(c) for c in r["calls"]]) for r in out.collect()}
        assert got == want
    assert deltas.merged_deltas(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_markers_predicates_and_stylesheets(spark):
    row = spark.range(1).select(
        placeholders.id_indices(F.lit("a [id3] b [id10]")).alias("i"), placeholders.id_position_faults(F.lit("[id1] [id2]"), F.lit("[id1] [id3]")).alias("f"), placeholders.id_position_faults(F.lit("[id1]"), F.lit("x")).alias("g"),
        F.array(*(status.has_work(F.lit(c), F.lit(n)) for c, n in (("x", 1), ("", 1), (None, 1), ("x", 0), ("x", None)))).alias("w"),
    ).first()
    assert row["i"] == [3, 10] and [tuple(x) for x in row["f"]] == [(1, 2, 3)] and [tuple(x) for x in row["g"]] == [(None, 1, 0)] and row["w"] == [True, False, False, False, False]
    item = '<item id="{0}" href="{0}" media-type="text/css"/>'
    opf = "<package>" + "".join(map(item.format, ("css/a.css", "../b.css", "./c/../d.css", "gone.css"))) + "</package>"
    files = [("book", m, b) for m, b in (("OEBPS/content.opf", opf.encode()), ("OEBPS/css/a.css", b""), ("b.css", b""), ("OEBPS/d.css", b""), ("css/a.css", b""))] + [("other", "OEBPS/gone.css", b"")]
    got = epub.declared_stylesheets(spark.createDataFrame(files, "book string, member string, body binary")).collect()
    assert sorted((r["book"], r["member"]) for r in got) == [("book", "OEBPS/css/a.css"), ("book", "OEBPS/d.css"), ("book", "b.css")]
