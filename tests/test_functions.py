"""Text predicates and folds against stated cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions import language, markup, placeholders, text
from quire.operators import glossary, status, workflow


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("html", "outcome", "unmatched"),
    [
        ("<ul><li>ab</li><li>cd</li></ul>", "ok", 0), ("<b><i>ab</b>", "crossed", 0), ("<td><tr></td></tr>", "crossed", 0), ("<p>a<br>b<img src='q'/><hr/></p>", "ok", 0), ("", "ok", 0),
        ("<b><!-- > note --></b>", "ok", 0), ("<em><i", "open", 0), ("<b></ ></b>", "ok", 0), ("</em>", "ok", 1), ("<td>", "leftover", 0),
    ],
)
def test_integrity(spark, html, outcome, unmatched):
    got = one(spark, markup.integrity(F.col("h")), h=html)
    assert (got["outcome"], got["unmatched"]) == (outcome, unmatched)


def test_tokens_and_modes(spark):
    assert one(spark, text.tokens(F.col("t")), t="cold night") == 2
    assert one(spark, text.tokens(F.col("t")), t="") == 1
    assert one(spark, markup.markup_mode(F.col("t")), t="<?xml version='1.0'?><ncx>") == "xml"
    assert one(spark, markup.markup_mode(F.col("t")), t="<html><navMap>") == "html"
    assert one(spark, markup.bare_ampersands(F.col("t")), t="a & b &amp; &#38 &#x26;") == 2


@pytest.mark.parametrize("broken", ["see [STYLE;7] and [CODE;12].", "see [STYLE: 7] and [CODE: 12].", "see [STYLE; 7] and [CODE;12]."])
def test_repair(spark, broken):
    assert one(spark, placeholders.repaired(F.col("t")), t=broken) == "see [STYLE:7] and [CODE:12]."
    assert one(spark, placeholders.repaired(F.col("t")), t="STYLE;7 [ CODE;1]") == "STYLE;7 [ CODE;1]"


def test_restore_goes_from_the_highest(spark):
    got = one(spark, placeholders.restored(F.lit("[PRE:1][CODE:0][STYLE:0]"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("[CODE:0]"))))
    assert got == "bcc"


@pytest.mark.parametrize(
    ("line", "decision"),
    [
        ("Transport Gateway", "review"), ("Nobody had crossed the frozen river before the winter ended.", "fail"), ("Chapter Seven", "fail"),
        ("Korhonen, P., Lindqvist, A., and Moreau, J. (2019). Measuring the depth of mountain lakes.", "allow"), ("docker run -it alpine sh", "allow"), ("山上的湖水很深，冬天会结冰", "allow"),
    ],
)
def test_residual(spark, line, decision):
    assert one(spark, language.finding(F.col("t"))["decision"], t=line) == decision


def test_target_language(spark):
    for t, want in (("山高水长", True), ("附录", True), ("下面用 Kafka 和 Spark 处理日志，再把结果写入表中。", True), ("river 山", False)):
        assert one(spark, language.is_target_language(F.col("t")), t=t) is want


def test_marker_repair(spark):
    original = "[TEXT:0]cold[TEXT:1]night\n[TEXT:2]!"
    assert one(spark, text.repaired_markers(F.col("o"), F.col("t")), o="[TEXT:0]up\n[TEXT:1]down\n[TEXT:2]!", t="[TEXT:0]上\n[TEXT:1]下\n！") == "[TEXT:0]上\n[TEXT:1]下\n[TEXT:2]！"
    assert one(spark, text.repaired_markers(F.col("o"), F.col("t")), o=original, t="冷[TEXT:1]夜\n[TEXT:2]！").startswith("[TEXT:0]冷[TEXT:1]夜")


@pytest.mark.parametrize(
    ("now", "translated", "process", "then"),
    [
        ("translation_failed", "", True, "translation_failed"), ("translation_failed", "<p>再会</p>", True, "translated"), ("accepted_as_is", "<p>Farewell</p>", False, "accepted_as_is"),
        ("writeback_failed", "<p>再会</p>", True, "translated"), ("writeback_failed", None, False, "writeback_failed"), ("pending", None, True, "pending"), ("completed", "x", False, "completed"),
    ],
)
def test_status(spark, now, translated, process, then):
    got = one(spark, status.next_state(F.lit(now), F.lit("<p>Farewell</p>"), F.lit(translated).cast("string")))
    assert (got["process"], got["status"]) == (process, then)


def test_glossary(spark):
    for term, want in (("tidal energy forecast", True), ("tidal forecast", False), ("harbour", False), ("class loader", False), ("in/out valve", False), ("red green blue white black grey", False)):
        assert one(spark, glossary.is_valid_term(F.col("t"), ["tidal", "forecast"]), t=term) is want
    assert one(spark, glossary.title_case(F.col("t")), t="deep-sea o'connor") == "Deep-Sea O'Connor"
    assert one(spark, glossary.matching(F.col("t"), ["CPU", "BUS", "central processing unit"]), t="The CPU here is a central processing unit") == ["central processing unit", "CPU"]


def test_corrections(spark):
    fixes = F.array(F.struct(F.lit("Map of the coast").alias("old"), F.lit("X").alias("new")), F.struct(F.lit("海岸").alias("old"), F.lit("海滨").alias("new")), F.struct(F.lit("a[CODE:1]").alias("old"), F.lit("b").alias("new")))
    html = '<p>海岸</p><img alt="Map of the coast" src="x"/>'
    assert one(spark, workflow.corrected(F.lit(html), workflow.usable_corrections(fixes))) == html.replace("海岸", "海滨")
    assert one(spark, F.size(workflow.usable_corrections(fixes))) == 2


def test_errors_and_history(spark):
    assert one(spark, workflow.is_safety_error(F.lit("安全审核失败"), F.lit(200))) is True
    assert one(spark, workflow.is_safety_error(F.lit("network timeout"), F.lit(200))) is False
    assert one(spark, workflow.history(F.array(*map(F.lit, ["a", "a", "b", "c", "d", "e"])))) == ["b", "c", "d", "e"]
    assert one(spark, workflow.sanitized(F.lit("\x1b[31m<p>a</p>\\n<p>\x07b\\nc</p>"))) == "<p>a</p>\n<p>b\\nc</p>"
    assert one(spark, workflow.parsed_response(F.lit('{"translation": "OK"}'))) == "OK"


def test_cheap_signs_of_patterns_miss_nothing(spark):
    import random

    from pyspark.sql import functions as F

    from quire.functions import language as lang

    bits = "git commit|https://x.org/a|src/app.py|npm|snake_case|camelCase|[CODE:1]|[Panda 2013]|(Institute of Technology)|`a b`|me@ex.org|file.PY|.jſ|Next.js|gitHub|fasT open|HookHub|don't'|<b>|a.|--flag|译文".split("|")
    rng = random.Random(4)
    df = spark.createDataFrame([(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 5))),) for _ in range(2000)], "t string")
    every = F.regexp_replace("t", lang.PLACEHOLDER, " ")
    for pattern in (lang.CITATION, f"(?iU){lang.CODEISH}", f"(?iU){lang.INSTITUTION}", *(f"(?i){p}" for p in lang.PHRASES)):
        every = F.regexp_replace(every, pattern, " ")
    assert df.where(lang.cleaned(F.col("t")) != every).count() == 0
    assert df.where(lang.is_technical(F.col("t")) & ~F.trim("t").rlike(lang.SIGNAL)).count() == 0 and df.where(lang.is_technical(F.col("t"))).count() > 100
