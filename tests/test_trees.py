"""Node table, protection, chunking, validation and write-back against stated cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import placeholders
from quire.operators import chunking, dom, protect, validation, writeback
from quire.sources import epub
from quire.streaming import status as stream


def parsed(spark, *html):
    return dom.parse(spark.createDataFrame(list(enumerate(html)), "k long, h string"), "k", "h")


CODE = [
    ("<h2>Listing</h2><pre>for row in rows:\n    keep(row)</pre>", "<h2>Listing</h2>[PRE:0]"),
    ("<p>set</p><code>width=9</code><p>then</p>", "<p>set</p>[CODE:0]<p>then</p>"),
    ('<p>Call <span class="x7"><tt class="y2">openFile</tt></span> first.</p>', "<p>Call [CODE:0] first.</p>"),
    ("<p>Run <code>make</code>, then <code>install</code> twice.</p>", "<p>Run [CODE:0], then [CODE:1] twice.</p>"),
    ("<p><code>Shift</code>/<code>Tab</code>/<code>F4</code></p>", "<p>[CODE:0]</p>"),
    ("<p><code>up</code><i>/</i><code>down</code></p>", "<p>[CODE:0]<i>/</i>[CODE:1]</p>"),
    ("<p><code>in</code>/<code>out</code> beside <code>left</code>/<code>right</code></p>", "<p>[CODE:0] beside [CODE:1]</p>"),
    ('<div class="syntax-highlight"><span>let total = 0;</span></div><p>Sum.</p>', "[PRE:0]<p>Sum.</p>"),
    ("<p>first</p><pre>a</pre><p>second <code>b</code></p><pre>c</pre>", "<p>first</p>[PRE:0]<p>second [CODE:0]</p>[PRE:1]"),
]


def test_protection_and_back(spark):
    p = parsed(spark, *(h for h, _ in CODE))
    out = protect.protect(p, dom.nodes(p, "k"), "k")
    back = placeholders.restored(F.col("html"), F.col("pre"), F.col("code"), F.col("style"))
    got = {r["k"]: (r["html"], r["same"]) for r in out.join(p, "k").select("k", "html", (back == F.col("normalized")).alias("same")).collect()}
    assert [got[i] for i in range(len(CODE))] == [(want, True) for _, want in CODE]


def test_paths(spark):
    rows = dom.nodes(parsed(spark, "<html><body><p>a</p><p>b</p><div><p>c</p></div></body></html>"), "k").where("name = 'p'").orderBy("node_id").collect()
    assert [r["xpath"] for r in rows] == ["/html/body/p[1]", "/html/body/p[2]", "/html/body/div/p"]


def test_chunks(spark):
    code = "".join(f"[CODE:{i}]" for i in range(4))
    cases = {
        0: ("<html><body><p>A</p><p>B</p><p>C</p></body></html>", 1000, 12, [3]),
        1: (f"<html><body><p>x {code}</p><p>y {code}</p><p>z {code}</p></body></html>", 1000, 8, [2, 1]),
        2: (f"<html><body><div><p>a {code}</p><p>b {code}</p></div></body></html>", 1000, 4, [1, 1]),
        3: ("<html><body><p>one long paragraph of words</p></body></html>", 3, 12, [1]),
        4: (f"<html><body><figure>t {code}</figure></body></html>", 1000, 2, [1]),
        5: ("<html><head><title>My Book</title></head><body><p>Content</p></body></html>", 1000, 12, [2]),
    }
    for html, limit, ph, want in cases.values():
        p = parsed(spark, html)
        got = chunking.chunks(p, "k", limit, ph).orderBy("chunk_no").collect()
        assert [len(r["xpaths"]) for r in got] == want


def test_navigation(spark):
    html = "<ncx><navMap>" + "".join(f"<navPoint><navLabel><text>Part {i}</text></navLabel></navPoint>" for i in range(95)) + "</navMap></ncx>"
    got = chunking.nav_chunks(parsed(spark, html), "k", 5000).collect()
    assert sum(len(r["targets"]) for r in got) == 95 and max(len(r["targets"]) for r in got) <= 24
    assert min(got, key=lambda r: r["chunk_no"])["original"].startswith("[NAVTXT:0] Part 0\n")


@pytest.mark.parametrize(
    ("original", "translated", "message"),
    [
        ("<p>Press [CODE:3] or [CODE:4] twice</p>", "<p>按两次 [CODE:4] 或 [CODE:3]</p>", ""),
        ("<p>[CODE:3]</p><p>[CODE:4] [CODE:5]</p>", "<p>[CODE:5]</p><p>[CODE:4] [CODE:3]</p>", "CODE 占位符归属/数量不一致"),
        ('<p><abbr title="Random Access Memory">RAM</abbr></p>', '<p><abbr title="随机存取存储器">RAM</abbr></p>', ""),
        ('<p><a id="s1">Index</a></p>', '<p><a id="s2">索引</a></p>', "标签属性不一致"),
        ("<p>The river had risen over night and nobody crossed it.</p>", "<p>The river had risen over night and nobody crossed it.</p>", "译文与原文相同"),
        ("<p>docker run -it alpine sh</p>", "<p>docker run -it alpine sh</p>", ""),
        ("<li>one</li>", "<li>一</li><li>二</li>", "元素数量不一致"),
        ("<p><em>deep</em> water</p>", "<p>深水</p>", "标签结构不一致"),
        ("<p>open</p>", "<p>开", "HTML标签结构错误"),
        ("<p>[PRE:2][PRE:5]</p>", "<p>[PRE:5][PRE:2] 见下</p>", "PRE 占位符不一致"),
    ],
)
def test_validation(spark, original, translated, message):
    pairs = spark.createDataFrame([(1, original, translated)], "k long, original string, translated string")
    got = validation.validated(pairs, "k").first()
    assert got["message"].startswith(message) and got["is_valid"] == (message == "")


def test_write_back_and_overlap(spark):
    p = parsed(spark, "<html><body><section><p>Dawn</p><p>Dusk</p></section></body></html>")
    chunks = spark.createDataFrame(
        [(0, "broad", 0, ["/html/body/section"], "<section>x</section>", "translated"), (0, "narrow", 1, ["/html/body/section/p[2]"], "<p>黄昏</p>", "translated"), (0, "lost", 2, ["/html/body/p[9]"], "<p>x</p>", "translated"), (0, "few", 3, ["/html/body/section/p[1]", "/html/body/section/p[2]"], "<p>x</p>", "translated")],
        "k long, name string, seq long, xpaths array<string>, translated string, status string",
    )
    html, faults = writeback.write_back(p, dom.nodes(p, "k"), chunks, "k")
    assert html.first()["html"] == "<html><body><section><p>Dawn</p><p>黄昏</p></section></body></html>"
    assert {(r["name"], r["fault"]) for r in faults.collect()} == {("broad", "overlap"), ("lost", "path"), ("few", "count")}


def test_attributes_come_back(spark):
    pairs = spark.createDataFrame([(1, '<p id="a"><img alt="Logo" src="x"/></p>', '<p id="b" x="1"><img alt="标志" src="y"/></p>')], "k long, original string, translated string")
    assert validation.normalized_attributes(pairs, "k").first()["html"] == '<p id="a"><img alt="标志" src="x"/></p>'


def test_epub_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("b.epub", "OEBPS/a.xhtml", bytearray(b"<p>x</p>")), ("b.epub", "META-INF/container.xml", bytearray(b"<c/>"))], "book string, member string, body binary")
    body = epub.archives(files).first()["body"]
    with zipfile.ZipFile(io.BytesIO(bytes(body))) as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
    (tmp_path / "b.epub").write_bytes(bytes(body))
    got = epub.members(spark, str(tmp_path)).where(epub.is_translatable(F.col("member"))).collect()
    assert [(r["member"], bytes(r["body"])) for r in got] == [("OEBPS/a.xhtml", b"<p>x</p>")]


def test_fonts_and_language(spark):
    row = spark.createDataFrame([("h4 { color: red; font-family: Georgia; } kbd { font-family: x; } p.a { margin: 0 }", '<dc:language id="pub-language">en</dc:language><dc:language>en</dc:language>')], "css string, opf string")
    got = row.select(epub.with_fonts(F.col("css")).alias("css"), epub.with_language(F.col("opf")).alias("opf")).first()
    assert got["css"] == 'h4 { color: red; font-family: STYuanti, serif; } kbd { font-family: "Courier New", monospace; } p.a { margin: 0 }'
    bare = spark.createDataFrame([("p { margin: 0 }",)], "css string").select(epub.with_fonts(F.col("css")).alias("css")).first()["css"]
    assert bare.startswith("p { margin: 0 }\n") and epub.TEXT_RULE in bare and epub.CODE_RULE in bare and got["opf"] == '<dc:language id="pub-language">zh-CN</dc:language><dc:language>en</dc:language>'


def test_status_stream(spark, tmp_path):
    for i, rows in enumerate([['{"name":"a","seq":1,"status":"pending","translated":""}'], ['{"name":"a","seq":2,"status":"translated","translated":"x"}', '{"name":"b","seq":1,"status":"pending","translated":""}']]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(rows))
        stream.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r["name"], r["status"]) for r in stream.current(spark, str(tmp_path / "out")).collect()} == {("a", "translated"), ("b", "pending")}


def test_frozen_tags_come_back(spark):
    from quire.operators import workflow

    p = parsed(spark, '<p>a<br/>b<span id="x"></span><span>c</span><img src="y"/></p>')
    out = workflow.frozen(p, "k")
    row = out.select("html", workflow.thawed(F.col("html"), F.col("tags")).alias("back"), workflow.thawed(F.replace("html", F.lit("[TAG:1]"), F.lit("")), F.col("tags")).alias("bad")).first()
    assert row["html"] == "<p>a[TAG:0]b[TAG:1]<span>c</span>[TAG:2]</p>" and row["back"] == p.first()["normalized"] and row["bad"] is None


def test_text_batches(spark):
    from quire.operators import workflow

    p = parsed(spark, "<div>" + "".join(f"<p>t{i} [CODE:{i}]</p>" for i in range(11)) + "<p>[PRE:0]</p></div>")
    got = workflow.text_batches(p, "k").orderBy("batch").collect()
    assert [len(r["units"]) for r in got] == [8, 3] and got[1]["payload"].startswith("[TEXT:8]t8 [CODE:8]\n[TEXT:9]")
    fault = lambda a, b: spark.range(1).select(workflow.text_batch_fault(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert fault("[TEXT:0]a [CODE:1]", "[TEXT:0]甲 [CODE:1]") is None and fault("[TEXT:0]a", "[TEXT:1]甲") == "markers"
    assert fault("[TEXT:0]a", "[TEXT:0] ") == "blank" and fault("[TEXT:0]a [CODE:1]", "[TEXT:0]甲") == "placeholders"


def test_recovery_keeps_what_is_sound(spark):
    items = spark.createDataFrame([(1, "<r><p>a</p><p>b</p></r>")], "k long, normalized string")
    chunks = spark.createDataFrame([(1, "good", 0, [(3, 11, "<p>甲</p>")]), (1, "bad", 1, [(11, 19, "<p>[CODE:0]</p>")])], "k long, name string, seq long, spans array<struct<low: int, high: int, new: string>>")
    row = writeback.recovered(items, chunks, "k").first()
    assert row["html"] == "<r><p>甲</p><p>b</p></r>" and row["left_out"] == ["bad"]


def nav_chunk(spark, html, translated):
    p = parsed(spark, html)
    nodes = dom.nodes(p, "k")
    cut = chunking.nav_chunks(p, "k").select("k", F.lit("nav").alias("name"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("array<string>").alias("xpaths"), "targets", F.lit(translated).alias("translated"), F.lit("translated").alias("status"))
    html, faults = writeback.write_back(p, nodes, cut, "k")
    return html.first()["html"], [r["fault"] for r in faults.collect()]


def test_navigation_is_written_where_it_was_read(spark):
    page = "<nav><i><!-- hint -->Up</i><i>[CODE:4]<b>mid</b>Down &amp; out</i></nav>"
    said = "[NAVTXT:0] A\n[NAVTXT:1] B\n[NAVTXT:2] C\n[NAVTXT:3] D & <E>"
    assert nav_chunk(spark, page, said) == ("<nav><i>AB</i><i>[CODE:4]<b>C</b>D &amp; &lt;E&gt;</i></nav>", [])
    for fault, wrong in (("markers", said.replace("[NAVTXT:1]", "")), ("markers", said.replace("NAVTXT:2", "NAVTXT:7")), ("blank", said.replace(" C", ""))):
        assert nav_chunk(spark, page, wrong) == (page, [fault])


def test_items_are_restored_or_blamed(spark):
    p = parsed(spark, "<r><p>one [CODE:0]</p><p>two</p></r>", "<r><p>one</p><p>two</p></r>", "<r><p>one</p></r>", "<r><p>one [PRE:3]</p><p>x</p></r>")
    items = p.select("k", "normalized", F.lit(None).cast("array<string>").alias("pre"), F.when(F.col("k") == 0, F.array(F.lit("<code>f</code>"))).alias("code"), F.lit(None).cast("array<string>").alias("style"))
    rows = [(0, "a", 0, ["/r/p[1]"], "<p>eins [CODE:0]</p>", "translated"), (1, "a", 0, ["/r/p[1]"], "<p>eins</p>", "translated"), (1, "b", 1, ["/r/p[2]"], "<p>zwei [STYLE:5]</p>", "translated"), (1, "c", 2, ["/r/p[2]"], "<p>zwei</p>", "translation_failed")]
    rows += [(3, "a", 0, ["/r/p[2]"], "<p>y</p>", "translated"), (3, "b", 1, ["/r/p[2]"], "<p>[CODE:1]</p>", "accepted_as_is")]
    chunks = spark.createDataFrame(rows, "k long, name string, seq long, xpaths array<string>, translated string, status string")
    html, status = writeback.restore_items(items, dom.nodes(p, "k"), chunks, "k")
    assert {r["k"]: r["html"] for r in html.collect()} == {0: "<r><p>eins <code>f</code></p><p>two</p></r>", 1: "<r><p>eins</p><p>two</p></r>", 2: "<r><p>one</p></r>", 3: None}
    assert {(r["k"], r["name"]): r["status"] for r in status.collect()} == {(0, "a"): "translated", (1, "a"): "translated", (1, "b"): "writeback_failed", (1, "c"): "translation_failed", (3, "a"): "translated", (3, "b"): "writeback_failed"}


def test_navigation_documents(spark):
    p = parsed(spark, '<html><body><nav class="TOC x"><a>1</a></nav></body></html>', "<html><body><p>x</p></body></html>", "<ncx><navPoint/></ncx>")
    got = {r["k"]: r["is_nav"] for r in chunking.nav_documents(dom.nodes(p, "k"), "k", F.lit("OEBPS/c.xhtml")).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_interval():
    from quire.operators.workflow import Interval

    now, slept = [0.0], []
    gate = Interval(60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert [gate(lambda x: x, i) for i in range(3)] == [0, 1, 2] and slept == [60.0, 60.0]


def test_checkpoints(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"name": "b", "checkpoint_schema_version": 2, "items": [{"id": "i1", "content": "<p>x</p>"}]}')
    (tmp_path / "torn.json").write_text('{"name": "c", "items": [')
    assert [(r["book"], r["id"]) for r in epub.checkpoint(spark, str(tmp_path)).collect()] == [("b", "i1")]
    (tmp_path / "old.json").write_text('{"name": "d", "checkpoint_schema_version": 1, "items": [{"id": "i2"}]}')
    with pytest.raises(Exception, match="checkpoint of version 1"):
        epub.checkpoint(spark, str(tmp_path)).collect()


def test_legacy_items(spark):
    chunk = "array<struct<name: string, translated: string, status: string, chunk_mode: string, xpaths: array<string>, n_targets: int>>"
    nav, title = ("n", "", "pending", "nav_text", [], 9), ("t", "书名", "translated", "html", [epub.TITLE], 0)
    rows = [("a", True, [nav]), ("b", True, [("n", "", "pending", "nav_text", [], 25)]), ("c", True, [("x", "", "pending", "html", ["/p"], 0)]), ("d", False, [title]), ("e", False, []), ("f", False, [title, ("y", "", "pending", "html", ["/html/body/p"], 0)]), ("g", True, None), ("h", False, [("t", "", "pending", "html", [epub.TITLE], 0)])]
    items = spark.createDataFrame([("book", i, n, c) for i, n, c in rows], f"book string, id string, nav boolean, chunks {chunk}")
    got = {r["id"]: None if r["kept"] is None else [c["name"] for c in r["kept"]] for r in epub.legacy_items(items, F.col("nav"), F.lit(True)).collect()}
    assert got == {"b": None, "c": None, "g": None, "d": ["t"], "e": [], "h": []}


def test_legacy_keys_come_back(spark):
    df = spark.createDataFrame([(["<b>$1</b>", "a\\b"],)], "o array<string>")
    keyed = F.concat(F.lit("x "), F.lower(placeholders.random_key(F.get("o", F.lit(0)))), F.lit(" y "), placeholders.random_key(F.get("o", F.lit(1))))
    assert df.select(placeholders.restored_keys(keyed, F.col("o")).alias("t")).first()["t"] == "x <b>$1</b> y a\\b"


def test_proofreading_and_completion(spark, tmp_path):
    from quire.operators import workflow

    rows = [(1, "a", "<p>Two birds</p>", "<p>两只鸟。。您看</p>", "translated", "html"), (2, "b", "<p>x</p>", "", "translation_failed", "html"), (3, "c", "[NAVTXT:0] Up", "[NAVTXT:0] 上", "translated", "nav_text"), (4, "d", "<p>Sea</p>", "<p>大海</p>", "translated", "html"), (5, "e", "<p>Sun</p>", "<p>太阳</p>", "translated", "html")]
    chunks = spark.createDataFrame(rows, "k long, name string, original string, translated string, status string, chunk_mode string")
    first = lambda rs: ['{"corrections": {"鸟": "雀", "[CODE:1]": "x"}}' if "鸟" in r["payload"] else '{"error": "safety policy", "code": 1}' if "海" in r["payload"] else "nonsense" for r in rs]
    second = lambda rs: ['{"corrections": {"大海": "<b>海</b>"}}' if "海" in r["payload"] else "again nonsense" for r in rs]
    found = workflow.proofread(chunks, workflow.Answers(f"{tmp_path}/1", first), workflow.Answers(f"{tmp_path}/2", second), lambda d: d.persist())
    got = {r["name"]: (r["proofread"], [(c["old"], c["new"]) for c in r["corrections"]]) for r in found.collect()}
    assert got == {"a": (True, [("鸟", "雀"), ("[CODE:1]", "x")]), "b": (False, []), "c": (False, []), "d": (True, [("大海", "<b>海</b>")]), "e": (False, [])}
    done = {r["k"]: (r["translated"], r["status"]) for r in workflow.completed(chunks.join(found, "name"), "k").collect()}
    # d: the correction would change the structure, so the text before it stays
    assert done == {1: ("<p>两只雀。你看</p>", "completed"), 2: ("", "translation_failed"), 3: ("[NAVTXT:0] 上", "completed"), 4: ("<p>大海</p>", "completed"), 5: ("<p>太阳</p>", "completed")}
    fixes = F.array(F.struct(F.lit("a").alias("old"), F.lit("b").alias("new")), F.struct(F.lit("bb").alias("old"), F.lit("c").alias("new")), F.struct(F.lit("z").alias("old"), F.lit("").alias("new")))
    assert tuple(spark.range(1).select(workflow.correction_counts(F.lit("<a>aab</a>"), fixes).alias("x")).first()["x"]) == (3, 2)


def test_protection_needs_no_shuffle(spark):
    """Protection and chunks of it are worked out in a document's row: nothing is held, and only finished blocks are dealt out."""
    docs = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CODE)] + [(0, "<p>twice <code>x</code></p>")], "k long, h string")
    out = protect.protect(dom.parse(docs, "k", "h", hold=False), None, "k", ("normalized",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InMemory" not in plan
    got = sorted((r["k"], r["html"], r["code"]) for r in out.where("k = 0").collect())
    assert got == [(0, CODE[0][1], []), (0, "<p>twice [CODE:0]</p>", ["<code>x</code>"])]


def test_pairs_are_validated_in_their_row(spark):
    """Both sides are parsed where they stand: nothing is joined or held, and a key that stands twice gives two rows."""
    pairs = spark.createDataFrame([(1, "<p>old text</p>", "<p>旧文 with some left over words</p>"), (1, "<p>a</p>", "<p>甲</p><p>乙</p>")], "k long, original string, translated string")
    out = validation.validated(pairs, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InMemory" not in plan
    assert sorted(r["message"] for r in out.collect()) == ["", "元素数量不一致"]


def test_of_spans_at_one_place_the_last_chunk_holds(spark):
    items = spark.createDataFrame([(1, "<p>a</p><p>b</p>")], "k long, normalized string")
    span = "array<struct<low:int,high:int,new:string>>"
    found = spark.createDataFrame([(1, "x", 2, None, [(8, 16, "later")]), (1, "y", 1, None, [(8, 16, "earlier"), (0, 8, "first")]), (1, "z", 3, "path", [(0, 8, "no")])], f"k long, name string, seq long, fault string, spans {span}")
    out = writeback.put_in(items, found, "k")
    assert [r["html"] for r in out.collect()] == ["firstlater"]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_chunks_parse_a_document_once(spark):
    """Blocks and the units of a table of contents leave in one pass; markup is sliced by bytes, whatever its characters."""
    html = '<html><body><p>ü𝄞 one two</p><nav class="toc"><a href="x">Größe</a><a href="y">β</a></nav><p>日本 three</p></body></html>'
    p = parsed(spark, html)
    out = chunking.chunks(p, "k", 60)
    got = [(r["chunk_mode"], r["original"], r["xpaths"], [t["text"] for t in r["targets"] or []]) for r in out.orderBy("chunk_no").collect()]
    assert got == [
        ("html_fragment", "<p>ü𝄞 one two</p>", ["/html/body/p[1]"], []),
        ("nav_text", "[NAVTXT:0] Größe\n[NAVTXT:1] β", [], ["Größe", "β"]),
        ("html_fragment", "<p>日本 three</p>", ["/html/body/p[2]"], []),
    ]
    bare = dom.parse(spark.createDataFrame([(0, html)], "k long, h string"), "k", "h", hold=False)
    assert chunking.chunks(bare, "k", 60)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    same = bare.select(F.forall("nodes", lambda n: dom.outer_of(F.col("normalized").cast("binary"), n) == dom.outer(F.col("normalized"), n)).alias("same"))
    assert same.first()["same"]


def test_paths_meet_nodes_without_their_pieces(spark, tmp_path, monkeypatch):
    """Write-back leaves one table of splices and none of what it wrote on its way; a chunk's texts are no part of the join that looks up its paths."""
    from quire.sources import tables

    monkeypatch.setattr(tables, "shared_folder", lambda s: str(tmp_path))
    p = parsed(spark, "<r><p>a</p><p>b</p><p>c</p></r>")
    rows = [(0, "x", 0, ["/r/p[1]", "/r/p[2]"], "<p>A</p><p>B</p>", "translated"), (0, "y", 1, ["/r/p[2]", "/r/p[3]"], "<p>Y</p>", "translated"), (0, "z", 2, ["/r/p[4]"], "<p>Z</p>", "translated")]
    chunks = spark.createDataFrame(rows, "k long, name string, seq long, xpaths array<string>, translated string, status string")
    html, faults = writeback.write_back(p, dom.nodes(p, "k"), chunks, "k", tables.persisted)
    assert len(list((tmp_path / "quire").iterdir())) == 1
    assert html.first()["html"] == "<r><p>A</p><p>B</p><p>c</p></r>" and {r["name"]: r["fault"] for r in faults.collect()} == {"y": "count", "z": "path"}
    cut = tables.persisted(writeback.in_pieces(chunks, "k"))
    plan = writeback.resolved(cut, dom.nodes(p, "k"), "k").select("k", "fault")._jdf.queryExecution().optimizedPlan().toString()
    looked_up = [line for line in plan.splitlines() if "place" in line]
    assert looked_up and not any("piece" in line for line in looked_up)
