"""Books as a data source: by manifest, in parts; written as files and archives, whole or not at all."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import books

CONTAINER = '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
OPF = (
    '<package xmlns="urn:o"><manifest><item id="a" href="text/one%20a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    '<item id="s" href="../s.css" media-type="text/css"/><item id="x" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/></spine></package>'
)
FILES = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/p.opf": OPF, "OEBPS/text/one a.xhtml": "<p>1</p>", "OEBPS/nav.xhtml": "<nav/>", "s.css": "p{}", "OEBPS/extra.xhtml": "<p>not declared</p>"}


def book(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


def test_files_by_manifest(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    book(tmp_path / "in" / "deep" / "b.EPUB", FILES)
    book(tmp_path / "in" / "c.epub", {"x.html": "<p/>"})
    (tmp_path / "in" / "note.txt").write_text("no book")
    df = books.members(spark, str(tmp_path / "in"))
    got = {r["member"]: r for r in df.where(F.col("book").endswith("b.EPUB")).collect()}
    assert {n: bytes(r["body"]).decode() for n, r in got.items()} == FILES
    said = {n: (r["media_type"], r["properties"], r["spine"]) for n, r in got.items() if r["media_type"]}
    assert said == {"OEBPS/text/one a.xhtml": (books.DOCUMENT, None, 1), "OEBPS/nav.xhtml": (books.DOCUMENT, "nav", 0), "s.css": ("text/css", None, None)}
    assert {r["member"] for r in books.documents(df).collect()} == {"OEBPS/text/one a.xhtml", "OEBPS/nav.xhtml"}


def test_a_large_book_has_many_tasks(spark, tmp_path):
    book(tmp_path / "b.epub", FILES | {f"OEBPS/m{i}.xhtml": "x" * 1000 for i in range(40)})
    df = books.members(spark, str(tmp_path), split=5000)
    assert df.rdd.getNumPartitions() >= 8 and df.count() == 47 and df.where("media_type IS NOT NULL").count() == 3
    os.makedirs(tmp_path / "none")
    assert books.members(spark, str(tmp_path / "none")).count() == 0


def test_round_trip_as_files_and_archives(spark, tmp_path):
    rows = [(b, n, t.encode()) for b in ("b1", "b2") for n, t in FILES.items()] + [("b2", "null.txt", None), ("b3", "x.html", b"<p/>")]
    df = spark.createDataFrame(rows, "book string, member string, body binary").withColumn("more", F.lit(1)).repartition(3)
    out = tmp_path / "files"
    os.makedirs(out / "b1"), os.makedirs(out / "other")
    (out / "b1" / "old").write_text("old"), (out / "other" / "stays").write_text("stays")
    books.write_files(df, str(out))
    found = {os.path.relpath(os.path.join(d, f), out): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(out) for f in fs}
    assert found == {f"{b}/{n}": body or b"" for b, n, body in rows} | {"other/stays": b"stays"}
    books.write_archives(df, str(tmp_path / "zips"))
    assert sorted(os.listdir(tmp_path / "zips")) == ["b1.epub", "b2.epub", "b3.epub"]
    for name in ("b1", "b3"):
        z = zipfile.ZipFile(tmp_path / "zips" / f"{name}.epub")
        first = z.infolist()[0]
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and z.testzip() is None and z.read("mimetype") == b"application/epub+zip"
    back = books.members(spark, str(tmp_path / "zips")).where(F.col("book").endswith("b2.epub"))
    assert {r["member"]: bytes(r["body"]) for r in back.collect()} == {n: (t or b"") for b, n, t in rows if b == "b2"}


@pytest.mark.parametrize("write", [books.write_files, books.write_archives])
def test_a_failing_task_leaves_nothing(spark, tmp_path, write):
    rows = [("b", f"m{i}", b"x" * 100) for i in range(50)] + [("b", "../out", b"x"), ("c", "m", b"y")]
    with pytest.raises(Exception, match="no place in a folder"):
        write(spark.createDataFrame(rows, "book string, member string, body binary").repartition(4), str(tmp_path / "o"))
    left = [f for _, _, fs in os.walk(tmp_path) for f in fs]
    assert left == []
