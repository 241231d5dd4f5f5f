"""Books as tables: EPUB members, checkpoints, glossaries, manual reports, and what is written back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
CHUNK = "struct<name: string, original: string, translated: string, status: string, tokens: int, chunk_mode: string, xpaths: array<string>>"
ITEM = {"id": "string", "path": "string", "content": "string", "translated": "string", "chunks": f"array<{CHUNK}>"} | dict.fromkeys(("preserved_pre", "preserved_code", "preserved_style"), "array<string>")
BOOK = f"name string, path string, extract_path string, checkpoint_schema_version int, items array<struct<{', '.join(f'{k}: {v}' for k, v in ITEM.items())}>>"


def members(spark: SparkSession, path: str) -> DataFrame:
    """(book, member, body): every file in every EPUB under a path, unzipped in the tasks that read it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                        yield pa.RecordBatch.from_arrays([pa.array([book]), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["book", "member", "body"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(each, "book string, member string, body binary")


def is_translatable(member: Column) -> Column:
    low = F.lower(member)
    return low.rlike(r"\.(xhtml|html|htm|xml|ncx)$") & ~low.endswith("container.xml") & ~F.contains(member, F.lit("META-INF"))


def book_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def derived_paths(path: Column) -> Column:
    """struct<name, extract_dir, checkpoint>: where a book's parts lie beside it."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    name = book_name(path)
    return F.struct(name.alias("name"), F.concat(folder, F.lit("/temp/"), name).alias("extract_dir"), F.concat(folder, F.lit("/"), name, F.lit(".json")).alias("checkpoint"))


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(book, item, ...) rows of checkpoints, a file each; a file that is no JSON is no checkpoint, another version is an error."""
    files = spark.read.text(path, wholetext=True).where(F.try_parse_json("value").isNotNull())
    books = files.select(F.from_json("value", BOOK).alias("b")).select("b.*")
    version = F.coalesce("checkpoint_schema_version", F.lit(-1))
    bad = F.raise_error(F.concat(F.lit("checkpoint of version "), version.cast("string")))
    return books.where(F.when(version == VERSION, F.lit(True)).otherwise(bad.cast("boolean"))).select(F.col("name").alias("book"), F.explode("items").alias("i")).select("book", "i.*")


TITLE = "/html/head/title"


def legacy_items(items: DataFrame, is_nav: Column, meaningful: Column, most: int = 24) -> DataFrame:
    """Items (book, id, chunks) of old checkpoints whose chunks have to be made again: (book, id, is_nav, kept), with finished chunks of the title as ``kept``.

    Navigation without navigation chunks, or with one of more than ``most`` targets; other documents with a meaningful body but without
    chunks, or with chunks of the title alone. Chunks have name, translated, status, chunk_mode, xpaths and n_targets.
    """
    chunks = F.coalesce("chunks", F.filter("chunks", lambda c: F.lit(False)))
    nav_mode = lambda c: F.coalesce(c["chunk_mode"] == "nav_text", F.lit(False))
    oversized = F.exists("chunks", lambda c: nav_mode(c) & (F.coalesce(c["n_targets"], F.lit(0)) > most))
    none = F.coalesce(F.size("chunks"), F.lit(0)) <= 0
    old_nav = none | ~F.exists("chunks", nav_mode) | oversized
    of_title = lambda c: (F.size(c["xpaths"]) > 0) & F.forall(c["xpaths"], lambda x: x == TITLE)
    old = none | F.forall("chunks", lambda c: F.coalesce(of_title(c), F.lit(False)))
    again = F.when(is_nav, F.coalesce(old_nav, F.lit(True))).otherwise(F.coalesce(old, F.lit(True)) & meaningful)
    finished = lambda c: (F.coalesce(F.length(F.trim(c["translated"])), F.lit(0)) > 0) | F.coalesce(c["status"].isin("translated", "accepted_as_is", "completed", "writeback_failed"), F.lit(False))
    kept = F.when(~is_nav, F.filter(chunks, lambda c: F.coalesce(of_title(c), F.lit(False)) & finished(c)))
    return items.where(again).select("book", "id", is_nav.alias("is_nav"), kept.alias("kept"))


def glossary(text: DataFrame) -> DataFrame:
    """(term, translation) of JSON texts (value): pairs with a translation; what isn't an object has none."""
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "translation")).where("length(translation) > 0")


def manual(text: DataFrame) -> DataFrame:
    """(name, manual, pos) of manual reports (value)."""
    report = F.from_json("value", "chunks array<struct<name: string, translated: string>>")
    return text.select(F.posexplode(report["chunks"]).alias("pos", "c")).select(F.col("c.name").alias("name"), F.col("c.translated").alias("manual"), "pos").where("length(manual) > 0")


def same_inventory(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(book, usable): whether every item still has as many protected regions as its checkpoint says."""
    n = lambda p: F.struct(*(F.coalesce(F.size(F.col(f"{p}.{k}")), F.lit(0)).alias(k) for k in ("preserved_pre", "preserved_code", "preserved_style")))
    met = stored.alias("s").join(now.alias("n"), ["book", "id"], "full")
    return met.groupBy("book").agg(F.bool_and(n("s") == n("n")).alias("usable"))


# sinks


def output_name(name: Column, incomplete: Column) -> Column:
    return F.concat(name, F.when(incomplete, "-cn-incomplete.epub").otherwise("-cn.epub"))


def with_language(opf: Column, language: str = "zh-CN") -> Column:
    """A package document in the target language; only elements with the ids that name its language are changed."""
    out = F.regexp_replace(opf, r'(<dc:language\b[^>]*\bid="pub-language"[^>]*>)[^<]*(</dc:language>)', f"$1{language}$2")
    return F.regexp_replace(out, r'(<meta\b(?=[^>]*\bid="meta-language")(?=[^>]*\bproperty="dcterms:language")[^>]*>)[^<]*(</meta>)', f"$1{language}$2")


def stylesheets(opf: Column) -> Column:
    return F.regexp_extract_all(opf, F.lit(r'<item\b[^>]*\bhref="([^"]+\.css)"[^>]*\bmedia-type="text/css"'), F.lit(1))


def declared_stylesheets(members: DataFrame) -> DataFrame:
    """(book, member): the stylesheets that a book's package document declares, by their place beside it, as far as the book (book, member, body) has them."""
    opf = members.where(F.lower("member").endswith(".opf")).select("book", F.regexp_extract("member", r"^(.*/)?[^/]*$", 1).alias("folder"), F.explode(stylesheets(F.decode("body", "UTF-8"))).alias("href"))
    # "a/../b" and "./b" are b
    at = F.regexp_replace(F.concat("folder", "href"), r"(^|/)\./", "$1")
    for _ in range(4):
        at = F.regexp_replace(at, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    told = opf.select("book", at.alias("member")).distinct()
    return told.join(members.select("book", "member"), ["book", "member"], "left_semi")


# The fonts, the rules that take the one for code, and the rules that a stylesheet without fonts gets.
CODE_FONT, TEXT_FONT = '"Courier New", monospace', "STYuanti, serif"
CODE_SELECTOR = r"(?i)\b(code|pre|math|kbd|samp|\.source-code|\.source-inline|\.screen-inline|\.sc-highlight|\.console|\.highlight)\b"
TEXT_RULE = """
/* 全局字体设置 */
body, p, h1, h2, h3, h4, h5, h6, div, span, .figure-caption, .callout-heading, .callout, .index-head {
    font-family: STYuanti, serif;
}
"""
CODE_RULE = """
/* 代码和数学标签使用等宽字体 */
code, pre, math, kbd, samp, .source-code, .source-inline, .screen-inline, .sc-highlight, .console, .highlight {
    font-family: "Courier New", monospace;
}
"""


def with_fonts(css: Column) -> Column:
    """Every rule's (first) font family: one for code, one for the rest; rules for both at the end if none names a family. A declaration counts with its semicolon."""
    rules = F.regexp_extract_all(css, F.lit(r"[^{}]*\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0))
    family = r"(?is)^([^{]*\{[^}]*?)font-family\s*:[^;}]*;"
    put = lambda r, font: F.regexp_replace(r, family, f"$1font-family: {font};")
    one = lambda r: F.when(F.regexp_extract(r, r"^([^{]*)\{", 1).rlike(CODE_SELECTOR), put(r, CODE_FONT)).otherwise(put(r, TEXT_FONT))
    changed = F.array_join(F.transform(rules, one), "")
    return F.when(css.rlike(r"(?i)font-family\s*:[^;]*;"), changed).otherwise(F.concat(css, F.lit("\n" + TEXT_RULE + "\n" + CODE_RULE)))


def archives(files: DataFrame) -> DataFrame:
    """(book, body): EPUB archives of files (book, member, body): the mimetype first and stored, the rest deflated. A book is one row."""

    def zipped(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        rows = dict(zip(table.column("member").to_pylist(), table.column("body").to_pylist(), strict=True))
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("mimetype"), rows.pop("mimetype", None) or b"application/epub+zip", zipfile.ZIP_STORED)
            for name in sorted(rows):
                z.writestr(zipfile.ZipInfo(name), rows[name], zipfile.ZIP_DEFLATED)
        return pa.table({"book": table.column("book")[:1], "body": pa.array([out.getvalue()], pa.binary())})

    return files.groupBy("book").applyInArrow(zipped, "book string, body binary")


def report(failed: DataFrame, findings: DataFrame, generated_at: Column) -> DataFrame:
    """One JSON text (value) of failed chunks (name, original, status) and findings (name, text); no row if there are none of either."""
    a = failed.agg(F.sort_array(F.collect_list(F.struct("name", "original", "status", F.lit("").alias("translated")))).alias("chunks"))
    b = findings.agg(F.sort_array(F.collect_list(F.struct("name", F.substring("text", 1, 240).alias("text")))).alias("suspect_english_terms"))
    both = a.unionByName(b, allowMissingColumns=True).agg(F.max("chunks").alias("chunks"), F.max("suspect_english_terms").alias("suspect_english_terms"))
    value = F.to_json(F.struct(generated_at.alias("generated_at"), F.size("chunks").alias("total"), F.size("suspect_english_terms").alias("suspect_total"), "suspect_english_terms", "chunks"))
    return both.where("size(chunks) + size(suspect_english_terms) > 0").select(value.alias("value"))


def save_checkpoint(chunks: DataFrame, path: str, batch: str) -> None:
    """A batch of finished chunks, appended under its own name; written again it replaces itself. A restart anti-joins what is there."""
    chunks.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def unfinished(chunks: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The chunks (name, ...) that no checkpoint has yet."""
    return chunks.join(spark.read.parquet(path).select("name").distinct(), "name", "left_anti")


def write_items(files: DataFrame, path: str) -> None:
    """Translated and untouched members of all books as a table by book: (book, member, body)."""
    files.write.mode("overwrite").partitionBy("book").parquet(path)
