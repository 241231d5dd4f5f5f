"""Predicates and folds over markup text that need no tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import count, found

#: Elements without an end tag (fixed values).
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
ROOT = r"^\s*(?:<\?xml\b[^>]*>\s*)?<([A-Za-z_][A-Za-z0-9_:.\-]*)"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)\b"
#: A text is complex, and gets a smaller token limit, from so many of these elements on (fixed values).
COMPLEX = {"figure": 1, "section": 3, "aside": 1, "pagebreak": 1}
FACTOR, FLOOR = 0.6, 300


def markup_mode(markup: Column) -> Column:
    """``xml`` for package, container and navigation documents, else ``html``."""
    root = F.lower(F.regexp_extract(markup, ROOT, 1))
    low = F.lower(markup)
    xml = root.isin("ncx", "package", "container") | low.contains("<navmap") | low.contains("<navpoint")
    return F.when((root != "") & (root != "html") & xml, "xml").otherwise("html")


def as_written(markup: Column, known: tuple[str, ...]) -> Column:
    """The markup with only the references of ``known`` standing for characters: any other ampersand, as that of a reference cut off before its semicolon, is text."""
    return F.regexp_replace(markup, rf"&(?!(?:{'|'.join(known)});)", "&amp;")


def is_nav_name(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("toc.ncx") | low.endswith("nav.xhtml") | low.endswith("toc.xhtml")


def effective_limit(limit: int, figures: Column, sections: Column, asides: Column, pagebreaks: Column, is_nav: Column) -> Column:
    hard = (figures >= COMPLEX["figure"]) | (sections >= COMPLEX["section"]) | (asides >= COMPLEX["aside"]) | (pagebreaks >= COMPLEX["pagebreak"])
    return F.when(~is_nav & hard, max(FLOOR, int(limit * FACTOR))).otherwise(limit).cast("long")


def bare_ampersands(html: Column) -> Column:
    """Ampersands that begin no reference; decimal ones need no semicolon, hexadecimal ones aren't known."""
    return count(r"&(?![#][0-9]+|[a-zA-Z][a-zA-Z0-9]*;)", html)


def integrity(html: Column) -> Column:
    """struct<outcome, crossed, unmatched, depth>: a stack of open tags folded over all tags in order.

    outcome: ``ok``, ``crossed`` (an end tag of an element below the top), ``open`` (a ``<`` without ``>``) or ``leftover``.
    An end tag of nothing open is counted, but no fault by itself.
    """
    tags = F.transform(
        found(r"<[^>]*>", html),
        lambda t: F.struct(F.lower(F.regexp_extract(t, TAG_NAME, 1)).alias("name"), t.startswith("</").alias("close"), (t.endswith("/>") | t.startswith("<!")).alias("skip")),
    )
    tags = F.filter(tags, lambda t: (t["name"] != "") & ~t["skip"] & ~t["name"].isin(VOID))
    start = F.struct(F.array().cast("array<string>").alias("st"), F.lit(None).cast("string").alias("crossed"), F.lit(0).cast("long").alias("un"))

    def step(acc: Column, t: Column) -> Column:
        st, top = acc["st"], F.get(acc["st"], F.size(acc["st"]) - 1)
        opened = F.struct(F.array_append(st, t["name"]).alias("st"), acc["crossed"].alias("crossed"), acc["un"].alias("un"))
        popped = F.struct(F.slice(st, 1, F.greatest(F.size(st) - 1, F.lit(0))).alias("st"), acc["crossed"].alias("crossed"), acc["un"].alias("un"))
        crossed = F.struct(st.alias("st"), t["name"].alias("crossed"), acc["un"].alias("un"))
        unmatched = F.struct(st.alias("st"), acc["crossed"].alias("crossed"), (acc["un"] + 1).alias("un"))
        return F.when(acc["crossed"].isNotNull(), acc).when(~t["close"], opened).when(top == t["name"], popped).when(F.array_contains(st, t["name"]), crossed).otherwise(unmatched)

    def finish(acc: Column) -> Column:
        depth = F.size(acc["st"]).cast("long")
        outcome = F.when(acc["crossed"].isNotNull(), "crossed").when(html.rlike("<[^>]*$"), "open").when(depth > 0, "leftover").otherwise("ok")
        return F.struct(outcome.alias("outcome"), acc["crossed"].alias("crossed"), acc["un"].alias("unmatched"), depth.alias("depth"))

    return F.aggregate(tags, start, step, finish)
