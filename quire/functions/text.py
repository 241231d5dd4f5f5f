"""Text primitives as Spark expressions: token counts, white space, marker segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a run of letters, digits and underscores, or any other visible character (fixed value).
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Placeholders of protected regions (fixed values).
SECONDARY = r"\[(?:PRE|CODE|STYLE):\d+\]"
NAV_MARKER = r"\[NAVTXT:\d+\]"
TEXT_MARKER = r"\[TEXT:\d+\]"
TAG_MARKER = r"\[TAG:\d+\]"
KINDS = ("PRE", "CODE", "STYLE")
CJK = "[一-鿿]"


def count(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it stands there: a lambda's variable isn't copied as an expression is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """The token count of a text, at least 1."""
    return F.greatest(F.lit(1).cast("long"), count(TOKEN, text))


def found(pattern: str, text: Column, group: int = 0) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines with anything but white space."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) > 0)


def without_line_ends(text: Column) -> Column:
    """What is before the line ends at the end."""
    return F.regexp_replace(text, r"\n+$", "")


def segments(text: Column, marker: str, clean=strip) -> Column:
    """array<struct<marker, payload>>: each marker with what follows it up to the next."""
    rest = F.slice(F.split(text, marker, -1), 2, 1 << 30)
    return F.transform(F.arrays_zip(found(marker, text).alias("marker"), rest.alias("payload")), lambda x: F.named_struct(F.lit("marker"), x["marker"], F.lit("payload"), clean(x["payload"])))


def repaired_markers(original: Column, translated: Column) -> Column:
    """Put back [TEXT:n] markers that a translation lost: line by line where the lines correspond, else the first one."""
    o, t = lines(original), lines(translated)
    lead = "^" + TEXT_MARKER
    aligned = (F.size(o) > 0) & (F.size(o) == F.size(t)) & F.forall(o, lambda x: x.rlike(lead))
    by_line = F.array_join(F.zip_with(o, t, lambda a, b: F.concat(F.regexp_extract(a, lead, 0), F.regexp_replace(b, lead, ""))), "\n")
    now = F.when(aligned, by_line).otherwise(translated)
    want, have = found(TEXT_MARKER, original), found(TEXT_MARKER, now)
    swallowed = (F.size(want) > 0) & (F.size(have) + 1 == F.size(want)) & (have == F.slice(want, 2, 1 << 30)) & (F.size(have) > 0)
    before = strip(F.element_at(F.split(now, TEXT_MARKER, -1), 1))
    return F.when(swallowed & (F.length(before) > 0), F.concat(F.get(want, F.lit(0)), now)).otherwise(now)
