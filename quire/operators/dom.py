"""The node table: one parse a document, in Arrow batches; everything else joins and windows on it.

A node's descendants are the nodes from node_id + 1 to last_desc, so ancestor and descendant are interval comparisons within a document,
and a node's markup is a slice of the normalised text (ser_start, ser_end; in bytes of UTF-8 raw_start, raw_end), so nothing is stored twice and write-back is
splicing. A node_id is also the node's place in its document's array.
"""

from __future__ import annotations

from collections.abc import Iterator
import re
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.markup import VOID, markup_mode
from quire.functions.text import SECONDARY

#: Characters of markup whose nodes go to Spark in one batch, if it is more than one document.
PARSED = 100_000
#: The tokens and placeholders of ``functions.text``, counted as the markup is written: none crosses a tag, so a node has those of its parts.
#: Attributes whose value is a list of words in HTML (fixed values).
TOKENS = re.compile(r"\w+|[^\w \t\n\x0b\f\r]")
PLACEHOLDERS = re.compile(SECONDARY)
LISTS = {"class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone"}
NODES = "node_id int, parent_id int, last_desc int, depth int, pos int, kind string, name string, attrs map<string,string>, classes array<string>, text string, xpath string, place string, ser_start int, ser_end int, raw_start int, raw_end int, tok int, ph int, seen int, ancestors array<int>"


class Node:
    __slots__ = ("kind", "name", "attrs", "text", "children", "parent")

    def __init__(self, kind: str, name: str = "", attrs: dict | None = None, text: str = "", parent: Node | None = None):
        self.kind, self.name, self.attrs, self.text, self.children, self.parent = kind, name, attrs or {}, text, [], parent


class Builder(HTMLParser):
    """A tree without implied end tags: an end tag closes the nearest open element of its name, or is dropped; the end closes all."""

    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=True)
        self.xml = xml
        self.root = self.at = Node("document")
        if xml:
            self.CDATA_CONTENT_ELEMENTS = ()

    def _case(self, name: str, raw: str | None) -> str:
        return name if not self.xml or not raw else raw

    def _add(self, node: Node) -> Node:
        node.parent = self.at
        self.at.children.append(node)
        return node

    def _raw_name(self) -> str | None:
        raw = self.get_starttag_text() or ""
        return raw[1:].split(None, 1)[0].rstrip("/>") if raw else None

    def _attrs(self, attrs: list[tuple[str, str | None]]) -> dict:
        out = {}
        for k, v in attrs:
            out[k] = " ".join((v or "").split()) if k in LISTS and not self.xml else v or ""
        return out

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self._add(Node("element", self._case(tag, self._raw_name()), self._attrs(attrs)))
        if self.xml or tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(Node("element", self._case(tag, self._raw_name()), self._attrs(attrs)))

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up.parent is not None and up.name.lower() != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        last = self.at.children[-1] if self.at.children else None
        kind = self.at.name if self.at.name in ("script", "style") else "text"
        if last is not None and last.kind == kind:
            last.text += data
        else:
            self._add(Node(kind, text=data))

    def handle_comment(self, data: str) -> None:
        self._add(Node("comment", text=data))

    def handle_decl(self, decl: str) -> None:
        self._add(Node("doctype", text=decl))

    def handle_pi(self, data: str) -> None:
        self._add(Node("pi", text=data))

    def unknown_decl(self, data: str) -> None:
        self._add(Node("cdata", text=data.removeprefix("CDATA[")))


def tree(html: str, xml: bool) -> Node:
    builder = Builder(xml)
    builder.feed(html)
    builder.close()
    return builder.root


def _quoted(value: str) -> str:
    value = escape(value, quote=False)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


def flatten(root: Node) -> tuple[str, list[dict]]:
    """The normalised text, and the rows of all nodes in document order; no recursion, so any depth will do.

    ``xpath`` has an index where siblings share a name; ``place`` is what paths are looked up by (``place_of``): small local names, an index at every step.
    ``tok``, ``ph`` and ``seen`` are the tokens, placeholders and texts that can be read (not blank without placeholders) of a node and all below it.
    """
    out: list[str] = []
    rows: list[dict] = []
    size = raw = tok = ph = read = 0

    known: dict[str, int] = {}  # the tokens of a tag, which mostly stands there many times

    def write(s: str, tag: bool = False) -> None:
        nonlocal size, raw, tok, ph
        out.append(s)
        size += len(s)
        raw += len(s) if s.isascii() else len(s.encode("utf-8"))
        n = known.get(s) if tag else None
        if n is None:
            n = len(TOKENS.findall(s))
            if tag:
                known[s] = n
        tok += n
        if "[" in s:
            ph += len(PLACEHOLDERS.findall(s))

    stack: list[tuple[Node, dict | None, str, str, int, int, bool]] = [(root, None, "", "", 0, -1, False)]
    while stack:
        node, row, path, place, pos, up, leaving = stack.pop()
        if leaving:
            if node.kind == "element" and not (node.name in VOID and not node.children) and not row.get("_short"):
                write(f"</{node.name}>", True)
            row["last_desc"], row["ser_end"], row["raw_end"] = len(rows) - 1, size, raw
            row["tok"], row["ph"], row["seen"] = tok - row["tok"], ph - row["ph"], read - row["seen"]
            continue
        row = {"node_id": len(rows), "parent_id": up, "pos": pos, "kind": node.kind, "name": node.name, "attrs": node.attrs, "text": node.text, "xpath": path, "place": place, "ser_start": size, "raw_start": raw, "tok": tok, "ph": ph, "seen": read}
        row["depth"] = rows[up]["depth"] + 1 if up >= 0 else 0
        row["ancestors"] = [*rows[up]["ancestors"], up] if up >= 0 else []
        row["classes"] = node.attrs.get("class", "").split()
        rows.append(row)
        if node.kind == "element":
            attrs = "".join(f" {k}={_quoted(v)}" for k, v in node.attrs.items())
            row["_short"] = node.name in VOID and not node.children
            write(f"<{node.name}{attrs}/>" if row["_short"] else f"<{node.name}{attrs}>", True)
        elif node.kind == "text":
            write(escape(node.text, quote=False))
            read += bool((PLACEHOLDERS.sub("", node.text) if "[" in node.text else node.text).strip())
        elif node.kind in ("script", "style"):
            write(node.text)
        elif node.kind != "document":
            write({"comment": "<!--{}-->", "doctype": "<!{}>", "pi": "<?{}>", "cdata": "<![CDATA[{}]]>"}[node.kind].format(node.text))
        stack.append((node, row, path, place, pos, up, True))
        names: dict[str, int] = {}
        for c in node.children:
            if c.kind == "element":
                names[c.name] = names.get(c.name, 0) + 1
        seen: dict[str, int] = {}
        local: dict[str, int] = {}
        paths = []
        for c in node.children:
            if c.kind == "element":
                seen[c.name] = seen.get(c.name, 0) + 1
                plain = c.name.rpartition(":")[2].lower()
                local[plain] = local.get(plain, 0) + 1
                paths.append((f"{path}/{c.name}" + (f"[{seen[c.name]}]" if names[c.name] > 1 else ""), f"{place}/{plain}[{local[plain]}]"))
            else:
                paths.append((path, place))
        for i in range(len(node.children) - 1, -1, -1):
            stack.append((node.children[i], None, *paths[i], i, row["node_id"], False))
    return "".join(out), rows


def parse(docs: DataFrame, key: str, html: str, carry: tuple[str, ...] = (), hold: bool = True) -> DataFrame:
    """(key, normalized, nodes array<struct>, and the columns of ``carry``): each document parsed once and, with ``hold``, held in memory or on the executors' disks for the operators that join on it.

    Null markup parses as empty. What a lost executor held is parsed again from the source.
    """
    out = parsed_together(docs, key, {"nodes": html}, carry).withColumnRenamed("nodes_text", "normalized")
    return out.persist(StorageLevel.MEMORY_AND_DISK) if hold else out


def parsed_together(docs: DataFrame, key: str, markup: dict[str, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, for each name of ``markup`` the normalised text name_text and the nodes name, and the columns of ``carry``): several columns of markup parsed in the row they stand in."""
    many = len(markup)
    names = ["key", *(x for m in markup for x in (f"{m}_text", m)), *carry]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.strip().split(" ", 1) for f in NODES.split(", ")]
        kinds = {"int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
        struct = pa.struct([(n, kinds[k]) for n, k in fields])

        def written(markups: pa.Array, modes: pa.Array) -> list[pa.Array]:
            texts, ends, columns = [], [0], {n: [] for n, _ in fields}
            for markup, mode in zip(markups.to_pylist(), modes.to_pylist(), strict=True):
                normal, rows = flatten(tree(markup or "", mode == "xml"))
                texts.append(normal)
                ends.append(ends[-1] + len(rows))
                for n, values in columns.items():
                    values.extend([list(r[n].items()) for r in rows] if n == "attrs" else [r[n] for r in rows])
            flat = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in struct], fields=list(struct))
            return [pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        for batch in batches:
            at = 0
            sizes = [sum(len(m) for m in row if m) for row in zip(*(batch.column(1 + 2 * i).to_pylist() for i in range(many)), strict=True)]
            while at < batch.num_rows:
                # a document or more at once, by their size: nodes take many times the room of their markup
                n, size = 1, sizes[at]
                while n < 100 and at + n < batch.num_rows and size + sizes[at + n] <= PARSED:
                    size += sizes[at + n]
                    n += 1
                part = batch.slice(at, n)
                found = [a for i in range(many) for a in written(part.column(1 + 2 * i), part.column(2 + 2 * i))]
                yield pa.RecordBatch.from_arrays([part.column(0), *found, *part.columns[1 + 2 * many :]], names=names)
                at += n

    told = [x for i, html in enumerate(markup.values()) for x in (F.col(html).alias(f"_html{i}"), F.coalesce(markup_mode(F.col(html)), F.lit("html")).alias(f"_mode{i}"))]
    src = docs.select(F.col(key).alias("key"), *told, *carry)
    struct = ", ".join(f.strip().replace(" ", ": ", 1) for f in NODES.split(", "))
    out = "".join(f", {m}_text string, {m} array<struct<{struct}>>" for m in markup)
    more = "".join(f", {c} {src.schema[c].dataType.simpleString()}" for c in carry)
    return src.mapInArrow(each, f"key {src.schema['key'].dataType.simpleString()}{out}{more}").withColumnRenamed("key", key)


def nodes(parsed: DataFrame, key: str) -> DataFrame:
    """One row a node."""
    return parsed.select(key, F.explode("nodes").alias("n")).select(key, "n.*")


def place_of(xpath):
    """What a path names, in the form of ``place``: prefixes and case don't count, a step without an index is the first; null for a path that is none."""
    steps = F.filter(F.split(xpath, "/"), lambda x: x != "")
    one = r"(?U)^(?:[\w.-]*:)*([\w.-]+)(?:\[(\d+)\])?$"
    index = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, one, 2), F.lit("")).cast("int"), F.lit(1)).cast("string")
    told = F.transform(steps, lambda x: F.concat(F.lit("/"), F.lower(F.regexp_extract(x, one, 1)), F.lit("["), index(x), F.lit("]")))
    return F.when(F.forall(steps, lambda x: x.rlike(one)), F.array_join(told, ""))


def outer(normalized, node):
    """A node's markup."""
    return F.substring(normalized, node["ser_start"] + 1, node["ser_end"] - node["ser_start"])


def outer_of(raw, node):
    """The same from the normalised text as binary: it costs the node's size, where ``outer`` reads all characters before it."""
    return F.substring(raw, node["raw_start"] + 1, node["raw_end"] - node["raw_start"]).cast("string")


def visible(html):
    """What is left of normalised markup without tags, comments, scripts and styles; references as their characters."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>|<[^>]*>", " ")
    return F.replace(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def spliced(normalized, spans):
    """The text with each (low, high, new) span of an ordered array replaced; spans don't overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["high"].alias("at"), F.concat(acc["out"], F.substring(normalized, acc["at"] + 1, s["low"] - acc["at"]), s["new"]).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(normalized, acc["at"] + 1, F.length(normalized))))
