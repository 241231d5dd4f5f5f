"""The query catalogue: name -> Spark query, and name -> SQL that must give the same rows.

Tables lack some shapes the operators are for (commands, placeholders, CJK text), so queries inject them into whole tables by rules
that both sides state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import language, markup, placeholders, text
from quire.operators import chunking, dom, glossary, packing, status, workflow
from quire.plans import mining, trees, whole
from quire.sources.tables import persisted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: DuckDB's forms of shared pieces.
TOK = r"greatest(1, len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')))::BIGINT"
LINES = r"""lines AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS pos, line FROM (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '\S'))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, pos, line): the lines of documents that aren't blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    kept = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    return docs.select("doc_id", "lang", F.posexplode(kept).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query("token_count_by_lang", f"SELECT lang, count(*)::BIGINT AS n_docs, sum({TOK.format('text')})::BIGINT AS tokens FROM documents GROUP BY lang")
def token_count_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(text.tokens(F.col("text"))).alias("tokens"))


def _fold(units: str, key: str, limit: int, ph: int | None = None, most: int | None = None) -> str:
    """Recursive SQL of the packing fold over ``units`` (key, pos from 0, tok, ph)."""
    over = f"p.tok + u.tok > {limit}" + (f" OR p.ph + u.ph > {ph}" if ph is not None else "") + (f" OR p.n >= {most}" if most is not None else "")
    return f"""fold AS (
  SELECT {key}, pos, tok AS t, ph AS h, tok, ph, 1::BIGINT AS n, 0::BIGINT AS cid FROM {units} WHERE pos = 0
  UNION ALL
  SELECT u.{key}, u.pos, u.tok, u.ph, CASE WHEN {over} THEN u.tok ELSE p.tok + u.tok END, CASE WHEN {over} THEN u.ph ELSE p.ph + u.ph END,
         CASE WHEN {over} THEN 1 ELSE p.n + 1 END, CASE WHEN {over} THEN p.cid + 1 ELSE p.cid END
  FROM fold p JOIN {units} u ON u.{key} = p.{key} AND u.pos = p.pos + 1)"""


@query(
    "greedy_chunks",
    rf"""WITH RECURSIVE {LINES}, units AS MATERIALIZED (SELECT doc_id, pos, {TOK.format('line')} AS tok, 0::BIGINT AS ph FROM lines), {_fold('units', 'doc_id', 60)}
SELECT doc_id, cid AS chunk_no, count(*)::BIGINT AS n_blocks, sum(t)::BIGINT AS tokens, substr(md5(doc_id::VARCHAR || '#' || cid::VARCHAR), 1, 8) AS name FROM fold GROUP BY doc_id, cid""",
)
def greedy_chunks(spark, sf_dir):
    """Lines of documents packed into chunks of at most 60 tokens."""
    units = doc_lines(spark, sf_dir).select("doc_id", "pos", text.tokens(F.col("line")).alias("tok"), F.lit(0).alias("ph"))
    chunks = packing.packed(units, ["doc_id"], 60).groupBy("doc_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("tok").alias("tokens"))
    return chunks.withColumn("name", packing.chunk_name(F.col("doc_id"), F.col("chunk_no")))


@query(
    "chunk_two_limits",
    rf"""WITH RECURSIVE {LINES}, units AS MATERIALIZED (SELECT doc_id, pos, {TOK.format("line || CASE WHEN pos % 3 = 0 THEN ' [CODE:' || pos || ']' ELSE '' END")} AS tok, CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS ph FROM lines),
{_fold('units', 'doc_id', 120, 2)}
SELECT doc_id, cid AS chunk_no, count(*)::BIGINT AS n_blocks, sum(t)::BIGINT AS tokens, sum(h)::BIGINT AS placeholders FROM fold GROUP BY doc_id, cid""",
)
def chunk_two_limits(spark, sf_dir):
    """Lines, every third with a placeholder, packed under a token and a placeholder limit."""
    marked = F.concat("line", F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" [CODE:"), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.lit("")))
    units = doc_lines(spark, sf_dir).select("doc_id", "pos", text.tokens(marked).alias("tok"), text.count(text.SECONDARY, marked).alias("ph"))
    return packing.packed(units, ["doc_id"], 120, 2).groupBy("doc_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("tok").alias("tokens"), F.sum("ph").alias("placeholders"))


@query(
    "nav_pack",
    rf"""WITH RECURSIVE u0 AS (SELECT page_id, unnest(a) AS label, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]+)</a>', 1) AS a FROM pages)),
units AS MATERIALIZED (SELECT page_id, pos::BIGINT AS pos, {TOK.format("'[NAVTXT:' || pos || '] ' || label")} AS tok, 0::BIGINT AS ph FROM u0), {_fold('units', 'page_id', 30, None, 24)}
SELECT page_id, cid AS chunk_no, count(*)::BIGINT AS n_units, sum(t)::BIGINT AS tokens FROM fold GROUP BY page_id, cid""",
)
def nav_pack(spark, sf_dir):
    """Link texts of pages as numbered navigation units, at most 24 and 30 tokens a chunk."""
    labels = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]+)</a>'), F.lit(1))
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(labels).alias("pos", "label"))
    units = each.select("page_id", "pos", text.tokens(F.concat(F.lit("[NAVTXT:"), F.col("pos").cast("string"), F.lit("] "), "label")).alias("tok"), F.lit(0).alias("ph"))
    return packing.packed(units, ["page_id"], 30, None, 24).groupBy("page_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_units"), F.sum("tok").alias("tokens"))


_TAGS = r"""tags AS (SELECT id, i, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)\b', 1)) AS name, t[2] = '/' AS closing
  FROM (SELECT id, unnest(regexp_extract_all(html, '<[^>]*>')) AS t, generate_subscripts(regexp_extract_all(html, '<[^>]*>'), 1) AS i FROM src) WHERE t NOT LIKE '%/>' AND t NOT LIKE '<!%'),
kept AS MATERIALIZED (SELECT id, name, closing, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM tags
  WHERE name <> '' AND name NOT IN ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr')),
size AS (SELECT src.id, count(k) AS n, any_value(html) AS html FROM src LEFT JOIN kept ON kept.id = src.id GROUP BY src.id),
walk AS (SELECT id, 0::BIGINT AS k, []::VARCHAR[] AS st, NULL::VARCHAR AS crossed, 0::BIGINT AS un FROM src
  UNION ALL SELECT w.id, w.k + 1,
    CASE WHEN NOT t.closing THEN list_append(w.st, t.name) WHEN len(w.st) > 0 AND w.st[len(w.st)] = t.name THEN w.st[1:len(w.st) - 1] ELSE w.st END,
    CASE WHEN t.closing AND NOT (len(w.st) > 0 AND w.st[len(w.st)] = t.name) AND list_contains(w.st, t.name) THEN t.name END,
    CASE WHEN t.closing AND NOT list_contains(w.st, t.name) THEN w.un + 1 ELSE w.un END
  FROM walk w JOIN kept t ON t.id = w.id AND t.k = w.k + 1 WHERE w.crossed IS NULL)
SELECT s.id, CASE WHEN crossed IS NOT NULL THEN 'crossed' WHEN regexp_matches(s.html, '<[^>]*$') THEN 'open' WHEN len(st) > 0 THEN 'leftover' ELSE 'ok' END AS outcome,
  crossed, un AS unmatched, len(st)::BIGINT AS depth FROM size s JOIN walk w ON w.id = s.id WHERE w.crossed IS NOT NULL OR w.k = s.n"""


def _integrity(src: DataFrame) -> DataFrame:
    return src.select("id", markup.integrity(F.col("html")).alias("v")).select("id", "v.*")


@query("html_integrity", f"WITH RECURSIVE src AS (SELECT page_id AS id, html FROM pages), {_TAGS}")
def html_integrity(spark, sf_dir):
    return _integrity(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))


_WRAPPED = "'<div><p>' || replace(text, chr(10), CASE doc_id % 5 WHEN 0 THEN '</p><p>' WHEN 1 THEN '<br/>' WHEN 2 THEN '</p></i><p>' WHEN 3 THEN '<em></p></em><p>' ELSE '<!-- - --><hr>' END) || CASE WHEN doc_id % 7 = 0 THEN '</p></div><' WHEN doc_id % 11 = 0 THEN '</p>' ELSE '</p></div>' END"


@query("fragment_integrity", f"WITH RECURSIVE src AS (SELECT doc_id AS id, {_WRAPPED} AS html FROM documents), {_TAGS}")
def fragment_integrity(spark, sf_dir):
    """Documents wrapped in markup of five kinds, sound, crossed, cut off and left open."""
    between = "CASE doc_id % 5 WHEN 0 THEN '</p><p>' WHEN 1 THEN '<br/>' WHEN 2 THEN '</p></i><p>' WHEN 3 THEN '<em></p></em><p>' ELSE '<!-- - --><hr>' END"
    html = F.expr(f"concat('<div><p>', replace(text, chr(10), {between}), CASE WHEN doc_id % 7 = 0 THEN '</p></div><' WHEN doc_id % 11 = 0 THEN '</p>' ELSE '</p></div>' END)")
    return _integrity(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), html.alias("html")))


_AMP = "replace(text, '. ', CASE doc_id % 6 WHEN 0 THEN ' & ' WHEN 1 THEN ' &amp; ' WHEN 2 THEN ' &#38 ' WHEN 3 THEN ' &#x26; ' WHEN 4 THEN '&copy ' ELSE '. ' END)"


@query("bare_ampersand", rf"SELECT doc_id, (len(regexp_extract_all(t, '&')) - len(regexp_extract_all(t, '&(#[0-9]+|[a-zA-Z][a-zA-Z0-9]*;)')))::BIGINT AS bare FROM (SELECT doc_id, {_AMP} AS t FROM documents)")
def bare_ampersand(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", markup.bare_ampersands(F.expr(_AMP)).alias("bare"))


_HEADS = "CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN '<?xml version=\"1.0\"?><ncx>' || html WHEN 2 THEN '<package>' || html WHEN 3 THEN '<div><navPoint>' || html WHEN 4 THEN 'x ' || html ELSE '  <section>' || html END"


@query(
    "markup_mode",
    rf"""SELECT page_id, CASE WHEN root <> '' AND root <> 'html' AND (root IN ('ncx', 'package', 'container') OR contains(lower(h), '<navmap') OR contains(lower(h), '<navpoint')) THEN 'xml' ELSE 'html' END AS mode
FROM (SELECT page_id, h, lower(regexp_extract(h, '^\s*(?:<\?xml\b[^>]*>\s*)?<([A-Za-z_][A-Za-z0-9_:.\-]*)', 1)) AS root FROM (SELECT page_id, {_HEADS} AS h FROM pages))""",
)
def markup_mode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_HEADS).alias("h")).select("page_id", markup.markup_mode(F.col("h")).alias("mode"))


_PATH = "CASE page_id % 5 WHEN 0 THEN 'OEBPS/toc.ncx' WHEN 1 THEN 'OEBPS/Nav.XHTML' WHEN 2 THEN url WHEN 3 THEN url || '/toc.xhtml' ELSE url || '/chapter.xhtml' END"


@query("nav_name", f"SELECT page_id, contains(p, 'toc.ncx') OR p LIKE '%nav.xhtml' OR p LIKE '%toc.xhtml' AS is_nav FROM (SELECT page_id, lower({_PATH}) AS p FROM pages)")
def nav_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.is_nav_name(F.expr(_PATH)).alias("is_nav"))


@query(
    "effective_limit",
    r"""SELECT page_id, CASE WHEN page_id % 9 <> 0 AND (f >= 1 OR s >= 3 OR a >= 1 OR b >= 1) THEN 720 ELSE 1200 END::BIGINT AS token_limit FROM (
SELECT page_id, len(regexp_extract_all(h, '<figure[ >]')) AS f, len(regexp_extract_all(h, '<section[ >]')) AS s, len(regexp_extract_all(h, '<aside[ >]')) AS a, len(regexp_extract_all(h, 'epub:type="pagebreak"')) AS b
FROM (SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '<figure>' WHEN 1 THEN '<section><section>' WHEN 2 THEN '<section><section class="x"><section>' WHEN 3 THEN '<span epub:type="pagebreak">' ELSE '' END AS h FROM pages))""",
)
def effective_limit(spark, sf_dir):
    html = F.expr("concat(html, CASE page_id % 5 WHEN 0 THEN '<figure>' WHEN 1 THEN '<section><section>' WHEN 2 THEN '<section><section class=\"x\"><section>' WHEN 3 THEN '<span epub:type=\"pagebreak\">' ELSE '' END)")
    n = lambda p: text.count(p, F.col("h"))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("h"))
    return pages.select("page_id", markup.effective_limit(1200, n("<figure[ >]"), n("<section[ >]"), n("<aside[ >]"), n('epub:type="pagebreak"'), F.col("page_id") % 9 == 0).alias("token_limit"))


_MIXED = "CASE doc_id % 4 WHEN 0 THEN '你好世界' WHEN 1 THEN repeat('译文', 40) || text WHEN 2 THEN repeat('译', 20000) || text ELSE text END"


@query(
    "already_target_language",
    rf"SELECT doc_id, cjk, latin, cjk >= 2 AND (latin = 0 OR cjk >= greatest(4.0, latin * 0.5)) AS is_target FROM (SELECT doc_id, len(regexp_extract_all(t, '[一-鿿]'))::BIGINT AS cjk, len(regexp_extract_all(t, '[A-Za-z]'))::BIGINT AS latin FROM (SELECT doc_id, {_MIXED} AS t FROM documents))",
)
def already_target_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MIXED).alias("t"))
    return docs.select("doc_id", language.cjk_count(F.col("t")).alias("cjk"), language.latin_count(F.col("t")).alias("latin"), language.is_target_language(F.col("t")).alias("is_target"))


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CONTEXT = r"regexp_replace({0}, '\s+', ' ', 'g')"


@query(
    "residual_english",
    rf"""WITH src AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Chapter ' || text WHEN 1 THEN '译文 ' || text ELSE text END AS t FROM conversations),
c AS (SELECT conv_id, turn, t, trim(regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}|https?://\S+|[A-Za-z0-9_./-]+/[A-Za-z0-9_./-]+', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM src),
w AS (SELECT conv_id, turn, t, list_filter(list_transform(regexp_extract_all(k, '[A-Za-z][A-Za-z''-]*'), lambda x: trim(x, '''')),
  lambda x: NOT (lower(x) IN ({_in(language.ALLOWED)}) OR (len(x) <= 5 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')) OR regexp_matches(x, '[a-z][A-Z]'))) AS words FROM c)
SELECT conv_id, turn, len(words)::BIGINT AS n_words, len(list_filter(words, lambda x: lower(x) IN ({_in(language.STOPWORDS)})))::BIGINT AS n_stop, len(regexp_extract_all(t, '[一-鿿]'))::BIGINT AS cjk,
 len(list_filter(words, lambda x: lower(x) IN ({_in(language.HEADINGS)}))) > 0 AS heading FROM w""",
)
def residual_english(spark, sf_dir):
    """Words, stop words and headings that the residual-language classifier counts in every turn; paths, addresses and URLs go first."""
    t = F.expr("CASE conv_id % 4 WHEN 0 THEN concat('Chapter ', text) WHEN 1 THEN concat('译文 ', text) ELSE text END")
    src = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    codeish = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://\S+|[A-Za-z0-9_./-]+/[A-Za-z0-9_./-]+"
    src = src.withColumn("words", language.words_of(F.trim(F.regexp_replace(F.regexp_replace("t", codeish, " "), r"\s+", " "))))
    among = lambda values: F.size(F.filter("words", lambda w: language.plain(w).isin(values))).cast("long")
    return src.select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), among(language.STOPWORDS).alias("n_stop"), language.cjk_count(F.col("t")).alias("cjk"), (among(language.HEADINGS) > 0).alias("heading"))


@query("residual_decisions")
def residual_decisions(spark, sf_dir):
    """Decision and reason for every line of documents, by language."""
    # exploded, so that the classification isn't copied into each use of its fields
    lines = doc_lines(spark, sf_dir).select("lang", F.explode(F.array(language.finding(F.col("line")))).alias("f"))
    return lines.groupBy("lang", "f.decision", "f.reason").agg(F.count(F.lit(1)).alias("n"))


_COMMANDS = "CASE doc_id % 8 WHEN 0 THEN 'git commit -m fix' WHEN 1 THEN 'see https://example.org/a' WHEN 2 THEN 'src/main/app.py' WHEN 3 THEN 'npm' WHEN 4 THEN 'snake_case camelCase' WHEN 5 THEN 'std::vector' WHEN 6 THEN 'plain words only' ELSE substr(text, 1, 60) END"


@query(
    "technical_noop",
    rf"""WITH s AS (SELECT doc_id, regexp_replace({_COMMANDS}, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, len(t) > 0 AND NOT regexp_matches(t, '[^\x00-\x7F]') AND
 (CASE WHEN regexp_matches(t, 'https?://\S+') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '(?:^|\s)--?[A-Za-z0-9][A-Za-z0-9_-]*\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '\b[A-Za-z0-9_./-]+/[A-Za-z0-9_./-]+\b') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(t, '\b[A-Za-z0-9_.-]+\.(?:py|js|ts|tsx|jsx|json|yaml|yml|toml|ini|cfg|md|txt|html|xml|epub|sh)\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '\b[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+\b') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(t, '\b[a-z]+[A-Z][A-Za-z0-9]*\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '\b[A-Za-z0-9_.-]+::[A-Za-z0-9_.-]+\b') THEN 1 ELSE 0 END
 + CASE WHEN regexp_extract(t, '^\S+') IN ({_in(language.COMMANDS)}) AND regexp_full_match(t, '[A-Za-z0-9_./:=@+-]+(?:\s+[A-Za-z0-9_./:=@+-]+)*') THEN 2 ELSE 0 END
 + CASE WHEN NOT regexp_full_match(t, '[A-Za-z0-9_.:/+-]+') THEN 0 WHEN t IN ({_in(language.COMMANDS)}) THEN 2 WHEN regexp_matches(t, '[._:/+-]|\d') THEN 1 ELSE 0 END) >= 2 AS technical FROM s""",
)
def technical_noop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(language.is_technical(F.expr(_COMMANDS)), F.lit(False)).alias("technical"))


_CITED = "CASE doc_id % 4 WHEN 0 THEN 'Smith, J., Doe, A. and Roe, B. (2021). The nature of all things there are.' WHEN 1 THEN 'Knuth, Donald: The art of computer programming in four volumes, Example Press' WHEN 2 THEN '(2021) a line that opens with a year, Smith, J., and goes on' ELSE replace(substr(text, 1, 200), chr(10), ' ') END"


@query(
    "bibliographic_ref",
    r"""WITH s AS (SELECT doc_id, trim(regexp_replace(""" + _CITED + r""", '\s+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, t, regexp_extract(t, '^(.*?)(?:\((?:18|19|20)\d{2}[a-z]?\)|\b(?:18|19|20)\d{2}[a-z]?\.)', 1) AS head, regexp_matches(t, '\((?:18|19|20)\d{2}[a-z]?\)|\b(?:18|19|20)\d{2}[a-z]?\.') AS dated,
 regexp_extract(t, '^[A-Z][A-Za-z''’.-]{1,60},\s+[A-Z](?:[A-Za-z''’.-]{1,60}|\.)(?:\s+[A-Z][A-Za-z''’.-]{1,60})?\s*[:：]\s+(.+)$', 1) AS title FROM s)
SELECT doc_id, len(t) >= 40 AND NOT (dated AND head = '') AND ((dated AND len(head) <= 220 AND regexp_matches(head, '(?:^|[^\p{L}\p{N}_])\p{L}[\p{L}\p{N}_''’.-]*,\s+[A-Z]\.') AND (len(regexp_extract_all(head, '\b[A-Z]\.')) >= 1 OR regexp_matches(head, '(?i)&|\band\b|\bet\s+al\.') OR len(regexp_extract_all(head, ',')) >= 2))
 OR (title <> '' AND len(regexp_extract_all(title, '[A-Za-z][A-Za-z''’.-]*')) >= 6 AND regexp_matches(title, '(?i)\b(?:Books?|Press|Publishing|Publishers?|Publications|University\s+Press)\b'))) AS is_reference FROM h""",
)
def bibliographic_ref(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(language.is_reference(F.expr(_CITED)), F.lit(False)).alias("is_reference"))


#: Chunks made of documents: a status by id, and a translation of several kinds.
_STATUS = "CASE doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'translated' WHEN 2 THEN 'accepted_as_is' WHEN 3 THEN 'completed' WHEN 4 THEN 'translation_failed' ELSE 'writeback_failed' END"
_TRANSLATED = "CASE doc_id % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN text ELSE reverse(text) END"
_CHUNKS = f"SELECT doc_id, lang, text AS original, {_STATUS} AS status, {_TRANSLATED} AS translated FROM documents".replace("STRING", "VARCHAR")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.col("text").alias("original"), F.expr(_STATUS).alias("status"), F.expr(_TRANSLATED).alias("translated"))


@query(
    "status_machine",
    f"""SELECT doc_id, CASE WHEN status = 'writeback_failed' AND has THEN TRUE WHEN status IN ('accepted_as_is', 'completed', 'writeback_failed') THEN FALSE WHEN status = 'translated' THEN has ELSE TRUE END AS process,
 CASE WHEN status IN ('writeback_failed', 'translation_failed') AND has AND (status = 'writeback_failed' OR translated <> original) THEN 'translated' ELSE status END AS status
FROM (SELECT *, coalesce(len(translated) > 0, FALSE) AS has FROM ({_CHUNKS}))""",
)
def status_machine(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("doc_id", status.next_state(F.col("status"), F.col("original"), F.col("translated")).alias("s")).select("doc_id", "s.process", "s.status")


@query(
    "status_stats",
    f"""SELECT lang, count(*)::BIGINT AS total, count(*) FILTER (status IN ('translated', 'accepted_as_is', 'completed'))::BIGINT AS translated, count(*) FILTER (status = 'translation_failed')::BIGINT AS untranslated,
 count(*) FILTER (status = 'pending')::BIGINT AS pending, count(*) FILTER (status = 'writeback_failed')::BIGINT AS failed, coalesce(bool_or(status IN ('translation_failed', 'writeback_failed')), FALSE) AS incomplete FROM ({_CHUNKS}) GROUP BY lang""",
)
def status_stats(spark, sf_dir):
    return status.statistics(_chunks(spark, sf_dir), "lang", more=(status.is_incomplete(F.col("status")).alias("incomplete"),))


@query(
    "manual_overrides",
    f"""WITH m AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'manual ' || doc_id ELSE '' END AS manual FROM labels)
SELECT c.doc_id, md5(coalesce(CASE WHEN manual <> '' THEN manual ELSE translated END, '-')) AS translated_md5, CASE WHEN manual <> '' THEN 'translated' ELSE status END AS status, coalesce(manual <> '', FALSE) AS overridden FROM ({_CHUNKS}) c LEFT JOIN m ON m.doc_id = c.doc_id""",
)
def manual_overrides(spark, sf_dir):
    manual = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, F.concat(F.lit("manual "), F.col("doc_id").cast("string"))).otherwise("").alias("manual"), F.lit(0).alias("pos"))
    out = status.overridden(_chunks(spark, sf_dir).withColumnRenamed("doc_id", "name"), manual)
    return out.select(F.col("name").alias("doc_id"), F.md5(F.coalesce("translated", F.lit("-"))).alias("translated_md5"), "status", "overridden")


@query(
    "final_gate",
    f"""WITH g AS (SELECT doc_id, status, status NOT IN ('translation_failed', 'writeback_failed') AND coalesce(len(translated) > 0, FALSE) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gated FROM ({_CHUNKS}))
SELECT doc_id, CASE WHEN gated THEN 'translation_failed' ELSE status END AS status, gated FROM g WHERE gated OR status IN ('translation_failed', 'writeback_failed')""",
)
def final_gate(spark, sf_dir):
    """The chunks that the gate and earlier stages have failed, for the report."""
    findings = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("toxic") == 1, "fail").otherwise("review").alias("decision"))
    out = status.gated(_chunks(spark, sf_dir).withColumnRenamed("doc_id", "name"), findings)
    return status.failures(out).select(F.col("name").alias("doc_id"), "status", "gated")


_TERMS = ["the and", "of the", "in", "Tion", "de la", "und", "no such term"]


@query(
    "glossary_filter",
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in sorted(_TERMS, key=lambda t: (-len(t), t))) + "], lambda t: contains(lower(text), lower(t))), '|') AS terms FROM documents",
)
def glossary_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(glossary.matching(F.col("text"), _TERMS), "|").alias("terms"))


_FORBIDDEN = ["the", "of", "and", "de", "la", "und", "data", "analysis"]


@query(
    "glossary_validity",
    rf"""WITH t AS (SELECT DISTINCT term FROM (SELECT array_to_string(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[1 + doc_id % 3 : 1 + doc_id % 3 + doc_id % 6], ' ') AS term FROM documents) WHERE term <> '')
SELECT term, len(w) BETWEEN 2 AND 5 AND NOT regexp_matches(term, '[=()\[\]{{}}<>/\\:%*©’_−ˉ+±×÷√∫∑∏∂Δ∇≈≠≤≥“”—–]') AND NOT list_has_any(w, [{_in(glossary.CODE_KEYWORDS)}]) AND regexp_matches(term, '\p{{L}}') AND regexp_matches(term, '^[\p{{L}}\p{{N}}]') AND regexp_matches(term, '[\p{{L}}\p{{N}}]$')
 AND len(list_filter(w, lambda x: x NOT IN ({_in(_FORBIDDEN)}))) > 0 AS valid FROM (SELECT term, string_split(lower(term), ' ') AS w FROM t)""",
)
def glossary_validity(spark, sf_dir):
    """Whether word runs out of every document could be terms."""
    term = F.expr(r"array_join(slice(split(regexp_replace(text, '\\s+', ' '), ' '), 1 + cast(doc_id % 3 AS INT), 1 + cast(doc_id % 6 AS INT)), ' ')")
    terms = table(spark, sf_dir, "documents").select(term.alias("term")).where("term <> ''").distinct()
    return terms.select("term", glossary.is_valid_term(F.col("term"), _FORBIDDEN).alias("valid"))


_STOP = sorted({*language.STOPWORDS, *glossary.CODE_KEYWORDS, *_FORBIDDEN})


@query(
    "glossary_tfidf",
    rf"""WITH p AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT row_number() OVER () AS sid, list_transform(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), lambda x: CASE WHEN x IN ({_in(_STOP)}) THEN '' ELSE x END) AS w FROM (SELECT unnest(regexp_split_to_array(t, '[.!?]+')) AS s FROM p WHERE length(t) > 100)),
k AS (SELECT sid, w FROM s WHERE len(w) > 0),
g AS (SELECT sid, w[i:i + n - 1] AS g FROM (SELECT sid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE len(w) >= n)),
f AS (SELECT sid, array_to_string(g, ' ') AS term, count(*) AS tf FROM g WHERE NOT list_contains(g, '') GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), c AS (SELECT count(*) AS n FROM k),
w AS (SELECT sid, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM f JOIN d USING (term), c),
u AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY sid)) AS u FROM w)
SELECT term, round(sum(u) / (SELECT n FROM c), 6) AS score FROM u GROUP BY term ORDER BY score DESC, term LIMIT 200""",
)
def glossary_tfidf(spark, sf_dir):
    """The 200 terms (word runs of two to five) of all documents with the largest mean tf-idf: a top-k report."""
    sents = glossary.sentences(table(spark, sf_dir, "documents"))
    return glossary.tfidf(sents, _STOP, persisted)


@query(
    "glossary_merge",
    r"""WITH d AS (SELECT doc_id, lang, regexp_replace(source, '[0-9]', 'q', 'g') AS s FROM documents), t AS (SELECT doc_id, upper(s[1:1]) || lower(s[2:]) || ' ' || upper(lang[1:1]) || lower(lang[2:]) AS term, lang || ' ' || s AS old FROM d),
n AS (SELECT DISTINCT term FROM t), o AS (SELECT term, max(old) AS old FROM t WHERE doc_id % 3 = 0 GROUP BY 1 UNION ALL SELECT 'Old Term', 'x')
SELECT coalesce(n.term, o.term) AS term, CASE WHEN n.term IS NOT NULL THEN coalesce(old, '') END AS translation, CASE WHEN n.term IS NULL THEN 'removed' WHEN o.term IS NULL THEN 'added' ELSE 'kept' END AS state FROM n FULL JOIN o ON n.term = o.term""",
)
def glossary_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.regexp_replace("source", "[0-9]", "q"))
    new = docs.select(glossary.title_case(F.concat_ws(" ", "source", "lang")).alias("term")).distinct()
    old = docs.where("doc_id % 3 = 0").select(F.concat_ws(" ", "source", "lang").alias("term"), F.concat_ws(" ", "lang", "source").alias("translation"))
    return glossary.merged(new, old.unionByName(spark.createDataFrame([("old term", "x")], "term string, translation string")))


_BROKEN = "replace(text, ', ', CASE doc_id % 5 WHEN 0 THEN ' [PRE: 1] ' WHEN 1 THEN ' [CODE;22] ' WHEN 2 THEN ' [STYLE; 3] ' WHEN 3 THEN ' [PRE:4] ' ELSE ' PRE:5 [TAG: 1] ' END)"


@query("placeholder_repair", rf"SELECT doc_id, md5(regexp_replace({_BROKEN}, '\[(PRE|CODE|STYLE)(?:: |; ?)(\d+)\]', '[\1:\2]', 'g')) AS repaired_md5 FROM documents")
def placeholder_repair(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(placeholders.repaired(F.expr(_BROKEN))).alias("repaired_md5"))


@query(
    "placeholder_validate",
    rf"""SELECT doc_id, len(regexp_extract_all(t, '\[PRE:\d+\]'))::BIGINT AS pre, len(regexp_extract_all(t, '\[CODE:\d+\]'))::BIGINT AS code, len(regexp_extract_all(t, '\[STYLE:\d+\]'))::BIGINT AS style,
 len(regexp_extract_all(t, '\[PRE:\d+\]')) = doc_id % 4 AND len(regexp_extract_all(t, '\[CODE:\d+\]')) = 0 AND len(regexp_extract_all(t, '\[STYLE:\d+\]')) = 0 AS matches FROM (SELECT doc_id, {_BROKEN} AS t FROM documents)""",
)
def placeholder_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BROKEN).alias("t"))
    zero = F.lit(0).cast("long")
    return docs.select("doc_id", *(c.alias(k) for k, c in placeholders.counts(F.col("t")).items()), placeholders.counts_match(F.col("t"), {"pre": F.col("doc_id") % 4, "code": zero, "style": zero}).alias("matches"))


@query(
    "placeholder_restore",
    """SELECT doc_id, md5(replace(replace(replace(replace(t, '[STYLE:0]', '<style>[CODE:0]</style>'), '[CODE:1]', '<tt>x</tt>'), '[CODE:0]', '<code>' || lang || '</code>'), '[PRE:0]', '<pre>' || doc_id || '</pre>')) AS restored_md5
FROM (SELECT doc_id, lang, replace(replace(text, ', ', ' [CODE:1] [PRE:0] '), '. ', ' [STYLE:0] [CODE:0] ') AS t FROM documents)""",
)
def placeholder_restore(spark, sf_dir):
    t = F.expr("replace(replace(text, ', ', ' [CODE:1] [PRE:0] '), '. ', ' [STYLE:0] [CODE:0] ')")
    pre = F.array(F.concat(F.lit("<pre>"), F.col("doc_id").cast("string"), F.lit("</pre>")))
    code = F.array(F.concat(F.lit("<code>"), "lang", F.lit("</code>")), F.lit("<tt>x</tt>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(placeholders.restored(t, pre, code, F.array(F.lit("<style>[CODE:0]</style>")))).alias("restored_md5"))


#: A numbered placeholder for each line, and a translation that turns, drops or keeps their order.
_PAIRS = """SELECT doc_id, a, CASE doc_id % 4 WHEN 0 THEN list_reverse(a) WHEN 1 THEN a[2:] || a[1:1] WHEN 2 THEN a[1:len(a) - 1] ELSE a END AS b
 FROM (SELECT doc_id, list_transform(range(0, len(string_split(text, chr(10))) + 1), lambda i: '[CODE:' || i || ']') AS a FROM documents)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("transform(sequence(0, size(split(text, '\n'))), i -> concat('[CODE:', i, ']'))").alias("a"))
    b = F.expr("CASE doc_id % 4 WHEN 0 THEN reverse(a) WHEN 1 THEN concat(slice(a, 2, size(a)), slice(a, 1, 1)) WHEN 2 THEN slice(a, 1, size(a) - 1) ELSE a END")
    return docs.select("doc_id", F.array_join("a", " ").alias("original"), F.array_join(b, " ").alias("translated"))


@query("code_multiset_diff", f"SELECT doc_id, list_sort(a) = list_sort(b) AS same FROM ({_PAIRS})")
def code_multiset_diff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", placeholders.same_multiset(F.col("original"), F.col("translated")).alias("same"))


@query(
    "placeholder_sequence_diff",
    f"SELECT doc_id, i::BIGINT AS pos, a[i] AS original, b[i] AS translated FROM (SELECT doc_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM ({_PAIRS})) WHERE a[i] IS DISTINCT FROM b[i]",
)
def placeholder_sequence_diff(spark, sf_dir):
    diff = placeholders.sequence_difference(F.col("original"), F.col("translated"), r"\[CODE:\d+\]")
    return _pairs(spark, sf_dir).select("doc_id", F.explode(diff).alias("d")).select("doc_id", "d.*")


_TURNS = "SELECT conv_id, turn, '[TEXT:' || turn || ']' || regexp_replace(text, '\\s+', ' ', 'g') AS line FROM conversations"


@query(
    "marker_segments",
    rf"""WITH c AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS t FROM ({_TURNS}) GROUP BY conv_id)
SELECT conv_id, i::BIGINT AS pos, m[i] AS marker, md5(rtrim(p[i + 1], chr(10))) AS payload_md5 FROM (SELECT conv_id, regexp_extract_all(t, '\[TEXT:\d+\]') AS m, regexp_split_to_array(t, '\[TEXT:\d+\]') AS p, unnest(range(1, len(regexp_extract_all(t, '\[TEXT:\d+\]')) + 1)) AS i FROM c)""",
)
def marker_segments(spark, sf_dir):
    """Conversations as marked lines, split into their segments again."""
    line = F.concat(F.lit("[TEXT:"), F.col("turn").cast("string"), F.lit("]"), F.regexp_replace("text", r"\s+", " "))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    joined = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("t"))
    each = joined.select("conv_id", F.posexplode(text.segments(F.col("t"), text.TEXT_MARKER, text.without_line_ends)).alias("pos", "s"))
    return each.select("conv_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("s.marker").alias("marker"), F.md5("s.payload").alias("payload_md5"))


@query(
    "marker_repair",
    r"""WITH t AS (SELECT conv_id, turn, '[TEXT:' || turn || ']' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' x' AS o, CASE turn % 3 WHEN 0 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) || ' y' WHEN 1 THEN '[TEXT:99]' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' y' ELSE '[TEXT:' || turn || ']' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' y' END AS t FROM conversations)
SELECT conv_id, turn, md5('[TEXT:' || turn || ']' || regexp_replace(t, '^\[TEXT:\d+\]', '')) AS repaired_md5 FROM t""",
)
def marker_repair(spark, sf_dir):
    """Turns whose translation lost or changed its marker."""
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    own = F.concat(F.lit("[TEXT:"), F.col("turn").cast("string"), F.lit("]"))
    original = F.concat(own, body, F.lit(" x"))
    lead = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "[TEXT:99]").otherwise(own)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", original.alias("o"), F.concat(lead, body, F.lit(" y")).alias("t"))
    return turns.select("conv_id", "turn", F.md5(text.repaired_markers(F.col("o"), F.col("t"))).alias("repaired_md5"))


_XPATHS = "CASE pos % 4 WHEN 0 THEN '/html/body/section' WHEN 1 THEN '/html/body/section/p[' || pos || ']' WHEN 2 THEN '/html/body/div[' || pos || ']/p' ELSE '/html/body/sections' END"


@query(
    "overlap_chunks",
    rf"""WITH {LINES}, x AS (SELECT doc_id, pos, {_XPATHS} AS xpath FROM lines), d AS (SELECT *, len(xpath) - len(replace(xpath, '/', '')) AS depth FROM x)
SELECT doc_id, pos FROM d a WHERE EXISTS (SELECT 1 FROM d b WHERE b.doc_id = a.doc_id AND b.pos <> a.pos AND starts_with(b.xpath, a.xpath || '/') AND a.depth < b.depth)""",
)
def overlap_chunks(spark, sf_dir):
    """Chunks on a path above another chunk's, in the same document."""
    x = doc_lines(spark, sf_dir).select("doc_id", "pos", F.array(F.expr(_XPATHS.replace("||", "||"))).alias("xpaths"))
    return trees.overlapping(x, "doc_id", "pos")


@query(
    "correction_apply",
    """SELECT doc_id, md5('<p class="the">' || replace(replace(replace(text, '<', ''), 'the', 'das'), 'das', 'dies') || '</p>') AS corrected_md5 FROM documents""",
)
def correction_apply(spark, sf_dir):
    """Corrections in order, which may cascade, on text between tags; one with a placeholder is left out."""
    html = F.concat(F.lit('<p class="the">'), F.replace("text", F.lit("<"), F.lit("")), F.lit("</p>"))
    pair = lambda a, b: F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"))
    fixes = workflow.usable_corrections(F.array(pair("the", "das"), pair("of [CODE:1]", "von"), pair("das", "dies")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(workflow.corrected(html, fixes)).alias("corrected_md5"))


@query(
    "post_process",
    "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '. ', '。。您，，大型语言模型'), '您', '你'), '大型语言模型', '大语言模型'), '。。', '。'), '，，', '，')) AS post_md5 FROM documents",
)
def post_process(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(workflow.post_processed(F.replace("text", F.lit(". "), F.lit("。。您，，大型语言模型")))).alias("post_md5"))


_ERRORS = "CASE doc_id % 6 WHEN 0 THEN '安全审核失败' WHEN 1 THEN 'network timeout' WHEN 2 THEN 'a content policy hit' WHEN 3 THEN '标签结构不一致: x' WHEN 4 THEN 'HTML标签结构错误' ELSE text END"


@query(
    "error_kinds",
    f"""SELECT doc_id, doc_id % 9 = 0 OR {' OR '.join(f"contains(m, '{w}')" for w in workflow.SAFETY_WORDS)} AS safety, {' OR '.join(f"contains(m, '{w}')" for w in workflow.STRUCTURE_WORDS)} AS structure FROM (SELECT doc_id, {_ERRORS} AS m FROM documents)""",
)
def error_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ERRORS).alias("m"))
    code = F.when(F.col("doc_id") % 9 == 0, 10014).otherwise(200)
    return docs.select("doc_id", workflow.is_safety_error(F.col("m"), code).alias("safety"), workflow.is_structure_error(F.col("m")).alias("structure"))


@query(
    "route_chunks",
    rf"""SELECT doc_id, CASE WHEN len(translated) > 0 THEN 'pass' WHEN NOT regexp_matches(t, '\S') THEN 'copy' WHEN cjk >= 2 AND (latin = 0 OR cjk >= greatest(4.0, latin * 0.5)) THEN 'accept' ELSE 'call' END AS route FROM
(SELECT doc_id, t, CASE WHEN doc_id % 5 = 0 THEN 'done' ELSE '' END AS translated, len(regexp_extract_all(t, '[一-鿿]')) AS cjk, len(regexp_extract_all(t, '[A-Za-z]')) AS latin FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE {_MIXED} END AS t FROM documents))""",
)
def route_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE {_MIXED} END").alias("t"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'done' ELSE '' END").alias("translated"))
    return docs.select("doc_id", workflow.route(F.col("t"), F.col("translated"), F.col("t"), F.lit(False)).alias("route"))


@query(
    "id_markers",
    r"""WITH m AS (SELECT doc_id, list_transform(range(0, doc_id % 5), lambda i: '[id' || i || ']') AS e FROM documents), h AS (SELECT doc_id, e, CASE doc_id % 3 WHEN 0 THEN e WHEN 1 THEN list_reverse(e) ELSE e || ['[id9]'] END AS h FROM m)
SELECT doc_id, CASE WHEN len(e) = 0 THEN 'ok' WHEN len(list_filter(e, lambda x: NOT list_contains(h, x))) > 0 THEN 'missing' WHEN len(list_filter(h, lambda x: NOT list_contains(e, x))) > 0 THEN 'extra' WHEN e <> h THEN 'order' ELSE 'ok' END AS verdict FROM h""",
)
def id_markers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("slice(array('[id0]', '[id1]', '[id2]', '[id3]'), 1, cast(doc_id % 5 AS INT))").alias("e"))
    have = F.expr("CASE doc_id % 3 WHEN 0 THEN e WHEN 1 THEN reverse(e) ELSE array_append(e, '[id9]') END")
    return docs.select("doc_id", placeholders.id_marker_check(F.array_join(have, " word "), F.col("e")).alias("verdict"))


@query(
    "stream_merge",
    "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn, text)) AS content_md5, count(*)::BIGINT AS deltas FROM (SELECT conv_id, turn, text FROM conversations) GROUP BY conv_id",
)
def stream_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "text").alias("seq"), F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("usage"))
    return workflow.merged_stream(turns, "conv_id", F.count(F.lit(1)).alias("deltas")).select("conv_id", F.md5("content").alias("content_md5"), "deltas")


@query(
    "delta_merge",
    """WITH d AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE turn % 2 = 0), o AS (SELECT DISTINCT * FROM d),
calls AS (SELECT conv_id, turn % 3 AS i, string_agg(text, '' ORDER BY turn, text) AS args, arg_min('call ' || turn, struct_pack(turn, text)) AS id FROM o WHERE turn % 3 < 2 GROUP BY 1, 2),
c AS (SELECT conv_id, string_agg(i || ' ' || id || ' ' || args, chr(10) ORDER BY i) AS calls FROM calls GROUP BY conv_id),
e AS (SELECT conv_id, string_agg(role || '=' || last, ',' ORDER BY role) AS extra FROM (SELECT conv_id, role, arg_max(turn::VARCHAR, struct_pack(turn, text)) AS last FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT o.conv_id, count(*)::BIGINT AS deltas, arg_min(role, struct_pack(turn, text)) AS role, md5(string_agg(text, '' ORDER BY turn, text)) AS content_md5, arg_max('usage ' || turn, struct_pack(turn, text)) AS usage, any_value(extra) AS extra, md5(coalesce(any_value(calls), '')) AS calls_md5
FROM o LEFT JOIN c USING (conv_id) LEFT JOIN e USING (conv_id) GROUP BY o.conv_id""",
)
def delta_merge(spark, sf_dir):
    """Conversations as streams of deltas, every second one sent twice and all of them out of order: texts, the last usage, merged maps, and tool calls from their pieces."""
    from quire.operators import deltas

    t = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    call = F.when(F.col("turn") % 3 < 2, F.array(F.struct((F.col("turn") % 3).cast("int").alias("index"), F.concat(F.lit("call "), turn).alias("id"), F.lit(None).cast("string").alias("name"), F.col("text").alias("arguments"))))
    each = t.select("conv_id", F.struct("turn", "text").alias("seq"), "role", F.col("text").alias("content"), F.concat(F.lit("usage "), turn).alias("usage"), F.create_map("role", turn).alias("extra"), call.alias("tool_calls"))
    sent = each.unionByName(each.where("seq.turn % 2 = 0"))
    out = deltas.merged_deltas(sent, "conv_id").withColumn("calls", deltas.whole_calls(F.col("tool_calls")))
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    calls = F.array_join(F.transform(F.coalesce("calls", F.array().cast(f"array<{deltas.CALL}>")), lambda c: F.concat_ws(" ", c["index"].cast("string"), c["id"], c["arguments"])), "\n")
    return out.select("conv_id", "deltas", "role", F.md5("content").alias("content_md5"), "usage", extra.alias("extra"), F.md5(calls).alias("calls_md5"))


@query(
    "sanitize_output",
    r"""SELECT page_id, length(t)::BIGINT AS length, md5(t) AS clean_md5 FROM (SELECT page_id, regexp_replace(replace(html, '><', '>' || chr(10) || '<'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t FROM pages)""",
)
def sanitize_output(spark, sf_dir):
    """Pages with escapes and spelled-out line ends put in, cleaned again."""
    dirty = F.concat(F.replace("html", F.lit("><"), F.lit(">\\n<")), F.lit("\u001b[31m\u0007"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(workflow.sanitized(dirty)).cast("long").alias("length"), F.md5(workflow.sanitized(dirty)).alias("clean_md5"))


@query(
    "toc_chunks",
    rf"""WITH RECURSIVE {LINES}, clean AS (SELECT doc_id, pos, '<p>' || regexp_replace(line, '[<>&]', '', 'g') || '</p>' AS html FROM lines WHERE regexp_matches(regexp_replace(line, '[<>&]', '', 'g'), '\S')),
parts AS (SELECT doc_id * 3 + CASE WHEN pos < 3 THEN 0 ELSE 2 END AS k, pos, html AS s FROM clean
  UNION ALL SELECT doc_id * 3 + 1, i, '[NAVTXT:' || i || '] Part ' || i FROM (SELECT doc_id, unnest(range(doc_id % 30 + 1)) AS i FROM documents)),
units AS MATERIALIZED (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY pos) - 1)::BIGINT AS pos, {TOK.format('s')} AS tok, 0::BIGINT AS ph, s FROM parts), {_fold('units', 'k', 60, None, None)}
SELECT k // 3 AS doc_id, (dense_rank() OVER (PARTITION BY k // 3 ORDER BY k % 3, cid) - 1)::BIGINT AS chunk_no, CASE WHEN k % 3 = 1 THEN 'nav_text' ELSE 'html_fragment' END AS chunk_mode, n_units, tokens, original_md5
FROM (SELECT f.k, cid, count(*)::BIGINT AS n_units, sum(t)::BIGINT AS tokens, md5(string_agg(s, chr(10) ORDER BY f.pos)) AS original_md5 FROM fold f JOIN units u ON u.k = f.k AND u.pos = f.pos GROUP BY 1, 2)""",
)
def toc_chunks(spark, sf_dir):
    """Documents as paragraphs with a table of contents after the third: chunks of 60 tokens, those of the table by themselves and numbered anew."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[<>&]", "")), lambda x: x.rlike(r"\S"))
    nav = F.concat(F.lit('<nav class="toc"><ol>'), F.array_join(F.expr("transform(sequence(0, doc_id % 30), i -> concat('<li><a href=\"x\">Part ', i, '</a></li>'))"), ""), F.lit("</ol></nav>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))).alias("p"), nav.alias("nav"))
    html = F.concat(F.lit("<html><body>"), F.array_join(F.slice("p", 1, 3), ""), "nav", F.array_join(F.slice("p", 4, 1 << 30), ""), F.lit("</body></html>"))
    parsed = dom.parse(docs.select("doc_id", html.alias("html")), "doc_id", "html", hold=False)
    out = chunking.chunks(parsed, "doc_id", 60)
    n_units = F.when(F.col("chunk_mode") == "nav_text", F.size("targets")).otherwise(F.size("xpaths")).cast("long")
    return out.select("doc_id", "chunk_no", "chunk_mode", n_units.alias("n_units"), "tokens", F.md5("original").alias("original_md5"))


QUERIES |= trees.QUERIES | mining.QUERIES | whole.QUERIES
SQL |= trees.SQL | mining.SQL | whole.SQL
