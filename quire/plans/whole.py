"""A whole run over documents as a query, with a model whose answers the SQL can tell."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import run, workflow
from quire.sources.tables import persisted, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SAID, MENDED = "译文甲", "译文乙"


def answers(rows: list[dict]) -> list[str]:
    """By the class of the paragraphs: k0 and k4 right at once, k1 once it is told of its fault, k2 text by text only, k3 never."""
    out = []
    for r in rows:
        p = json.loads(r["payload"])
        text = p["text_to_translate"]
        if text.startswith("[TEXT:"):
            said = re.sub(r"\][^\n]*", f"]{SAID}", text)
        else:
            said = re.sub(r">[^<\n]+<", f">{SAID}<", text)
            if 'class="k2"' in text or ('class="k1"' in text and "validation_error" not in p):
                said = said.replace("</p>", "<br></p>", 1)
        out.append("" if 'class="k3"' in text else json.dumps({"translation": said}, ensure_ascii=False))
    return out


def corrections(rows: list[dict]) -> list[str]:
    return [json.dumps({"corrections": {SAID: MENDED} if 'class=\\"k4\\"' in r["payload"] else {}}) for r in rows]


def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as markup, translated, proofread and written back: its status, how many attempts its chunks took, and the markup that came out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[<>&]", "")), lambda x: x.rlike(r"\S"))
    kind = F.concat(F.lit('<p class="k'), (F.col("doc_id") % 5).cast("string"), F.lit('">'))
    html = F.concat(F.lit("<html><body>"), F.array_join(F.transform(lines, lambda x: F.concat(kind, x, F.lit("</p>"))), ""), F.lit("</body></html>"))
    folder = f"{shared_folder(spark)}/quire/run-{uuid.uuid4().hex}"
    proof = workflow.Answers(f"{folder}/corrections", corrections)
    out = run.run(docs.select("doc_id", html.alias("html")), "doc_id", workflow.Answers(f"{folder}/answers", answers), proof, proof, persisted, limit=300)
    chunks = out.chunks.groupBy("doc_id").agg(F.min("status").alias("status"), F.max("status").alias("last_status"), F.max("attempts").cast("long").alias("attempts"))
    return chunks.join(out.items, "doc_id").select("doc_id", "status", "last_status", "attempts", F.md5("html").alias("html_md5"))


QUERIES["whole_run"] = whole_run
SQL["whole_run"] = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, regexp_replace(line, '[<>&]', '', 'g') AS line, doc_id % 5 AS k FROM l),
h AS (SELECT doc_id, k, '<html><body>' || string_agg('<p class="k' || k || '">' || CASE k WHEN 3 THEN line WHEN 4 THEN '{MENDED}' ELSE '{SAID}' END || '</p>', '' ORDER BY i) || '</body></html>' AS html FROM c WHERE regexp_matches(line, '\S') GROUP BY doc_id, k)
SELECT doc_id, CASE WHEN k = 3 THEN 'translation_failed' ELSE 'completed' END AS status, CASE WHEN k = 3 THEN 'translation_failed' ELSE 'completed' END AS last_status,
  CASE k WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END::BIGINT AS attempts, md5(html) AS html_md5 FROM h"""
