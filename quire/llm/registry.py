"""The corpus operators' queries, and SQL for those it can express."""

from __future__ import annotations

from quire.llm import merkle, neardup, periodic, substring, urlfilter, warc
from quire.llm.ann import op2_ann
from quire.llm.langid import op4_langid
from quire.llm.maxent import op6_maxent
from quire.llm.neardup import op1_neardup
from quire.llm.packing import op7_packing
from quire.llm.pieces import op5_pieces
from quire.llm.quality import op10_quality
from quire.llm.sharding import op3_sharding
from quire.llm.substring import op8_substring

QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_ann": op2_ann,
    "op3_sharding": op3_sharding,
    "op4_langid": op4_langid,
    "op5_pieces": op5_pieces,
    "op6_maxent": op6_maxent,
    "op7_packing": op7_packing,
    "op8_substring": op8_substring,
    "op9_warc": warc.op9_warc,
    "op10_quality": op10_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_urls": urlfilter.op12_urls,
    "op13_periodic": periodic.op13_periodic,
}
SQL: dict[str, str] = {"op1_neardup": neardup.SQL, "op8_substring": substring.SQL, "op9_warc": warc.SQL, "op11_merkle": merkle.SQL, "op12_urls": urlfilter.SQL, "op13_periodic": periodic.SQL}
