"""The automaton and the matching of many terms, against searches term by term."""

import random

import numpy as np
import pytest

from quire.operators import matching
from quire.operators.automaton import Automaton


def scan_all(terms, texts):
    return [(i, j, w) for i, x in enumerate(texts) for j in range(1, len(x) + 1) for w in sorted(terms, key=len, reverse=True) if x[:j].endswith(w)]


def test_automaton_finds_what_a_search_finds():
    rng = random.Random(1)
    for _ in range(60):
        terms = list({"".join(rng.choice("ab é") for _ in range(rng.randint(1, 6))).encode() for _ in range(rng.randint(0, 12))})
        texts = ["".join(rng.choice("abé d") for _ in range(rng.choice([0, 1, 5, 40, 700, 1500]))).encode() for _ in range(rng.randint(0, 5))]
        automaton = Automaton(terms)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
        text, end, term = automaton.scan(np.frombuffer(b"".join(texts), np.uint8), at)
        assert [(int(t), int(e - at[t]), terms[w]) for t, e, w in zip(text, end, term)] == scan_all(terms, texts)


def test_automaton_refuses_what_it_cannot_hold(monkeypatch):
    with pytest.raises(ValueError):
        Automaton([b"a", b""])
    with pytest.raises(ValueError):
        Automaton([b"a", b"a"])
    monkeypatch.setattr("quire.operators.automaton.MOST_ENTRIES", 10)
    with pytest.raises(ValueError):
        Automaton([b"abcdef"])


def test_twenty_thousand_terms(spark):
    rng = random.Random(2)
    letters = "abcdefghij É"
    terms = list({"".join(rng.choice(letters) for _ in range(rng.randint(2, 7))).strip() or "x" for _ in range(24_000)})[:20_000]
    terms += ["AbC", "aBc", "aa", "aaa", None, ""]
    texts = ["".join(rng.choice(letters + "A") for _ in range(rng.choice([0, 30, 400]))) for _ in range(60)] + ["aaaaaaa", None, "ABC abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    out = matching.matched_terms(rows, "doc_id", table)
    assert len(out._jdf.queryExecution().toString()) < 5_000  # the plan doesn't hold the terms
    order = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    for r in out.collect():
        low = (texts[r["doc_id"]] or "").lower()
        assert [(f["term"], f["n"]) for f in r["found"]] == [(t, low.count(t.lower())) for t in order if t.lower() in low]


def test_corrections_cascade_in_order(spark):
    rng = random.Random(3)
    parts = lambda n: "".join(rng.choice("abcab ") for _ in range(n))
    fixes = [(i, parts(rng.randint(1, 3)) or "a", parts(rng.randint(0, 3))) for i in range(300)] + [(7, "zz", "[CODE:1]"), (8, "[PRE:2]", "x"), (9, "", "x"), (10, None, "x")]
    htmls = [f'<p class="abc">{parts(40)}<b>{parts(10)}</b> &lt; {parts(5)}</p>' for _ in range(40)] + ["", None, "a < b > a", "<"]
    got = {r["id"]: r for r in matching.corrected_by(spark.createDataFrame(list(enumerate(htmls)), "id int, html string"), "id", spark.createDataFrame(fixes, "pos int, old string, new string")).collect()}
    usable = [(o, n) for _, o, n in sorted((f for f in fixes if f[1]), key=lambda f: f) if "[" not in o + n]
    for i, html in enumerate(htmls):
        out, replaced, matched = [], 0, set()
        for p in matching._PARTS.findall(html or ""):
            if not (p.startswith("<") and p.endswith(">") and len(p) > 1):
                for k, (o, n) in enumerate(usable):
                    if c := p.count(o):
                        p, replaced = p.replace(o, n), replaced + c
                        matched.add(k)
            out.append(p)
        assert (got[i]["html"], got[i]["replaced"], got[i]["matched"]) == ("".join(out), replaced, len(matched))


def test_a_run_is_corrected_once(monkeypatch):
    """However often a word stands in the texts, it is searched once."""
    searched = []
    scan = Automaton.scan
    monkeypatch.setattr(Automaton, "scan", lambda self, data, at: searched.append(len(data)) or scan(self, data, at))
    corrector = matching.Corrector([("cat", "tac"), ("ac", "x.c"), ("dog", "cat")])
    texts = ["cat, dog " * 1_000, "dog", "", "- -"]
    assert [(t, n, len(hit)) for t, n, hit in corrector(texts)] == [("tx.c, cat " * 1_000, 3_000, 3), ("cat", 1, 1), ("", 0, 0), ("- -", 0, 0)]
    corrector(texts)
    assert sum(searched) < 100
