"""Sentences and glossary mining: the statistics by brute force, and what has to stay together."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import dom, mining, sentences
from quire.sources.tables import persisted

PLAIN = "the quick brown fox jumps over a lazy dog while every cat sleeps near some warm stove and nobody minds it much at all".split()


def prose(rng, n=400):
    """Sentences of plain words, with abbreviations, initials, decimals and ordinals among them."""
    out = []
    for _ in range(n):
        words = rng.sample(PLAIN, rng.randint(6, 12))
        at = rng.randint(1, 4)
        words[at:at] = rng.choice([[], ["Dr.", "Hill"], ["Mr.", "Stone"], ["approx.", "seven"], ["J.", "K.", "Miller"], ["version", "3.5"], ["a", "5.", "edition"], ["U.S.", "law"]])
        out.append(words[0].capitalize() + " " + " ".join(words[1:]) + rng.choice([".", ".", ".", "?", "!"]))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [prose(rng, 40) for _ in range(12)]
    docs = spark.createDataFrame([(i, "  ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return texts, docs, sentences.train(docs, persisted)


def test_abbreviation_scores_by_brute_force(corpus):
    texts, _, model = corpus
    words = [w for t in texts for s in t for w in s.split()]
    kind = lambda w: "##number##" if (b := w.rstrip(".?!,;:…"))[:1].isdigit() else b.lower()
    n, periods = len(words), sum(w.endswith(".") for w in words)
    whole, short = Counter(map(kind, words)), Counter(kind(w) for w in words if w.endswith("."))
    want = {}
    for t, k in short.items():
        if t == "##number##":
            continue
        clip = lambda p: min(max(p, 1e-12), 1 - 1e-12)
        like = lambda p: k * math.log(clip(p)) + (whole[t] - k) * math.log(clip(1 - p))  # noqa: B023, E731
        letters = len(t.replace(".", ""))
        score = 2 * (like(0.99) - like(periods / n)) * math.exp(-letters) * (1 + t.count(".")) * letters ** -(whole[t] - k)
        if score >= 0.3:
            want[t] = score
    got = {r["type"]: r["score"] for r in model.abbreviations.collect()}
    assert got.keys() == want.keys() and {"dr", "mr", "u.s", "j", "k"} <= got.keys() and "dog" not in got
    assert all(abs(got[t] - want[t]) < 1e-9 * max(1, want[t]) for t in want)


def test_collocations_and_starters_by_brute_force(corpus):
    texts, docs, model = corpus
    assert ("##number##", "edition") in {(r["type"], r["next"]) for r in model.collocations.collect()}
    known = {r["type"] for r in model.abbreviations.collect()}
    words = [[w for s in t for w in s.split()] for t in texts]
    kind = lambda w: "##number##" if (b := w.rstrip(".?!,;:…"))[:1].isdigit() else b.lower()
    flat = [w for t in words for w in t]
    loose = lambda t: t == "##number##" or (len(t) == 1 and t.isalpha())
    ends = lambda w: w[-1] in "?!" or (w[-1] == "." and kind(w) not in known)
    n, breaks = len(flat), sum(ends(a) for t in words for a in t[:-1])
    total, after = Counter(map(kind, flat)), Counter(kind(b) for t in words for a, b in zip(t, t[1:]) if ends(a) and not (a[-1] == "." and loose(kind(a))))
    clip = lambda p: min(max(p, 1e-12), 1 - 1e-12)
    like = lambda k, m, p: k * math.log(clip(p)) + (m - k) * math.log(clip(1 - p))
    want = {}
    for t, ab in after.items():
        a, b = breaks, total[t]
        ll = 2 * (like(ab, a, ab / a) + like(b - ab, n - a, (b - ab) / (n - a)) - like(ab, a, b / n) - like(b - ab, n - a, b / n))
        if ll >= 30 and n / a > b / ab and t.isalpha():
            want[t] = ll
    got = {r["type"]: r["score"] for r in model.starters.collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-6 for t in want)


def test_sentences_stay_whole(corpus):
    texts, docs, model = corpus
    got = {r["doc_id"]: r["sentences"] for r in sentences.split_sentences(docs, model, "doc_id").collect()}
    assert got == dict(enumerate(texts))


def test_odd_texts(spark, corpus):
    model = corpus[2]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, ". . ."), (6, 'He said "stop." Then  (maybe!) went... and came… Yes'), (7, "x. " * 5000), (8, "a" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["sentences"] for r in sentences.split_sentences(docs, model, "doc_id").collect()}
    assert sorted(got) == [4, 5, 6, 7, 8] and got[4] == ["one"] and got[6] == ['He said "stop."', "Then (maybe!)", "went... and came… Yes"] and len(got[8][0]) == 50_000
    assert all(" ".join(s) == " ".join((dict(rows)[k] or "").split()) for k, s in got.items())
    none = docs.where("doc_id < 0")
    empty = sentences.train(none, persisted)
    assert [t.count() for t in (empty.abbreviations, empty.starters, empty.collocations, empty.joined)] == [0] * 4
    assert sentences.split_sentences(none, empty, "doc_id").count() == 0 and mining.mined(none, "doc_id", [], persisted).count() == 0


def test_noun_phrases_follow_the_grammar(spark):
    lexicon, suffixes = spark.createDataFrame([("the", "O"), ("runs", "O"), ("big", "J"), ("red", "J")], "word string, tag string"), spark.createDataFrame([("ous", "J"), ("us", "O")], "suffix string, tag string")
    sents = spark.createDataFrame([(1, ["The big red dog house runs.", "Famous red.", "cat, big, mouse red dog big 12 cats x-y 'z"]), (2, [])], "doc_id long, sentences array<string>")
    got = {(r["doc_id"], r["nth"]): r["phrases"] for r in mining.noun_phrases(sents, "doc_id", lexicon, suffixes, persisted).collect()}
    assert got == {(1, 0): [["big", "red", "dog", "house"]], (1, 2): [["cat"], ["mouse"], ["red", "dog"], ["cats", "x-y"], ["z"]]}
    tags = {r["word"]: r["tag"] for r in mining.word_tags(spark.createDataFrame([(w,) for w in ("famous", "ous", "bus", "plus", "12", "dog", "the")], "word string"), lexicon, suffixes).collect()}
    assert tags == {"famous": "J", "ous": "N", "bus": "N", "plus": "O", "12": "O", "dog": "N", "the": "O"}


def test_purified_drops_code_and_navigation(spark):
    body = "<p>" + "plain words in a paragraph " * 6 + "</p>"
    html = f"<html><body><nav>menu</nav><header>head <b>er</b></header>{body}<table><tr><td>cell</td></tr></table><p>see <a href='x'>link</a> end</p><!-- no --><footer>foot</footer></body></html>"
    parsed = dom.parse(spark.createDataFrame([(1, html), (2, "<p>short</p>"), (3, None)], "doc_id long, html string"), "doc_id", "html", hold=False)
    got = {r["doc_id"]: r["text"] for r in mining.purified(parsed, "doc_id").collect()}
    assert got == {1: " ".join(("plain words in a paragraph " * 6 + " see end").split())}


def test_glossary_file_keeps_translations(spark, tmp_path):
    path = str(tmp_path / "book.json")
    terms = spark.createDataFrame([("Data Frame", 1.0), ("Query Plan", 0.5)], "term string, score double")
    mining.write_glossary(terms, path)
    assert json.loads(open(path).read()) == mining.empty_glossary(terms) == {"Data Frame": "", "Query Plan": ""}
    open(path, "w").write(json.dumps({"data frame": "数据帧", "Old Term": "旧", "Query Plan": ""}))
    state = {r["term"]: r["state"] for r in mining.write_glossary(terms, path).collect()}
    assert json.loads(open(path).read()) == {"Data Frame": "数据帧", "Query Plan": ""} and state == {"Data Frame": "kept", "Query Plan": "kept", "Old Term": "removed"}
    open(path, "w").write("{broken")
    mining.write_glossary(terms, path)
    assert list(json.loads(open(path).read())) == ["Data Frame", "Query Plan"] and len(list(tmp_path.iterdir())) <= 3


def test_terms_rank_by_mean_tfidf(spark):
    phrases = spark.createDataFrame([(1, 0, [["neural", "network"], ["deep", "neural", "network"]]), (1, 1, [["query", "plan"]]), (2, 0, [["query", "plan"], ["plan"]])], "doc_id long, nth int, phrases array<array<string>>")
    got = {r["term"]: r["score"] for r in mining.ranked_terms(phrases, "doc_id", 4, ["the"], persisted).collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    a, b = 2 * idf(1), idf(1)
    norm = math.hypot(a, b)
    assert got == {"neural network": round(a / norm / 4, 6), "deep neural network": round(b / norm / 4, 6), "query plan": 0.5}


def test_terms_of_equal_and_of_single_sentences_rank_as_by_brute_force(spark):
    from quire.operators import glossary

    rng = random.Random(3)
    vocabulary = "alpha beta gamma delta the epsilon".split() + [f"w{i}" for i in range(30)]
    sents = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 9))] for _ in range(120)]
    sents += sents[:40] * 3 + [["alpha", "beta", "alpha", "beta", "alpha"], ["the"], ["solo"]]
    n, each = len(sents), []
    for s in sents:
        tf = Counter(" ".join(g) for k in range(2, 6) for i in range(len(s) - k + 1) if "the" not in (g := s[i : i + k]))
        each.append(tf)
    df = Counter(t for tf in each for t in tf)
    want = Counter()
    for tf in each:
        w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in tf.items()}
        for t, x in w.items():
            want[t] += x / math.sqrt(sum(v * v for v in w.values())) / n
    for top in (5, 60, 10_000):
        first = sorted(((-round(x, 6), t) for t, x in want.items()))[:top]
        got = glossary.tfidf(spark.createDataFrame([(s,) for s in sents], "words array<string>"), ["the"], persisted, top)
        assert [(r["term"], r["score"]) for r in got.orderBy("score", "term").collect()] == sorted(((t, -x) for x, t in first), key=lambda r: (r[1], r[0]))


def test_only_shared_words_are_told_apart_by_a_shuffle(spark):
    from quire.operators import ranking

    units = ranking.distinct_units(spark.createDataFrame([("a b c\nd e",), ("a b c\nd e",), ("a b x",), ("q r s",)], "unit string"), persisted)
    met = ranking._shared(units, 2, 2, False).join(units, "sid").collect()
    assert {r["unit"]: [x["df"] for x in r["met"]] for r in met} == {"a b c\nd e": [3], "a b x": [3]}


def test_sentences_are_cut_in_their_row_as_by_the_join(spark, corpus):
    _, docs, model = corpus
    odd = ['He said "stop." Then  (maybe!) went... and came… Yes', ". . . A. B. c", "Dr.) Hill (Mr. Stone) 5. edition 3.5. x İ. ẞ. ǅ. end.", "J. K. Miller… dog", "x. " * 300]
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    own = sentences.split_sentences(docs, model, "doc_id")
    by_join = sentences._split_by_join(docs, model.joins(docs), "doc_id", "text")
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["sentences"] for r in own.collect()} == {r["doc_id"]: r["sentences"] for r in by_join.collect()}


def test_phrases_are_found_in_their_row_as_by_the_join(spark, corpus, monkeypatch):
    _, docs, model = corpus
    sents = sentences.split_sentences(docs, model, "doc_id")
    found = mining.noun_phrases(sents, "doc_id", *mining.tag_tables(spark), persisted)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mining, "BROADCAST", 3)
    by_join = mining.noun_phrases(sents, "doc_id", *mining.tag_tables(spark), persisted)
    rows = lambda df: {(r["doc_id"], r["nth"]): r["phrases"] for r in df.collect()}
    assert rows(found) == rows(by_join) and rows(found)


def test_units_are_ranked_in_slices_and_leave_nothing(spark, tmp_path, monkeypatch):
    """Slices of a few files each, and a filter that is full, give the same terms; only the ranked ones stay on disk."""
    from quire.operators import ranking
    from quire.sources import tables

    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))),) for _ in range(300)]
    sents = spark.createDataFrame(rows, "unit string").repartition(6)
    told = lambda df: [(r["term"], r["score"]) for r in df.orderBy(F.desc("score"), "term").collect()]
    units = ranking.distinct_units(sents, tables.persisted)
    want = told(ranking.ranked(units, 300, tables.persisted, 40, 5))
    monkeypatch.setattr(tables, "shared_folder", lambda s: str(tmp_path))
    for name, value in {"SLICE": 1, "SLICES": 3, "LEAST_BITS": 6, "MOST_BITS": 6}.items():
        monkeypatch.setattr(ranking, name, value)
    spread = tables.persisted(units.select("unit", "m", "whole").repartition(6).withColumn("sid", F.monotonically_increasing_id()))
    assert told(ranking.ranked(spread, 300, tables.persisted, 40, 5)) == want and len(want) == 40
    assert len(list((tmp_path / "quire").iterdir())) == 2


def test_mining_leaves_its_terms_and_makes_a_text_pure_once(spark, tmp_path, monkeypatch):
    from quire.operators.sentences import pure
    from quire.sources import tables

    odd = ["a  b", " a\t\nb ", "a b\n", " a   b\x1c\x1dc", "a\x85b", " ", "", "ab c d", None, "a\n b \n\n c"]
    got = [r["p"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i long, t string").select("i", pure(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == ["a b", "a b", "a b", "a b c", "a b", "", "", "ab c d", None, "a b c"]
    monkeypatch.setattr(tables, "shared_folder", lambda s: str(tmp_path))
    text = "The great river of the north meets the old stone bridge. " * 3
    docs = spark.createDataFrame([(1, text), (2, text + "Great river boats pass."), (3, "short"), (4, None)], "doc_id long, text string")
    terms = mining.mined(docs, "doc_id", ["the"], tables.persisted)
    assert "Great River" in {r["term"] for r in terms.collect()}
    assert len(list((tmp_path / "quire").iterdir())) == 1
