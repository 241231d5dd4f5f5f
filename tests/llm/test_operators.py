"""The corpus operators on small tables of odd cases, against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, langid, maxent, neardup, packing, pieces, quality, sharding, substring, warc
from quire.llm.tables import written as tables_written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def texts() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = line(120).split(), line(45)
    rows = [(i, line(rng.randint(1, 200)), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100 + i, " ".join(base), "en") for i in range(6)]  # copies
    rows += [(200 + i, " ".join(w if j != 10 * i + 5 else "other" for j, w in enumerate(base)), "en") for i in range(8)]  # near copies
    rows += [(300 + i, f"{line(30)} {shared} {line(30)}", "en") for i in range(8)]  # a shared passage
    rows += [(400, None, None), (401, "", "en"), (402, " \n\t ", None), (403, "One TWO", "en"), (404, "one two", "fr"), (None, line(60), "en"), (405, "x" * 3000, "en"), (406, "a  b\n a  b\na", "fr"), (406, "a  b\n a  b\na", "fr")]
    rows += [(500, line(4000), "en"), (501, "日本 語 ▁x  é<|endoftext|> 12", "en")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string, lang string")
    # columns that clash with names the operators use
    return df.withColumns({c: F.lit("x") for c in ("cls", "rank", "bundle", "uid", "n", "size", "rid", "draw", "k", "shard")}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("doc_id = -1")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def grouped(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(tuple(r[k] for k in keys))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def expected(make):
    out = defaultdict(list)
    for i, t, lang in texts():
        out[i].append(make(i, t, lang))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def shingles(text):
    w = [x.translate(SMALL) for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("small", [48, 2])
def test_neardup_is_brute_force(docs, none, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # 2: all nodes but pairs are large
    rows = texts()
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    want = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        c = min(least[root(i)], default=None) if sets[i] else d
        want[d].append((len(sets[i]), c, d is not None and c == d))
    got = grouped(neardup.near_duplicates(docs).collect(), "n_shingles", "component_id", "kept")
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("group", [30_000, 2])
def test_substring_is_brute_force(docs, none, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    seen, want = {}, {}
    for d, t in sorted({(1 << 63 if d is None else d, t) for d, t, _ in texts()}, key=lambda x: (x[0], x[1] or "")):
        w = words(t)
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.setdefault(g, (d, i))
        want[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    got = substring.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s")).collect()
    assert len(got) == len(texts()) and {(1 << 63 if r["doc_id"] is None else r["doc_id"]): (r["n_words"], r["n_removed"], r["s"]) for r in got} == want
    assert sum(v[1] for v in want.values()) > 300 and substring.without_repeats(none).count() == 0


def test_quality_counts(docs, none):
    def one(_, t, __):
        x = t or ""
        w = words(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        covered = {j for i, g in enumerate(tri) if n[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [v for v in x.split("\n") if words(v)]
        dup = sum(v in lines[:i] for i, v in enumerate(lines))
        return len(w), sum(len(v.decode()) for v in w), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    found = quality.score_quality(docs).collect()
    assert grouped(found, *quality.FACTS, "base_failed") == expected(one)
    assert not any(r["kept"] and r["base_failed"] for r in found) and sum(r["kept"] for r in found) > 30
    assert quality.score_quality(none).count() == 0


def test_quality_learns_from_texts_full_of_symbols(spark):
    rng = random.Random(8)
    code = lambda: " ".join("".join(rng.choice("xyz=") for _ in range(4)) + rng.choice("#$%&|<>") for _ in range(80))
    found = quality.score_quality(spark.createDataFrame([(i, code(), "code") for i in range(30)], "doc_id long, text string, lang string")).collect()
    assert all(r["bits"] > 1 and r["kept"] for r in found)


def test_quality_has_a_model_for_every_language(spark):
    rng = random.Random(9)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(80))
    rows = [(100 * k + i, text("abcdefghijklmnopqrstuvwxyz"[k : k + 4]), f"l{k:02}" if k else None) for k in range(20) for i in range(7 if k < 15 else 6)]
    found = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)).collect()
    assert len(found) == len(rows) and all(r["kept"] for r in found)
    assert len({(r["low"], r["high"]) for r in found if r["doc_id"] >= 100}) >= 17
    assert all(len({r["low"] for r in found if r["doc_id"] // 100 == k}) == 1 for k in range(20))
    assert max(r["bits"] for r in found) < 2.5  # four letters and the space


def test_quality_rejects_beyond_either_band(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(200)), "en") for i in range(200)]
    rows += [(900, "".join(c if rng.random() > 0.25 else rng.choice("qxzjkvw") for c in rows[0][1]), "en")]  # garbled
    rows += [(901, " ".join("e" * (50 + i) for i in range(60)), "en"), *((910 + i, " ".join("e" * (50 + j) for j in range(60)), "en") for i in range(3))]  # the same sign on and on
    found = {r["doc_id"]: r for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert all(found[i]["kept"] for i in range(200))
    assert not found[900]["kept"] and found[900]["bits"] > found[900]["high"]
    assert not found[901]["kept"] and found[901]["bits"] < found[901]["low"]


def kneser_ney(grams: Counter) -> dict[tuple, float]:
    """Modified Kneser-Ney by its formulas: the probability of each 4-gram (a tuple) given its first three."""
    counts = {4: grams}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    lower = {(): 1 / (len(counts[1]) + 1)}
    for k in range(1, 5):
        c = [sum(v == i for v in counts[k].values()) for i in range(5)]
        y = c[1] / max(1, c[1] + 2 * c[2])
        d = [min(max(i - (i + 1) * y * c[i + 1] / max(1, c[i]), 0.05), i - 0.05) for i in (1, 2, 3)]
        total, gone = Counter(), Counter()
        for g, n in counts[k].items():
            total[g[:-1]] += n
            gone[g[:-1]] += d[min(n, 3) - 1]
        lower = {g: (n - d[min(n, 3) - 1]) / total[g[:-1]] + gone[g[:-1]] / total[g[:-1]] * lower[g[1:]] for g, n in counts[k].items()}
    return lower


def test_quality_model_is_kneser_ney(spark):
    rng = random.Random(2)
    rows = [(100 * (lang is None) + i, "".join(rng.choice("abАя中 9é𝒳") for _ in range(60)), lang) for i in range(40) for lang in ("xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["bits"] for r in quality.score_quality(docs).collect()}
    for lang in ("xx", None):
        grams, each = Counter(), {}
        for i, t, of in rows:
            if of == lang:
                line = "   " + re.sub(r"\d", "0", t)
                each[i] = [tuple(line[k : k + 4]) for k in range(len(t))]
                grams.update(each[i])
        p = kneser_ney(grams)
        for i, gs in each.items():
            assert abs(found[i] - np.mean([-np.log2(p[g]) for g in gs])) < 1e-4
        context = Counter(g[:3] for g in grams).most_common(1)[0][0]
        assert sum(p[g] for g in grams if g[:3] == context) <= 1 + 1e-9


def test_quality_in_bundles_is_the_same(docs, monkeypatch):
    whole = grouped(quality.score_quality(docs).collect(), "bits", "kept")
    monkeypatch.setattr(quality, "BROADCAST", 0)
    monkeypatch.setattr(quality, "BUNDLE", 20_000)
    assert grouped(quality.score_quality(docs).collect(), "bits", "kept") == whole


@pytest.mark.parametrize("count", [5, 40])
def test_sharding(docs, none, count):
    got = sharding.shard_by_size(docs, count).collect()
    assert grouped(got, "size", "text_crc32") == expected(lambda _, t, __: (len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())))
    shards, together = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r["shard"]].append(r)
        if r["text_crc32"] is not None:
            together[r["text_crc32"]].add(r["shard"])
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in together.values())
    assert set(shards) <= set(range(count)) and sharding.shard_by_size(none, count).count() == 0


def test_deal_class_follows_the_heap():
    import heapq

    for seed in range(20):
        rng = random.Random(seed)
        loads = [rng.random() * 50 for _ in range(7)]
        plain, heap = [(v, i) for i, v in enumerate(loads)], [(v, i) for i, v in enumerate(loads)]
        heapq.heapify(plain), heapq.heapify(heap)
        order = []
        for _ in range(45):
            load, s = heapq.heappop(plain)
            heapq.heappush(plain, (load + 3.5, s))
            order.append(s)
        head, cycle = sharding.deal_class(heap, 3.5, 45)
        assert order == (head + [cycle[i % len(cycle)] for i in range(45 - len(head))] if cycle else head)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = sorted(tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,) for _, x, _ in texts())
    got = packing.pack(docs, path).collect()
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) and sum(n for _, n in s) <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= 1
    whole = [tuple(np.frombuffer(b"".join(r["ids"] for r in sorted(v, key=lambda r: r["start"])), "<u4").tolist()) for v in by_doc.values() if v[0]["doc_id"] != 406]
    assert set(whole) <= set(want) and sum(len(x) for x in want) == sum(r["length"] for r in got)
    assert packing.pack(none, path).count() == 0


def test_fill_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(50):
        count = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(6)}
        used = packing.fill(count, sorted(count, reverse=True), 100)
        sums = {0}
        for n, c in count.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 100}
        assert sum(n * k for n, k in used.items()) == max(sums) and all(k <= count[n] for n, k in used.items())


def test_plan_with_one_length_has_little_padding():
    rows = packing.plan({1100: 1000})
    assert sum(r[4] * (r[2] - r[1]) for r in rows) == 1100 * 1000 and max(r[5] + r[2] - r[1] for r in rows) <= 1100 * 1000 // 2048 + 1


def test_pieces_are_the_librarys(docs, none):
    import sentencepiece

    path = pieces.model_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.decode(pieces.encode(docs, path), path).collect()
    ids = grouped([{"doc_id": r["doc_id"], "ids": tuple(np.frombuffer(r["ids"], "<u4").tolist()), "text": r["text"]} for r in got], "ids", "text")
    assert ids == expected(lambda _, t, __: (tuple(model.encode(t or "")), (t or "").replace("▁", " ")))
    assert pieces.encode(none, path).count() == 0


def test_a_class_meets_its_tokens_once_however_many_nodes_it_is_in(spark, monkeypatch):
    """Texts with a passage in common, none of them near another: the joins by class give a row a class, not one for each node."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng = random.Random(31)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = own(120)
    docs = spark.createDataFrame([(i, f"{own(30)} {shared} {own(30)}") for i in range(40)], "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in neardup.near_duplicates(docs).collect())
    runs, made = store.executionsList(), []
    for x in (runs.apply(i).executionId() for i in range(before, runs.size())):
        nodes, values = store.planGraph(x).allNodes(), store.executionMetrics(x)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(r"Join \[cls#\d+L?\], \[cls#\d+L?\], Inner", node.desc()):
                rows = next(m for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows")
                value = values.get(rows.accumulatorId())
                made.append(int(value.get().replace(",", "")) if value.isDefined() else 0)
    assert made and max(made) <= 40


def test_pieces_are_one_lattice_a_unit_and_the_same_by_a_join(docs, monkeypatch):
    """Every different unit of the corpus is encoded once, however many bundles it is in; units that not every task holds come by a join."""
    path = pieces.model_path()
    rows = lambda df: sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in df.collect())
    want = rows(pieces.encode(docs, path))
    monkeypatch.setattr(pieces, "BUNDLE", 1 << 10)
    tables = []
    monkeypatch.setattr(pieces, "written", lambda df, name: tables.append(tables_written(df, name)) or tables[-1])
    assert rows(pieces.encode(docs, path, most=20)) == rows(pieces.encode(docs, path)) == want
    assert all(t.count() == t.select("word").distinct().count() > 20 for t in tables)


def test_viterbi_over_the_lattice_is_the_best_path(spark):
    rng = random.Random(12)
    table = [(p, i, -rng.random() * 5) for i, p in enumerate(sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(40)}))]
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    df = spark.createDataFrame([(0, w) for w in sorted(set(words))], "bundle long, word string")
    found = pieces.encode_units(df, spark.createDataFrame(table, "piece string, id int, score double"), 4, list(range(1000, 1256)), viterbi=True).collect()
    score = {p: (v, i) for p, i, v in table}

    def best(w: str) -> tuple[float, list[int]]:
        at = [(0.0, [])]
        for e in range(1, len(w) + 1):
            options = []
            for s in range(max(0, e - 4), e):
                p = w[s:e]
                if p in score:
                    options.append((at[s][0] + score[p][0], at[s][1] + [score[p][1]]))
                elif e - s == 1:
                    options.append((at[s][0] + pieces.SPELLED, at[s][1] + [1000 + b for b in p.encode()]))
            at.append(max(options, key=lambda o: o[0]))
        return at[-1]

    name = {i: p for p, i, _ in table} | {1000 + b: chr(b) for b in range(128)}
    value = lambda ids: sum(score[name[i]][0] if i < 1000 else pieces.SPELLED for i in ids)
    assert len(found) == len(set(words))
    for r in found:  # of paths of one score either will do
        assert "".join(name[i] for i in r["ids"]) == r["word"].replace(" ", "▁") and abs(value(r["ids"]) - best(r["word"].replace(" ", "▁"))[0]) < 1e-9


def test_texts_longer_than_a_run(spark):
    """A text of 2.6 MB, more than two runs: whole, in every operator that cuts batches into runs."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(20)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(400_000))
    docs = spark.createDataFrame([(1, long, "xx"), (2, long[:3000], "xx"), (3, long, "xx")], "doc_id long, text string, lang string")
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert near[1] == near[3] == (len(shingles(long)), 1) and near[2][1] == 2
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.without_repeats(docs).collect()}
    assert cut[1] == (400_000, 0) and cut[3] == (400_000, 400_000) and cut[2][1] >= 20
    assert {r["doc_id"]: r["n_words"] for r in quality.score_quality(docs).collect()}[1] == 400_000
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = zlib.crc32(np.array(t.encode(long, add_special_tokens=False).ids + [1], "<u4").tobytes())
    got = sorted((r["start"], bytes(r["ids"])) for r in packing.pack(docs.where("doc_id = 1"), packing.tokenizer_path()).collect())
    assert zlib.crc32(b"".join(x for _, x in got)) == want
    path = pieces.model_path()
    ids = pieces.encode(docs.where("doc_id = 1"), path).first()["ids"]
    assert np.frombuffer(ids, "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(long)


def test_language_on_held_out(spark, none):
    rng = random.Random(1)
    parts = {"xx": ["ka", "lo", "mi", "ta"], "yy": ["ßen", "ung", "sch", "ver"], "zz": ["ère", "eux", "oi", "qu"]}
    row = lambda i, lang: (i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang)
    rows = [row(i, rng.choice(list(parts))) for i in range(240)] + [(900, None, "xx"), (901, "12 34 !!", "xx"), (902, "", None), (None, "kalo mita", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert len(held) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none).count() == 0


def test_marginals_are_forward_backward():
    rng = np.random.default_rng(0)
    e, moves, start = rng.random((12, 3)).astype(np.float32) + 0.1, rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.marginals(e, np.array([0, 5]), np.array([5, 7]), moves, start)
    import itertools

    for first, n in ((0, 5), (5, 7)):
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(start[path[0]]) * np.prod([e[first + i, s] for i, s in enumerate(path)]) * np.exp(sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for i, s in enumerate(path):
                total[i, s] += p
        assert np.allclose(total / total.sum(1, keepdims=True), got[first : first + n], atol=1e-4)


def test_pair_marginals_are_those_of_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    e, moves, start = rng.random((6, 3)).astype(np.float32) + 0.1, rng.normal(size=(3, 3)), rng.normal(size=3)
    filtered = np.empty_like(e)
    p = langid.marginals(e, np.array([0]), np.array([6]), moves, start, filtered)
    got = langid.pair_marginals(filtered[:-1], p[1:], moves)
    want = np.zeros((5, 3, 3))
    for path in itertools.product(range(3), repeat=6):
        odds = np.exp(start[path[0]]) * np.prod([e[i, s] for i, s in enumerate(path)]) * np.exp(sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, (a, b) in enumerate(itertools.pairwise(path)):
            want[i, a, b] += odds
    assert np.allclose(got, want / want.sum((1, 2), keepdims=True), atol=1e-4)


def test_language_model(docs, none):
    tokens = [(d, [w.translate(SMALL) for w in words(t)] + [None]) for d, t, _ in texts()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for d, ws in tokens:
        want[d].append((out(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)))
    found = maxent.score_texts(docs).withColumn("base", F.round("base_score", 5)).collect()
    assert grouped(found, "held_out", "n_tokens", "n_known", "train_tokens", "base") == {k: sorted(x, key=repr) for k, x in want.items()}
    assert all(r["score"] < 0 for r in found) and maxent.score_texts(none).count() == 0


def test_language_model_does_not_depend_on_the_partitions(docs):
    score = lambda df: {k: [round(v[0], 5) for v in x] for k, x in grouped(maxent.score_texts(df).collect(), "score").items()}
    assert score(docs) == score(docs.repartition(7, "text"))


def test_language_model_gains_over_words_alone(spark):
    rng = random.Random(6)
    words = {c: [f"{c}{i}{e}" for i in range(40)] for c, e in (("a", "er"), ("b", "en"), ("c", "ig"))}
    rows = [(i, " ".join(rng.choice(words["abc"[k % 3]]) for k in range(60)), None) for i in range(300)]  # classes of words in turn
    found = [r for r in maxent.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r["held_out"]]
    assert len(found) > 20 and np.mean([r["score"] - r["base_score"] for r in found]) > 10


def test_class_shares_sum_to_one():
    rng = np.random.default_rng(1)
    rows, weights = rng.integers(0, maxent.ROWS, (7, 50)), rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(maxent.log_softmax(rows, weights)).sum(1), 1, atol=1e-5)


def test_gradient_and_shares_by_folded_tables():
    rng = np.random.default_rng(2)
    cls, bucket, at = rng.integers(0, maxent.CLASSES, 3_000), rng.integers(0, maxent.BUCKETS, 3_000), np.arange(0, 3_001, 30)
    rows, weights = maxent.history(cls, bucket, at), rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    shares = maxent.log_softmax(rows, weights)
    parts = maxent.tables(weights)
    assert len(parts) < len(rows)  # fewer rows are summed for a token than it has features
    assert np.allclose(maxent.log_shares(rows, cls, parts), shares[np.arange(len(cls)), cls], atol=1e-4)
    total, n, gap = np.zeros((maxent.ROWS, maxent.CLASSES)), np.zeros(maxent.ROWS, np.int64), -np.exp(shares)
    gap[np.arange(len(cls)), cls] += 1
    maxent.gradient(rows, cls, parts, total, n)
    told = np.zeros_like(total)
    for r in rows:
        np.add.at(told, r, gap)
    assert np.allclose(total, told, atol=1e-3) and (n == np.bincount(rows.reshape(-1), minlength=maxent.ROWS)).all()


def test_history_reaches_five_words_back():
    cls, bucket, at = np.arange(12) % 3, np.arange(12), np.array([0, 12])
    for k in range(1, 6):
        other = cls.copy()
        other[6 - k] = 40
        assert (maxent.history(cls, bucket, at)[:, 6] != maxent.history(other, bucket, at)[:, 6]).any()
    assert (maxent.ALONE, maxent.CLASSES) == (16, 48)


def test_archive(spark):
    rows = [(5, "u5", "<p>" + "x" * 200), (3, "u3", "<p>" + "x" * 200), (9, "a\r\nb", "<p>" + "x" * 200), (1, None, "short"), (2, "u", "short"), (4, "u", None), (None, "u", "<p>" + "x" * 200), (7, "u7", "é" * 80 + "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n"), (7, "u7", "é")]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archive(archive).collect()), key=repr)
    raw = lambda h: (h or "").encode()
    owner = lambda h: min(p for p, _, x in rows if x == h and p is not None)
    again = lambda p, h: len(raw(h)) >= 100 and p != owner(h)
    assert got == sorted(((p, len(raw(h)), hashlib.sha256(raw(h)).hexdigest(), "revisit" if again(p, h) else "response", owner(h) if again(p, h) else None) for p, _, h in rows), key=repr)
    assert archive.payloads.count() == len({raw(h) for _, _, h in rows})
    for r in warc.records(archive).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[length:] == b"\r\n\r\n" and rest[:length] == (b"" if b"WARC-Type: revisit" in head else bytes(r["payload"]))
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(60)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [1.0, None] * 8), (None, x[1].tolist())]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    hit = total = 0
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-float(v @ w), i) for i, w in good if i != q)[:20]
            assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and all(abs(s - float(v @ dict(good)[i])) < 1e-9 for i, s in got[q])
            hit += len({i for _, i in near} & {i for i, _ in got[q]})
            total += 20
    assert hit >= 0.9 * total and set(got) == {i for i, _ in good if i % 20 == 0}
    few = spark.createDataFrame(rows[:21], "vec_id long, embedding array<float>")
    assert ann.search(few).where("query_id = 0").count() == 20 and ann.search(few.where("vec_id < 3")).count() == 2 and ann.search(few.where("vec_id < 0")).count() == 0


def test_pipeline(spark, docs, none):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        base = docs.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
        out = stage(spark, base, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == list(c.COLUMNS) and len(rows) <= len(texts())
        if name == "near_duplicate":
            ids = [r["doc_id"] for r in rows]
            assert 100 in ids and not set(ids) & {101, 102, 103, 104, 105} and ids.count(406) == 1 and 400 in ids
        if name == "quality":
            assert all(r["text"] and len(words(r["text"])) >= 50 for r in rows) and {300, 500} <= {r["doc_id"] for r in rows}
        if name == "language":
            assert {r["doc_id"] for r in rows} >= {0, 1, 300} and 400 not in {r["doc_id"] for r in rows}
        if name == "passages":
            assert len(rows) == len(texts())
        assert stage(spark, base.where("doc_id = -1"), "").count() == 0


def test_language_field_is_fitted_in_a_task_as_on_the_driver(spark):
    docs = spark.createDataFrame([(i, "the cat and dog" if i % 2 else "le chat et chien", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    drawn = langid.sample(docs, F.lit(True))
    rows = sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"]))
    want = langid.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    got = langid.fitted(drawn)
    assert got.langs == want.langs == ["en", "fr"] and (got.weights == want.weights).all() and (got.moves == want.moves).all()
