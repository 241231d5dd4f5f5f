"""Operators 11 to 13 on small tables of odd cases, against their definitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle, periodic, urlfilter

CLASH = ("rank", "pos", "h", "n", "src", "digits", "all", "block", "way", "top", "host", "path", "rule", "runs", "start", "key")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# 11


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def tree(hashes):
    """All levels of a tree."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def manifest_of(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = way(trees[s], i) + way(top, at)
            other = r[4].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
            h = leaf((*r[:4], other))
            for left, right in steps:
                h = sha(left + h + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return out


def document_rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "Gämma", "日本", ""])
    rows = [(i * rng.choice([1, 1, 70_000]) - 50, "big", rng.choice(["en", None]), i, f"{word()} {word()}") for i in range(600)]
    rows += [(i, "sixteen", "en", 1, "x") for i in range(16)] + [(i, "seventeen", "en", 1, "X") for i in range(17)] + [(7, "lone", "en", 1, "One")]
    rows += [(None, None, None, None, None)] * 3 + [(None, "big", "en", 5, t) for t in ("a", "b", "A")] + [(5, "twice", "en", 5, t) for t in ("b", "a", "a", "", None)]
    rows += [(2**63 - 1, "far", "en", 1, "A"), (-(2**63), "far", "en", 1, "A"), (3, "", "en", 1, "Long " * 20_000)]
    rows += [(i, f"s{i}", "en", 1, "X") for i in range(300)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def queried(docs):
    """As the query derives its columns."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    out = merkle.manifest(docs, F.when(chosen, F.translate("text", merkle.UPPER, merkle.LOWER)))
    proof = merkle.hashed(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""))
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


@pytest.mark.parametrize("copies", [merkle.COPIES, 2])
def test_manifest_by_definition(spark, monkeypatch, copies):
    monkeypatch.setattr(merkle, "COPIES", copies)  # equal rows are spread in runs, whatever their length
    rows = document_rows()
    got = [tuple(r) for r in queried(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(manifest_of(rows), key=repr)
    assert not all(r[-1] for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "Text")], [(None, None, None, None, None)], [(1, "a", "en", 1, "x"), (1, "b", "en", 1, "x")]])
def test_small_manifests(spark, rows):
    assert sorted((tuple(r) for r in queried(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == sorted(manifest_of(rows), key=repr)


def test_deep_manifest(spark):
    """Three levels of blocks: more than 65,536 leaves in one source."""
    n = 65_536 + 300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.col("id").cast("string").alias("text"))
    out = merkle.manifest(docs).agg(F.count(F.lit(1)), F.count_if("verified"), F.countDistinct("leaf"), F.max("root"), F.max(F.size("proof"))).first()
    levels = tree([leaf((i, "s", "en", 1, str(i))) for i in range(n)])
    assert tuple(out) == (n, n, n, levels[-1][0], 5)


# 12


def verdict_of(url, rules, strict, soft):
    text = (url or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), found[2]) if found else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
    hits = lambda terms: [t for t in terms if re.search(rf"(?<![a-z0-9\x80-\U0010ffff]){re.escape(t)}(?![a-z0-9\x80-\U0010ffff])", text)]
    hard, mild = hits(strict), hits(soft)
    return host, path, best and best.name, best.verdict if best else "block" if hard or len(mild) >= 2 else "allow", hard, mild


def test_url_verdicts_by_definition(spark):
    rng = random.Random(6)
    strict, soft = ["casino", "xxx", "live-bet"], ["bet", "win", "free", "free-bet", "casino", "日本"]
    bits = ["casino", "XXX", "bet", "win", "free", "-", ".", "/", "日本", "é", "com", "net", "www", "example", "?", "#", "://", "en", "1", "%63", ":80", "live"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    urls += ["".join(["http", rng.choice(["", "s"]), "://", rng.choice(["", "www.", "m."]), rng.choice(["example", "WIN-free", "xn"]), rng.choice([".com", ".net", ".org"]), rng.choice(["", "/", "/en/1", "/fr/casino", "/es/"]), rng.choice(["", "?a=win", "#x"])]) for _ in range(300)]
    urls += [None, "", "://", "a://b", "http://Example.COM", "x" * 3000 + "://casino.org/" + "y/" * 40_000 + "casino", "\n://a\nb/c\nd"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://casino.org"), (5, "twice"), (5, "twice")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("casino"))).repartition(3)
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["strict_terms"], r["soft_terms"]) for r in urlfilter.filter_urls(pages, urlfilter.RULES, strict, soft).collect()]
    want = [(i, *verdict_of(u, urlfilter.RULES, strict, [t for t in soft if t not in strict])) for i, u in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert urlfilter.filter_urls(pages.where("page_id < -1")).count() == 0


def test_url_rules_and_limits(spark, monkeypatch):
    rules = [urlfilter.Rule("b.c", "/x", "block"), urlfilter.Rule("c", "/xy/", "allow"), urlfilter.Rule("", "", "block")]
    pages = spark.createDataFrame([(1, "http://a.b.c/xy/"), (2, "http://c/xyz"), (3, "none")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, rules, [], []).collect()}
    assert got == {1: ("b.c/x", "block"), 2: (None, "allow"), 3: ("", "block")}
    counted = urlfilter.filter_urls(spark.createDataFrame([(1, "casino-casino/bet.bet")], "page_id long, url string"), [], ["casino"], ["bet"]).first()
    assert (counted["strict_hits"], counted["soft_hits"]) == (2, 2)
    monkeypatch.setattr(urlfilter, "MOST_BYTES", 3)
    with pytest.raises(ValueError):
        urlfilter.filter_urls(pages)


# 13


def runs_by_definition(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def periodic_texts():
    rng = random.Random(8)
    texts = [None, "", " \n ", "a", "a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a c", ("x y z " * 10 + "w ") * 4, "a " * 30 + "b " * 30, ("a " * 30 + "b ") * 5, "é " * 40 + "日本 " * 25]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
            words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))] + [rng.choice("abcd") for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice([" ", "\t", " \n"]).join(words))
    return texts + ["z " * 3000, "p q r " * 900 + "s"]


def test_runs_by_definition(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(periodic_texts())] + [(None, "a " * 24), (3, "a " * 24), (3, "a " * 24)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(2)

    def want(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        runs = runs_by_definition(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        return len(words), tuple(runs), b" ".join(w for i, w in enumerate(words) if i not in gone)

    got = [(r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), bytes(r["collapsed"])) for r in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(((i, *want(t)) for i, t in rows), key=repr)
    assert sum(len(r[2]) for r in got) > 60 and periodic.periodic_runs(docs.where("doc_id < 0")).count() == 0


def test_pairs_in_parts(monkeypatch):
    import numpy as np

    words = np.array([1, 2, 3] * 40 + [4] + [5, 6] * 30)
    whole = periodic.runs_of(periodic.names(words, np.array([0, len(words)])), 0, len(words)).tolist()
    monkeypatch.setattr(periodic, "PAIRS", 1)
    assert periodic.runs_of(periodic.names(words, np.array([0, len(words)])), 0, len(words)).tolist() == whole == [list(r) for r in runs_by_definition(words.tolist())]


def test_query_plants_and_digests(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(rng.choice([0, 1, 30, 200, 300])))) for i in range(150)] + [(None, "x"), (12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op13_periodic(spark, str(tmp_path)).collect()]
    want = []
    for i, text in rows:
        words = (text or "").split()
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = runs_by_definition(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, n, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for j, w in enumerate(words) if j not in gone))))
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[2] > 0 for r in got) > 2
