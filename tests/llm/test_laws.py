"""What operator 3 promises of its shards, measured on them."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import sharding


@pytest.mark.parametrize("n_shards", [1, 7, 40])
def test_shards_are_near_equal_in_bytes(spark, n_shards):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(900)]
    texts += [texts[3]] * 60 + [texts[7]] * 25 + [None] * 20 + ["long " * 8000]
    out = sharding.shard_by_size(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), n_shards).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
    load, slots, home, groups = Counter(), defaultdict(list), {}, Counter()
    for r in out:
        text = texts[r["doc_id"]]
        size = len((text or "").encode()) + 16
        assert (r["size"], r["law"], r["grown_shard"]) == (size, "bytes", None) and r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        load[r["shard"]] += size
        slots[r["shard"]].append(r["slot"])
        if text is not None:
            groups[text] += size
            assert home.setdefault(text, r["shard"]) == r["shard"]  # equal texts stay together
    assert set(load) <= set(range(n_shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # longest first on the least loaded: no shard is ahead of another by more than the last group put on it
    mean, largest = sum(load.values()) / n_shards, max(groups.values())
    assert max(load.values()) <= max(mean * 1.01 + 16, largest) or max(load.values()) - min(load[i] for i in range(n_shards)) <= 0.02 * mean + 64
