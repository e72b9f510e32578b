"""Hot keys, ties and sizes: what tasks hold stays bounded, and results stay those of plain versions."""

import math
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seepage.llm import packing, sharding, tokens


def bm25(docs, seed):
    """Scores of all documents for the terms of the seed, from the formula; terms of one document or of half of them are left out."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    counts = [Counter(d.tolist()) for d in docs]
    df = Counter(t for c in counts for t in c)
    out = []
    for d, c in zip(docs, counts):
        total = 0.0
        for t in counts[seed]:
            if 1 < df[t] and 2 * df[t] < n and c[t]:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                total += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(total)
    return out


def test_neighbours_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    docs = [np.minimum(rng.zipf(1.3, int(rng.integers(1, 80))), 400).astype("<u2") for _ in range(200)] + [np.array([7], "<u2")] * 3
    for seed in (0, 5, 100, 199, 201):
        index = packing.Index(docs)
        index.used[[seed, 11, 12]] = True
        scores = bm25(docs, seed)
        want = sorted((i for i, x in enumerate(scores) if x > 0 and not index.used[i]), key=lambda i: (-round(scores[i], 9), i))
        found = index.neighbours(seed)
        got = [next(found) for _ in want]
        assert [round(scores[i], 9) for i in got] == [round(scores[i], 9) for i in want]
        assert not want or sorted(got) == sorted(want)
        rest = []
        for doc in found:
            index.used[doc] = True
            rest.append(doc)
            if len(rest) == 5:
                break
        assert rest == sorted(rest)


@pytest.mark.parametrize("room", [0, 600, 8_000_000])
def test_neighbours_do_not_depend_on_the_table(monkeypatch, room):
    """Frequent terms are summed as rows of a table, the others as postings, in any share."""
    rng = np.random.default_rng(4)
    docs = [np.minimum(rng.zipf(1.3, int(rng.integers(1, 80))), 400).astype("<u2") for _ in range(200)]
    monkeypatch.setattr(packing, "TABLE", room)
    index = packing.Index(docs)
    assert index.table.size <= max(room, index.n) and (len(index.table) > 1) == (room > 200)
    for seed in (0, 5, 100):
        scores = bm25(docs, seed)
        found, want = index.neighbours(seed), sum(x > 0 for x in scores)
        got = [scores[next(found)] for _ in range(want)]
        assert min(got) > 0 and np.allclose(got, sorted(scores, reverse=True)[:want], rtol=1e-5)


def test_very_many_short_documents():
    """Time follows the number of documents where each has no neighbour or the same few terms."""
    def seconds(n):
        docs = [np.array([0] if i % 2 else [i % 50 + 1, 0], "<u2") for i in range(n)]
        started = time.process_time()
        assert sorted(packing.chain(docs)) == list(range(n))
        return time.process_time() - started

    seconds(2_000)
    assert seconds(60_000) < 25 * max(seconds(6_000), 0.05)


@pytest.mark.parametrize("spaced, name", [(True, "byte_bpe_50k.json"), (False, "word_bpe_49k.json")])
def test_a_small_cache_gives_the_same_ids(spaced, name):
    rng = random.Random(3)
    letters = "abcdeéßñ日"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "###", "\n"])
                      for _ in range(60)) for _ in range(60)]
    small = tokens.Encoder(public_tokenizers.path(name), spaced, "<u2", kept=40_000)
    assert [small.encode(texts[i: i + 7]) for i in range(0, 60, 7)] == [small.whole(texts[i: i + 7]) for i in range(0, 60, 7)]
    assert small.before and tokens._OBJECTS * len(small.known) < 400_000


def test_pieces_are_numbered_once_and_a_failed_call_leaves_none():
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True, "<u2")
    texts = ["one two, two\nthree", "two é日 one.", None, "", "a  b"]
    want, whole = enc.whole([t or "" for t in texts]), enc._whole
    enc._whole = lambda texts: 1 / 0
    with pytest.raises(ZeroDivisionError):
        enc.encode(texts)
    enc._whole = whole
    assert enc.encode(texts) == enc.encode(texts) == want
    assert sorted(enc.known.values()) == list(range(len(enc.known))) and len(enc.known.ends) == len(enc.known) + 1


@pytest.mark.parametrize("rows", [
    "SELECT id % 3 = 0 AS hot, id, repeat(char(CAST(97 + id % 26 AS INT)), 100) AS text FROM range(6000)",  # one id holds a third
    "SELECT true AS hot, id, 'the same text in every row, which no hash of id and text can part' AS text FROM range(10000)",
])
def test_buckets_fit_whatever_the_ids(spark, tmp_path, rows):
    docs = spark.sql(rows).select(F.when(F.col("hot"), F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), "text")
    found = sharding.write_shards(docs, str(tmp_path / "out"), 4, bucket_bytes=16_384)
    sizes = [r.total for r in found.groupBy("bucket").agg(F.sum("size").alias("total")).collect()]
    assert max(sizes) < 2 * 16_384 and sum(sizes) == docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    slots = found.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("d"))
    assert all(r.n == r.d == r.top + 1 for r in slots.collect())
