"""The prefix trie against a plain one that rebuilds every conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seepage.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string, part string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    below = defaultdict(list)
    for seq in members:
        for d in range(len(seq) + 1):
            below[seq[:d]].append(seq)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
    childless = {s for s in members if not any(x[:-1] == s for x in members if x)}
    return sorted(
        (min(ms), len(s), min(members[s[:-1]]) if s else None, len(ms), sum(len(x) == len(s) + 1 for x in below[s]),
         sum(x in childless for x in below[s]), sum((len(members[x]) - 1) * words(x) for x in below[s]),
         hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest())
        for s, ms in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, parts=5, **options):
    table = spark.createDataFrame([(*r, 1, "n", "p") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in P.trie(table, **options).select(COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in list(range(70)) + [200, 213, 219, 407, -5, -20, -23]:
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "a", "b b", "", None, "x\ty z"])))
    assert found(spark, rows) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(3, 0, "u", "hi there")] * 3 + [(None, 0, "u", "lost")] * 2 + [(20, None, None, None)] * 2 + [(25, 1, "", "")]
    assert found(spark, rows) == sorted(plain(rows), key=lambda r: (r[0], r[1]))
    assert found(spark, [(None, 1, "u", "x")]) == []
    assert P.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_conversation_across_many_tasks(spark):
    """One conversation holds most rows and another branches off late; repeats of one row are dealt out as well."""
    rows = [(c, i, "u", f"t{i % 5}") for c in (41, 43) for i in range(400 + 30 * (c == 43))]
    rows += [(60, 0, "u", "same")] * 500 + [(61, 0, "u", "same")] * 500 + [(62, 0, "v", "w " * 5000)]
    got = found(spark, rows)
    want = sorted(plain(rows), key=lambda r: (r[0], r[1]))
    assert got == want


def test_running_sums_do_not_depend_on_tasks(spark):
    lanes = P.Lanes()
    rows = [(7, i, "u", str(i)) for i in range(300)] + [(c, 0, "u", "x") for c in range(50, 80)]
    table = spark.createDataFrame([(*r, 1, "n", "p") for r in rows], SCHEMA).repartition(6)
    hashed = P.hashed(table, 0, id_col="conv_id", turn_col="turn", role_col="role", text_col="text")
    at, totals = P.prefixes(hashed, lanes)
    got = {r.pos: r for r in at.where("conv_id = 7").collect()}
    keys = [r.k1 for r in hashed.where("conv_id = 7").orderBy("turn").collect()]
    for lane, p in enumerate(lanes.primes):
        total = 0
        for i, k in enumerate(keys, 1):
            total = (total + k % p * pow(lanes.bases[lane], i, p)) % p
            assert got[i][f"s{lane}"] == total
    assert totals.where("conv_id = 7").first().length == 300


def test_powers(spark):
    lanes = P.Lanes()
    exponents = [0, 1, 2, 31, 2**20 + 5, 2**33 + 1]
    table = spark.createDataFrame([(e,) for e in exponents], "e long")
    for lane, p in enumerate(lanes.primes):
        want = [pow(lanes.bases[lane], e, p) for e in exponents]
        assert [r[0] for r in table.select(lanes.power(lane, F.col("e"))).collect()] == want
        assert lanes.powers(lane, np.array(exponents)).tolist() == want


def test_equal_fingerprints_are_seen(spark):
    """With so small primes different prefixes share fingerprints, and no attempt is taken for right."""
    rows = [(c, i, "u", f"{c} {i}") for c in range(40) for i in range(4)]
    with pytest.raises(ValueError, match="fingerprints"):
        found(spark, rows, primes=(7, 11), attempts=2)
