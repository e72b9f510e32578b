"""The encoder's batches of words, and the index of a shard while its documents are used."""

import copy
import json
import random

import numpy as np
import public_tokenizers
from test_bounds import bm25

from seepage.llm import packing, token_counts, tokens

SPACED = public_tokenizers.path("byte_bpe_50k.json")


def test_words_go_to_the_merges_many_at_once():
    """5,000 words, some with marks or after a line feed, take few calls of the library and have its ids."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeéßñ日") for _ in range(rng.randint(3, 9))) for _ in range(5000)})
    text = " ".join(w + rng.choice(["", "", ".", "###", "\n"]) for w in words).replace("\n ", "\n")
    enc = tokens.Encoder(SPACED, True, "<u2")
    calls, bare, whole = [], enc.bare, enc._whole

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return bare.encode_batch_fast(texts, **options)

    enc.bare, enc._whole = Counted(), lambda texts: calls.append(len(texts)) or whole(texts)
    assert enc.encode([text]) == [np.array(whole([text])[0], "<u2").tobytes()]
    assert sum(calls) < len(words) // 50
    assert enc.counts([text, None, "a  b"]) == [len(whole([text])[0]), 0, len(whole(["a  b"])[0])]


def test_a_vocabulary_with_tokens_across_words(tmp_path):
    """Merges that reach over a blank would join neighbours, so words go one by one there."""
    with open(SPACED, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    for k, (a, b) in enumerate([["e", "Ġ"], ["eĠ", "t"]]):
        model["vocab"][a + b] = 50_300 + k
        model["merges"].insert(k, [a, b])
    path = tmp_path / "across.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    enc, text = tokens.Encoder(str(path), True, "<u2"), "one two the tree\nte"
    assert enc.bare is None and enc.encode([text]) == enc.whole([text])
    assert tokens.Encoder(SPACED, True, "<u2").bare


def test_used_documents_leave_the_index():
    """Scores are summed for the documents that are left, and are those of the whole shard's index."""
    rng = np.random.default_rng(3)
    docs = [np.minimum(rng.zipf(1.3, int(rng.integers(1, 80))), 400).astype("<u2") for _ in range(200)]
    index = packing.Index(docs)
    for k, seed in enumerate(np.argsort([-len(d) for d in docs], kind="stable")[:4].tolist()):
        index.used[seed] = True
        index.used[rng.choice(200, 45 * k, replace=False)] = True
        scores, found = bm25(docs, seed), index.neighbours(seed)
        want = [i for i, x in enumerate(scores) if x > 0 and not index.used[i]]
        got = [next(found) for _ in want]
        assert sorted(got) == want and np.allclose([scores[i] for i in got], sorted((scores[i] for i in want), reverse=True), rtol=1e-5)
        left = 200 - int(index.used.sum())
        assert want and index.table.shape[1] == len(index.docs) <= max(left * 4 / 3, left + 1)


def test_equal_scores_come_in_the_order_of_the_documents():
    scores = np.array([0.0, 2, 1, 2, 1, 1, 0, 3])
    assert packing.best(scores, 3).tolist() in ([7, 1, 3], [1, 3, 7])
    assert sorted(packing.best(scores, 4).tolist()) == [1, 2, 3, 7]
    assert sorted(packing.best(scores, 7).tolist()) == sorted(packing.best(scores, 20).tolist()) == [1, 2, 3, 4, 5, 7]
    assert packing.best(np.zeros(5), 3).tolist() == []


def test_signatures_are_those_of_single_documents():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 50_000, n).astype("<u2").tobytes() for n in [1, 2, 3, 4, 700, 0, 5, 90]]
    assert packing.signatures(docs) == packing.signatures(docs, most=100) == [packing.signatures([d])[0] for d in docs]
    assert packing.signatures([]) == []


def test_edits_of_many_documents_are_counted_together(spark):
    """Three edits of 60 documents take a call each for all of them, and pieces are kept from one to the next."""
    rng, calls = random.Random(8), []
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 3, 400]))) for _ in range(60)]
    count = token_counts._count(SPACED, True)
    assert token_counts.KEPT > 50_000 * 2 * (tokens._OBJECTS + 10)

    def counted(some):
        calls.append(len(some))
        return count(some)

    cut = [token_counts.segments(t) for t in texts]
    docs = alone = [(t, token_counts.Tree([len(p) for p in own], count(own))) for t, own in zip(texts, cut)]
    alone = [(t, copy.deepcopy(tree)) for t, tree in alone]
    for _ in range(3):
        edits = [(rng.randint(-2, 900), rng.choice([0, 0, 30]), rng.choice(["", "x y", " new words"])) for _ in docs]
        docs = token_counts.edited_together(docs, edits, counted)
        alone = [token_counts.edited(*doc, *edit, count) for doc, edit in zip(alone, edits)]
        assert [(t, tree.chars, tree.tokens, n) for t, tree, n in docs] == [(t, tree.chars, tree.tokens, n) for t, tree, n in alone]
        docs, alone = [d[:2] for d in docs], [d[:2] for d in alone]
    assert len(calls) == 3 and [tree.tokens[1] for _, tree in docs] == count([t for t, _ in docs])


def test_documents_with_different_numbers_of_edits(spark):
    rows = [(i, "one two three four " * 40, [(k, 5 * k, 3, f" z{k}") for k in range(i % 5)] if i % 7 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}").coalesce(1)
    made = token_counts.trees(docs, SPACED, keep=("edits",))
    found = {r.doc_id: r for r in token_counts.apply_edits(made, SPACED).collect()}
    whole = tokens.Encoder(SPACED, True, "<u4")
    for i, text, edits in rows:
        for _, at, remove, insert in edits or ():
            text = text[:at] + insert + text[at + remove:]
        r = found[i]
        assert (r.text, r.n_edits, r.tokens[1]) == (text, len(edits or ()), len(whole.whole([text])[0]) // 4)
        assert (r.encoded > 0) == bool(edits)
