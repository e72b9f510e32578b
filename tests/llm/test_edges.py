"""Every operator and stage on null, empty, repeated, very long and tied rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
from brute import fingerprint, least_reached

from seepage.llm import (
    decontaminate, embeddings, language, line_dedup, packing, sharding, simhash, token_counts, token_files, toxicity,
)

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SPACED, PLAIN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASH = ("doc, copy, pos, line, node, fp, n, component_id, bucket, shard, size, ids, sig, part, value, lo, hi, own, gone, "
         "held_out, score, words, runs, at, edits, tokens, chars, root, later_id, bad_id, dirty_id, dirty_copy, row_id, _row_id, row_copy, "
         "text_copy, _text_copy, line_id, line_copy, line_gone, _line_copy, _line_id, _dirty_id, _dirty_copy").split(", ")

OPERATORS = {
    "packing": lambda d, i, l: packing.pack(d, SPACED),
    "simhash": lambda d, i, l: simhash.near_duplicates(d),
    "counts": lambda d, i, l: token_counts.counts(token_counts.apply_edits(
        token_counts.trees(d.drop("edits").withColumn("edits", token_counts.derived_edits()), SPACED, keep=("edits",)), SPACED)),
    "lines": lambda d, i, l: line_dedup.digest(line_dedup.without_repeats(d)),
    "files": lambda d, i, l: token_files.token_files(d, PLAIN),
    "decontaminate": lambda d, i, l: decontaminate.digest(decontaminate.contamination(d, i)),
    "language": lambda d, i, l: language.languages(d),
    "toxicity": lambda d, i, l: toxicity.toxicity(d, l),
    "sharding": lambda d, i, l: sharding.sharded(d),
}
ONE_EACH = set(OPERATORS) - {"packing"}


@pytest.fixture(scope="module")
def tables(spark):
    text = "a few words that repeat " * 12
    rows = [(0, text, "en", None, 1), (1, text, None, "s", None), (2, None, "en", "s", 0), (None, "no id here", "fr", "s", 9),
            (3, "", "fr", "s", 0), (4, "\n\n\n", None, None, 3), (5, "12 34 !!", "en", "s", 8), (6, "le mot est la", "fr", "s", 5),
            (6, "le mot est la", "fr", "s", 5), (7, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "s", 1),
            (8, "One Two", "en", "s", 7), (9, "one two", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"'x' AS {c}" for c in CLASH])
    items = spark.createDataFrame([(0, "few words that"), (None, "one two"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (6, 0), (8, None), (None, 1), (77, 0), (3, 0), (2, 1)], "doc_id long, toxic int")
    return docs, items.selectExpr("*", "'x' AS words", "'y' AS win"), labels.selectExpr("*", "1 AS score", "2 AS label")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(tables, name):
    docs, items, labels = tables
    found = OPERATORS[name](docs, items, labels).collect()
    ids = [r.doc_id for r in found]
    if name in ONE_EACH:
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    else:
        assert set(ids) == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(tables, name):
    docs, items, labels = (t.limit(0) for t in tables)
    assert OPERATORS[name](docs, items, labels).count() == 0
    if name in ("decontaminate", "toxicity"):
        assert OPERATORS[name](tables[0], items, labels).count() == tables[0].count()


def test_empty_embeddings(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, cell int, home int")
    assert embeddings.near_vectors(none).count() == 0


def test_defined_results(tables):
    docs, items, labels = tables
    by_language = {r.doc_id: r for r in language.languages(docs).collect()}
    assert all(by_language[i].lang_pred == "und" and by_language[i].score == 0 for i in (2, 3, 4, 5))
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()}
    assert hit[2] == hit[3] == 0 and hit[8] == hit[9] == 2 and hit[0] > 0
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert component[1] == 0 and component[3] == component[4] == component[2] == 2 and component[9] == 8
    lines = {r.doc_id: r for r in line_dedup.without_repeats(docs).collect()}
    assert lines[0].n_gone == 0 and lines[1].n_gone == 1 and lines[2].text is None


def test_stages_keep_columns(spark, tables, tmp_path):
    docs, items, _ = tables
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def near_copy(text):
    """The text with one word changed, at the first place where its fingerprint stays within three bits."""
    own = text.split()
    for k in range(len(own)):
        other = " ".join(["changed" if i == k else w for i, w in enumerate(own)])
        if bin(fingerprint(text) ^ fingerprint(other)).count("1") <= 3:
            return other
    raise AssertionError("no such place")


def test_near_duplicates_are_those_of_all_pairs(spark):
    """The stage's decisions against fingerprints of a plain version, compared pair by pair."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    prints = [fingerprint(rows[i]) for i in ids]
    want = least_reached(ids, lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {i for i, first in zip(ids, want) if i == first}


def test_pipeline_decisions(spark, tmp_path):
    """Exact and near copies, a shared passage, a benchmark passage and texts without letters, and nothing else."""
    import random

    rng = random.Random(1)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").limit(1).first()
    vocabulary = [w for w in known.text.split() if w.isalpha()]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, bench = text(70), text(12)
    rows = [(i, text(300)) for i in range(40)]
    rows += [(100, rows[0][1]), (101, near_copy(rows[1][1])),
             (102, text(100) + "\n" + passage + "\n" + text(20)), (103, text(100) + "\n" + passage + "\n" + text(20)),
             (104, text(80) + " " + bench + " " + text(80)), (105, "12 34"), (106, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, step = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        step[name] = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = set(range(40)) | {102, 103}
    assert step["language_id"] == clean | {100, 101, 104}
    assert step["line_repeats"] == clean | {101, 104}
    assert step["near_duplicates"] == clean | {104}
    assert step["benchmark_passages"] == clean
    left = {r.doc_id: r for r in kept.collect()}
    assert passage in left[102].text and passage not in left[103].text and left[103].n_chars == len(left[103].text)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == clean


def test_stages_decide_by_row(spark):
    """A null id and a repeated id, each with a good and a bad text: only the bad one goes."""
    good = [" ".join(f"{w}{w} the word and of" for w in words) for words in ("abcdefgh", "ijklmnop", "qrstuvwx")]
    rows = [(None, good[0]), (None, "12 34"), (None, None), (5, good[1]), (5, "56 !!"), (6, good[2])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("5", good[1]), ("6", good[2]), ("None", good[0])]
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (3, text(5)), (3, text(5)),
            (4, text(4)), (None, text(1)), (None, text(6))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = simhash.first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        [("1", text(1)), ("2", text(2)), ("None", text(3)), ("3", text(5)), ("4", text(4)), ("None", text(6))])
