"""Python steps hold pieces of a bounded size, whatever Arrow batches hold, and give the rows of the whole batch."""

import tracemalloc

import pyarrow as pa

from seepage.functions import hosts, html
from seepage.functions.pieces import pieces
from seepage.operators import matching
from seepage.plans import QUERIES
from seepage.plans import source_queries as Q

SF = "/root/testdata/sf0.001"


def test_pieces_are_all_rows_in_order():
    texts = pa.array(["a" * (i % 90) for i in range(500)] + [None, "x" * 5_000, ""])
    numbers = pa.array(range(503))
    cut = list(pieces([texts, numbers], 1_000))
    assert [v for t, _ in cut for v in t.to_pylist()] == texts.to_pylist()
    assert [v for _, n in cut for v in n.to_pylist()] == list(range(503))
    assert all(len(t) == 1 or t.nbytes + n.nbytes <= 1_000 for t, n in cut) and len(cut) > 20
    assert list(pieces([pa.array([], pa.string())])) == []


def test_grams_of_a_batch_take_the_memory_of_a_piece():
    texts = pa.array([f"{i:06d} some words of a page " * 80 for i in range(8_000)])
    grams = matching._byte_grams(6, (6,)).func
    tracemalloc.start()
    n = sum(len(out) for out in grams(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8_000 and peak < 12 * texts.nbytes  # ninety bytes a byte if a batch is held
    few = texts.slice(3, 40)
    assert [x for out in grams(iter([few])) for x in out.to_pylist()] == [x for i in range(40) for out in grams(iter([few.slice(i, 1)])) for x in out.to_pylist()]


def test_nodes_and_links_come_by_piece(monkeypatch):
    held, nodes_of = [], html._nodes_of
    monkeypatch.setattr(html, "_nodes_of", lambda pages: held.append(pages.nbytes) or nodes_of(pages))
    pages = pa.array([f"<p>{i}</p>" + "<br>" * 500 for i in range(3_000)] + [None, ""])
    found = [x for out in html._parse.func(iter([pages])) for x in out.to_pylist()]
    assert max(held) <= 1 << 20 and len(held) > 5 and found == nodes_of(pages).to_pylist()
    base, links = pa.array(["https://a.example.com/x/"] * 20_000), pa.array([["y" * 90, None]] * 20_000)
    joined = list(hosts.join_urls.func(iter([(base, links)])))
    assert len(joined) > 2 and sum(map(len, joined)) == 20_000 and joined[0][0].as_py() == ["https://a.example.com/x/" + "y" * 90, None]


def test_files_are_built_by_piece():
    docs = pa.array([[{"doc_id": 10 * g + i, "text": "words " * 60} for i in range(10)] for g in range(1_000)])
    out = list(Q._file_of(lambda g, own: f"{g}:{len(own)}".encode()).func(iter([(pa.array(range(1_000)), docs)])))
    assert len(out) > 3 and [x for o in out for x in o.to_pylist()] == [f"{g}:10".encode() for g in range(1_000)]


def test_arrays_of_certificates_do_not_grow(spark, monkeypatch):
    sizes, write = [], Q.write_files
    monkeypatch.setattr(Q, "PER_ARRAY", 30, raising=False)
    monkeypatch.setattr(Q, "write_files", lambda rows, folder: sizes.extend(
        bytes(r.content).count(b"\n") - 1 for r in rows.collect()) or write(rows, folder))
    found = QUERIES["ct_load_arrays"](spark, SF)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert found.count() == n == sum(sizes) and max(sizes) < 65  # twenty files of 75 before
