"""Packing of documents into token windows by lexical retrieval.

Documents are encoded once and dealt into shards by a signature of their
tokens, the least hash of their token triples, so that near copies meet; the
id breaks ties, which splits large groups. Every shard has an inverted index
of its own with BM25 weights; its terms are vocabulary ids. Terms that half of
the shard's documents hold tell little and are not in the index. The first document
of a window is its seed: the index returns the seed's best neighbours that are
not used yet, and they fill the window one after another. A document that goes
beyond the window is cut there and seeds the next one. Documents without a
neighbour follow in the order of the signature. A seed meets the documents of
its own shard, not those of others.

All windows of a shard but its last are full. What is left at the end goes
into sequences of the powers of two that add up to it, so nothing is padded.

A null text is an empty one, which has the end id alone. A very long text is
encoded and cut like any other, and may make a shard alone. Repeated rows have
pieces each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.tokens import batches_of_texts, encoder, give_back
from seepage.session import settle

WINDOW = 1024
#: Tokens of a shard, which one task holds with its index.
SHARD_TOKENS = 4_000_000
#: Documents of a shard, for short ones: their numbers take 16 bits.
SHARD_DOCS = 1 << 16
#: Weights of a shard's most frequent terms that are held for every document.
TABLE = 8_000_000
#: Best candidates that are put in order first.
FIRST = 32
K1, B = 1.2, 0.75
DTYPE = "<u2"


def signatures(docs: list[bytes], most: int = 1 << 15) -> list[int]:
    """Of each document's ids the least hash of the token triples; of fewer tokens, of what there is. ``most``: tokens hashed at once."""
    out, some, held = [], [], 0
    for k, data in enumerate(docs, 1):
        some.append(data.ljust(6, b"\0"))
        held += len(data) // 2
        if held < most and k < len(docs):
            continue
        x = np.frombuffer(b"".join(some), DTYPE).astype(np.uint64)
        ends = np.cumsum([len(d) // 2 for d in some])
        with np.errstate(over="ignore"):
            h = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        spans = np.column_stack([np.r_[0, ends[:-1]], ends - 2]).ravel()[:-1]  # no triple spans two documents
        out += (np.minimum.reduceat(h, spans)[::2] >> np.uint64(1)).tolist()
        some, held = [], 0
    return out


def encoded(docs: DataFrame, tokenizer: str, *, spaced: bool = True, end_id: int = 0, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, sig, n, ids): little-endian 16-bit ids of every whole text with ``end_id`` after them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        give_back()
        enc, end = encoder(tokenizer, spaced, DTYPE), np.array([end_id], DTYPE).tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in batches_of_texts(texts):
                ids = [x + end for x in enc.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a),
                     pa.array(signatures(ids), pa.int64()),
                     pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "sig", "n", "ids"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, sig long, n long, ids binary")


def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest positive scores, or of as many as there are; of equal ones the first."""
    least = np.partition(scores, -n)[-n] if len(scores) > n else 0
    if least <= 0:
        return np.flatnonzero(scores > 0)
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[: n - len(above)]]


class Index:
    """Inverted index of a shard's documents with BM25 weights, and which of them are used."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        wide = np.uint32
        keys = np.repeat(np.arange(n, dtype=wide) << wide(16), lengths) | np.concatenate(docs).astype(wide)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        tf = np.diff(np.r_[first, len(keys)])
        keys = keys[first]
        doc, term = (keys >> wide(16)).astype(np.int32), (keys & wide(0xFFFF)).astype(np.int32)
        df = np.bincount(term, minlength=1 << 16)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / lengths.mean()))
        # Terms of half the documents or more tell nothing; a term of one document has no other to find.
        telling = (df > 1) & (2 * df < n)
        own = telling[term]
        doc, term, weight = doc[own], term[own], weight[own]
        self.starts = np.searchsorted(doc, np.arange(n + 1))  # by document, for queries
        self.terms = term
        order = np.argsort(term, kind="stable")
        doc, weight = doc[order].astype(np.intp), weight[order]  # as bincount takes them
        ends = np.r_[0, np.cumsum(np.bincount(term, minlength=1 << 16))]
        # The longest postings become rows of a weight for every document, which are summed faster than they are counted.
        often = np.argsort(-df * telling, kind="stable")[: max(1, TABLE // max(n, 1))]
        often = np.sort(often[(telling & (df > n // 16))[often]])
        self.row = np.full(1 << 16, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.table = np.zeros((len(often), n), np.float32)
        for row, (i, j) in zip(self.table, zip(ends[often].tolist(), ends[often + 1].tolist())):
            row[doc[i:j]] = weight[i:j]
        self.posting_docs, self.posting_weights, self.term_starts = doc, weight, ends
        self.docs = np.arange(n)  # whose columns the table and the postings have
        self.used = np.zeros(n, bool)
        self.next = 0

    def drop_used(self) -> None:
        """Take the used documents out of table and postings once they are a quarter of them."""
        left = ~self.used[self.docs]
        n = int(np.count_nonzero(left))
        if 4 * n > 3 * len(left):
            return
        self.docs, self.table = self.docs[left], np.compress(left, self.table, axis=1)
        own, place = left[self.posting_docs], np.cumsum(left) - 1
        self.term_starts = np.r_[0, np.cumsum(own)][self.term_starts]
        self.posting_docs, self.posting_weights = place[self.posting_docs[own]], self.posting_weights[own]

    def in_order(self) -> int | None:
        """The first unused document."""
        while self.next < self.n and self.used[self.next]:
            self.next += 1
        return self.next if self.next < self.n else None

    def neighbours(self, seed: int):
        """Documents that are unused when they are asked for, by falling BM25 score for all terms of the seed, then the others in order."""
        terms = self.terms[self.starts[seed]: self.starts[seed + 1]]
        if len(terms):
            self.drop_used()
            docs, rows = self.docs, self.row[terms]
            terms = terms[rows < 0]
            sums = np.zeros(len(docs), np.float32)
            for row in rows[rows >= 0].tolist():
                sums += self.table[row]
            scores = sums.astype(np.float64)
            spans = [slice(a, b) for a, b in zip(self.term_starts[terms].tolist(), self.term_starts[terms + 1].tolist())]
            if spans:
                scores += np.bincount(np.concatenate([self.posting_docs[s] for s in spans]),
                                      np.concatenate([self.posting_weights[s] for s in spans]), len(docs))
            scores[self.used[docs]] = 0
            first = best(scores, FIRST)
            ordered = lambda at: at[np.lexsort((at, -scores[at]))]
            for doc in docs[ordered(first)].tolist():
                if not self.used[doc]:
                    yield doc
            scores[first] = 0  # the others, which few windows come to
            for doc in docs[ordered(np.flatnonzero(scores))].tolist():
                if not self.used[doc]:
                    yield doc
        while (doc := self.in_order()) is not None:
            yield doc


def chain(docs: list[np.ndarray]) -> list[int]:
    """The order of a shard's documents: each window's seed is followed by its neighbours until the window is full."""
    index, out, at = Index(docs), [], 0
    found, doc = None, index.in_order()
    while doc is not None:
        index.used[doc] = True
        out.append(doc)
        room = -at % WINDOW
        at += len(docs[doc])
        if at % WINDOW == 0:  # the next window starts with a new seed
            found, doc = None, index.in_order()
            continue
        if found is None or len(docs[doc]) > room:  # this document is the first of the window that is open now
            found = index.neighbours(doc)
        doc = next(found, None)
    return out


def windows(total: int) -> list[int]:
    """Lengths of the sequences of ``total`` tokens: full windows, then powers of two."""
    rest = total % WINDOW
    return [WINDOW] * (total // WINDOW) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(lengths: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of documents of these lengths, laid end to end."""
    out, sizes, seq, offset = [], windows(sum(lengths)), 0, 0
    for doc, n in enumerate(lengths):
        start = 0
        while start < n:
            length = min(n - start, sizes[seq] - offset)
            out.append((doc, start, length, seq, offset))
            start, offset = start + length, offset + length
            if offset == sizes[seq]:
                seq, offset = seq + 1, 0
    return out


def _pack(with_ids: bool, shard_tokens: int):
    def packed(doc_ids: pa.Array, docs: list[np.ndarray], first: int):
        order = chain(docs)
        found = pieces([len(docs[i]) for i in order])
        at = [order[p[0]] for p in found]
        bodies = [docs[i][s: s + n] for i, (_, s, n, _, _) in zip(at, found)]
        columns = {
            "doc_id": doc_ids.take(pa.array(at)), "start": pa.array([p[1] for p in found], pa.int64()),
            "length": pa.array([p[2] for p in found], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(b.astype("<u4").tobytes()) for b in bodies], pa.int64()),
            "doc_tokens": pa.array([len(docs[i]) for i in at], pa.int64()),
            "sequence_id": pa.array([first + p[3] for p in found], pa.int64()),
            "offset": pa.array([p[4] for p in found], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([b.tobytes() for b in bodies], pa.binary())
        return pa.RecordBatch.from_pydict(columns), found[-1][3] + 1

    def run(batches):
        give_back()
        first = TaskContext.get().partitionId() << 40
        ids, docs, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            start = 0
            for k, data in enumerate(batch.column("ids").to_pylist()):
                docs.append(np.frombuffer(data, DTYPE))
                held += len(docs[-1])
                if held >= shard_tokens or len(docs) >= SHARD_DOCS:
                    ids.append(batch.column("doc_id").slice(start, k + 1 - start))
                    out, n = packed(pa.concat_arrays(ids), docs, first)
                    yield out
                    first, start, ids, docs, held = first + n, k + 1, [], [], 0
            ids.append(batch.column("doc_id").slice(start))
        if docs:
            yield packed(pa.concat_arrays(ids), docs, first)[0]
    return run


def pack(docs: DataFrame, tokenizer: str, *, with_ids: bool = False, shard_tokens: int = SHARD_TOKENS,
         **options) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    tokens = settle(encoded(docs, tokenizer, **options), "ids")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    dealt = tokens.repartitionByRange(max(1, -(-total // shard_tokens)), "sig", "doc_id").sortWithinPartitions("sig", "doc_id", "ids")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids binary" if with_ids else ""))
    return dealt.select("doc_id", "ids").mapInArrow(_pack(with_ids, shard_tokens), schema)
