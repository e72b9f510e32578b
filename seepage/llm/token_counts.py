"""Token counts of documents under edits: only what an edit touches is encoded again.

A document is cut into segments where its tokenizer is sure to cut, before
white space that follows something else, so its token count is the sum of its
segments' counts. A segment tree over them holds sums of characters and of
tokens. An edit finds its segments by the character sums, takes in a neighbour
where the edited text no longer has a sure cut at the border (the boundary
context), encodes that region alone and updates the sums above it.

A null text is an empty one; its tree has one empty leaf. An edit beyond the
end is moved to the end, a negative place to the start, a null place or number
is 0 and a null insertion inserts nothing. Edits of a document apply in the
order of ``seq``, those of one ``seq`` in the order of their other columns;
the first edits of many documents are counted together, then the second ones.
Edits of unknown documents are ignored, documents without edits keep their
counts. Rows of one id share its edits. An empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import count as count_up

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.tokens import batches_of_texts, encoder

SEGMENT = 192
#: Bytes of text pieces kept by a worker; building and editing run side by side, each in workers of its own.
KEPT = 24 << 20
EDITS = "array<struct<seq: int, at: long, remove: long, insert: string>>"
_CUT = re.compile(r"(?<=\S)[ \n]")


def segments(text: str) -> list[str]:
    """The text in pieces of about ``SEGMENT`` characters or more, cut only where the tokenizer is sure to cut."""
    out, start = [], 0
    while len(text) - start > 2 * SEGMENT:
        found = _CUT.search(text, start + SEGMENT)
        if not found:
            break
        out.append(text[start: found.start()])
        start = found.start()
    if start < len(text):
        out.append(text[start:])
    return out


class Tree:
    """Sums of characters and tokens over segments, in an implicit binary tree: node k has the children 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        fill = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + fill, [0] * self.size + tokens + fill
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def stored(cls, chars: list[int], tokens: list[int]) -> Tree:
        """A tree from its arrays as stored."""
        tree = cls.__new__(cls)
        tree.size, tree.chars, tree.tokens = len(chars) // 2, chars, tokens
        return tree

    def leaf(self, at: int) -> tuple[int, int]:
        """The segment that holds the character, and where the segment starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def put(self, i: int, chars: int, tokens: int) -> None:
        k = i + self.size
        more_chars, more_tokens = chars - self.chars[k], tokens - self.tokens[k]
        while k and (more_chars or more_tokens):
            self.chars[k] += more_chars
            self.tokens[k] += more_tokens
            k //= 2

    def replaced(self, i: int, j: int, leaves: list[tuple[int, int]]) -> Tree:
        """Segments i to j become ``leaves``; the tree itself if they fit there, else one of other shape."""
        if len(leaves) <= j - i + 1:
            for k in range(i, j + 1):
                self.put(k, *(leaves[k - i] if k - i < len(leaves) else (0, 0)))
            return self
        own = list(zip(self.chars[self.size:], self.tokens[self.size:]))
        own = [x for x in own[:i] + leaves + own[j + 1:] if x[0]]
        return Tree([c for c, _ in own], [t for _, t in own])


def region_of(text: str, tree: Tree, at: int, remove: int, insert: str) -> tuple[int, int, int, int, str] | None:
    """What an edit makes of the segments it touches: the first and last of them, their place in the text, their new text."""
    n = len(text)
    at = min(max(at, 0), n)
    remove = min(max(remove, 0), n - at)
    if not remove and not insert:
        return None
    i, start = tree.leaf(min(at, n - 1)) if n else (0, 0)
    j, end = tree.leaf(min(at + max(remove, 1) - 1, n - 1)) if n else (0, 0)
    end += tree.chars[tree.size + j]
    region = text[start:at] + insert + text[at + remove: end]
    while True:
        if start and region and (region[0] not in " \n" or text[start - 1].isspace()):
            i, before = tree.leaf(start - 1)
            region, start = text[before:start] + region, before
        elif end < n and region and region[-1].isspace():
            j, after = tree.leaf(end)
            after += tree.chars[tree.size + j]
            region, end = region + text[end:after], after
        else:
            break
    return i, j, start, end, region


def edited(text: str, tree: Tree, at: int, remove: int, insert: str, count) -> tuple[str, Tree, int]:
    """Text and tree after one edit, and how many characters were encoded for it. ``count``: tokens of each of some texts."""
    return edited_together([(text, tree)], [(at, remove, insert)], count)[0]


def edited_together(docs: list[tuple[str, Tree]], edits: list[tuple[int, int, str]], count) -> list[tuple[str, Tree, int]]:
    """``edited`` for one edit each of several documents, whose tokens are counted together."""
    regions = [region_of(*doc, *edit) for doc, edit in zip(docs, edits)]
    parts = [segments(r[4]) if r else [] for r in regions]
    counts, out = iter(count([p for own in parts for p in own])), []
    for (text, tree), found, own in zip(docs, regions, parts):
        if not found:
            out.append((text, tree, 0))
            continue
        i, j, start, end, region = found
        tree = tree.replaced(i, j, [(len(p), next(counts)) for p in own])
        out.append((text[:start] + region + text[end:], tree, len(region)))
    return out


def _count(path: str, spaced: bool):
    return encoder(path, spaced, "<u4", KEPT).counts


def trees(docs: DataFrame, tokenizer: str, *, spaced: bool = True, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text, chars and tokens (the tree's sums, the root at 1), and the columns ``keep``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)

    def run(batches):
        count = _count(tokenizer, spaced)
        for batch in batches:
            texts, chars, tokens = batch.column("text").to_pylist(), [], []
            for a, b in batches_of_texts(texts):
                parts = [segments(t) for t in texts[a:b]]
                counts = iter(count([p for own in parts for p in own]))
                for own in parts:
                    tree = Tree([len(p) for p in own], [next(counts) for _ in own])
                    chars.append(tree.chars)
                    tokens.append(tree.tokens)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(chars, kind), pa.array(tokens, kind),
                 *(batch.column(c) for c in keep)], ["doc_id", "text", "chars", "tokens", *keep])
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, chars array<int>, tokens array<int>{kinds}")


def with_edits(docs: DataFrame, edits: DataFrame, *, id_col: str = "doc_id", edit_id_col: str = "doc_id") -> DataFrame:
    """The documents with a column ``edits``, from a table of single edits (id, seq, at, remove, insert)."""
    one = F.struct(F.col("seq").cast("int").alias("seq"), F.col("at").cast("long").alias("at"),
                   F.col("remove").cast("long").alias("remove"), F.col("insert").cast("string").alias("insert"))
    grouped = edits.filter(F.col(edit_id_col).isNotNull()).groupBy(F.col(edit_id_col).alias("_edit_id")).agg(
        F.array_sort(F.collect_list(one)).alias("edits"))
    return docs.drop("edits").join(grouped, docs[id_col] == F.col("_edit_id"), "left").drop("_edit_id")


def apply_edits(rows: DataFrame, tokenizer: str, *, spaced: bool = True) -> DataFrame:
    """The rows of ``trees`` with a column ``edits`` (as ``EDITS``, in order) after the edits.

    Adds n_edits, before (the count without them) and encoded (characters
    encoded again).
    """
    def run(batches):
        count = _count(tokenizer, spaced)
        for batch in batches:
            for a, b in batches_of_texts(batch.column("text").to_pylist()):
                part = batch.slice(a, b - a)
                texts, chars, tokens, edits = (part.column(c).to_pylist() for c in ("text", "chars", "tokens", "edits"))
                docs = [(text, Tree.stored(c, t)) for text, c, t in zip(texts, chars, tokens)]
                before, encoded = [tree.tokens[1] for _, tree in docs], [0] * len(docs)
                own = [i for i, e in enumerate(edits) if e]
                for k in count_up():  # the k-th edit of every document that has one
                    own = [i for i in own if len(edits[i]) > k]
                    if not own:
                        break
                    done = edited_together([docs[i] for i in own], [
                        (e["at"] or 0, e["remove"] or 0, e["insert"] or "") for e in (edits[i][k] for i in own)], count)
                    for i, (text, tree, some) in zip(own, done):
                        docs[i] = text, tree
                        encoded[i] += some
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([text for text, _ in docs], pa.string()),
                     pa.array([tree.chars for _, tree in docs], kind), pa.array([tree.tokens for _, tree in docs], kind),
                     pa.array([len(e or ()) for e in edits], pa.int32()), pa.array(before, pa.int64()),
                     pa.array(encoded, pa.int64())],
                    ["doc_id", "text", "chars", "tokens", "n_edits", "before", "encoded"])
    rows = rows.select("doc_id", "text", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, chars array<int>, tokens array<int>, n_edits int, "
                                "before long, encoded long")


def derived_edits(id_col: str = "doc_id", text_col: str = "text"):
    """A column of three edits that follow from the document: a removal, an insertion of its own words, a replacement."""
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")

    def place(k: int):
        return F.crc32(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(k))).cast("binary")) % (size + 1)

    def own(k: int, n: int):
        return F.substring(F.coalesce(F.col(text_col), F.lit("")), (place(k) + 1).cast("int"), F.lit(n))

    def edit(seq: int, remove: int, insert):
        return F.struct(F.lit(seq).alias("seq"), place(seq).alias("at"), F.lit(remove).cast("long").alias("remove"),
                        insert.alias("insert"))
    return F.array(edit(1, 70, F.lit("")), edit(2, 0, own(4, 90)), edit(3, 40, own(5, 25)))


def counts(rows: DataFrame) -> DataFrame:
    """Digest of ``apply_edits``' rows."""
    return rows.select(
        "doc_id", F.col("before").alias("n_tokens"), F.col("n_edits").cast("long").alias("n_edits"),
        F.get("tokens", F.lit(1)).cast("long").alias("edited_tokens"),
        F.get("chars", F.lit(1)).cast("long").alias("edited_chars"),
        F.crc32(F.col("text").cast("binary")).alias("edited_crc32"), F.col("encoded").alias("encoded_chars"))


