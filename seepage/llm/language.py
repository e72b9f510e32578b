"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text: one layer of gated units reads the
bytes forwards, one backwards, and a linear layer over both states gives the
position's probabilities. A document's probabilities are the mean over its
positions. Texts are read in windows of ``SPAN`` bytes, from the first to the
last, so that long texts cost memory by the window; every byte is in exactly
one window. Training is backpropagation through time in numpy on windows of a
bounded sample of labelled texts: at most ``PER_LABEL`` texts a label and
``WINDOWS`` windows each.

A null text or one without letters is ``und`` with score 0. Without any
labelled text every other text is ``und`` too. Only the text is an input of a
prediction. Repeated rows have a row each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SPAN = 128
HIDDEN = 8
#: Bounds of the training sample.
PER_LABEL = 600
WINDOWS = 6
TRAIN_SPAN = 64
STEPS = 260
BATCH = 192
PAD = 256


class Network:
    """Parameters: for each direction the bytes' input table, the recurrent matrix, and the output layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden, k = labels, hidden, len(labels)
        self.p = {}
        for d in "fb":
            self.p[f"table_{d}"] = rng.normal(0, 0.4, (3 * hidden, 257)).astype(np.float32)
            self.p[f"own_{d}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
            self.p[f"out_{d}"] = rng.normal(0, hidden**-0.5, (k, hidden)).astype(np.float32)
        self.p["bias"] = np.zeros((k, 1), np.float32)
        self.hold_pads()

    def hold_pads(self) -> None:
        """Beyond a text's end the update gate keeps the state as it is."""
        for d in "fb":
            table = self.p[f"table_{d}"]
            table[:, PAD] = 0
            table[: self.hidden, PAD] = 30

    def read(self, x: np.ndarray, d: str, keep: bool = False):
        """States after each position of x (positions, windows), in the direction's own order; with ``keep`` the
        gates too, for training."""
        hid, (steps, n) = self.hidden, x.shape
        table, own = self.p[f"table_{d}"], self.p[f"own_{d}"]
        h = np.zeros((hid, n), np.float32)
        states, gates = np.empty((steps, hid, n), np.float32), []
        g, m = np.empty((3 * hid, n), np.float32), np.empty((3 * hid, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(own, h, out=m)
            zr = g[: 2 * hid]
            zr += m[: 2 * hid]
            zr *= 0.5
            np.tanh(zr, out=zr)  # the logistic function by tanh
            zr *= 0.5
            zr += 0.5
            new = g[2 * hid:]
            if keep:
                side = m[2 * hid:].copy()
            m[2 * hid:] *= zr[hid:]
            new += m[2 * hid:]
            np.tanh(new, out=new)
            if keep:
                gates.append((t, h.copy(), zr[:hid].copy(), zr[hid:].copy(), new.copy(), side))
            h -= new
            h *= zr[:hid]
            h += new
            states[t] = h
        return (states, gates) if keep else states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (positions, labels, windows) of windows of bytes (positions, windows)."""
        out = np.matmul(self.p["out_f"], self.read(x, "f"))
        out += np.matmul(self.p["out_b"], self.read(x, "b"))
        out += self.p["bias"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the positions that hold text; y is the label of each window."""
        hid = self.hidden
        kept = {d: self.read(x, d, keep=True) for d in "fb"}
        out = sum(np.matmul(self.p[f"out_{d}"], kept[d][0]) for d in "fb") + self.p["bias"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        there = (x != PAD)[:, None, :]
        out[:, y, np.arange(len(y))] -= 1
        out *= there / np.float32(max(1, there.sum()))
        grad = {"bias": out.sum(axis=(0, 2))[:, None]}
        for d in "fb":
            states, gates = kept[d]
            grad[f"out_{d}"] = np.einsum("tkn,thn->kh", out, states, optimize=True)
            at_states = np.matmul(self.p[f"out_{d}"].T, out)
            table, own = np.zeros_like(self.p[f"table_{d}"]), np.zeros_like(self.p[f"own_{d}"])
            back = np.zeros((hid, x.shape[1]), np.float32)
            for t, before, z, r, new, side in reversed(gates):
                back = back + at_states[t]
                d_new = back * (1 - z) * (1 - new * new)
                d_z = back * (before - new) * z * (1 - z)
                d_r = d_new * side * r * (1 - r)
                through = np.concatenate([d_z, d_r, d_new * r])
                own += through @ before.T
                inputs = np.concatenate([d_z, d_r, d_new])
                for row, values in zip(table, inputs):
                    row += np.bincount(x[t], values, 257).astype(np.float32)
                back = back * z + self.p[f"own_{d}"].T @ through
            grad[f"table_{d}"], grad[f"own_{d}"] = table, own
        return grad


def train(labels: list[str], windows: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on random batches of windows (windows, positions) with labels y, each label as likely as the others."""
    net, rng = Network(labels), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    of = [np.flatnonzero(y == k) for k in range(len(labels))]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(0, len(labels), BATCH)])
        rate = 0.02 * (1 - (step - 1) / steps) + 0.0005
        for name, g in net.gradients(np.ascontiguousarray(windows[pick].T), y[pick]).items():
            g = np.clip(g, -1, 1)
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            net.p[name] -= (rate * (first[name] / (1 - 0.9**step))
                            / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        net.hold_pads()
    return net


def training_windows(docs: DataFrame, learn, *, id_col: str, text_col: str, label_col: str):
    """Labels, windows and each window's label, from a sample by hash of at most about ``PER_LABEL`` texts a label."""
    rows = docs.filter(learn & F.col(label_col).isNotNull() & (F.length(F.col(text_col)) > 0)).select(
        F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.lit(8)).alias("draw"),
        F.col(text_col).alias("text"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # a row for each language
    labels = sorted(counts)
    if not labels:
        return [], np.zeros((0, TRAIN_SPAN), np.int64), np.zeros(0, np.int64)
    share = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, PER_LABEL / counts[k])))])
    unit = F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53)
    sample = rows.filter(unit < F.element_at(share, F.col("label"))).select("label", "draw", "text")

    def cut(batches):
        for batch in batches:
            names, found = [], []
            for label, draw, text in zip(*(batch.column(c).to_pylist() for c in ("label", "draw", "text"))):
                data = text.encode()
                rng = np.random.default_rng(draw & 0xFFFFFFFF)
                for a in rng.integers(0, max(1, len(data) - TRAIN_SPAN + 1), WINDOWS).tolist():
                    names.append(label)
                    found.append(data[a: a + TRAIN_SPAN])
            yield pa.RecordBatch.from_pydict({"label": pa.array(names, pa.string()), "window": pa.array(found, pa.binary())})
    held = sorted((r.label, bytes(r.window)) for r in sample.mapInArrow(cut, "label string, window binary").collect())
    windows = np.full((len(held), TRAIN_SPAN), PAD, np.int64)
    for i, (_, data) in enumerate(held):
        windows[i, : len(data)] = np.frombuffer(data, np.uint8)
    place = {k: i for i, k in enumerate(labels)}
    return labels, windows, np.array([place[k] for k, _ in held], np.int64)


def pooled(net: Network, texts: list[bytes], most: int = 2048) -> np.ndarray:
    """Mean probabilities over all bytes of each text (texts, labels)."""
    sums = np.zeros((len(texts), len(net.labels)))
    sizes = np.array([len(x) for x in texts], np.int64)
    parts = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(texts)), parts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    for a in range(0, len(owner), most):
        own, at = owner[a: a + most], index[a: a + most]
        x = np.full((len(own), SPAN), PAD, np.int64)
        for i, (o, k) in enumerate(zip(own.tolist(), at.tolist())):
            piece = texts[o][k * SPAN: (k + 1) * SPAN]
            x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        x = np.ascontiguousarray(x.T)
        there = (x != PAD)[:, None, :]
        np.add.at(sums, own, (net.probabilities(x) * there).sum(axis=0).T)
    return sums / np.maximum(sizes, 1)[:, None]


def _told(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each text; texts without letters are of unknown language."""
    texts = [(x or "") for x in texts]
    known = [i for i, x in enumerate(texts) if net and any(map(str.isalpha, x))]
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for a in range(0, len(known), 256):
        own = known[a: a + 256]
        found = pooled(net, [texts[i].encode() for i in own])
        for i, k, s in zip(own, found.argmax(axis=1), found.max(axis=1)):
            labels[i], scores[i] = net.labels[k], float(min(1.0, s))
    return labels, scores


def _predict(net: Network | None):
    def run(batches):
        for batch in batches:
            labels, scores = _told(net, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(labels, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def _accept(net: Network | None, least: float, text_col: str):
    def run(batches):
        for batch in batches:
            labels, scores = _told(net, batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(labels, scores)], pa.bool_()))
    return run


def _trained(docs: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[Network | None, Column]:
    """The network (none without labels) and the column that tells which rows were held out of its training."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels, windows, y = training_windows(docs, ~held_out, id_col=id_col, text_col=text_col, label_col=label_col)
    return (train(labels, windows, y) if labels else None), held_out


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Rows whose crc32 of the id as text leaves 2 by division by 4 are held out
    of the training; a null id is not held out.
    """
    net, held_out = _trained(docs, id_col=id_col, text_col=text_col, label_col=label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.35, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "lang") -> DataFrame:
    """The documents whose language is told with a pooled probability of ``least`` or more, with all their columns.

    Each row is decided by its own text, whatever its id.
    """
    net, _ = _trained(docs, id_col=id_col, text_col=text_col, label_col=label_col)
    return docs.mapInArrow(_accept(net, least, text_col), docs.schema)
