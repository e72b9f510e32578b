"""Toxicity of whole texts by compression distance to a toxic and an ordinary zstandard dictionary.

A window is a lower-cased word, written ``TIMES`` times, so that one match
with a dictionary shows in its compressed length. The ordinary dictionary is
trained on windows of ordinary texts. The toxic one is trained on the windows
of toxic texts that ordinary texts hardly have, and is followed by the
ordinary one, so the two compressors differ in the toxic windows alone. A
window is toxic if the toxic dictionary saves at least a calibrated number of
bytes, and a document's score is a logistic function, fitted on labelled
texts, of how many and which share of its windows are.

Labels are learned from a bounded sample: at most about ``TOXIC_TEXTS`` and
``ORDINARY_TEXTS`` labelled texts by hash of the id. Rows whose crc32 of the
id as text leaves 1 by division by 3 are held out. Only the text is an input
of a score. A null text counts as empty and scores what a text without toxic
windows does. Without toxic or without ordinary labels every score is 0.
Repeated rows have a row each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMES = 3
TOXIC_TEXTS = 1500
ORDINARY_TEXTS = 4000
ORDINARY_BYTES = 65_536
TOXIC_BYTES = 16_384
ORDINARY_WINDOWS = 100_000
LEAST = 0.7
#: Weight of an ordinary text against a toxic one in the fit, at their shares among the labels.
ORDINARY_WEIGHT = 0.4
KEPT_WINDOWS = 800_000
_MARKS = b".,;:!?*#$%&\"'()[]<>-"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space, without marks at their ends."""
    found = [w.strip(_MARKS) for w in (text or "").lower().encode().split()]
    return [w for w in found if w]


def window(word: bytes) -> bytes:
    return (b" " + word) * TIMES


def _stems(word: bytes) -> set[bytes]:
    return {word[:n] for n in (4, 5, 6, 8) if n < len(word)} | {word[:8]}


def _dictionary(samples: list[bytes], size: int, complete: bool = False) -> bytes:
    """A zstandard dictionary trained on the samples; of too few, the samples themselves.

    With ``complete`` the most frequent samples that the training left out
    come before it.
    """
    try:
        trained = zstandard.train_dictionary(size * 3 // 4 if complete else size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        trained, complete = b"", True
    added, room = [], size - len(trained)
    for sample, _ in Counter(samples).most_common() if complete else ():
        if room < len(sample):
            break
        if sample not in trained:
            added.append(sample)
            room -= len(sample)
    return b"".join(reversed(added)) + trained


def telling_words(toxic: list[list[bytes]], ordinary: list[list[bytes]], times: float = 8.0) -> list[bytes]:
    """Words of toxic texts with a beginning that toxic texts hold ``times`` as often as ordinary ones, repeats included."""
    held = [Counter(), Counter()]
    for counts, texts in zip(held, (toxic, ordinary)):
        # Copies and most near copies share their words' least hash and count once.
        for text in {min(map(zlib.crc32, text), default=0): text for text in texts}.values():
            counts.update(set().union(*map(_stems, set(text))))
    least = max(3, len(toxic) // 60)
    telling = {s for s, n in held[0].items()
               if n >= least and n / len(toxic) >= times * (held[1][s] + 0.5) / len(ordinary)}
    return [w for text in toxic for w in text if not telling.isdisjoint(_stems(w))]


class Classifier:
    """Both dictionaries, the window threshold and the logistic weights."""

    def __init__(self, toxic_texts: list[str], ordinary_texts: list[str], odds: float = 1.0, seed: int = 9):
        """``odds``: how much rarer or more frequent ordinary texts are in the labels than in this sample, against toxic."""
        toxic, ordinary = [words(t) for t in toxic_texts], [words(t) for t in ordinary_texts]
        rng = np.random.default_rng(seed)
        plain = [w for text in ordinary for w in text]
        if len(plain) > ORDINARY_WINDOWS:
            plain = [plain[i] for i in rng.choice(len(plain), ORDINARY_WINDOWS, replace=False)]
        picked = telling_words(toxic, ordinary) or [w for text in toxic for w in text]
        self.ordinary = _dictionary([window(w) for w in plain], ORDINARY_BYTES)
        self.toxic = _dictionary([window(w) for w in picked], TOXIC_BYTES, complete=True)
        self.least, self.noise, self.weights = 1, 0.0, np.zeros(4)
        gains = [[self.gains(t) for t in texts] for texts in (toxic, ordinary)]
        y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
        weight = np.where(y == 1, 1.0, odds)
        best = math.inf
        for least in (1, 2, 3, 4, 5):  # the threshold whose fit has the least loss
            noise = (sum(v >= least for g in gains[1] for v in g) + 1) / (sum(map(len, gains[1])) + 1)
            x = np.array([self.features(g, least, noise) for side in gains for g in side])
            w, loss = _logistic(x, y, weight)
            if loss < best - 1e-9:
                best, self.least, self.noise, self.weights = loss, least, noise, w

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _ready(self) -> None:
        """Compressors live in the process that uses them."""
        if not hasattr(self, "_known"):
            how = zstandard.ZstdCompressionParameters(
                window_log=18, chain_log=18, hash_log=17, search_log=9, min_match=3, target_length=128,
                strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._sides = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=how)
                self._sides.append(zstandard.ZstdCompressor(compression_params=how, dict_data=held))
            self._known: dict[bytes, int] = {}

    def gains(self, text: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves on each window; windows seen before are not compressed again."""
        self._ready()
        known = self._known
        found = list(map(known.get, text))
        if None in found:
            if len(known) > KEPT_WINDOWS:
                known.clear()
            ordinary, toxic = (side.compress for side in self._sides)
            for i, gain in enumerate(found):
                if gain is None:
                    w = text[i]
                    gain = known.get(w)
                    if gain is None:
                        source = window(w)
                        gain = known[w] = len(ordinary(source)) - len(toxic(source))
                    found[i] = gain
        return found

    @staticmethod
    def features(gains: list[int], least: int, noise: float) -> tuple[float, ...]:
        """Toxic windows, their share, and their number against what ordinary texts of that length hold by chance."""
        n, size = sum(g >= least for g in gains), len(gains)
        return (1.0, math.log1p(n), math.log(n / max(size, 1) + 0.002) - math.log(0.002),
                math.log((n + 0.5) / (noise * size + 0.5)))

    def score(self, text: str | None) -> float:
        x = self.features(self.gains(words(text)), self.least, self.noise)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, x))))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and mean loss of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * np.r_[0, w[1:]]
        hessian = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def fitted(docs: DataFrame, labels: DataFrame, learn, *, id_col: str, text_col: str, label_id_col: str,
           label_col: str) -> Classifier | None:
    """A classifier from a bounded sample by hash of the labelled rows that ``learn`` lets through."""
    known = labels.select(F.col(label_id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(learn(F.col("label_id")) & F.col("label").isin(0, 1))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    caps = {1: TOXIC_TEXTS, 0: ORDINARY_TEXTS}
    share = F.when(F.col("label") == 1, min(1.0, caps[1] / counts[1])).otherwise(min(1.0, caps[0] / counts[0]))
    unit = F.shiftrightunsigned(F.xxhash64(F.col("label_id").cast("string"), F.lit(9)), 11) * F.lit(2.0**-53)
    picked = known.filter(unit < share).dropDuplicates(["label_id"])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # the sample is bounded
    rows = sorted((r.label, r.doc_id, r.text or "") for r in texts.select("label", "doc_id", "text").collect())
    toxic, ordinary = ([t for k, _, t in rows if k == label] for label in (1, 0))
    if not toxic or not ordinary:
        return None
    return Classifier(toxic, ordinary, odds=ORDINARY_WEIGHT * (counts[0] / len(ordinary)) / (counts[1] / len(toxic)))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 for a score of 0.7 or more)."""
    def held_out(i):
        return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 3 == 1, F.lit(False))

    model = fitted(docs, labels, lambda i: ~held_out(i), id_col=id_col, text_col=text_col,
                   label_id_col=label_id_col, label_col=label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            scores = [model.score(x) if model else 0.0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= LEAST) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
