"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded by what its characters and
words look like (letter case, marks, digits, repetition, word lengths); a hidden layer embeds it; gated
attention weighs the passages of a document, and the weighted embedding gives the score. All weights are
learned from document labels only, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import held_out

PASSAGE = 64  # words
LOWER, UPPER, DIGIT, SPACE_CHAR, MARK, BAR, STOP, OTHER = range(8)
FEATURES = 24


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, dtype=np.int64)
    for code in range(256):
        char = chr(code)
        if char.isspace():
            kinds[code] = SPACE_CHAR
        elif char.isdigit():
            kinds[code] = DIGIT
        elif char.isupper():
            kinds[code] = UPPER
        elif char.isalpha():
            kinds[code] = LOWER
        elif char == "|":
            kinds[code] = BAR
        elif char in ".,;:?'\"-()":
            kinds[code] = STOP
        else:
            kinds[code] = MARK
    return kinds


KINDS = _classes()


def encode(text: str | None) -> np.ndarray:
    """A row of features for each passage of a whole text; one row of zeros if it has no word."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = KINDS[np.minimum(codes, 255)]
    kinds = np.where(codes > 255, OTHER, kinds)
    names = np.fromiter(map(_NAMES.__getitem__, words), dtype=np.int64, count=len(words))
    if len(_NAMES) > 400_000:
        _NAMES.clear()

    firsts = np.arange(0, len(words), PASSAGE)
    ends = np.append(firsts[1:], len(words))
    n = (ends - firsts).astype(float)
    char_at = np.concatenate([[0], np.cumsum(lengths)])
    chars = (char_at[ends] - char_at[firsts]).astype(float)
    passage_of_char = np.repeat(np.arange(len(firsts)), chars.astype(int))
    by_kind = np.bincount(passage_of_char * 8 + kinds, minlength=8 * len(firsts)).reshape(-1, 8)

    passage = np.arange(len(words)) // PASSAGE
    same = lambda k: np.bincount(passage[k:][names[k:] == names[:-k]], minlength=len(firsts)) / n if len(names) > k else np.zeros(len(firsts))
    order = np.lexsort((names, passage))
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (names[order][1:] != names[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=len(firsts)) / n
    seen_first = np.zeros(len(words), dtype=bool)
    seen_first[np.unique(names, return_index=True)[1]] = True
    new_here = np.bincount(passage[seen_first], minlength=len(firsts)) / n
    mean = np.add.reduceat(lengths, firsts) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(lengths**2, firsts) / n - mean**2, 0))
    last_char = kinds[char_at[1:] - 1]
    first_char = kinds[char_at[:-1]]
    share = lambda mask: np.bincount(passage[mask], minlength=len(firsts)) / n
    rows = [
        *(by_kind / chars[:, None]).T,
        distinct,
        new_here,
        same(1),
        same(2),
        same(3),
        mean / 10,
        spread / 10,
        share(last_char == MARK),
        share(last_char == STOP),
        share(first_char == UPPER),
        share(lengths == 1),
        share(lengths > 15),
        np.log1p(n) / 5,
        np.full(len(firsts), np.log1p(len(words)) / 10),
        np.full(len(firsts), len(np.unique(names)) / len(words)),
        np.full(len(firsts), 1.0),
    ]
    return np.array(rows, dtype=np.float32).T


class _Names(dict):
    """Word -> a number that is the same in every process."""

    def __missing__(self, word: str) -> int:
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


_NAMES = _Names()


class GatedAttention:
    """h = tanh(W x); a ~ exp(w . (tanh(V h) * sigmoid(U h))); score = sigmoid(c . sum(a h) + b)."""

    NAMES = ("W", "V", "U", "w", "c", "b")

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        """Adam on the log loss; deterministic for given bags in a given order."""
        rng = np.random.default_rng(seed)
        rows = np.concatenate(bags).astype(float)
        mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3)
        scaled = [(bag - mean) / scale for bag in bags]
        size = rows.shape[1]
        shapes = {"W": (size, hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "b": ()}
        weights = {k: rng.normal(0, 0.3 / np.sqrt(max(1, np.prod(shape[:1]))) * 2, shape) if shape else np.array(0.0) for k, shape in shapes.items()}
        first = {k: np.zeros(v.shape) for k, v in weights.items()}
        second = {k: np.zeros(v.shape) for k, v in weights.items()}
        steps = 0
        for _ in range(epochs):
            order = rng.permutation(len(scaled))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                steps += 1
                gradient = cls._gradient(weights, [scaled[i] for i in chosen], labels[chosen])
                for k in cls.NAMES:
                    g = gradient[k] + decay * weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
        return cls(weights, mean, scale)

    @staticmethod
    def _forward(weights: dict[str, np.ndarray], rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple:
        h = np.tanh(rows @ weights["W"])
        t, s = np.tanh(h @ weights["V"]), 1 / (1 + np.exp(-(h @ weights["U"])))
        e = np.clip((t * s) @ weights["w"], -30, 30)
        x = np.exp(e)
        a = x / np.repeat(np.add.reduceat(x, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ weights["c"] + weights["b"], -30, 30)))
        return h, t, s, a, z, y

    @classmethod
    def _gradient(cls, weights: dict[str, np.ndarray], bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.concatenate(bags)
        h, t, s, a, z, y = cls._forward(weights, rows, starts, sizes)
        dy = (y - labels) / len(bags)
        dz = dy[:, None] * weights["c"]
        dz_row = np.repeat(dz, sizes, axis=0)
        da = (dz_row * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        gated = de[:, None] * weights["w"]
        dt, ds = gated * s * (1 - t * t), gated * t * s * (1 - s)
        dh = dz_row * a[:, None] + dt @ weights["V"].T + ds @ weights["U"].T
        dh = dh * (1 - h * h)
        return {"W": rows.T @ dh, "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dy, "b": dy.sum()}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return self._forward(self.weights, (np.concatenate(bags) - self.mean) / self.scale, starts, sizes)[-1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, label_col: str = "quality") -> GatedAttention | None:
    """Learn from at most `sample` labelled documents that are not held out; None without any.

    The sample is the `sample` smallest hashes of the labelled ids, with one text of each (the least, where rows
    repeat an id), so that the rows the driver gets and the broadcast ids are bounded by the parameter.
    """
    usable = F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"))
    ids = labels.where(usable).groupBy("doc_id").agg(F.max(label_col).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<float>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(t).ravel() for t in texts])

    one = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = one.select("doc_id", "label", features("text").alias("x")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.array(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return GatedAttention.fit(bags, np.array([float(r["label"]) for r in rows]))


def predict(docs: DataFrame, model: GatedAttention | None, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts are one empty passage and get the score the model gives to it; without a
    model every score is 0.5. Repeated rows give repeated rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            texts = batch["_text"].tolist()
            scores = [0.5] * len(texts)
            if model is not None:
                scores = [float(y) for at in range(0, len(texts), 200) for y in model.score([encode(t) for t in texts[at : at + 200]])]
            batch["score"] = scores
            batch["predicted"] = [int(s >= threshold) for s in scores]
            yield batch[["doc_id", "held_out", "score", "predicted"]]

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_text")).mapInPandas(label, schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, threshold: float = 0.3) -> DataFrame:
    """Learn from labelled documents and score all of them."""
    return predict(docs, fit(docs, labels, sample), threshold)
