"""Language ID by unigram piece models, summed over all segmentations of each word.

The pieces are a fixed public vocabulary; what is learned is each language's probability of each
piece, by expectation-maximisation over the words of a bounded sample of labelled documents. A word's
probability is the forward sum over all ways to cut it into pieces; a text's is the product over its
words. Logarithms of words are kept between texts, so the work of a text is a lookup for each word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_sample, held_out
from tidemark.llm.token_counts import SPACE, read_pieces

WORD = re.compile(r"[^\W\d_]+")
CHUNK = 48  # letters; longer runs are cut and every part counts
KEEP_WORDS = 150_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, each with a leading word mark; long runs are cut into parts."""
    found = WORD.findall((text or "").lower())
    if not all(map(str.isalpha, found)):  # numerals that are no decimal digits, as in "x²"
        found = [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]
    if any(len(w) > CHUNK for w in found):
        found = [w[i : i + CHUNK] for w in found for i in range(0, len(w), CHUNK)]
    return found


def vocabulary(path: str) -> set[str]:
    """Pieces made of letters, with or without the mark, in lower case."""
    return {p for p in read_pieces(path) if p.strip(SPACE) and WORD.fullmatch(p.removeprefix(SPACE)) and p == p.lower()}


def expected_pieces(words: dict[str, int], pieces: dict[str, float], longest: int) -> tuple[dict[str, float], float]:
    """Expected piece counts over all segmentations (forward-backward), and the log-likelihood."""
    counts: dict[str, float] = defaultdict(float)
    total = 0.0
    for word, n in words.items():
        marked = SPACE + word
        size = len(marked)
        arcs = []
        ahead = [0.0] * (size + 1)
        ahead[0] = 1.0
        for end in range(1, size + 1):
            for start in range(max(0, end - longest), end):
                p = pieces.get(marked[start:end])
                if p:
                    arcs.append((start, end, p))
                    ahead[end] += ahead[start] * p
        if ahead[size] <= 0:
            continue
        back = [0.0] * (size + 1)
        back[size] = 1.0
        for start, end, p in reversed(arcs):
            back[start] += p * back[end]
        scale = n / ahead[size]
        total += n * math.log(ahead[size])
        for start, end, p in arcs:
            counts[marked[start:end]] += scale * ahead[start] * p * back[end]
    return counts, total


def fit_pieces(words: dict[str, int], vocab: set[str], rounds: int) -> dict[str, float]:
    """Piece probabilities of one language."""
    longest = max(map(len, vocab), default=1)
    seen: Counter = Counter()
    for word, n in words.items():
        marked = SPACE + word
        for start in range(len(marked)):
            for end in range(start + 1, min(len(marked), start + longest) + 1):
                piece = marked[start:end]
                if end - start == 1 or piece in vocab:
                    seen[piece] += n
    whole = sum(seen.values())
    pieces = {p: n / whole for p, n in seen.items()}
    for _ in range(rounds):
        counts, _ = expected_pieces(words, pieces, longest)
        whole = sum(counts.values()) or 1.0
        pieces = {p: c / whole for p, c in counts.items() if c > 1e-4 or len(p) == 1}
    return pieces


class Scorer:
    """Logarithms of words under every language. `models`: language -> piece -> probability.

    New words are scored together, those of one length at a time: a polynomial hash names each
    substring, a collision-free table finds its piece, and the forward sums run over all words at once.
    """

    FLOOR = 1e-7  # of a letter that a language has not shown
    SLOTS = 22

    def __init__(self, models: dict[str, dict[str, float]]):
        self.langs = sorted(models)
        pieces = sorted({p for m in models.values() for p in m})
        self.longest = max(map(len, pieces), default=1)
        rows = np.zeros((len(pieces) + 1, len(self.langs)))
        for at, lang in enumerate(self.langs):
            rows[:-1, at] = [max(models[lang].get(p, 0.0), self.FLOOR if len(p) == 1 else 0.0) for p in pieces]
        self.rows = rows  # the last one: no piece
        for self.base in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 2000, 2):
            self.keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
            slots = self._slots(self.keys)
            if len(set(slots.tolist())) == len(pieces):
                break
        else:
            raise ValueError("no hash keeps the pieces apart")
        self.table = np.full(1 << self.SLOTS, len(pieces), dtype=np.int32)
        self.table[slots] = np.arange(len(pieces))
        self.keys = np.append(self.keys, np.uint64(0))
        self.numbers: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)))

    def _hash(self, text: str) -> int:
        value = 0
        for char in text:
            value = (value * self.base + ord(char) + 1) & (2**64 - 1)
        return value

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.SLOTS)

    def log_words(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        out = np.zeros((len(words), len(self.langs)))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        nothing, base = len(self.rows) - 1, np.uint64(self.base)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            joined = "".join(SPACE + words[i] for i in at)
            codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").reshape(len(at), size + 1).astype(np.uint64)
            whole = [np.zeros(len(at), dtype=np.uint64)]
            for k in range(size + 1):
                whole.append(whole[-1] * base + codes[:, k] + np.uint64(1))
            powers = [np.uint64(pow(self.base, k, 2**64)) for k in range(self.longest + 1)]
            sums = [np.ones((len(at), len(self.langs)))]
            for end in range(1, size + 2):
                total = np.zeros((len(at), len(self.langs)))
                for start in range(max(0, end - self.longest), end):
                    key = whole[end] - whole[start] * powers[end - start]
                    piece = self.table[self._slots(key)]
                    piece = np.where(self.keys[piece] == key, piece, nothing)
                    if start == end - 1:
                        total += sums[start] * np.maximum(self.rows[piece], self.FLOOR)
                    else:
                        hit = np.flatnonzero(piece != nothing)
                        if len(hit):
                            total[hit] += sums[start][hit] * self.rows[piece[hit]]
                sums.append(total)
            out[at] = np.log(np.maximum(sums[-1], 1e-300))
        return out

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text its best language and the posterior under equal priors; `und`, 0 without a letter."""
        found = [words_of(t) for t in texts] if self.langs else [[] for _ in texts]
        if len(self.numbers) > KEEP_WORDS:
            self.numbers, self.logs = {}, self.logs[:0]
        new = list({w for words in found for w in words if w not in self.numbers})
        self.numbers.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate([self.logs, self.log_words(new)])
        return [self._best(words) for words in found]

    def _best(self, words: list[str]) -> tuple[str, float]:
        if not words:
            return "und", 0.0
        ids = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        logs = self.logs[ids].sum(axis=0)
        best = int(logs.argmax())
        return self.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def in_portions(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in their order, about `chars` characters at a time."""
    portion, size = [], 0
    for text in texts:
        portion.append(text)
        size += len(text or "")
        if size > chars:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def fit(df: DataFrame, vocabulary_path: str, sample: int = 250, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[str, float]]:
    """Piece probabilities of each language, from about `sample` documents of each.

    Learns from rows that are not held out and have a language and a text; rows that repeat one count once. What
    the driver gets is bounded by the number of languages times the vocabulary.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    chosen = bounded_sample(rows.where(usable), "lang", ["doc_id", "text"], sample)
    texts = chosen.groupBy("lang", "doc_id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("lang", "text")

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        words = Counter(w for text in group["text"] for w in words_of(text))
        pieces = fit_pieces(words, vocabulary(vocabulary_path), rounds)
        return pd.DataFrame({"lang": key[0], "piece": list(pieces), "p": list(pieces.values())})

    found = texts.groupBy("lang").applyInPandas(learn, "lang string, piece string, p double").collect()
    models: dict[str, dict[str, float]] = {}
    for lang, piece, p in found:
        models.setdefault(lang, {})[piece] = p
    return models


def predict(df: DataFrame, models: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, and the columns in `carry`.

    A null text, an empty one and one without letters are `und` with score 0. Repeated rows give
    repeated rows; languages with equal scores are taken in alphabetical order; the whole text counts.
    """
    sent = df.sparkSession.sparkContext.broadcast(models)
    kept: dict[str, Scorer] = {}

    def label(texts: pd.Series) -> pd.DataFrame:
        if "scorer" not in kept:
            kept["scorer"] = Scorer(sent.value)
        found = [x for part in in_portions(texts.tolist()) for x in kept["scorer"].score(part)]
        return pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    label = F.pandas_udf(label, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    # Only the text goes to Python; as a nondeterministic call it is made once, whatever is filtered by its result.
    labelled = df.select(F.col(id_col).alias("doc_id"), *carry, label.asNondeterministic()(F.col(text_col)).alias("_label"))
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_label.lang_pred", "_label.score", *carry)


def language_id(df: DataFrame, vocabulary_path: str, sample: int = 250, rounds: int = 3) -> DataFrame:
    """Learn from the labelled rows of `df` and predict all of them."""
    return predict(df, fit(df, vocabulary_path, sample, rounds))
