"""Language-model scores of texts: the probability of a text summed over all ways to cut it into pieces.

The pieces and their first weights are those of a public subword vocabulary; their probabilities are fitted to the words of the corpus by
expectation-maximisation, with the vocabulary's weights as a prior. Pieces do not reach over words, so the sum over a text's
lattice is the product of its words' sums, times the probability of the end. Sums run over bytes, of which each is a piece of its
own, so every text has a probability. The words of the corpus are arcs of the lattice too, from a word's start to its end: an arc weighs the
word's count less a discount (estimated from the words seen once and twice), and what all arcs give up weighs the segmentations,
so the probabilities of all texts add up to one. The pieces are fitted to the distinct words, as it is new words that they are for.

Beside it stands the plain unigram of words. Words whose share of the corpus is at least one in `FREQUENT` are as few as that
and go to every task; a document's other words meet their counts and scores, which are made once for each distinct word, in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.token_counts import SPACE, read_pieces

MARK = b" "  # no word holds one
END = b""  # the end of a text, as a token
FREQUENT, FREQUENT_BYTES = 100_000, 64
LONG = 64  # bytes; longer words are summed one at a time
SLOTS = 22
SMOOTHING = 0.1


def words_of(text: bytes | None) -> list[bytes]:
    """Runs without white space of ASCII, A to Z in lower case."""
    return (text or b"").lower().split()


def prior_pieces(path: str) -> dict[bytes, float]:
    """Pieces as bytes, words' first ones with the mark, and their shares by the vocabulary's own weights.

    The file's scores are 0, -1, -2 and so on, the ranks of its merges; a share falls with the rank as 1 / rank (Zipf). Every byte is a piece, those that the file
    does not rank as the last. Pieces with capitals, or white space inside, fit no word.
    """
    found: dict[bytes, float] = {}
    for piece, score in read_pieces(path).items():
        raw = piece.removeprefix(SPACE).encode()
        if raw and SPACE not in piece.removeprefix(SPACE) and raw == raw.lower() and raw.split() == [raw]:
            found.setdefault((MARK if piece.startswith(SPACE) else b"") + raw, 1.0 / (1.0 - score))
    least = min(found.values(), default=1.0)
    for byte in range(256):
        found.setdefault(bytes([byte]), least)
    whole = sum(found.values())
    return {p: w / whole for p, w in found.items()}


class Lattice:
    """Sums over all segmentations. `pieces`: distinct strings of bytes; `logs`: their natural logarithms."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.pieces, self.logs = pieces, np.append(logs, -np.inf)
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.base = 0x9E3779B97F4A7C15
        self.keys = np.array([self._hash(p) for p in pieces] + [0], dtype=np.uint64)
        self.tables: list[np.ndarray] = []  # pieces by slot; those that find theirs taken go to the next table
        left = np.arange(len(pieces))
        while len(left):
            _, first = np.unique(self._slots(self.keys[left]), return_index=True)
            table = np.full(1 << SLOTS, len(pieces), dtype=np.int32)
            table[self._slots(self.keys[left[first]])] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _hash(self, piece: bytes) -> int:
        value = 0
        for byte in piece:
            value = (value * self.base + byte + 1) & (2**64 - 1)
        return value

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the pieces with these hashes, or the number behind the last."""
        slots, nothing = self._slots(keys), len(self.pieces)
        found = np.full(len(keys), nothing, dtype=np.int32)
        for table in self.tables:
            piece = table[slots]
            found = np.where(self.keys[piece] == keys, piece, found)
        return found

    def _arcs(self, words: list[bytes]) -> tuple[int, dict[tuple[int, int], np.ndarray]]:
        """Length, and for (start, end) the pieces of words of one length, the mark included."""
        codes = np.frombuffer(b"".join(MARK + w for w in words), dtype=np.uint8).reshape(len(words), -1).astype(np.uint64)
        size = codes.shape[1]
        base, whole = np.uint64(self.base), [np.zeros(len(words), dtype=np.uint64)]
        for k in range(size):
            whole.append(whole[-1] * base + codes[:, k] + np.uint64(1))
        powers = [np.uint64(pow(self.base, k, 2**64)) for k in range(self.longest + 1)]
        arcs = {}
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self._find(whole[end] - whole[start] * powers[end - start])
                if (piece < len(self.pieces)).any():
                    arcs[start, end] = piece
        return size, arcs

    def _forward(self, n: int, size: int, arcs: dict[tuple[int, int], np.ndarray]) -> list[np.ndarray]:
        sums = [np.zeros(n)]
        for end in range(1, size + 1):
            some = np.array([sums[start] + self.logs[arcs[start, end]] for start in range(max(0, end - self.longest), end) if (start, end) in arcs])
            sums.append(_log_sum(some))
        return sums

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """The natural logarithm of each word's sum; words of one length are summed together."""
        out, sizes = np.zeros(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size > LONG:
                out[at] = [self._long(words[i])[0][-1] for i in at]
                continue
            for i in range(0, len(at), 20_000):
                own = at[i : i + 20_000]
                length, arcs = self._arcs([words[j] for j in own])
                out[own] = self._forward(len(own), length, arcs)[-1]
        return out

    def _long(self, word: bytes, back: bool = False) -> tuple[list[float], list[float]]:
        """Logarithms of the sums up to each place, and from it to the end if `back`."""
        marked = MARK + word
        ahead = [0.0] + [-math.inf] * len(marked)
        for end in range(1, len(marked) + 1):
            ahead[end] = _log_sum_of([ahead[start] + self.logs[i] for start in range(max(0, end - self.longest), end) if (i := self.number.get(marked[start:end])) is not None])
        behind = [-math.inf] * len(marked) + [0.0]
        for start in range(len(marked) - 1, -1, -1) if back else ():
            behind[start] = _log_sum_of([behind[end] + self.logs[i] for end in range(start + 1, min(len(marked), start + self.longest) + 1) if (i := self.number.get(marked[start:end])) is not None])
        return ahead, behind

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of the words (forward and backward)."""
        total = np.zeros(len(self.pieces) + 1)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size > LONG:
                for i in at:
                    self._expected_long(words[i], counts[i], total)
                continue
            for i in range(0, len(at), 20_000):
                own = at[i : i + 20_000]
                length, arcs = self._arcs([words[j] for j in own])
                ahead, behind = self._forward(len(own), length, arcs), [None] * length + [np.zeros(len(own))]
                for start in range(length - 1, -1, -1):
                    some = [behind[end] + self.logs[arcs[start, end]] for end in range(start + 1, min(length, start + self.longest) + 1) if (start, end) in arcs]
                    behind[start] = _log_sum(np.array(some)) if some else np.full(len(own), -np.inf)
                shares = [np.exp(ahead[start] + self.logs[piece] + behind[end] - ahead[-1]) * counts[own] for (start, end), piece in arcs.items()]
                total += np.bincount(np.concatenate(list(arcs.values())), weights=np.concatenate(shares), minlength=len(total))
        return total[:-1]

    def _expected_long(self, word: bytes, n: float, total: np.ndarray) -> None:
        marked, (ahead, behind) = MARK + word, self._long(word, True)
        for start in range(len(marked)):
            for end in range(start + 1, min(len(marked), start + self.longest) + 1):
                i = self.number.get(marked[start:end])
                if i is not None:
                    total[i] += n * math.exp(ahead[start] + self.logs[i] + behind[end] - ahead[-1])


def _log_sum(rows: np.ndarray) -> np.ndarray:
    top = rows.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(rows - safe).sum(axis=0))


def _log_sum_of(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def held_out_tenth(doc_id: Column) -> Column:
    """True for the tenth of documents that is never learned from, and for those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n of (text, held_out): how often a word stands in the rows that are learned from, 0 for words of the others only.

    The end counts once for each row. Tasks count by batch before anything is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            found: Counter = Counter()
            for text, other in zip(batch["text"], batch["held_out"], strict=True):
                if other:
                    found.update(dict.fromkeys(words_of(text), 0))
                    found[END] += 0
                else:
                    found.update(words_of(text))
                    found[END] += 1
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    return texts.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pd.DataFrame], rows: int = 50_000, size: int = 4_000_000) -> Iterator[list[bytes]]:
    """Words of several batches together, so that many of one length are summed at once."""
    held, length = [], 0
    for batch in batches:
        for word in batch["word"]:
            held.append(word)
            length += len(word)
            if len(held) >= rows or length >= size:
                yield held
                held, length = [], 0
    if held:
        yield held


def fit_pieces(counts: DataFrame, path: str, rounds: int, prior: float) -> tuple[list[bytes], np.ndarray]:
    """The pieces and the natural logarithms of their probabilities, of which the last is the end's.

    A round is one job over the distinct words, each of weight one, the end too; the driver gets one number for each piece of the vocabulary.
    """
    spark = counts.sparkSession
    shares = prior_pieces(path)
    pieces = list(shares)
    base = np.array([shares[p] for p in pieces] + [1.0 / len(pieces)])
    logs = np.log(base / base.sum())
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logs[:-1])

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(pieces, sent.value), np.zeros(len(pieces))  # noqa: B023
            for words in _gathered(batches):
                total += lattice.expected(words, np.ones(len(words)))
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": used, "x": total[used]})

        found = counts.where((F.col("word") != F.lit(END)) & (F.col("n") > 0)).select("word").mapInPandas(expect, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
        total = prior * base / base.sum()
        total[-1] += 1
        for r in found:
            total[r["piece"]] += r["x"]
        logs = np.log(total / total.sum())
    return pieces, logs


def word_scores(counts: DataFrame, pieces: list[bytes], logs: np.ndarray) -> DataFrame:
    """word, n, segmented: the natural logarithm of the sum over the word's segmentations, made once for each distinct word."""
    sent = counts.sparkSession.sparkContext.broadcast(logs)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, end = Lattice(pieces, sent.value[:-1]), float(sent.value[-1])
        for batch in filter(len, batches):
            words = batch["word"].tolist()
            found = lattice.log_words([w or MARK for w in words])
            yield pd.DataFrame({"word": words, "n": batch["n"], "segmented": [x if w else end for w, x in zip(words, found, strict=True)]})

    return counts.mapInPandas(score, "word binary, n long, segmented double")


def score_texts(df: DataFrame, path: str, rounds: int = 3, prior: float = 1000.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. Whole texts count, of any length; repeated rows count each and give repeated rows; rows
    without an id are scored and not learned from. Without a row to learn from, or with an empty table, the word
    model has smoothing only and the pieces their prior. Other columns are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = df.select(F.col(id_col).alias("doc_id"), text).withColumn("held_out", held_out_tenth(F.col("doc_id")))
    counts = materialize(word_counts(rows.select("text", "held_out")), "word-counts")
    n = F.col("n")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(n > 0).alias("v"), F.count_if(n == 1).alias("once"), F.count_if(n == 2).alias("twice")).first()
    n_train, below = sums["n"], sums["n"] + SMOOTHING * (sums["v"] + 1)
    discount = sums["once"] / (sums["once"] + 2 * sums["twice"]) if sums["once"] and sums["twice"] else 0.5
    given_up = discount * sums["v"] / n_train if n_train else 1.0  # the share of the segmentations
    pieces, logs = fit_pieces(counts, path, rounds, prior)
    arc = F.greatest(n - discount, F.lit(0.0)) / max(n_train, 1)
    # Where no arc is, in logarithms: the sum over the segmentations of a very long word is no number.
    score = F.when(arc > 0, F.log10(arc + F.lit(given_up) * F.exp("segmented"))).otherwise(math.log10(given_up) + F.col("segmented") / math.log(10))
    scored = word_scores(counts, pieces, logs).select("word", "n", F.log10((n + SMOOTHING) / F.lit(below)).alias("base"), score.alias("score"))
    scored = materialize(scored, "word-scores")
    frequent = (n > 0) & (n * FREQUENT >= n_train) & (F.octet_length("word") <= FREQUENT_BYTES)
    few = {bytes(r["word"]): (r["base"], r["score"]) for r in scored.where(frequent).collect()}  # FREQUENT words of FREQUENT_BYTES at most
    sent = spark.sparkContext.broadcast(few)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            at, size, sizes = 0, 0, batch["text"].map(len).tolist()
            for i, more in enumerate(sizes):  # some million bytes at a time
                size += more
                if size > 2_000_000 or i == len(sizes) - 1:
                    yield _counted(batch[at : i + 1], sent.value)
                    at, size = i + 1, 0

    schema = "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<int>"
    own = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")
    done = materialize(own.mapInPandas(count, schema), "counted-texts")
    pairs = done.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = pairs.join(scored.where(~frequent), "word")
    total = lambda c: F.sum(F.col("times") * F.col(c))
    rest = met.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"), total("base").alias("base_score"), total("score").alias("score"))
    none = {c: F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("doc_id", "held_out", "n_tokens")}
    both = done.select("row", *none, "n_known", "base_score", "score").unionByName(rest.select("row", *none.values(), "n_known", "base_score", "score"))
    whole = both.groupBy("row").agg(*(F.max(c).alias(c) for c in none), *(F.sum(c).alias(c) for c in ("n_known", "base_score", "score")))
    return whole.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _counted(batch: pd.DataFrame, few: dict[bytes, tuple[float, float]]) -> pd.DataFrame:
    """What a task knows of its texts, and their other words with how often they stand in each text."""
    texts = [Counter(words_of(t)) for t in batch["text"]]
    for words in texts:
        words[END] = 1
    known = [[(n, few[w]) for w, n in words.items() if w in few] for words in texts]
    rare = [{w: n for w, n in words.items() if w not in few} for words in texts]
    out = batch[["row", "doc_id", "held_out"]].copy()
    out["n_tokens"] = [words.total() for words in texts]
    out["n_known"] = [sum(n for n, _ in some) for some in known]
    out["base_score"] = [math.fsum(n * x[0] for n, x in some) for some in known]
    out["score"] = [math.fsum(n * x[1] for n, x in some) for some in known]
    out["words"] = [list(some) for some in rare]
    out["times"] = [list(some.values()) for some in rare]
    return out
