"""Nearest neighbours by additive quantisation.

Directions of vectors are sums of one codeword from each of several full-dimensional codebooks, learned on residuals
of a bounded sample and assigned by beam search. Queries meet codes in a grid of bounded blocks: in a
cell, a query's lookup tables (its inner products with all codewords) score every code, times the stored norm. How far a
vector lies from its code is stored too, and bounds what its code can be wrong by. So the exact scores of the first by code
set a bar, and every vector whose code and bound reach it is scored exactly, by inner products of the original vectors in double
precision: nothing that belongs to the nearest is lost, whatever the vectors are. Codes that fit badly only leave more to score. The best
of a cell go on, and of those the best of a query. Equal vectors are searched once, as a class, so that a vector with very many
copies costs one code and crowds nobody out.

No cells of a coarse partition are left out: on the given vectors, which fill their space evenly, the 64 best of 256
cells hold 0.76 of the nearest and 128 hold 0.93.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

SALTS = 64


class Quantizer:
    """`books`: codebooks x codewords x dimensions."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.norms = (self.books**2).sum(axis=2)
        self._cross: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def fit(cls, sample: np.ndarray, n_books: int, n_words: int, rounds: int, seed: int = 7) -> Quantizer:
        """Residual k-means, one codebook after the other; deterministic for a given sample."""
        rng = np.random.default_rng(seed)
        rest = sample.astype(np.float32).copy()
        n_words = min(n_words, len(rest))
        books = []
        for _ in range(n_books):
            words = rest[rng.choice(len(rest), n_words, replace=False)].copy()
            for turn in range(rounds + 1):
                nearest = (rest @ words.T * 2 - (words**2).sum(axis=1)).argmax(axis=1)
                if turn == rounds:
                    break
                sums = np.zeros_like(words)
                np.add.at(sums, nearest, rest)
                counts = np.bincount(nearest, minlength=n_words)
                used = counts > 0
                words[used] = sums[used] / counts[used, None]
                if not used.all():
                    words[~used] = rest[rng.choice(len(rest), int((~used).sum()))]
            books.append(words)
            rest -= words[nearest]
        return cls(np.array(books))

    def cross(self, a: int, b: int) -> np.ndarray:
        """Inner products of the codewords of two codebooks."""
        if (a, b) not in self._cross:
            self._cross[a, b] = self.books[a] @ self.books[b].T
        return self._cross[a, b]

    def encode(self, rows: np.ndarray, beam: int) -> np.ndarray:
        """Codes by beam search: the `beam` best partial sums are kept from codebook to codebook."""
        rows = rows.astype(np.float32)
        n, codes, error = len(rows), None, np.zeros((len(rows), 1), dtype=np.float32)
        for m in range(len(self.books)):
            cost = (self.norms[m] - 2 * rows @ self.books[m].T)[:, None, :] + error[:, :, None]
            for j in range(m):
                cost += 2 * self.cross(j, m)[codes[:, :, j]]
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(flat, best, axis=1)
            parent, word = best // cost.shape[2], best % cost.shape[2]
            before = np.zeros((n, keep, 0), dtype=np.int64) if codes is None else np.take_along_axis(codes, parent[:, :, None], axis=1)
            codes = np.concatenate([before, word[:, :, None]], axis=2)
        return codes[np.arange(n), error.argmin(axis=1)].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x codebooks x codewords."""
        return np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and the lengths (infinite, where they are beyond doubles)."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return x / lengths, (lengths * largest)[:, 0]


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: non-null ids and vectors that are not zero and have finite components only."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: class_id (its smallest id), v, members (its `keep` smallest ids)."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = Window.partitionBy("v", "_salt").orderBy("vec_id")
    few = salted.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= keep)
    return few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("members")).withColumn("class_id", F.col("members")[0])


def nearest(
    df: DataFrame,
    k: int = 20,
    every: int = 20,
    n_books: int = 16,
    n_words: int = 256,
    beam: int = 4,
    sample: int = 8192,
    rerank: int = 128,
    code_block: int = 8192,
    query_block: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest by inner product of every id divisible by `every`.

    A query is no neighbour of itself; equal scores go to the smaller id; fewer candidates than `k` give
    fewer rows. Null ids, and vectors that are null, zero, or hold null or non-finite components, take no
    part. Vectors of one length are searched among themselves, as others have no inner product with them. Repeated
    rows count once. An empty table gives an empty result; other columns are not read. The codebooks are learned on
    about `sample` distinct vectors; all rows are indexed. The `rerank` best of a cell by their codes set the bar that
    the bounds of all others are held against, so the result does not depend on it.
    """
    spark = df.sparkSession
    rows = usable_vectors(df, id_col, vector_col)
    classes = materialize(vector_classes(rows, k + 1), "vector-classes")
    found = None
    for size in sorted((r for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()), key=lambda r: r["d"]):
        of_size = F.size("v") == size["d"]
        queries = rows.where((F.col("vec_id") % every == 0) & of_size)
        some = _best_of_cells(classes.where(of_size), size["n"], queries, k + 1, n_books, n_words, beam, sample, rerank, code_block, query_block)
        found = some if found is None else found.unionAll(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    near = found.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k + 1).join(classes.select("class_id", "members"), "class_id")
    each = near.select("query_id", "score", F.explode("members").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best_of_cells(classes: DataFrame, n_classes: int, queries: DataFrame, keep: int, n_books: int, n_words: int, beam: int, sample: int, rerank: int, code_block: int, query_block: int) -> DataFrame:
    """query_id, class_id, score of the `keep` best classes of each cell; all vectors are of one length."""
    spark = classes.sparkSession
    spread = 1 << 30
    drawn = classes.where(F.pmod(F.xxhash64(F.lit(3), "class_id"), F.lit(spread)) < F.lit(float(spread) * sample / n_classes))
    vectors = sorted((r["class_id"], r["v"]) for r in drawn.select("class_id", "v").collect()) or [(r["class_id"], r["v"]) for r in classes.orderBy("class_id").limit(sample).collect()]
    quantizer = Quantizer.fit(directions(np.array([v for _, v in vectors]))[0], n_books, n_words, 6)
    sent = spark.sparkContext.broadcast(quantizer.books)

    def encode(batches):  # noqa: ANN001, ANN202
        quantizer = Quantizer(sent.value)
        sizes = np.sqrt(quantizer.norms.astype(float))
        for batch in batches:
            if len(batch):
                x = np.array(batch["v"].tolist())
                u, lengths = directions(x)
                codes = np.concatenate([quantizer.encode(u[i : i + 512], beam) for i in range(0, len(u), 512)])
                made = quantizer.decode(codes).astype(float)
                stretch = (u * made).sum(axis=1) / np.maximum((made * made).sum(axis=1), 1e-12)
                # What single precision may add is in the reach: a rounding for each sum and product of tables and codes.
                rounding = (x.shape[1] + len(sizes) + 8) * 2.0**-23 * np.abs(stretch) * sum(sizes[m][codes[:, m]] for m in range(len(sizes)))
                reach = np.linalg.norm(u - stretch[:, None] * made, axis=1) + rounding + 1e-9
                yield pd.DataFrame({"class_id": batch["class_id"], "codes": [c.tobytes() for c in codes], "stretch": stretch, "reach": reach, "norm": lengths, "v": [r.tobytes() for r in x]})

    coded = materialize(classes.select("class_id", "v").mapInPandas(encode, "class_id long, codes binary, stretch double, reach double, norm double, v binary"), "codes")
    n_code_blocks = -(-n_classes // code_block)
    n_query_blocks = max(1, -(-queries.count() // query_block))
    coded = coded.withColumn("code_block", F.pmod(F.xxhash64("class_id"), F.lit(n_code_blocks))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))
    )
    queries = queries.withColumn("query_block", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(n_query_blocks)).cast("int")).withColumn(
        "code_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_code_blocks - 1).cast("long")))
    )

    def cell(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(codes) and len(asked):
            quantizer = Quantizer(sent.value)
            code = np.frombuffer(b"".join(codes["codes"]), dtype=np.uint8).reshape(len(codes), -1)
            x = np.frombuffer(b"".join(codes["v"])).reshape(len(codes), -1)
            stretch, reach, norm, ids = (codes[c].to_numpy() for c in ("stretch", "reach", "norm", "class_id"))
            near = stretch.astype(np.float32)
            q, q_ids = np.array(asked["v"].tolist()), asked["vec_id"].to_numpy()
            unit = directions(q)[0]
            first, least = min(max(rerank, keep), len(code)), min(keep, len(code))
            with np.errstate(over="ignore", invalid="ignore"):
                for at in range(0, len(q), 64):
                    tables = quantizer.tables(unit[at : at + 64])
                    guess = np.zeros((len(tables), len(code)), dtype=np.float32)
                    for m in range(code.shape[1]):
                        guess += tables[:, m, :][:, code[:, m]]
                    guess *= near
                    who, rows = [], []
                    for i, told in enumerate(guess.astype(float)):
                        ahead = np.argpartition(-(told * norm), first - 1)[:first]
                        some = np.flatnonzero(~((told + reach) * norm < _bar(x[ahead] @ unit[at + i], norm[ahead], least)))
                        score = x[some] @ unit[at + i]
                        some = some[~(score + 1e-12 * norm[some] < _bar(score, norm[some], least))]
                        who.append(np.full(len(some), at + i))
                        rows.append(some)
                    found.append(_ranked(q, x, ids, np.concatenate(who), np.concatenate(rows), keep).assign(query_id=lambda r: q_ids[r["who"]]))
        return pd.concat(found)[["query_id", "class_id", "score"]] if found else pd.DataFrame({"query_id": [], "class_id": [], "score": []})

    keys = ["code_block", "query_block"]
    return coded.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(cell, "query_id long, class_id long, score double")


def _bar(scores: np.ndarray, norms: np.ndarray, least: int) -> float:
    """What `least` of the scores surely reach, roundings of their sums allowed for."""
    return np.partition(scores - 1e-12 * norms, len(scores) - least)[len(scores) - least]


def _ranked(q: np.ndarray, x: np.ndarray, ids: np.ndarray, who: np.ndarray, rows: np.ndarray, keep: int) -> pd.DataFrame:
    """who, class_id, score of the `keep` best of each query, ties to smaller ids; scores are summed in the order of the components, in bounded pieces."""
    score = np.zeros(len(rows))
    for at in range(0, len(rows), 65536):
        some = slice(at, at + 65536)
        for d in range(x.shape[1]):
            score[some] += q[who[some], d] * x[rows[some], d]
    found = pd.DataFrame({"who": who, "class_id": ids[rows], "score": score})
    found = found.sort_values(["who", "score", "class_id"], ascending=[True, False, True], na_position="first")
    return found[found.groupby("who").cumcount() < keep]
