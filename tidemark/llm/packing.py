"""Packing documents into fixed-size sequences by the linear grouping scheme.

Tokens are made where the texts are; only (document, piece, length) travels. The number of distinct
lengths is bounded by the sequence size, so the plan is made from the histogram of lengths:

1. large pieces (more than a third, or a half, of a sequence) are sorted by length and cut into groups of equal
   cardinality; each is rounded up to the longest of its group;
2. the few rounded sizes are packed by column generation over configurations (a linear programme whose
   pricing step is a knapsack), rounded down; what the fractions leave joins step 4;
3. the actual pieces take the places of the rounded ones, which leaves the true free space;
4. the left-over and the small pieces go best fit, longest first, into the free space.

The plan is made with both bounds of "large", and the one that uses fewer sequences is taken.

A plan is a list of runs: "pieces of this length with ranks a..b go to sequences s.., at this offset".
Pieces get their ranks by counts over hash buckets, so that no length, however frequent, meets in one
task, and find their run by a join on the length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

KEEP_WORDS = 400_000
RANK_BUCKET = 20_000
RANK_PART = 1 << 14

# Texts of these characters only are split by the pattern below just as the tokenizer splits them.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]|<\\|")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    """Token ids of whole texts as little-endian bytes; ids of words are kept between texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(self.model.get_vocab_size(), dtype=bool)  # tokens that end a word
        for token, number in self.model.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1  # every word ends in a token of its own
        self.known.update(zip(words, [x.tobytes() for x in np.split(ids, cuts[:-1])], strict=True))

    def ids(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return self._encode([text])[0]
        words = _WORDS.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > KEEP_WORDS:
                self.known = {}
            self.learn([w for w in set(words) if w not in self.known])
            return b"".join(map(self.known.__getitem__, words))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One a worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
    ]
)


def tokenized_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of at most `capacity` tokens; a null text is an empty one."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["_text"], strict=True):
                ids = words.ids(text or "") + end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, number, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=_PIECES.names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return source.mapInPandas(cut, _PIECES)


def _grouped(histogram: dict[int, int], large: int, groups: int) -> tuple[list[int], list[int], dict[int, list[list[int]]]]:
    """Sizes and numbers of the equal-cardinality groups, and the actual lengths in each."""
    lengths = sorted((x for x in histogram if x > large), reverse=True)
    share = -(-sum(histogram[x] for x in lengths) // max(1, groups))
    sizes: list[int] = []
    numbers: list[int] = []
    members: dict[int, list[list[int]]] = {}
    for length in lengths:
        left = histogram[length]
        while left:
            if not sizes or numbers[-1] == share:
                sizes.append(length)
                numbers.append(0)
                members[len(sizes) - 1] = []
            take = min(left, share - numbers[-1])
            numbers[-1] += take
            members[len(sizes) - 1].append([length, take])
            left -= take
    return sizes, numbers, members


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth, by a knapsack over the number of pieces."""
    most = capacity // int(sizes.min())
    value = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        better, pick = value.copy(), np.full(capacity + 1, -1)
        for g, (size, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
            if w > 0:
                moved = value[: capacity + 1 - size] + w
                wins = moved > better[size:] + 1e-12
                better[size:][wins] = moved[wins]
                pick[size:][wins] = g
        picks.append(pick)
        if np.array_equal(better, value):
            break
        value = better
    counts, room = np.zeros(len(sizes), dtype=int), capacity
    best = float(value[capacity])
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return best, counts


def configurations(sizes: list[int], numbers: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size in a sequence, number of such sequences), by column generation."""
    if not sizes:
        return []
    size, need = np.array(sizes), np.array(numbers, dtype=float)
    basis = np.diag((capacity // size).astype(float))
    amounts = np.linalg.solve(basis, need)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(size)))
        best, counts = _best_configuration(size, worth, capacity)
        if best <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, counts.astype(float))
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        amounts = np.maximum(amounts - ratio[out] * step, 0)
        amounts[out] = ratio[out]
        basis[:, out] = counts
    return [(basis[:, i].astype(int), int(amounts[i] + 1e-6)) for i in range(len(size)) if amounts[i] + 1e-6 >= 1]


def plan(histogram: dict[int, int], capacity: int, groups: int = 240, large: int | None = None) -> tuple[list[tuple], int]:
    """Runs (length, first rank, pieces, first sequence, pieces in a sequence, offset), and the sequences used.

    Deterministic; its size depends on `capacity` and `groups`, not on the number of pieces. A run of a
    length holds `pieces` ranks; rank first + k is in sequence first_sequence + k // in_a_sequence.
    """
    large = capacity // 3 if large is None else large
    left = {x: n for x, n in histogram.items() if n}
    given: dict[int, int] = defaultdict(int)
    runs: list[tuple] = []
    room: dict[int, list[list[int]]] = defaultdict(list)  # free space -> [first sequence, number]
    used = 0

    def place(length: int, number: int, first: int, each: int, offset: int) -> None:
        runs.append((length, given[length], number, first, each, offset))
        given[length] += number
        left[length] -= number

    whole = left.get(capacity, 0)
    if whole:
        place(capacity, whole, 0, 1, 0)
        used = whole
    sizes, numbers, members = _grouped({x: n for x, n in left.items() if x < capacity and n}, large, groups)
    for counts, number in configurations(sizes, numbers, capacity):
        slots = [g for g, k in enumerate(counts) for _ in range(k)]
        number = min([number, *(sum(n for _, n in members[g]) // k for g, k in enumerate(counts) if k)])
        filled: list[list[list[int]]] = []
        for g in slots:  # actual pieces, longest first, take the places of this slot
            need, parts = number, []
            while need:
                length, n = members[g][0]
                take = min(need, n)
                parts.append([length, take])
                need -= take
                members[g][0][1] -= take
                if not members[g][0][1]:
                    members[g].pop(0)
            filled.append(parts)
        done = 0
        while done < number:  # stretches of sequences that hold the same lengths
            stretch, offset = min(parts[0][1] for parts in filled), 0
            for parts in filled:
                place(parts[0][0], stretch, used + done, 1, offset)
                offset += parts[0][0]
                parts[0][1] -= stretch
                if not parts[0][1]:
                    parts.pop(0)
            room[capacity - offset].append([used + done, stretch])
            done += stretch
        used += number
    spaces = sorted(x for x in room if x)
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        while left[length]:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                new = -(-left[length] // each)
                room[capacity].append([used, new])
                insort(spaces, capacity)
                used += new
                continue
            space = spaces[at]
            first, number = room[space].pop()
            if not room[space]:
                spaces.pop(at)
            each = min(space // length, left[length])
            full = min(number, left[length] // each)
            place(length, full * each, first, each, capacity - space)
            for start, n, rest in ((first, full, space - full_length(each, length)), (first + full, number - full, space)):
                if n and rest:
                    if not room[rest]:
                        insort(spaces, rest)
                    room[rest].append([start, n])
    return runs, used


def best_plan(histogram: dict[int, int], capacity: int, groups: int) -> list[tuple]:
    """The runs of the plan that uses fewest sequences, of those with either bound of large pieces."""
    plans = [plan(histogram, capacity, groups, capacity // share) for share in (3, 2)]
    return min(plans, key=lambda x: x[1])[0]


def full_length(each: int, length: int) -> int:
    """Tokens that `each` pieces of a length take."""
    return each * length


def pack(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    groups: int = 240,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id only. Longer documents than `capacity` are
    cut every `capacity` tokens. Repeated rows are packed as often as they come. An empty table gives
    an empty result. Other columns are not read. The histogram that the driver sees has at most
    `capacity` rows.
    """
    spark = df.sparkSession
    # The salt is written with the rows, so that copies of one document are dealt too, and alike whenever they are read.
    salted = tokenized_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("_salt", F.monotonically_increasing_id())
    pieces = materialize(salted, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = best_plan(histogram, capacity, groups)
    buckets = max(1, -(-sum(histogram.values()) // RANK_BUCKET))
    schema = "length long, first_rank long, pieces long, first_sequence long, each long, first_offset long"
    planned = spark.createDataFrame(runs, schema)

    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "_salt"), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "_salt")
    ranked = (
        dealt.withColumn("_row", F.row_number().over(within))
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        .withColumn("_part", F.floor(F.col("_rank") / RANK_PART))
    )
    # A piece meets the runs of its length in its part of the ranks only.
    last = F.col("first_rank") + F.col("pieces") - 1
    planned = planned.withColumn("_part", F.explode(F.sequence(F.floor(F.col("first_rank") / RANK_PART), F.floor(last / RANK_PART))))
    behind = F.col("_rank") - F.col("first_rank")
    return (
        ranked.join(planned, ["length", "_part"])
        .where((behind >= 0) & (behind < F.col("pieces")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_sequence") + F.floor(behind / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + behind % F.col("each") * F.col("length")).alias("offset"),
        )
    )
