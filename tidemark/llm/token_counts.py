"""Token counts by a finite-state transducer compiled from a BPE piece model.

A transducer state is what of the text read so far can still change the segmentation: the longest
suffix that some longer piece starts with, and for each position in it the last token and the token
count relative to now. Reading a character moves to one next state and emits the change of the
count. States and transitions are made when first met and kept.

No piece continues over "non-space then space", so after such a boundary the state no longer depends
on what was before it. A chunk of a long text stands for a map of states: entry state -> (exit state, tokens). What
follows its first boundary is the same for all entry states and is read once; only what is before it is read for each
state asked for. Maps are associative under `compose`, and a document's chunks are combined by a balanced prefix scan,
in which every character is read once for each state that enters its chunk.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
KEEP_WORDS = 250_000
KEEP_STATES = 200_000
CHUNK_CHARS = 1 << 16


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, integer or bytes)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece BPE model with their scores."""
    pieces: dict[str, float] = {}
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                pieces[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
    return pieces


class Transducer:
    """Counts the tokens of a text; `pieces` maps each piece to its score (higher merges first)."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p))}
        self.joined = {c for p in pieces if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or "\n" in self.joined:
            raise ValueError("a piece spans a boundary: chunk maps would not compose")
        self._reset()
        self.words = _Counts(self)

    def _reset(self) -> None:
        """Forgets all states. Those still held go on to work: a row knows its own state."""
        self.rows: dict[tuple, dict] = {}  # state -> its row: character -> (next state's row, emitted), and "" -> the state
        self.fits: dict[tuple[str, str], bool] = {}
        self.start = self._row(("", (), (None, 0)))

    def _row(self, state: tuple) -> dict:
        if state not in self.rows:
            self.rows[state] = {"": state}
        return self.rows[state]

    def merge(self, text: str) -> list[str]:
        """The plain greedy merge, used on two tokens at a time to see whether they stay apart."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.pieces.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: str | None, right: str) -> bool:
        key = (left or "", right)
        if key not in self.fits:
            self.fits[key] = self.merge(key[0] + right) == ([left, right] if left else [right])
        return self.fits[key]

    def _cost(self, token: str) -> int:
        return 1 if token in self.pieces else len(token.encode())

    def _move(self, state: tuple, char: str) -> tuple[dict, int]:
        """Next state's row and emitted count. A state keeps (start, last token, count) for those starts of
        its suffix from which a longer piece is still possible, longest first."""
        suffix, open_starts, (newest, at_end) = state
        read, pieces = suffix + char, self.pieces
        for start, last, count in (*open_starts, (len(suffix), newest, at_end)):
            token = read[start:]
            if (token in pieces or len(token) == 1) and self._apart(last, token) and self._apart(None, token):
                break
        emitted = count + self._cost(token)
        kept = [(i, t, c - emitted) for i, t, c in (*open_starts, (len(suffix), newest, at_end)) if read[i:] in self.prefixes]
        drop = kept[0][0] if kept else len(read)
        return self._row((read[drop:], tuple((i - drop, t, c) for i, t, c in kept), (token, 0))), emitted

    def walk(self, row: dict, text: str) -> tuple[dict, int]:
        """The row that reading `text` leads to from `row`, and the tokens emitted."""
        total = 0
        for char in text:
            found = row.get(char)
            if found is None:
                found = row[char] = self._move(row[""], char)
            row, emitted = found
            total += emitted
        if len(self.rows) > KEEP_STATES:
            self._reset()
        return row, total

    def run(self, segment: str) -> int:
        """Tokens of one segment, read from the start state."""
        return self.walk(self.start, segment)[1]

    def tokens(self, text: str) -> int:
        """Tokens of a text that starts at a boundary; spaces are already SPACE."""
        words, total = self.words, 0
        for number, line in enumerate(text.split("\n")):
            if number:
                total += words["\n"]
            if SPACE not in line:
                total += words[line] if line else 0
                continue
            first, *rest = line.split(SPACE)
            if first:
                total += words[first]
            if "" in rest:
                total += sum(map(words.__getitem__, _SEGMENTS.findall(line[len(first) :])))
            else:
                spaced = words.spaced
                total += sum(map(spaced.__getitem__, rest))
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text, with the leading space that the model adds."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= CHUNK_CHARS:
            return self.tokens(text)
        maps: list[StateMap] = [ChunkMap(self, text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)]
        while len(maps) > 1:  # a level of the scan tree
            maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][self.start[""]][1]


class StateMap(dict):
    """Entry state -> (exit state, tokens), filled for the states that it is asked for."""

    def __init__(self, of: Callable[[tuple], tuple[tuple, int]]):
        super().__init__()
        self.of = of

    def __missing__(self, state: tuple) -> tuple[tuple, int]:
        self[state] = found = self.of(state)
        return found


class ChunkMap(StateMap):
    """The map of a chunk. All entry states have the same exit if the chunk has a boundary."""

    def __init__(self, machine: Transducer, chunk: str):
        super().__init__(self._read)
        self.machine, self.rest = machine, None
        at = _first_boundary(chunk)
        self.head = chunk if at < 0 else chunk[:at]
        if at >= 0:
            body = chunk[at:]
            cut = _last_boundary(body)
            row, open_tokens = machine.walk(machine.start, body[cut:])
            self.rest = row[""], (machine.tokens(body[:cut]) if cut else 0) + open_tokens

    def _read(self, state: tuple) -> tuple[tuple, int]:
        row, tokens = self.machine.walk(self.machine._row(state), self.head)
        return (row[""], tokens) if self.rest is None else (self.rest[0], tokens + self.rest[1])


def compose(a: StateMap, b: StateMap) -> StateMap:
    """The map of two neighbouring stretches."""

    def both(state: tuple) -> tuple[tuple, int]:
        middle, before = a[state]
        end, after = b[middle]
        return end, before + after

    return StateMap(both)


_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*")
_BOUNDARY = re.compile(f"(?<=[^{SPACE}\n])(?={SPACE})|(?=\n)|(?<=\n)")


def _first_boundary(chunk: str) -> int:
    found = next((m.start() for m in _BOUNDARY.finditer(chunk) if m.start()), -1)
    return found if found < len(chunk) else -1


def _last_boundary(body: str) -> int:
    """Where the last segment starts: scanned backwards, so long texts are not searched twice."""
    at = len(body.rstrip(SPACE)) if body.endswith(SPACE) else len(body)
    at = max(body.rfind(SPACE, 0, at), body.rfind("\n", 0, at) + 1)
    while at > 0 and body[at - 1] == SPACE:
        at -= 1
    return max(at, 0)


class _Counts(dict):
    """Segment -> tokens; `spaced` is the same for segments written without their one leading space."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.spaced = machine, _Spaced(machine)

    def __missing__(self, segment: str) -> int:
        if len(self) > KEEP_WORDS:
            self.clear()
        self[segment] = found = self.machine.run(segment)
        return found


class _Spaced(dict):
    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        if len(self) > KEEP_WORDS:
            self.clear()
        self[word] = found = self.machine.run(SPACE + word)
        return found


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One transducer a worker process and model file."""
    if path not in _MACHINES:
        gc.set_threshold(200_000, 20, 50)  # states are many small containers without cycles
        _MACHINES[path] = Transducer(read_pieces(path))
    return _MACHINES[path]


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. No shuffle; rows are kept as they are.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; an empty table
    gives an empty result; other columns, whatever their names, are not read. `model_path` must be
    readable on every executor (the installed public tokenizers are). Very long texts are cut into
    chunks whose maps are composed; nothing is truncated.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counts = machine(model_path).count
        return pd.Series([counts(t) for t in texts], dtype="int64")

    return (
        df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), count("_text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
