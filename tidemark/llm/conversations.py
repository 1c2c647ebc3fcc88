"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

Rows are put in order by a range sort and cut into pieces of bounded length, so that a long conversation is many. A piece is a
small graph: a row is kept, gets another role or is deleted, and an empty turn may be inserted before it or at the end; what is
written so far is in one of four states. An edge's weight is one whole number: its cost in the high digits, and the letter
of its edit in the low digits, at the place that the letter takes in the audit; places after the last stay zero. So the least of
whole numbers is the cheapest path, and among those the one whose audit comes first. No path's letters start another's
of the same rows and cost, as what more the other has are insertions, which cost; so leasts of pieces can be joined to leasts of conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

SPACES = " \t\n\x0b\x0c\r"
DROP, BLANK, STRIP, REPEAT, TO_USER = range(5)
#: States of what is written: nothing, a system turn, a user turn last, an assistant turn last. The first and the last may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LETTERS = "\0DIKR"  # digits 1 to 4, in the order of ASCII; 0 is the padding
DIGIT_BITS = 3
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Codes of rows: s, u, a and o (another initial) can stay, in capitals if they are truncated; x has to go.
GONE = "x"
PIECE_ROWS, PIECE_CHARS = 256, 1_000_000
PIECE = (
    "conv_id long, part int, piece int, codes string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, low long, high long, turns long, paths array<struct<start:int,end:int,cost:long,audit:string>>"
)
ARROW_PIECE = [
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("codes", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns")),
    ("paths", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _edges(code: str) -> list[tuple[int, int, int, int]]:
    """from, to, cost, digit of a row's edits. Insertions are edges of their own."""
    out = [(s, s, DELETE, 1) for s in range(4)]
    if code != GONE:
        more = TRUNCATED if code.isupper() else 0
        out += [(s, t, KEEP + more, 3) for s, t in AFTER.get(code.lower(), {}).items()]
        out += [(s, t, REROLE + more, 4) for role in "ua" for s, t in AFTER[role].items()]
    return out


EDGES = {code: _edges(code) for code in "suaoSUAOx"}
INSERTS = [(s, t, INSERT, 2) for role in "ua" for s, t in AFTER[role].items()]


def _relax(nodes: dict[int, tuple[int, int]], edges: list[tuple[int, int, int, int]], width: int, into: dict[int, tuple[int, int]] | None = None) -> dict[int, tuple[int, int]]:
    """The least weights behind `edges`, of (weight, letters so far) by state, with those in `into`."""
    out = {} if into is None else dict(into)
    for s, t, cost, digit in edges:
        if s in nodes:
            weight, n = nodes[s]
            found = weight + (cost << (DIGIT_BITS * width)) + (digit << (DIGIT_BITS * (width - 1 - n)))
            if t not in out or found < out[t][0]:
                out[t] = found, n + 1
    return out


def _with_inserts(nodes: dict[int, tuple[int, int]], width: int) -> dict[int, tuple[int, int]]:
    """Also with insertions here: two suffice, as a third comes back to a state at a cost."""
    once = _relax(nodes, INSERTS, width, nodes)
    return _relax(once, INSERTS, width, once)


def _letters(weight: int, n: int, width: int) -> str:
    low = weight & ((1 << (DIGIT_BITS * width)) - 1)
    digits = oct(low)[2:].rjust(width, "0")[:n]
    return digits.translate({48 + d: LETTERS[d] for d in range(1, 5)})


def _weight(cost: int, letters: str, width: int) -> int:
    digits = letters.translate({ord(c): str(d) for d, c in enumerate(LETTERS) if d})
    return (cost << (DIGIT_BITS * width)) + (int(digits, 8) << (DIGIT_BITS * (width - len(letters))) if letters else 0)


def piece_paths(codes: str, starts: tuple[int, ...] = (0, 1, 2, 3)) -> list[tuple[int, int, int, str]]:
    """start, end, cost, audit of the least path from each start to each state over the rows; no insertions after the last row."""
    width = 3 * len(codes) + 1
    out = []
    for start in starts:
        nodes = {start: (0, 0)}
        for code in codes:
            nodes = _relax(_with_inserts(nodes, width), EDGES[code], width)
        out += [(start, end, weight >> (DIGIT_BITS * width), _letters(weight, n, width)) for end, (weight, n) in sorted(nodes.items())]
    return out


def join_pieces(pieces: list[tuple[int, list[tuple[int, int, int, str]]]]) -> tuple[int, str]:
    """cost and audit of a conversation from (rows, paths) of its pieces."""
    width = 3 * sum(n for n, _ in pieces) + 2
    nodes = {NOTHING: (0, 0)}
    for _, paths in pieces:
        after: dict[int, tuple[int, int]] = {}
        for start, end, cost, audit in paths:
            if start in nodes:
                weight, n = nodes[start]
                found = weight + (cost << (DIGIT_BITS * width)) + (_weight(0, audit, width) >> (DIGIT_BITS * n))
                if end not in after or found < after[end][0]:
                    after[end] = found, n + len(audit)
        nodes = after
    nodes = _with_inserts(nodes, width)
    weight, n = min(nodes[end] for end in ENDS if end in nodes)
    return weight >> (DIGIT_BITS * width), _letters(weight, n, width)


def damaged(conversations: DataFrame, rate: int = 20) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after their damage, equal ones as one; 0 copies of a row that was dropped.

    Nulls count as one space in the key, the role and the text; the turn itself stays null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % rate
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("_kind"))
    gone = F.col("_kind") == DROP
    after = rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, " ").when(F.col("_kind") == TO_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone, " ").when(F.col("_kind") == BLANK, "").when(F.col("_kind") == STRIP, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("_kind") == REPEAT, 2).otherwise(1).alias("_n"),
    )
    return after.groupBy("conv_id", "turn", "role", "text").agg(F.sum("_n").alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Adds `code` of the first of a row's copies, and `again`: it was seen in an earlier turn."""
    rows = rows.withColumn("_same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = rows.where("copies > 0").groupBy("conv_id", "_same").agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    seen = seen.withColumnRenamed("conv_id", "_conv").withColumnRenamed("_same", "_digest")  # texts seen in several turns only
    whole = rows.join(seen, rows["conv_id"].eqNullSafe(seen["_conv"]) & (rows["_same"] == seen["_digest"]), "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    again = F.coalesce(turn != F.col("_first"), F.lit(False))
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(last == "", " ").when(again, GONE).when(last.isin(".", "!", "?"), known).otherwise(F.upper(known))
    return whole.select("conv_id", "turn", "role", "text", "copies", code.alias("code"), initial.alias("initial"))


class _Piece:
    """The piece that is being gathered."""

    def __init__(self, number: int):
        self.number, self.codes, self.roles, self.texts, self.chars = number, [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = None

    def add(self, code: str, initial: str, turn: int | None, role: str, text: str) -> None:
        self.blank += code == " "
        self.duplicate += code == GONE
        self.truncated += code.isupper()
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if code in (" ", GONE):
            self.codes.append(GONE)
        else:
            self.codes.append(code)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)

    def row(self, conv: int | None, part: int, first: bool) -> dict:
        codes = "".join(self.codes)
        paths = piece_paths(codes, (NOTHING,) if first else (0, 1, 2, 3))
        sums = {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "turns": self.turns}
        ends = {"head": self.head, "tail": self.tail, "low": self.low, "high": self.high}
        named = [dict(zip(("start", "end", "cost", "audit"), p, strict=True)) for p in paths]
        return {"conv_id": conv, "part": part, "piece": self.number, "codes": codes, "roles": self.roles, "texts": self.texts, "paths": named} | sums | ends


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Runs of a conversation's rows in order, of at most `piece_rows` each, with their faults, least paths and what may stay of them."""
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema(ARROW_PIECE)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, piece, others, out, chars = None, -1, None, 0, [], 0

        def close() -> None:
            nonlocal chars
            out.append(piece.row(conv, part, others > 1 and piece.number == 0))
            chars += piece.chars + sum(len(p["audit"]) for p in out[-1]["paths"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "code", "initial", "part")]
            for own, turn, role, text, copies, code, initial, part in zip(*columns, strict=True):  # noqa: B007
                if piece is None or own != conv:
                    if piece is not None:
                        close()
                    conv, piece, others = own, _Piece(0), others + 1
                for copy in range(copies):
                    if len(piece.codes) >= piece_rows or piece.chars >= PIECE_CHARS:
                        close()
                        piece = _Piece(piece.number + 1)
                    piece.add(code if copy == 0 or code == " " else GONE, initial, turn, role, text)
                if chars >= PIECE_CHARS or len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, chars = [], 0
        if piece is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema)

    return materialize(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(gather, PIECE), "conversation-pieces")


def _edited(codes: str, letters: Iterator[str], roles: Iterator[str], texts: Iterator[str], state: int) -> tuple[Iterator[str], int]:
    """`role:text` of what a piece's edits leave, and the state behind it. Roles follow from the state: a kept system turn can only be the first."""
    out = []
    for code in codes:
        while True:
            edit = next(letters)
            role, text = (next(roles), next(texts)) if edit != "I" and code != GONE else ("", "")
            if edit != "D":
                initial = code.lower() if edit == "K" else "a" if state == USER else "u"
                out.append(f"{role if edit == 'K' else 'assistant' if initial == 'a' else 'user'}:{text}")
                state = AFTER[initial][state]
            if edit != "I":
                break
    return out, state


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation id, the null one included: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (`damaged`), then taken by turn, nulls first, and where turns are equal by role and text. A text without
    anything but white space is blank, a repeated role and text a duplicate, a text whose last character is none of `.!?` truncated; the
    first of these counts. Empty and null texts are blank; a conversation all of whose rows were dropped gives zeros, an empty audit and the
    digest of an empty text; an empty table an empty result. Very long texts count whole; other columns are not read. Gaps beyond a
    long wrap as sums of longs do.
    """
    pieces = _pieces(_marked(damaged(conversations)), piece_rows)
    # A conversation's paths come first, then its texts in order: the first are small, of the others one batch is held.
    plan = pieces.withColumn("kind", F.lit(0)).withColumn("roles", F.lit(None).cast("array<string>")).withColumn("texts", F.lit(None).cast("array<string>"))
    content = pieces.withColumn("kind", F.lit(1)).withColumn("paths", F.lit(None).cast(pieces.schema["paths"].dataType))
    both = plan.unionByName(content.where(F.size("roles") > 0).select(*plan.columns))
    order = (F.col("conv_id").asc_nulls_first(), F.col("kind"), F.col("part"), F.col("piece"))
    ordered = both.repartition("conv_id").sortWithinPartitions(*order)
    columns = [x.split() for x in RESULT.split(", ")]
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in columns])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if held is None or r["conv_id"] != held.conv:
                    if held is not None:
                        done.append(held.result())
                    held = _Conversation(r["conv_id"])
                held.take(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.result()], schema)

    return ordered.mapInArrow(fold, RESULT)


class _Conversation:
    """What is known of the conversation whose pieces come by: first all paths, then the texts."""

    def __init__(self, conv: int | None):
        self.conv, self.sums, self.pieces, self.found = conv, [0, 0, 0, 0], [], None
        self.tail = self.low = self.high = None
        self.turns, self.state, self.digest, self.wrote = 0, NOTHING, hashlib.sha256(), False
        self.codes: list[tuple[int, int, str]] = []
        self.letters: Iterator[str] = iter("")
        self.at = 0

    def take(self, r: dict) -> None:
        if r["kind"] == 1:
            self._decide()
            while self.codes[self.at][:2] != (r["part"], r["piece"]):
                self._write(self.codes[self.at][2], iter(()), iter(()))
            self._write(r["codes"], iter(r["roles"]), iter(r["texts"]))
            return
        self.sums = [a + r[c] for a, c in zip(self.sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        if r["codes"]:
            if self.tail is not None:
                self.sums[3] += self.tail + r["head"] not in ("su", "ua", "au")
            self.tail = r["tail"]
            self.pieces.append((len(r["codes"]), [(p["start"], p["end"], p["cost"], p["audit"]) for p in r["paths"]]))
            self.codes.append((r["part"], r["piece"], r["codes"]))
            if r["low"] is not None:
                self.turns += r["turns"] - (self.high == r["low"])
                self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def _decide(self) -> None:
        if self.found is None:
            self.found = join_pieces(self.pieces) if self.pieces else (0, "")
            self.letters, self.pieces = iter(self.found[1]), []

    def _write(self, codes: str, roles: Iterator[str], texts: Iterator[str]) -> None:
        lines, self.state = _edited(codes, self.letters, roles, texts, self.state)
        self._hash(lines)
        self.at += 1

    def _hash(self, lines: list[str]) -> None:
        for line in lines:
            self.digest.update((("\n" if self.wrote else "") + line).encode("utf-8", "surrogatepass"))
            self.wrote = True

    def result(self) -> dict:
        self._decide()
        while self.at < len(self.codes):
            self._write(self.codes[self.at][2], iter(()), iter(()))
        for _ in self.letters:  # insertions after the last row
            self._hash(["assistant:" if self.state == USER else "user:"])
            self.state = ASSISTANT if self.state == USER else USER
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        gaps = (gaps + 2**63) % 2**64 - 2**63
        values = (self.conv, gaps, *self.sums, *self.found, self.digest.hexdigest())
        return {x.split()[0]: value for x, value in zip(RESULT.split(", "), values, strict=True)}
