"""Line deduplication by a segment-partition edit join, with built-in functions only.

Lines are compared in lower case without outer white space. A line is removed if the same line, or one
within the edits allowed, comes earlier in (doc_id, line number) order; lines shorter than `min_chars` stay.
Lines of fewer than `LONG_WORDS` words are compared with each other by characters and allow one edit. Longer
lines are compared with each other by words (what single spaces separate), so that a changed word is one edit: the shorter line of a pair allows
one edit for each 16 words, from 64 words on the root of a quarter of its words, 30 at most.
A line is written as an array of symbols, hashes of its characters or of its words; all that follows reads symbols only.

A line that allows t edits is cut into t + 1 segments, half of them placed from its start and half from its
end. Some segment is intact and has as many edits before it as it has segments before it (and no more after it
than segments): a line in reach holds it moved by its number at most. So a line gives its own segments, and the
substrings so moved, as keys; equal keys make candidates, which a banded bit-parallel edit distance verifies. Where
many lines share a key, all are compared with a few of them, first the earliest and then those that hold most such
keys; lines found near an earlier one are done. Those still open are compared with all earlier lines of
the key but those that maps of parities rule out (an edit changes two symbols, so two bits at most), so that lines that
are alike but not near do not make all their pairs, and no near pair that decides on a line is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

MIN_CHARS = 40
LONG_WORDS = 16
MAX_EDITS = 30  # a band of 61 rows fits a word of 64 bits
CROWDED = 32  # rows of a key from which its lines are compared with hubs first
HUB_ROUNDS = 3
MAP_WORDS = 4  # 64 bits each
BROADCAST_ROWS = 500_000  # of ids: up to 20 MB
OUTER = " \t\r\f\v\u00a0\u3000"


def allowed_edits(length: Column, short: Column) -> Column:
    """Edits allowed to a line of so many symbols."""
    by_words = F.least(F.floor(length / LONG_WORDS), F.floor(F.sqrt(length / 4)), F.lit(MAX_EDITS))
    return F.when(short, 1).otherwise(by_words).cast("int")


def least_length(edits: Column, short: Column, min_chars: int) -> Column:
    """Symbols of the shortest compared line that allows so many edits."""
    return F.when(short, min_chars).otherwise(F.greatest(edits * LONG_WORDS, edits * edits * 4)).cast("int")


def _coded(lines: DataFrame) -> DataFrame:
    """Adds short, length and code (the symbols) to lines with their `norm`, which it drops."""
    # The words come from a generator, so that the line is split once for all that reads them.
    words = lines.withColumn("words", F.explode(F.array(F.split("norm", " "))))
    words = words.withColumn("short", F.size("words") < LONG_WORDS)
    chars = F.filter(F.split("norm", ""), lambda c: c != "")
    code = F.transform(F.when(F.col("short"), chars).otherwise(F.col("words")), lambda x: F.hash(x))
    return words.withColumn("length", F.when(F.col("short"), F.length("norm")).otherwise(F.size("words"))).withColumn("code", code).drop("norm", "words")


def _cut(lines: DataFrame, min_chars: int) -> DataFrame:
    """key, id, own: of each line its segments and the runs of symbols moved against them; own tells which.

    A line has its own number of edits t and, if it is in reach of a shorter line of the band below, that one's. Segments of
    a side are numbered from its end of the line; number j is moved by -j to j, so the first j of them have j * j keys and a
    running number tells both.
    """
    t = allowed_edits(F.col("length"), F.col("short"))
    below = F.when(~F.col("short") & (t > 1) & (F.col("length") < least_length(t, F.col("short"), min_chars) + t - 1), F.struct((t - 1).alias("t"), F.lit(False).alias("own")))
    bands = lines.select("id", "code", "short", "length", F.explode(F.array_compact(F.array(F.struct(t.alias("t"), F.lit(True).alias("own")), below))).alias("band"))
    rows = bands.select("id", "code", "short", "length", "band.t", "band.own")
    left, right = F.floor(F.col("t") / 2) + 1, F.ceil(F.col("t") / 2)
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), left * left + right * right - 1)))
    each = each.withColumn("side", (F.col("k") >= left * left).cast("int")).withColumn("k", F.col("k") - F.col("side") * left * left)
    each = each.withColumn("j", F.floor(F.sqrt("k"))).withColumn("move", F.col("k") - F.col("j") * F.col("j") - F.col("j"))
    size = F.floor(least_length(F.col("t"), F.col("short"), min_chars) / (F.col("t") + 1)).cast("int")
    start = F.when(F.col("side") == 0, F.col("j") * size).otherwise(F.col("length") - (F.col("j") + 1) * size) + F.col("move") + 1
    key = F.xxhash64("short", "t", "side", "j", F.slice("code", start.cast("int"), size))
    return each.select(key.alias("key"), "id", (F.col("own") & (F.col("move") == 0)).alias("own"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key other lines have too, one of them as its own; adds n, the rows of the key."""
    of_key = Window.partitionBy("key")
    counted = rows.select(
        "*", F.min("id").over(of_key).alias("_lo"), F.max("id").over(of_key).alias("_hi"), F.max("own").over(of_key).alias("_own"), F.count("*").over(of_key).alias("n")
    )
    return counted.where((F.col("_lo") != F.col("_hi")) & F.col("_own")).drop("_lo", "_hi", "_own")


def _pairs(rows: DataFrame) -> DataFrame:
    """a < b of all lines that share a key which one of them owns."""
    own = rows.where("own").select("key", F.col("id").alias("x"))
    met = rows.select("key", "id", "own").join(own, "key").where((F.col("id") != F.col("x")) & (~F.col("own") | (F.col("id") < F.col("x"))))
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))


def _joined(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """`rows` joined with `few`, which is broadcast if it is counted to be small, and shuffled else."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, keys, how)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (as written) of documents with an id and a text."""
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def compared(line: Column) -> Column:
    """What of a line is compared."""
    return F.lower(F.trim(line, F.lit(OUTER)))


def edits_within(a: Column, b: Column, most: Column, skew: Column, width: Column, mask: Column) -> Column:
    """True if the arrays a and b are within `most` edits (30 or fewer), by the bit-parallel recurrence on a band.

    `skew` is how much longer a is, `width` the rows of the band (2 * most + 1), and `mask` so many bits; they are columns,
    as an expression would be computed anew for every symbol.

    A column of the table of distances is two words: the rows of the band, from `most` above the diagonal to
    `most` below it, where the distance grows by one downwards, and where it falls. Every step moves the band down by
    a row. The distance is followed along the diagonal that ends in the last cell.
    """
    shift = lambda x, n: F.call_function("shiftleft", x, n)
    one = F.lit(1).cast("long")
    start = F.struct(mask.bitwiseAND(F.bitwise_not(shift(one, most) - 1)).alias("up"), F.lit(0).cast("long").alias("down"), F.abs(skew).cast("long").alias("edits"))

    def step(s: Column, j: Column) -> Column:
        # One-element arrays bind what is used more than once, so that it is computed once.
        gap = F.greatest(most - j + 1, F.lit(0))  # rows of the band above the first
        rows = F.struct(F.slice(a, j - most + gap, width - gap).alias("rows"), F.get(b, j - 1).alias("c"), gap.alias("gap"))
        first = lambda x: F.struct(x["rows"].alias("rows"), x["c"].alias("c"), x["gap"].alias("gap"), F.array_position(x["rows"], x["c"]).cast("int").alias("at"))

        def match(x: Column) -> Column:
            every = F.aggregate(
                F.sequence(F.lit(1), F.size(x["rows"])),
                F.lit(0).cast("long"),
                lambda found, k: found.bitwiseOR(F.when(F.get(x["rows"], k - 1) == x["c"], shift(one, k - 1 + x["gap"])).otherwise(F.lit(0).cast("long"))),
            )
            no_other = F.array_position(F.slice(x["rows"], x["at"] + 1, width), x["c"]) == 0
            same = F.when(x["at"] == 0, F.lit(0).cast("long")).when(no_other, shift(one, x["at"] - 1 + x["gap"])).otherwise(every)
            return F.struct(same.alias("same"), s.alias("s"))

        def apply(x: Column) -> Column:
            same, up, down = x["same"], x["s"]["up"], x["s"]["down"]
            flat = (same.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(same).bitwiseOR(down).bitwiseAND(mask)
            return F.struct(flat.alias("flat"), up.alias("up"), down.alias("down"), x["s"]["edits"].alias("edits"))

        def after(x: Column) -> Column:
            flat, up, down = x["flat"], x["up"], x["down"]
            right = down.bitwiseOR(F.bitwise_not(flat.bitwiseOR(up))).bitwiseAND(mask)
            left = flat.bitwiseAND(up)
            below = F.call_function("shiftright", flat, F.lit(1))
            met = F.call_function("shiftright", flat, most + skew).bitwiseAND(one)
            return F.struct(
                left.bitwiseOR(F.bitwise_not(below.bitwiseOR(right))).bitwiseAND(mask).alias("up"),
                below.bitwiseAND(right).alias("down"),
                (x["edits"] + F.when(j > -skew, 1 - met).otherwise(F.lit(0).cast("long"))).alias("edits"),
            )

        walked = F.get(F.transform(F.transform(F.transform(F.transform(F.array(rows), first), match), apply), after), F.lit(0))
        return F.when(s["edits"] > most, s).otherwise(walked)

    walked = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda s: s["edits"])
    return F.when(F.abs(skew) > most, F.lit(False)).when((F.size(b) == 0) | (F.size(a) == 0), F.lit(True)).otherwise(walked <= most)


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """id, id2 of the later line of each pair that is near, written."""
    pairs = materialize(pairs.distinct(), "line-candidates")
    side = lambda p: texts.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "id2", "first", "code", "length", "short")))
    both = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id")).where(F.col("a_short") == F.col("b_short"))
    late = lambda c: F.when(F.col("a_first") < F.col("b_first"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    edits = allowed_edits(F.least("a_length", "b_length"), F.col("a_short"))
    reach = both.withColumn("edits", edits).where(F.abs(F.col("a_length") - F.col("b_length")) <= F.col("edits"))
    reach = reach.select(late("id"), late("id2"), "edits", F.col("a_code").alias("x"), F.col("b_code").alias("y"))
    # An edit brings or takes one symbol.
    reach = reach.where((F.size(F.array_except("x", "y")) <= F.col("edits")) & (F.size(F.array_except("y", "x")) <= F.col("edits")))
    for _ in range(2):  # what both begin with is left out, then what both end with
        same = F.array_position(F.zip_with("x", "y", lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
        same = F.when(same > 0, same - 1).otherwise(F.size("x"))
        reach = reach.withColumn("same", same)
        reach = reach.select("id", "id2", "edits", *(F.reverse(F.slice(c, F.col("same") + 1, F.size(c))).alias(c) for c in ("x", "y")))
    reach = reach.withColumn("skew", F.size("x") - F.size("y")).withColumn("width", F.col("edits") * 2 + 1)
    reach = materialize(reach.withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("width")) - 1), "line-rests")
    found = edits_within(F.col("x"), F.col("y"), F.col("edits"), F.col("skew"), F.col("width"), F.col("mask"))
    return materialize(reach.where(found).select("id", "id2").distinct(), "near-lines")


def _crowd_members(texts: DataFrame) -> DataFrame:
    """id, first, length, short, and m0..: parities of the numbers of symbols that hash to a place."""
    places = F.transform("code", lambda c: F.pmod(c, F.lit(64 * MAP_WORDS)))
    known = materialize(texts.select("id", "first", "length", "short", places.alias("places")), "crowd-places")

    def word(k: int) -> Column:
        here = F.filter("places", lambda p: (p >= 64 * k) & (p < 64 * k + 64))
        return F.aggregate(here, F.lit(0).cast("long"), lambda m, p: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p - 64 * k)))

    return known.select("id", "first", "length", "short", *(word(k).alias(f"m{k}") for k in range(MAP_WORDS)))


def _crowded_pairs(crowded: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Candidates of lines (key, id) that share crowded keys and are near no hub, and what is near the hubs."""
    carried = ("id", "first", "length", "short", *(f"m{k}" for k in range(MAP_WORDS)))
    held = materialize(crowded.groupBy("id").agg(F.count("*").alias("held"), F.collect_set("key").alias("keys")), "crowded-lines")
    members = _crowd_members(_joined(texts, held.select("id"), ["id"], "left_semi")).join(held, "id")
    rows = materialize(crowded.select("key", "id").join(members, "id"), "crowd")
    apart = sum((F.bit_count(F.col(f"m{k}").bitwiseXOR(F.col(f"x_m{k}"))) for k in range(MAP_WORDS)), F.lit(0))
    edits = allowed_edits(F.least("length", "x_length"), F.col("short"))
    may = (F.col("short") == F.col("x_short")) & (F.abs(F.col("length") - F.col("x_length")) <= edits) & (apart <= edits * 2) & (F.col("x_first") < F.col("first"))
    near: list[DataFrame] = []
    hubs = None
    is_open = rows
    for turn in range(HUB_ROUNDS):
        # The earliest, then the one most like the others, then the one of those before it.
        ahead = rows if turn < 2 else rows.join(hubs.select("key", "x_first"), "key").where(F.col("first") < F.col("x_first"))
        order = F.col("first") if turn == 0 else F.struct(-F.col("held"), F.col("first"))
        hubs = ahead.groupBy("key").agg(F.min_by(F.struct(*carried), order).alias("x"))
        hubs = materialize(hubs.select("key", *(F.col(f"x.{c}").alias(f"x_{c}") for c in carried)), "crowd-hubs")
        met = is_open.join(hubs, "key").where(may)
        near.append(_near(met.select(F.col("x_id").alias("a"), F.col("id").alias("b")), texts))
        is_open = materialize(is_open.join(near[-1].select("id").distinct(), "id", "left_anti"), "open-lines")
    # Two lines that share several keys meet at the least of them only.
    earlier = rows.select("key", F.col("keys").alias("x_keys"), *(F.col(c).alias(f"x_{c}") for c in carried))
    met = is_open.join(earlier, "key").where(may & (F.array_min(F.array_intersect("keys", "x_keys")) == F.col("key")))
    return met.select(F.col("x_id").alias("a"), F.col("id").alias("b")), near


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, id of the lines to remove; `id` is the hash of what is compared of the line."""
    # The compared text comes from a generator, so that it is made once for the filter and all that follows.
    read = _lines(docs).select("doc_id", "line_no", F.explode(F.array(compared(F.col("line")))).alias("norm")).where(F.length("norm") >= min_chars)
    # A line is known by two hashes. Its text travels only if it shares a key with another.
    read = read.select("doc_id", "line_no", "norm", F.xxhash64("norm").alias("id"), F.xxhash64(F.lit(11), "norm").alias("id2"))
    places = materialize(read.select("doc_id", "line_no", "id", "id2"), "line-places")
    lines = materialize(places.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")), "distinct-lines")
    shared = materialize(_shared(_cut(_coded(read.select("id", "norm")), min_chars).distinct()), "shared-keys")
    wanted = materialize(shared.select("id").distinct(), "wanted-lines")
    texts = _joined(read, wanted, ["id"], "left_semi").groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("norm").alias("norm"))
    texts = materialize(_coded(texts), "candidate-lines")
    pairs, near = _pairs(shared.where(F.col("n") <= CROWDED)), []
    crowded = shared.where(F.col("n") > CROWDED).select("key", "id").distinct()
    if not crowded.isEmpty():
        more, near = _crowded_pairs(crowded, texts)
        pairs = pairs.union(more)
    near.append(_near(pairs, texts))
    late = near[0]
    for more in near[1:]:
        late = late.union(more)
    known = lines.join(late.distinct().withColumn("near", F.lit(True)), ["id", "id2"], "left")
    bad = materialize(known.where((F.col("n") > 1) | F.col("near")).select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near")), "repeated-lines")
    found = _joined(places, bad, ["id", "id2"], "inner")
    return found.where(F.col("near") | (F.struct("doc_id", "line_no") != F.col("first"))).select("doc_id", "line_no", "id")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text (without the removed lines), n_lines, n_removed, and `keep_columns`.

    Null texts stay null and empty ones empty, both with 0 removed; a document may lose all its lines and
    is then an empty text. Rows with a null id are kept as they are. Of rows that repeat a doc_id, lines of one number are one
    place, so rows that are equal keep the same lines, and a text loses a line only where that number is the removed line in it too.
    Lines of any length count whole; an empty table gives an empty result; other columns than those named are not read.
    """
    removed = materialize(duplicate_lines(docs, min_chars).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "id")).alias("_all")), "removed-lines")
    # Another text of the id may have another line of that number, or none.
    here = F.filter("_all", lambda g: F.xxhash64(compared(F.get("_lines", g["line_no"]))) == g["id"])
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return (
        docs.select("doc_id", "text", *keep_columns)
        .join(removed.hint("shuffle_merge"), "doc_id", "left")  # what is removed grows with the documents
        .withColumn("_lines", F.when(F.col("_all").isNotNull(), F.split("text", "\n")))
        .withColumn("_gone", F.when(F.col("_all").isNotNull(), F.transform(here, lambda g: g["line_no"])))
        .select(
            "doc_id",
            F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col("text")).alias("text"),
            F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
            F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
            *keep_columns,
        )
    )
