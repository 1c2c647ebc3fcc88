"""Benchmark decontamination by template windows, with built-in functions only.

Text becomes a template: numbers, units behind numbers, and names (capitalised words inside a sentence)
turn into typed placeholders, everything else into lower-case words. A capitalised word that opens a sentence (or follows a
number) may be a name or a word: every window has all readings of such words, on both sides. Windows of five template tokens of
the documents meet those of the benchmark in a hash join. An item counts as found in a document if at
least 0.8 of its windows are there and its slots are consistent: on an alignment (document position less
item position), one value of the item always stands for one value of the document. So a question asked
again with other numbers or names is found, and a chance meeting of placeholders is not. A value has one
meaning for a type and a role: the 5 of "5 kg" may differ from that of "5 apples". Different names stay different,
different numbers need not. The check is made once with the items' openings as words and once with all readings, and either will do.

Beside that the lower-case tokens themselves meet in windows of five, or of the whole item if it is shorter, so
that a copy is found whatever its items' placeholders and the case of its names.

Most documents are ruled out before their templates are made. A document that holds at least 0.8 of an item's windows holds one of any
(a fifth of them) + 1; so for each item that many windows are picked, and of each reading of them a pair of adjacent words, longest first. The words
of a pair are letters only, and so follow each other in the document among its runs of letters too, whatever its numbers, units and names
are. Documents without any such pair hold no item. Items whose windows have too few pairs are looked for in all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

WINDOW = 5
SHARE = 0.8
BROADCAST_PLACES = 1_000_000  # of windows, or pairs of words: some ten MB
BROADCAST_DOCS = 500_000  # ids: some ten MB
# Units that may follow a number.
UNITS = "kg|km|cm|mm|mg|ml|kwh|mph|km/h|usd|eur|gb|mb|kb|hours|hour|minutes|minute|seconds|days|day|weeks|years|miles|meters|litres|percent|dollars|euros"
NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
# The look ahead comes first, as few places pass it.
NAME = r"(?=\p{Lu})(?<=[\p{L}\p{N},] )\p{Lu}\p{Ll}+"
OPENING = r"(?=\p{Lu})(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
LEAST_WORDS = 2  # literal tokens of a window
BREAK = r"[^\p{L}\p{N}]+"
NO_LETTERS = r"[^\p{L}]+"
STEADY = r"^[\p{L}&&[^\u03c3\u03c2]]+$"  # how a sigma is written depends on what is beside it
OPEN = "1"  # before a word that opens a sentence
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = "0n", "0p", "0u"  # no word starts with a digit once numbers are replaced


def template_tokens(text: Column) -> Column:
    """Array of template tokens of a text, opening words marked by OPEN; empty for null."""
    slots = F.regexp_replace(F.regexp_replace(text, r"[\t\n\x0B\f\r]\s*| \s+", " "), NUMBER, f" {NUMBER_SLOT} ")
    slots = F.regexp_replace(slots, rf"0n  ?(?i:{UNITS})(?![\p{{L}}\p{{N}}])", f"{NUMBER_SLOT} {UNIT_SLOT}")
    slots = F.regexp_replace(slots, NAME, NAME_SLOT)
    return _words(F.regexp_replace(slots, OPENING, f"{OPEN}$0"))


def as_words(tokens: Column) -> Column:
    """The tokens, opening words read as words."""
    return F.transform(tokens, lambda x: F.when(x.startswith(OPEN), F.substr(x, F.lit(2))).otherwise(x))


def readings(size: int) -> Column:
    """For each set of opening words in a window (as bits) its subsets: those read as names."""
    return F.lit([[part for part in range(2**size) if part & whole == part] for whole in range(2**size)])


def token_hashes(tokens: Column) -> Column:
    """A hash for each token, so that a token in many windows is read once."""
    return F.transform(tokens, lambda x: F.xxhash64(x))


def opening_hashes(words: Column, opens: Column, size: int) -> Column:
    """dpos, h of the readings of each run of `size` tokens that take an opening word as a name; h is null for those to be left out. `words`
    (hashes) and `opens` (1 for an opening word, else 0) must be columns.

    For each opening those where it is the first that is read as a name: most have no other opening close behind, so that few windows
    need to be looked at by bits.
    """
    last = F.size(words) - size

    def token(at: Column, k: int, j: int, part: Column | None) -> Column:
        if j == k:
            return F.xxhash64(F.lit(NAME_SLOT))
        word = F.get(words, at - k + j)
        return word if j < k or part is None else F.when(part.bitwiseAND(F.lit(1 << (j - k - 1))) != 0, F.xxhash64(F.lit(NAME_SLOT))).otherwise(word)

    def around(at: Column, part: Column | None = None) -> Column:
        made = []
        for k in range(size):  # the opening's place in the window; bits beyond the window must be empty
            inside = (at >= k) & (at - k <= last)
            inside = inside if part is None else inside & (part < (1 << (size - 1 - k)))
            made.append(F.struct((at - k).alias("dpos"), F.when(inside, F.xxhash64(*(token(at, k, j, part) for j in range(size)))).alias("h")))
        return F.array(*made)

    def of_opening(at: Column) -> Column:
        behind = sum((F.coalesce(F.get(opens, at + j + 1), F.lit(0)) * (1 << j) for j in range(1, size - 1)), F.coalesce(F.get(opens, at + 1), F.lit(0)))
        return F.when(behind == 0, around(at)).otherwise(F.flatten(F.transform(F.get(readings(size - 1), behind), lambda part: around(at, part))))

    places = F.filter(F.sequence(F.lit(0), F.size(opens) - 1), lambda i: F.get(opens, i) == 1)
    return F.when(last >= 0, F.flatten(F.transform(places, of_opening)))


def raw_tokens(text: Column) -> Column:
    """Array of the tokens that the template's tokens stand for, at the same positions."""
    kept = F.regexp_replace(text, NUMBER, " $0 ")
    return F.array_remove(F.split(F.lower(F.regexp_replace(kept, r"(?=[.,:/])(?<=\p{Nd})[.,:/](?=\p{Nd})", "0x")), BREAK), "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def window_hash(tokens: Column, at: Column, size: int) -> Column:
    """Hash of `size` tokens, given by their hashes, from position `at` (from 0). They are fetched one by one: a slice would copy
    the whole array for each window."""
    return F.xxhash64(*(F.get(tokens, at + k) for k in range(size)))


def window_hashes(tokens: Column, size: int) -> Column:
    """A hash for each run of `size` tokens, given by their hashes; empty if there are fewer. `tokens` must be a column, not an
    expression, or it would be computed anew for each window."""
    last = F.size(tokens) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: window_hash(tokens, i, size))).otherwise(
        F.array().cast("array<bigint>")
    )


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """item (a hash of both), item_id, text of all distinct rows with an id and a text."""
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return known.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").distinct()


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """item, ipos, v, h, w, slots, roles, n_slots, n_windows: windows with a literal majority, but for openings read as names; v is the
    set of these, as bits."""
    tokens = items.select("item", template_tokens(F.col("text")).alias("t"), raw_tokens(F.col("text")).alias("raw"))
    # The role of a number is what follows it.
    after = lambda x, i: F.when(F.get("t", i + 1).isin(NUMBER_SLOT, NAME_SLOT), F.get("t", i + 1)).otherwise(F.get("raw", i + 1))
    roles = F.transform("t", lambda x, i: F.when(x == NUMBER_SLOT, F.coalesce(after(x, i), F.lit(""))).otherwise(F.lit("")))
    windows = tokens.where(F.size("t") >= size).select(
        "item", "raw", "t", roles.alias("roles"), F.explode(F.sequence(F.lit(1), F.size("t") - size + 1)).alias("ipos")
    )
    windows = windows.withColumn("m", F.slice("t", F.col("ipos"), F.lit(size)))
    whole = sum((F.when(F.get("m", F.lit(k)).startswith(OPEN), 1 << k).otherwise(0) for k in range(size)), F.lit(0))
    windows = windows.withColumn("v", F.explode(F.get(readings(size), whole)))
    read = F.array(*(F.when(F.col("v").bitwiseAND(F.lit(1 << k)) != 0, F.lit(NAME_SLOT)).otherwise(F.get(as_words(F.col("m")), F.lit(k))) for k in range(size)))
    slots_in = lambda tokens: F.size(F.filter(tokens, lambda x: x.startswith("0")))
    windows = windows.withColumn("w", read).withColumn("n_slots", slots_in(F.col("w")))
    literal = (slots_in(F.col("m")) * 2 < size) & (F.col("n_slots") <= max(size - LEAST_WORDS, 0))
    usable = windows.where(literal).withColumn("h", F.xxhash64(*(F.xxhash64(F.get("w", F.lit(k))) for k in range(size))))
    counts = usable.groupBy("item").agg(F.countDistinct("ipos").alias("n_windows"))
    sliced = usable.withColumn("slots", F.slice("raw", F.col("ipos"), F.lit(size))).withColumn("roles", F.slice("roles", F.col("ipos"), F.lit(size)))
    return sliced.select("item", "ipos", "v", "h", "w", "slots", "roles", "n_slots").join(counts, "item")


def exact_windows(items: DataFrame, size: int) -> DataFrame:
    """item, ipos, h, size, n_windows, w: windows of lower-case tokens, the whole item if it has fewer than `size`."""
    tokens = items.select("item", raw_tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    tokens = tokens.select("item", "words", token_hashes(F.col("words")).alias("raw"))
    made = F.when(F.size("raw") >= size, window_hashes(F.col("raw"), size))
    for n in range(1, size):
        made = made.when(F.size("raw") == n, F.array(window_hash(F.col("raw"), F.lit(0), n)))
    found = tokens.select("item", "words", F.least(F.size("raw"), F.lit(size)).alias("size"), made.alias("hs"))
    found = found.select("item", "words", "size", F.size("hs").alias("n_windows"), F.posexplode("hs").alias("ipos", "h"))
    return found.select("item", "ipos", "h", "size", "n_windows", F.slice("words", F.col("ipos") + 1, F.col("size")).alias("w"))


def best_pair(words: Column, size: int) -> Column:
    """n, h of the longest two adjacent words of a window that are letters only; null if it has none. `words` must be a column."""
    steady = lambda k: F.get(words, F.lit(k)).rlike(STEADY)
    pairs = [F.when(steady(k) & steady(k + 1), F.struct((F.length(F.get(words, F.lit(k))) + F.length(F.get(words, F.lit(k + 1)))).alias("n"), F.xxhash64(F.get(words, F.lit(k)), F.get(words, F.lit(k + 1))).alias("h"))) for k in range(size - 1)]
    none = F.lit(None).cast("struct<n:int,h:bigint>")
    return F.array_max(F.array(none, *pairs))


def item_pairs(known: DataFrame, size: int, share: float) -> DataFrame:
    """item, weak, hs: the pairs of words of which a document must hold one to hold `share` of an item's windows; weak if they can't tell.

    `known`: item, ipos, n_windows, w; a place has a row for each reading, and any of them may be the one in the document.
    """
    each = known.select("item", "ipos", "n_windows", best_pair(F.col("w"), size).alias("pair"))
    places = each.groupBy("item", "ipos").agg(F.max("n_windows").alias("n_windows"), F.min(F.coalesce("pair.n", F.lit(0))).alias("n"), F.collect_set("pair.h").alias("hs"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "ipos"))
    # One more than the windows that may be missing.
    picked = places.withColumn("rank", rank).where(F.col("rank") <= F.floor(F.col("n_windows") * (1 - share) + 1e-6) + 1)
    return picked.groupBy("item").agg((F.min("n") == 0).alias("weak"), F.flatten(F.collect_list("hs")).alias("hs"))


def documents_with(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, text of the documents that hold any of the pairs (h) among their runs of letters."""
    runs = texts.select("doc", F.split(F.lower("text"), NO_LETTERS).alias("runs"))
    # Not filtered by the number of runs: the filter would be moved to the scan, and split there again.
    places = F.when(F.size("runs") > 1, F.sequence(F.lit(0), F.size("runs") - 2))
    each = runs.select("doc", "runs", F.explode(places).alias("at"))
    each = each.select("doc", F.xxhash64(F.get("runs", F.col("at")), F.get("runs", F.col("at") + 1)).alias("h"))
    pairs = materialize(pairs.distinct(), "pairs")
    met = each.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_PLACES else pairs, "h", "left_semi")
    found = materialize(met.select("doc").distinct(), "documents-with-pairs")
    few = found.count() <= BROADCAST_DOCS
    return materialize(texts.join(F.broadcast(found) if few else found, "doc", "left_semi"), "likely-texts")


def exact_copies(texts: DataFrame, known: DataFrame, size: int, share: float) -> DataFrame:
    """doc, item, coverage of items whose lower-case tokens are in a document; `known` are their windows."""
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most `size` of them
    tokens = texts.select("doc", token_hashes(raw_tokens(F.col("text"))).alias("raw"))
    each = [F.struct(F.lit(n).alias("size"), window_hashes(F.col("raw"), n).alias("hs")) for n in sizes or [size]]
    hashes = tokens.select("doc", F.explode(F.array(*each)).alias("x")).select("doc", "x.size", F.explode("x.hs").alias("h"))
    once = hashes.join(known.drop("w"), ["size", "h"]).groupBy("doc", "item", "ipos").agg(F.max("n_windows").alias("n_windows"))
    counts = once.groupBy("doc", "item").agg((F.count("*") / F.max("n_windows")).alias("coverage"))
    return counts.where(F.col("coverage") >= share)


def template_hits(texts: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """doc, item, dpos, ipos, v, n_windows, n_slots: where the documents' template windows, in all readings, are those of items."""
    tokens = texts.select("doc", template_tokens(F.col("text")).alias("t"))
    opens = F.transform("t", lambda x: x.startswith(OPEN).cast("int"))
    tokens = tokens.select("doc", token_hashes(as_words(F.col("t"))).alias("t"), opens.alias("opens"))
    tokens = tokens.select("doc", "t", opening_hashes(F.col("t"), F.col("opens"), size).alias("more"))
    # All windows with openings as words, by their places, then the other readings, which know theirs.
    plain = F.size("t") - size + 1
    hashes = tokens.select("doc", "more", plain.alias("plain"), F.posexplode(F.concat(window_hashes(F.col("t"), size), F.col("more.h"))).alias("at", "h")).where("h IS NOT NULL")
    hashes = hashes.select("doc", F.when(F.col("at") < F.col("plain"), F.col("at")).otherwise(F.get("more", F.col("at") - F.col("plain"))["dpos"]).alias("dpos"), "h")
    by_hash = known.select("h", "item", "ipos", "v", "n_windows", "n_slots")
    return hashes.join(by_hash, "h").select("doc", "item", "dpos", "ipos", "v", "n_windows", "n_slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, coverage of every item found in a document.

    Null texts hold nothing; texts of any length are read whole; empty tables give an empty result; other columns are not read. Of items of fewer than `size` tokens, and of those whose windows are all
    placeholders for the greater part, copies are found. Rows that repeat a doc_id are looked at one by one and count together; rows that repeat an
    item_id with other texts are all looked for. The benchmark's windows are joined as they are: Spark broadcasts them
    only below its size threshold.
    """
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = texts.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc"), "text")
    items = materialize(distinct_items(benchmark), "items")
    known = materialize(benchmark_windows(items, size), "benchmark-windows")
    exact = materialize(exact_windows(items, size), "exact-windows")
    asked_for = {k: materialize(item_pairs(rows, size, share), f"{k}-pairs") for k, rows in (("template", known), ("exact", exact))}
    pairs = asked_for["template"].unionByName(asked_for["exact"]).where("NOT weak").select(F.explode("hs").alias("h"))
    likely_texts = documents_with(texts, pairs)

    def looked_for(find: Callable[..., DataFrame], kind: str, rows: DataFrame, *more: float) -> DataFrame:
        """What `find` gives: items in the documents that may hold them, weak ones in all documents."""
        weak = asked_for[kind].where("weak").select("item")
        found = find(likely_texts, rows.join(weak, "item", "left_anti"), size, *more)
        return found if weak.isEmpty() else found.unionByName(find(texts, rows.join(weak, "item", "left_semi"), size, *more))

    hits = materialize(looked_for(template_hits, "template", known), "window-hits")

    def covered(found: DataFrame) -> DataFrame:
        once = found.groupBy("doc", "item", "ipos").agg(F.max("n_windows").alias("n_windows"))
        counts = once.groupBy("doc", "item").agg((F.count("*") / F.max("n_windows")).alias("coverage"))
        return counts.where(F.col("coverage") >= share)

    likely = covered(hits)
    with_slots = hits.join(likely.select("doc", "item"), ["doc", "item"], "left_semi").withColumn("diagonal", F.col("dpos") + 1 - F.col("ipos"))
    asked = materialize(with_slots.where(F.col("n_slots") > 0), "slot-windows")
    # Of a document's tokens only the windows asked for are sent on.
    places = materialize(asked.groupBy("doc").agg(F.collect_set("dpos").alias("places")), "asked-places")
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    raw = texts.join(F.broadcast(places) if few else places, "doc").select("doc", "places", raw_tokens(F.col("text")).alias("raw"))
    there = F.transform("places", lambda at: F.struct(at.alias("dpos"), F.slice("raw", at + 1, F.lit(size)).alias("there")))
    slices = raw.select("doc", F.explode(there).alias("x")).select("doc", "x.dpos", "x.there")
    values = (
        asked.join(slices, ["doc", "dpos"])
        .join(known.select("item", "ipos", "v", "w", "slots", "roles"), ["item", "ipos", "v"])
        .select("doc", "item", "diagonal", (F.col("v") > 0).alias("opening"), F.explode(F.arrays_zip("w", "slots", "roles", "there")).alias("z"))
        .select("doc", "item", "diagonal", "opening", F.col("z.w").alias("kind"), F.col("z.roles").alias("role"), F.col("z.slots").alias("was"), F.col("z.there").alias("now"))
        .where(F.col("kind").startswith("0"))
        .distinct()
    )
    key = ["doc", "item", "diagonal"]

    def consistent(found: DataFrame, values: DataFrame) -> DataFrame:
        values = values.drop("opening").distinct()
        changed = values.groupBy(*key, "kind", "role", "was").agg(F.count("*").alias("n")).where("n > 1").select(*key)
        merged = values.where(F.col("kind") == NAME_SLOT).groupBy(*key, "now").agg(F.countDistinct("was").alias("n")).where("n > 1").select(*key)
        return covered(found.join(changed.union(merged).distinct(), key, "left_anti"))

    values = materialize(values, "slot-values")
    asked_again = consistent(with_slots.where("v = 0"), values.where(~F.col("opening"))).unionByName(consistent(with_slots, values))
    both = asked_again.unionByName(looked_for(exact_copies, "exact", exact, share)).join(items.select("item", "item_id"), "item")
    return both.groupBy("doc.doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (ascending, comma-separated), coverage of the best.

    Null and empty texts hold nothing; texts of any length are read whole; rows that repeat a doc_id get the same result each; a null doc_id
    is never contaminated; an empty table gives an empty result, an empty benchmark finds nothing; other columns are not read.
    """
    found = contaminated(docs, benchmark, size, share).groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string"))).alias("item_ids"),
        F.round(F.max("coverage"), 6).alias("coverage"),
    )
    return (
        docs.select("doc_id")
        .join(found, "doc_id", "left")
        .select(
            "doc_id",
            F.col("n_items").isNotNull().alias("contaminated"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("item_ids", F.lit("")).alias("item_ids"),
            F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        )
    )
