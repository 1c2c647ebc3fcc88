"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is a weighted set of shingles of five words; a shingle's weight is how often it occurs. Every
shingle starts a Poisson process at the rate of its weight; each arrival goes to a random component of
the signature, whose first arrival names its shingle. Arrivals are made in rounds and end early, when
they come after the latest first arrival of all components. Two signatures agree in a component with the
probability Jaccard similarity of the two sets.

Equal texts are one class from the start. A text with repeated shingles is signed twice, with and without its weights,
so that both similarities are found. In each bucket of each band all texts are compared with one hub, the text that
shares most buckets with others, which is linear in the bucket; verified links make components; buckets that still
hold several components get another hub. What is left in them are texts that are alike but were near no hub. Of
those, pairs of different components are verified unless an exact bound rules them out: how many shingles of a text no
other component holds, and maps of parities, both of which bound how far two sets are apart. So no link between bucket
mates is lost, no pair inside a component is made, and a group of loosely similar texts does not make all its pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import batches_of, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 6
HUB_ROUNDS = 2
PARITY_WORDS = 16
TOGETHER, GROUP_SETS = 16_384, 64  # shingles and sets that are signed together
KEEP_WORDS = 100_000
SIGN_ROWS, VERIFY_ROWS = 1_000, 200  # rows that a Python worker gets at a time; a row to verify holds two whole sets
CROWDED = 32  # texts of a bucket from which shingles are counted by component
BROADCAST_ROWS = 200_000  # of classes, 24 bytes each
SALTS = 8
WORD = re.compile(r"\w+")


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _Words()


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit shingle hashes and their counts; fewer words than `size` are one shingle, no word none."""
    if len(_WORDS) > KEEP_WORDS:
        _WORDS.clear()
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    hashes = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(words) - size + 1 + k])
    return np.unique(hashes, return_counts=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """For each set and component, the element of the component's first arrival; zeros for an empty set.

    Every round makes the next few arrivals of all elements still going, of all sets at once: so many in the
    first that most components are met. An element's arrivals depend on nothing but the element and its
    weight, so the grouping changes no signature.
    """
    first, owner = np.full(len(sets) * size, np.inf), np.zeros(len(sets) * size, dtype=np.uint64)
    lengths = [len(elements) for elements, _ in sets]
    active = np.concatenate([elements for elements, _ in sets])
    rate = -np.concatenate([weights for _, weights in sets]).astype(float)
    of, time, done = np.repeat(np.arange(len(sets)), lengths), np.zeros(len(active)), 0
    enough = int(size * (np.log(size) + 1)) * len(sets)
    while len(active):
        few = max(1, min(256, enough // len(active)))
        turns = np.array([((done + k + 1) * 0xD1342543DE82EF95) & (2**64 - 1) for k in range(few)], dtype=np.uint64)
        noise = _mix(active[:, None] + turns)
        times = np.log(((noise >> np.uint64(11)).astype(float) + 1) / 2.0**53) / rate[:, None]
        times[:, 0] += time
        np.cumsum(times, axis=1, out=times)
        component = ((_mix(noise ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(size)).astype(np.int64) + of[:, None] * size).ravel()
        at = times.ravel()
        better = np.flatnonzero(at < first[component])
        np.minimum.at(first, component[better], at[better])
        better = better[at[better] == first[component[better]]]
        owner[component[better]] = active[better // few]
        time, done = times[:, -1], done + few
        going = time < first.reshape(-1, size).max(axis=1)[of]
        active, rate, time, of = active[going], rate[going], time[going], of[going]
        enough = size * len(sets)
    return owner.reshape(-1, size)


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The signature of one set."""
    return signatures([(elements, weights)], size)[0]


def band_hashes(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for row in owner.reshape(bands, rows).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Jaccard similarity of the sets, and probability Jaccard similarity of the weighted sets."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    jaccard = len(both) / (len(a) + len(b) - len(both))
    if wa.max() == wa.min() == 1 and wb.max() == wb.min() == 1:
        return jaccard, jaccard
    only_a, only_b = np.delete(wa, at_a), np.delete(wb, at_b)
    pairs, n = np.unique(np.stack([wa[at_a], wb[at_b]]), axis=1, return_counts=True)
    x, y = pairs.astype(float)
    total = 0.0
    for k in range(len(n)):
        whole = (np.maximum(x / x[k], y / y[k]) * n).sum() + only_a.sum() / x[k] + only_b.sum() / y[k]
        total += n[k] / whole
    return jaccard, total


_SIGNED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("parity", T.ArrayType(T.LongType())),
    ]
)


def parity(elements: np.ndarray) -> np.ndarray:
    """A bit map of 64 * PARITY_WORDS bits, each the parity of the number of elements that hash to it.

    Two sets differ in at least as many elements as their maps differ in bits.
    """
    places = (_mix(elements ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * PARITY_WORDS)).astype(np.int64)
    bits = (np.bincount(places, minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


@F.pandas_udf(_SIGNED)
def _signed(texts: pd.Series) -> pd.DataFrame:
    """Band hashes by weighted and, where that differs, by plain shingles; sizes; parity map."""
    sets = [shingles(text) for text in texts]
    todo = [(i, elements, weights) for i, (elements, weights) in enumerate(sets) if len(elements)]
    todo += [(i, elements, np.ones_like(weights)) for i, elements, weights in todo if weights.max() > 1]
    bands: list = [np.zeros(0, dtype=np.int64)] * len(sets)
    group: list = []
    held = 0
    for one in [*sorted(todo, key=lambda x: len(x[1])), None]:
        if group and (one is None or held + len(one[1]) > TOGETHER or len(group) == GROUP_SETS):
            for (i, *_), owner in zip(group, signatures([x[1:] for x in group], BANDS * BAND_ROWS), strict=True):
                bands[i] = np.union1d(bands[i], band_hashes(owner, BANDS, BAND_ROWS))
            group, held = [], 0
        if one is not None:
            group.append(one)
            held += len(one[1])
    return pd.DataFrame(
        {
            "n": [len(elements) for elements, _ in sets],
            "total": [int(weights.sum()) for _, weights in sets],
            "bands": bands,
            "parity": [parity(elements) for elements, _ in sets],
        }
    )


def components(links: DataFrame) -> DataFrame:
    """id, root (its smallest id) of all ids in `links` (a, b), by alternating large and small stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        last = now


@F.pandas_udf(T.StructType([T.StructField("s", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.IntegerType()))]))
def _sets(texts: pd.Series) -> pd.DataFrame:
    """Shingles and, unless they are all 1, their weights."""
    found = [shingles(t) for t in texts]
    return pd.DataFrame({"s": [s.view(np.int64) for s, _ in found], "w": [None if w.max(initial=1) == 1 else w.astype(np.int32) for _, w in found]})


def _shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, s, w of the texts named by `ids` (id, doc_id of a row with that text)."""
    wanted = materialize(ids.distinct(), "shingled-ids")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text", text_id(F.col("text")).alias("id")).join(few, ["id", "doc_id"], "left_semi").dropDuplicates(["id"])
    with batches_of(docs.sparkSession, SIGN_ROWS):
        return materialize(texts.select("id", _sets("text").alias("x")).select("id", "x.s", "x.w"), "shingle-sets")


def _verified(pairs: DataFrame, owners: DataFrame, docs: DataFrame, at_least: float) -> DataFrame:
    """Those of `pairs` (a, b; the ids of texts) whose shingles are similar enough, written."""

    @F.pandas_udf("boolean")
    def alike(sa: pd.Series, wa: pd.Series, sb: pd.Series, wb: pd.Series) -> pd.Series:
        out = []
        for x, wx, y, wy in zip(sa, wa, sb, wb, strict=True):
            wx = np.ones(len(x), dtype=int) if wx is None else np.asarray(wx)
            wy = np.ones(len(y), dtype=int) if wy is None else np.asarray(wy)
            out.append(max(similarity(np.asarray(x), wx, np.asarray(y), wy)) >= at_least - 1e-12)
        return pd.Series(out, dtype=bool)

    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = _shingle_sets(named.join(owners, "id"), docs)
    left = known.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa"))
    right = known.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb"))
    with batches_of(docs.sparkSession, VERIFY_ROWS):
        return materialize(pairs.join(left, "a").join(right, "b").where(alike("sa", "wa", "sb", "wb")).select("a", "b"), "links")


def text_id(text: Column) -> Column:
    """What a text is known by: 64 bits of hash."""
    return F.xxhash64(text)


def _most_apart(at_least: float, prefix: str = "hub_") -> Column:
    """How many elements two similar sets differ in at most.

    Of unweighted sets (n + m) * (1 - s) / (1 + s). If the parts p and q of two masses are not shared, the probability
    Jaccard similarity is (1 - p) * (1 - q) / (1 - p * q) at most, which holds p + q to 2 * (1 - s) / (1 + s).
    """
    weighted = (F.col("n") != F.col("total")) | (F.col(f"{prefix}n") != F.col(f"{prefix}total"))
    share = (1 - at_least) / (1 + at_least)
    plain = (F.col("n") + F.col(f"{prefix}n")) * share
    return F.when(weighted, F.greatest(plain, F.greatest("total", f"{prefix}total") * 2 * share)).otherwise(plain) + 1e-9


def _may_share(at_least: float, prefix: str = "hub_") -> Column:
    """False if the shingles that each text shares with other components (number `common`, mass `common_total`) are too few."""
    n, m, total, other = F.col("n"), F.col(f"{prefix}n"), F.col("total"), F.col(f"{prefix}total")
    both = F.least("common", f"{prefix}common")
    weighted = (n != total) | (m != other)
    p = F.greatest((total - F.col("common_total")) / total, (n - both) / total)
    q = F.greatest((other - F.col(f"{prefix}common_total")) / other, (m - both) / other)
    plain = both >= at_least * (n + m - both) - 1e-9
    return plain | (weighted & ((1 - p) * (1 - q) >= at_least * (1 - p * q) - 1e-9))


def _common_shingles(here: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame | None:
    """id, common, common_total of the texts in crowded buckets: shingles that another component in such buckets holds too."""
    crowded = here.groupBy("band_hash").agg(F.count("*").alias("k")).where(F.col("k") > CROWDED).select("band_hash")
    members = materialize(here.join(crowded, "band_hash", "left_semi").select("id", "root").distinct(), "crowd")
    if members.isEmpty():
        return None
    known = _shingle_sets(members.join(owners, "id").select("id", "doc_id"), docs).join(members, "id")
    ones = F.transform("s", lambda x: F.lit(1))
    each = known.select("id", "root", F.explode(F.arrays_zip("s", F.coalesce("w", ones).alias("w"))).alias("x")).select("id", "root", "x.s", "x.w")
    shared = each.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")
    held = each.join(shared, "s", "left_semi").groupBy("id").agg(F.count("*").alias("common"), F.sum("w").alias("common_total"))
    left = members.select("id").join(held, "id", "left")
    return materialize(left.select("id", F.coalesce("common", F.lit(0)).alias("common"), F.coalesce("common_total", F.lit(0)).alias("common_total")), "common-shingles")


def _links(distinct: DataFrame, docs: DataFrame, at_least: float) -> DataFrame | None:
    """id, root of the texts that are linked with others; None if there are none."""
    rows = distinct.select("id", "n", "total", F.explode("bands").alias("band_hash"))
    shared = rows.groupBy("band_hash").agg(F.count("*").alias("k")).where("k > 1")
    central = F.sum("k").over(Window.partitionBy("id"))  # of a text: at most 2 * BANDS rows
    mates = materialize(rows.join(shared, "band_hash").withColumn("central", central).drop("k"), "bucket-mates")
    owners = distinct.select("id", "doc_id")
    maps = distinct.select("id", *(F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)))
    apart = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"hub_p{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    fits = F.abs(F.col("n") - F.col("hub_n")) <= _most_apart(at_least)
    labels = links = tested = used = None
    for turn in range(HUB_ROUNDS + 1):
        here = mates.withColumn("root", F.col("id")) if labels is None else mates.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        if labels is not None:
            mixed = here.groupBy("band_hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band_hash")
            here = materialize(here.join(mixed, "band_hash", "left_semi"), "mixed-buckets")
        if turn < HUB_ROUNDS:
            if used is None:
                fresh = here.withColumn("was_hub", F.lit(False))
            else:
                fresh = here.join(used.withColumn("was_hub", F.lit(True)), "id", "left").withColumn("was_hub", F.coalesce("was_hub", F.lit(False)))
            hubs = fresh.groupBy("band_hash").agg(F.min(F.struct("was_hub", (-F.col("central")).alias("o"), "id", "root", "n", "total")).alias("hub"))
            hubs = materialize(hubs.select("band_hash", F.col("hub.id").alias("hub"), *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("root", "n", "total"))), "hubs")
            used = hubs.select(F.col("hub").alias("id")).distinct() if used is None else used.union(hubs.select(F.col("hub").alias("id"))).distinct()
            met = here.join(hubs, "band_hash").where((F.col("hub_root") != F.col("root")) & fits)
        else:
            common = _common_shingles(here, owners, docs)
            if common is None:
                here = here.withColumn("common", F.col("n")).withColumn("common_total", F.col("total"))
            else:
                here = here.join(common, "id", "left").withColumn("common", F.coalesce("common", "n")).withColumn("common_total", F.coalesce("common_total", "total"))
            # A text that shares too little with all others has no mates.
            kept = ("id", "root", "n", "total", "common", "common_total")
            alone = F.col("common") < at_least * F.col("n") - 1e-9
            here = here.where(~alone | (F.col("n") != F.col("total"))).join(maps, "id").select("band_hash", *kept, *(f"p{k}" for k in range(PARITY_WORDS)))
            here = materialize(here, "open-mates")
            others = here.select("band_hash", F.col("id").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in here.columns if c not in ("band_hash", "id")))
            may = fits & _may_share(at_least) & (apart <= _most_apart(at_least))
            met = here.join(others, "band_hash").where((F.col("hub") > F.col("id")) & (F.col("hub_root") != F.col("root")) & may)
        pairs = met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        found = _verified(pairs, owners, docs, at_least)
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = materialize(components(links), "labels")
    return labels


def near_duplicates(docs: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its class), kept (it is that one).

    Two texts are linked if the Jaccard or the probability Jaccard similarity of their shingles is at least
    `at_least`, or if they are equal (by 64 bits of hash); classes are the connected components. Every row is judged by
    its own text, so rows that repeat a doc_id with different texts may be in different classes. A row with a null text is
    in no class but its own; one with a null id has a null class and is kept. An empty table gives an empty result.
    Texts without a word are equal to none but their copies. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    usable = rows.where(known)
    with batches_of(docs.sparkSession, SIGN_ROWS):
        signed = usable.select("doc_id", text_id(F.col("text")).alias("id"), _signed("text").alias("x"))
        signed = materialize(signed.select("doc_id", "id", "x.n", "x.total", "x.bands", "x.parity"), "signatures")
    first = signed.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    distinct = signed.join(first.select("id", "doc_id"), ["id", "doc_id"], "left_semi").dropDuplicates(["id"])
    labels = _links(distinct, usable, at_least)
    if labels is None:
        labels = first.select("id", F.col("id").alias("root")).limit(0)
    rooted = first.join(labels, "id", "left").where(F.col("root").isNotNull() | (F.col("copies") > 1)).withColumn("root", F.coalesce("root", "id"))
    rooted = materialize(rooted.select("id", "root", "doc_id"), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = materialize(rooted.join(smallest, "root").select("id", "class_id"), "classes")
    ids = signed.select("doc_id", "id")
    if classes.count() <= BROADCAST_ROWS:
        classed = ids.join(F.broadcast(classes), "id", "left")
    else:  # copies of one text are dealt over several tasks
        salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        classed = ids.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("long")).join(salted, ["id", "salt"], "left")
    classed = classed.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    alone = rows.where(~known).select("doc_id", F.col("doc_id").alias("class_id"))
    return classed.unionAll(alone).withColumn("kept", F.col("doc_id").isNull() | (F.col("class_id") == F.col("doc_id")))
