"""Training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import calendar
import collections
import hashlib
import itertools
import random
import re
import time
import zlib
from datetime import date

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import ann, decontaminate, html_text, language_id, line_dedup, near_dedup, packing, pii, quality, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, id long, h long"


def _docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, "   "), (4, "the same words again and again in this long enough line of text"), (5, "the same words again and again in this long enough line of text"), (6, "ab " * 30_000), (7, "a" * 50_000), (None, "no id here, but a text that is long enough to be compared")]


def test_edge_cases_keep_every_row_of_an_empty_table(spark):
    docs, labels = _docs(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for found in (token_counts.token_counts(docs, PIECES), near_dedup.near_duplicates(docs), line_dedup.dedup_lines(docs), decontaminate.decontaminate(docs, benchmark), pii.pseudonymize(docs, "k"), quality.quality(docs, labels), language_id.language_id(docs, PIECES), packing.pack(docs, WORDS)):
        assert found.count() == 0


def test_edge_cases_have_defined_results(spark):
    rows = [*EDGES, EDGES[3]]  # null, empty and very long texts, equal texts, a repeated row, a null id, columns with clashing names
    docs, text = _docs(spark, rows), dict(EDGES)
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, None)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, None), (2, "short"), (None, "x"), (3, text[4]), (3, text[4])], "item_id long, text string")

    def by_id(found, *columns):
        out = collections.defaultdict(list)
        for r in found.collect():
            out[r["doc_id"]].append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
        assert sum(map(len, out.values())) == len(rows)
        return out

    counts = by_id(token_counts.token_counts(docs, PIECES), "n_bytes", "n_tokens", "over_limit")
    assert counts[1] == counts[2] == [(0, 0, False)] and counts[6][0][2] and counts[4][0] == counts[5][0] and len(counts[4]) == 2
    classes = by_id(near_dedup.near_duplicates(docs), "class_id", "kept")
    assert classes[1] == [(1, True)] and classes[4] == [(4, True)] * 2 and classes[5] == [(4, False)] and classes[None] == [(None, True)]
    lines = by_id(line_dedup.dedup_lines(docs), "text", "n_lines", "n_removed")
    assert lines[1] == [(None, 0, 0)] and lines[2] == [("", 1, 0)] and lines[5] == [("", 1, 1)] and lines[7] == [(text[7], 1, 0)] and lines[None] == [(text[None], 1, 0)]
    found = by_id(decontaminate.decontaminate(docs, benchmark), "contaminated", "n_items", "item_ids", "coverage")
    assert found[4] == [(True, 1, "3", 1.0)] * 2 and found[1] == found[2] == found[6] == found[None] == [(False, 0, "", 0.0)]
    moved = by_id(pii.pseudonymize(docs, "k"), "text", "n_replaced")
    assert moved == {i: [(t, 0)] * (2 if i == 4 else 1) for i, t in EDGES}
    judged = by_id(quality.quality(docs, labels), "score", "predicted")
    assert all(0 <= s <= 1 and p == (s >= 0.3) for x in judged.values() for s, p in x) and judged[1] == judged[2]
    spoken = by_id(language_id.language_id(docs, PIECES), "lang_pred", "score")
    assert all(x == ("und", 0.0) for v in spoken.values() for x in v)  # nothing is labelled, so no language is known
    packed = packing.pack(docs, WORDS).collect()
    assert {(r["doc_id"], r["length"]) for r in packed if r["doc_id"] in (1, 2)} == {(1, 1), (2, 1)}
    assert sum(r["piece"] == 0 for r in packed) == len(rows) and sum(r["doc_id"] == 4 for r in packed) == 2


def test_token_counts_equal_the_library(spark, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    texts = ["".join(rng.choice(" ▁  abcdeſéß日本\n\t0123.,<s></s>😀ing the") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    machine = token_counts.machine(PIECES)
    for chunk in (65_536, 13):
        monkeypatch.setattr(token_counts, "CHUNK_CHARS", chunk)
        assert [machine.count(t) for t in texts] == [len(x) for x in model.encode(texts)]


def test_state_maps_compose(monkeypatch):
    """Maps of chunks, composed in any way, are the map of the whole; a run without boundaries is read once."""
    rng = random.Random(6)
    machine = token_counts.machine(PIECES)
    start = machine.start[""]
    for _ in range(60):
        text = "▁" + "".join(rng.choice("abcdeing▁▁\nst日") for _ in range(rng.randint(3, 60)))
        cuts = sorted(rng.sample(range(1, len(text)), 2))
        a, b, c = (token_counts.ChunkMap(machine, x) for x in (text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]))
        one, other = token_counts.compose(token_counts.compose(a, b), c), token_counts.compose(a, token_counts.compose(b, c))
        assert one[start] == other[start] and one[start][1] == machine.tokens(text)
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 1000)
    walked, walk = [], token_counts.Transducer.walk
    monkeypatch.setattr(token_counts.Transducer, "walk", lambda self, row, text: walked.append(len(text)) or walk(self, row, text))
    assert machine.count("ab" * 100_000) > 0 and sum(walked) == 200_001


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, WORDS).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    by_doc = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = model.encode(d["text"], add_special_tokens=False).ids + [1]
        for r in by_doc[d["doc_id"]]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        assert sum(r["length"] for r in by_doc[d["doc_id"]]) == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 4096) + 2


def test_packing_plan_places_everything_once():
    rng = random.Random(1)
    histogram = dict(collections.Counter(rng.randint(1, 4096) for _ in range(5000)))
    runs, used = packing.plan(histogram, 4096, 40)
    placed, bins = collections.Counter(), collections.defaultdict(list)
    for length, _, pieces, first, each, offset in runs:
        placed[length] += pieces
        for k in range(pieces):
            bins[first + k // each].append((offset + k % each * length, length))
    assert placed == histogram and len(bins) == used
    for parts in bins.values():
        assert max(o + n for o, n in parts) == sum(n for _, n in parts) <= 4096
    assert used <= 1.05 * sum(n * k for n, k in histogram.items()) / 4096  # half of the lengths leave no room for a second of their like


def test_language_id_is_right_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.language_id(docs, PIECES).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.9 * found.count()


def test_segmentations_are_summed():
    pieces = {"▁": 0.2, "▁a": 0.3, "a": 0.25, "b": 0.15, "ab": 0.1}
    scorer = language_id.Scorer({"x": pieces})
    expected = 0.2 * 0.25 * 0.15 + 0.2 * 0.1 + 0.3 * 0.15
    assert np.isclose(np.exp(scorer.log_words(["ab"])[0, 0]), expected)
    counts, _ = language_id.expected_pieces({"ab": 1}, pieces, 2)
    assert np.isclose(counts["▁a"], 0.3 * 0.15 / expected)


def test_quality_is_right_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs, labels).where("held_out").join(labels, "doc_id")
    assert found.where("predicted = quality").count() >= 0.9 * found.count()


def test_attention_gradient():
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, 5)) for n in (1, 3, 4)]
    labels = np.array([0.0, 1.0, 1.0])
    model = quality.GatedAttention.fit(bags, labels, hidden=4, gate=3, epochs=1)
    weights = model.weights

    def loss(w):
        sizes = np.array([len(b) for b in bags])
        y = model._forward(w, np.concatenate(bags), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)[-1]
        return -(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean()

    gradient = model._gradient(weights, bags, labels)
    for name in model.NAMES:
        flat = np.atleast_1d(weights[name]).ravel()
        for i in range(min(3, flat.size)):
            up, down = flat.copy(), flat.copy()
            up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
            there = [loss(weights | {name: x.reshape(np.shape(weights[name]))}) for x in (up, down)]
            assert np.isclose((there[0] - there[1]) / 2e-5, np.atleast_1d(gradient[name]).ravel()[i], atol=1e-6)


def test_nearest_recall_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype("float32")
    x[100:180] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (5, [float(v) for v in x[5]])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20).collect()
    by_query = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        scores = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:20]
        hits += len(set(best) & {v for v, _ in by_query[q]})
        assert by_query[q] == sorted(by_query[q], key=lambda p: (-p[1], p[0])) and len(by_query[q]) == 20
    assert hits >= 0.9 * 600 and set(by_query) == set(range(0, 600, 20))


def test_nearest_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    found = collections.defaultdict(dict)
    for r in ann.nearest(table, code_block=512, query_block=64).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hits = asked = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        hits += len({int(ids[i]) for i in best} & found[ids[q]].keys())
        asked += len(best)
        assert all(np.isclose(s, scores[list(ids).index(v)], rtol=1e-12) for v, s in list(found[ids[q]].items())[:3])
    assert hits >= 0.97 * asked


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1e300, 1.0]), (3, [1.0, 2.0, 3.0]), (20, [3.0, 2.0, 1.0]), (40, []), (5, [float("inf"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, class_id long, v long")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table).collect())
    assert found == [(0, 1, 2, 1e300 + 2.0), (0, 2, 1, 4.0), (20, 1, 3, 10.0)]
    assert ann.nearest(table.limit(0)).columns == ["query_id", "rank", "vec_id", "score"] and ann.nearest(table.limit(0)).count() == 0


def test_nearest_misses_none_whatever_the_vectors_are(spark):
    rng = np.random.default_rng(6)
    even = rng.normal(size=(1200, 32))
    even /= np.linalg.norm(even, axis=1, keepdims=True)
    huge = even.copy()
    huge[-1] *= 1e30
    kinds = (even, huge, (rng.random((1200, 32)) < 0.08).astype(float))
    for x in kinds:
        x = x[(x != 0).any(axis=1)]
        found = collections.defaultdict(list)
        table = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        for r in sorted(ann.nearest(table, n_books=4, n_words=16, rerank=24, code_block=400, query_block=32).collect(), key=lambda r: (r["query_id"], r["rank"])):
            found[r["query_id"]].append(r["vec_id"])
        for q in range(0, len(x), 20):
            scores = sum(x[:, d] * x[q, d] for d in range(32))
            assert found[q] == [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]


def _shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else collections.Counter()


def _similarities(a, b):
    """Jaccard and probability Jaccard similarity of two weighted sets, from their definitions."""
    both = a.keys() & b.keys()
    if not both:
        return 0.0, 0.0
    plain = len(both) / len(a.keys() | b.keys())
    if max(a.values()) == max(b.values()) == 1:
        return plain, plain
    return plain, sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in both)


def _classes_by_hand(rows, similar=0.8):
    """A class (its smallest id) for each id."""
    sets = {i: _shingles(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i in sorted(rows):
        for j in {j for e in sets[i] for j in holders[e]} | {j for j in rows if j < i and rows[j] == rows[i]}:
            if rows[i] == rows[j] or max(_similarities(sets[i], sets[j])) >= similar - 1e-12:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
        for e in sets[i]:
            holders[e].append(i)
    return {i: root(i) for i in rows}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = _classes_by_hand({r["doc_id"]: r["text"] for r in docs.collect()})
    found = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == expected
    assert {r["doc_id"] for r in found if r["kept"]} == set(expected.values())


def test_near_duplicates_of_loose_groups(spark, monkeypatch):
    """Many variants of one text, few of them near each other; and texts whose shingles repeat."""
    monkeypatch.setattr(near_dedup, "CROWDED", 3)
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(220)]
    rows = {}
    for i in range(260):
        text = list(base)
        for _ in range(rng.choice((1, 2, 6, 7, 8, 9))):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows[i] = " ".join(text)
    plain, phrase = " ".join(rng.choice(words) for _ in range(300)), " ".join(rng.choice(words) for _ in range(5))
    rows |= {1000: plain, 1001: f"{plain} {' '.join([phrase] * 60)}", 1002: f"{plain} {phrase}", 1003: " ".join([phrase] * 50), 1004: " ".join([phrase] * 40)}
    pairs = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(_docs(spark, list(rows.items()))).collect()}
    expected = _classes_by_hand(rows)
    assert found == expected and 20 < len(set(expected.values())) < 240
    assert expected[1001] == 1000 and expected[1004] == 1003
    assert sum(pairs) < 8 * len(rows)


def test_near_duplicates_of_more_classes_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklm") for _ in range(60)) for _ in range(20)]
    rows = {i: texts[i % 20] + " n" * (i // 20 == 3) for i in range(80)}
    docs = _docs(spark, [*rows.items(), (100, None), (101, ""), (None, texts[0])])
    expected = sorted(near_dedup.near_duplicates(docs).collect(), key=str)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert sorted(near_dedup.near_duplicates(docs).collect(), key=str) == expected
    assert {r["doc_id"]: r["class_id"] for r in expected if r["doc_id"] is not None} == {i: i % 20 for i in rows} | {100: 100, 101: 101}


def test_probability_jaccard():
    rng = np.random.default_rng(3)
    elements = np.unique(rng.integers(1, 2**62, 300).astype(np.uint64))
    wa, wb = rng.integers(1, 4, len(elements)), rng.integers(1, 4, len(elements))
    a, b = slice(0, 250), slice(50, None)
    _, exact = near_dedup.similarity(elements[a], wa[a], elements[b], wb[b])
    wide_a, wide_b = np.where(np.arange(len(elements)) < 250, wa, 0).astype(float), np.where(np.arange(len(elements)) >= 50, wb, 0).astype(float)
    slow = sum(1 / np.maximum(wide_a / wide_a[d], wide_b / wide_b[d]).sum() for d in range(50, 250))
    assert np.isclose(exact, slow)
    same = near_dedup.signature(elements[a], wa[a], 4096) == near_dedup.signature(elements[b], wb[b], 4096)
    assert abs(same.mean() - exact) < 0.04


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def _near_lines(a, b):
    """The rule of line dedup, said plainly."""
    x, y = a.split(" "), b.split(" ")
    if (len(x) < 16) != (len(y) < 16):
        return a == b
    if len(x) < 16:
        return abs(len(a) - len(b)) <= 1 and _edits(a, b) <= 1
    n = min(len(x), len(y))
    allowed = int(min(n // 16, (n / 4) ** 0.5, 30))
    return abs(len(x) - len(y)) <= allowed and _edits(x, y) <= allowed


def _dedup_by_hand(rows):
    """doc_id -> text without the removed lines, for rows in the order of their ids."""
    seen, out = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            norm = line.strip(line_dedup.OUTER).lower()
            if len(norm) < 40 or not any(_near_lines(norm, s) for s in seen):
                kept.append(line)
            if len(norm) >= 40:
                seen.append(norm)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("crowded", [1, 32])
def test_line_dedup_equals_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef ") for _ in range(60)).strip() + "xyz" for _ in range(12)]

    def changed(line):
        at = rng.randrange(len(line))
        return rng.choice([line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "w" + line[at + 1 :], line])

    docs = [(i, "\n".join([changed(changed(rng.choice(base))) for _ in range(4)] + ["short"])) for i in range(40)]
    expected = _dedup_by_hand(docs)
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(_docs(spark, docs)).collect()}
    assert found == expected


@pytest.mark.parametrize("crowded", [1, 32])
def test_line_dedup_finds_changed_words_at_every_length(spark, monkeypatch, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(60)]

    def changed(line):
        parts = line.split(" ")
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(parts))
            parts[at : at + 1] = rng.choice([[], [rng.choice(words)], [parts[at], rng.choice(words)[:3]], [parts[at] + "s"]])
        return " ".join(parts)

    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (8, 12, 15, 17, 31, 32, 33, 49, 64, 67, 101, 150)]
    base.append(" ".join(base[8].split()[:32] + base[9].split()[32:]))
    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(6))) for i in range(26)]
    expected = _dedup_by_hand(rows)
    lines = [line for _, text in rows for line in text.split("\n")]
    kept = [line for text in expected.values() for line in text.split("\n") if line]
    assert 20 < len(kept) < len(lines) - 40 and len(set(lines)) > len(kept) + 30
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()} == expected


def test_bit_parallel_edit_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice([[], ["a"], ["b"]])
        rows.append((a, b, rng.randint(0, 30 if rng.random() < 0.1 else 6)))
    table = spark.createDataFrame(rows, "a array<string>, b array<string>, t int")
    width = F.col("t") * 2 + 1
    near = line_dedup.edits_within(F.col("a"), F.col("b"), F.col("t"), F.size("a") - F.size("b"), width, F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1)
    found = table.select("a", "b", "t", near.alias("near")).collect()
    assert all(r["near"] == (_edits(r["a"], r["b"]) <= r["t"]) for r in found)


def test_decontamination_checks_slots(spark):
    benchmark = spark.createDataFrame([(1, "If Alice has 12 apples and Bob gives her 5 kg more how many apples does Alice have now")], "item_id long, text string")
    docs = [
        (1, "Well. If Carol has 99 apples and Dave gives her 7 kg more how many apples does Carol have now? ok"),
        (2, "If Carol has 99 apples and Dave gives her 7 kg more how many apples does Erin have now"),
        (3, "nothing of the kind is in here at all"),
    ]
    found = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.decontaminate(_docs(spark, docs), benchmark).collect()}
    assert found == {1: (True, "1"), 2: (False, ""), 3: (False, "")}


def test_decontamination_finds_copies_of_any_item(spark):
    items = [(1, "What is 12 + 7 * 3 - 5 + 16"), (2, "Compute 14 * 23 + 7"), (3, "If Alice has 12 apples and Bob gives her 5 kg more how many apples does Alice have now"), (4, "A man buys 5 kg of flour and then 5 apples for the cake he bakes")]
    docs = [
        (1, "so, what is 12 + 7 * 3 - 5 + 16? who knows"),
        (2, "Please compute 14 * 23\n + 7 today"),
        (3, items[2][1].lower()),
        (4, "If  Alice has 99 apples and\nBob gives her 7 kg more how many apples does\n Alice have now"),
        (5, "A man buys 7 kg of flour and then 9 apples for the cake he bakes"),
        (6, "what is 12 + 8 * 3 - 5 + 16, compute 14 * 24 + 7"),
        (7, None),
    ]
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.decontaminate(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {1: "1", 2: "2", 3: "3", 4: "3", 5: "4", 6: "", 7: ""}


def test_decontamination_of_odd_items(spark):
    """Items that begin with a name, repeat an id, or merge two names; rows that repeat a doc_id."""
    items = [(1, "Alice has 12 apples and 5 pears left"), (2, "Two plus two equals"), (3, "What is 12 + 35 * 7 - 9 / 4 ?"), (4, "the first text of item four is about a river"), (4, "another text of item four is about a green hill"), (None, "no id"), (5, None)]
    items.append((6, "Today Alice and Bob walk with Carol to the old mill where Alice meets Bob and Carol again"))
    docs = [
        (1, "They said that Alice has 12 apples and 5 pears left today"),
        (2, "They said that Carol has 7 apples and 9 pears left today"),
        (3, "two plus two equals four"),
        (4, "Well: what is 12 + 35 * 7 - 9 / 4 ? Tell"),
        (5, "the first text of item four is about a river"),
        (6, "another text of item four is about a green hill"),
        (7, "Today Dora and Erik walk with Fred to the old mill where Dora meets Erik and Fred again"),
        (8, "Today Dora and Dora walk with Dora to the old mill where Dora meets Dora and Dora again"),
        (9, "nothing here"),
        (9, "so Zoe has 1 apples and 1 pears left"),
    ]
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.decontaminate(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {1: "1", 2: "1", 3: "2", 4: "3", 5: "4", 6: "4", 7: "6", 8: "", 9: "1"}


def _template(text):
    """Template tokens, the raw tokens behind them, and whether they open a sentence, token by token."""
    text = re.sub(r"\s+", " ", text or "")
    out, at, after_number = [], 0, False
    for m in re.finditer(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", text):
        word = m[0]
        if word[0].isdigit():
            kind = "0n"
        elif after_number and text[at : m.start()] in ("", " ") and re.fullmatch(decontaminate.UNITS, word, re.IGNORECASE):
            kind = "0u"
        elif m.start() > 1 and text[m.start() - 1] == " " and re.match(r"[^\W_]|,", text[m.start() - 2]) and re.fullmatch(r"[^\W\d_]+", word) and word[0].isupper() and word[1:].islower() and len(word) > 1:
            kind = "0p"
        else:
            kind = word.lower()
        opens = kind == word.lower() and bool(re.fullmatch(r"[^\W\d_]{2,}", word)) and word[0].isupper() and word[1:].islower()
        out.append((kind, word.lower(), opens))
        at, after_number = m.end(), kind == "0n"
    return out


def _readings(tokens):
    """All readings of a window: its tokens, and which of them are openings read as names."""
    free = [k for k, x in enumerate(tokens) if x[2]]
    for n in range(len(free) + 1):
        for names in itertools.combinations(free, n):
            yield tuple("0p" if k in names else x[0] for k, x in enumerate(tokens)), names


def _contaminated_by_hand(docs, items):
    """(document, item) pairs by the rule of decontamination, said plainly."""
    known = []
    for i, text in items:
        tokens = _template(text)
        if not tokens:
            continue
        after = [k if k in ("0n", "0p") else r for k, r, _ in tokens[1:]] + [""]
        roles = [after[n] if kind == "0n" else "" for n, (kind, _) in enumerate(t[:2] for t in tokens)]
        size = min(5, len(tokens))
        exact = [tuple(r for _, r, _ in tokens[n : n + size]) for n in range(len(tokens) - size + 1)]
        windows = []
        for n in range(len(tokens) - 4):
            part = tokens[n : n + 5]
            for w, names in _readings(part):
                if sum(x[0][0] == "0" for x in part) * 2 < 5 and sum(k[0] == "0" for k in w) <= 3:
                    windows.append((n, w, [r for _, r, _ in part], roles[n : n + 5], bool(names)))
        known.append((i, size, exact, windows, len({w[0] for w in windows})))
    found = set()
    for d, text in docs:
        tokens = _template(text)
        raw = [r for _, r, _ in tokens]
        at = collections.defaultdict(list)
        for n in range(len(tokens) - 4):
            for w, _ in _readings(tokens[n : n + 5]):
                at[w].append(n)
        there = {size: {tuple(raw[n : n + size]) for n in range(len(raw) - size + 1)} for size in range(1, 6)}
        for i, size, exact, windows, n_windows in known:
            if sum(w in there[size] for w in exact) >= 0.8 * len(exact):
                found.add((d, i))
                continue
            every = [(n, dn, was, w, roles, opening) for n, w, was, roles, opening in windows for dn in at.get(w, ())]
            for hits in (every, [h for h in every if not h[5]]):
                if not hits or len({h[0] for h in hits}) < 0.8 * n_windows:
                    continue
                values = collections.defaultdict(set)
                for n, dn, was, w, roles, _ in hits:
                    values[dn - n] |= {(w[k], roles[k], was[k], raw[dn + k]) for k in range(5) if w[k][0] == "0"}
                good = {
                    diagonal
                    for diagonal in {h[1] - h[0] for h in hits}
                    if len({v[:3] for v in values[diagonal]}) == len(values[diagonal])
                    and len({v[3] for v in values[diagonal] if v[0] == "0p"}) == len({(v[2], v[3]) for v in values[diagonal] if v[0] == "0p"})
                }
                if len({h[0] for h in hits if h[1] - h[0] in good}) >= 0.8 * n_windows:
                    found.add((d, i))
    return found


def test_decontamination_finds_items_with_other_names_and_numbers(spark):
    """Questions of several sentences, asked again with other names and numbers: nine in ten are found, and no other text."""
    rng = random.Random(6)
    verbs = ["has", "buys", "sells", "finds", "paints", "counts", "carries", "borrows", "washes", "packs", "sorts", "draws"]
    things = ["apples", "marbles", "stamps", "books", "boxes", "shells", "candles", "ribbons", "pencils", "plates", "coins", "lamps"]
    names = ["Lena", "Julia", "Max", "Oskar", "Nina", "Paul", "Rosa", "Emil", "Clara", "Hugo", "Frida", "Anton"]

    def asked(shape, names, numbers):
        v, t = shape
        a, b = names
        x, y, z = numbers
        return f"{a} {v[0]} {x} {t[0]} near the {t[1]}. {b} {v[1]} {y} {t[2]} for her. {a} {v[2]} {z} of them at the old market. How many {t[0]} does {a} keep if {b} {v[3]} the {t[3]}?"

    shapes = [(rng.sample(verbs, 4), rng.sample(things, 4)) for _ in range(40)]
    items = [(i, asked(s, rng.sample(names, 2), rng.sample(range(2, 90), 3))) for i, s in enumerate(shapes)]
    docs = [(i, "So it was. " + asked(s, rng.sample(names, 2), rng.sample(range(100, 900), 3)) + " That is all.") for i, s in enumerate(shapes)]
    docs += [(100 + i, asked((rng.sample(verbs, 4), rng.sample(things, 4)), rng.sample(names, 2), (3, 4, 5))) for i in range(40)]
    two = asked(shapes[0], ["Nora", "Ivan"], [501, 502, 503])
    docs.append((200, two.replace("Nora", "Kim", 1)))  # one person of the item would be two
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in found for i in range(40)) >= 36 and not {f for f in found if f[0] != f[1]}


def test_decontamination_equals_brute_force(spark):
    """Every item against every document of the small table, with some documents that ask items again."""
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(10_000 + i, t) for i, t in enumerate(("If Alice has 12 apples and Bob gives her 5 kg more how many apples does Alice have now", "A man buys 5 kg of flour and then 5 apples for the cake he bakes", "Mary has 3 cats", "Tom and Ann share 8 nuts with Tom", "Tom has 3 nuts. Ann gives Tom 4 of hers. Mary eats 2 nuts and sleeps."))]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    names = ["Zoe", "Max", "Ida", "Tom", "Ann"]
    for i, t in items:
        for k in range(3):
            again = re.sub(r"\d+", lambda m: str(rng.randint(1, 9)), re.sub(r"\b(Alice|Bob|Mary|Tom|Ann)\b", lambda m: rng.choice(names), t))
            words = again.split()
            if k == 2:
                words[rng.randrange(len(words))] = "changed"
            docs.append((100_000 + 3 * i + k, f"Well then, {' '.join(words)} and so on"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == _contaminated_by_hand(docs, items) and len(found) > 20


def test_decontamination_reads_likely_documents_only(spark, monkeypatch):
    """Templates are made of documents that hold a pair of words of an item; items without such pairs are looked for in all."""
    items = [(1, "If Alice has 12 apples and Bob gives her 5 kg more how many apples does Alice have now"), (2, "Today Mary walks to the old mill, where 7 men wait"), (3, "οδος ΚΑΙ νερο και αλλα πεντε λογια εδω στην ωρα")]
    odd = [(4, "12 + 7 = 19"), (5, "x² plus 5y² is 7z² or 9")]
    docs = [
        (1, "x.If Carol has 3apples and Dave gives her 7kg more how\n many apples does Carol have now"),
        (2, "'Today Ruth walks to the old mill,where 91men wait"),
        (3, "so ΟΔΟΣ και Νερο ΚΑΙ αλλα: πεντε λογια εδω στην ωρα 5"),
        (4, "it says 12+7=19 there"),
        (5, "that x² plus 5y² is 7z² or 9 is so"),
        (6, "the river runs to the green sea and nothing else is to be said of it"),
        (7, "5"), (8, ""), (9, None), (10, "If"),
    ]
    read, whole = [], decontaminate.template_hits
    monkeypatch.setattr(decontaminate, "template_hits", lambda texts, *more: read.append(texts.count()) or whole(texts, *more))

    def found(items):
        table = spark.createDataFrame(items, "item_id long, text string")
        return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(_docs(spark, docs), table).collect()}

    assert found(items) == {(1, 1), (2, 2), (3, 3)} and read[0] <= 4
    assert found(items + odd) == {(i, i) for i in range(1, 6)}
    words = spark.createDataFrame([(["the", "old", "mill", "0n", "men"],), (["a", "0n", "b", "0p", "c"],), (["οδος", "και", "x²", "b", "0n"],)], "w array<string>")
    pairs = words.select(decontaminate.best_pair(F.col("w"), 5).alias("p"), F.xxhash64(F.lit("old"), F.lit("mill")).alias("h")).collect()
    assert pairs[0]["p"].asDict() == {"n": 7, "h": pairs[0]["h"]} and pairs[1]["p"] is None and pairs[2]["p"] is None


def _luhn(digits):
    worth = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
    return sum(worth) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    rows = [(1, "card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112."), (2, "call +1 (499) 555-6503 at 97.51.17.173 or x.y@mail7.example.com on 1987-02-28 not 1987-02-30")]
    found = {r["doc_id"]: r for r in pii.pseudonymize(_docs(spark, rows), "k").collect()}
    spaced, plain = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", found[1]["text"])[:2]
    assert spaced.replace(" ", "") == plain != "4111111111111111" and _luhn(plain) and "4111111111111112" in found[1]["text"]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} at (\d+\.){3}\d+ or u[0-9a-f]{7}@d[0-9a-f]{8}\.invalid on \d{4}-\d\d-\d\d not 1987-02-30", found[2]["text"])
    assert "555-6503" not in found[2]["text"] and found[2]["n_replaced"] == 4


def test_feistel_is_a_permutation(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert numbers.select(pii.permute_digits(F.col("d"), "k", "t").alias("p")).distinct().where("p rlike '^[0-9]{3}$'").count() == 1000
    days = spark.range(65_536).select(pii.permute_number(F.col("id"), 256, "k", "t").alias("p"))
    assert days.distinct().where("p between 0 and 65535").count() == 65_536


def test_pseudonyms_stay_within_their_format(spark):
    """Every pseudonym is a value that its kind's pattern and check admit; equal values stay equal, others never meet."""
    rng = random.Random(5)
    ssn = [f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(400)]
    phones = [f"({rng.randint(200, 999)}) {rng.randint(100, 999)}-{rng.randint(0, 9999):04d}" for _ in range(200)] + [f"+{rng.randint(10**10, 10**11)}" for _ in range(100)]
    dates = [f"{rng.randint(1000, 2999)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(300)]
    cards = []
    for _ in range(100):
        payload = str(rng.randint(10**14, 10**15 - 1))
        cards.append(next(payload + str(c) for c in range(10) if _luhn(payload + str(c))))
    for kind, values in (("ssn", ssn), ("phone", phones), ("date", dates), ("card", cards)):
        rows = spark.createDataFrame([(i, f"so {v} , and") for i, v in enumerate(values)], "doc_id long, text string")
        found = {r["doc_id"]: r for r in pii.pseudonymize(rows, "k").collect()}
        moved = [found[i]["text"].removeprefix("so ").removesuffix(" , and") for i in range(len(values))]
        assert all(re.fullmatch(pii.PATTERNS[kind].replace(r"\p{L}\p{N}", "a-z"), m) for m in moved), kind
        assert len(set(moved)) == len(set(values)) == len(set(zip(values, moved, strict=True)))
        assert sum(a == b for a, b in zip(values, moved, strict=True)) <= 2 and all(found[i][f"n_{kind}"] == 1 for i in found if moved[i] != values[i])
        if kind == "card":
            assert all(map(_luhn, moved)) and not any(m.startswith("0") for m in moved)
        if kind == "phone":
            assert not any(re.sub(r"\D", "", m).startswith("0") for m in moved)


def _noise_by_hand(tag, turn, size, half):
    return int(hashlib.sha256(f"k:{tag}:{turn}:{size}:{half}".encode()).hexdigest()[:15], 16)


def _pair_by_hand(a, b, m, n, tag):
    size = f"{m},{n}"
    for turn in range(1, 9):
        a, b, m, n = b, (a + _noise_by_hand(tag, turn, size, b)) % m, n, m
    return a, b


def _led_by_hand(digits, tag):
    bare = digits.lstrip("0")
    if not bare:
        return digits
    left = max(len(bare) // 2, 1)
    least, right = 10 ** (left - 1), len(bare) - left
    a, b = _pair_by_hand(int(bare[:left]) - least, int(bare[left:] or 0), 9 * least, 10**right, tag)
    return "0" * (len(digits) - len(bare)) + str(a + least) + (f"{b:0{right}d}" if right else "")


def _day_by_hand(day):
    block, year = day.year - day.year % 40, day.year % 40
    if (day.month, day.day) == (2, 29):
        leaps = [y for y in range(1000, 3000) if calendar.isleap(y)]
        at = leaps.index(day.year)
        return date(leaps[at - at % 97 + _pair_by_hand(at % 97, 0, 97, 1, "leap day")[0]], 2, 29)
    if day.day <= 12:
        y, d = _pair_by_hand(year, (day.month - 1) * 12 + day.day - 1, 40, 144, "early day")
        return date(block + y, d // 12 + 1, d % 12 + 1)
    late = [(m, d) for m in range(1, 13) for d in range(13, calendar.monthrange(2001, m)[1] + 1)]
    y, d = _pair_by_hand(year, late.index((day.month, day.day)), 40, len(late), "late day")
    return date(block + y, *late[d])


def test_led_numbers_are_permuted_in_their_class(spark):
    """All strings of four digits, and of one: a permutation that keeps the number of leading zeros, as a plain version has it."""
    for n in (1, 4):
        rows = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        found = {r["d"]: r["p"] for r in rows.select("d", pii.permute_led(F.col("d"), "k", "phone").alias("p")).collect()}
        assert len(set(found.values())) == 10**n and found == {d: _led_by_hand(d, "phone") for d in found}
        assert all(len(d.lstrip("0")) == len(p.lstrip("0")) for d, p in found.items())


def test_days_are_permuted_in_their_class(spark):
    """Every day from 1000 to 2999: a permutation; those up to the 12th stay such; some as a plain version has them."""
    days = spark.range(730_485).select(F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    at = F.struct(F.year("d").cast("long").alias("y"), F.month("d").cast("long").alias("m"), F.day("d").cast("long").alias("d"))
    moved = days.select("d", pii.permute_day(at, "k").alias("p")).select("d", F.make_date(F.col("p.y").cast("int"), F.col("p.m").cast("int"), F.col("p.d").cast("int")).alias("p"))
    counts = moved.agg(F.countDistinct("p").alias("n"), F.max((F.day("p") <= 12) != (F.day("d") <= 12)).alias("broken"), F.max(F.abs(F.year("p") - F.year("d"))).alias("far"))
    r = counts.first()
    assert (r["n"], r["broken"]) == (730_485, False) and r["far"] < 400
    some = moved.where("pmod(hash(d), 500) = 0 OR (month(d) = 2 AND day(d) = 29 AND year(d) < 1300)").collect()
    assert len(some) > 1000 and all(r["p"] == _day_by_hand(r["d"]) for r in some)


def test_pseudonyms_are_linked_in_all_notations(spark):
    """One telephone number and one day in many notations; a plain version says what becomes of them."""
    phone = _led_by_hand("15112345678", "phone")
    day, early = _day_by_hand(date(1980, 12, 25)), _day_by_hand(date(1987, 3, 5))
    english, german = calendar.month_name, dict(enumerate(pii.MONTHS[48:], 1))
    th = lambda n: f"{n}{'th' if n // 10 == 1 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"
    cases = [
        ("+49 151 12345678", f"+49 {phone[:3]} {phone[3:]}"),
        ("+4915112345678", f"+49{phone}"),
        ("+49 (0)151 12345678", f"+49 (0){phone[:3]} {phone[3:]}"),
        ("0151 12345678", f"0{phone[:3]} {phone[3:]}"),
        ("+33 6 12 34 56 78", None),
        ("06 12 34 56 78", None),
        ("030 123 4567", None),
        ("12/25/1980", f"{day.month:02d}/{day.day}/{day.year}"),
        ("25/12/1980", f"{day.day}/{day.month:02d}/{day.year}"),
        ("25.12.1980", f"{day.day}.{day.month:02d}.{day.year}"),
        ("1980-12-25", f"{day}"),
        ("5 March 1987", f"{early.day} {english[early.month]} {early.year}"),
        ("March 5th, 1987", f"{english[early.month]} {th(early.day)}, {early.year}"),
        ("5. März 1987", f"{early.day}. {german[early.month].capitalize()} {early.year}"),
        ("5 de marzo de 1987", f"{early.day} de {pii.MONTHS[35 + early.month]} de {early.year}"),
        ("3/5/1987", None),
        ("30 February 1987", "30 February 1987"),
        ("13/13/1987", "13/13/1987"),
        ("version 3 May be", "version 3 May be"),
    ]
    rows = spark.createDataFrame([(i, f"see {v}, and") for i, (v, _) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r["text"].removeprefix("see ").removesuffix(", and") for r in pii.pseudonymize(rows, "k").collect()}
    for i, (was, expected) in enumerate(cases):
        assert found[i] == expected if expected else found[i] != was and len(found[i]) >= len(was) - 1, (was, found[i], expected)
    assert re.sub(r"\D", "", found[4])[2:] == re.sub(r"\D", "", found[5])[1:] and found[6].startswith("0")


def test_windows_are_hashed_from_token_hashes(spark):
    """Tokens equal those of plain patterns on odd white space, units and names; a window's hash is that of its tokens' hashes."""
    from pyspark.sql import functions as F

    d = decontaminate
    texts = ["a \n Paris\t\tsaw  Bob Lee,\r\n5kg of 3  KG and 1,200.5 km/h kgs x", "7 7 8 kg\x0b\x0cTom Éa. Ünder x:Y 1:2/3 4.", "  ", "", "Ab\u2003Cd Ef 2 minutes Gh"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    plain = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), d.NUMBER, " 0n ")
    plain = F.regexp_replace(plain, rf"(?<=0n ) ?(?i:{d.UNITS})(?![\p{{L}}\p{{N}}])", "0u")
    plain = F.regexp_replace(plain, r"(?<=[\p{L}\p{N},] )\p{Lu}\p{Ll}+", "0p")
    plain = F.regexp_replace(plain, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "1$0")
    plain = F.filter(F.split(F.lower(plain), d.BREAK), lambda w: w != "")
    raw = F.regexp_replace(F.regexp_replace("text", d.NUMBER, " $0 "), r"(?<=\p{Nd})[.,:/](?=\p{Nd})", "0x")
    raw = F.filter(F.split(F.lower(raw), d.BREAK), lambda w: w != "")
    for r in rows.select(d.template_tokens(F.col("text")).alias("t"), plain.alias("p"), d.raw_tokens(F.col("text")).alias("r"), raw.alias("q")).collect():
        assert r["t"] == r["p"] and r["r"] == r["q"]
    words = spark.createDataFrame([(list("abcde"),)], "w array<string>").select(d.token_hashes(F.col("w")).alias("h"), F.xxhash64(*(F.xxhash64(F.lit(x)) for x in "abcde")).alias("e"))
    assert [r["x"] == [r["e"]] for r in words.select(d.window_hashes(F.col("h"), 5).alias("x"), "e").collect()] == [True]


def test_language_id_reads_letters_only(spark):
    rows = [(i, f"{w} {w}s", "en") for i, w in enumerate(("house", "garden", "river", "stone", "water") * 3)] + [(50, "½ ² ①", None), (51, "x²y", None), (52, None, "en")]
    found = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert found[50]["lang_pred"] == found[52]["lang_pred"] == "und" and found[50]["score"] == 0
    assert found[51]["lang_pred"] == "en" and len(found) == len(rows)
    assert language_id.words_of("x²y ½ Ⅻa") == ["x", "y", "a"]


def _page(i, body):
    return f"<html><head><title>t{i}</title></head><body><div class='top'><a href='/'>Home</a> <a href='/x'>More {i}</a></div>{body}<div>Call us {i}</div></body></html>"


def test_wrapper_decides_what_the_article_is():
    """Pages without an article element: headings and lists stay, the template's constants and link boxes go."""
    body = "<div class='text'><h1>T{0}</h1><p>Share this page</p><p>Hello &amp;amp; <b>wor</b>ld {0}, a longer text that is the article's<p>second {0}</p><ul><li>a{0}<li>b</ul><div>Written by our desk</div></div>"
    pages = [_page(i, body.format(i)) for i in range(4)]
    wrapper = html_text.infer(pages)
    assert "(<li>#TEXT</>)+" in html_text.expression(wrapper)
    expected = "T1\n\nShare this page\n\nHello &amp; world 1, a longer text that is the article's\n\nsecond 1\n\na1\n\nb"
    assert html_text.extract(pages[1], html_text.Reader(wrapper)) == expected
    alone = html_text.extract(pages[1], None)  # by itself the page can't tell what its template says
    assert alone != expected and "Written by our desk" in alone
    # A text equal to a constant in another place stays, and so does an element that the wrapper lacks.
    odd = _page(9, body.format(9).replace("second 9", "Written by our desk").replace("</ul>", "</ul><blockquote>new</blockquote>"))
    text = html_text.extract(odd, html_text.Reader(wrapper))
    assert text.split("\n\n")[3:] == ["Written by our desk", "a9", "b", "new"]


def test_copies_of_one_article_are_no_template():
    pages = [f"<html><body><nav>{i}</nav><article><h1>One</h1><p>and the same</p></article><footer>f</footer></body></html>" for i in range(6)]
    assert html_text.extract(pages[0], html_text.Reader(html_text.infer(pages))) == "One\n\nand the same"


def test_articles_keep_what_all_pages_share():
    """A heading, a formula and an object's text that all pages of a host have stay in an article; so does a heading in a container."""
    for tag in ("article", "main", "div class='text'"):
        body = "<{1}><h1>Introduction</h1><p>text {0} of page {0}, which is a long one</p><h2>Results</h2><p>more {0} and more of it</p><p>where <math><mi>x</mi></math> is <object>a plot</object></p></{2}>"
        pages = [_page(i, body.format(i, tag, tag.split()[0])) for i in range(40)]
        reader = html_text.Reader(html_text.infer(pages[:8]))
        expected = "Introduction\n\ntext 7 of page 7, which is a long one\n\nResults\n\nmore 7 and more of it\n\nwhere x is a plot"
        assert html_text.extract(pages[7], reader) == expected, tag


def test_alignment_of_long_pages_is_near_linear():
    rng = random.Random(4)
    for turn in range(300):
        a, b = ([rng.choice("abcdefgh"[: 1 + turn % 8]) for _ in range(rng.randint(0, 12))] for _ in "ab")
        found = html_text._matched(a, b)
        assert all(a[i] == b[k] for i, k in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        assert bool(found) == bool(set(a) & set(b)) and (a != b or len(found) == len(a))
    assert html_text._matched(list("abxcd"), list("abycd")) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    pages = ["<article>" + "".join(f"<h2>t{i}</h2><p>x{i}</p>" + "<div>n</div>" * (i % n == 0) for i in range(5_000)) + "</article>" for n in (7, 11)]
    start = time.monotonic()
    text = html_text.extract(pages[0], html_text.Reader(html_text.infer(pages)))
    assert time.monotonic() - start < 10 and text.count("\n\n") == 10_714
    keys = [[k for i in range(10_000) for k in ("h2", "p", *(["div"] if i % n == 0 else []))] for n in (7, 11)]
    start = time.monotonic()
    html_text._matched(*keys)
    assert time.monotonic() - start < 1


def test_odd_pages():
    article = "<article><h1>A</h1><p>x<br>y &lt;<p class='reply-to-critics'>z</p><div class='search-results'>found</div><div class='comment-list'><p>c</p></div><footer>f</footer></article>"
    assert html_text.extract(article, None) == "A\n\nx y <\n\nz\n\nfound"
    assert html_text.extract('<article><p>a <a href="x>link</a> b</p></article>', None) == "a link b"
    deep = 10_000
    assert html_text.extract("<div>" * deep + "<p>in</p>" + "</div>" * deep + "<p>out</p>", None) == "in\n\nout"
    assert html_text.extract(None, None) == html_text.extract("<nav>x</nav>", None) == ""
    assert html_text.extract("<script>var a = '<p>no</p>'</script><!-- <p>no</p> --><p>yes</p>", None) == "yes"


def test_main_text_equals_a_plain_parse(spark):
    """The given pages have one article element each: a plain parse of it gives the texts expected."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        expected = [" ".join(html.unescape(x).split()) for x in parts]
        assert found[r["page_id"]]["text"] == "\n\n".join(x for x in expected if x)
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


def test_wrappers_come_from_all_pages_of_a_host(spark):
    """A constant that only pages of a rare shape have goes from these; what one page alone has stays; articles in rare places are read."""
    extra = ["<ul><li>a{0}</ul>", "<ol><li>b{0}</ol>", "<blockquote>c{0}</blockquote>", "<pre>d{0}</pre>", "<h2>e{0}</h2>", "<h3>f{0}</h3>", "<h4>g{0}</h4>", "<dl><dt>h{0}</dl>", "<hr>"]
    body = "<div class='text'>{1}<h1>T{0}</h1><p>text {0} of page {0}, which is a long one, longer than all about it</p>{2}{3}</div>"
    rows = [_page(i, body.format(i, "", extra[i % 9].format(i), "")) for i in range(90)]
    rows += [_page(i, body.format(i, "<address>Written by our desk</address>", "<table><tr><td>t</table>", "")) for i in range(90, 94)]
    rows += [_page(94, body.format(94, "<section>Only here</section>", "", ""))]
    # More shapes than are merged at a time, all with one element of the template.
    rows += [""] * 5 + [_page(i, body.format(i, "", "".join(f"<{t}>x{i}</{t}>" for k, t in enumerate("h2 pre h3 ol h4 ul h5".split()) if i >> k & 1), "<footer>f</footer>")) for i in range(100, 228)]
    pages = spark.createDataFrame([(i, f"http://{'o' * (i == 94)}h.example/", x) for i, x in enumerate(rows)] + [(i, "http://oh.example/", _page(i, body.format(i, "", "", ""))) for i in range(300, 310)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.main_text(pages.repartition(1)).collect()}
    assert found == {r["page_id"]: r["text"] for r in html_text.main_text(pages.repartition(7)).collect()}
    for i in range(90, 94):
        assert found[i] == f"T{i}\n\ntext {i} of page {i}, which is a long one, longer than all about it\n\nt", found[i]
    assert found[94].startswith("Only here\n\nT94")
    assert found[0].endswith("\n\na0") and found[227].count("\n\n") == 1 + bin(227 & 127).count("1")
    named = [f"<body><div id='p{i}'><article id='a{i}'><p>x{i}</article></div>{'<section><article class=late><p>y</article></section>' * (i == 70)}</body>" for i in range(71)]
    pages = spark.createDataFrame([(i, "http://n.example/", x) for i, x in enumerate(named)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()} == {i: f"x{i}" + "\n\ny" * (i == 70) for i in range(71)}
    assert html_text.extract("<article class='comment'>c</article><div><p>the text</p></div>", None) == "the text"


def test_main_text_with_more_wrappers_than_are_broadcast(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.when(F.col("page_id") % 9 > 0, F.col("url")).alias("url"), "html")
    expected = sorted(html_text.main_text(pages).collect(), key=str)
    monkeypatch.setattr(html_text, "BROADCAST_CHARS", 0)
    assert sorted(html_text.main_text(pages).collect(), key=str) == expected


def test_wrappers_are_learned_inside_of_articles(spark):
    """Links that all articles of a host begin or end with are menus; all else that they share stays, and so do links of their own."""
    body = "<body><{1}><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul><div><a href='/{0}'>Read {2}</a></div><h2>Notes</h2><p>text {0} of page {0}, which is a long one<p>{3}, one more {0}, so that what all share is the lesser part of the text, as it is on most pages<div>All agree.</div><p><a>Share</a> | <a>Print</a></{1}></body>"
    tags = ["article", "main"]
    rows = [body.format(i, tags[i % 2], "on" if i not in (8, 9) else "this", "short" if i % 3 else "<i>some</i>") for i in range(40)]
    own = rows[6].replace("News", "New")
    for tag in tags:
        wrapper = html_text.infer(rows[tags.index(tag) :: 2])
        assert "<ul>(<li><a>#TEXT</></>)+</>" in html_text.expression(wrapper) and "<div>All agree.</>" in html_text.expression(wrapper)
        assert "Home" in html_text.extract(own.replace("article", tag), html_text.Reader(wrapper))
    pages = spark.createDataFrame([(i, f"http://{tags[i % 2]}.example/", x) for i, x in enumerate(rows)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.main_text(pages.repartition(1)).collect()}
    assert found == {r["page_id"]: r["text"] for r in html_text.main_text(pages.repartition(5)).collect()}
    for i, text in found.items():
        assert text == f"{'Read this' if i in (8, 9) else 'Read on'}\n\nNotes\n\ntext {i} of page {i}, which is a long one\n\n{'short' if i % 3 else 'some'}, one more {i}, so that what all share is the lesser part of the text, as it is on most pages\n\nAll agree.", text


def test_main_text_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/", ""), (2, "http://h/", ""), (3, "odd", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect()) == [(1, "", 0), (2, "", 0), (2, "", 0), (3, "x", 1)]
    assert html_text.main_text(pages.limit(0)).count() == 0
    clashing = pages.selectExpr("page_id", "url", "html", "'x' AS host", "1 AS h", "2 AS shape", "'y' AS wrapper", "3 AS n")
    assert html_text.main_text(clashing).count() == 4


def test_pipeline_equals_its_stages_by_hand(spark):
    """Every stage against a plain version of it, on the output of the plain version before."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    before = len(rows)
    scorer = language_id.Scorer(language_id.fit(table, PIECES))
    rows = {i: t for i, t in rows.items() if (x := scorer.score([t])[0])[0] != "und" and x[1] >= corpus_pipeline.LEAST_POSTERIOR}
    cleaned = _dedup_by_hand(sorted(rows.items()))
    rows = {i: t for i, t in cleaned.items() if t == rows[i] or t.strip(" ")}
    classes = _classes_by_hand(rows)
    rows = {i: t for i, t in rows.items() if classes[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in _contaminated_by_hand(rows.items(), items)}
    rows = {i: t for i, t in rows.items() if i not in bad}
    model = Tokenizer.from_file(WORDS)
    expected = set()
    for i, t in rows.items():
        ids = model.encode(t, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected.add((i, k // 4096, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == expected and len(packed) == len(expected)
    assert bad and 0.5 * before < len(rows) < before
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts))) and sum(n for _, n in parts) <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_pipeline_stages_of_odd_rows(spark):
    """Null, empty and repeated rows, and an empty table, through every stage."""
    import corpus_pipeline

    text = "a river runs through the green garden and the old stone house stands near the water of the wide river"
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, text, "en", "s", 5), (3, text, "en", "s", 5), (4, text, "en", None, None), (None, text, None, None, None), (7, "½ ²", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    left = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        left.append(docs.count())
    assert left[1] == 4 and left[2] <= left[1]  # null, empty and letterless texts are in no language
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == left[-1]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_texts_that_share_an_id_keep_their_own_lines(spark):
    """A line goes only from the text that repeats it, whatever other texts of its id have at that place."""
    a, b, c = (f"{word} is a line that is long enough to be compared with the others here" for word in ("first", "second", "third"))
    rows = [(1, f"{a}\n{b}"), (1, f"{c}\n{a}"), (1, "x"), (2, c), (3, None), (1, None)]
    found = line_dedup.dedup_lines(_docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["n_lines"], r["n_removed"]) for r in found) == sorted([(1, f"{a}\n{b}", 2, 0), (1, c, 2, 1), (1, "x", 1, 0), (2, "", 1, 1), (3, "", 0, 0), (1, "", 0, 0)])
