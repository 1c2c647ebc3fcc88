"""Conversation repair, lattice scores and clustering against brute force."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tests.conftest import SF
from tidemark.llm import clusters, conversations, lm_scores, queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, ours[columns].values.tolist())) == sorted(map(tuple, theirs[columns].values.tolist()))


# --- conversations


def _repaired(table):
    """By a plain search over (cost, audit) for the cheapest edits of each conversation."""
    by, out = collections.defaultdict(list), {}
    for conv, turn, role, text in table:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in by.items():
        after = []
        for turn, role, text in rows:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in after:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        heap, done, found = [(0, "", 0, "", ())], set(), None
        while found is None:
            cost, audit, i, roles, body = heapq.heappop(heap)
            if (i, roles if roles in ("", "s") else roles[-1]) in done:
                continue
            done.add((i, roles if roles in ("", "s") else roles[-1]))
            if i == len(after) and re.fullmatch("(s?(ua)+)?", roles):
                found = cost, audit, body
                continue

            def push(price, letter, step, initial, line, at=(cost, audit, i, roles, body)):
                if not initial or re.fullmatch("s?(ua)*u?", at[3] + initial):
                    heapq.heappush(heap, (at[0] + price, at[1] + letter, at[2] + step, at[3] + initial, at[4] + line))  # noqa: B023

            for role in ("user", "assistant"):
                push(2, "I", 0, role[0], (f"{role}:",))
            if i < len(after):
                _, own, text = after[i]
                push(3, "D", 1, "", ())
                if faults[i] not in ("b", "d"):
                    more = faults[i] == "t"
                    if own[:1]:
                        push(more, "K", 1, own[:1], (f"{own}:{text}",))
                    for role in ("user", "assistant"):
                        push(2 + more, "R", 1, role[0], (f"{role}:{text}",))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, found[0], found[1], hashlib.sha256("\n".join(found[2]).encode()).hexdigest())
    return out


def _conversations(spark, table):
    return spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, code string, part int")


@pytest.mark.parametrize("piece_rows", [2, 256])
def test_repair_finds_the_cheapest_edits(spark, piece_rows):
    rng = random.Random(5)
    table = []
    for conv in [*range(120), None, 2**60 + 1]:
        for i in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "s"])
            table.append((conv, rng.choice([i, i, i, None, i * 2]), role, rng.choice(["Hi.", "Yes!", "no", "  ", "", "ok.", "Q?\n", None, f"x{i}.", f"y{i}", "long. " * 2000])))
    table += table[:5]  # repeated rows
    found = conversations.repair(_conversations(spark, table), piece_rows)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == _repaired(table)


def test_one_conversation_of_many_rows_is_many_pieces(spark):
    rng = random.Random(7)
    table = [(7, i, rng.choice(["user", "assistant"]), f"{rng.randint(0, 10**6)}{rng.choice(['.', ''])}") for i in range(1500)]
    assert {r[0]: tuple(r)[1:] for r in conversations.repair(_conversations(spark, table), 100).collect()} == _repaired(table)


def test_repair_of_nothing(spark):
    assert conversations.repair(_conversations(spark, [])).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert [tuple(r) for r in conversations.repair(_conversations(spark, [(5, gone, "user", "Hi.")])).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- lattice scores


def _all_cuts(word, shares):
    """The sum over all segmentations, one by one."""
    if not word:
        return 1.0
    return sum(p * _all_cuts(word[len(piece) :], shares) for piece, p in shares.items() if word.startswith(piece))


def test_the_lattice_sums_all_segmentations():
    shares = {b" a": 0.1, b" ab": 0.2, b" ": 0.05, b"a": 0.1, b"b": 0.1, b"ba": 0.15, b"aba": 0.1, b"c": 0.2}
    lattice = lm_scores.Lattice(list(shares), np.log(list(shares.values())))
    words = [b"a", b"ab", b"abab", b"ababa", b"cabba", b"ab" * 40]
    assert np.allclose(lattice.log_words(words[:-1]), [math.log(_all_cuts(b" " + w, shares)) for w in words[:-1]])
    ahead = [1.0]
    marked = b" " + words[-1]
    for end in range(1, len(marked) + 1):
        ahead.append(sum(ahead[a] * shares.get(marked[a:end], 0) for a in range(end)))
    assert np.isclose(lattice.log_words(words[-1:])[0], math.log(ahead[-1]))  # a long word, summed alone
    counts = np.array([2.0, 1.0, 3.0, 1.0, 1.0, 2.0])
    whole = lambda logs: float((lm_scores.Lattice(list(shares), logs).log_words(words) * counts).sum())
    expected, logs = lattice.expected(words, counts), np.log(list(shares.values()))
    for i in range(len(shares)):  # expected counts are the derivatives by the logarithms
        step = np.eye(len(shares))[i] * 1e-5
        assert np.isclose((whole(logs + step) - whole(logs - step)) / 2e-5, expected[i], atol=1e-4)


def test_scores_equal_a_plain_count_and_the_given_formula(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm_scores.score_texts(docs, PIECES).collect()
    rows = docs.select("doc_id", "text").collect()

    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]

    train = collections.Counter(w for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in tokens(r["text"]))
    n, v = sum(train.values()), len(train)
    plain = {r["doc_id"]: tokens(r["text"]) for r in rows}
    for r in got:
        words = plain[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0, len(words), sum(w in train for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
    # The whole model by hand: word arcs less the discount, and what they give up for the segmentations.
    counts = lm_scores.word_counts(spark.createDataFrame([(bytearray((r["text"] or "").encode()), zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows], "text binary, held_out boolean")).persist()
    pieces, logs = lm_scores.fit_pieces(counts, PIECES, 3, 1000.0)
    lattice = lm_scores.Lattice(pieces, logs[:-1])
    once, twice = (sum(c == k for c in train.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    for r in got[:20]:
        total = 0.0
        for w in plain[r["doc_id"]]:
            cuts = logs[-1] if w is None else lattice.log_words([w.encode()])[0]
            total += math.log10(max(train[w] - d, 0) / n + d * v / n * math.exp(cuts)) if train[w] else math.log10(d * v / n) + cuts / math.log(10)
        assert math.isclose(r["score"], total, rel_tol=1e-6)
    assert abs(sum(math.exp(x) for x in logs) - 1) < 1e-9


def test_scores_of_odd_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (None, "a b", 2), (2, "", 3), (3, "x" * 70_000 + " the the", 3), (5, "é É A", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = lm_scores.score_texts(docs, PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"]) for r in found) == [(0, True, 3), (1, False, 1), (1, False, 1), (2, False, 1), (3, False, 4), (5, False, 4)]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert lm_scores.score_texts(docs.where("n > 9"), PIECES).count() == 0


# --- clustering


def test_the_curve_visits_every_cell_by_single_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), axis=-1).reshape(-1, n)
        order = sorted(range(len(cells)), key=lambda i: clusters.hilbert_keys(cells, bits)[i].tobytes())
        assert all(np.abs(cells[a] - cells[b]).sum() == 1 for a, b in zip(order, order[1:], strict=False))


def test_no_box_rules_out_a_nearest_centroid():
    rng = np.random.default_rng(1)
    fewer = 0
    for _ in range(200):
        c = rng.integers(-50, 50, (8, 3))
        x = rng.integers(-60, 60, 3) + rng.integers(0, 12, (30, 3))
        some = clusters.candidates(x.min(axis=0).astype(float), x.max(axis=0).astype(float), c)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert set(np.flatnonzero((d == d.min(axis=1, keepdims=True)).any(axis=0))) <= set(some)
        cluster, distance = clusters.nearest_of(x, c, some)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        fewer += len(some) < 8
    assert fewer > 100


def test_clusters_of_odd_rows(spark):
    rng = random.Random(2)
    good = [(i, [float(rng.randint(-2, 2)) for _ in range(64)]) for i in range(40)]
    rows = [*good, good[3], (None, good[4][1]), (41, None), (42, [1.0] * 63), (43, [float("nan")] * 64), (44, [None] * 64), (2**60 + 1, [1e30] * 64), *[(50 + i, good[0][1]) for i in range(300)]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    found = clusters.cluster_vectors(df, block_rows=16).collect()
    kept = [(i, [min(max(math.floor(64 * x), -(2**62)), 2**62) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and x == x for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:16]
    centroids = [v for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(3):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if own[k] else c for k, c in enumerate(centroids)]
    end = 2**63 - 1
    assert collections.Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found) == collections.Counter((i, near(v)[1], min(near(v)[0], end)) for i, v in kept)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest() for r in found)
    assert clusters.cluster_vectors(df.where("vec_id = 42")).count() == 0
