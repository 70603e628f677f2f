"""Decontamination, ranked search and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import contamination, negatives, ranking

ASCII = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def own_words(text):
    return WORD.findall((text or "").translate(ASCII))


def texts_with_items(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "ßé", "ñ", "x1"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(9, 40)))) for i in range(20)]
    items += [(20, None), (21, ""), (22, " - "), (23, "w1 W2 w3"), (24, "w7"), (25, items[0][1]), (None, items[1][1]),
              (3, items[3][1]), (26, " ".join(["la"] * 25))]
    docs = [(0, None, "a"), (1, "", "b"), (2, "--", "c"), (3, "la " * 60, "d"), (None, items[4][1], "e")]
    for i in range(4, 120):
        words = make(rng.randint(0, 80))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = (items[rng.randrange(20)][1]).split()
            low = rng.randint(0, max(len(part) - 12, 0))
            at = rng.randint(0, len(words))
            words[at:at] = part[low : low + rng.randint(8, 30)]
        docs.append((i, rng.choice(["  ", ""]) + rng.choice([" ", ", ", "\n"]).join(words).upper() + rng.choice([".", ""]), "s"))
    return docs + [docs[50], docs[50], docs[3]], items


def brute_hits(text, windows):
    words = own_words(text)
    hit, items = set(), set()
    for window, owners in windows.items():
        for p in range(len(words) - len(window) + 1):
            if tuple(words[p : p + len(window)]) == window:
                hit |= set(range(p, p + len(window)))
                items |= owners
    return words, hit, items


def brute_windows(items):
    windows = {}
    for item, text in items:
        words = own_words(text)
        size = min(len(words), 10)
        for p in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[p : p + size]), set()).update(set() if item is None else {str(item)})
    return windows


@pytest.mark.parametrize("few", [True, False])
def test_contamination(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(contamination, "BROADCAST_WINDOWS", 0)
    docs, items = texts_with_items()
    windows = brute_windows(items)
    frame = spark.createDataFrame(docs, "doc_id long, text string, name string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for doc, text, _ in docs:
        words, hit, found = brute_hits(text, windows)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    got = [tuple(r) for r in contamination.report(frame, benchmark).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_decontaminated_texts(spark):
    docs, items = texts_with_items(8)
    windows = brute_windows(items)
    columns = "doc_id long, text string, name string, spans int, own string, text_md5 string, row int, tokens int"
    frame = spark.createDataFrame([(*d, 5, "o", "m", 7, 8) for d in docs], columns)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for doc, text, name in docs:
        _, hit, _ = brute_hits(text, windows)
        if hit:
            split = re.match(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)(.*)", text, re.S)
            tokens = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", split[2])
            text = split[1] + "".join(t for i, t in enumerate(tokens) if i not in hit)
        expected.append(((doc, text, name, 5, "o", "m", 7, 8), bool(hit)))
    cleaned = contamination.decontaminate(frame, benchmark)
    assert cleaned.columns == frame.columns
    assert sorted(map(str, map(tuple, cleaned.collect()))) == sorted(str(r) for r, _ in expected)
    left = contamination.decontaminate(frame, benchmark, whole=True)
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r, hit in expected if not hit)
    assert contamination.decontaminate(frame, benchmark.limit(0)).count() == len(docs)
    assert contamination.report(frame.limit(0), benchmark).count() == 0
    assert contamination.report(frame, benchmark.limit(0)).filter("contaminated").count() == 0


def test_long_text_and_many_hits(spark):
    text = " ".join(f"v{i % 9000}" for i in range(30_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(9000)))], "item_id long, text string")
    row = contamination.report(frame, benchmark).first()
    windows = 9000 - 9
    assert row.n_words == 30_000 and row.n_hit == 3 * (windows + 9) + 3000


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k=20):
    bags = [(d, Counter(t.translate(ASCII) for t in TERM.findall(x or ""))) for d, x, *_ in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(t.translate(ASCII) for t in TERM.findall(text or ""))
        scored = []
        for d, b, size in bags:
            m = 75 + (25 * size * n) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
                for t, times in asked.items() if t in b
            )
            if score > 0:
                scored.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, d, -score))
    return out


def test_ranked_search(spark, monkeypatch):
    rng = random.Random(4)
    docs, items = texts_with_items(21)
    common = ["the", "of", "and"]
    docs += [(1000 + i, " ".join(rng.choices(common + [f"w{j}" for j in range(40)], k=rng.randint(1, 60))), "t") for i in range(900)]
    items += [(40, "the the of W3"), (41, "nowhere at all"), (42, "w1 " * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, rank string").repartition(3)
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, item int")
    expected = sorted(brute_ranks(docs, items), key=str)
    assert sorted((tuple(r) for r in ranking.search(frame, benchmark).collect()), key=str) == expected
    # small shards, blocks, groups and slices change nothing
    for name, value in (("SHARD_DOCS", 150), ("BLOCK", 4), ("FIRST", 1), ("GROUP_TERMS", 10), ("SLICE_TERMS", 120), ("TABLE_BYTES", 4000)):
        monkeypatch.setattr(ranking, name, value)
    assert sorted((tuple(r) for r in ranking.search(frame, benchmark).collect()), key=str) == expected
    assert ranking.search(frame.limit(0), benchmark).count() == 0
    assert ranking.search(frame, benchmark.limit(0)).count() == 0
    assert ranking.search(frame, benchmark.withColumn("text", F.lit(" "))).dtypes == ranking.search(frame, benchmark).dtypes


def test_blocks_are_skipped():
    """Few documents are scored where the bounds tell them apart."""
    rng = np.random.default_rng(2)
    n, terms = 4000, 60
    topic = rng.integers(0, 30, n)
    owner = np.repeat(np.arange(n), 2)
    column = np.stack([topic, 30 + rng.integers(0, 30, n)], axis=1).ravel()
    value = np.where(column < 30, 800_000, 1_000)
    order = np.lexsort((column, owner))
    group = ranking.Group([(0, np.array([3, 40]), np.array([9000, 10])), (1, np.arange(terms), np.ones(terms, np.int64))])
    shard = ranking.Shard(n, owner[order], column[order], value[order], group)
    best, scored = ranking.Best(20), []
    shard.scores, plain = lambda d, w: scored.append(len(d)) or plain(d, w), shard.scores
    number, columns, weights = group.items[0]
    shard.search(columns, weights, best, np.arange(n), np.zeros(n, bool))
    full = np.bincount(owner[order], value[order] * np.isin(column[order], [3, 40]) * np.where(column[order] == 3, 9000, 10))
    top = np.lexsort((np.arange(n), -full))[:20]
    assert best.ids.tolist() == top.tolist() and sum(scored) < n / 4


def brute_negatives(rows, factor=None):
    named = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None for c in v):
            continue
        named[i] = min(named.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in named.items():
        if a % 50:
            continue
        dot = lambda u: sum(x * y for x, y in zip(u, v))
        scored = sorted((-dot(u), i, lab) for i, (lab, u) in named.items() if i != a and len(u) == len(v))
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(a, p, r, i, -score, -s) for r, (s, i, _) in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("large", [1, 1 << 26])
def test_hard_negatives(spark, monkeypatch, large):
    monkeypatch.setattr(negatives, "BLOCKS", 3)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 150)
    monkeypatch.setattr(negatives, "HELD_SCORES", 2000)
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 3), [large * rng.randint(-3, 9) for _ in range(4)]) for i in range(600)]
    rows += [(600, None, [1, 2, 3, 4]), (None, 1, [1, 1, 1, 1]), (650, 1, None), (700, 1, [1, None, 2, 3]),
             (750, 2, [5, 5]), (751, 2, [5, 4]), (752, 1, [3, 4]), (800, 1, []), (850, 1, [0, 0, 0, 0]), rows[50], rows[50],
             (100, 9, [1, 1, 1, 1])]
    rows += [(900 + i, i % 2, [7, 7, 7, 7]) for i in range(200)]  # a common vector
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, v array<long>, block int, nth int")
    found = negatives.hard_negatives(frame.repartition(5), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(brute_negatives(rows))
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(frame, F.col("vec_id") < 0).count() == 0


def test_scaled(spark):
    values = [[0.5, -0.001], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], None, []]
    frame = spark.createDataFrame([(v,) for v in values], "e array<float>")
    got = [r[0] for r in frame.select(negatives.scaled(F.col("e"), 256)).collect()]
    assert got == [[128, -1], None, None, None, None, []]
