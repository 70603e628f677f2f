"""Operators that compare documents or vectors, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import lines, ngram_join, substrings, vectors, words
from auditloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(ids, links):
    """Least id reachable of each."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(seed=5):
    """Documents with exact and near copies, shared passages, and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    def make(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = make(70), [None, "", " \n", "one", "one", "One", "a b c d", "la " * 120, "la " * 70]
    for _ in range(12):
        base = make(rng.randint(20, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    for _ in range(10):
        texts.append(" ".join(make(rng.randint(0, 60)) + passage + make(rng.randint(0, 60))))
    big = make(150)
    for _ in range(60):  # a large group of near copies
        copy = list(big)
        copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (30, 20), (200, 150)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        links += [(i, i + 1) for i in range(1000, 1040)]
        rows = spark.createDataFrame(links + [(None, 1), (5000, 5000)], "a long, b long")
        ends = {x for a, b in links if a != b for x in (a, b)}
        expected = groups(ends, links)
        assert {r.id: r.component for r in components(rows).collect()} == expected
    assert components(rows.filter("false")).count() == 0


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}


def test_ngram_join(spark):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    expected = groups(list(sets), links)
    docs = frame(spark, rows).withColumn("cls", F.lit("clash")).withColumn("n", F.lit(None))
    found = ngram_join.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {
        i: (len(s), expected[i]) for i, s in sets.items()
    }
    kept = ngram_join.drop_near_duplicates(docs.unionByName(docs.limit(5)))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_ngram_join_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (3, "")]
    found = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == [
        (0, 0, 0), (0, 2, 7), (3, 0, 3), (7, 2, 7), (7, 2, 7)
    ]
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_prefix_lengths_keep_similar_pairs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        ranks = {g: int(r) for g, r in enumerate(rng.integers(0, 6, 200))}
        x = rng.permutation(200)[:n]
        y = np.unique(np.concatenate([x[: max(1, int(n * 0.9))], rng.permutation(200)[: int(rng.integers(0, n // 8 + 1))]]))
        x = np.sort(x)
        if 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
            continue
        for g in np.intersect1d(x, y):  # what two documents have occurs twice
            ranks[g] = max(ranks[g], 1)
        (i, a), (j, b) = (ngram_join.choose_prefix(np.array([ranks[g] for g in s], np.uint8)) for s in (x, y))
        assert len(np.intersect1d(x[a], y[b])) >= min(i, j)


def brute_substrings(rows, window=50):
    texts = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][p : p + window]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    rows += [(900, "x y " * 80), (901, "x y " * 50 + "tail"), (902, "head " + "la " * 60)]
    expected = brute_substrings(rows)
    docs = frame(spark, rows).withColumn("at", F.lit(1)).withColumn("row", F.lit("clash"))
    found = substrings.dedup_substrings(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == expected


def test_equal_windows_have_equal_interior_symbols():
    rng = np.random.default_rng(4)
    window = rng.integers(0, 30, 50).astype(np.uint64)
    seen = []
    for _ in range(60):
        left, right = (rng.integers(0, 30, int(rng.integers(0, 20))).astype(np.uint64) for _ in range(2))
        text = words.mix(np.concatenate([left, window, right]))
        names, sizes, _ = substrings.compress(text, np.array([len(text)]))
        start = np.cumsum(sizes) - sizes - len(left)
        inside = (start >= substrings.MARGIN) & (start + sizes <= 50 - substrings.MARGIN)
        seen.append(tuple(zip(start[inside].tolist(), names[inside].tolist())))
    assert len(set(seen)) == 1 and seen[0]


def test_substring_dedup_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (4, text), (4, text), (9, "new " + text), (2, None), (1, "")]
    found = substrings.dedup_substrings(frame(spark, rows), with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text or "") for r in found) == [
        (0, 80, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (4, 80, 0, ""), (4, 80, 0, ""), (9, 81, 80, "new"),
    ]
    assert substrings.dedup_substrings(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(frame(spark, []), window=20)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_lines(rows, percent=80):
    """Rows left of each document: lines that share a key of the operator and are similar, by comparing all."""
    found = []
    for i, text in rows:
        if text is None:
            continue
        part = lines._Lines([text], lines.MIN_WORDS)
        keys = lines.block_keys(part.sketches)
        for k in range(len(part.used)):
            found.append((i, int(part.place[k]), set(keys[part.kind[k]].tolist()), part.line(k).decode()))
    links = []
    for a, x in enumerate(found):
        for b in range(a):
            y = found[b]
            longest = max(len(x[3]), len(y[3]))
            if x[3] == y[3] or x[2] & y[2] and 100 * (longest - levenshtein(x[3], y[3])) >= percent * longest:
                links.append((a, b))
    order = sorted(range(len(found)), key=lambda k: found[k][:2])
    rank = {k: r for r, k in enumerate(order)}
    least = groups(range(len(found)), [(rank[a], rank[b]) for a, b in links])
    gone = defaultdict(set)
    for r, root in least.items():
        if r != root:
            gone[found[order[r]][0]].add(found[order[r]][1])
    out = {}
    for i, text in rows:
        if text is not None:
            out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        else:
            out[i] = None
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(200)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 45))) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "short line\nshort line")]
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 3)):
            line = rng.choice(base).split()
            if rng.random() < 0.6:
                k = rng.randrange(len(line))
                line[k] = line[k][:-1] + rng.choice("0123456789x!")
            own.append(" ".join(line).title() if rng.random() < 0.2 else " ".join(line))
        rows.append((10 + i, "\n".join(own)))
    clashing = ["line", "row", "own", "hash", "gone", "lines", "keys", "name", "id", "doc", "first", "component"]
    docs = frame(spark, rows).withColumns({c: F.lit(c) for c in clashing}).withColumn("n_removed", F.lit("clash"))
    for percent in (80, 95):
        found = lines.dedup_lines(docs, percent).collect()
        assert {r.doc_id: r.text for r in found} == brute_lines(rows, percent)
        assert sum(r.n_removed for r in found) > 10
        assert all(r[c] == c for r in found for c in clashing)
        assert {r.doc_id: r.n_lines for r in found} == {i: 0 if t is None else t.count("\n") + 1 for i, t in rows}
    assert lines.dedup_lines(docs.filter("false")).count() == 0


def variants(words, n, seed=21):
    """Pairs of lines of so many words, one of them replaced, with an edit similarity of 80 % or more."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    out = []
    while len(out) < n:
        line = [rng.choice(vocabulary) for _ in range(words)]
        other = list(line)
        other[rng.randrange(words)] = rng.choice(vocabulary)
        line, other = " ".join(line), " ".join(other)
        longest = max(len(line), len(other))
        if other != line and 100 * (longest - levenshtein(line, other)) >= 80 * longest:
            out.append((line, other))
    return out


def test_line_dedup_recall(spark):
    """Against edit similarity alone, and the same whatever else the table holds."""
    for words, least in ((40, 0.7), (100, 0.95)):
        pairs = variants(words, 60)
        rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
        gone = [{r.doc_id for r in lines.dedup_lines(frame(spark, more)).collect() if r.n_removed} - set(range(1000, 9000))
                for more in (rows, rows + [(1000 + i, p[0]) for i, p in enumerate(variants(9, 1500, 5))])]
        assert gone[0] == gone[1] and all(i % 2 for i in gone[0]) and len(gone[0]) >= least * len(pairs)


def test_a_repeated_word_has_one_vote(spark):
    """Long lines, every sixtieth word replaced by the same one."""
    rng = random.Random(2)
    line = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(1500)]
    other = ["x" if i % 60 == 0 else w for i, w in enumerate(line)]
    found = lines.dedup_lines(frame(spark, [(1, " ".join(line)), (2, " ".join(other))])).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 1}


def test_short_lines_take_part(spark):
    rows = [(1, "Menu\nAll rights reserved.\n\n..."), (2, "...\n\nALL rights reserved\nmenu\nOther"), (3, "home  page\nhome page")]
    found = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert found == {1: rows[0][1], 2: "...\n\nOther", 3: "home  page"}


def test_simhashes_count_votes():
    rng = np.random.default_rng(6)
    count = np.array([1, 2, 255, 256, 700, 4])
    words_ = rng.integers(0, 1 << 63, int(count.sum()), np.uint64)
    first = np.cumsum(count) - count
    found = lines.simhashes(words_, first, count, 3)
    for i, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        own = [int(w) for w in words_[a : a + n]]
        if n == 2:  # a word that two short lines share does not decide for both
            assert found[i, 0] != words_[a]
            continue
        for bit in range(64):
            votes = 2 * sum(w >> bit & 1 for w in own) + (own[0] >> bit & 1)
            assert (int(found[i, 0]) >> bit & 1) == (votes > n)
    assert len(np.unique(found)) == found.size


def test_simhashes_of_pieces(monkeypatch):
    """Lines of every length around a piece's, in groups of several sizes."""
    rng = np.random.default_rng(3)
    count = np.r_[np.arange(1, 40), 254:258, [509, 510, 511, 600]]
    words_ = rng.integers(0, 1 << 63, int(count.sum()), np.uint64) << np.uint64(1)
    first = np.cumsum(count) - count
    whole = lines.simhashes(words_, first, count, 2)
    for abreast in (1, 7):
        monkeypatch.setattr(lines, "ABREAST", abreast)
        assert (lines.simhashes(words_, first, count, 2) == whole).all()
    for i, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        own = words_[a : a + n]
        if n != 2:
            votes = np.unpackbits(own.astype(">u8").view(np.uint8)).reshape(n, 64).sum(axis=0, dtype=int)
            leading = np.unpackbits(own[:1].astype(">u8").view(np.uint8))
            assert (np.unpackbits(whole[i, :1].astype(">u8").view(np.uint8)) == (2 * votes + leading > n)).all()


def test_lines_that_stand_in_many_texts_are_sketched_once(spark):
    """Their keys alone are no keys that several lines have, so none travels."""
    names = spark.createDataFrame(
        [(i, 5, bytearray(np.random.default_rng(i).bytes(8 * lines.SIMHASHES))) for i in (1, 2, 3)] +
        [(4, 5, bytearray(np.random.default_rng(1).bytes(8 * lines.SIMHASHES)))],
        "name long, length int, sketch binary",
    )
    found = lines.shared_keys(names).collect()
    assert {r.name for r in found} == {1, 4} and len(found) == 2 * len({r.key for r in found}) == 4 * lines.SIMHASHES


def test_block_keys_meet():
    """Sketches that differ in fewer bits than there are blocks share a key."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        one = rng.integers(0, 1 << 63, (1, lines.SIMHASHES), np.uint64)
        other, blocks = one.copy(), 2 * lines.SIMHASHES
        for bit in rng.permutation(64 * lines.SIMHASHES)[: blocks - 1].tolist():
            other[0, bit // 64] ^= np.uint64(1 << bit % 64)
        assert np.isin(lines.block_keys(one), lines.block_keys(other)).any()
        assert len(np.unique(lines.block_keys(one))) == blocks


def test_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(200):
        v = base[rng.integers(0, 8)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.3])
        rows.append((100 + i, (v * rng.choice([1, 7.5])).tolist()))
    odd = [
        (1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15),
        (1004, [float("nan")] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15), (1006, [1.0, 2.0]),
        (1007, [2.0, 4.0]), (1008, [1e300] * 16), (1009, [2e300] * 16),
    ]
    good = [r for r in rows + odd[6:]]
    links = []
    for a, x in good:
        for b, y in good:
            if a < b and len(x) == len(y):
                x_, y_ = (np.array(z) / np.max(np.abs(z)) for z in (x, y))
                if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.9:
                    links.append((a, b))
    expected = groups([i for i, _ in rows + odd], links)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn(
        "cls", F.lit("clash"))
    found = vectors.near_vectors(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {
        i: (degree[i], c, c == i) for i, c in expected.items()
    }
    assert vectors.near_vectors(table.filter("false")).count() == 0


def test_graphs_travel_in_pieces(spark, monkeypatch):
    """No row holds a whole graph or shard, and the marked links alone connect what all links connect."""
    monkeypatch.setattr(vectors, "PIECE", 1 << 13)
    monkeypatch.setattr(vectors, "SHARD_VALUES", 4000)
    monkeypatch.setattr(vectors, "HELD_LINKS", 50)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(1200, 16))
    x[600:] = x[rng.integers(0, 5, 600)] + rng.normal(size=(600, 16)) * 0.1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    points = table.selectExpr("vec_id AS cls", "1L AS size", "embedding AS v", "16 AS dim", f"{16 << 32} + vec_id % 5 AS shard")
    built = vectors.graphs(points, 0.9, 5)
    held = built.agg(F.max(F.length("data")).alias("most"), F.count("*").alias("n"), F.count_distinct("shard").alias("shards")).first()
    assert held.most <= vectors.PIECE and held.shards == 5 and held.n > 15
    links = vectors.search(points, built, 0.9, 5).collect()
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.argwhere(np.triu(x @ x.T >= 0.9, 1)).tolist()
    assert sorted([r.a, r.b] for r in links) == near
    marked = [(r.a, r.b) for r in links if r.tree]
    assert groups(range(1200), marked) == groups(range(1200), near) and len(marked) < len(near) / 3
    degree = np.bincount(np.array(near).ravel(), minlength=1200)
    found = vectors.near_vectors(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {
        i: (degree[i], c) for i, c in groups(range(1200), near).items()
    }


def test_a_hub_is_linked_back_in_steps(monkeypatch):
    """Many nodes that offer themselves to one, and small steps, leave the same graph."""
    rng = np.random.default_rng(22)
    x = rng.normal(size=(2500, 24))
    x[1::2] = x[0] + rng.normal(size=(1250, 24)) * 0.3
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    whole = vectors.Graph.build(x)
    monkeypatch.setattr(vectors, "HELD", 1 << 16)
    steps = vectors.Graph.build(x)
    assert all((a == b).mean() > 0.99 for a, b in zip(whole.layers, steps.layers))
    assert steps.audit(0.9) >= vectors.RECALL
    bare = vectors.Graph.unpack(steps.pack(vectors=False), steps.x)
    assert all((a == b).all() for a, b in zip(bare.layers, steps.layers)) and bare.beam == steps.beam


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 32)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = vectors.Graph.build(x)
    assert graph.audit(0.9) >= vectors.RECALL
    again = vectors.Graph.unpack(graph.pack())
    found = sum(map(len, again.above(x, 0.9)))
    assert found >= 0.99 * np.count_nonzero(x.astype(np.float32) @ x.T.astype(np.float32) >= 0.9)


def test_audit_sees_small_groups():
    """Many easy links of one group do not hide that no pair outside of it is found."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 32))
    x[:1000] = x[0] + rng.normal(size=(1000, 32)) * 0.05
    x[2000:] = x[1000:2000] + rng.normal(size=(1000, 32)) * 0.05
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    lists = np.full((3000, vectors.LINKS), -1, np.int32)
    lists[:1000] = rng.integers(0, 1000, (1000, vectors.LINKS))
    graph = vectors.Graph(x, [lists], 0)  # only the group is linked
    assert graph.audit(0.9) >= vectors.RECALL and graph.beam == 3000
    assert all(i + 1000 in f for i, f in zip(range(1000, 2000), graph.above(x[1000:2000], 0.9)))


def test_audit_without_links_of_its_own():
    """No two members link; vectors of other shards must still be found."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(12000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = vectors.Graph.build(x)
    graph.beam = 4
    assert graph.audit(0.9, x[:50] + np.float32(0)) >= vectors.RECALL and graph.beam > 4
    asked = x[:1000] + rng.normal(size=(1000, 64)).astype(np.float32) * 0.04
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    true = (asked * x[:1000]).sum(axis=1) >= 0.9
    found = [i in f for i, f in enumerate(graph.above(asked, 0.9))]
    assert true.sum() > 500 and np.mean(np.array(found)[true]) >= 0.97
