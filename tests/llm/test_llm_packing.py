"""Mixing and packing: plain recomputation, invariants and exact round trips."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.llm import mixing, packing
from auditloom.llm.queries import vocabulary
from auditloom.llm.worker import given_back

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Share, cap and share again what is left over, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        free -= over
    return out


def mixed_corpus():
    rng = random.Random(4)
    rows = [(None, "a b", "a"), (3, None, "b"), (4, "", None), (5, "x " * 900, "c"), (6, "y", "void" * 3)]
    for i in range(500):
        source = rng.choice(["a"] * 6 + ["b", "c", "d", "é", "Z", "", None])
        rows.append((100 + i, "w " * rng.randint(0, 80), source))
    rows += [(1000 + i // 2, "twice here", "b") for i in range(10)] + [(7, None, "empty source")]
    return rows


def test_mix(spark):
    rows = mixed_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("h", F.lit(1))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    targets, taken, most = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for r in found:
        assert r.size == len(WORDS.findall(r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], 2 * r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= most[s]
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id or 0, r.text or "", r.source or "", r.taken)
    assert sorted(map(key, again)) == sorted(map(key, found))
    repeated = mixing.repeated(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in found)
    assert mixing.mix(docs.filter("false")).count() == 0


def test_nested_budgets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", None]), rng.randint(0, 50)) for i in range(300)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn(
        "h", mixing.hashed(F.col("doc_id")))
    budgets = spark.createDataFrame(
        [(s, i, b) for s in ("a", None) for i, b in enumerate((0.0, 500.0, 1500.0, 1e9))],
        "source string, budget_id int, budget double")
    limits = {(r.source, r.budget_id): r.threshold for r in mixing.thresholds(sizes, budgets).collect()}
    hashed = [(r.source, r.h, r["size"]) for r in sizes.collect()]
    for s in ("a", None):
        own = [limits[s, i] for i in range(4)]
        assert own == sorted(own)
        sums = [sum(z for x, h, z in hashed if x == s and h < t) for t in own]
        assert sums[3] == sum(z for x, _, z in hashed if x == s)
        assert all(abs(a - b) <= 50 for a, b in zip(sums, (0, 500, 1500)))


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = "aAbéÉßÜñçİKΣ漢'’.,;:!?-0139#<|>́\xa0\x1c  \t\n\x0b"
    texts = [None, "", " ", "it's don't. we'll, x.y... <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b,",
             "Hello, World! 12,5% über’s ﬁn éa", "word " * 9000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.withColumn("bin", F.lit("clash"))
    rows = packing.pack_documents(docs, path).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for k, r in enumerate(own):
            part = np.array(ids[r.start : r.start + 4096], "<u4")
            assert (r.piece, r.length) == (k, len(part)) and r.ids_crc32 == zlib.crc32(part.tobytes())
    least = -(-sum(r.length for r in rows) // 4096)
    assert check_packed(rows, 4096) <= least + 1
    assert packing.pack_documents(docs.filter("false"), path).count() == 0


def test_pack_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rng = random.Random(3)
    lengths = [rng.choice([1, 5, 30, 40, 51, 60, 99, 100]) for _ in range(1500)]
    rows = spark.createDataFrame([(x,) for x in lengths], "length long").withColumn("uid", F.lit("clash"))
    found = packing.pack(rows, 100).collect()
    assert sorted(r.length for r in found) == sorted(lengths)
    fresh = len(set(packing.best_fit(np.array(lengths), 100).tolist()))
    assert check_packed(found, 100) <= 1.02 * fresh + 1


def test_local_search_empties_bins():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 100, 60)
        bins = rng.permutation(60)
        better = packing.local_search(lengths, bins, 100)
        fill = np.bincount(better, lengths)
        assert fill.max() <= 100 and len(np.unique(better)) < 60
    # one bin too many: only an exchange of two for one helps
    lengths = np.array([50, 30, 40, 40, 20, 20])
    bins = np.array([0, 0, 1, 1, 2, 2])
    assert len(np.unique(packing.local_search(lengths, bins, 100))) == 2


@pytest.mark.parametrize("low, high", [(700, 1600), (500, 900)])
def test_local_search_comes_near_the_bound(low, high):
    lengths = np.random.default_rng(1).integers(low, high + 1, 4096)
    fitted = packing.best_fit(lengths, 4096)
    better = packing.local_search(lengths, fitted, 4096)
    fill = np.bincount(better, lengths)
    least = -(-int(lengths.sum()) // 4096)
    assert fill.max() <= 4096 and len(better) == len(lengths)
    assert len(np.unique(better)) <= 1.01 * least < 1.02 * least < len(np.unique(fitted))


def test_step_of_a_bin_with_many_documents():
    """Two of 26 documents of 2 for one of 3 is the only step."""
    lengths = np.array([2] * 26 + [3, 96])
    bins = np.array([0] * 26 + [1, 1])
    fill, room = np.array([52, 99]), np.array([48, 1])
    gain, group, receiver, other = packing._step(lengths, bins, list(range(26)), 0, fill, room)
    assert (gain, len(group), receiver, other) == (1, 2, 1, 26)
    assert packing._step(lengths, bins, [26, 27], 1, fill, room) is None


def own_memory():
    """MB that this process alone holds, without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_memory_goes_back_when_a_task_ends():
    stays = []

    def run(batches):
        for batch in batches:
            parts = [bytes(50_000) for _ in range(4000)]
            stays.append(bytes(50_000))  # lies behind the rest, as what a worker keeps may
            yield batch.slice(0, len(parts) // 4000)

    before = own_memory()
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert [b.num_rows for b in given_back(run)(iter([batch, batch]))] == [1, 1]
    assert len(stays) == 2 and own_memory() - before < 50


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    path = vocabulary("word_bpe_49k.json")
    encoder, whole = packing.WordEncoder(path), packing.WordEncoder(path)
    letters = str.maketrans("0123456789", "abcdefghij")
    for i in range(40):
        text = " ".join(["often", *(str(1000 + (20 * i + k) % 700).translate(letters) for k in range(20)), "a-b"])
        ids = np.array(whole.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode([text.encode()]) == [ids]
        assert len(encoder.words) <= 60 and len(encoder.older) <= 60 and b"often" in encoder.words
    assert len(encoder.older) > 0  # words met lately are not encoded again


def test_worker_memory_after_packing(spark):
    """A million different words leave less in a worker than the words themselves take."""
    words = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.translate(
        F.hex(F.col("id") * 500 + i + (1 << 24)), "0123456789", "ghijklmnop"))
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    assert packing.pieces(docs, vocabulary("word_bpe_49k.json")).agg(F.sum("length")).first()[0] > 1_000_000

    def held(batches):
        for batch in batches:
            with open("/proc/self/smaps_rollup") as f:
                mb = int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024
            yield pa.RecordBatch.from_pydict({"mb": [mb] * batch.num_rows})

    most = spark.range(0, 16, 1, 16).mapInArrow(held, "mb double").agg(F.max("mb")).first()[0]
    assert most < 190
