"""Remove long repeated word sequences, found by recompression.

Rounds replace short runs of one symbol and pairs of symbols by new symbols, named by a hash of
what they replace, so a name means the same words in every document. Each round decides from
the two or few symbols it joins alone: equal sequences get equal symbols except near their ends,
within `MARGIN` words. A first exchange tells which symbols occur in several documents; only windows whose
interior symbols all do are named themselves, and a second exchange tells which of those repeat. What
is left are true repeats, and the least document of each is found by an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import (
    Shared, buffers, distinct, hash_spans, mix, of_windows, shared_names, spans, steps,
)
from auditloom.session import cut

WINDOW = 50
#: Rounds: what is joined, and the most words that a new symbol may stand for.
ROUNDS = (("run", 2), ("pair", 2), ("pair", 4), ("pair", 4), ("pair", 8))
#: Words from a sequence's end within which its symbols depend on what lies beyond: each round adds
#: the length of one of its symbols.
MARGIN = sum(most for _, most in ROUNDS)

_U = np.uint64


def _join_runs(names, sizes, owner, most):
    first = np.flatnonzero(np.r_[len(names) > 0, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[first, len(names)])
    merged = (count > 1) & (count * sizes[first] <= most)
    keep = np.ones(len(names), bool)
    keep[np.repeat(merged, count)] = False
    head = first[merged]
    keep[head] = True
    names, sizes = names.copy(), sizes.copy()
    names[head] = mix(names[head] * _U(0x9FB21C651E98DF25) + count[merged].astype(np.uint64))
    sizes[head] *= count[merged]
    return names[keep], sizes[keep], owner[keep]


def _join_pairs(names, sizes, owner, most, turn):
    right = (mix(names + _U(0x632BE59BD9B4E019 * (turn + 1) & (1 << 64) - 1)) & _U(1)).astype(bool)
    merged = (
        ~right[:-1] & right[1:] & (owner[:-1] == owner[1:]) & (sizes[:-1] + sizes[1:] <= most)
    )
    head = np.flatnonzero(merged)
    names, sizes = names.copy(), sizes.copy()
    names[head] = mix(names[head] * _U(0xD6E8FEB86659FD93) + mix(names[head + 1] ^ _U(turn + 1)))
    sizes[head] += sizes[head + 1]
    keep = np.ones(len(names), bool)
    keep[head + 1] = False
    return names[keep], sizes[keep], owner[keep]


def compress(words: np.ndarray, counts: np.ndarray):
    """Names, lengths in words and texts of the last round's symbols, in order."""
    names, sizes = words, np.ones(len(words), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for turn, (kind, most) in enumerate(ROUNDS):
        if kind == "run":
            names, sizes, owner = _join_runs(names, sizes, owner, most)
        else:
            names, sizes, owner = _join_pairs(names, sizes, owner, most, turn)
    return names, sizes, owner


def candidates(words: np.ndarray, counts: np.ndarray, shared: Shared, window: int):
    """Hash, text and place of each window whose interior symbols all occur in several documents."""
    names, sizes, owner = compress(words, counts)
    end = np.cumsum(sizes)
    start = end - sizes
    alone = ~shared.contains(names)
    first = np.cumsum(counts) - counts
    low = np.maximum(end[alone] - (window - MARGIN), first[owner[alone]])
    high = start[alone] - MARGIN
    excluded = np.zeros(len(words) + 1, np.int64)
    some = low <= high
    np.add.at(excluded, low[some], 1)
    np.add.at(excluded, high[some] + 1, -1)
    excluded = np.cumsum(excluded)
    hashes, own, place = of_windows(words, counts, window)
    keep = excluded[first[own] + place] == 0
    return hashes[keep], own[keep], place[keep]


class _Words:
    """Words of a slice of texts: their spans, hashes and numbers per text."""

    def __init__(self, column: pa.Array) -> None:
        self.data, offsets = buffers(column)
        self.starts, self.ends = spans(self.data, offsets)
        self.counts = np.diff(np.searchsorted(self.starts, offsets))
        self.hashes = hash_spans(self.data, self.starts, self.ends)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


FOUND = (
    "doc_id long, n_words long, kept_sha256 string, whole long, text string, at array<int>, names array<long>"
)


def _windows(docs: DataFrame, symbols: Broadcast, repeats: Shared, window: int) -> DataFrame:
    """One row of `FOUND` per document; `text`, `at` and `names` are null without a repeated window."""
    table = docs.sparkSession.sparkContext.broadcast((repeats.bits, repeats.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, twice = Shared(*symbols.value), Shared(*table.value)
        for batch in batches:
            for step in steps(batch, 1):
                words = _Words(step.column(1))
                names, own, place = candidates(words.hashes, words.counts, known, window)
                keep = twice.contains(names)
                names, own, place = names[keep].view(np.int64), own[keep], place[keep].astype(np.int32)
                sizes = np.bincount(own, minlength=step.num_rows)
                offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                none = pa.array(sizes == 0)
                ends = np.cumsum(words.counts)
                sums = np.zeros(len(words.hashes) + 1, np.uint64)
                order = np.arange(len(words.hashes), dtype=np.uint64)
                np.cumsum(mix(words.hashes ^ (order - np.repeat((ends - words.counts).astype(np.uint64), words.counts)) * _U(0xA0761D6478BD642F)), out=sums[1:])
                whole = mix((sums[ends] - sums[ends - words.counts]) + words.counts.astype(np.uint64))
                texts = step.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    step.column(0), pa.array(words.counts, pa.int64()),
                    pa.array([_sha((t or b"").split()) for t in texts]), pa.array(whole.view(np.int64)),
                    pa.array([t if n else None for t, n in zip(texts, sizes)], pa.binary()).cast(pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(place), mask=none),
                    pa.ListArray.from_arrays(offsets, pa.array(names), mask=none),
                ], ["doc_id", "n_words", "kept_sha256", "whole", "text", "at", "names"])

    return docs.mapInArrow(run, FOUND)


def _names(found: DataFrame, rows: DataFrame) -> DataFrame:
    """`doc_id, name` of the windows of `found` whose row is in `rows`, and perhaps of others."""
    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return mix(batch.column(0).to_numpy().astype(np.uint64))

    wanted = shared_names(rows, numbers, least=1, slices=lambda batch: [batch])
    table = found.sparkSession.sparkContext.broadcast((wanted.bits, wanted.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shared(*table.value)
        for batch in batches:
            batch = batch.filter(pa.array(known.contains(numbers(batch))))
            for at in range(0, batch.num_rows, 256):
                _, doc_id, name = batch.slice(at, 256).columns
                sizes = np.diff(name.offsets.to_numpy())
                names, sizes = distinct(name.flatten().to_numpy().view(np.uint64), sizes)
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                     pa.array(names.view(np.int64))],
                    ["doc_id", "name"],
                )

    return found.mapInArrow(run, "doc_id long, name long")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` for each row of `docs` (`doc_id, text`).

    A word goes if a window of `window` words around it also starts in a document with a smaller id;
    windows are those of the input. `with_text` adds `kept_text`, the words left, joined by one space
    (null where nothing went: the text stays as it is). A null text has no words; a null id is
    smaller than none, and such a row keeps all its words; rows with equal ids are not smaller than
    each other. Other columns are ignored. `window` must exceed twice `MARGIN` by the longest symbol.

    Windows are named by 64 bits: of 10^9 different repeated ones two share a name with a chance of
    3 percent.
    """
    if window < 2 * MARGIN + ROUNDS[-1][1]:
        raise ValueError(f"a window needs {2 * MARGIN + ROUNDS[-1][1]} words or more")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = plain.select("text")

    def symbols_of(step: pa.RecordBatch) -> np.ndarray:
        words = _Words(step.column(0))
        names, _, owner = compress(words.hashes, words.counts)
        return distinct(names, np.bincount(owner, minlength=step.num_rows))[0]

    symbols = shared_names(texts, symbols_of)
    table = docs.sparkSession.sparkContext.broadcast((symbols.bits, symbols.levels))

    def windows_of(step: pa.RecordBatch) -> np.ndarray:
        words = _Words(step.column(0))
        names, own, _ = candidates(words.hashes, words.counts, Shared(*table.value), window)
        return distinct(names, np.bincount(own, minlength=step.num_rows))[0]

    repeats = shared_names(texts, windows_of)
    found = cut(
        _windows(plain, table, repeats, window).withColumn("row", F.monotonically_increasing_id()),
        dense=True,
    )
    # a copy of a whole smaller document loses every word; its windows can be left out
    open_ = found.filter("at IS NOT NULL AND doc_id IS NOT NULL")
    least = open_.groupBy("whole", "n_words").agg(F.min("doc_id").alias("first"))
    copies = cut(
        open_.select("row", "doc_id", "whole", "n_words").join(least, ["whole", "n_words"])
        .select("row", "doc_id", "whole", (F.col("doc_id") > F.col("first")).alias("copy"))
    )
    names = _names(open_.select("row", "doc_id", "names"), copies.filter("NOT copy").select("row"))
    # windows that stay: the least document's own, in all its rows
    first = names.groupBy("name").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(
        F.collect_list("name").alias("own")  # at most the windows of one document
    )
    copied = copies.filter("copy").groupBy("doc_id").agg(F.collect_set("whole").alias("copied"))
    changed = (
        found.filter("text IS NOT NULL")
        .select("doc_id", "n_words", "kept_sha256", "whole", "text", "at", "names")
        .join(copied, "doc_id", "left").join(first, "doc_id", "left")  # texts move once
        .withColumn("copy", F.coalesce(F.array_contains("copied", F.col("whole")), F.lit(False)))
    )
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, n_words, sha, text, at, names, copy, own = batch.columns
            removed, kept_sha, kept_text = [], [], []
            for i, (t, c) in enumerate(zip(text.cast(pa.binary()), copy)):
                words = t.as_py().split()
                stay = np.zeros(len(words), bool)
                if not c.as_py():
                    place = at[i].values.to_numpy()
                    if own[i].is_valid:
                        place = place[~np.isin(names[i].values.to_numpy(), own[i].values.to_numpy())]
                    if not len(place) or not doc_id[i].is_valid:
                        removed.append(0)
                        kept_sha.append(sha[i].as_py())
                        kept_text.append(None)
                        continue
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, place, 1)
                    np.add.at(edges, place + window, -1)
                    stay = np.cumsum(edges)[:-1] == 0
                left = [w for w, s in zip(words, stay) if s]
                removed.append(len(words) - len(left))
                kept_sha.append(_sha(left))
                kept_text.append(b" ".join(left).decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([
                doc_id, n_words, pa.array(removed, pa.int64()), pa.array(kept_sha, pa.string()),
                pa.array(kept_text, pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = changed.select(
        "doc_id", "n_words", "kept_sha256", "text", "at", "names", "copy", "own"
    ).mapInArrow(remove, out)
    same = found.filter("text IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        F.lit(None).cast("string").alias("kept_text"),
    )
    result = same.unionByName(done)
    return result if with_text else result.drop("kept_text")
