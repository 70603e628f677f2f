"""Ranked lexical search: posting lists cut into blocks of similar documents, skipped by exact bounds.

Documents become vectors of the items' terms where they are read. Each task indexes its documents in
shards: the posting list of a term is clustered by a random projection of its documents, and cut into
blocks; a block's summary has the largest value of each term among its documents, rounded up to a byte. An
item visits the blocks of its terms from the highest bound down, scores their documents exactly, and
stops where no bound reaches the lowest score it keeps, which it takes along to the next shard. Of each
task, only the best documents of each item move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.words import buffers, hash_spans, spans, steps
from auditloom.session import cut

#: Documents an item gets.
BEST = 20
#: Term rows of the items that are broadcast at once; items beyond them take another pass.
SLICE_TERMS = 1 << 20
#: Documents of a shard, terms of a group of items (a longer item stands alone), bytes of a shard's table,
#: documents of a block, clusters of a list, dimensions of the projection, blocks visited first.
SHARD_DOCS, GROUP_TERMS, TABLE_BYTES, BLOCK, CLUSTERS, SKETCH, FIRST = 4096, 4096, 32 << 20, 64, 64, 16, 8
#: A summary's unit is 2 to this power; values are below a million, so a byte holds them.
UNIT_BITS = 12
_LAST = np.iinfo(np.int64).max

#: Letters: A-Z lower-cased; all that stands between terms is a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a text column in order, and the number of terms of each text."""
    data, offsets = buffers(column)
    data = _FOLD[data]
    starts, ends = spans(data, offsets)
    return hash_spans(data, starts, ends), np.diff(np.searchsorted(starts, offsets))


def _counted(numbers: np.ndarray, owner: np.ndarray, texts: int, kinds: int):
    """Ends of each text's part, distinct numbers in it, and how often each occurs."""
    pairs, times = np.unique(owner * kinds + numbers, return_counts=True)
    return np.searchsorted(pairs, np.arange(texts + 1) * kinds), pairs % max(kinds, 1), times


def item_terms(items: DataFrame) -> DataFrame:
    """`item, term, times` (term: a hash) of `item, text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, 1):
                hashes, counts = terms_of(step.column(1))
                known, numbers = np.unique(hashes, return_inverse=True)
                owner = np.repeat(np.arange(len(counts)), counts)
                ends, number, times = _counted(numbers, owner, len(counts), len(known))
                of = pa.array(np.repeat(np.arange(len(counts)), np.diff(ends)))
                yield pa.RecordBatch.from_arrays([
                    step.column(0).take(of), pa.array(known[number].view(np.int64)), pa.array(times, pa.int32()),
                ], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term long, times int")


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """`doc_id, n, terms, tfs`: a document's number of terms, and those of `vocabulary` (by place in it)."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            for step in steps(batch, 1):
                hashes, counts = terms_of(step.column(1))
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                owner = np.repeat(np.arange(len(counts)), counts)[hit]
                ends, numbers, times = _counted(at[hit], owner, len(counts), len(known))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    step.column(0), pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
                ], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<int>"
    )


class Group:
    """Some items: `terms` (places in the vocabulary) that they have, and of each item its number, columns
    and weights."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.terms = np.unique(np.concatenate([t for _, t, _ in items]))
        self.items = [(number, np.searchsorted(self.terms, t), w) for number, t, w in items]
        self.directions = np.random.default_rng(7).standard_normal((len(self.terms), SKETCH)).astype(np.float32)


def groups(items: list[tuple[int, np.ndarray, np.ndarray]]) -> list[Group]:
    """Items (`number, terms, weights`) in groups with about `GROUP_TERMS` terms each."""
    out, held, size = [], [], 0
    for item in items:
        if held and size + len(item[1]) > 2 * GROUP_TERMS:
            out.append(Group(held))
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    return [*out, Group(held)] if held else out


class Shard:
    """Blocked posting lists of some documents for the terms of a group.

    `owner, column, value` are the postings by document; every value is below a million.
    """

    def __init__(self, n: int, owner: np.ndarray, column: np.ndarray, value: np.ndarray, group: Group) -> None:
        self.column, self.value = column, value
        self.ends = np.searchsorted(owner, np.arange(n + 1))
        units = np.zeros((n, len(group.terms)), np.uint8)
        units[owner, column] = (value + (1 << UNIT_BITS) - 1) >> UNIT_BITS
        sketch = np.zeros((n, SKETCH), np.float32)
        has = np.flatnonzero(np.diff(self.ends))
        if len(has):
            sums = np.add.reduceat(group.directions[column] * value[:, None].astype(np.float32), self.ends[has], axis=0)
            sketch[has] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        order = np.argsort(column, kind="stable")
        edges = np.searchsorted(column[order], np.arange(len(group.terms) + 1))
        members, summaries, first = [], [], np.zeros(len(group.terms) + 1, np.int64)
        for t, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            made = 0
            if b > a:
                docs = self._clustered(owner[order[a:b]], sketch)
                made = -(-len(docs) // BLOCK)
                members += [docs[i : i + BLOCK] for i in range(0, len(docs), BLOCK)]
                if made == 1:
                    summaries.append(units[docs].max(axis=0)[None])
                else:  # the last document stands again for places that are left
                    full = np.r_[docs, np.repeat(docs[-1:], made * BLOCK - len(docs))]
                    summaries.append(units[full].reshape(made, BLOCK, -1).max(axis=1))
            first[t + 1] = first[t] + made
        self.first, self.members = first, members
        self.summaries = np.concatenate(summaries) if summaries else np.zeros((0, len(group.terms)), np.uint8)

    @staticmethod
    def _clustered(docs: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """The documents of a list, similar ones next to each other."""
        if len(docs) <= BLOCK:
            return docs
        many = min(CLUSTERS, len(docs) // BLOCK + 1)
        own = sketch[docs]
        near = own @ own[np.arange(many) * len(docs) // many].T
        cluster = near.argmax(axis=1)
        return docs[np.lexsort((-near[np.arange(len(docs)), cluster], cluster))]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        starts, sizes = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - begin, sizes)
        return np.add.reduceat(self.value[at] * weights[self.column[at]], begin)

    def search(self, columns: np.ndarray, weights: np.ndarray, found: Best, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Offer `found` all documents that can be among the best of an item."""
        blocks = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in columns.tolist()])
        if not len(blocks):
            return
        bounds = self.summaries[blocks[:, None], columns].astype(np.float64) @ (weights * float(1 << UNIT_BITS))
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        dense = np.zeros(self.summaries.shape[1], np.int64)
        dense[columns] = weights
        seen = np.zeros(len(ids), bool)
        at, size = 0, FIRST
        while True:
            end = min(at + size, int(np.searchsorted(-bounds, -max(found.least, 1), "right")))
            if end <= at:
                return
            docs = np.unique(np.concatenate([self.members[b] for b in blocks[at:end].tolist()]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            if len(docs):
                found.offer(self.scores(docs, dense), ids[docs], nulls[docs])
            at, size = end, 2 * size


class Best:
    """The best documents of an item so far; `least` is the score that another one must reach."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        keep = scores >= self.least
        if not keep.any():
            return
        scores = np.r_[self.scores, scores[keep]]
        ids, nulls = np.r_[self.ids, ids[keep]], np.r_[self.nulls, nulls[keep]]
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def searched(found: DataFrame, asked: list[Group], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """`item, score, doc_id`: the best `k` documents of each item in each task; `found` as of `vectors`."""
    table = found.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = table.value
        best = {number: Best(k) for group in asked for number, _, _ in group.items}

        def index(parts: list[pa.RecordBatch]) -> None:
            part = pa.Table.from_batches(parts).combine_chunks()
            nulls = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = part["doc_id"].fill_null(_LAST).to_numpy()
            lists = part["terms"].combine_chunks()
            owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            terms = lists.flatten().to_numpy()
            tf = part["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 75 + (25 * part["n"].to_numpy() * n_docs) // n_terms
            value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
            for group in asked:
                size = max(1, TABLE_BYTES // len(group.terms))
                column = np.minimum(np.searchsorted(group.terms, terms), len(group.terms) - 1)
                mine = group.terms[column] == terms
                for low in range(0, len(ids), size):
                    some = mine & (owner >= low) & (owner < low + size)
                    high = min(low + size, len(ids))
                    shard = Shard(high - low, owner[some] - low, column[some], value[some], group)
                    for number, columns, weights in group.items:
                        shard.search(columns, weights, best[number], ids[low:high], nulls[low:high])

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                held.append(batch.slice(at, SHARD_DOCS))
                size += held[-1].num_rows
                if size >= SHARD_DOCS:
                    index(held)
                    held, size = [], 0
        if held:
            index(held)
        for number, b in best.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(b.ids), number)), pa.array(b.scores), pa.array(b.ids, mask=b.nulls),
            ], ["item", "score", "doc_id"])

    return found.mapInArrow(run, "item long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """`item_id, rank, doc_id, score`: the `k` best of `docs` (`doc_id, text`) for each of `items`.

    Scores are those of the query's contract, above 0; equal ones go by ascending `doc_id`, null last.
    Repeated rows of `docs` are documents of their own. Rows of `items` with equal id and text are
    one item, those with equal ids and different texts are ranked apart. Null and empty texts have no
    terms. Terms are named by 64-bit hashes: a word is taken for a term of an item with odds of
    (terms of items) x (distinct words) / 2^64. Very long texts are vectors like others.
    """
    numbered = cut(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    terms = cut(item_terms(numbered))
    slices = max(1, -(-terms.count() // SLICE_TERMS))
    results = []
    for i in range(slices):  # one, unless the items are very many
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == i).orderBy("item", "term").collect()
        vocabulary = np.unique(np.array([r.term for r in rows], np.int64).view(np.uint64))
        if not len(vocabulary):
            continue
        found = cut(vectors(docs, vocabulary))
        total = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not total[0]:
            continue
        held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * total[0] + 2) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(vocabulary), np.int64)
        for term, w in held.select("term", weight).collect():  # one row per term of the slice
            weights[term] = w
        places = np.searchsorted(vocabulary, np.array([r.term for r in rows], np.int64).view(np.uint64))
        times = np.array([r.times for r in rows], np.int64)
        edges = np.flatnonzero(np.r_[True, np.diff([r.item for r in rows]) != 0])
        asked = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)]):
            w = times[a:b] * weights[places[a:b]]
            if w.any():
                asked.append((rows[a].item, places[a:b][w > 0], w[w > 0]))
        if asked:
            results.append(searched(found, groups(asked), total[0], total[1], k))
    if not results:
        return numbered.limit(0).select(
            "item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")
        )
    all_of = results[0]
    for more in results[1:]:
        all_of = all_of.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = all_of.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return first.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
