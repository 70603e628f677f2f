"""Hard negatives for anchors: slots of scores, the best of each slot, merged from the top down.

An anchor's positives are its nearest rows of the same label. Each positive has a window of scores for its
negatives, which ends at a share of its own score. These upper limits cut the scores of an anchor into
disjoint slots; of each slot only the best rows are kept, first per block of rows, then over all. A window's
best rows are the best of its slot and of those below it, so all the overlapping windows of an anchor
are answered from one short list.

Rows are dealt into blocks of bounded size. A task holds one block, and all anchors pass by it in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import cut

#: Rows of a block on average, least number of blocks, scores that a task holds at once: bounds of
#: memory and of the number of tasks, results do not depend on them.
BLOCK_ROWS, BLOCKS, HELD_SCORES = 65_536, 32, 1 << 21
#: Positives of an anchor, negatives of a positive, limits of the window in percent of the positive's score.
POSITIVES, NEGATIVES, LOWER, UPPER = 5, 3, 50, 95
_NONE = np.iinfo(np.int64).min


def scaled(vector: Column, factor: int) -> Column:
    """`floor(factor * x)` of each component; null if the vector or a component is null or not finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(v, lambda c: F.floor(F.lit(float(factor)) * c)))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices, ends of the 64-bit range beyond it."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a, dtype=np.float64).max()) * float(np.abs(b, dtype=np.float64).max()) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    wide = np.dot(a.astype(object), b.T.astype(object))
    return np.clip(wide, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `k` highest `allowed` scores of each row; of equal ones the first columns."""
    n = scores.shape[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if int(np.abs(scores, dtype=np.float64).max(initial=0)) < 2**62 // n:
        order = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), _NONE)
        top = np.argpartition(order, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(scores), 1))
    else:
        top = np.lexsort((np.where(allowed, ~scores, 0), ~allowed), axis=1)[:, :k]
    row, at = np.nonzero(np.take_along_axis(allowed, top, axis=1))
    return row, top[row, at]


class _Block:
    """Rows of one block, by id."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], table["label"].to_numpy()[order]
        self.x = _matrix(table["v"].combine_chunks())[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _passing(
    rows: DataFrame, anchors: DataFrame, extra: str,
    choose: Callable[[_Block, pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> DataFrame:
    """`anchor_id, slot, id, score`: what `choose` takes of each block for each anchor.

    Anchors have the column `extra` besides. Every block gets all anchors of its dimension; they
    follow its rows, and are read batch by batch.
    """
    empty = F.lit(None).cast(anchors.schema[extra].dataType).alias(extra)
    blocks = rows.select("dim", "block").distinct()
    passing = anchors.join(blocks, "dim").select(
        "block", F.lit(True).alias("asks"), "id", "label", "v", extra
    )
    both = rows.select("block", F.lit(False).alias("asks"), "id", "label", "v", empty).unionByName(passing)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])]) if len(keys) else []
            for start, end in zip(edges, [*edges[1:], len(keys)]):
                part = batch.slice(start, end - start)
                if keys[start] != number:
                    number, held, block = keys[start], [], None
                if not asks[start]:
                    held.append(part.select([2, 3, 4]))
                    continue
                block = block or _Block(held)
                size = max(1, HELD_SCORES // len(block.ids))
                for at in range(0, part.num_rows, size):
                    some = part.slice(at, size)
                    scores = inner(_matrix(some.column(4)), block.x)
                    slot, row, column = choose(block, some, scores)
                    yield pa.RecordBatch.from_arrays([
                        some.column(2).take(pa.array(row)), pa.array(slot, pa.int32()),
                        pa.array(block.ids[column]), pa.array(scores[row, column]),
                    ], ["anchor_id", "slot", "id", "score"])

    return (
        both.repartition(partitions, "block").sortWithinPartitions("block", "asks")
        .mapInArrow(run, "anchor_id long, slot int, id long, score long")
    )


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")


def nearest_alike(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """`anchor_id, id, score` of the `k` best other rows of each anchor's label."""

    def choose(block: _Block, some: pa.RecordBatch, scores: np.ndarray):
        alike = some.column(3).to_numpy()[:, None] == block.labels
        alike &= some.column(2).to_numpy()[:, None] != block.ids
        row, column = best(scores, alike, k)
        return np.zeros(len(row), np.int32), row, column

    found = _passing(rows, anchors.withColumn("limits", F.lit(None).cast("array<long>")), "limits", choose)
    return _first(found, ["anchor_id"], k).select("anchor_id", "id", "score")


def best_of_slots(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """`anchor_id, slot, id, score`: the `k` best rows of another label in each slot of each anchor.

    `limits` of an anchor has the upper ends of its slots, descending, and last the least score
    that any window reaches; a slot holds the scores up to its end and above that of the next one.
    """

    def choose(block: _Block, some: pa.RecordBatch, scores: np.ndarray):
        limits = some.column(5).to_pylist()
        most = max(map(len, limits))
        ends = np.array([[*x[:-1], *[x[-1] - 1] * (most - len(x) + 1)] for x in limits], np.int64)
        other = some.column(3).to_numpy()[:, None] != block.labels
        slots, rows_, columns = [], [], []
        for i in range(most - 1):
            inside = other & (scores <= ends[:, i, None]) & (scores > ends[:, i + 1, None])
            row, column = best(scores, inside, k)
            slots.append(np.full(len(row), i, np.int32))
            rows_.append(row)
            columns.append(column)
        return np.concatenate(slots), np.concatenate(rows_), np.concatenate(columns)

    return _first(_passing(rows, anchors, "limits", choose), ["anchor_id", "slot"], k)


def _percent(score: str, percent: int, up: bool) -> Column:
    return F.expr(f"cast({'ceil' if up else 'floor'}(cast({score} AS decimal(20, 0)) * {percent} / 100) AS bigint)")


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    lower: int = LOWER, upper: int = UPPER,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score` from `vec_id, label, v`.

    `label` is a whole number, `v` holds whole numbers (`scaled` makes them), `anchors` is a condition
    on `vec_id`. Scores are exact inner products. An anchor's positives are its `positives` best rows of
    the same label, and a positive's negatives the `negatives` best rows of other labels with
    `lower * positive_score <= 100 * negative_score <= upper * positive_score`; higher scores first, ties
    by id. Rows with a null id, label, vector or component take no part. An id names one row: of several
    that share it, the least by label, then by vector, stays. Vectors of different lengths do not meet.
    A positive without negatives has no row, so no anchors or an empty table give none. Products
    beyond 64 bits count as the end of that range. Other columns are ignored.
    """
    v = F.col("v").cast("array<long>")
    plain = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    named = cut(plain.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*"))
    blocks = max(BLOCKS, -(-named.count() // BLOCK_ROWS))
    dim = F.size("v")
    dealt = named.select(
        F.col("vec_id").alias("id"), "label", "v", dim.alias("dim"),
        (dim * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(blocks))).alias("block"),
    )
    asking = named.filter(anchors).select(F.col("vec_id").alias("id"), "label", "v", dim.alias("dim"))
    alike = cut(
        nearest_alike(dealt, asking, positives)
        .withColumns({"least": _percent("score", lower, True), "most": _percent("score", upper, False)})
        .filter("least <= most")
    )
    windows = alike.groupBy("anchor_id").agg(
        F.collect_list(F.struct(F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "least", "most")).alias("windows"),
        F.concat(F.sort_array(F.collect_set("most"), asc=False), F.array(F.min("least"))).alias("limits"),
    )
    windows = cut(windows)  # at most `positives` windows each
    bounded = asking.join(windows.select(F.col("anchor_id").alias("id"), "limits"), "id")
    # the slots of an anchor from the top down, each in order: one sorted list
    lists = best_of_slots(dealt, bounded, negatives).groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("below"), "id"))).alias("best")
    )
    answered = windows.join(lists, "anchor_id").select("anchor_id", F.explode("windows").alias("w"), "best")
    suffix = F.slice(F.filter("best", lambda x: -x["below"] <= F.col("w.most")), 1, negatives)
    inside = F.filter(suffix, lambda x: -x["below"] >= F.col("w.least"))
    return answered.select("anchor_id", "w.*", F.posexplode(inside).alias("nth", "n")).select(
        "anchor_id", "positive_id", (F.col("nth") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", (-F.col("n.below")).alias("negative_score"),
    )
